"""The filter audit, the source divergence audit and the ZIP-packaged archives against plain Python."""

import base64
import hashlib
import io
import re
import zipfile
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from newsweave.llm import divergence, filter_audit, warc

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
rng = np.random.default_rng(11)
WORDS = ["".join(rng.choice(list("abcdéXYZ#1"), rng.integers(1, 6))) for _ in range(150)]


def prose(n):
    return " ".join(WORDS[int(i)] for i in np.minimum(rng.zipf(1.4, n) - 1, 149))


TEXTS = [prose(int(n)) for n in rng.integers(0, 140, 60)] + [None, "", " \t\n", "plain words only " * 30, "ÀÉ" * 300, "A" * 40 + " b" * 60, "x" * 70_000, "one two three\x85four"]
DOCS = [(i, t, ["en", "de", None, ""][i % 4], [None, "", "a", "b", "é", "c"][i % 6]) for i, t in enumerate(TEXTS + TEXTS[5:25] + TEXTS[60:64])]
DOCS += [DOCS[3], DOCS[3], (3, TEXTS[4], "en", "a"), (3, TEXTS[3], "fr", "b"), (None, TEXTS[7], "en", "a"), (None, TEXTS[7], "en", "a"), (None, TEXTS[8], "en", "a"), (None, None, None, None), (-5, TEXTS[9], "zz", "lonely")]
SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, word string, vector int, total int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x", 1, "y", 2, 3) for d in DOCS], SCHEMA).repartition(3).cache()


def test_filter_audit(spark, docs):
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (4, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, _, s in DOCS:
        text = t or ""
        words = WORD.findall(text)
        again = i is not None and any((u or "") == text and j is not None and j < i for j, u, *_ in DOCS)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), again)
        parts[s or ""].append((frozenset(f for f, x in zip("ABCDE", fails) if x), i in good, i in toxic))
    want, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[0]]
                failing = [r for r in rows if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[part, f] += len(out)
                want[part, order, step] = (len(left), len(out), len(failing) - len(out), sum(r[0] == {f} for r in rows), sum(r[1] for r in out), sum(r[2] for r in out))
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[3:9] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def brute_divergence(rows, most):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for _, t, lang, source in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= 3]
        names = sorted(s for x, s in groups if x == lang)

        def chances(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: chances(counts[lang, s]) for s in names}
        q = chances(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, n) for n, (item, v) in enumerate(ranked, 1) if part == "pair" or n <= most}
    return out


@pytest.mark.parametrize(("bucket", "block", "most"), [(20_000, 256, 200), (7, 2, 5)])
def test_divergence(docs, monkeypatch, bucket, block, most):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    want = brute_divergence(DOCS, most)
    for frame in (docs, docs.repartition(2)):
        got = divergence.divergences(frame, most_terms=most).collect()
        assert len(got) == len(want)
        assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == want
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_divergence_without_kept_terms(docs):
    got = divergence.divergences(docs, least_docs=10_000).collect()
    assert got and {(r.part, r.value) for r in got} == {("pair", 0)}


def test_blocks_of_sources():
    """A task that holds few sources at a time gives the same sums, counts beyond 64 bits of product included."""
    import pyarrow as pa

    names = [f"s{i:02}" for i in range(9)]
    own = np.random.default_rng(2)
    vectors = [[{"source": n, "n": int(v)} for n, v in zip(names, own.integers(0, 4, 9)) if v] or [{"source": "s00", "n": 10**10}] for _ in range(40)]
    times = [int(x) for x in own.integers(1, 5, 40)]
    total = {n: sum(k * e["n"] for v, k in zip(vectors, times) for e in v if e["source"] == n) for n in names}
    kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    left = pa.table({"vid": [str(i) for i in range(40)], "vector": pa.array(vectors, kind), "times": times})
    right = pa.table({"source": names[::-1], "total": [total[n] for n in names[::-1]], "terms": [sum(times)] * 9})
    chance = lambda n, all_: 1 + 10**9 * (n + 1) // (all_ + sum(times))
    want = Counter()
    for v, k in zip(vectors, times):
        n = {e["source"]: e["n"] for e in v}
        p = {s: chance(n.get(s, 0), total[s]) for s in names}
        for s in names:
            for t in names:
                want[s, t] += k * ((p[s] - p[t]) ** 2 // p[t])
    size = divergence.BLOCK
    try:
        for divergence.BLOCK in (256, 4):
            got = Counter()
            for block in range(-(-9 // divergence.BLOCK)):
                for r in divergence._bucket((pa.scalar("x"), pa.scalar(0), pa.scalar(block)), left, right).to_pylist():
                    if r["item"]:
                        got[r["source"], r["item"]] += r["value"]
            assert got == {k: v for k, v in want.items() if k[0] != k[1]}
    finally:
        divergence.BLOCK = size


PAGES = [(i, f"https://a.test/{i} ü\n?q=1", h) for i, h in enumerate(["<p>a</p>", "", None, "<p>a</p>", "é" * 4000, "x" * 300_000, "<p>b</p>\r\n\r\nWARC/1.1\r\n"] * 3)]
PAGES += [(3, "again", "<p>a</p>"), (0, None, "<p>a</p>"), (None, None, "<p>a</p>"), (None, "u", "alone"), (None, "v", "alone"), (-7, "w", "late")] + [(100 + i, None, "hot") for i in range(60)]


def base32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_rows(least=0):
    out = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "").encode() == raw and j is not None]
        first = min(same, default=None) if len(raw) >= least else i
        revisit = first is not None and i != first
        out[i, len(raw), base32(raw), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x", "y") for p in PAGES], "page_id long, url string, html string, key int, digest string, first_id string").repartition(3).cache()


@pytest.mark.parametrize("least", [0, 5])
def test_archives(pages, least, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    assert Counter(map(tuple, warc.archive_report(pages, least).collect())) == page_rows(least)
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_archives_in_ranges(spark, pages, tmp_path):
    manifest = warc.write_packages(pages, f"file:{tmp_path}", package_bytes=2000)
    assert manifest.count() > 6
    for size in (1, 700, 1 << 22):
        got = warc.read_packages(manifest, range_bytes=size).collect()
        assert len(got) == len(PAGES)
        texts = Counter((h or "").encode() for _, _, h in PAGES)
        assert {bytes(r.payload) for r in got if r.record_type == "response"} == set(texts)
        assert all(base32(bytes(r.payload)) == r.payload_digest for r in got if r.payload is not None)
        assert {r.target_uri for r in got if r.record_id == "<urn:page:4>"} == {"https://a.test/4%20%C3%BC%0A?q=1"}


def package(members, before=b"", comment=b"", compress=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data, zipfile.ZIP_DEFLATED if name in compress else zipfile.ZIP_STORED)
        z.comment = comment
    return before + out.getvalue()


def reader(raw):
    return (lambda start, n: raw[start : start + n]), len(raw)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it" + b"." * 300])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 50])
def test_directories(monkeypatch, wide, comment, before):
    if wide:  # every size and offset is written as a 64-bit one
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    members = {"archive/data.warc.gz": b"a" * 1000, "indexes/é.cdxj": b"", "datapackage.json": b"{}" * 40}
    raw = package(members, before, comment)
    found = warc.directory(*reader(raw))
    assert {n: raw[at : at + size] for n, (_, at, size) in found.items()} == members
    assert found.keys() == members.keys()
    assert warc.directory(*reader(package({}))) == {}


def test_other_packages():
    """Members without an index, with part of one, not compressed, and packages that cannot be read."""
    records = [warc.record(i, "u", b"payload %d" % i * 50, len(b"payload %d" % i * 50), base32(b"payload %d" % i * 50), None) for i in range(30)]
    import zlib

    def zipped(raw):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        return press.compress(raw) + press.flush()

    parts = [zipped(r) for r in records]
    line = lambda at, n: 'k 0 {"filename": "a.warc.gz", "offset": "%d", "length": %d}\n' % (at, n)  # noqa: E731, UP031
    read, size = reader(package({"archive/a.warc.gz": b"".join(parts), "archive/b.warc": b"".join(records), "indexes/i.cdxj": line(0, len(parts[0]))}))
    plans = list(warc.planned(read, size, 100))
    assert [(m, n) for m, _, _, n in plans] == [("archive/a.warc.gz", []), ("archive/b.warc", [])]
    for member, start, n, _ in plans:
        for step in (7, 1 << 16):
            got = list(warc._streamed(read, start, n, step) if member.endswith("gz") else warc._plain(read, start, n))
            assert got == records
    with pytest.raises(ValueError, match="not stored"):
        list(warc.planned(*reader(package({"archive/a.warc.gz": b"".join(parts)}, compress=["archive/a.warc.gz"])), 100))
    with pytest.raises(ValueError, match="ZIP"):
        warc.directory(*reader(b"no archive at all"))
    with pytest.raises(ValueError, match="differ"):
        warc.parsed(records[0].replace(b"payload 0", b"payload 1", 1))
    assert warc.parsed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n") is None

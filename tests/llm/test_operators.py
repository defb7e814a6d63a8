import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsweave.llm import decontaminate, lm_scoring, mixing, near_dup, pii, quality, suffix_dedup, token_counts, token_output, toxicity
from newsweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, band int"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
rng = np.random.default_rng(7)
VOCABULARY = ["".join(rng.choice(list("abcdeghé"), rng.integers(1, 7))) for _ in range(300)]


def prose(n, seed):
    own = np.random.default_rng(seed)
    return " ".join(VOCABULARY[int(i)] for i in np.minimum(own.zipf(1.3, n) - 1, 299))


BASE = [prose(120, s) for s in range(25)]
TEXTS = {i: t for i, t in enumerate(BASE)}
for i in range(8):  # near copies, exact copies, shared passages
    words = BASE[i].split(" ")
    words[3 * i + 5] = "edited"
    TEXTS[100 + i] = " ".join(words)
    TEXTS[200 + i] = BASE[i]
    TEXTS[300 + i] = prose(40, 50 + i) + " " + BASE[i + 8] + "\n" + prose(30, 90 + i)
TEXTS |= {400: "", 401: "word", 402: "one two three four", 403: None, 404: " \t\n", 405: "a " * 3000, 406: "aé" * 700, 407: "x y z " * 400, 408: "same line here\nsame line here\n\nother", 409: "Word word WORD wörd Wörd", 410: prose(4000, 5)}
TEXTS |= {500: "write to jane.doe@mail.example.org, or 10.0.0.1 and 300.1.1.1; call +44 (20) 7946-0958 now", 501: "card 4111 1111 1111 1111 and 4111 1111 1111 1112 ip 0.0.0.0 a@b@c.de x@y", 502: "+12345 1.2.3.4.5.6.7.8 mailto:a@b.c.d. +1-202-555-0100"}


def frame(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 1) for i, t in texts] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated and null keys, null and odd texts, columns with clashing names."""
    extra = [(None, None, None, None, None, None, None), (None, BASE[3], None, "s1", 1, None, None), (5, BASE[5], "en", "s1", 1, "x", 1)]
    return frame(spark, TEXTS.items(), extra).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 2), int(i % 5 == 0)) for i in range(25)] + [(0, None, None), (None, 1, 1), (1, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(str, rows))


def test_token_output(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert bag(tuple(r) for r in token_output.token_table(docs).collect()) == bag(want)
    assert token_output.token_table(empty).count() == 0


def test_token_counts(spark, docs, empty):
    from newsweave.llm.tokens import Encoder

    encoder = Encoder(special_as_text=True)
    want = [(i, len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in pairs(docs)]
    assert bag(tuple(r) for r in token_counts.token_counts(docs).collect()) == bag(want)
    assert token_counts.token_counts(empty).count() == 0


def test_separator_scan_stitches_blocks(spark, tmp_path):
    own = np.random.default_rng(3)
    for k in range(3):
        ids = own.integers(1, 5, 700).astype("<u2")
        ids[own.random(700) < (0.3, 0.02, 0.005)[k]] = 0
        ids.tofile(tmp_path / f"ids-{k}.bin")
    (tmp_path / "ids-9.bin").write_bytes(b"")
    got = {}
    for r in token_counts.scan_flat(spark, str(tmp_path), 0, "<u2", 64).orderBy("file", "nth").collect():
        got.setdefault(r.file, []).append((r.n_tokens, r.ended))
    for k in range(3):
        ids = np.fromfile(tmp_path / f"ids-{k}.bin", "<u2")
        cut = np.flatnonzero(ids == 0)
        want = [(int(n), True) for n in np.diff(np.concatenate([[-1], cut])) - 1]
        left = len(ids) - (int(cut[-1]) + 1 if len(cut) else 0)
        assert got[f"ids-{k}.bin"] == want + ([(left, False)] if left else [])


BASE_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def test_pii_base(docs, empty):
    want = []
    for i, t in pairs(docs):
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE_PII.items()) for m in re.finditer(p, t) if valid(kind, m[0]))
        named = ",".join(f"{list(BASE_PII)[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *[sum(k == j for _, k, _ in spans) for j in range(4)], hashlib.sha256(named.encode()).hexdigest()))
    got = pii.personal_data(docs)
    assert bag(tuple(r)[:6] for r in got.collect()) == bag(want)
    assert pii.personal_data(empty).count() == 0


def test_pii_finds_unseen(spark):
    seeds = [f"our member id card 4111 1111 1111 1111 reach me at user{i}@host{i}.example today" for i in range(12)]
    texts = [*seeds, "you can reach me at jane(at)host77 today", "reach me quickly", "met at house1234 today"]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, enumerate(texts))).collect()}
    begin = texts[12].index("jane")
    assert got[12] == f"email:{begin}:{begin + len('jane(at)host77')}"
    assert got[13] == ""
    assert got[14] == ""


@pytest.mark.parametrize("most_grouped", [1, 20_000])
def test_repeats(docs, empty, most_grouped):
    rows = [(i, t.encode()) for i, t in pairs(docs)]
    count = Counter(b[p : p + 400] for _, b in rows for p in range(len(b) - 399))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest()))
    assert bag(tuple(r) for r in suffix_dedup.remove_repeats(docs, most_grouped).collect()) == bag(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_merge_compares_from_known_prefixes():
    own = np.random.default_rng(2)
    keys = sorted({bytes(own.integers(97, 99, own.integers(1, 12)).astype(np.uint8)) for _ in range(300)})
    dealt = [sorted(k for k, r in zip(keys * 2, own.integers(0, 5, 2 * len(keys))) if r == j) for j in range(5)] + [[]]
    runs = []
    for own_keys in dealt:
        shared, rest = suffix_dedup.front_coded(own_keys)
        runs.append(suffix_dedup.Run(np.array(shared, int), np.array([len(r) for r in rest], int), b"".join(rest)))
    out, last = [], b""
    for r, j, n in suffix_dedup.merge(runs):
        key = dealt[r][j]
        assert n == suffix_dedup.common(last, key, 0)
        out.append(key)
        last = key
    assert out == sorted(k for d in dealt for k in d)


def test_mix(docs, empty):
    rows = mixing.copies(docs).collect()
    size = Counter()
    for r in rows:
        assert r.copies in (0, 1, 2)
        size[r.source] += r.size
    assert len(rows) == docs.count()
    target = {r.source: r.target for r in rows}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal, open_, want = 1.5 * sum(size.values()), set(order), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    while True:
        level = (goal - sum(want.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in full}
        open_ -= full
        if not full or not open_:
            break
    want |= {s: level * weight[s] for s in open_}
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    again = mixing.copies(docs.repartition(5)).collect()
    assert bag(map(tuple, rows)) == bag(map(tuple, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(empty).count() == 0


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_duplicates(docs, empty):
    rows = [(i, shingle_set(t)) for i, t in pairs(docs)]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for b in range(len(rows)):
        for a in range(b):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, len(s), least.get(find(k)), i == least.get(find(k))) for k, (i, s) in enumerate(rows)]
    assert bag(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == bag(want)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns


def test_components(spark):
    own = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in own.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 1), (7, 7)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in got}
    assert {x for e in edges if None not in e and e[0] != e[1] for x in e} == set(got)


ITEM = "The train of Anna Keller leaves Bergen at 14 and travels 320 km before it stops near the old harbour for 5 minutes"


def test_leaks(spark, docs, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, prose(60, 77)), (3, None), (4, ""), (None, BASE[20]), (5, "short item of six plain words")], "item_id long, text string")
    again = ITEM.replace("Anna Keller", "Mary Jones").replace("Bergen", "Oslo").replace("320", "410").replace("14", "9")
    mixed = ITEM.replace("Anna Keller leaves Bergen", "Anna Keller leaves Bergen").replace("320", "14")
    own = frame(spark, [(1, prose(50, 1) + " " + ITEM + " end"), (2, again), (3, prose(300, 2)), (4, None), (5, mixed.upper()), (6, "so a short item of six plain words it is")])
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.leaks(own, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (6, 5): True}
    assert {r.doc_id for r in decontaminate.drop_leaks(own, bench).collect()} == {3, 4, 5}
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert (20, None) in found
    loud = frame(spark, [(1, "!! " + " ".join(w + "!!" for w in "été à la plage où les élèves jouent près du port après midi".upper().split()))])
    quiet = spark.createDataFrame([(1, "été à la plage où les élèves jouent près du port après midi")], "item_id long, text string")
    assert decontaminate.leaks(loud, quiet).count() == 1
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_lm(docs, empty):
    rows = [(i, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]) for i, t in pairs(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    want = bag((i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(float(base(t)), 6)) for i, t in rows)
    one = lm_scoring.lm_scores(docs).collect()
    assert bag((*tuple(r)[:5], round(r.base_score, 6)) for r in one) == want
    few = lm_scoring.lm_scores(docs, shard_tokens=700).collect()  # many shards, refined contexts
    assert bag((*tuple(r)[:5], round(r.base_score, 6)) for r in few) == want
    again = lm_scoring.lm_scores(docs.repartition(5), shard_tokens=700).collect()
    assert bag((r.doc_id, round(r.score, 2)) for r in few) == bag((r.doc_id, round(r.score, 2)) for r in again)
    trained = [r for r in one if not r.held_out and r.n_tokens > 50]
    assert all(r.score > r.base_score for r in trained)
    by_key = lambda rows: sorted(rows, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score, r.score))
    middle = lm_scoring.lm_scores(docs, shard_tokens=20_000).collect()
    for other in (few, middle):  # a shard's size is no part of the model
        assert all(abs(a.score - b.score) <= 1e-3 * abs(b.score) + 0.01 for a, b in zip(by_key(one), by_key(other)))
    # the model itself, in plain counts, up to eight-bit codes
    pair, two, triple = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            for k in range(1, len(t)):
                b = t[k - 2] if k > 1 else 0
                pair[t[k - 1], t[k]] += 1
                two[b, t[k - 1]] += 1
                triple[b, t[k - 1], t[k]] += 1
    q = lm_scoring.STRENGTH

    def score(t):
        total = np.log10((count[t[0]] + 0.1) / (n + 0.1 * (v + 1)))
        for k in range(1, len(t)):
            b, c, w = t[k - 2] if k > 1 else 0, t[k - 1], t[k]
            p1 = (count[w] + 0.1) / (n + 0.1 * (v + 1))
            p2 = (pair[c, w] + q * p1) / (count[c] + q)
            total += np.log10((triple[b, c, w] + q * p2) / (two[b, c] + q))
        return float(total)

    full = by_key([type("R", (), {"doc_id": i, "n_tokens": len(t), "base_score": float(base(t)), "score": score(t)}) for i, t in rows])
    for a, b in zip(by_key(one), full):
        assert a.doc_id == b.doc_id
        assert abs(a.score - b.score) <= 0.03 * a.n_tokens
    assert lm_scoring.lm_scores(empty).count() == 0
    alone = lm_scoring.lm_scores(docs.filter("doc_id is not null and crc32(cast(doc_id as string)) % 10 = 0")).collect()
    assert alone
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_lm_keeps_tries(docs, tmp_path):
    from newsweave.llm.elias_fano import Trie

    lm_scoring.lm_scores(docs, shard_tokens=5000, folder=str(tmp_path / "tries")).count()
    files = sorted((tmp_path / "tries").glob("*.trie"))
    assert files
    assert all(Trie(f.read_bytes()).words.n > 0 for f in files)


def test_toxicity(spark, docs, labels, empty):
    bad = ["vile", "hateful", "scumbag", "nasty"]
    own = np.random.default_rng(1)
    toxic = [(1000 + i, " ".join([*prose(30, 1000 + i).split(), *own.choice(bad, 4)]) if i % 4 == 0 else prose(34, 1000 + i)) for i in range(600)]
    marks = spark.createDataFrame([(i, 1, int((i - 1000) % 4 == 0)) for i, _ in toxic if i % 3], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(frame(spark, [*toxic, (9, None), (10, "")]), marks).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    got = {r.doc_id: r.predicted for r in rows}
    truth = {i: int((i - 1000) % 4 == 0) for i, _ in toxic}
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    assert got[9] == got[10] == 0
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_quality(spark, docs, labels, empty):
    want = []
    for i, t in pairs(docs):
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = Counter(windows)
        inside = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed))
    rows = quality.quality(docs, labels).collect()
    assert bag(tuple(r)[:7] for r in rows) == bag(want)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality.quality(empty, labels).count() == 0
    good = [(i, prose(60, i)) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "#|" for w in prose(60, 500 + i).split())) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality(frame(spark, good + junk), marks).collect() if not r.base_failed}
    assert sum(kept[i] == (i < 1000) for i in kept) >= 0.97 * len(kept)


def test_pipeline(spark, tmp_path, docs, labels):
    import corpus_pipeline

    docs.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, BASE[20]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == COLUMNS
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
    ids = [r.doc_id for r in now.select("doc_id").collect()]
    assert 20 not in ids
    assert not {200, 201} & set(ids)
    # each stage against the definition, on what it was given
    read = lambda name: spark.read.parquet(f"{sf}/{name}")
    toxic = {(r.doc_id, r.text) for r in read("documents.parquet").collect()} - {(r.doc_id, r.text) for r in read("toxicity").collect()}
    model = toxicity.fit(read("documents.parquet"), labels, None)
    scored = read("documents.parquet").select("doc_id", "text").mapInArrow(toxicity.score_texts(model), "doc_id long, score double")
    assert bag(i for i, _ in toxic) == bag({r.doc_id for r in scored.filter("score >= 0.7").collect()})
    given = {(r.doc_id, r.text or "") for r in read("toxicity").collect()}
    sets = {i: shingle_set(t) for i, t in given if i is not None}
    alike = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    stay, left = set(), set(sets)
    while left:  # one component after another
        group, open_ = set(), [min(left)]
        while open_:
            x = open_.pop()
            if x not in group:
                group.add(x)
                open_ += [y for y in left - group if alike(x, y)]
        stay.add(min(group))
        left -= group
    assert {r.doc_id for r in read("near_duplicates").filter("doc_id is not null").collect()} == stay
    after = Counter(r.doc_id for r in read("decontamination").collect())
    assert set(after) == {r.doc_id for r in read("near_duplicates").collect()} - {20}
    mixed = Counter({i: 0 for i in after})
    for r in mixing.copies(read("decontamination")).collect():
        mixed[r.doc_id] += r.copies
    assert {i: n for i, n in mixed.items() if n} == dict(Counter(ids))
    last = corpus_pipeline.run(spark, sf)
    assert bag(r.doc_id for r in last.collect()) == bag(ids)
    rows = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in last.collect()}
    assert rows == {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.token_table(now).collect()}

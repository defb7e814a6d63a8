"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP file of stored members: `archive/data.warc.gz`, one gzip member a record; `indexes/index.cdxj`, a line a
record with its offset and length; `datapackage.json`. Each writing task makes packages of up to `PACKAGE_BYTES`
in the shared folder, under names that no other attempt has, and reports them as rows of a manifest that Spark commits; files of lost
attempts are in no manifest. Reading takes two steps: a task a package parses the end record, the ZIP64 records where sizes ask for them, the
central directory and the index, and plans ranges of about `RANGE_BYTES`; the ranges are dealt out anew and each is read
with one call. Archive members without an index line are read from their first byte on. Members must be stored; a response's
payload must have the digest that its record states, or the job fails.

Records with equal payloads (by SHA-1 and length) of at least `least` bytes are written once: those with the smallest
page_id are `response` (all of them, if rows repeat it), others `revisit` it. Payloads that hold more than a thousandth of all rows, a
thousand at most, are matched by a broadcast, the others by a join on the digest.

Null html is an empty payload, null url gives no target; a null page_id comes after all others: it revisits an equal page that
has an id, else is a response; repeated rows are records of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import chunks, release, text_column
from .shared import shared_path, store, until_exit

PACKAGE_BYTES = 128 << 20
RANGE_BYTES = 4 << 20
HOT_SHARE = 1000
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, size bigint, records bigint"
SPLIT = "path string, member string, start bigint, size bigint, lengths array<bigint>"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; `payload` None: a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_URI)}"]), "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if payload is None else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "!#$%&'()*+,/:;=?@[]~"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


class Package:
    """A ZIP package being written: the archive member first, then its index and description."""

    def __init__(self, root: str):
        self.path = f"{root}/{uuid.uuid4().hex}.wacz"
        system, at = store(self.path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, raw: bytes, url: str | None, digest: str) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        part = press.compress(raw) + press.flush()
        self.member.write(part)
        self.lines.append(f"{quote(url or '', safe=_URI) or '-'} {_STAMP} " + json.dumps({"digest": f"sha1:{digest}", "offset": self.at, "length": len(part), "filename": ARCHIVE.split("/")[1]}))
        self.at += len(part)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(f"{line}\n" for line in self.lines).encode()  # in the order of the archive, so neighbours make ranges
        about = {"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.at}, {"path": INDEX, "bytes": len(index)}]}
        self.zip.writestr(INDEX, index)
        self.zip.writestr("datapackage.json", json.dumps(about))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, len(self.lines)


_STAMP = "".join(c for c in DATE if c.isdigit())


def _manifest(made: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "size", "records"])


def _packing(root: str, package_bytes: int):
    def run(batches):
        made, now = [], None
        for batch in chunks(batches, "html"):
            columns = (text_column(batch, c) for c in ("page_id", "url", "html", "first_id"))
            for page_id, url, html, first in zip(*columns):
                payload = (html.as_py() or "").encode()
                page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                digest = base32_sha1(payload)
                again = first is not None and first != page_id
                now = now or Package(root)
                now.add(record(page_id, url, None if again else payload, len(payload), digest, first if again else None), url, digest)
                if now.at >= package_bytes:
                    made.append(now.close())
                    now = None
        if now:
            made.append(now.close())
        yield _manifest(made)
        release()

    return run


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and first_id: the smallest page_id of an equal payload, null where no other row has the payload."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.concat(F.sha1(F.col("html").cast("binary")), F.lit("-"), F.octet_length("html")))
    many = own.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1")
    hot = F.col("n") * HOT_SHARE > own.count()
    common = many.filter(hot).select(F.col("digest").alias("hot_digest"), F.col("first_id").alias("hot_first"))
    others = many.filter(~hot).select(F.col("digest").alias("key"), "first_id")
    # rows of a hot payload take keys that nothing else has, so that they stay spread
    own = own.join(F.broadcast(common), F.col("digest") == F.col("hot_digest"), "left")
    apart = F.concat(F.lit("-"), F.xxhash64("page_id", "url"))
    own = own.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(apart))
    return own.join(others, "key", "left").select("page_id", "url", "html", F.coalesce("hot_first", "first_id").alias("first_id"))


def write_packages(pages: DataFrame, root: str, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as packages below `root`; the committed manifest: path, size, records."""
    spark = pages.sparkSession
    with_first(pages, least).mapInArrow(_packing(f"{root}/packages", package_bytes), MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


Read = Callable[[int, int], bytes]


def directory(read: Read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file of `size` bytes: name to (method, offset of the data, stored size)."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)  # the mark within a comment is none
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    stop = tail_at + end  # where the directory should end
    locator = read(stop - 20, 20) if stop >= 76 else b""
    if locator[:4] == b"PK\6\7":
        # right before its locator, or (with data of its own) where the locator says
        places = [at for at in (stop - 76, struct.unpack_from("<Q", locator, 8)[0]) if read(at, 4) == b"PK\6\6"]
        if not places:
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, start = struct.unpack("<QQQ", read(places[0] + 32, 24))
        stop = places[0]
    shift = stop - (start + length)  # bytes before the first member
    raw, at, found = read(start + shift, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values, only of the fields that are full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full, stored, header = (next(wide) if v == 0xFFFFFFFF else v for v in (full, stored, header))
            k += 4 + n
        local = read(header + shift, 30)
        if local[:4] != b"PK\3\4" or flags & 1:
            raise ValueError(f"{name}: no local header, or encrypted")
        found[name] = (method, header + shift + 30 + sum(struct.unpack_from("<HH", local, 26)), stored)
        at += 46 + n_name + n_extra + n_comment
    return found


def planned(read: Read, size: int, range_bytes: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """(member, first byte in the package, bytes, lengths of the records; none: not indexed) of the ranges of a package."""
    members = directory(read, size)

    def of(name: str) -> tuple[int, int]:
        method, start, length = members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        return start, length

    lines: dict[str, list[tuple[int, int]]] = {}
    for name in members:
        if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj")):
            for line in read(*of(name)).decode().splitlines():
                entry = json.loads(line.split(" ", 2)[2])
                lines.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    for name in members:
        if not name.startswith("archive/") or name.endswith("/"):
            continue
        start, length = of(name)
        spans = sorted(set(lines.get(name.split("/", 1)[1], [])))
        if sum(n for _, n in spans) != length or any(a + n != b for (a, n), (b, _) in zip(spans, spans[1:])):
            yield name, start, length, []  # the index leaves something out
            continue
        at, held, span = 0, [], 0
        for _, n in spans:
            held.append(n)
            span += n
            if span >= range_bytes:
                yield name, start + at, span, held
                at, held, span = at + span, [], 0
        if held:
            yield name, start + at, span, held


def _opened(path: str) -> tuple[Read, int]:
    system, at = store(path)
    file = system.open_input_file(at)

    def read(start: int, n: int) -> bytes:
        return file.read_at(n, start)

    return read, file.size()


def _planning(range_bytes: int):
    def run(batches):
        for batch in batches:
            for path in text_column(batch, "path").to_pylist():
                read, size = _opened(path)
                ranges = list(planned(read, size, range_bytes))
                columns = [pa.array([path] * len(ranges), pa.string()), *(pa.array([r[i] for r in ranges], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "member", "start", "size", "lengths"])

    return run


def _streamed(read: Read, start: int, size: int, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a member of gzip members, whose places nothing tells."""
    press, got = zlib.decompressobj(31), []
    for at in range(0, size, step):
        data = read(start + at, min(step, size - at))
        while data:
            got.append(press.decompress(data))
            data = press.unused_data
            if press.eof:
                yield b"".join(got)
                press, got = zlib.decompressobj(31), []


def _plain(read: Read, start: int, size: int) -> Iterator[bytes]:
    """The records of an archive that is not compressed."""
    at, stop = start, start + size
    while at < stop:
        head, n = b"", 4096
        while b"\r\n\r\n" not in head and at + len(head) < stop:
            head, n = read(at, min(n, stop - at)), 2 * n
        length = head.index(b"\r\n\r\n") + 8 + int(headers(head)[1]["content-length"])
        yield read(at, length)
        at += length


def headers(raw: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields by small name, and where the body starts."""
    stop = raw.index(b"\r\n\r\n")
    first, *lines = raw[:stop].decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, stop + 4


def parsed(raw: bytes) -> tuple | None:
    """A record as a RECORD tuple; None for those that hold no page (warcinfo, request, metadata)."""
    version, head, at = headers(raw)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = raw[at : at + int(head["content-length"])]
    _, http, body = headers(block)
    payload, digest = block[body:], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
    n = len(payload) if kind == "response" else int(http["content-length"])
    return head["warc-record-id"], kind, head.get("warc-target-uri"), digest, n, head.get("warc-refers-to"), payload if kind == "response" else None


def _reading(payloads: bool):
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def records(path: str, member: str, start: int, size: int, lengths: list[int]) -> Iterator[bytes]:
        read, _ = _opened(path)
        if lengths:
            data, at = memoryview(read(start, size)), 0
            for n in lengths:
                yield zlib.decompress(data[at : at + n], 31)
                at += n
        else:
            yield from (_streamed if member.endswith(".gz") else _plain)(read, start, size)

    def run(batches):
        for batch in batches:
            for split in zip(*(text_column(batch, c) for c in ("path", "member", "start", "size", "lengths"))):
                rows, held = [], 0
                for raw in records(*(v.as_py() for v in split)):
                    if found := parsed(raw):
                        rows.append(found if payloads else (*found[:6], None))
                        held += len(raw) if payloads else 256
                    if held >= RANGE_BYTES:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)
        release()

    return run


def read_packages(manifest: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The page records of the packages in `manifest` (path): RECORD columns; without `payloads` that column is null (it is checked all the same)."""
    ranges = manifest.select("path").repartition("path").mapInArrow(_planning(range_bytes), SPLIT)
    return ranges.repartition("path", "start").mapInArrow(_reading(payloads), RECORD)


def page_of(urn: str) -> Column:
    """The page_id of a record's name."""
    digits = F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def archive_report(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its packages, which stay for the session."""
    spark: SparkSession = pages.sparkSession
    root = shared_path(spark, "warc")
    manifest = write_packages(pages, root, least)
    until_exit(spark, root)
    return read_packages(manifest, payloads=False).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM s
"""

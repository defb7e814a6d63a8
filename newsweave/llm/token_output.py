"""Documents as coded token-id files.

A file is a Parquet dataset whose rows are segments: part (position of the range of keys), segment (position in
the part), doc_ids and lengths of the whole documents in it, and payload, a coded stream of `range_coder`. Spark's
committers write it, so a retried task leaves no half file and any file system will do. Documents stand in
ascending doc_id order over parts, segments and lists: one exchange by key range, tokenising and coding follow in the
same stage. A segment takes whole documents up to `SEGMENT` ids; a longer document has one of its own.

Null text is empty and still gets its end id; a null doc_id comes first; rows with equal doc_id follow each other by the
first `HEAD` characters of their texts; an empty table gives a dataset without rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import range_coder
from .arrays import chunks, release, text_column
from .shared import shared_path, until_exit
from .tokens import encoder, with_end

END = 2
HEAD = 32  # characters that order the rows of one doc_id
SEGMENT = range_coder.BLOCK
TEXT_BYTES = 1 << 18  # of texts that are encoded at once: what is made for each byte of them takes 30 to 60 times that
FILE = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, payload binary"
READ = "part int, segment int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def _segments(ids: np.ndarray, lens: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of whole documents with at most SEGMENT ids, or one document."""
    stop = np.cumsum(lens)
    out, at = [], 0
    while at < len(lens):
        base = stop[at] - lens[at]
        to = max(at + 1, int(np.searchsorted(stop, base + SEGMENT, "right")))
        out.append((at, to))
        at = to
    return out


def _coding(path: str | None, end: int, special_as_text: bool):
    def code(part: int, segment: int, keys: list[pa.Array], ids: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
        release()
        key, stop = pa.concat_arrays(keys), np.concatenate([[0], np.cumsum(lens)])
        cuts = _segments(ids, lens)
        payloads = range_coder.encode([ids[stop[a] : stop[b]] for a, b in cuts])
        offs = pa.array([0, *(b for _, b in cuts)], pa.int32())
        columns = [
            pa.array([part] * len(cuts), pa.int32()), pa.array(range(segment, segment + len(cuts)), pa.int32()), pa.ListArray.from_arrays(offs, key), pa.ListArray.from_arrays(offs, pa.array(lens)),
            pa.array([stop[b] - stop[a] for a, b in cuts], pa.int64()), pa.array(payloads, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "doc_ids", "lengths", "n_tokens", "payload"])

    def run(batches):
        release()
        ids_of, part, segment = encoder(path, special_as_text), TaskContext.get().partitionId(), 0
        keys, ids, lens, held = [], [], [], 0
        for batch in chunks(batches, limit=TEXT_BYTES):
            flat, per_row = with_end(*ids_of.encode(text_column(batch)), end)
            if keys and held + len(flat) > SEGMENT:
                out = code(part, segment, keys, np.concatenate(ids), np.concatenate(lens))
                segment += out.num_rows
                keys, ids, lens, held = [], [], [], 0
                yield out
                del out
                release()
            keys.append(text_column(batch, "doc_id"))
            ids.append(flat.astype(np.uint16 if flat.max(initial=0) < 65536 else np.uint32))
            lens.append(per_row)
            held += len(flat)
        if keys:
            yield code(part, segment, keys, np.concatenate(ids), np.concatenate(lens))

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, special_as_text: bool = False) -> None:
    """Write `docs` (doc_id, text) as a token file. `tokenizer`: a path that every machine has."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a key of many rows is dealt out by the beginning of its texts and, for equal ones, by the place of the row
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "head"]
    ordered = rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order, "text").select("doc_id", "text")
    ordered.mapInArrow(_coding(tokenizer, end, special_as_text), FILE).write.parquet(path)


def _reading(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            release()
            part, segment, doc_ids, lengths, payload = (text_column(batch, c)[i] for c in ("part", "segment", "doc_ids", "lengths", "payload"))
            ids, lens = range_coder.decode([payload.as_py()])[0], lengths.values.to_numpy()
            stop = np.concatenate([[0], np.cumsum(lens)])
            if stop[-1] != len(ids):
                raise ValueError("lengths and ids of a segment differ")
            raw, n = memoryview(ids.astype("<u4", copy=False)).cast("B"), len(lens)
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stop.tolist(), stop[1:].tolist())]
            columns = [pa.array([part.as_py()] * n, pa.int32()), pa.array([segment.as_py()] * n, pa.int32()), doc_ids.values, pa.array(stop[:-1]), pa.array(lens), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file."""
    file = spark.read.schema(FILE).parquet(path)
    docs = file.select("part", "segment", "doc_ids", "lengths", "n_tokens", "payload").mapInArrow(_reading, READ)
    # the parts' totals are few, a part's segments are summed within it
    sizes = file.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "segment", inner.alias("inner")).join(parts, "part").select("part", "segment", (F.col("inner") + F.col("part_start")).alias("base"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write the token file in the shared folder, for the session, and report its documents."""
    path = shared_path(docs.sparkSession, "token-file")
    write_tokens(docs, path, tokenizer, end)
    until_exit(docs.sparkSession, path)
    return read_tokens(docs.sparkSession, path)

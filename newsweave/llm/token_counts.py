"""Token counts by separator scan over flat id files.

Flat files hold nothing but ids (little endian, 16 bits where the vocabulary allows, else 32), documents end with
one separator id, and there is no index. A scan lists the files with their lengths, deals blocks of
`BLOCK_BYTES` to tasks, and searches each block for separators with one vectorised comparison. A block reports its
separators, the ids before its first and after its last one; a prefix scan over a file's blocks stitches documents
that cross them: the open tail of earlier blocks is added to a block's first document.

Blocks read their own byte range, so memory is the block, whatever the file or document. Ids after the last
separator of a file are an unfinished document and reported with `ended` false. An empty file gives no rows; an
empty document counts zero ids. Null text is empty; null and repeated doc_ids are written like others.
"""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import chunks, text_column
from .shared import shared_path, stored, until_exit
from .shared import store as _files
from .tokens import default_tokenizer, encoder, with_end

SEPARATOR = 50256
BLOCK_BYTES = 4 << 20
BLOCKS = "file string, block bigint, n bigint, head bigint, tail bigint, lengths array<bigint>"


def id_type(tokenizer: str | None = None) -> str:
    """16 bits where all ids of the vocabulary fit, else 32."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab_size() <= 1 << 16 else "<u4"


def _writing(folder: str, path: str | None, separator: int, dtype: str):
    def run(batches):
        ids_of = None
        store, base = _files(folder)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}.bin"
        draft = posixpath.join(base, f"_{name}-{uuid.uuid4().hex}")
        out, keys, nth = None, [], 0
        for batch in chunks(batches):
            if out is None:
                ids_of = encoder(path, True)
                out = store.open_output_stream(draft)
            flat, per_row = with_end(*ids_of.encode(text_column(batch)), separator)
            if len(flat) and int(flat.max()) > np.iinfo(dtype).max:
                raise ValueError(f"an id does not fit {dtype}")
            out.write(flat.astype(dtype).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(nth, nth + n)), text_column(batch, "doc_id")], names=["file", "nth", "doc_id"])
            nth += n
        if out is not None:
            out.close()
            store.move(draft, posixpath.join(base, name))  # a retried task writes the same bytes again

    return run


def write_flat(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Write `docs` as flat id files, one for each partition; gives file, nth, doc_id, as stored beside them."""
    store, base = _files(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_writing(folder, tokenizer, separator, dtype), "file string, nth bigint, doc_id bigint").write.parquet(f"{folder}-keys")
    return docs.sparkSession.read.schema("file string, nth bigint, doc_id bigint").parquet(f"{folder}-keys")


def _scanning(separator: int, dtype: str):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _files(row["path"])
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(row["size"], row["offset"]), dtype)
                at = np.flatnonzero(ids == separator)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - int(at[-1]) - 1 if len(at) else len(ids)
                names = BLOCKS.replace(",", "").split()[::2]
                values = [[posixpath.basename(path)], [row["block"]], [len(at)], [head], [tail], [(np.diff(at) - 1).tolist()]]
                kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    return run


def scan_flat(spark: SparkSession, folder: str, separator: int = SEPARATOR, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, nth, n_tokens (without the separator), ended for every document in the files ids-*.bin of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder).select("path", "length").filter("length > 0")
    offsets = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {block_bytes}L)")).alias("offset"))
    blocks = offsets.select("path", "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).alias("size"), (F.col("offset") / block_bytes).cast("long").alias("block"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = blocks.repartition(parts, "path", "offset").mapInArrow(_scanning(separator, dtype), BLOCKS)
    got = stored(got, "flat-blocks")
    # only the blocks' numbers meet in a file's window, not the lengths of their documents
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # ids since the last separator before the block, and separators before it
    seen = got.drop("lengths").withColumn("open", F.sum(F.when(F.col("n") == 0, F.col("tail")).otherwise(0)).over(order))
    seen = seen.withColumn("mark", F.when(F.col("n") > 0, F.col("tail") - F.col("open")))
    carried = F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.last("open").over(before), F.lit(0))
    seen = seen.withColumns({"carried": carried, "base": F.coalesce(F.sum("n").over(before), F.lit(0)), "is_last": F.lead("block").over(order).isNull()})
    seen = seen.join(got.select("file", "block", "lengths").hint("merge"), ["file", "block"])
    first = F.array(F.struct((F.col("base")).alias("nth"), (F.col("carried") + F.col("head")).alias("n_tokens"), F.lit(True).alias("ended")))
    inner = F.transform("lengths", lambda x, i: F.struct((F.col("base") + i + 1).alias("nth"), x.alias("n_tokens"), F.lit(True).alias("ended")))
    left = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    last = F.array(F.struct((F.col("base") + F.col("n")).alias("nth"), left.alias("n_tokens"), F.lit(False).alias("ended")))
    none = F.filter(first, lambda x: F.lit(False))
    found = F.concat(F.when(F.col("n") > 0, F.concat(first, inner)).otherwise(none), F.when(F.col("is_last") & (left > 0), last).otherwise(none))
    return seen.select("file", F.explode(found).alias("d")).select("file", "d.nth", "d.n_tokens", "d.ended")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document, counted by scanning flat files written in the shared folder."""
    spark = docs.sparkSession
    folder = shared_path(spark, "flat-ids")
    dtype = id_type(tokenizer)
    keys = write_flat(docs, folder, tokenizer, dtype=dtype)
    for path in (folder, f"{folder}-keys"):
        until_exit(spark, path)
    # both sides grow with the documents: neither is broadcast
    return keys.hint("merge").join(scan_flat(spark, folder, dtype=dtype).hint("merge"), ["file", "nth"]).select("doc_id", "n_tokens")

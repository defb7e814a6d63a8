"""MinHash near-duplicates with circulant signatures, exact confirmation and connected components.

One permutation scatters the shingle fingerprints over 32-bit places, a second one, circularly shifted by the
coordinate's number, orders them: coordinate k of a signature is the least value of the second permutation at
place + k * stride (modulo the domain). `ROWS` coordinates make a band, `BANDS` bands a signature: a pair at
the threshold 0.85 shares no band with probability (1 - 0.85**5)**28, about 1e-7; at 0.8, the pipeline's threshold,
with (1 - 0.8**5)**28, about 1.5e-5.

Rows with equal shingle sets form one class first (a pre-aggregated group), so copies never meet in pairs. Classes
that share a band bucket are compared with the bucket's most connected class on full shingle sets. Only where
that leaves a bucket with more than one component are the remaining cross-component pairs formed, between the
members outside the bucket's largest component and the others, and confirmed the same way. Such buckets with the same
main component are a family; its rows meet block by block within a task, which holds each set once, so what is sent
grows with rows and blocks, not with pairs. Shingles that no other such row has cannot be shared, which bounds a
pair's similarity before it is compared. No bucket is capped.

Null and empty texts have no shingles and stand alone; a text of one to four words has its word sequence as the
only shingle; repeated rows are one class; null doc_id rows take part, component_id is the least doc_id that is
not null (null where there is none, and then they are kept); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, buffers, chunks, mix, shingles, text_column
from .components import components
from .shared import cut, fresh, stored

ROWS, BANDS = 5, 28
STRIDE = 0x9E3779B1
ID_BITS = 50
GROUPED, BLOCK_ITEMS = 128, 32_768  # members of a leader, and shingles of a block, that are confirmed together
SIGNED = "doc_id bigint, n_shingles bigint, class bigint, class_check bigint, bands array<bigint>"


def shingle_sets(batch: pa.RecordBatch, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 50-bit shingle fingerprints of all rows, one after another, and each row's offset."""
    words = Words(*buffers(text_column(batch)))
    row, h = shingles(words, size)
    keys = np.sort((row.astype(np.uint64) << U64(ID_BITS)) | (h >> U64(64 - ID_BITS)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    offs = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.uint64) << U64(ID_BITS))
    return keys & U64((1 << ID_BITS) - 1), offs


def circulant(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Signatures, one row for each segment that begins at `starts` (none empty), `count` coordinates."""
    place = (mix(values) >> U64(32)).astype(np.uint32)
    out = np.empty((len(starts), count), np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(count):
        np.add(place, np.uint32(k * STRIDE % 2**32), out=x)
        np.multiply(x, np.uint32(0x7FEB352D), out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x846CA68B), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _ranges(offs: np.ndarray, values: np.ndarray, reduce) -> np.ndarray:
    out = np.zeros(len(offs) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = reduce(values, offs[full])
    return out


def digests(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's shingle set."""
    n, once = np.diff(offs).astype(np.uint64), mix(values + U64(1))
    first = mix(_ranges(offs, once, np.add.reduceat) + n)
    return first, mix(_ranges(offs, mix(once), np.bitwise_xor.reduceat) ^ n)


def signed(batches):
    """Arrow batches of doc_id, text to rows of SIGNED; the class is a 128-bit digest of the shingle set."""
    for batch in chunks(batches):
        values, offs = shingle_sets(batch)
        n = np.diff(offs)
        full = np.flatnonzero(n)
        bands = np.zeros((batch.num_rows, BANDS), np.int64)
        if len(full):
            sig = circulant(values, offs[full], ROWS * BANDS).astype(np.uint64).reshape(len(full), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                key = mix(key * U64(0x100000001B3) + sig[:, :, r])
            bands[full] = key.view(np.int64)
        first, second = digests(values, offs)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([text_column(batch, "doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], names=["doc_id", "n_shingles", "class", "class_check", "bands"])


def set_rows(batches):
    """Arrow batches of node, text to node, items (the sorted fingerprints as bytes), for texts of that class."""
    for batch in chunks(batches):
        values, offs = shingle_sets(batch)
        raw, node = values.tobytes(), text_column(batch, "node").cast(pa.int64())
        own = digests(values, offs)[0].view(np.int64) == node.to_numpy()
        items = pa.array([raw[8 * a : 8 * b] for a, b in zip(offs[:-1], offs[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([node, items], names=["node", "items"]).filter(pa.array(own))


def _confirm(percent: int):
    """The pairs of one group whose sets are alike enough; the group holds each set it needs once."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = dict(zip(sets["node"].to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for x in sets["items"])))
        keep = np.zeros(pairs.num_rows, bool)
        for i, (x, y) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())):
            a, b = held[x], held[y]
            c = np.sort(np.concatenate([a, b]), kind="stable")
            both = int(np.count_nonzero(c[1:] == c[:-1]))
            keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return pairs.select(["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (group, a, b) whose full shingle sets are alike enough.

    A set is sent once to each group that needs it, not once for each pair.
    """
    ends = pairs.select(F.col("group").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = ends.join(sets, "node").select("to", "node", "items")
    return pairs.groupBy("group").cogroup(needed.groupBy("to")).applyInArrow(_confirm(percent), "a bigint, b bigint")


def _by_leader(star: DataFrame) -> DataFrame:
    """Pairs of a leader `a` in groups of about `GROUPED` members, whatever its family."""
    many = cut(star.groupBy("a").agg(F.ceil(F.count("*") / GROUPED).alias("groups")))  # apart, so that the join can split a leader
    return star.join(many, "a").select(F.xxhash64("a", F.pmod(F.hash("b"), F.col("groups"))).alias("group"), "a", "b")


def _alike_across(percent: int):
    """Links between the two blocks of a group: open rows (side 0) against all rows (side 1) of other components.

    Only rows that share a band and whose bounds allow a link are compared, on their full sets.
    """

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, root, n, shared, is_open = (table[c].to_numpy() for c in ("node", "root", "n_shingles", "shared", "is_open"))
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["items"]]
        every, out = np.flatnonzero(side == 1), []
        for i in np.flatnonzero(side == 0):
            both = np.minimum(shared[every], shared[i])
            fit = (root[every] != root[i]) & ~(is_open[every] & (node[every] < node[i])) & (100 * both >= percent * (n[every] + n[i] - both))
            for j in every[fit][(bands[every[fit]] == bands[i]).any(1)]:
                c = np.sort(np.concatenate([items[i], items[j]]), kind="stable")
                same = int(np.count_nonzero(c[1:] == c[:-1]))
                if 100 * same >= percent * (n[i] + n[j] - same):
                    out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within families that the stars left in several components.

    `members`: family, node, root, n_shingles, shared, bands. The rows outside a family's main component meet all of its
    rows block by block, about `BLOCK_ITEMS` shingles a block; pairs are formed only within a group's task.
    """
    own = F.when(F.col("root") != F.col("family"), F.col("n_shingles"))
    count = cut(members.groupBy("family").agg(F.ceil(F.sum("n_shingles") / BLOCK_ITEMS).alias("all_blocks"), F.ceil(F.coalesce(F.sum(own), F.lit(0)) / BLOCK_ITEMS).alias("open_blocks")))
    placed = members.join(count, "family").withColumn("is_open", F.col("root") != F.col("family"))
    mine = lambda blocks: F.pmod(F.hash("node"), F.col(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    first = placed.filter("is_open").select("*", F.lit(0).alias("side"), mine("open_blocks").alias("i"), each("all_blocks").alias("j"))
    second = placed.filter("open_blocks > 0").select("*", F.lit(1).alias("side"), each("open_blocks").alias("i"), mine("all_blocks").alias("j")).select(first.columns)
    met = first.unionByName(second).withColumn("group", F.xxhash64("family", "i", "j")).drop("family", "i", "j", "open_blocks", "all_blocks")
    return met.join(sets, "node").groupBy("group").applyInArrow(_alike_across(percent), "a bigint, b bigint")


def _items(batches):
    for batch in batches:
        column = text_column(batch, "items")
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in column]
        nodes = np.repeat(text_column(batch, "node").to_numpy(), [len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        for i in range(0, len(flat), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 20)]), pa.array(flat[i : i + (1 << 20)])], names=["node", "item"])


def _shared_counts(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, shared: how many of its shingles any other of these nodes has; no link can rest on the others."""
    own = sets.join(nodes, "node", "left_semi")
    items = own.mapInArrow(_items, "node bigint, item bigint")
    alone = items.groupBy("item").agg(F.count("*").alias("n"), F.first("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    counted = own.select("node", (F.length("items") / 8).cast("long").alias("n")).join(alone, "node", "left")
    return counted.select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(plain.mapInArrow(signed, SIGNED), "near-dup-signed")
    full = rows.filter("n_shingles > 0")
    classes = cut(full.groupBy("class", "class_check", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")).withColumnRenamed("class", "node"))
    keyed = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    busy = keyed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(keyed.join(busy, "band"))
    drawn = members.groupBy("node").agg(F.sum("size").alias("pull"))
    pulled = members.join(drawn, "node")
    leaders = pulled.groupBy("band").agg(F.max(F.struct("pull", "node")).getField("node").alias("leader"), F.max(F.struct("pull", "node", "n_shingles")).getField("n_shingles").alias("leader_n"))
    fits = lambda x, y: F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")
    star = members.join(leaders, "band").filter("node <> leader").filter(fits("n_shingles", "leader_n"))
    star = cut(star.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    nodes = members.select("node").distinct()
    by_doc = classes.join(nodes, "node", "left_semi").select("node", "doc_id")
    # one text for each class that shares a bucket: the row of its least key; a key with several texts is told apart by digest
    owner = plain.join(by_doc.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")))
    sets = stored(owner.select("node", "text").mapInArrow(set_rows, "node bigint, items binary").dropDuplicates(["node"]), "near-dup-sets")
    links = cut(confirmed(_by_leader(star), sets, percent))
    where = components(links)
    placed = cut(members.join(where, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    split = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).getField("root").alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_ = placed.join(split, "band").select(F.col("main").alias("family"), "node", "root", "n_shingles").distinct()
    open_ = cut(open_.join(_shared_counts(open_.select("node").distinct(), sets), "node").join(classes.select("node", "bands"), "node"))
    more = cut(_across(open_, sets, percent))
    roots = where if more.isEmpty() else components(links.unionByName(more))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = named.join(ids, "root").select(F.col("node").alias("class"), "class_check", "component_id")
    out = rows.drop("bands").join(member, ["class", "class_check"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay: of each group the one with the least doc_id.

    Texts without words and rows without a doc_id all stay; of rows alike in doc_id and text one stays.
    """
    verdict, own = near_duplicates(docs, percent), fresh(docs, "kept_id")
    kept = cut(verdict.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("rows")))
    out = docs.join(kept.select(own), F.col("doc_id") == F.col(own), "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.filter("doc_id is null"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root)
SELECT r.id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id, r.id = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

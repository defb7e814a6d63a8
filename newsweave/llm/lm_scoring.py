"""Language-model scoring with trigram tries of the corpus itself.

Words are runs of characters other than space and 0x09-0x0D with A-Z in small letters, then one end per document.
Documents whose key digest falls in the held-out remainder teach nothing; all are scored.

1. Texts are read once and stored as chunks of about `CHUNK_TOKENS` tokens: a sorted vocabulary and codes.
2. Each chunk sends its vocabulary's counts, a word at most once, by ranges of fingerprints; sums come back.
3. With the counts, a chunk deals its tokens out by context (the word before). About `SHARD_TOKENS` training tokens
   make a shard; their number follows from the corpus. A context word with more than a quarter of that is split over
   shards of its own by classes of the word before and of the word itself.
4. Such shards count their pairs (word before and context, context and word), the counts are summed over the corpus by
   ranges of pairs, and each shard gets the whole counts of its pairs back. So a split divides work only: all counts that a
   probability needs are the corpus's, and scores do not depend on `shard_tokens`.
5. A shard builds its trie (`elias_fano`), writes it to the shared folder, maps it and scores its tokens by
   successor search. Sums by chunk and document go back.

A document's first word has its unigram probability (c + 0.1) / (N + 0.1 (V + 1)). From there each order is smoothed by the one
below it, which counts as `STRENGTH` observations, and probabilities are kept as eight-bit codes.

Null and empty texts score their end; a null doc_id is trained on (it has no remainder) and reported; repeated rows count
and are scored each; an empty table gives no rows; without training rows only the unigram floor is left; further columns
are ignored. `train_tokens` is N. Everything gathered grows with the corpus; nothing is pruned or capped.
"""

from __future__ import annotations

import mmap
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .arrays import U64, Words, buffers, chunks, mix, release, text_column
from .packed import pack, unpack, value
from .shared import shared_path, store, stored, until_exit

CHUNK_TOKENS, SHARD_TOKENS = 1_600_000, 1_000_000
STRENGTH = 2.0
MODULUS, HELD_OUT = 10, 0
_ID = U64((1 << 56) - 1)
END = U64(2)  # stands for a document's end
CHUNK = "chunk bigint, doc_ids array<bigint>, lengths binary, held binary, vocabulary binary, counts binary, codes binary"
PART = "part int, chunk bigint, payload binary"
SHARD = "shard bigint, chunk bigint, payload binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def is_held(doc_ids: pa.Array) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % MODULUS == HELD_OUT for x in doc_ids.to_pylist()], bool)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all rows, an end after each row, and each row's number of tokens."""
    words = Words(*buffers(text_column(batch)))
    return np.insert((words.hashes() & _ID) | U64(4), words.cut[1:], END), np.diff(words.cut) + 1


def _chunk_rows(batches):
    part, nth = TaskContext.get().partitionId(), 0

    def made() -> pa.RecordBatch:
        keys, lens, flat = pa.chunked_array(ids).combine_chunks(), np.concatenate(lengths), np.concatenate(tokens)
        held = is_held(keys)
        vocabulary, codes = np.unique(flat, return_inverse=True)
        counts = np.bincount(codes[~np.repeat(held, lens)], minlength=len(vocabulary))
        columns = [
            pa.array([(part << 32) + nth]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(pa.array([pack(x)], pa.binary()) for x in (lens, held.astype(np.uint8), vocabulary, counts, codes)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "lengths", "held", "vocabulary", "counts", "codes"])

    ids, lengths, tokens, have = [], [], [], 0
    for batch in chunks(batches):
        flat, lens = _tokens(batch)
        ids.append(text_column(batch, "doc_id").cast(pa.int64()))
        lengths.append(lens)
        tokens.append(flat)
        have += len(flat)
        if have >= CHUNK_TOKENS:
            yield made()
            ids, lengths, tokens, have, nth = [], [], [], 0, nth + 1
    if ids:
        yield made()


def _split(parts: int):
    """A chunk's vocabulary by ranges of fingerprints."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (words,), (counts,) = unpack(value(batch, "vocabulary", i)), unpack(value(batch, "counts", i))
                cut = np.searchsorted(words, np.array([(p << 56) // parts for p in range(parts + 1)], np.uint64))
                full = [p for p in range(parts) if cut[p] < cut[p + 1]]
                payloads = [pack(words[cut[p] : cut[p + 1]], counts[cut[p] : cut[p + 1]]) for p in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([value(batch, "chunk", i)] * len(full), pa.int64()), pa.array(payloads, pa.binary())], names=["part", "chunk", "payload"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Corpus counts and ranks of each chunk's words in one range, and the range's tokens, trained and all words."""
    sent = [unpack(p) for p in table.column("payload").to_pylist()]
    words, at = np.unique(np.concatenate([w for w, _ in sent]), return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in sent]).astype(float)).astype(np.int64)
    cut = np.cumsum([0, *(len(w) for w, _ in sent)])
    payloads = [pack(total[at[a:b]], np.diff(at[a:b], prepend=0)) for a, b in zip(cut[:-1], cut[1:])]
    # the range's sums stand in its first row
    sums = [pa.array([int(x)] + [0] * (len(sent) - 1), pa.int64()) for x in (total.sum(), (total > 0).sum(), len(words))]
    return pa.Table.from_arrays([table.column("part"), table.column("chunk"), pa.array(payloads, pa.binary()), *sums], names=["part", "chunk", "payload", "tokens", "types", "words"])


def unigram(counts: np.ndarray, tokens: int, types: int) -> np.ndarray:
    return (counts + 0.1) / (tokens + 0.1 * (types + 1))


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _shards(tokens: int, shard_tokens: int) -> int:
    return max(1, -(-tokens // shard_tokens))


def _dealt(tokens: int, types: int, sizes: dict[int, int], shard_tokens: int):
    """A chunk's tokens by shard, and one row of what it knows itself (shard below 0).

    From here on a word is its rank among the fingerprints of the corpus. `sizes`: words in each range. Shards from `shards` on
    hold split contexts.
    """
    ranges = sorted(sizes)
    base = dict(zip(ranges, np.cumsum([0, *(sizes[p] for p in ranges)]).tolist()))
    every = sum(sizes.values())
    shards, hot = _shards(tokens, shard_tokens), max(1, shard_tokens // 4)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        rows: list[tuple[int, int, bytes]] = []
        for i in range(left.num_rows):
            chunk = value(left, "chunk", i)
            lens, held, codes = (unpack(value(left, k, i))[0] for k in ("lengths", "held", "codes"))
            back = sorted(zip(right.column("part").to_pylist(), right.column("payload").to_pylist()))
            known, rank = zip(*((n, base[p] + np.cumsum(step.astype(np.int64))) for p, (n, step) in ((p, unpack(x)) for p, x in back)))
            known, words = np.concatenate([n.astype(np.int64) for n in known]), np.concatenate(rank)
            lens, codes = lens.astype(np.int64), codes.astype(np.int32)
            begin = np.cumsum(lens) - lens
            log10 = np.log10(unigram(known, tokens, types))
            own = [lens, np.add.reduceat((known > 0)[codes].astype(np.int64), begin), np.add.reduceat(log10[codes], begin).view(np.uint64), log10[codes[begin]].view(np.uint64)]
            rows.append((-1 - chunk, chunk, pack(held, *own)))
            doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
            inner = np.ones(len(codes), bool)
            inner[begin] = False
            at = np.flatnonzero(inner).astype(np.int32)
            if not len(at):
                continue
            doc, third, second = doc[at], codes[at], codes[at - 1]
            # vocabulary with the place before a document
            start = len(words)
            names, counts = np.append(words, every).astype(np.uint64), np.append(known, 0)
            first, context = np.where(at - 1 > begin[doc], codes[np.maximum(at - 2, 0)], np.int32(start)), second
            shard = (mix(names) % U64(shards)).astype(np.int32)[context]
            busy = np.flatnonzero(counts[context] > hot)
            if len(busy):
                pieces = np.ceil(counts[context[busy]] / hot)
                rows_ = np.ceil(np.sqrt(pieces))
                one, two = rows_.astype(np.uint64), np.ceil(pieces / rows_).astype(np.uint64)
                piece = (mix(names ^ U64(5))[first[busy]] % one) * two + mix(names ^ U64(9))[third[busy]] % two
                shard[busy] = shards + (mix(names[context[busy]] + mix(piece + U64(1))) % U64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            spans = _runs(shard[order])
            remap, used = np.zeros(len(names), np.int32), np.zeros(len(names), bool)
            for s, a, b in spans:
                pick = order[a:b]
                three = (first[pick], context[pick], third[pick])
                if (b - a) * 16 < len(names):
                    local = np.unique(np.concatenate(three))
                else:
                    for x in three:
                        used[x] = True
                    local = np.flatnonzero(used)
                    used[local] = False
                remap[local[_by_count(counts[local])]] = np.arange(len(local))  # common words get small, well packed numbers
                row = doc[pick]
                rows.append((int(s), chunk, pack(np.diff(names[local], prepend=U64(0)), counts[local], *(remap[x] for x in three), np.diff(row, prepend=0), held[row])))
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "chunk", "payload"])

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(values, prepend=-1, append=-1))
    return [(int(values[a]), a, b) for a, b in zip(cut[:-1], cut[1:])]


def _mapped(folder: str, name: str, trie: bytes, keep: bool):
    """Write a trie in the shared folder and map it; a store without local files is read instead.

    Unless it is kept, the file's name goes at once and its bytes with the map.
    """
    files, base = store(folder)
    draft, path = f"{base}/_{name}-{uuid.uuid4().hex}", f"{base}/{name}"
    with files.open_output_stream(draft) as f:
        f.write(trie)
    path = path if keep else draft
    if keep:
        files.move(draft, path)
    try:
        if files.type_name == "local":
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with files.open_input_file(path) as f:
            return f.read_buffer()
    finally:
        if not keep:
            files.delete_file(path)


class _Tokens:
    """A shard's tokens from all chunks: ascending words with their counts, and per token before, context, word (indices) and trained."""

    def __init__(self, payloads: list[bytes]):
        self.sent = [unpack(p) for p in payloads]
        self.words, place = np.unique(np.concatenate([np.cumsum(x[0].astype(np.uint64)) for x in self.sent]), return_inverse=True)
        self.counts = np.zeros(len(self.words), np.int64)
        self.counts[place] = np.concatenate([x[1] for x in self.sent]).astype(np.int64)
        base = np.cumsum([0, *(len(x[0]) for x in self.sent)])
        place = np.concatenate([place[b + _by_count(x[1])] for x, b in zip(self.sent, base)]).astype(np.int32)
        self.before, self.context, self.word = (place[np.concatenate([x[k].astype(np.int64) + b for x, b in zip(self.sent, base)])] for k in (2, 3, 4))
        self.trained = np.concatenate([x[6] for x in self.sent]) == 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints of (before, context) and (context, word), and for each token where its two stand."""
        inner, outer = mix(self.words ^ U64(0x243F6A88)), mix(self.words ^ U64(0x85A308D3))
        of_context = mix(self.words + U64(1))[self.context]
        keys, at = np.unique(np.concatenate([mix(of_context + inner[self.before]), mix(of_context ^ outer[self.word])]), return_inverse=True)
        return keys, at.reshape(2, -1)


def _pair_counts(shards: int, parts: int):
    """The training counts of the pairs in a shard of split contexts, by ranges of fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        shard, rows = table.column("shard")[0].as_py(), []
        if shard >= shards:
            tokens = _Tokens(table.column("payload").to_pylist())
            keys, at = tokens.pairs()
            counts = sum(np.bincount(x[tokens.trained], minlength=len(keys)) for x in at)
            cut = np.append(np.searchsorted(keys, np.array([(p << 64) // parts for p in range(parts)], np.uint64)), len(keys))
            rows = [(p, shard, pack(keys[a:b], counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "shard", "payload"])

    return run


def _pair_totals(table: pa.Table) -> pa.Table:
    """Corpus counts of the pairs in one range, to each shard that asked, in the order it sent them."""
    sent = [unpack(p) for p in table.column("payload").to_pylist()]
    _, at = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in sent]).astype(float)).astype(np.int64)
    cut = np.cumsum([0, *(len(k) for k, _ in sent)])
    payloads = [pack(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.Table.from_arrays([table.column("part"), table.column("shard"), pa.array(payloads, pa.binary())], names=["part", "shard", "payload"])


def _scored(folder: str, keep: bool, tokens: int, types: int, strength: float):
    """Train a shard's trie and score its tokens: chunk, payload (documents and sums)."""

    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        shard, chunk = table.column("shard")[0].as_py(), table.column("chunk")
        if shard < 0:
            return table.select(["shard", "chunk", "payload"])
        release()
        own = _Tokens(table.column("payload").to_pylist())
        prior = unigram(own.counts, tokens, types)
        log10 = np.log10(prior)[own.word]
        given = (None, None)
        if totals.num_rows:
            back = sorted(zip(totals.column("part").to_pylist(), totals.column("payload").to_pylist()))
            given = np.concatenate([unpack(x)[0].astype(np.int64) for _, x in back])[own.pairs()[1]]
        trie = elias_fano.Trie(_mapped(folder, f"shard-{shard:08d}.trie", elias_fano.build(own.words, own.counts, own.context, own.before, own.word, prior, strength, own.trained, given[1], given[0]), keep))
        log10 = trie.log10(trie.node(trie.identify(own.words))[own.context], own.before, own.word, log10)
        cut, payloads = np.cumsum([0, *(len(x[2]) for x in own.sent)]), []
        for x, a, z in zip(own.sent, cut[:-1], cut[1:]):
            step = x[5].astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], step[1:] > 0]))
            sums = np.add.reduceat(log10[a:z], begin)
            payloads.append(pack(step[begin], np.rint(-sums * 1024).astype(np.int64)))
        return pa.Table.from_arrays([table.column("shard"), chunk, pa.array(payloads, pa.binary())], names=["shard", "chunk", "payload"])

    return run


def _gathered(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one chunk: what it knew itself and the shards' sums."""
    keys = left.column("doc_ids").combine_chunks()[0].values if left.num_rows else pa.array([], pa.int64())
    held, score, rest = None, np.zeros(len(keys)), []
    for shard, payload in zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()):
        if shard < 0:
            held, lens, known, base, first = unpack(payload)
            rest = [lens.astype(np.int64), known.astype(np.int64), base.astype(np.uint64).view(float)]
            score += first.astype(np.uint64).view(float)
        else:
            step, sums = unpack(payload)
            score[np.cumsum(step.astype(np.int64))] -= sums.astype(float) / 1024
    columns = [keys, pa.array(held.astype(bool)), *map(pa.array, rest), pa.array(score)]
    return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def lm_scores(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, strength: float = STRENGTH, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text).

    With `folder` (on shared storage) the tries stay there, a file for each shard; otherwise they go when they are done.
    """
    spark = docs.sparkSession
    keep = folder is not None
    folder = folder or shared_path(spark, "lm-tries")
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    if not keep:
        until_exit(spark, folder)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunk_rows, CHUNK), "lm-chunks")
    sent = rows.select("chunk", "vocabulary", "counts").mapInArrow(_split(parts), PART)
    counts = stored(sent.groupBy("part").applyInArrow(_summed, PART + ", tokens bigint, types bigint, words bigint"), "lm-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    sizes = {r.part: r.n for r in counts.groupBy("part").agg(F.sum("words").alias("n")).collect()}  # one number a partition
    dealt = rows.select("chunk", "lengths", "held", "codes").groupBy("chunk").cogroup(counts.select("chunk", "part", "payload").groupBy("chunk")).applyInArrow(_dealt(tokens, types, sizes, shard_tokens), SHARD)
    pairs = dealt.groupBy("shard").applyInArrow(_pair_counts(_shards(tokens, shard_tokens), parts), "part int, shard bigint, payload binary")
    totals = pairs.groupBy("part").applyInArrow(_pair_totals, "part int, shard bigint, payload binary")
    scored = dealt.groupBy("shard").cogroup(totals.withColumnRenamed("shard", "to").groupBy("to")).applyInArrow(_scored(folder, keep, tokens, types, strength), SHARD)
    out = rows.select("chunk", "doc_ids").groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(_gathered, RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

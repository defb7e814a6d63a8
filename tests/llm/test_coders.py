import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from newsweave.llm import elias_fano, range_coder
from newsweave.llm.packed import pack, unpack


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 9000])
@pytest.mark.parametrize("kind", ["zipf", "even", "same", "repeats"])
def test_range_coder(n, kind):
    own = np.random.default_rng(n)
    ids = {
        "zipf": lambda: np.minimum(own.zipf(1.2, n), 65535), "even": lambda: own.integers(0, 65536, n), "same": lambda: np.full(n, 65535), "repeats": lambda: np.resize(own.integers(0, 50000, 37), n),
    }[kind]().astype(np.uint16)
    raw = range_coder.encode([ids, ids[: n // 2]])
    back = range_coder.decode(raw)
    assert np.array_equal(back[0], ids)
    assert np.array_equal(back[1], ids[: n // 2])
    if kind in ("same", "repeats") and n > 4000:
        assert len(raw[0]) < 0.3 * n


def test_range_coder_checks():
    raw = bytearray(range_coder.encode([np.arange(5000, dtype=np.uint16)])[0])
    raw[-200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        range_coder.decode([bytes(raw)])


def test_range_coder_takes_ids_of_32_bits():
    ids = np.array([65536, 0, (1 << 32) - 1, 1 << 20, 65536] * 300, np.int64)
    assert np.array_equal(range_coder.decode(range_coder.encode([ids]))[0], ids)


def test_range_coder_beats_order_0_and_zlib():
    import pyarrow.parquet as pq

    from newsweave.llm.tokens import Encoder

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids = Encoder().encode(texts)[0][:400_000]
    count = np.bincount(ids)
    count = count[count > 0]
    bits = 8 * len(range_coder.encode([ids])[0]) / len(ids)
    assert bits < -(count / len(ids) * np.log2(count / len(ids))).sum() - 0.3
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 0.3


def test_pieces_of_every_code_point():
    """Also those that are newer than Python's tables."""
    from newsweave.llm.tokens import Encoder

    encoder = Encoder(special_as_text=True)
    texts = ["".join(f"a{chr(c)}1's {chr(c)}" for c in range(base, base + 64)) for base in range(0, 0x30000, 64) if not 0xD800 <= base < 0xE000]
    flat, per_row = encoder.encode(pa.array(texts))
    cut = np.concatenate([[0], np.cumsum(per_row)])
    assert all(e.ids == flat[a:b].tolist() for e, a, b in zip(encoder.tokenizer.encode_batch(texts, add_special_tokens=False), cut, cut[1:]))


def odd_texts(n):
    own = np.random.default_rng(5)
    letters = [*"abcdefgh' ", "é", "中", "🙂", "\x00", "\u0100", "ÿ", "\n", "1", "#"]
    return [*("".join(own.choice(letters, size)) for size in own.integers(0, 60, n)), "", "x" * 30000, " ", "\u00f5"]


def test_library_gets_many_pieces_in_one_text(monkeypatch):
    from newsweave.llm.tokens import Encoder

    encoder, calls = Encoder(), []
    lists = encoder._lists
    monkeypatch.setattr(encoder, "_lists", lambda tokenizer, texts: calls.append(len(texts)) or lists(tokenizer, texts))
    texts = odd_texts(2000)
    flat, per_row = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert flat.tolist() == [i for ids in want for i in ids]
    assert per_row.tolist() == [len(ids) for ids in want]
    assert sum(calls) * 50 < len(encoder.keys)


def test_library_gets_pieces_one_by_one_without_a_mark(tmp_path):
    """Where a merge takes every byte that could stand between, or an added token may stand within a piece."""
    import json

    from newsweave.llm.tokens import ALPHABET, Encoder, default_tokenizer

    with open(default_tokenizer()) as file:
        merged, added = (json.loads(text) for text in [file.read()] * 2)
    model = merged["model"]
    for b in (*range(0xF5, 0x100), 0xC0, 0xC1):
        model["vocab"]["a" + chr(ALPHABET[b])] = 60000 + b
        model["merges"].append(["a", chr(ALPHABET[b])] if isinstance(model["merges"][0], list) else f"a {chr(ALPHABET[b])}")
    added["added_tokens"].append({"id": 70000, "content": "bc", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    for k, made in enumerate((merged, added)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(made))
        encoder = Encoder(str(path), special_as_text=True)
        assert encoder.mark is None
        texts = odd_texts(300)
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(pa.array(texts))[0].tolist() == [i for ids in want for i in ids]


def test_places():
    from newsweave.llm.tokens import Places

    own = np.random.default_rng(7)
    # many that want the same slots, the last ones too, and a table that grows
    keys = np.unique(np.concatenate([own.integers(0, 1 << 63, 30_000, dtype=np.uint64), np.arange(300, dtype=np.uint64) << np.uint64(40), (np.arange(1, 300, dtype=np.uint64) << np.uint64(40)) - np.uint64(1)]))
    own.shuffle(keys)
    places, at = Places(8), 0
    for n in (0, 1, 5, 500, 9000, len(keys)):
        assert (places.find(keys[at:]) == -1).all()
        places.add(keys[at:n])
        at = max(at, n)
        assert len(places) == at
        assert np.array_equal(places.find(keys[:at]), np.arange(at))


def test_encoder_forgets(monkeypatch):
    from newsweave.llm import tokens

    monkeypatch.setattr(tokens, "MOST_CACHED", 500)
    encoder, texts = tokens.Encoder(), odd_texts(600)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        flat, _ = encoder.encode(pa.array(some))
        assert flat.tolist() == [i for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False) for i in e.ids]
    assert len(encoder.keys) < 2000


def test_range_coder_searches_few_places():
    """Nearly all ids are found by the table of nearest ids, and all of them are the ones that a search finds."""
    own = np.random.default_rng(2)
    model = range_coder._Model(3000)
    for _ in range(40):
        model.new.append(np.minimum(own.zipf(1.3, 8192), 3000) - 1)
    model._refresh()
    every = np.concatenate([model.cum[:-1], model.cum[1:] - 1, own.integers(0, model.cum[-1], 100_000)])
    assert np.array_equal(model._holding(every), np.searchsorted(model.cum, every, "right") - 1)
    at = own.integers(0, model.cum[-1], 100_000)
    assert (model.near[at >> range_coder._NEAR] != model.near[(at >> range_coder._NEAR) + 1]).mean() < 0.15


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 1 << 56), (1000, 1500), (3000, 1 << 40)])
def test_sequence(n, universe):
    own = np.random.default_rng(n)
    values = np.sort(own.choice(universe, n, replace=False) if universe < 1 << 30 else own.integers(0, universe, n))
    made = elias_fano.Sequence(np.frombuffer(elias_fano.encode_sequence(values, universe) + b"pad", np.uint8))
    assert np.array_equal(made.values if n else values, values)
    ask = np.concatenate([values, own.integers(0, universe, 50)]).astype(np.int64)
    for part in (ask, *ask[:5].reshape(-1, 1)):
        at, equal = made.successor(part)
        assert np.array_equal(at, np.searchsorted(values, part))
        assert np.array_equal(equal, np.isin(part, values))


def test_trie_sums_to_one():
    own = np.random.default_rng(0)
    words = np.sort(own.choice(1 << 40, 30, replace=False)).astype(np.uint64)
    before, context, word = (np.minimum(own.zipf(1.5, 4000) - 1, 29) for _ in range(3))
    prior = np.bincount(word, minlength=30) + 0.1
    prior = prior / prior.sum()
    counts = np.bincount(context, minlength=30)  # a word is followed by one token each time
    trie = elias_fano.Trie(elias_fano.build(words, counts, context, before, word, prior, 2.0))
    ids = trie.identify(words)
    assert np.array_equal(ids, np.arange(30))
    assert np.array_equal(trie.identify(np.array([1, 1 << 50], np.uint64)), [-1, -1])
    for c, b in ((0, 0), (0, 29), (5, 1), (29, 29)):
        p = 10 ** trie.log10(np.repeat(trie.node(ids[[c]]), 30), np.full(30, b), np.arange(30), np.log10(prior))
        assert abs(p.sum() - 1) < 0.05


def test_pack():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([1 << 40, 3]), np.array([True, False])]
    back = unpack(pack(*arrays))
    assert all(np.array_equal(a, b) for a, b in zip(arrays, back))


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_is_held_few_times():
    """Coding 2**21 ids of two bytes makes no 64-bit copies of all of them (before: 30 and 42 MB)."""
    ids = np.minimum(np.random.default_rng(3).zipf(1.3, range_coder.BLOCK), 50_000).astype(np.uint16)
    raw = []
    assert _peak(lambda: raw.extend(range_coder.encode([ids]))) < 28e6
    back = []
    assert _peak(lambda: back.extend(range_coder.decode(raw))) < 38e6
    assert np.array_equal(back[0], ids)


def test_a_new_encoder_is_built_in_little_memory():
    """A worker builds its own; the pieces of all unknown characters at once took 79 MB."""
    from newsweave.llm import tokens

    assert _peak(lambda: tokens._classes.__wrapped__(tokens.default_tokenizer())) < 20e6


def test_tokens_are_made_of_few_texts_at_once(monkeypatch):
    """A batch of 9 MB is encoded by stretches, with the ids that it gets as a whole (before: 64 MB)."""
    from types import SimpleNamespace

    from newsweave.llm import token_output, tokens
    from newsweave.llm.arrays import text_column

    own = np.random.default_rng(5)
    words = np.array([f"{'' if k % 3 else 'W'}ord{k}" for k in range(3000)])
    texts = [" ".join(words[own.integers(0, 3000, 200)]) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(token_output, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(token_output.range_coder, "encode", lambda streams: [s.astype("<u4").tobytes() for s in streams])
    tokens.encoder(None, False).encode(text_column(batch)[:10])
    out = []
    assert _peak(lambda: out.extend(token_output._coding(None, 2, False)(iter([batch])))) < 40e6
    flat, per_row = tokens.with_end(*tokens.Encoder().encode(text_column(batch)), 2)
    assert b"".join(p for b in out for p in b.column("payload").to_pylist()) == flat.astype("<u4").tobytes()
    assert [n for b in out for row in b.column("lengths").to_pylist() for n in row] == per_row.tolist()


def test_places_grow_in_little_memory():
    """From 2**20 to 2**21 slots (before: 61 MB)."""
    from newsweave.llm import tokens

    keys = np.random.default_rng(7).permutation(np.arange(1, 600_001, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    places = tokens.Places()
    places.add(keys[:500_000])
    assert _peak(lambda: places.add(keys[500_000:530_000])) < 45e6
    places.add(keys[530_000:])
    assert np.array_equal(places.find(keys), np.arange(600_000))
    assert (places.find(keys + np.uint64(1)) == -1).all()

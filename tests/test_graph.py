"""Components and the greedy choice on graphs against plain Python; titles that share their beginnings."""

import random
import time

import pytest
from pyspark.sql import functions as F

from newsweave.operators import dedup, graph, skew


def greedy(edges):
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    gone = set()
    for b in sorted(before):
        if before[b] - gone:
            gone.add(b)
    return gone


def graphs():
    rng = random.Random(4)
    some = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(180)}
    chain = {(i, i + 1) for i in range(1000, 1200)}
    star = {(2000, i) for i in range(2001, 2080)}
    clique = {(a, b) for a in range(3000, 3020) for b in range(a + 1, 3020)}
    return some | chain | star | clique


@pytest.mark.parametrize("most", [200_000, 30])
def test_greedy_drops(spark, most):
    edges = sorted(graphs())
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.id for r in graph.greedy_drops(frame, most).collect()} == greedy(edges)
    assert graph.greedy_drops(frame.limit(0)).count() == 0


def test_components(spark):
    edges = [*graphs(), (7, 7), (None, 3), (5000, None)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_chain_takes_few_jobs(spark):
    """A chain of 200 links is settled in as many jobs as its logarithm asks for, not one round a link."""
    frame = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("chain", "chain")
    assert {r.id for r in graph.greedy_drops(frame).collect()} == set(range(1, 201, 2))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 120


def words(rng, n):
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) + " "
    return out[:n]


def test_common_beginnings(spark):
    """Titles that begin alike take no longer than others, and no pair is lost among them."""
    rng = random.Random(9)
    plain = [words(rng, 70) for _ in range(600)]
    head = words(rng, 26)
    alike = [head + words(rng, 44) for _ in range(600)]
    alike += [t[:40] + "x" + t[41:] for t in alike[:30]] + [t + "yz" for t in alike[30:50]]
    took = []
    for titles in (plain, plain, alike):
        frame = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
        start = time.monotonic()
        got = {(r.a, r.b) for r in dedup.near_pairs(frame).collect()}
        took.append(time.monotonic() - start)
    want = {(i, j) for j in range(len(alike)) for i in range(max(0, j), j)} | {(i, 600 + i) for i in range(50)}
    assert got == want
    assert took[2] < 3 * took[1] + 2


def test_halves_in_common_do_not_meet(spark):
    """Of titles that share their first half, only pairs that may be alike are written."""
    rng = random.Random(11)
    head = words(rng, 40)
    titles = [head + words(rng, 40) for _ in range(800)]
    titles += [t[:60] + "q" + t[61:] for t in titles[:20]] + [t[1:77] for t in titles[20:30]] + [t[4:] + "abc" for t in titles[30:40]]
    sized = spark.createDataFrame(list(enumerate(titles)), "id long, title string").select("id", "title", F.length("title").alias("n"), dedup.letters("title").alias("letters"))
    met = {(r.id, r.l_id) for r in dedup.meeting(sized).collect()}
    assert {(i, 800 + i) for i in range(40)} <= met
    assert len(met) < 3000  # of 319,600 pairs with a common half


def test_counts_of_heavy_keys(spark):
    rows = [(1, i) for i in range(500)] + [(k, 0) for k in range(2, 90) for _ in range(k % 5)] + [(None, 5)]
    got = skew.with_counts(spark.createDataFrame(rows, "k long, v int"), "k", "n", share=10).collect()
    assert sorted((r.k, r.v, r.n) for r in got) == sorted((k, v, sum(x == k for x, _ in rows)) for k, v in rows if k is not None)


@pytest.mark.parametrize("common", [40, 58])
def test_large_families_meet_on_arrays(spark, common):
    """The titles of a large family are told apart within the tasks, on arrays, and few of them go on to the ratio."""
    rng = random.Random(12)
    head = words(rng, common)
    plain = [words(rng, 80) for _ in range(7000)]
    family = [head + words(rng, 80 - common) for _ in range(7000)]
    took = []
    for titles in (plain, plain, family):
        frame = spark.createDataFrame(list(enumerate(titles)), "id long, title string").repartition(4)
        start = time.monotonic()
        got = {(r.a, r.b) for r in dedup.near_pairs(frame).collect()}
        took.append(time.monotonic() - start)
    assert all(dedup.ratio(family[a], family[b]) >= 95 for a, b in got)
    some = range(0, 7000, 23)
    want = {(i, j) for j in some for i in some if i < j and dedup.ratio(family[i], family[j]) >= 95}
    assert want == {(a, b) for a, b in got if a % 23 == 0 and b % 23 == 0}
    assert took[2] < 4 * took[1] + 5


def test_meeting_in_batches():
    """Rows of a gram may come in any number of batches; what meets is the same as by a look at all pairs of rows."""
    import pyarrow as pa

    rng = random.Random(13)
    drawn = [(rng.randrange(40), rng.randrange(60, 81), rng.getrandbits(5) - 9, own, rng.randrange(1, 20), g - 20, rng.randrange(3)) for g in range(40) for own in (True, False) for _ in range(rng.randrange(90 if g % 5 == 0 else 4))]
    names = ["id", "n", "letters", "is_long", "at", "gram", "before"]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*drawn), [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()])], names=names)
    want = set()
    for a, n, x, is_long, at, gram, before in drawn:
        for b, l_n, y, l_long, l_at, l_gram, l_before in drawn:
            edits, shift = (n + l_n) // 20, at - l_at
            if is_long and not l_long and gram == l_gram and before != l_before and (l_n, b) < (n, a) and n - l_n <= edits and abs(shift) + abs(n - l_n - shift) <= edits and ((x ^ y) & (1 << 64) - 1).bit_count() <= edits:
                want.add((min(a, b), max(a, b)))
    for rows in (1000, 64, 3):
        met = {(a, b) for batch in dedup._meet(iter(table.to_batches(max_chunksize=rows))) for a, b in zip(batch["id"].to_pylist(), batch["l_id"].to_pylist())}
        assert met == want

"""Cases of the first review: each was lost before."""

import pytest

from newsweave.llm import decontaminate, pii


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")


def test_pipeline_takes_near_copies_from_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(250)]
    near, far = list(words), list(words)
    for i in (20, 70, 120, 170, 220):  # 25 of 246 shingles: 221 / 271 = 0.815
        near[i] = "edited"
    for i in (20, 60, 100, 140, 180, 220):  # 30 of 246: 216 / 276 = 0.783
        far[i] = "other"
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


LONG = " ".join(f"{'Anna' if i in (10, 100, 190) else 'plain' + chr(97 + i % 26) + chr(97 + i // 26)}" for i in range(200))


def found(spark, docs, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.leaks(frame(spark, docs), bench).collect()}


@pytest.mark.parametrize("nth", [0, 1, 2])
def test_one_changed_name_does_not_hide_a_copy(spark, nth):
    words = LONG.split(" ")
    words[(10, 100, 190)[nth]] = "Anne"
    assert found(spark, [(1, " ".join(words))], [LONG]) == {(1, 0): True}


def test_items_without_plain_words_and_case_changed_copies(spark):
    items = ["What is 345 times 27 minus 18", "Oslo Bergen", "Anna Keller met Mary Jones of Oslo and Peter Smith from Bergen in Rome", "11 12 13 14 15 16 17 18 19 20 21"]
    docs = [(k, f"so {t} it goes") for k, t in enumerate(items)] + [(10 + k, f"so {t.upper()} it goes") for k, t in enumerate(items)] + [(20, items[2].lower()), (30, "What is 346 times 27 minus 18")]
    assert found(spark, docs, items) == {(a, k): True for k in range(4) for a in (k, 10 + k)} | {(20, 2): True}


@pytest.mark.parametrize("tried", range(30))
def test_longest_stretch(tried):
    import random

    own = random.Random(tried)
    rows = [{(own.choice("ab"), own.choice("xy")) for _ in range(own.randint(0, 2))} for _ in range(12)]
    fits = lambda part: len({x for x, _ in set().union(*part)}) == len(set().union(*part))
    assert decontaminate.longest(rows) == max(j - i for i in range(12) for j in range(i, 13) if i == j or fits(rows[i:j]))


def test_only_the_rows_with_a_passage_go(spark):
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    docs = frame(spark, [(None, LONG), (None, "clean"), (None, None), (7, LONG), (7, "clean"), (8, "clean")])
    assert sorted(map(str, decontaminate.drop_leaks(docs, bench).collect())) == sorted(map(str, frame(spark, [(None, "clean"), (None, None), (7, "clean"), (8, "clean")]).collect()))


def test_identifiers_in_groups_and_short_ones(spark):
    seeds = [f"please call me on +44 20 7946 {1000 + i} today" for i in range(20)] + [f"write to us at user{i}@host{i}.example now" for i in range(20)]
    numbers = ["(020) 7946 0958", "020 7946 0958", "020 7946-0958", "020.7946.0958", "12345", "020 7946 0958."]
    texts = seeds + [f"please call me on {n} today" for n in numbers] + ["write to us at a@b now"]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, enumerate(texts))).collect()}
    for k, n in enumerate(numbers):
        assert got[40 + k] == f"phone:18:{18 + len(n.rstrip('.'))}"
    assert got[46] == "email:15:18"

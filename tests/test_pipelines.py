import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsweave.constants import TAG_ALERT, TAG_NEW
from newsweave.operators import dedup, scan, search, stats
from newsweave.schemas import ENTRY, PAGE, RAW_ENTRY

NOW = datetime(2024, 3, 5, 12)


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")



def entry(feed, nth, link, title, summary=None, age=timedelta(hours=10), description=None):
    return (feed, nth, link, title, summary, description, None if age is None else NOW - age)


ENTRIES = [
    entry(0, 0, "https://vnexpress.net/1", "Sởi bùng phát", "Ghi nhận 7 ca tại đây"),
    entry(0, 1, "https://vnexpress.net/1", "Sởi lần hai"),
    entry(0, 2, "", "Sởi không có link"),
    entry(0, 3, None, "Sởi không có link"),
    entry(0, 4, "https://vnexpress.net/2", "Tư vấn về sởi", age=timedelta(hours=1)),
    entry(1, 0, "https://vnexpress.net/2", "Sởi sau tư vấn"),
    entry(1, 1, "https://dantri.com.vn/3", "Cúm A và sởi", "x" * 501, timedelta(days=5)),
    entry(1, 2, "https://dantri.com.vn/4", "Cúm A", "", timedelta(days=5, seconds=1)),
    entry(1, 3, "https://other.test/5", "cúm a mới", None, None, "15 ca mắc trong mô tả"),
    entry(1, 4, "https://cand.com.vn.evil.test/6", "Sởi", "20 trường hợp", timedelta(hours=-3)),
    entry(1, 5, "https://tuoitre.vn/7", "Sởi đã lưu"),
    entry(1, 6, "https://tuoitre.vn/8", None),
]


def test_route(spark):
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    existing = spark.createDataFrame([("https://tuoitre.vn/7",), ("https://other.test/5",)], "link string")
    routed = scan.route(entries, ["cúm A", "sởi"], [], existing, as_of()).cache()
    got = {r.link: r for r in routed.collect()}
    assert {k: r.route for k, r in got.items()} == {
        "https://vnexpress.net/1": "saved", "https://dantri.com.vn/3": "saved", "https://other.test/5": "unknown", "https://cand.com.vn.evil.test/6": "saved", "https://tuoitre.vn/7": "existing",
    }
    first = got["https://vnexpress.net/1"]
    assert (first.title, first.tags, first.case_count, first.source) == ("Sởi bùng phát", TAG_ALERT, 7, "vnexpress.net")
    third = got["https://dantri.com.vn/3"]
    assert (third.keywords_matched, third.primary_disease, len(third.summary)) == ("cúm A, sởi", "cúm A", 503)
    fifth = got["https://other.test/5"]
    assert (fifth.tags, fifth.case_count, fifth.published_date, fifth.summary) == (TAG_NEW, 15, NOW, "15 ca mắc trong mô tả")
    assert got["https://cand.com.vn.evil.test/6"].tags == TAG_NEW
    assert scan.counts(routed).first().saved_trusted_count == 3
    assert {(r.disease_name, r.case_count) for r in scan.cases(routed, as_of()).collect()} == {("sởi", 7), ("sởi", 20)}
    assert scan.unknown(routed).count() == 1
    assert scan.unknown(routed, False).count() == 0
    strict = scan.route(entries, ["sởi"], [], None, as_of(), scan.ScanOptions(suffix_match=True))
    assert strict.filter("link like '%evil%'").first().route == "unknown"


def test_route_without_keywords_or_entries(spark):
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    assert scan.route(entries, [], [], None, as_of()).count() == 0
    assert scan.route(entries.limit(0), ["sởi"], [], None, as_of()).count() == 0


def test_newest_hundred_keywords(spark):
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    assert scan.route(entries, [f"k{i}" for i in range(100)] + ["sởi"], [], None, as_of()).count() == 0


def mutated(rng, title, edits):
    for _ in range(edits):
        i = rng.randrange(len(title) + 1)
        kind = rng.randrange(3)
        title = title[:i] + (rng.choice("abc") if kind < 2 else "") + title[i + (kind > 0) :]
    return title


def titles(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = "".join(rng.choice("abcd ") for _ in range(rng.choice([1, 2, 10, 25, 40, 80])))
        out += [base] + [mutated(rng, base, rng.randrange(6)) for _ in range(rng.randrange(5))]
    rng.shuffle(out)
    return [t for t in out[:n] if t.strip()]


def test_near_pairs_against_all_pairs(spark):
    distinct = sorted(set(titles(3, 250)))
    frame = spark.createDataFrame(list(enumerate(distinct)), "id int, title string")
    got = [(r.a, r.b) for r in dedup.near_pairs(frame).collect()]
    want = {(i, j) for j in range(len(distinct)) for i in range(j) if dedup.ratio(distinct[i], distinct[j]) >= 95}
    assert len(got) == len(set(got))
    assert set(got) == want
    assert len(want) >= 50


def test_fuzzy_first_is_greedy(spark):
    rows = titles(5, 200)
    frame = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(rows)], "feed_ord int, entry_ord long, title string")
    order = sorted(range(len(rows)), key=lambda i: (i % 3, i))
    keep = dedup.greedy([rows[i].strip().lower() for i in order])
    assert sorted(r.entry_ord for r in dedup.fuzzy_first(frame).collect()) == sorted(i for i, k in zip(order, keep) if k)
    assert dedup.fuzzy_first(frame.limit(0)).count() == 0


def test_common_subsequence():
    assert dedup.common_subsequence("abcbdab", "bdcaba") == 4
    assert dedup.common_subsequence("", "x") == 0
    assert dedup.ratio("", "") == 100


BODY = "A page with a paragraph that has many more than ten words in it. And more. End."


def test_search_news(spark):
    when = "Tue, 05 Mar 2024 10:00:00 GMT"
    entries = spark.createDataFrame(
        [
            (0, 0, "https://r/?url=https://a.vn/1?x=1", " Ebola outbreak in the north grows quickly ", when), (0, 1, "https://a.vn/2", "Ebola outbreak in the north grows quickly!", when), (0, 2, "https://a.vn/3", "ebola page is missing", when),
            (1, 0, "https://a.vn/4", "ebola page is missing.", when), (1, 1, "https://a.vn/5", "MERS update", when), (1, 2, "https://a.vn/6", "MERS too old", "2024-03-01"), (1, 3, "https://a.vn/7", "no keyword", when), (1, 4, "https://a.vn/8", "Ebola bad date", "soon"), (1, 5, None, "Ebola no link", when),
        ],
        RAW_ENTRY,
    )
    pages = spark.createDataFrame([("https://a.vn/1", f"<p>{BODY}"), ("https://a.vn/4", f"<p>{BODY}"), ("https://a.vn/5", '<meta name="description" content="too short">')], PAGE)
    found = search.search_news(entries, pages, ["sebs"], 3, as_of())
    rows = found.collect()
    assert [(r.n, r.title, r.published, r.link) for r in rows] == [(1, "Ebola outbreak in the north grows quickly", "2024-03-05 10:00", "https://a.vn/1")]
    assert search.report(found).first().entry.startswith("1. Ebola outbreak")


def test_dates_and_pages_are_read_once(spark, tmp_path, monkeypatch):
    """A date is read of the entries found by title only, above the join that makes them; a page is taken apart once, however many entries have its link."""
    when = "Tue, 05 Mar 2024 10:00:00 GMT"
    titled = spark.createDataFrame([(0, i, f"https://a.vn/{i // 2}", f"Ebola {word} report") for i, word in enumerate(["northern", "weekly", "late", "first"])], "feed_ord int, entry_ord int, link string, title string")
    entries = titled.join(spark.createDataFrame([(i, when) for i in range(9)], "entry_ord int, published string"), "entry_ord")
    plan = search.candidates(entries, ["sebs"], 3, as_of())._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp" not in plan.split("Join ", 1)[1]

    seen = str(tmp_path / "seen")

    @F.pandas_udf("string")
    def snippet(pages):
        with open(seen, "a") as out:
            out.write("".join(f"{p}\n" for p in pages))
        return pages

    monkeypatch.setattr(search.html, "snippet", snippet)
    pages = spark.createDataFrame([(f"https://a.vn/{i}", f"page {i} {BODY}") for i in range(5)], PAGE)
    found = search.search_news(entries, pages, ["sebs"], 3, as_of()).collect()
    assert sorted((r.n, r.link) for r in found) == [(1, "https://a.vn/0"), (2, "https://a.vn/0"), (3, "https://a.vn/1"), (4, "https://a.vn/1")]
    assert sorted(open(seen).read().splitlines()) == [f"page {i} {BODY}" for i in range(2)]


def test_statistics(spark):
    cases = spark.createDataFrame([(1, "a", 3, NOW), (2, "a", 1, NOW - timedelta(days=2)), (3, "b", 4, NOW - timedelta(days=7)), (4, "b", 2, NOW - timedelta(days=7, seconds=1))], "article_id int, disease_name string, case_count int, report_date timestamp_ntz")
    trend = stats.trends(cases, 7, as_of())
    assert {(r.date, r.cases) for r in trend.collect()} == {("2024-03-05", 3), ("2024-03-03", 1), ("2024-02-27", 4)}
    assert {(r["name"], r.cases) for r in stats.labelled(trend).collect()} == {("03/05", 3), ("03/03", 1), ("02/27", 4)}
    assert [tuple(r) for r in stats.labelled(trend.limit(0)).collect()] == [("Chưa có data", 0)]
    assert {tuple(r) for r in stats.shares(cases).collect()} == {("a", 4, 40), ("b", 6, 60)}
    assert [r.change for r in stats.change(trend).orderBy("date").collect()] == [None, -3, 2]
    identity = spark.createDataFrame([(1, "t", "l", NOW), (2, "t", "m", NOW)], "id long, title string, link string, published_date timestamp_ntz")
    details = spark.createDataFrame([(1, 1, "s", "d", "k", "Mới, Cảnh báo", True)], "id long, article_id long, summary string, source string, keywords_matched string, tags string, is_whitelisted boolean")
    assert tuple(stats.overview(identity, details, cases).first()) == (2, 10, 1)
    assert tuple(stats.overview(identity.limit(0), details, cases.limit(0)).first()) == (0, 0, 0)
    flat = {r.id: r for r in stats.flat_articles(identity, details).collect()}
    assert (flat[2].tags, flat[2].is_whitelisted, flat[1].is_whitelisted) == (None, False, True)
    tools = spark.createDataFrame([("alerts", 3420, 2145), ("script", 5678, 4892)], "tool string, articles int, relevant int")
    long = tools.select("tool", F.explode(F.sequence(F.lit(1), "articles")).alias("i"), "relevant")
    assert {(r.tool, r.accuracy) for r in stats.accuracy(long, "tool", F.col("i") <= F.col("relevant")).collect()} == {("alerts", 62.7), ("script", 86.2)}
    assert [r.id for r in stats.page(identity, F.desc("id"), skip=1, limit=1).collect()] == [1]
    assert stats.ui_page(identity, F.asc("id"), number=0).count() == 2


def test_no_whole_text_is_exchanged(spark):
    """What a scan makes of texts is made before the window over links."""
    entries = spark.createDataFrame([(0, 0, "http://a.vn/1", "dịch sởi", "x" * 900 + " 12 ca mắc", datetime(2024, 3, 5))], "feed_ord int, entry_ord int, link string, title string, summary string, published timestamp_ntz")
    routed = scan.route(entries, ["sởi"], ["a.vn"], None, as_of())
    assert [(r.case_count, len(r.summary)) for r in routed.collect()] == [(12, 503)]
    below = routed._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1]
    assert "case_count" in below


def test_feed_files_hold_many_entries(spark, tmp_path, monkeypatch):
    from newsweave.plans import searches

    path = str(tmp_path / "feeds")
    monkeypatch.setattr(searches.places, "new", lambda *a: path)
    assert searches._read_feeds(spark, "/root/testdata/sf0.001", 60).count() == 200
    assert len(list((tmp_path / "feeds").rglob("*.txt"))) == 60

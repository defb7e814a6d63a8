import base64
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsweave.functions import dates, display, html, text, urls
from newsweave.operators import numbering, selection

NOW = datetime(2024, 3, 5, 12)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "count"),
    [
        ("thêm 20 trường hợp", 20), ("Ghi nhận 7 ca tử vong", 7), ("ghi nhận 3 ca, 15 ca mắc", 15), ("1.500 ca mắc", 500), ("15.000", 0), ("", 0), (None, 0),
        ("15 ca mắc", 15), ("GẦN 100 NGƯỜI NHIỄM", 100), ("99999999999999 ca mắc", 0), ("phát hiện 4 trường hợp", 4),
    ],
)
def test_case_count(spark, value, count):
    assert one(spark, value, text.case_count) == count


@pytest.mark.parametrize(
    ("title", "keywords", "expected"),
    [
        ("Tư vấn: sốt xuất huyết", ["sốt xuất huyết"], None), ("Sởi và cúm A", ["cúm A", "sởi"], "cúm A, sởi"), ("customers", ["MERS"], "MERS"), ("nothing", ["x1"], None),
        ("a 100% _ b", ["% _"], "% _"), (None, ["a"], None), ("anything", [], None),
    ],
)
def test_match_keywords(spark, title, keywords, expected):
    assert one(spark, title, lambda c: text.match_keywords(c, keywords)) == expected


@pytest.mark.parametrize(
    ("title", "age", "expected"),
    [
        ("Bùng phát ổ dịch", timedelta(hours=4, minutes=59), "Mới, Cảnh báo"), ("Bùng phát ổ dịch", timedelta(hours=5), "Cảnh báo"), ("x", timedelta(hours=5), None), ("x", timedelta(hours=-2), "Mới"),
    ],
)
def test_tags(spark, title, age, expected):
    row = spark.createDataFrame([(title, NOW - age, NOW)], "t string, p timestamp_ntz, n timestamp_ntz")
    assert row.select(text.tags(F.col("t"), F.col("p"), F.col("n")).alias("r")).first().r == expected


def test_truncated_counts_code_points(spark):
    assert one(spark, "ế" * 500, text.truncated) == "ế" * 500
    assert one(spark, "ế" * 501, text.truncated) == "ế" * 500 + "..."


def test_keyword_sets(spark):
    assert len(text.expand_keywords([" SEBS ", "x"])) == 46
    assert text.expand_keywords([" a b "]) == ["a b"]
    assert len(one(spark, " Sebs ", text.expanded)) == 45
    assert one(spark, " Other ", text.expanded) == ["Other"]


def test_primary_disease_and_summary(spark):
    assert one(spark, "cúm A, sởi", text.primary_disease) == "cúm A"
    assert one(spark, " One. Two!  Three? Four.", text.summarised) == "One. Two! Three?"
    assert one(spark, "it's 2, ok", text.token_count) == 6


@pytest.mark.parametrize(
    ("link", "expected"),
    [("https://WWW.VnExpress.net:443/a", "vnexpress.net:443"), ("not a url", ""), (None, ""), ("//h.vn/x", "h.vn"), ("http://u@www.a.www.b/x", "u@a.b"), ("http://a_b.vn?q", "a_b.vn")],
)
def test_domain(spark, link, expected):
    assert one(spark, link, urls.domain) == expected


@pytest.mark.parametrize(
    ("link", "expected"),
    [
        ("http://a.vn/x%3Fy?z#w", "http://a.vn/x"), ("http://a.vn/a+b%20c", "http://a.vn/a+b c"), ("http://a.vn/50%", "http://a.vn/50%"), ("http://a.vn/a;b/c;d?e", "http://a.vn/a;b/c"), ("HTTP://A.vn/X", "http://A.vn/X"), (None, None),
    ],
)
def test_trim_url(spark, link, expected):
    assert one(spark, link, urls.trim_url) == expected


def test_original_link(spark):
    assert one(spark, "https://r/?q=1&url=https://a.vn/x&z", urls.original_link) == "https://a.vn/x"
    assert one(spark, "https://a.vn/x", urls.original_link) == "https://a.vn/x"


def payload(url: str) -> str:
    n = len(url)
    size = bytes([n]) if n < 128 else bytes([n % 128 + 128, n // 128])
    return base64.urlsafe_b64encode(bytes([8, 0x13, 0x22]) + size + url.encode() + bytes([0xD2, 1, 0])).decode().rstrip("=")


@pytest.mark.parametrize("url", ["https://a.vn/x", "https://a.vn/" + "y" * 159, "https://a.vn/" + "~" * 300])
def test_source_url(spark, url):
    assert one(spark, f"https://news.google.com/rss/articles/{payload(url)}?oc=5", urls.source_url) == url


@pytest.mark.parametrize("link", ["https://news.google.com/articles/!!!", "https://news.google.com/articles/", "https://x.vn/articles/abcd", "https://news.google.com/a/b"])
def test_source_url_keeps_others(spark, link):
    assert one(spark, link, urls.source_url) == link


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Tue, 05 Mar 2024 10:00:00 +0700", datetime(2024, 3, 5, 3)), ("Tue, 05 Mar 2024 10:00:00 GMT", datetime(2024, 3, 5, 10)), ("5 Mar 2024 10:00:00 ICT", datetime(2024, 3, 5, 3)), ("Tue, 05 Mar 2024 10:00 EDT", datetime(2024, 3, 5, 14)),
        ("2024-03-05T10:00:00Z", datetime(2024, 3, 5, 10)), ("2024-03-05T10:00:00.5+07:00", datetime(2024, 3, 5, 3)), ("2024-03-05 10:00:00", datetime(2024, 3, 5, 10)), ("2024-03-05", datetime(2024, 3, 5)), ("Mar 5, 2024", datetime(2024, 3, 5)),
        ("nonsense", None), ("", None), (None, None), ("99999-03-05", None),
    ],
)
def test_parsed(spark, value, expected):
    assert one(spark, value, dates.parsed) == expected


LONG = "This paragraph has rather more than ten words in it, surely. Second one! Third? Fourth."


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<meta name="description" content=" A. B. C. D. ">', "A. B. C."), ('<meta content="x og" property="og:description"><p>' + LONG, "x og"), ('<meta name="description" content=""><meta name="twitter:description" content="t">', "t"),
        (f"<p>short</p><p>{LONG}", "This paragraph has rather more than ten words in it, surely. Second one! Third?"), (f"<script>var t='</p>'</script><p>x<p>{LONG}</p>", "This paragraph has rather more than ten words in it, surely. Second one! Third?"),
        ("<div>none</div>", ""), ("", ""), (None, None),
    ],
)
def test_describe(page, expected):
    assert html.describe(page) == expected


def test_display(spark):
    assert one(spark, " a,  b ,,c", display.listed) == ["a", "b", "c"]
    assert one(spark, None, display.listed) == []
    assert one(spark, None, display.badge, "boolean") == display.MANUAL
    assert one(spark, 1234567, display.grouped, "long") == "1,234,567"
    assert one(spark, NOW, lambda c: display.as_json(F.struct(c.alias("at"))), "timestamp_ntz") == '{"at":"2024-03-05 12:00:00 UTC"}'
    assert one(spark, NOW, display.local_date, "timestamp_ntz") == "5/3/2024"


def test_selection(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, link string")
    chosen = spark.createDataFrame([("a",), ("a",), ("z",)], "link string")
    assert [r.id for r in selection.picked(rows, chosen).collect()] == [1]
    assert sorted(r.id for r in selection.without(rows, 2).collect()) == [1, 3]
    assert tuple(selection.tally(rows, chosen).first()) == (3, 1)


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as v").repartition(7)
    got = numbering.numbered(rows, "n", F.desc("v"), after=5).collect()
    assert {r.v: r.n for r in got} == {v: 1005 - v for v in range(1000)}
    assert numbering.numbered(rows.limit(0), "n", F.desc("v")).count() == 0


def test_many_keywords(spark):
    """Ten thousand keywords give what testing each of them gives, in list order."""
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    keywords = [word(rng.randrange(2, 9)) for _ in range(10_000)] + ["Sởi", "ABC", "abc", ""]
    titles = [word(rng.randrange(0, 60)) for _ in range(60)] + ["SỞI và ABC", "", None]
    frame = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    got = {r.i: r.m for r in frame.select("i", text.matched(F.col("t"), keywords).alias("m")).collect()}
    assert got == {i: None if t is None else [k for k in keywords if k.lower() in t.lower()] for i, t in enumerate(titles)}
    some = [k.lower() for k in keywords[:500]]
    held = {r.i: r.h for r in frame.select("i", text.contains_one_of(F.lower("t"), some).alias("h")).collect()}
    assert held == {i: None if t is None else any(k in t.lower() for k in some) for i, t in enumerate(titles)}


def test_pages_by_key(spark):
    """Every page by key is the page by offset, ties and missing times included."""
    from newsweave.operators import stats

    rows = [(i, None if i % 11 == 0 else NOW - timedelta(hours=i % 7)) for i in range(57)]
    frame = spark.createDataFrame(rows, "id long, published_date timestamp_ntz").cache()
    last, seen = None, []
    while page := [tuple(r) for r in stats.page_after(frame, last, limit=10).collect()]:
        want = stats.page(frame, F.desc("published_date"), F.desc("id"), skip=len(seen), limit=10)
        assert page == [tuple(r) for r in want.collect()]
        seen += page
        last = page[-1][::-1]
    assert len(seen) == 57

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsweave import cli
from newsweave.operators import scan, stats
from newsweave.schemas import ENTRY
from newsweave.sources import feeds
from newsweave.sources.store import Duplicate, Store
from newsweave.streaming import scan as streaming

NOW = datetime(2024, 3, 5, 12)


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")



def rows(n, start=0):
    return [(0, i, f"https://vnexpress.net/{i}", f"Sởi {i}", "ghi nhận 3 ca" if i % 2 else "", None, NOW) for i in range(start, start + n)]


def test_keywords_and_domains(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    assert store.add_keywords("sởi", " cúm A ", now=NOW) == 2
    with pytest.raises(Duplicate):
        store.add_keywords("sởi", now=NOW)
    assert store.add_keywords("sởi", "ho gà", now=NOW, strict=False) == 1
    with pytest.raises(ValueError, match="blank"):
        store.add_keywords("  ", now=NOW)
    assert store.keywords() == ["ho gà", "cúm A", "sởi"]
    assert store.delete_keyword(2)
    assert not store.delete_keyword(2)
    assert store.keywords() == ["ho gà", "sởi"]
    store.add_domains("a.vn", "b.vn")
    with pytest.raises(Duplicate):
        store.add_domains("b.vn")
    assert store.domains() == ["a.vn", "b.vn"]
    assert store.find("keywords", "text", "sởi").first().id == 1
    with pytest.raises(ValueError, match="confirm"):
        store.reset()
    store.reset(confirm=True)
    assert store.keywords() == []


def test_scan_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n, expected in ((4, 4), (6, 2)):
        routed = scan.route(spark.createDataFrame(rows(n), ENTRY), ["sởi"], [], store.read("article_identity"), as_of())
        assert store.save_scan(routed, as_of()) == expected
    identity, details, cases = (store.read(t) for t in ("article_identity", "article_details", "disease_cases"))
    assert sorted(r.id for r in identity.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted((r.article_id, r.case_count) for r in cases.collect()) == [(2, 3), (4, 3), (6, 3)]
    assert stats.flat_articles(identity, details).filter("source = 'vnexpress.net'").count() == 6
    extra = spark.createDataFrame([("t", "https://x.test/1", "s", "x.test", None, "sởi", None, False)], "title string, link string, summary string, source string, published_date timestamp_ntz, keywords_matched string, tags string, is_whitelisted boolean")
    assert store.save_articles(extra, as_of()) == 1
    with pytest.raises(Duplicate):
        store.save_articles(extra, as_of())
    assert store.find("article_identity", "link", "https://x.test/1").first().published_date == NOW
    assert store.read("disease_cases").count() == 3


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add_keywords("sởi", now=NOW)
    for n in (2, 5):
        spark.createDataFrame(rows(n), ENTRY).write.mode("append").parquet(str(tmp_path / "in"))
        query = streaming.scan_stream(streaming.entry_stream(spark, str(tmp_path / "in")), store, as_of, str(tmp_path / "mark"))
        query.awaitTermination()
        assert store.read("article_identity").count() == n


RSS = """<?xml version="1.0"?><rss><channel><title>c</title>
<item><title>Sởi</title><link> https://a.vn/1 </link><description>ghi nhận 2 ca</description><pubDate>Tue, 05 Mar 2024 10:00:00 +0700</pubDate></item>
<item><title>Khác</title><link>https://a.vn/2</link></item></channel></rss>"""


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text(RSS)
    got = feeds.read_feeds(spark, [str(path), str(path)]).orderBy("feed_ord", "entry_ord").collect()
    assert [(r.feed_ord, r.link, r.published) for r in got[:2]] == [(0, "https://a.vn/1", datetime(2024, 3, 5, 3)), (0, "https://a.vn/2", None)]
    assert len(got) == 4
    health = stats.feed_health(feeds.read_feeds(spark, [str(path)]), "malformed").first()
    assert (health.entries, health.malformed) == (2, 0)
    routed = scan.route(feeds.read_feeds(spark, [str(path)]), ["sởi"], ["a.vn"], None, as_of()).collect()
    assert [(r.link, r.case_count, r.route) for r in routed] == [("https://a.vn/1", 2, "saved")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "feed.xml").write_text(RSS)
    body = "<p>Một đoạn văn dài hơn mười từ để được chọn làm tóm tắt của trang này."
    spark.createDataFrame([("https://a.vn/1", body), ("https://a.vn/2", body)], "url string, html string").write.parquet(str(tmp_path / "pages"))
    chosen = cli.options(["--keywords", "sởi, ,x1", "--days", "5", "--feeds", str(tmp_path / "feed.xml"), "--pages", str(tmp_path / "pages"), "--as-of", "2024-03-05T12:00:00"])
    assert chosen.keywords == ["sởi", "x1"]
    assert cli.run(spark, chosen) == 1
    assert capsys.readouterr().out.startswith("1. Sởi\n2024-03-05 03:00\nhttps://a.vn/1\n")
    chosen.labels = True
    assert cli.run(spark, chosen) == 1
    assert capsys.readouterr().out.startswith("[1] Sởi\nNgày: 2024-03-05 10:00\nLink: https://a.vn/1\nTóm tắt: Một đoạn")


def test_a_failure_between_writes_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.create()
    routed = lambda: scan.route(spark.createDataFrame(rows(4), ENTRY), ["sởi"], [], store.read("article_identity"), as_of())
    write = Store._write
    for broken in ("article_identity", "disease_cases"):

        def fail(self, table, *args, _broken=broken, **kwargs):
            if table == _broken:
                raise OSError("lost")
            write(self, table, *args, **kwargs)

        monkeypatch.setattr(Store, "_write", fail)
        with pytest.raises(OSError, match="lost"):
            store.save_scan(routed(), as_of())
        monkeypatch.setattr(Store, "_write", write)
        assert [store.read(t).count() for t in ("article_identity", "article_details", "disease_cases")] == [0, 0, 0]
    assert store.save_scan(routed(), as_of()) == 4
    assert [store.read(t).count() for t in ("article_identity", "article_details", "disease_cases")] == [4, 4, 2]


def test_domains_in_capitals_are_trusted(spark):
    routed = scan.route(spark.createDataFrame(rows(2), ENTRY), ["sởi"], ["VnExpress.NET"], None, as_of())
    assert {r.route for r in routed.collect()} == {"saved"}
    assert scan.route(spark.createDataFrame(rows(2), ENTRY), None, [], None, as_of()).count() == 0


def test_ids_are_never_given_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add_keywords("a", "b", now=NOW)
    assert store.delete_keyword(2)
    store.add_keywords("c", now=NOW)
    assert {(r.id, r.text) for r in store.read("keywords").collect()} == {(1, "a"), (3, "c")}
    store.reset(confirm=True)
    store.add_keywords("a", now=NOW)
    assert store.find("keywords", "text", "a").first().id == 4


@pytest.mark.parametrize("local", [True, False])
def test_two_writers_store_each_link_once(spark, tmp_path, local):
    """While one scan is about to put its manifest, another one is stored whole; both are kept, their common links once."""
    first, second = (Store(spark, f"file:{tmp_path}") for _ in range(2))
    if not local:  # the way of other file systems
        first.log.local = second.log.local = None
    routed = lambda a, b: scan.route(spark.createDataFrame(rows(b - a, a), ENTRY), ["sởi"], [], None, as_of())
    put, met = first.log.put, []

    def late(number, state):
        if not met:
            met.append(second.save_scan(routed(2, 6), as_of()))
        return put(number, state)

    first.log.put = late
    assert first.save_scan(routed(0, 4), as_of()) == 2
    assert met == [4]
    assert first.log.numbers() == [1, 2]
    links = [r.link for r in second.read("article_identity").orderBy("id").collect()]
    assert links == [f"https://vnexpress.net/{i}" for i in (2, 3, 4, 5, 0, 1)]
    for table in ("article_identity", "article_details", "disease_cases"):
        ids = sorted(r.id for r in second.read(table).collect())
        assert ids == list(range(1, len(ids) + 1))
    assert second.save_scan(routed(0, 6), as_of()) == 0
    assert not first.log.put(2, {})


def test_kept_totals(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert tuple(store.overview().first()) == (0, 0, 0)
    made = [(0, i, f"https://vnexpress.net/{i}", f"Sởi {'bùng phát' if i % 3 == 0 else ''} {i}", f"ghi nhận {i} ca", None, datetime(2024, 3, 1 + i % 5, i % 24)) for i in range(40)]
    for part in (made[:15], made[10:]):
        store.save_scan(scan.route(spark.createDataFrame(part, ENTRY), ["sởi"], [], None, as_of()), as_of())

    def agrees():
        identity, details, cases = (store.read(t) for t in ("article_identity", "article_details", "disease_cases"))
        assert store.overview().first() == stats.overview(identity, details, cases).first()
        for now, days in ((NOW, 3), (datetime(2024, 3, 6), 4), (NOW, 0)):
            want = stats.trends(cases, days, F.lit(now).cast("timestamp_ntz"))
            assert sorted(map(tuple, store.trends(days, now).collect())) == sorted(map(tuple, want.collect()))

    agrees()
    assert not any("parquet" in str(f) for f in store.overview().inputFiles())
    assert store.compact("article_identity") == 2
    assert store.compact("article_identity") == 0
    assert len(store.state()["tables"]["article_identity"]) == 1
    agrees()
    store.reset(confirm=True)
    agrees()
    assert store.state()["next"]["article_identity"] == 41


def test_many_feeds_in_one_scan(spark, tmp_path):
    """Files, folders and patterns, some named twice; entries in the order of their files."""
    item = lambda i: f"<item><title>t{i}</title><link>https://a.vn/{i}</link></item>"
    for k in range(12):
        folder = tmp_path / f"feed {k}"
        folder.mkdir()
        for part in range(3):
            (folder / f"{part}.xml").write_text("<rss>" + "".join(item(100 * k + 10 * part + j) for j in range(k % 3)) + "</rss>")
    paths = [f"file:{tmp_path}/feed {k}" for k in range(12)] + [f"{tmp_path}/feed 4/1.xml", f"{tmp_path}/feed 5", f"{tmp_path}/feed [78]/*.xml"]
    spark.sparkContext.setJobGroup("feeds", "feeds")
    got = feeds.read_feeds(spark, paths).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("feeds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {n: [100 * k + 10 * part + j for part in range(3) for j in range(k % 3)] for n, k in enumerate([*range(12)])}
    want |= {12: [410], 13: want[5], 14: want[7] + want[8]}
    for n, numbers in want.items():
        own = sorted((r.entry_ord, r.link) for r in got if r.feed_ord == n)
        assert own == [(i, f"https://a.vn/{x}") for i, x in enumerate(numbers)]
    assert len(got) == sum(map(len, want.values()))
    assert jobs < 15
    assert feeds.read_feeds(spark, []).count() == 0


def test_feed_stream(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "1.xml").write_text(RSS)
    for expected in (2, 4):
        query = feeds.feed_stream(spark, str(tmp_path / "in" / "*")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(got) == expected
        assert {r.feed for r in got} == {"a"}
        (tmp_path / "in" / "a" / "2.xml").write_text(RSS)


def test_stateful_stream(spark, tmp_path):
    """Repeated links over restarts are stored once without a look at stored ones; a repeated batch is stored once; all as one batch scan."""
    store, plain = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "plain"))
    for one in (store, plain):
        one.add_keywords("sởi", now=NOW)
    read = []
    find = store.read
    store.read = lambda table, state=None: read.append(table) or find(table, state)
    for nth, (a, b) in enumerate(((0, 3), (1, 6), (0, 6), (4, 9))):
        spark.createDataFrame(rows(b - a, a), ENTRY).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.stateful_scan_stream(streaming.entry_stream(spark, str(tmp_path / "in")), store, as_of, str(tmp_path / "mark")).awaitTermination()
        assert store.state()["streams"]["scan"] >= nth if nth != 2 else True
    assert "article_identity" not in read
    plain.save_scan(scan.route(spark.createDataFrame(rows(9), ENTRY), ["sởi"], [], None, as_of()), as_of())
    for table in ("article_identity", "article_details", "disease_cases"):
        got, want = (sorted(map(tuple, one.read(table).collect())) for one in (store, plain))
        assert got == want
    last = store.state()["streams"]["scan"]
    again = scan.route(spark.createDataFrame(rows(4, 20), ENTRY), ["sởi"], [], None, as_of())
    assert store.save_scan(again, as_of(), batch=("scan", last)) == 0
    assert store.save_scan(again, as_of(), batch=("scan", last + 1)) == 4

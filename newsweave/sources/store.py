"""The stored tables: articles, cases, trusted domains and keywords as parts of Parquet data under a commit log.

A part is a folder of Parquet files that never changes. A manifest of the log names each table's parts, the next id of each
table and running totals; the last manifest is the store. A write makes its parts first and shows them all by putting one manifest, so a failed
write shows nothing. Of two writers one puts first; the other looks again at what is stored, leaves out what the first one
stored, takes later ids and tries again. Ids count up and are never given twice, whatever is deleted. Totals are sums over parts
kept with the commit that adds them, so the overview and whole days of the trend read no data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.constants import TAG_ALERT
from newsweave.operators import stats
from newsweave.operators.dedup import ORDER, not_stored
from newsweave.operators.numbering import numbered
from newsweave.operators.scan import approve, cases, saved
from newsweave.schemas import TABLES

from .log import Conflict, Log
from .places import cut

__all__ = ["Conflict", "Duplicate", "Store"]

IDENTITY, DETAILS, CASES = "article_identity", "article_details", "disease_cases"
EMPTY: dict[str, Any] = {"tables": {}, "next": {}, "totals": {"articles": 0, "alerts": 0, "cases": 0, "days": {}}}
#: parts with fewer rows are merged by `compact`
SMALL = 1_000_000


class Duplicate(ValueError):
    """The row is stored already."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    def state(self) -> dict[str, Any]:
        """The last manifest."""
        return self.log.last() or EMPTY

    def read(self, table: str, state: dict[str, Any] | None = None) -> DataFrame:
        """The current rows (or those of a manifest); no rows where nothing is stored."""
        parts = (state or self.state())["tables"].get(table, [])
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{p['part']}" for p in parts])

    def _write(self, table: str, rows: DataFrame, part: str) -> None:
        rows.select(*[c.split()[0] for c in TABLES[table].split(", ")]).write.parquet(f"{self.root}/{table}/{part}")

    def _add(self, state: dict[str, Any], table: str, rows: DataFrame, n: int, replace: bool = False) -> None:
        """Write `n` rows as a part and name it in the state."""
        part = uuid.uuid4().hex
        self._write(table, rows, part)
        state["tables"][table] = ([] if replace else state["tables"].get(table, [])) + [{"part": part, "rows": n}]

    def _ids(self, state: dict[str, Any], table: str, n: int) -> int:
        """The last id before `n` new ones, which are taken."""
        last = state["next"].get(table, 1) - 1
        state["next"][table] = last + 1 + n
        return last

    def create(self) -> None:
        """An empty store where there is none."""
        self.log.commit(EMPTY, lambda state: (None if self.log.numbers() else state, None))

    def reset(self, confirm: bool = False) -> None:
        """Forget all rows; only with `confirm`. Ids go on where they were."""
        if not confirm:
            raise ValueError("reset deletes every stored row: pass confirm=True")
        self.log.commit(EMPTY, lambda state: ({**EMPTY, "next": state["next"]}, None))

    def _add_articles(self, articles: DataFrame, as_of: Column, *order: str, with_cases: bool = False, strict: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Articles whose links are not stored yet, their details and cases, as one commit.

        With `batch` (a stream's name and the batch's number) the stream sees to it that links come once: stored links are not read, and a
        batch whose number the store has seen is left out.
        """
        articles = cut(articles.withColumn("published_date", F.coalesce("published_date", as_of)))
        wanted = articles.count() if strict else 0

        def build(state: dict[str, Any]) -> tuple[dict[str, Any] | None, int]:
            if batch:
                if state.setdefault("streams", {}).get(batch[0], -1) >= batch[1]:
                    return None, 0
                state["streams"][batch[0]] = batch[1]
            fresh = articles if batch else cut(not_stored(articles, self.read(IDENTITY, state)))
            found = fresh.agg(F.count("*").alias("n"), F.count_if(F.col("tags").contains(TAG_ALERT)).alias("alerts")).first()
            if strict and found.n < wanted:
                raise Duplicate("an article with this link is stored")
            if not found.n:
                return None, 0
            own = cut(numbered(fresh, "id", *[F.col(c) for c in order], after=self._ids(state, IDENTITY, found.n)))
            first = state["next"][IDENTITY] - found.n
            last = self._ids(state, DETAILS, found.n)
            details = own.withColumns({"article_id": F.col("id"), "id": F.col("id") - first + 1 + last, "is_whitelisted": F.coalesce("is_whitelisted", F.lit(False))})
            self._add(state, DETAILS, details, found.n)
            if with_cases:
                rows = cut(cases(own, as_of).join(own.select("link", F.col("id").alias("article_id")), "link"))
                per_day = rows.groupBy(F.date_format("report_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("case_count").alias("cases")).collect()  # one row a day
                n = sum(r.n for r in per_day)
                if n:
                    self._add(state, CASES, numbered(rows, "id", F.col("article_id"), after=self._ids(state, CASES, n)), n)
                days = state["totals"]["days"]
                for r in per_day:
                    days[r.day] = days.get(r.day, 0) + r.cases
                state["totals"]["cases"] += sum(r.cases for r in per_day)
            self._add(state, IDENTITY, own, found.n)
            state["totals"]["articles"] += found.n
            state["totals"]["alerts"] += found.alerts
            return state, found.n

        return self.log.commit(EMPTY, build)

    def save_scan(self, routed: DataFrame, as_of: Column, batch: tuple[str, int] | None = None) -> int:
        """Store the saved articles of a scan and their cases; gives the number of articles. What another scan stored since is left out;
        with `batch` see `_add_articles`."""
        return self._add_articles(saved(routed).drop("id"), as_of, *ORDER, with_cases=True, batch=batch)

    def save_articles(self, articles: DataFrame, as_of: Column, strict: bool = True) -> int:
        """Store articles approved by hand (one or many); with `strict`, one that is stored already is an error."""
        once = articles.dropDuplicates(["link"])
        if strict and approve(once, self.read(IDENTITY)).count() < articles.count():
            raise Duplicate("an article with this link is stored")
        return self._add_articles(once, as_of, "link", strict=strict)

    def _add_rows(self, table: str, key: str, rows: DataFrame, extra: dict[str, Column], strict: bool) -> int:
        """`rows`: _n (order), and the key."""
        rows = cut(rows.withColumns({key: F.trim(F.col(key)), **extra}))
        wanted = rows.count()
        if not rows.filter(F.col(key).isNull() | (F.col(key) == "")).isEmpty():
            raise ValueError(f"a blank {key}")
        rows = rows.groupBy(key, *extra).agg(F.min("_n").alias("_n"))

        def build(state: dict[str, Any]) -> tuple[dict[str, Any] | None, int]:
            fresh = cut(not_stored(rows, self.read(table, state), key))
            n = fresh.count()
            if strict and n < wanted:
                raise Duplicate(f"this {key} is stored")
            if not n:
                return None, 0
            self._add(state, table, numbered(fresh, "id", F.col("_n"), after=self._ids(state, table, n)), n)
            return state, n

        return self.log.commit(EMPTY, build)

    def _listed(self, values: Iterable[str], key: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(values)), f"_n int, {key} string")

    def add_keywords(self, *texts: str, now: datetime, strict: bool = True) -> int:
        """Store keywords; `strict=False` skips those that are stored."""
        return self.add_keyword_rows(self._listed(texts, "text"), now, strict)

    def add_keyword_rows(self, rows: DataFrame, now: datetime, strict: bool = True) -> int:
        """The same from a frame of any size: _n (order), text."""
        return self._add_rows("keywords", "text", rows, {"created_at": F.lit(now).cast("timestamp_ntz")}, strict)

    def add_domains(self, *domains: str, strict: bool = True) -> int:
        """Store trusted domains, in small letters."""
        return self.add_domain_rows(self._listed(domains, "domain"), strict)

    def add_domain_rows(self, rows: DataFrame, strict: bool = True) -> int:
        """The same from a frame of any size: _n (order), domain."""
        return self._add_rows("whitelist_domains", "domain", rows.withColumn("domain", F.lower("domain")), {"is_active": F.lit(True)}, strict)

    def delete_keyword(self, id_: int) -> bool:
        """Whether there was such a keyword; the others become a new part."""

        def build(state: dict[str, Any]) -> tuple[dict[str, Any] | None, bool]:
            rows = self.read("keywords", state)
            if rows.filter(F.col("id") == id_).isEmpty():
                return None, False
            self._add(state, "keywords", rows.filter(F.col("id") != id_), sum(p["rows"] for p in state["tables"]["keywords"]) - 1, replace=True)
            return state, True

        return self.log.commit(EMPTY, build)

    def compact(self, table: str, small: int = SMALL) -> int:
        """Write a table's small parts as one; gives how many they were."""

        def build(state: dict[str, Any]) -> tuple[dict[str, Any] | None, int]:
            parts = state["tables"].get(table, [])
            few = [p for p in parts if p["rows"] < small]
            if len(few) < 2:
                return None, 0
            rows = self.read(table, {"tables": {table: few}})
            state["tables"][table] = [p for p in parts if p not in few]
            self._add(state, table, rows, sum(p["rows"] for p in few))
            return state, len(few)

        return self.log.commit(EMPTY, build)

    def overview(self, as_of: Column | None = None) -> DataFrame:
        """The overview from the kept totals: one row, no data read."""
        t = self.state()["totals"]
        out = self.spark.createDataFrame([(t["articles"], t["cases"], t["alerts"])], "total_articles bigint, total_cases bigint, alert_count bigint")
        return out if as_of is None else out.withColumn("last_updated", as_of)

    def trends(self, days: int, now: datetime) -> DataFrame:
        """The daily trend: whole days from the kept totals, of the first, cut day only its own rows are read."""
        state, since = self.state(), now - timedelta(days=days)
        midnight = datetime(since.year, since.month, since.day)
        cutoff = midnight if since == midnight else midnight + timedelta(days=1)
        whole = [(d, n) for d, n in state["totals"]["days"].items() if d >= cutoff.strftime("%Y-%m-%d")]
        kept = self.spark.createDataFrame(whole, "date string, cases bigint")
        if since == midnight:
            return kept
        first = self.read(CASES, state).filter((F.col("report_date") >= F.lit(since).cast("timestamp_ntz")) & (F.col("report_date") < F.lit(cutoff).cast("timestamp_ntz")))
        return kept.unionByName(stats.trends(first, days, F.lit(now).cast("timestamp_ntz")))

    def keywords(self, limit: int = 100) -> list[str]:
        """Newest first, as a scan takes them."""
        return [r.text for r in self.read("keywords").orderBy(F.desc("id")).limit(limit).collect()]

    def domains(self, limit: int = 100, only_active: bool = False) -> list[str]:
        rows = self.read("whitelist_domains")
        rows = rows.filter("is_active") if only_active else rows
        return [r.domain for r in rows.orderBy("id").limit(limit).collect()]

    def find(self, table: str, key: str, wanted: str | int) -> DataFrame:
        """At most one row with this key."""
        return self.read(table).filter(F.col(key) == F.lit(wanted)).limit(1)

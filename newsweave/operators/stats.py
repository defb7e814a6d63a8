"""Aggregates of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsweave.constants import NO_TREND, TAG_ALERT


def flat_articles(identity: DataFrame, details: DataFrame) -> DataFrame:
    """Articles as clients see them; without details all is null but is_whitelisted, which is false."""
    own = details.select(F.col("article_id").alias("id"), "summary", "source", "keywords_matched", "tags", "is_whitelisted")
    return identity.join(own, "id", "left").withColumn("is_whitelisted", F.coalesce("is_whitelisted", F.lit(False)))


def articles_with_cases(identity: DataFrame, cases: DataFrame) -> DataFrame:
    """Each article with each of its cases; articles without cases have no row. The case's own id is case_id."""
    own = cases.withColumnRenamed("id", "case_id") if "id" in cases.columns else cases
    return identity.join(own, identity["id"] == own["article_id"])


def overview(identity: DataFrame, details: DataFrame, cases: DataFrame, as_of: Column | None = None) -> DataFrame:
    """total_articles, total_cases (0 where there are none), alert_count and, with a reference time, last_updated."""
    articles = identity.agg(F.count("*").alias("total_articles"))
    total = cases.agg(F.coalesce(F.sum("case_count"), F.lit(0)).cast("long").alias("total_cases"))
    alerts = details.filter(F.col("tags").like(f"%{TAG_ALERT}%")).select(F.col("article_id").alias("id"))
    counted = identity.join(alerts, "id").agg(F.count("*").alias("alert_count"))
    # three aggregates of one row each
    out = articles.join(total, F.lit(True)).join(counted, F.lit(True))
    return out if as_of is None else out.withColumn("last_updated", as_of)


def trends(cases: DataFrame, days: int, as_of: Column) -> DataFrame:
    """date, cases by day, from the same time of day `days` days ago; days without cases have no row."""
    recent = cases.filter(F.col("report_date") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.date_format("report_date", "yyyy-MM-dd").alias("date")).agg(F.sum("case_count").cast("long").alias("cases"))


def labelled(trend: DataFrame) -> DataFrame:
    """name (month/day), cases; one row that says so where there is no trend."""
    rows = trend.select(F.date_format(F.to_date("date"), "MM/dd").alias("name"), "cases")
    none = trend.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(NO_TREND).alias("name"), F.lit(0).cast("long").alias("cases"))
    return rows.unionByName(none)


def shares(cases: DataFrame, by: str = "disease_name", value: str = "case_count") -> DataFrame:
    """Each group's total and its whole percentage of all."""
    per = cases.groupBy(by).agg(F.sum(value).cast("long").alias("total"))
    whole = cases.agg(F.sum(value).cast("double").alias("whole"))
    return per.join(F.broadcast(whole), F.lit(True)).select(by, "total", F.round(F.col("total") / F.col("whole") * 100, 0).cast("long").alias("percent"))


def accuracy(found: DataFrame, by: str, relevant: Column) -> DataFrame:
    """Articles, relevant ones and their percentage for each tool."""
    per = found.groupBy(by).agg(F.count("*").alias("articles"), F.count_if(relevant).alias("relevant"))
    return per.withColumn("accuracy", F.round(F.col("relevant") * 100.0 / F.col("articles"), 1))


def lift(measures: DataFrame, base: str, other: str) -> DataFrame:
    """How much larger `other` is than `base`, in percent."""
    return measures.withColumn("lift", F.round((F.col(other) / F.col(base) - 1) * 100, 1))


def monthly(rows: DataFrame, when: str, scope: Column, value: Column, scopes: list[str]) -> DataFrame:
    """month (T1 to T12) with one summed column for each scope."""
    made = rows.select(F.month(when).alias("_m"), scope.alias("_scope"), value.alias("_value"))
    wide = made.groupBy("_m").pivot("_scope", scopes).agg(F.sum("_value"))
    return wide.select(F.concat(F.lit("T"), F.col("_m")).alias("month"), *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in scopes])


def change(trend: DataFrame, back: int = 1) -> DataFrame:
    """The trend with each day's difference from the `back`-th reported day before."""
    # one row a day: the window holds days, not cases
    before = F.lag("cases", back).over(W.orderBy("date"))
    return trend.withColumn("change", F.col("cases") - before)


def spikes(trend: DataFrame, days: int = 7, times: float = 2.0) -> DataFrame:
    """Days whose cases are at least `times` the mean of the `days` reported days before."""
    mean = F.avg("cases").over(W.orderBy("date").rowsBetween(-days, -1))
    return trend.withColumn("usual", mean).withColumn("is_spike", F.coalesce(F.col("cases") >= F.col("usual") * times, F.lit(False)))


def page(rows: DataFrame, *order: Column, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of ordered rows; ties need an order of their own."""
    return rows.orderBy(*order).offset(skip).limit(limit)


def page_after(rows: DataFrame, last: tuple | None, when: str = "published_date", key: str = "id", limit: int = 100) -> DataFrame:
    """The page after the row (when, key) of the one before, newest first; `last` None: the first page.

    No row before it is read again or carried along: the condition goes into the scan, so files and row groups of newer rows are skipped. A null
    time comes last, as the plain page has it; (when, key) must tell rows apart.
    """
    if last is not None:
        at, id_ = last
        older = F.col(when).isNull() & (F.col(key) < id_) if at is None else F.col(when).isNull() | (F.col(when) < F.lit(at).cast("timestamp_ntz")) | ((F.col(when) == F.lit(at).cast("timestamp_ntz")) & (F.col(key) < id_))
        rows = rows.filter(older)
    return rows.orderBy(F.desc_nulls_last(when), F.desc(key)).limit(limit)


def ui_page(rows: DataFrame, *order: Column, number: int = 1, size: int = 10) -> DataFrame:
    return page(rows, *order, skip=(max(1, number) - 1) * size, limit=size)


def feed_health(entries: DataFrame, malformed: str | None = None) -> DataFrame:
    """Entries and malformed records of each feed."""
    bad = F.count_if(F.col(malformed)) if malformed else F.lit(0).cast("long")
    return entries.groupBy("feed_ord").agg(F.count("*").alias("entries"), bad.alias("malformed"))


def first_of_feed(entries: DataFrame, most: int = 3) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("feed_ord").orderBy("entry_ord"))
    return entries.withColumn("nth", nth).filter(F.col("nth") <= most)

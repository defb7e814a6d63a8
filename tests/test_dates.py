"""Free-form dates in many written forms."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsweave.functions import dates

DEFAULT = datetime(2024, 5, 31, 9, 30)
AT = datetime(2024, 3, 5, 3, 7, 9)
FORMS = {
    "Tue, 05 Mar 2024 10:07:09 +0700": AT, "Tue, 05 Mar 2024 03:07:09 GMT": AT, "5 Mar 2024 10:07:09 ICT": AT, "2024-03-05T03:07:09Z": AT, "2024-03-05T10:07:09+07:00": AT, "2024-03-05 03:07:09": AT,
    "20240305T030709Z": AT, "20240305 030709": AT, "2024-03-05T03:07:09.123456Z": AT, "March 5, 2024 3:07:09 AM": AT, "Mar 5th, 2024 at 3:07:09 a.m.": AT, "Tuesday, 5 March 2024 03:07:09": AT,
    "Tue Mar  5 03:07:09 2024": AT, "Tue Mar  5 03:07:09 UTC 2024": AT, "Tue Mar 5 10:07:09 2024 +0700": AT, "03/05/2024 03:07:09": AT, "2024/3/5 3:07:09": AT, "5-Mar-2024 03:07:09": AT, "05-Mar-24 03:07:09": AT,
    "2024 Mar 5 03:07:09": AT, "03:07:09 5 Mar 2024": AT, "Tue, 05 Mar 2024 10:07:09 +0700 (ICT)": AT, "5 MAR 2024 03:07:09": AT, "2024-03-05 10:07:09 +07": AT, "5 March 2024 00:07:09 GMT+3": AT, "Mar. 4, 2024 10:07:09 pm EST": AT,
    "March 5, 2024": datetime(2024, 3, 5), "20240305": datetime(2024, 3, 5), "13/2/2024": datetime(2024, 2, 13), "2/13/2024": datetime(2024, 2, 13), "1 Feb 99": datetime(1999, 2, 1), "29 Feb 2024": datetime(2024, 2, 29),
    "2024-03-05 12 am": datetime(2024, 3, 5), "5 Mar 2024 12:30 PM": datetime(2024, 3, 5, 12, 30), "5 Mar 2024, 23:59 JST": datetime(2024, 3, 5, 14, 59), "5 Mar 2024 10:00 XYZ": datetime(2024, 3, 5, 10), "24-Mar-05": datetime(2005, 3, 24),
    "2024-12-31T23:30:00-01:00": datetime(2025, 1, 1, 0, 30), "Sept 1 2024": datetime(2024, 9, 1), "4 July, 2024 10:15 BST": datetime(2024, 7, 4, 9, 15),
}
BAD = ["", "  ", "no date", "30 Feb 2024", "2024-13-45", "25:00 5 Mar 2024", "5 Mar 2024 13:00 pm", "yesterday at 10:00", "5 Foo 2024", "1/2/3/4", "123456789012345678901234567890", "5 Mar 2024 10:99", "a" * 3000, "Tue", "99999", None]
PARTIAL = {"5 Mar": datetime(2024, 3, 5), "March 2023": datetime(2023, 3, 31), "Feb 2023": datetime(2023, 2, 28), "10:15": datetime(2024, 5, 31, 10, 15), "10 pm": datetime(2024, 5, 31, 22), "2021": datetime(2021, 5, 31), "3/5": datetime(2024, 3, 5), "17": datetime(2024, 5, 17)}
SHORT = {"5 Mar 80": datetime(1980, 3, 5), "5 Mar 70": datetime(2070, 3, 5), "3/5/24": datetime(2024, 3, 5)}  # within fifty years of 2024


def read(spark, texts, default=None):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in frame.select("i", dates.parsed(F.col("t"), default).alias("d")).collect()}
    return dict(zip(texts, (got[i] for i in range(len(texts)))))


def test_written_forms(spark):
    assert read(spark, list(FORMS)) == FORMS


def test_unreadable(spark):
    assert set(read(spark, BAD).values()) == {None}
    assert set(read(spark, BAD, F.lit(DEFAULT).cast("timestamp_ntz")).values()) == {None}


def test_missing_parts(spark):
    assert set(read(spark, list(PARTIAL)).values()) == {None}
    assert read(spark, list(PARTIAL | SHORT), F.lit(DEFAULT).cast("timestamp_ntz")) == PARTIAL | SHORT


@pytest.mark.parametrize("text", ["5 Mar 2024 10:00", "x"])
def test_generated_code_stays_small(spark, text):
    """The expression is compiled, not interpreted for its size."""
    plan = spark.range(3).select(dates.parsed(F.lit(text)).alias("d"), F.col("id"))
    assert plan.count() == 3

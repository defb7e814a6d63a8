"""Column functions for what clients show: badges, grouped numbers, local dates, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels of trusted and hand-approved articles
TRUSTED, MANUAL = "Uy tín", "Thủ công"


def badge(is_whitelisted: Column) -> Column:
    return F.when(F.coalesce(is_whitelisted, F.lit(False)), F.lit(TRUSTED)).otherwise(F.lit(MANUAL))


def grouped(number: Column) -> Column:
    """A whole number with separators between thousands."""
    return F.format_number(number, 0)


def local_date(when: Column) -> Column:
    """Day, month and year without leading zeros."""
    return F.date_format(when, "d/M/yyyy")


def listed(joined: Column) -> Column:
    """The parts of a comma-joined list, trimmed, without empty ones; no parts for null."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def as_json(row: Column) -> Column:
    """JSON with UTC times as `2024-03-05 10:00:00 UTC`."""
    return F.to_json(row, {"timestampFormat": "yyyy-MM-dd HH:mm:ss z", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss 'UTC'"})

"""Column functions on dates; every result is UTC wall-clock time without a zone.

A free-form date is read by what its parts can be: a clock, a zone after it, a month's name, weekdays and filler words, and numbers,
whose places as year, month and day follow from their sizes and order. Everything is built-in expressions; what several of them need is bound
once, so the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.constants import ZONES

from .values import once

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(?i)(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
_WEEKDAY = r"(?i)(?<![a-z])(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])\.?"
_FILLER = r"(?i)(?<![a-z])(?:at|on|of|and|t)(?![a-z])|(?<=\d)(?:st|nd|rd|th)(?![a-z])"
#: hour, minute, second, a or p, a or p of an hour alone
_CLOCK = r"(?i)(?<![\d:.])(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([ap])\.?m\b\.?)?|\s*([ap])\.?m\b\.?)(?![\d:])"
_NO_NAME = r"(?!(?i:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
#: a name right before the sign, sign, hours, minutes
_OFFSET = rf"(?<![\d/.-])({_NO_NAME}[A-Za-z]{{1,5}})?([+-])(\d{{1,2}}):?(\d{{2}})?(?=\s|$|\()"
_ZONE = rf"(?<![A-Za-z]){_NO_NAME}([A-Z]{{1,5}}|z|utc|gmt)(?![A-Za-z])"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})"
READ = "struct<clock:struct<h:int,m:int,s:int,half:string>,zone:int,month:int,before:int,left:string,n:array<string>>"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _zone(tail: Column) -> Column:
    """Minutes east of UTC by what follows the clock; 0 where nothing does or the name is unknown."""
    signed = F.when(_group(tail, _OFFSET, 2) == "+", 1).otherwise(-1) * (_group(tail, _OFFSET, 3).cast("int") * 60 + F.coalesce(_group(tail, _OFFSET, 4), F.lit("0")).cast("int"))
    # a name right before the sign tells what to add to get to it
    offset = F.when(_group(tail, _OFFSET, 1).isNotNull(), -signed).otherwise(signed)
    minutes = {name: int(at[0] + "1") * (int(at[1:3]) * 60 + int(at[4:6])) for name, at in ZONES.items()}
    known = F.create_map(*[F.lit(x) for pair in minutes.items() for x in pair])
    return F.coalesce(F.when(_group(tail, _OFFSET, 3).isNotNull(), offset), F.element_at(known, F.upper(F.regexp_extract(tail, _ZONE, 1))), F.lit(0))


def _parts(text: Column) -> Column:
    """A READ struct of a date's parts."""
    clocked = text.rlike(_CLOCK)
    clock = F.struct(
        _group(text, _CLOCK, 1).cast("int").alias("h"), F.coalesce(_group(text, _CLOCK, 2), F.lit("0")).cast("int").alias("m"), F.coalesce(_group(text, _CLOCK, 3), F.lit("0")).cast("int").alias("s"),
        F.lower(F.coalesce(_group(text, _CLOCK, 4), _group(text, _CLOCK, 5))).alias("half"),
    )
    tail = F.regexp_extract(text, f"{_CLOCK}(.*)$", 6)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, _OFFSET, " "), _ZONE, " "), r"\([A-Za-z ]*\)", " ")
    rest = F.when(clocked, F.concat(F.regexp_extract(text, f"^(.*?){_CLOCK}", 1), F.lit(" "), plain)).otherwise(text)

    def of(rest: Column) -> Column:
        month = F.lower(F.substring(F.regexp_extract(rest, _MONTH, 1), 1, 3))
        number = F.when(month != "", ((F.instr(F.lit(MONTHS), month) + 2) / 3).cast("int"))
        before = F.size(F.regexp_extract_all(F.regexp_extract(rest, rf"^(.*?){_MONTH}", 1), F.lit(r"\d+"), F.lit(0)))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, _MONTH, " "), _WEEKDAY, " "), _FILLER, " ")
        left = F.regexp_replace(bare, r"[\d\s,./;'’-]", "")
        return F.struct(F.when(clocked, clock).alias("clock"), _zone(tail).alias("zone"), number.alias("month"), before.alias("before"), left.alias("left"), F.regexp_extract_all(bare, F.lit(r"\d+"), F.lit(0)).alias("n")).cast(READ)

    return once(rest, of)


def _read(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    full = F.regexp_replace(F.regexp_replace(clean, _COMPACT + r"(\d{2})(?!\d)", "$1-$2-$3 $4:$5:$6"), _COMPACT + r"(?!\d)", "$1-$2-$3 $4:$5")
    return once(full, _parts)


def _places(p: Column) -> Column:
    """Year, month and day as texts; null where a part is missing, no struct where the numbers make no date."""
    a, b, c = (F.get(p["n"], F.lit(i)) for i in range(3))
    size = F.size(p["n"])
    clear = lambda x: (F.length(x) > 2) | (x.cast("int") > 31)
    month = p["month"].cast("string")
    none = F.lit(None).cast("string")
    at = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    first_year = clear(a) | (~clear(b) & (p["before"] == 2))  # two numbers before the name: the year, then the day
    named = F.when(size == 2, F.when(first_year, at(a, month, b)).otherwise(at(b, month, a))).when(size == 1, F.when(clear(a), at(a, month, none)).otherwise(at(none, month, a))).when(size == 0, at(none, month, none))
    whole = F.when((size == 1) & (F.length(a) == 8), at(F.substring(a, 1, 4), F.substring(a, 5, 2), F.substring(a, 7, 2)))
    three = F.when(clear(a), at(a, b, c)).when(a.cast("int") > 12, at(c, b, a)).otherwise(at(c, a, b))
    two = F.when(clear(a), at(a, b, none)).when(clear(b), at(b, a, none)).when(a.cast("int") > 12, at(none, b, a)).otherwise(at(none, a, b))
    one = F.when(F.length(a) == 4, at(a, none, none)).when(F.length(a) <= 2, at(none, none, a))
    bare = F.coalesce(whole, F.when(size == 3, three).when(size == 2, two).when(size == 1, one).when((size == 0) & p["clock"].isNotNull(), at(none, none, none)))
    return F.when((p["left"] == "") & ~F.exists(p["n"], lambda x: ~F.length(x).isin(1, 2, 4, 8)), F.when(p["month"].isNotNull(), named).otherwise(bare))


def _moment(p: Column, place: Column, default: Column | None) -> Column:
    missing = (lambda x: F.lit(None).cast("int")) if default is None else (lambda x: x(default))
    this_year = F.lit(2020) if default is None else F.year(default)
    short = place["y"].cast("int") + F.floor(this_year / 100).cast("int") * 100
    # two digits stand for the year within fifty of this one
    near = F.when(short >= this_year + 50, short - 100).when(short < this_year - 50, short + 100).otherwise(short)
    year = F.coalesce(F.when(F.length(place["y"]) <= 2, near).otherwise(place["y"].cast("int")), missing(F.year))
    month = F.coalesce(place["m"].cast("int"), missing(F.month))
    last = F.dayofmonth(F.last_day(F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")), "yyyy-MM-dd")))
    day = place["d"].cast("int") if default is None else F.coalesce(place["d"].cast("int"), F.least(missing(F.dayofmonth), last))
    hour, half = p["clock"]["h"], p["clock"]["half"]
    hour = F.when(p["clock"].isNull(), 0).when(half.isNull(), hour).when(hour.between(1, 12) | (hour == 0), hour % 12 + F.when(half == "p", 12).otherwise(0))
    local = F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(p["clock"]["m"], F.lit(0)), F.coalesce(p["clock"]["s"], F.lit(0)).cast("decimal(16,6)"))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), p["zone"])


def parsed(text: Column, default: Column | None = None) -> Column:
    """A free-form date; without a zone it is UTC; null where it cannot be read.

    A missing year, month or day is that of `default` (a day past the month's end is its last one), without `default` the date
    is unreadable. Numbers without a month's name are month, day, year unless their sizes say otherwise; two-digit years
    are those nearest to `default` (or 2020). A weekday alone says nothing.
    """
    return once(_read(text), lambda p: once(_places(p), lambda place: F.when(place.isNotNull(), _moment(p, place, default))))


def as_written(text: Column, default: Column | None = None) -> Column:
    """The same in the zone that the text names: what its clock shows."""
    return parsed(text, default) + F.make_dt_interval(F.lit(0), F.lit(0), once(_read(text), lambda p: p["zone"]))


def or_now(published: Column, as_of: Column) -> Column:
    """A missing date counts as now."""
    return F.coalesce(published, as_of)

"""Column functions on links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import once

NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def domain(link: Column) -> Column:
    """Host with port, lower case, every `www.` dropped; empty where there is none."""
    return F.replace(F.lower(F.regexp_extract(F.coalesce(link, F.lit("")), NETLOC, 1)), F.lit("www."), F.lit(""))


def original_link(link: Column) -> Column:
    """The target of a `url=` parameter, else the link."""
    return F.coalesce(F.nullif(F.regexp_extract(link, r"url=(https?://[^&]+)", 1), F.lit("")), link)


def unquoted(link: Column) -> Column:
    """Percent-decoded; plus signs stay, and a link with a stray percent sign stays as it is."""
    return F.when(F.contains(link, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)).otherwise(link)


def trim_url(link: Column) -> Column:
    """Decoded, then without query, fragment and the parameters of the last path segment; scheme in lower case."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(unquoted(x), r"[?#](?s:.*)$", ""), r";[^/]*$", "")
    scheme = lambda x: F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    return once(once(link, bare), lambda x: F.concat(F.lower(scheme(x)), F.substr(x, F.length(scheme(x)) + 1)))


def _payload(link: Column) -> Column:
    """The hexadecimal digits of a news.google.com article link's payload, without its head and tail; null where there is none."""
    code = F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?i:news\.google\.com)(?::[0-9]*)?/(?:[^?#;]*/)?articles/([^/?#;]+)", 1)
    padded = once(code, lambda x: F.rpad(F.regexp_replace(F.translate(x, "-_", "+/"), "=+$", ""), (F.ceil(F.length(x) / 4) * 4).cast("int"), F.lit("=")))
    plain = F.hex(F.try_to_binary(padded, F.lit("base64")))
    return F.regexp_replace(F.regexp_replace(plain, "^081322", ""), "D20100$", "")


def _carried(body: Column) -> Column:
    """The link in a payload: a length of one byte, or two from 128 on, then as many bytes."""
    byte = lambda at: F.conv(F.substring(body, at, 2), 16, 10).cast("int")
    long = byte(1) >= 128
    size = F.when(long, byte(1) - 128 + 128 * byte(3)).otherwise(byte(1))
    return F.decode(F.unhex(F.substr(body, F.when(long, 5).otherwise(3), size * 2)), "ISO-8859-1")


def source_url(link: Column) -> Column:
    """The link inside a news.google.com article link; other links, and those that cannot be read, as they are.

    The payload is base64 (URL alphabet): 08 13 22, a length (one byte, or two from 128 on), the link, D2 01 00.
    """
    inside = lambda x: once(_payload(x), lambda body: F.when(F.length(body) >= 4, F.nullif(_carried(body), F.lit(""))))
    return once(link, lambda x: F.coalesce(inside(x), x))


def resolved(link: Column) -> Column:
    return trim_url(source_url(original_link(link)))

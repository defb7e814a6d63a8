"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind, checked after matching. A match's place follows
from the lengths of what `split` leaves between the matches, in code points. The regular expressions are written
possessively and anchored behind their own run, which changes no match and keeps very long runs linear.

The method then learns from the base spans as seeds. The two words before a seed are a lexical pattern; a pattern
and every identifier-like word (with a digit or an at sign, of any length) or run of digit groups (joined by blanks, dots, hyphens
or brackets) that follows the same two words anywhere are linked; patterns of cards and phones take a run whole, those of the
other kinds take its words. `ROUNDS` times a pattern's confidence becomes the mean score of its instances (seeds of its
kind score 1) and an instance's score the noisy-or of its patterns. `SEEDS` different instances with a score of `SURE` or more,
seeds or found ones, induce a pattern, so what one round finds brings new patterns in the next. Patterns with a confidence of
`SURE` or more in the last round are trusted; their unseen instances are added as spans of the pattern's kind. A pattern's two words
are looked for in the last characters before an identifier, further back where they do not fit there: words of any length make patterns.

Counts and the digest are of base spans. Null and empty texts have no spans (the digest of an empty string); rows
keep their own identity, so null and repeated doc_ids give one row each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, stored

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a literal without which a kind cannot occur
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CANDIDATE = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
_GROUP = r"(?:\([0-9]++\)|[0-9]++)(?![\p{L}\p{N}@])"
GROUPED = rf"(?<!\S){_GROUP}(?:[\x20.-]{{0,3}}+{_GROUP})++"
#: what a candidate is, in its span's kind: a word, a word within a run of groups, a run
WORD, INNER, RUN = -1, -2, -3
GROUPED_KINDS = (2, 3)  # card, phone
ROUNDS, SEEDS, SURE = 3, 3, 0.8
REACHES = (48, 2000)  # characters before a span in which its two words are looked for first and next; then all


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = F.when(F.length(digits) > 0, F.sequence(F.lit(1), n))

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(doubled, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))


def _left(text: Column, start: Column) -> Column:
    """The two words before a place, small letters, digits alike; null where there are not two."""

    def within(near: Column, whole: Column) -> Column:
        # where it is not the whole beginning a word is never cut: what stands before it must be seen
        words = F.regexp_extract(F.when(whole, F.concat(F.lit(" "), near)).otherwise(near), r"\s(\S+\s+\S+)\s*$", 1)
        return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(words), r"\s+", " "), "[0-9]", "0"), F.lit(""))

    last = lambda n: within(text.substr(F.greatest(F.lit(1), start - (n - 1)), F.least(start, F.lit(n))), start < n)
    first, second = REACHES
    return F.coalesce(last(first), F.when(start >= first, last(second)), F.when(start >= second, within(text.substr(F.lit(1), start), F.lit(True))))


SPAN = "array<struct<start:int,kind:int,end:int,value:string,left:string>>"


def _spans(text: Column, found: Column, pieces: Column, kind: int) -> Column:
    """Spans of all matches from the matches and what lies between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["pieces"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("value"), F.lit(None).cast("string").alias("left"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("pieces"), found.alias("found"))
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and `base`: the checked spans of all kinds, by start and kind."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")
    for kind in KINDS:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        out = out.withColumn(f"f_{kind}", found if NEEDS[kind] is None else F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none))
    for i, kind in enumerate(KINDS):
        found, pieces = F.col(f"f_{kind}"), F.split(text, PATTERNS[kind], -1)
        valid = partial(_valid, kind)
        some = F.exists(found, lambda v: valid(v))  # noqa: B023
        spans = F.filter(_spans(text, found, pieces, i), lambda s: valid(s["value"]))  # noqa: B023
        out = out.withColumn(f"s_{kind}", F.when(some, spans).otherwise(F.array().cast(SPAN)))
    every = F.array_sort(F.concat(*[F.col(f"s_{k}") for k in KINDS]))
    return out.select("doc_id", "text", every.alias("base"))


def _with_left(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), _left(text, s["start"]).alias("left")))


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like words, without the punctuation around them, and runs of digit groups that touch no base span."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    spans = _spans(text, found, F.split(text, CANDIDATE, -1), WORD)
    grouped = F.regexp_extract_all(text, F.lit(GROUPED), F.lit(0))
    runs = F.when(F.size(grouped) > 0, _spans(text, grouped, F.split(text, GROUPED, -1), RUN)).otherwise(F.array().cast(SPAN))
    meets = lambda s, others: F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def trim(s: Column) -> Column:
        bare = F.regexp_replace(s["value"], r"^[^\p{L}\p{N}@+]++", "")
        lead = F.length(s["value"]) - F.length(bare)
        core = F.regexp_extract(bare, r"^(.*[\p{L}\p{N}])", 1)
        return F.struct((s["start"] + lead).alias("start"), s["kind"].alias("kind"), (s["start"] + lead + F.length(core)).alias("end"), core.alias("value"), s["left"].alias("left"))

    def placed(s: Column, whole: Column) -> Column:
        kind = F.when(meets(s, whole), F.lit(INNER)).otherwise(s["kind"])
        return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"))

    free = lambda all_: F.filter(all_, lambda s: (F.length(s["value"]) > 0) & ~meets(s, base))
    whole = free(runs)
    words = F.transform(free(F.transform(spans, trim)), lambda s: placed(s, whole))
    return F.when(F.size(found) > 0, F.concat(words, whole)).otherwise(F.array().cast(SPAN))


def _grouped(kind: Column) -> Column:
    """Whether a pattern of this kind takes runs of digit groups whole."""
    return kind.isin(*GROUPED_KINDS)


def _forms(form: Column) -> Column:
    """The values of `_grouped` whose patterns a candidate of this form can follow."""
    return F.when(form == RUN, F.array(F.lit(True))).when(form == INNER, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))


def _bootstrap(rows: DataFrame) -> DataFrame:
    """left, kind of the trusted patterns."""
    seeds = rows.select(F.explode("base").alias("s")).select("s.left", "s.kind", F.lower("s.value").alias("value")).filter("left is not null").distinct()
    loose = rows.select(F.explode("loose").alias("s")).select("s.left", F.lower("s.value").alias("value"), F.col("s.kind").alias("form")).filter("left is not null")
    # a seed stands beside the candidates of both forms
    known = seeds.select("left", "value", F.explode(F.array(F.lit(True), F.lit(False))).alias("grouped"))
    unseen = loose.select("left", "value", F.explode(_forms(F.col("form"))).alias("grouped"))
    edges = cut(known.union(unseen).distinct())
    of = edges.groupBy("left", "grouped").agg(F.count("*").alias("of"))
    fixed = seeds.select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, patterns = fixed, None
    for _ in range(ROUNDS):
        mine = edges.join(scores.withColumn("grouped", _grouped(F.col("kind"))), ["value", "grouped"])
        total = mine.groupBy("left", "kind", "grouped").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= SURE).alias("sure"))
        # instances found before induce patterns like seeds do
        patterns = cut(total.filter(F.col("sure") >= SEEDS).join(of, ["left", "grouped"]).select("left", "kind", "grouped", (F.col("sum") / F.col("of")).alias("conf")))
        reached = edges.join(patterns, ["left", "grouped"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("score"))
        reached = reached.join(fixed.select("value", "kind"), ["value", "kind"], "left_anti")
        scores = cut(fixed.unionByName(reached))
    best = patterns.filter(F.col("conf") >= SURE).groupBy("left").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"))
    return best.select("left", "kind")


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of `docs` (doc_id, text)."""
    text = F.col("text")
    found = base_spans(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", _with_left(text, F.col("base")).alias("base"), _with_left(text, candidates(text, F.col("base"))).alias("loose"))
    rows = stored(found, "pii-spans")
    trusted = _bootstrap(rows)
    hits = rows.select("uid", F.explode("loose").alias("s")).join(trusted.withColumnRenamed("kind", "p_kind"), (F.col("s.left") == F.col("left")) & F.array_contains(_forms(F.col("s.kind")), _grouped(F.col("p_kind"))))
    more = hits.select("uid", F.struct(F.col("s.start").alias("start"), F.col("p_kind").alias("kind"), F.col("s.end").alias("end")).alias("x"))
    more = more.groupBy("uid").agg(F.collect_list("x").alias("more"))
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = rows.select("uid", "doc_id", short.alias("base")).join(more, "uid", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(every).alias("spans"))

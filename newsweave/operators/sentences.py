"""Sentence ends told from abbreviations, learnt from a corpus without labels.

After Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006): a word type that nearly always carries a full stop, is short
and holds inner stops is an abbreviation; words that follow sentence ends far more often than chance begin sentences; words that
follow a number or initial with its stop more often than chance belong to it. All three are log-likelihood ratios of counts, which are plain
aggregates over the corpus; what is learnt is a small `Model` that column expressions apply to any text.

Tokens are runs without white space. A token's type is in small letters, without what is neither letter, digit nor stop around it. Null and
empty texts teach nothing and have no sentences; a model of an empty corpus knows nothing, so every stop ends a sentence.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import strip
from newsweave.functions.values import once
from newsweave.sources.places import kept

# fixed values: thresholds of the published method
ABBREVIATION, COLLOCATION, STARTER, SURE = 0.3, 7.88, 30.0, 0.99
#: longer lists of a model are looked up by hash, in buckets of so many entries on average
LISTED, BUCKET = 1000, 4
#: where a sentence may end: after a mark and closing signs, before white space; what follows belongs to the next one
_END = r"""([.!?…]["'”’»)\]]{0,3}\s+)"""
_MARK = "\x01"
#: white space in the Unicode sense, spelt out: it is looked up faster
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: the last word, looked for from the end
_LAST = r"(?s)^.*(?<!\S)(\S+)\s*$"


@dataclass(frozen=True)
class Model:
    """Word types in small letters: abbreviations without their last stop, `first second` pairs, first words of sentences.

    All that were learnt, best first. Of the corpus only these lists reach the driver; they travel within expressions. An abbreviation is rare among
    types: one of n letters without inner stops has to occur some e^n / 20 times where one token in twenty carries a stop.
    """

    abbreviations: tuple[str, ...] = ()
    collocations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()


def _type(token: Column) -> Column:
    """A token's type, its last stop included."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?…]+$", "")


def _bare(kind: Column) -> Column:
    return F.regexp_replace(kind, r"[.!?…]+$", "")


def _stopped(kind: Column) -> Column:
    """Whether a type carries exactly one stop at its end."""
    return kind.rlike(r"[^.!?…]\.$")


def _is_number(bare: Column) -> Column:
    return bare.rlike(r"^[0-9][0-9.,]*$")


def _is_initial(bare: Column) -> Column:
    return bare.rlike(r"^\p{L}$")


def _among(value: Column, listed: tuple[str, ...]) -> Column:
    if len(listed) <= LISTED:
        return value.isin(list(listed)) if listed else F.lit(False)
    # one literal: no entry holds a tab or a line end
    n = len(listed) // BUCKET
    buckets = ["\t"] * n
    for one in listed:
        buckets[zlib.crc32(one.encode()) % n] += f"{one}\t"
    own = lambda v: F.contains(F.get(F.split(F.lit("\n".join(buckets)), "\n"), (F.crc32(F.encode(v, "UTF-8")) % n).cast("int")), F.concat(F.lit("\t"), v, F.lit("\t")))
    return once(value, own)


def _words(texts: DataFrame, text: str) -> DataFrame:
    """token, n of the distinct tokens of the corpus as they are written: patterns are then matched once a token, not once a place."""
    words = F.split(F.col(text), _SPACE)
    return texts.filter(F.col(text).isNotNull()).select(F.explode(words).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def _marked(texts: DataFrame, text: str) -> DataFrame:
    """token, next, n of the distinct pairs whose first token has a mark that may end a sentence."""
    words = F.filter(F.split(F.col(text), _SPACE), lambda t: t != "")
    marked = lambda t: F.contains(t, F.lit(".")) | F.contains(t, F.lit("!")) | F.contains(t, F.lit("?")) | F.contains(t, F.lit("…"))
    pairs = once(words, lambda w: F.filter(F.transform(w, lambda t, i: F.when(marked(t), F.struct(t.alias("token"), F.get(w, i + 1).alias("next")))), lambda p: p.isNotNull()))
    return texts.filter(F.col(text).isNotNull()).select(F.explode(pairs).alias("p")).groupBy("p.token", "p.next").agg(F.count("*").alias("n"))


def _typed(counted: DataFrame, *more: Column) -> DataFrame:
    """bare, stopped, ended (by a mark that is no single stop) of tokens, with their numbers."""
    kinds = counted.withColumn("kind", _type(F.col("token")))
    own = kinds.select(_bare(F.col("kind")).alias("bare"), _stopped(F.col("kind")).alias("stopped"), F.col("kind").rlike(r"[!?…]$|\.\.$").alias("ended"), "n", *more)
    return own.filter("bare <> ''")


def tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """bare, stopped, ended, n of the distinct tokens of the corpus; n counts how often each occurs."""
    return _typed(_words(texts, text))


def _binary(of: Column, both: Column, rest: Column, total: Column) -> Column:
    """Log-likelihood ratio of a type carrying a stop as the corpus does (`rest` / `total`) against nearly always."""
    chance = rest / total
    null = both * F.ln(chance) + (of - both) * F.ln(1 - chance)
    return -2 * (null - (both * F.ln(F.lit(SURE)) + (of - both) * F.ln(F.lit(1 - SURE))))


def _pairing(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of b following a by chance against its own rate after a."""
    times = lambda n, p: F.when(n == 0, F.lit(0.0)).otherwise(n * F.ln(p))
    p, p1, p2 = b / total, both / a, (b - both) / (total - a)
    rest = total - a - b + both
    one = times(both, p) + times(a - both, 1 - p) + times(b - both, p) + times(rest, 1 - p)
    two = times(both, p1) + times(a - both, 1 - p1) + times(b - both, p2) + times(rest, 1 - p2)
    return -2 * (one - two)


def _total(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))


def abbreviations(corpus: DataFrame) -> DataFrame:
    """bare, with_stop, without_stop, score of the types that are abbreviations. `corpus`: from `tokens`."""
    counts = kept(corpus.groupBy("bare").agg(_total(F.col("stopped")).alias("with_stop"), _total(~F.col("stopped")).alias("without_stop")), "types")
    # one row
    all_ = counts.agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("total"))
    inner = F.length("bare") - F.length(F.replace("bare", F.lit("."), F.lit("")))
    letters = F.length("bare") - inner
    of = F.col("with_stop") + F.col("without_stop")
    ratio = _binary(of.cast("double"), F.col("with_stop").cast("double"), F.col("stops").cast("double"), F.col("total").cast("double"))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("without_stop").cast("double"))
    found = counts.filter(F.col("bare").rlike(r"\p{L}") & (F.col("with_stop") > 0)).join(F.broadcast(all_), F.lit(True))
    return found.withColumn("score", score).filter(F.col("score") >= ABBREVIATION).select("bare", "with_stop", "without_stop", "score")


def _best(found: DataFrame, *columns: str) -> tuple[str, ...]:
    return tuple(" ".join(r[:-1]) for r in found.select(*columns, "score").orderBy(F.desc("score"), *columns).collect())


def learn_abbreviations(texts: DataFrame, text: str = "text") -> Model:
    """A model that knows the corpus's abbreviations only: one pass of counting over it."""
    return Model(_best(abbreviations(tokens(texts, text)), "bare"))


def learn(texts: DataFrame, text: str = "text") -> Model:
    """A model of the corpus: one pass of counting over it for words, one for what follows a mark."""
    corpus = kept(tokens(texts, text).groupBy("bare", "stopped", "ended").agg(F.sum("n").alias("n")), "tokens")
    next_bare = _bare(_type(F.col("next")))
    marked = kept(_typed(_marked(texts, text), next_bare.alias("next_bare")).groupBy("bare", "stopped", "ended", "next_bare").agg(F.sum("n").alias("n")), "marked")
    short = _best(abbreviations(corpus), "bare")
    initial = _is_number(F.col("bare")) | _is_initial(F.col("bare"))
    ends = F.col("ended") | (F.col("stopped") & ~initial & ~_among(F.col("bare"), short))
    counted = corpus.groupBy("bare").agg(F.sum("n").alias("n"))
    totals = corpus.agg(F.sum("n").alias("total"), _total(ends).alias("ends"))
    after = marked.filter(ends & F.col("next_bare").rlike(r"^\p{L}")).groupBy(F.col("next_bare").alias("bare")).agg(F.sum("n").alias("both"))
    scored = after.join(counted, "bare").join(F.broadcast(totals), F.lit(True)).withColumn("score", _pairing(F.col("ends").cast("double"), F.col("n").cast("double"), F.col("both").cast("double"), F.col("total").cast("double")))
    starters = _best(scored.filter((F.col("score") >= STARTER) & (F.col("total") * F.col("both") > F.col("n") * F.col("ends"))), "bare")
    pairs = marked.filter(F.col("stopped") & initial & F.col("next_bare").rlike(r"^\p{L}")).groupBy("bare", "next_bare").agg(F.sum("n").alias("both"))
    first = corpus.filter(F.col("stopped")).groupBy("bare").agg(F.sum("n").alias("a"))
    joined = pairs.join(first, "bare").join(counted.select(F.col("bare").alias("next_bare"), "n"), "next_bare").join(F.broadcast(totals), F.lit(True))
    joined = joined.filter("both > 1").withColumn("score", _pairing(F.col("a").cast("double"), F.col("n").cast("double"), F.col("both").cast("double"), F.col("total").cast("double")))
    pairs = _best(joined.filter((F.col("score") >= COLLOCATION) & (F.col("total") * F.col("both") > F.col("n") * F.col("a"))), "bare", "next_bare")
    return Model(short, pairs, starters)


def _ends(piece: Column, following: Column, model: Model) -> Column:
    """Whether a sentence ends between a piece and the one after it."""
    kind = _type(F.regexp_extract(piece, _LAST, 1))
    first = F.regexp_extract(following, r"^(\S+)", 1)

    def decide(kind: Column, bare: Column) -> Column:
        after = _bare(_type(first))
        lower, upper = first.rlike(r"^[^\p{L}\p{N}]*\p{Ll}"), first.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
        initial = _is_initial(bare)
        known = _among(bare, model.abbreviations)
        begins = upper & _among(after, model.starters)
        pair = (initial | _is_number(bare)) & _among(F.concat_ws(" ", bare, after), model.collocations)
        within = pair | (_is_number(bare) & lower) | ((known | initial) & ~begins)
        return F.when(_stopped(kind), ~within).when(kind.rlike(r"\.\.$|…$"), ~lower).otherwise(True)

    return once(kind, lambda k: decide(k, _bare(k)))


def sentences(text: Column, model: Model) -> Column:
    """The sentences of a text, an array; white space within them stays."""
    pieces = F.split(F.regexp_replace(F.translate(strip(text), _MARK, " "), _END, f"$1{_MARK}"), _MARK)
    joined = lambda p: F.array_join(F.transform(p, lambda x, i: F.when(_ends(x, F.get(p, i + 1), model), F.concat(x, F.lit(_MARK))).otherwise(x)), "")
    whole = F.split(F.regexp_replace(once(pieces, joined), f"{_MARK}$", ""), _MARK)
    return F.filter(F.transform(whole, strip), lambda s: s != "")


def summarised(text: Column, model: Model, most: int = 3) -> Column:
    """The first sentences, joined by single spaces."""
    return F.array_join(F.slice(sentences(text, model), 1, most), " ")

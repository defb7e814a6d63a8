"""Column functions on titles and texts: keyword matching, case counts, tags, truncation."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from newsweave.constants import ALERTS, CASES_AFTER_VERB, CASES_BEFORE_NOUN, EXCLUDED, KEYWORD_SETS, TAG_ALERT, TAG_NEW

#: sentence ends and word tokens; both approximate a trained tokenizer
SENTENCE_END = r"(?<=[.!?])\s+"
TOKEN = r"(?U)\w+|[^\w\s]"


#: more phrases than this are looked for together
MANY = 64


def _has_automaton() -> bool:
    return importlib.util.find_spec("ahocorasick") is not None


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(text, p))


def _automaton(phrases: Sequence[str]) -> Callable[[Column], Column]:
    """A function of small-lettered texts: the numbers of the phrases in them, ascending, found in one pass whatever their number."""
    import ahocorasick

    always = [i for i, p in enumerate(phrases) if not p]
    places: dict[str, list[int]] = {}
    for i, p in enumerate(phrases):
        if p:
            places.setdefault(p, []).append(i)

    @F.pandas_udf(ArrayType(IntegerType()))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for phrase, own in places.items():
            machine.add_word(phrase, own)
        machine.make_automaton()

        def of(text: str | None) -> list[int] | None:
            if text is None:
                return None
            hit = {id(own): own for _, own in machine.iter(text)} if places else {}
            return sorted([*always, *(i for own in hit.values() for i in own)])

        for series in texts:
            yield series.map(of)

    return found


def contains_one_of(text: Column, phrases: Sequence[str]) -> Column:
    """Whether any of the phrases is in a text; many of them are looked for together."""
    if len(phrases) > MANY and _has_automaton():
        return F.size(_automaton(list(phrases))(text)) > 0
    return contains_any(text, literals(phrases))


def matched(title: Column, keywords: Sequence[str]) -> Column:
    """The keywords whose lower-cased form is in the lower-cased title, in list order and as written.

    Up to `MANY` keywords are tested one by one within the generated code; more of them by an automaton over all at once.
    """
    low = F.lower(title)
    if len(keywords) > MANY and _has_automaton():
        return F.transform(_automaton([k.lower() for k in keywords])(low), lambda i: F.element_at(literals(keywords), i + 1))
    return F.filter(literals(keywords), lambda k: F.contains(low, F.lower(k)))


def is_excluded(title: Column, phrases: Sequence[str] = tuple(EXCLUDED)) -> Column:
    return contains_any(F.lower(title), literals(phrases))


def match_keywords(title: Column, keywords: Sequence[str], excluded: Sequence[str] = tuple(EXCLUDED)) -> Column:
    """The matches joined by comma and space; null where an excluded phrase or no keyword is in the title."""
    return F.when(~is_excluded(title, excluded), F.nullif(F.array_join(matched(title, keywords), ", "), F.lit("")))


def primary_disease(matches: Column) -> Column:
    return F.split(matches, ", ")[0]


def case_count(text: Column) -> Column:
    """The first number of cases in a text, 0 where there is none; the first pattern wins wherever it stands."""
    low = F.lower(text)
    one = F.expr("int(null)")
    for pattern, group in ((CASES_BEFORE_NOUN, 1), (CASES_AFTER_VERB, 2)):
        one = F.coalesce(one, F.nullif(F.regexp_extract(low, "(?U)" + pattern, group), F.lit("")).try_cast("int"))
    return F.coalesce(one, F.lit(0))


def tags(title: Column, published: Column, as_of: Column, alerts: Sequence[str] = tuple(ALERTS)) -> Column:
    """New (under five hours old, or in the future) and alert tags, joined; null where there is neither."""
    new = F.when(published > as_of - F.expr("INTERVAL 5 HOURS"), F.lit(TAG_NEW))
    alert = F.when(contains_any(F.lower(title), literals(alerts)), F.lit(TAG_ALERT))
    return F.nullif(F.array_join(F.array_compact(F.array(new, alert)), ", "), F.lit(""))


def truncated(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def summarised(text: Column, sentences: int = 3) -> Column:
    """The first sentences, joined by single spaces."""
    return F.array_join(F.slice(F.split(strip(text), SENTENCE_END), 1, sentences), " ")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def expand_keywords(keywords: Sequence[str]) -> list[str]:
    """Names of keyword sets replaced by their members (repeats kept), other keywords stripped."""
    out: list[str] = []
    for keyword in keywords:
        named = KEYWORD_SETS.get(keyword.strip().lower())
        out += [k.strip() for k in named.split(",")] if named else [keyword.strip()]
    return out


def expanded(keyword: Column) -> Column:
    """The same for a column: an array for each keyword."""
    sets = F.create_map(*[x for name, members in KEYWORD_SETS.items() for x in (F.lit(name), literals([m.strip() for m in members.split(",")]))])
    return F.coalesce(F.element_at(sets, F.lower(strip(keyword))), F.array(strip(keyword)))

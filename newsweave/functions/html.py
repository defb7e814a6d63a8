"""The description of a page: meta tags first, then the first long paragraph. Arrow-batched, on the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import SENTENCE_END, TOKEN

METAS = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"))
LEAST_TOKENS = 10
_SPACE = re.compile(SENTENCE_END)
_TOKEN = re.compile(TOKEN.removeprefix("(?U)"))


class _Page(HTMLParser):
    """Contents of the meta tags and texts of the paragraphs; an open paragraph ends at the next one or with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.metas: dict[tuple[str, str], str] = {}
        self.paragraphs: list[list[str]] = []
        self.inside, self.hidden = False, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            own = {k: v or "" for k, v in attrs}
            for key, value in METAS:
                if own.get(key) == value:
                    self.metas.setdefault((key, value), own.get("content", ""))
        elif tag == "p":
            self.paragraphs.append([])
            self.inside = True
        elif tag in ("script", "style"):
            self.hidden += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.inside = False
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data: str) -> None:
        if self.inside and not self.hidden:
            self.paragraphs[-1].append(data)


def described(html: str | None) -> str | None:
    """A page's description; empty where it has none, null where there is no page."""
    if html is None:
        return None
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        return None
    text = next((page.metas[k].strip() for k in METAS if page.metas.get(k)), "")
    if not text:
        paragraphs = ("".join(p).strip() for p in page.paragraphs)
        text = next((p for p in paragraphs if len(_TOKEN.findall(p)) > LEAST_TOKENS), "")
    return text


def describe(html: str | None) -> str | None:
    """The first three sentences of a page's description."""
    text = described(html)
    return None if text is None else " ".join(_SPACE.split(text)[:3])


@F.pandas_udf(StringType())
def description(html: pd.Series) -> pd.Series:
    return html.map(described, na_action="ignore")


@F.pandas_udf(StringType())
def snippet(html: pd.Series) -> pd.Series:
    return html.map(describe, na_action="ignore")

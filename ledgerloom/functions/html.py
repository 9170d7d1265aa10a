"""Saved pages: their words, their links, and addresses given in tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import url_key

MOST_WORDS = 100_000


class _Page(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


@F.pandas_udf(T.IntegerType())
def page_words(html: pd.Series) -> pd.Series:
    """Words shown on a page, at most ``MOST_WORDS``; none for NULL."""
    return html.map(lambda h: min(MOST_WORDS, len(re.findall(r"\b\w+\b", " ".join(page(h).text)))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _targets(url: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([[urljoin(u or "", x) for x in page(h).links] for u, h in zip(url, html, strict=True)])


def page_links(url: Column | str, html: Column | str) -> Column:
    """Usable addresses that a page links to, made absolute, each once in order."""
    return F.array_distinct(F.array_compact(F.transform(_targets(url, html), url_key)))


# Fixed value: how places are labelled on the saved pages.
PLACE = re.compile(r"City(\w+?)State(\w{2})Zip([\d-]+)Country(\w+)")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("city", "state", "zip", "country")])))
def page_addresses(html: pd.Series) -> pd.Series:
    """Places written on a page as labelled City, State, Zip and Country, blanks between words ignored."""

    def places(h: str | None) -> list[tuple]:
        text = re.sub(r"[\s​]+", "", "".join(page(h).text))
        return [m.groups() for m in PLACE.finditer(text)]

    return html.map(places)

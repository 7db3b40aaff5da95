"""Text and title of HTML."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is dropped, and elements that begin a line.
SILENT = ("script", "style", "noscript")
LINES = ("p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "section")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in LINES:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def html_text(raw: str | None) -> str:
    """Readable text; lines at block elements, at most one blank line in a row, one newline at the end."""
    p = _Text()
    p.feed(raw or "")
    return re.sub(r"\n{3,}", "\n\n", html.unescape("".join(p.out))).strip() + "\n"


@F.pandas_udf(T.StringType())
def html_text_udf(s: pd.Series) -> pd.Series:
    return s.map(html_text)


@F.pandas_udf(T.StringType())
def unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t).strip())


def title_column(raw: F.Column) -> F.Column:
    """The first title element's content with the common entities replaced; null without one (stays in the JVM)."""
    t = F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(raw.rlike(r"(?is)<title[^>]*>.*?</title>"), F.btrim(t))

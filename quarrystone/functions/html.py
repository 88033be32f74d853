"""Web pages: metadata by expressions, readable content by a parser."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quarrystone.session import ship

DROPPED = {"script", "style", "nav", "aside", "footer", "header", "form", "noscript", "svg", "iframe", "button", "template"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "br", "hr", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

ship(__name__)


def _unescaped(c: Column) -> Column:
    for entity, text in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def title(page: Column) -> Column:
    return F.trim(_unescaped(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def description(page: Column) -> Column:
    tag = F.regexp_extract(page, r"""(?is)<meta\b(?=[^>]*\b(?:name|property)\s*=\s*["'](?:og:)?description["'])[^>]*>""", 0)
    return _unescaped(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["'](.*?)["']""", 1))


def domain(url: Column) -> Column:
    """The host, in lower case, without a leading www."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.href: list[str | None] = []
        self.lists: list[str] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in BLOCKS and tag != "br":
            self.out.append("\n\n" if tag not in ("li", "tr") else "\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
        elif tag == "li":
            self.out.append("1. " if self.lists[-1:] == ["ol"] else "- ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "blockquote":
            self.out.append("> ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "a":
            self.href.append(a.get("href"))
            self.out.append("[" if a.get("href") else "")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            to = self.href.pop()
            self.out.append(f"]({to})" if to else "")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in BLOCKS and tag not in ("br", "hr", "li"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def main_part(page: str) -> str:
    """The article or main element where the page has one, else its body."""
    for tag in ("article", "main", "body"):
        m = re.search(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", page)
        if m:
            return m[1]
    return page


def to_markdown(page: str | None) -> str:
    """Readable content as Markdown, without scripts, navigation and the like."""
    p = _Markdown()
    p.feed(main_part(page or ""))
    p.close()
    lines = [x.strip() if not x.startswith("    ") else x.rstrip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(to_markdown)


def clean(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """Adds title, description, domain, content (Markdown) and word_count."""
    text = F.coalesce(F.col(page), F.lit(""))
    rows = pages.withColumn("title", title(text)).withColumn("description", description(text)).withColumn("domain", domain(F.coalesce(F.col(url), F.lit(""))))
    rows = rows.withColumn("content", F.pandas_udf(_clean, "string")(text))
    return rows.withColumn("word_count", F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")))


def plain_text(page: Column) -> Column:
    """The text of the article without tags, by expressions alone."""
    body = F.regexp_extract(page, r"(?is)<article[^>]*>(.*)</article>", 1)
    body = F.when(body == "", page).otherwise(body)
    body = F.regexp_replace(body, r"(?is)<(script|style|nav|aside|footer|header)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(_unescaped(F.regexp_replace(body, r"<[^>]*>", " ")), r"\s+", " "))


def escaped(text: str) -> str:
    return _html.escape(text, quote=True)

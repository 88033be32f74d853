"""Expressions over Markdown and plain text: tokens, references, links, tags and other elements.

All are built-in functions; patterns are Java's. ``\\s`` and ``\\w`` count Unicode where the pattern says ``(?U)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a token is.
TOKEN = r"[a-z0-9]++(?:\.[a-z0-9]++)*+"
# The five families of references.
REFERENCE = (
    r"\b\d{2}\s?\d{2}\s?\d{2}(?:\.\d+)?\b|§\s?[0-9A-Z][0-9A-Z.\-]*"
    r"|\b(?:Part|Item|Section|Note|Sheet)\s+\d+[A-Za-z.\-]*"
    r"|\b[EMAPSGCVF]\d{3}(?:\.\d+)?[A-Z]?\b|\b[XGCS]-\d+\b"
)
MAX_REFERENCES = 10

# Callout types and their aliases.
CALLOUT_ALIASES = {
    "summary": "abstract", "tldr": "abstract", "hint": "tip", "important": "tip", "check": "success", "done": "success", "help": "question", "faq": "question",
    "caution": "warning", "attention": "warning", "fail": "failure", "missing": "failure", "error": "danger", "cite": "quote",
}
# Pattern families for a first sweep over extracted texts.
SWEEPS = {
    "equipment": r"AHU|RTU|EF-|P-[0-9]|CH-|MS-|transformer|switchboard|panelboard|pump|fan",
    "scope": r"OFCI|OFOI|NIC|owner[- ]furnish|by others|by owner|not in contract",
    "testing": r"NETA|special inspection|testing agency|commission|hydrostatic|TAB|ASTM E",
    "placeholder": r"\bXX\b|\bTBD\b|\bTODO\b",
}


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words and dotted ids, then the parts of the dotted ones: a multiset, its order says nothing."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    parts = lambda w: F.flatten(F.transform(F.filter(w, lambda t: F.contains(t, F.lit("."))), lambda t: F.split(t, r"\.")))
    # the matches are bound once: a text is searched once for both
    return F.flatten(F.transform(F.array(whole), lambda w: F.concat(w, parts(w))))


def query_tokens(text: str) -> list[str]:
    """The same for a query, in the driver."""
    out = []
    for t in re.findall(TOKEN, text.lower()):
        out += [t, *t.split(".")] if "." in t else [t]
    return out


def references(text: Column) -> Column:
    """Distinct references in order of appearance, ten at most."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?U)" + REFERENCE), F.lit(0)), lambda r: F.trim(r))), 1, MAX_REFERENCES)


def without_code(text: Column) -> Column:
    """Without fenced code, inline code and comments, whichever begins first."""
    return F.regexp_replace(text, r"(?s)```.*?```|`[^`]*`|<!--.*?-->", "")


def without_noise(text: Column) -> Column:
    """Without comments, then fenced, then inline code: other texts remain where they are nested."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)```.*?```", ""), r"`[^`]*`", "")


def wiki_links(text: Column) -> Column:
    """The insides of [[...]], in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def link_target(link: Column, blocks: bool = True) -> Column:
    """The name in a link: before any display text, heading and (if ``blocks``) block mark."""
    out = F.substring_index(F.substring_index(link, "|", 1), "#", 1)
    return F.trim(F.substring_index(out, "^", 1) if blocks else out)


def link_parts(link: Column) -> Column:
    """Struct (name, heading, block, display) of a link's inside."""
    target = F.substring_index(link, "|", 1)
    display = F.when(F.contains(link, F.lit("|")), F.substring(link, F.char_length(target) + 2, F.char_length(link)))
    name = F.substring_index(target, "#", 1)
    rest = F.when(F.contains(target, F.lit("#")), F.substring(target, F.char_length(name) + 2, F.char_length(target)))
    block = F.when(rest.startswith("^"), F.substring(rest, F.lit(2), F.char_length(rest)))
    return F.struct(F.trim(name).alias("name"), F.when(~rest.startswith("^"), F.trim(rest)).alias("heading"), F.trim(block).alias("block"), F.trim(display).alias("display"))


def embeds(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[\[([^\]]+)\]\]"), F.lit(1))


def inline_tags(text: Column) -> Column:
    """Tags without the #; letters of any language, digits, _, - and /, not beginning with a digit."""
    return F.array_distinct(F.regexp_extract_all(without_code(text), F.lit(r"(?U)(?:^|(?<=\s))#((?=[^\s\d])[\p{L}\d_\-/]+)"), F.lit(1)))


def callouts(text: Column) -> Column:
    """Array of structs (type, fold, title); aliases become their type, an absent title is empty."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^(?:>\s*)+\[!([A-Za-z0-9_-]+)\]([+-]?)[ \t]*(.*)$"), F.lit(0))
    p = r"^(?:>\s*)+\[!([A-Za-z0-9_-]+)\]([+-]?)[ \t]*(.*)$"

    def one(m: Column) -> Column:
        kind = F.lower(F.regexp_extract(m, p, 1))
        named = kind
        for alias, name in CALLOUT_ALIASES.items():
            named = F.when(kind == alias, name).otherwise(named)
        return F.struct(named.alias("type"), F.regexp_extract(m, p, 2).alias("fold"), F.trim(F.regexp_extract(m, p, 3)).alias("title"))

    return F.transform(found, one)


def hidden_comments(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)%%(.*?)%%"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"^\n|\n$", "")))


def tasks(text: Column) -> Column:
    """Array of structs (done, text) of the lines that are check boxes."""
    p = r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[(.)\][ \t]+(.*)$"
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    one = p.removeprefix("(?m)")
    return F.transform(found, lambda m: F.struct((F.regexp_extract(m, one, 1) != " ").alias("done"), F.trim(F.regexp_extract(m, one, 2)).alias("text")))


def headings(text: Column) -> Column:
    """Array of structs (level, title), outside code."""
    p = r"(?m)^(#{1,6})[ \t]+(.*)$"
    found = F.regexp_extract_all(without_code(text), F.lit(p), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.char_length(F.regexp_extract(m, "^#+", 0)).alias("level"), F.trim(F.regexp_replace(m, "^#+", "")).alias("title")))


def register_ids(text: Column) -> Column:
    """Array of structs (prefix, number) of ids such as X-12."""
    p = r"\b([A-Z]{1,3})-(\d{1,9})\b"
    return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(F.substring_index(m, "-", 1).alias("prefix"), F.substring_index(m, "-", -1).cast("long").alias("number")))


def drawing_index(text: Column) -> Column:
    """Array of structs (id, title, date): sheets of a drawing index, wherever they stand in the text."""
    p = r"\b([A-Z]{1,3}-?\d{2,4}(?:\.\d+)?[A-Z]?)[ \t]+(\S.*?)[ \t]+(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})"
    part = lambda m, i: F.regexp_extract(m, p, i)
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(part(m, 1).alias("id"), F.trim(part(m, 2)).alias("title"), part(m, 3).alias("date"))))


def spec_contents(text: Column) -> Column:
    """Array of structs (division, section, title) of the lines of a specification's contents."""
    p = r"(?m)^[ \t]*(?:DIVISION[ \t]+(\d{2})|(\d{2}[ \t]?\d{2}[ \t]?\d{2}(?:\.\d+)?))[ \t:–-]+(\S.*?)[ \t.]*(?:\d+)?[ \t]*$"
    one = p.removeprefix("(?m)")
    none = lambda c: F.when(c != "", c)
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(none(F.regexp_extract(m, one, 1)).alias("division"), none(F.regexp_extract(m, one, 2)).alias("section"), F.regexp_extract(m, one, 3).alias("title"))))


def sweeps(text: Column) -> Column:
    """Struct of match counts by family of ``SWEEPS``, in any case."""
    return F.struct(*[F.regexp_count(text, F.lit("(?i)" + p)).alias(name) for name, p in SWEEPS.items()])


def squeezed(text: Column, chars: int = 600) -> Column:
    """On one line, cut after ``chars`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) > chars, F.concat(F.left(flat, F.lit(chars)), F.lit("…"))).otherwise(flat)

"""Text templates over structured data: ``{{ value | filter:"argument" }}``, ``{% if %}``, ``{% for %}``.

A template is parsed once; ``render`` fills it per row in Python, on the executors. ``batch``
gives file names and texts for all rows, and refuses names that repeat or exist.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quarrystone.session import ship

MARK = re.compile(r"(?s)\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}\n?")
LITERAL = re.compile(r'\s*("(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|-?\d+(?:\.\d+)?|true|false|null|[\w.\[\]-]+)\s*')
TESTS = re.compile(r"\s*(==|!=|>=|<=|>|<)\s*")

ship(__name__)


class TemplateError(ValueError):
    pass


def safe_name(x: object) -> str:
    """Without the characters that file names may not have, white space made single."""
    return re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|#^\[\]]', "", _text(x))).strip().strip(".") or "untitled"


def yaml_property(x: object, name: str = "") -> str:
    """A whole frontmatter property, quoted and indented as it must be."""
    quote = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, str) else json.dumps(v)
    if isinstance(x, list):
        return f"{name}:" + ("".join(f"\n  - {quote(v)}" for v in x) or " []")
    return f"{name}: {quote(x)}" if x is not None else f"{name}:"


def date(x: object, pattern: str = "YYYY-MM-DD") -> str:
    letters = {"YYYY": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "DD": "%d", "dddd": "%A", "ddd": "%a", "HH": "%H", "mm": "%M", "ss": "%S", "YY": "%y"}
    t = x if isinstance(x, (dt.date, dt.datetime)) else dt.datetime.fromisoformat(_text(x))
    return re.sub("|".join(letters), lambda m: t.strftime(letters[m[0]]), pattern)


def _text(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return json.dumps(x, ensure_ascii=False, default=str) if isinstance(x, (dict, list)) else str(x)


FILTERS = {
    "trim": lambda x: _text(x).strip(), "lower": lambda x: _text(x).lower(), "upper": lambda x: _text(x).upper(), "title": lambda x: _text(x).title(), "capitalize": lambda x: _text(x).capitalize(),
    "safe_name": safe_name, "yaml_property": yaml_property, "date": date, "join": lambda x, by=", ": by.join(_text(v) for v in x or []), "split": lambda x, by=",": [p.strip() for p in _text(x).split(by)],
    "replace": lambda x, a="", b="": _text(x).replace(a, b), "default": lambda x, d="": d if x in (None, "", []) else x, "length": lambda x: len(x or ""), "first": lambda x: (x or [None])[0], "last": lambda x: (x or [None])[-1],
    "slice": lambda x, a=0, b=None: (x or "")[int(a) : None if b is None else int(b)], "wikilink": lambda x: f"[[{_text(x)}]]", "link": lambda x, text="": f"[{text or _text(x)}]({_text(x)})",
    "list": lambda x: "\n".join(f"- {_text(v)}" for v in (x if isinstance(x, list) else [x])), "blockquote": lambda x: "\n".join(f"> {line}" for line in _text(x).split("\n")), "json": lambda x: json.dumps(x, ensure_ascii=False, default=str),
}


def _argument(raw: str) -> tuple[str, object]:
    if raw[0] in "\"'":
        return "value", re.sub(r"\\(.)", r"\1", raw[1:-1])
    if raw in ("true", "false", "null"):
        return "value", {"true": True, "false": False, "null": None}[raw]
    if re.fullmatch(r"-?\d+(\.\d+)?", raw):
        return "value", float(raw) if "." in raw else int(raw)
    return "path", raw


def _expression(text: str) -> tuple:
    """(argument, [(filter, arguments)])."""
    m = LITERAL.match(text)
    if not m:
        raise TemplateError(f"a value is expected in {text!r}")
    head, at, filters = _argument(m[1]), m.end(), []
    while at < len(text):
        f = re.compile(r"\|\s*([A-Za-z_]\w*)\s*").match(text, at)
        if not f:
            raise TemplateError(f"unexpected {text[at:].strip()!r}")
        if f[1] not in FILTERS:
            raise TemplateError(f"no filter {f[1]}")
        at, args = f.end(), []
        while at < len(text) and text[at] in ":,":
            a = LITERAL.match(text, at + 1)
            if not a:
                raise TemplateError(f"an argument is expected in {text!r}")
            args.append(_argument(a[1]))
            at = a.end()
        filters.append((f[1], args))
    return head, filters


def parse(template: str) -> list:
    """A list of ('text', s), ('value', expression), ('if', [(condition, body)]), ('for', name, expression, body)."""
    root: list = []
    stack: list[tuple[str, list, object]] = [("", root, None)]
    at = 0
    for m in MARK.finditer(template):
        stack[-1][1].append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("value", _expression(m[1].strip())))
            continue
        word, _, rest = m[2].partition(" ")
        if word == "if":
            branches = [(_condition(rest), [])]
            stack.append(("if", branches[0][1], branches))
        elif word in ("elif", "elseif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            _, _, branches = stack.pop()
            branches.append((_condition(rest) if word != "else" else None, []))
            stack.append(("if", branches[-1][1], branches))
        elif word == "for":
            f = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip())
            if not f:
                raise TemplateError(f"for x in y is expected: {m[2]!r}")
            stack.append(("for", [], (f[1], _expression(f[2].strip()))))
        elif word in ("endif", "endfor"):
            kind, body, what = stack.pop()
            if kind != word[3:]:
                raise TemplateError(f"{word} without {word[3:]}")
            stack[-1][1].append(("if", what) if kind == "if" else ("for", *what, body))
        elif word == "set":
            name, eq, value = rest.partition("=")
            if not eq:
                raise TemplateError("set x = y is expected")
            stack[-1][1].append(("set", name.strip(), _expression(value.strip())))
        else:
            raise TemplateError(f"no tag {word}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    root.append(("text", template[at:]))
    return root


def _condition(text: str) -> list:
    """Alternatives ('or') of lists ('and') of (negated, left, operator, right)."""
    out = []
    for either in re.split(r"\s+or\s+|\|\|", text.strip()):
        row = []
        for part in re.split(r"\s+and\s+|&&", either):
            part = part.strip()
            negated = bool(re.match(r"(not\s+|!(?!=))", part))
            part = re.sub(r"^(not\s+|!(?!=))", "", part)
            sides = TESTS.split(part, 1)
            row.append((negated, _expression(sides[0]), sides[1] if len(sides) > 1 else None, _expression(sides[2]) if len(sides) > 1 else None))
        out.append(row)
    return out


def validate(template: str) -> str | None:
    """What is wrong with a template's syntax, tags or filters; None if nothing is."""
    try:
        parse(template)
    except TemplateError as e:
        return str(e)
    return None


def _lookup(data: dict, path: str) -> object:
    at: object = data
    for part in re.findall(r"[\w-]+", path):
        at = at.get(part) if isinstance(at, dict) else at[int(part)] if isinstance(at, list) and part.isdigit() and int(part) < len(at) else None
    return at


def _value(expression: tuple, data: dict) -> object:
    get = lambda a: a[1] if a[0] == "value" else _lookup(data, a[1])
    head, filters = expression
    x = get(head)
    for name, args in filters:
        x = FILTERS[name](x, *[get(a) for a in args])
    return x


def _holds(condition: list, data: dict) -> bool:
    def one(negated: bool, left: tuple, op: str | None, right: tuple | None) -> bool:
        a = _value(left, data)
        if op is None:
            result = bool(a)
        else:
            b = _value(right, data)
            if isinstance(a, str) != isinstance(b, str) and op not in ("==", "!="):
                a, b = _text(a), _text(b)
            result = {"==": lambda: a == b, "!=": lambda: a != b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b}[op]()
        return result != negated

    return any(all(one(*t) for t in row) for row in condition)


def fill(nodes: list, data: dict) -> str:
    out = []
    for n in nodes:
        if n[0] == "text":
            out.append(n[1])
        elif n[0] == "value":
            out.append(_text(_value(n[1], data)))
        elif n[0] == "set":
            data = data | {n[1]: _value(n[2], data)}
        elif n[0] == "if":
            out.append(next((fill(body, data) for c, body in n[1] if c is None or _holds(c, data)), ""))
        else:
            items = _value(n[2], data) or []
            out += [fill(n[3], data | {n[1]: x, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}) for i, x in enumerate(items)]
    return "".join(out)


def render(template: str, data: dict, **overrides: str) -> str:
    return fill(parse(template), data | overrides)


def rendered(rows: DataFrame, template: str, out: str = "text", json_column: str | None = None) -> DataFrame:
    """Adds ``out``: the template filled with each row's columns, or with the object in ``json_column``."""
    nodes = parse(template)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda s: fill(nodes, json.loads(s)))

    source = F.col(json_column) if json_column else F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    return rows.withColumn(out, F.pandas_udf(run, "string")(source))


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """name, json: a row for each CSV row (values stay strings), JSON array element or JSON file of a folder."""
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        source = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"), F.monotonically_increasing_id().alias("at"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select("path", F.trim(F.col("content").cast("string")).alias("json"))
        lists = files.where(F.col("json").startswith("[")).select(F.explode(F.from_json("json", "array<variant>")).alias("v")).select(F.to_json("v").alias("json"), F.monotonically_increasing_id().alias("at"))
        named = files.where(~F.col("json").startswith("[")).select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.json$", "").alias("name"), "json")
        return named.unionByName(_numbered(lists))
    return _numbered(source)


def _numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    # a batch of files to write is a list for people: its numbers are given in one place
    return rows.select(F.row_number().over(Window.orderBy("at")).cast("string").alias("name"), "json")


def batch(data: DataFrame, template: str, filename: str | None = None, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """file, text for each row of ``read_data``. An error if two rows have one file, a name is a path, or (without ``overwrite``) a file exists."""
    rows = rendered(data, template, "text", "json")
    rows = rendered(rows, filename, "file", "json") if filename else rows.withColumn("file", F.concat("name", F.lit(".md")))
    rows = rows.select("file", "text")
    bad = rows.where(F.col("file").rlike(r"[/\\]") | (F.col("file") == "")).select("file").limit(1).collect()
    if bad:
        raise TemplateError(f"{bad[0]['file']!r} is not a file name")
    twice = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("file").limit(5).collect()
    if twice:
        raise TemplateError("several rows have the file " + ", ".join(r["file"] for r in twice))
    if existing is not None and not overwrite:
        there = rows.join(existing.select("file").distinct(), "file", "left_semi").orderBy("file").limit(5).collect()
        if there:
            raise TemplateError("already there: " + ", ".join(r["file"] for r in there))
    return rows

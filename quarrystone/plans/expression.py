"""The view language's expressions: lexer, parser and a typed compiler to columns.

An expression is parsed to a small tree and compiled against a ``Scope`` of typed columns. Types
are needed before an expression can be chosen (``+`` adds numbers, joins strings and moves
dates), so every node yields a ``Value``: a column with its type.

Rules where the language leaves a choice: equality counts missing values as equal to each other;
an order comparison with a missing value is false; a missing property is null; a string that meets a
number or date is read as one; division by zero is null; ``if`` with branches of two types turns an empty string into null and otherwise
both into strings; a month counts 30 days where a duration is read as a total.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.\d+|\d+|\.\d+)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<op>==|!=|>=|<=|&&|\|\||[-+*/%<>!().,\[\]]))"""
)
REGEX = re.compile(r"\s*/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[\n])+)/([a-z]*)")
UNITS = {
    "y": ("months", 12), "year": ("months", 12), "years": ("months", 12), "M": ("months", 1), "month": ("months", 1), "months": ("months", 1),
    "w": ("micros", 7 * 86400), "week": ("micros", 7 * 86400), "weeks": ("micros", 7 * 86400), "d": ("micros", 86400), "day": ("micros", 86400), "days": ("micros", 86400),
    "h": ("micros", 3600), "hour": ("micros", 3600), "hours": ("micros", 3600), "m": ("micros", 60), "minute": ("micros", 60), "minutes": ("micros", 60),
    "s": ("micros", 1), "second": ("micros", 1), "seconds": ("micros", 1),
}
#: pattern letters of the format method and those of Spark, longest first
FORMATS = [("YYYY", "yyyy"), ("YY", "yy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("MM", "MM"), ("M", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("DD", "dd"), ("D", "d"), ("HH", "HH"), ("H", "H"), ("hh", "hh"), ("h", "h"), ("mm", "mm"), ("m", "m"), ("ss", "ss"), ("s", "s"), ("SSS", "SSS"), ("A", "a"), ("a", "a")]
TOTALS = {"days": 86400e6, "hours": 3600e6, "minutes": 60e6, "seconds": 1e6, "milliseconds": 1e3}
FILE_FIELDS = ["name", "basename", "path", "folder", "ext", "size", "ctime", "mtime", "tags", "links", "backlinks", "embeds", "properties"]


class ExpressionError(ValueError):
    """The expression can't be read, or it asks for what its types don't have."""


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Node:
    kind: str  # number string regexp name member call index unary binary
    value: object = None
    args: tuple = ()


def lex(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while text[at:].strip():
        expects_value = not out or (out[-1][0] == "op" and out[-1][1] not in (")", "]"))
        if expects_value and (m := REGEX.match(text, at)):
            out.append(("regexp", (m[1], m[2])))
        elif m := TOKEN.match(text, at):
            kind = m.lastgroup
            raw = m[kind]
            if kind == "string":
                raw = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), raw[1:-1])
            out.append((kind, float(raw) if kind == "number" else raw))
        else:
            raise ExpressionError(f"unexpected {text[at:].strip()[0]!r} in {text!r}")
        at = m.end()
    return out


class _Parser:
    LEVELS = [["||"], ["&&"], ["==", "!="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/", "%"]]

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, lex(text), 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: object | None = None) -> tuple[str, object]:
        token = self.peek()
        if token[0] == "end" or value is not None and token != ("op", value):
            raise ExpressionError(f"{value or 'more'} expected in {self.text!r}")
        self.at += 1
        return token

    def binary(self, level: int = 0) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in self.LEVELS[level]:
            op = self.take()[1]
            left = Node("binary", op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Node:
        if self.peek() in (("op", "!"), ("op", "-")):
            return Node("unary", self.take()[1], (self.unary(),))
        return self.postfix(self.primary())

    def primary(self) -> Node:
        kind, value = self.take()
        if kind in ("number", "string", "regexp", "name"):
            return Node(kind, value)
        if value == "(":
            inner = self.binary()
            self.take(")")
            return inner
        if value == "[":
            return Node("list", None, tuple(self.arguments("]")))
        raise ExpressionError(f"unexpected {value!r} in {self.text!r}")

    def arguments(self, close: str) -> list[Node]:
        out = []
        while self.peek() != ("op", close):
            out.append(self.binary())
            if self.peek() == ("op", ","):
                self.take()
            elif self.peek() != ("op", close):
                raise ExpressionError(f"{close} expected in {self.text!r}")
        self.take(close)
        return out

    def postfix(self, node: Node) -> Node:
        while True:
            if self.peek() == ("op", "."):
                self.take()
                kind, name = self.take()
                if kind != "name":
                    raise ExpressionError(f"a name is expected after '.' in {self.text!r}")
                node = Node("member", name, (node,))
            elif self.peek() == ("op", "("):
                self.take()
                node = Node("call", None, (node, *self.arguments(")")))
            elif self.peek() == ("op", "["):
                self.take()
                node = Node("index", None, (node, self.binary()))
                self.take("]")
            else:
                return node


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.binary()
    if p.at != len(p.tokens):
        raise ExpressionError(f"unexpected {p.peek()[1]!r} in {text!r}")
    return node


def names_in(node: Node) -> set[str]:
    """Formulas that a tree refers to, as ``formula.x``."""
    own = {f"formula.{node.value}"} if node.kind == "member" and node.args[0] == Node("name", "formula") else set()
    for a in node.args:
        own |= names_in(a)
    return own


# ---------------------------------------------------------------- values


@dataclass
class Value:
    """A column and its type; ``inner`` is a list's element type, ``literal`` a constant's Python value, ``months`` a duration's calendar part.

    ``raw`` is a test that may be null where the column is false: as a filter it means the same, and scans understand it.
    """

    col: Column | None
    type: str
    inner: str = "any"
    literal: object = None
    months: Column | None = None
    fields: dict | None = None
    raw: Column | None = None


@dataclass
class Scope:
    """What names mean: properties, the row's file, formulas (compiled on demand), ``this``, and the anchor for now()."""

    properties: dict[str, Value]
    file: dict[str, Value] = field(default_factory=dict)
    formulas: dict[str, str] = field(default_factory=dict)
    this: Value | None = None
    now: Column | None = None
    local: dict[str, Value] = field(default_factory=dict)
    open_formulas: tuple[str, ...] = ()

    def with_local(self, **values: Value) -> Scope:
        return Scope(self.properties, self.file, self.formulas, self.this, self.now, self.local | values, self.open_formulas)


def type_of(t: T.DataType) -> tuple[str, str]:
    if isinstance(t, T.NumericType):
        return "number", "any"
    if isinstance(t, T.BooleanType):
        return "boolean", "any"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date", "any"
    if isinstance(t, T.ArrayType):
        return "list", type_of(t.elementType)[0]
    if isinstance(t, T.MapType):
        return "object", type_of(t.valueType)[0]
    return "string", "any"


def typed(col: Column, t: T.DataType) -> Value:
    kind, inner = type_of(t)
    if kind == "number":
        col = col.cast("double")
    if kind == "date":
        col = col.cast("timestamp_ntz")
    return Value(col, kind, inner)


NULL = Value(None, "null")


def null_col() -> Column:
    return F.lit(None).cast("string")


def number(x: float) -> Value:
    return Value(F.lit(float(x)), "number", literal=float(x))


def string(x: str) -> Value:
    return Value(F.lit(x), "string", literal=x)


def col(v: Value) -> Column:
    return null_col() if v.col is None else v.col


def filter_of(v: Value) -> Column:
    """``truth`` for a place where null and false are the same."""
    return v.raw if v.raw is not None else v.col if v.type == "boolean" else truth(v)


def truth(v: Value) -> Column:
    if v.type == "null":
        return F.lit(False)
    if v.raw is not None:  # then the column is never null
        return v.col
    c = v.col
    test = {
        "boolean": lambda: c, "number": lambda: c != 0, "string": lambda: c != "", "list": lambda: F.size(c) > 0, "object": lambda: F.size(c) > 0, "duration": lambda: c != 0,
    }.get(v.type, lambda: c.isNotNull())()
    return F.coalesce(test, F.lit(False))


def empty(v: Value) -> Column:
    if v.type == "null":
        return F.lit(True)
    if v.type == "date":
        return F.lit(False)
    c = v.col
    return c.isNull() | {"string": lambda: c == "", "list": lambda: F.size(c) == 0, "object": lambda: F.size(c) == 0}.get(v.type, lambda: F.lit(False))()


def as_number(v: Value) -> Column:
    if v.type == "number":
        return v.col
    if v.type == "boolean":
        return v.col.cast("double")
    if v.type == "date":
        return F.unix_micros(v.col.cast("timestamp")) / 1000.0
    if v.type == "duration":
        return v.col / 1000.0
    return F.trim(col(v)).try_cast("double")


def as_date(v: Value) -> Column:
    return v.col if v.type == "date" else col(v).try_cast("timestamp_ntz")


def text_of(c: Column, kind: str) -> Column:
    if kind == "number":
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    if kind == "date":
        whole = c == F.date_trunc("DAY", c).cast("timestamp_ntz")
        return F.when(whole, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return c.cast("string")


def as_text(v: Value) -> Column:
    if v.type in ("link", "file"):
        return v.fields["display"].col if v.fields.get("display") else v.fields["path"].col
    if v.type == "list":
        return F.array_join(F.transform(v.col, lambda x: text_of(x, v.inner)), ", ")
    if v.type == "duration":
        return (v.col / 1000.0).cast("long").cast("string")
    return text_of(col(v), v.type)


def duration_of(text: str) -> Value | None:
    """'1 day', '2h 30m', '-1M': None where the text is no duration."""
    parts = re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    if not parts or re.sub(r"[+-]?\d+(?:\.\d+)?\s*[A-Za-z]+|[\s,]", "", text) or any(u not in UNITS for _, u in parts):
        return None
    months = sum(float(n) * UNITS[u][1] for n, u in parts if UNITS[u][0] == "months")
    micros = sum(float(n) * UNITS[u][1] * 1e6 for n, u in parts if UNITS[u][0] == "micros")
    return Value(F.lit(micros), "duration", literal=text, months=F.lit(int(months)))


def move(date: Column, d: Value, sign: int) -> Value:
    moved = F.timestamp_add("MONTH", sign * d.months, date) if d.months is not None else date
    return Value(F.timestamp_add("MICROSECOND", (sign * d.col).cast("long"), moved), "date")


def link(path: Value, display: Value | None = None, kind: str = "link") -> Value:
    return Value(as_text(path), kind, fields={"path": Value(as_text(path), "string", literal=path.literal), **({"display": Value(as_text(display), "string")} if display else {})})


def note_name(v: Value) -> Column:
    """The name that a link, file or text stands for, in lower case."""
    c = v.fields["path"].col if v.type in ("link", "file") else as_text(v)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.md$", ""), r"[#|].*$", ""))


# ---------------------------------------------------------------- compiling


def compile_expression(text: str, scope: Scope) -> Value:
    return evaluate(parse(text), scope)


def evaluate(n: Node, s: Scope) -> Value:
    return {"number": lambda: number(n.value), "string": lambda: string(n.value), "regexp": lambda: Value(None, "regexp", literal=n.value), "list": lambda: _list([evaluate(a, s) for a in n.args]), "name": lambda: _name(n.value, s), "member": lambda: _member(n, s), "call": lambda: _call(n, s), "index": lambda: _index(evaluate(n.args[0], s), evaluate(n.args[1], s)), "unary": lambda: _unary(n, s), "binary": lambda: _binary(n, s)}[n.kind]()


def _name(name: str, s: Scope) -> Value:
    if name in s.local:
        return s.local[name]
    if name in ("true", "false"):
        return Value(F.lit(name == "true"), "boolean", literal=name == "true")
    if name == "null":
        return NULL
    if name == "file":
        return Value(s.file["path"].col if "path" in s.file else None, "file", fields={"path": s.file.get("path", NULL), "row": s.file})
    if name == "this" and s.this is not None:
        return s.this
    if name == "note":
        return Value(None, "scope", fields=s.properties)
    if name == "formula":
        return Value(None, "formulas")
    return s.properties.get(name, NULL)


def formula(name: str, s: Scope) -> Value:
    if name not in s.formulas:
        return NULL
    if name in s.open_formulas:
        raise ExpressionError(f"formula {name} refers to itself")
    inner = Scope(s.properties, s.file, s.formulas, s.this, s.now, {}, (*s.open_formulas, name))
    return compile_expression(s.formulas[name], inner)


def _list(values: list[Value]) -> Value:
    kinds = {v.type for v in values}
    if len(kinds) == 1:
        return Value(F.array(*[v.col for v in values]), "list", kinds.pop())
    return Value(F.array(*[as_text(v) for v in values]).cast("array<string>"), "list", "string")


def _index(v: Value, i: Value) -> Value:
    if v.type == "list":
        return Value(F.get(v.col, i.col.cast("int")), v.inner)
    if v.type == "object":
        return Value(F.try_element_at(v.col, as_text(i)), v.inner)
    raise ExpressionError(f"a {v.type} has no elements")


def _unary(n: Node, s: Scope) -> Value:
    v = evaluate(n.args[0], s)
    if n.value == "!":
        return Value(~truth(v), "boolean")
    return Value(-v.col, "duration", months=-v.months if v.months is not None else None) if v.type == "duration" else Value(-as_number(v), "number", literal=-v.literal if isinstance(v.literal, float) else None)


def _binary(n: Node, s: Scope) -> Value:
    op, (a, b) = n.value, (evaluate(x, s) for x in n.args)
    if op == "&&":
        return Value(truth(a) & truth(b), "boolean", raw=filter_of(a) & filter_of(b))
    if op == "||":
        return Value(truth(a) | truth(b), "boolean", raw=filter_of(a) | filter_of(b))
    if op in ("==", "!="):
        x, y = _comparable(a, b)
        same = x.eqNullSafe(y)
        return Value(same if op == "==" else ~same, "boolean")
    if op in ("<", ">", "<=", ">="):
        x, y = _comparable(a, b)
        test = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return Value(F.coalesce(test, F.lit(False)), "boolean", raw=test)
    if op in ("+", "-") and "date" in (a.type, b.type):
        return _date_sum(a, b, op)
    if op in ("+", "-") and a.type == b.type == "duration":
        sign = 1 if op == "+" else -1
        zero = F.lit(0)
        return Value(a.col + sign * b.col, "duration", months=(a.months if a.months is not None else zero) + sign * (b.months if b.months is not None else zero))
    if op == "*" and "duration" in (a.type, b.type):
        d, k = (a, b) if a.type == "duration" else (b, a)
        return Value(d.col * as_number(k), "duration", months=(d.months * as_number(k)).cast("int") if d.months is not None else None)
    if op == "+" and a.type == b.type == "list":
        return Value(F.concat(a.col, b.col), "list", a.inner)
    if op == "+" and not {a.type, b.type} <= {"number", "boolean", "null"}:
        blank = lambda v: F.coalesce(as_text(v), F.lit(""))
        return Value(F.concat(blank(a), blank(b)), "string")
    if "duration" in (a.type, b.type):
        raise ExpressionError("a duration is not a number: take its .days, .hours or another field first")
    x, y = as_number(a), as_number(b)
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}[op](), "number")


def _date_sum(a: Value, b: Value, op: str) -> Value:
    if a.type == b.type == "date":
        if op == "+":
            raise ExpressionError("two dates can't be added")
        return Value(F.timestamp_diff("MICROSECOND", b.col, a.col).cast("double"), "duration")
    date, other = (a, b) if a.type == "date" else (b, a)
    if other.type == "string" and isinstance(other.literal, str) and (d := duration_of(other.literal)):
        return move(date.col, d, 1 if op == "+" else -1)
    if other.type == "duration":
        return move(date.col, other, 1 if op == "+" else -1)
    if op == "-" and a.type == "date" and other.type in ("string", "null"):
        return Value(F.timestamp_diff("MICROSECOND", as_date(b), a.col).cast("double"), "duration")
    if op == "+" and other.type == "string":
        return Value(F.concat(F.coalesce(as_text(a), F.lit("")), F.coalesce(as_text(b), F.lit(""))), "string")
    raise ExpressionError(f"a date and a {other.type} don't add up")


def _comparable(a: Value, b: Value) -> tuple[Column, Column]:
    kinds = {a.type, b.type}
    if "null" in kinds:
        other = a if b.type == "null" else b
        null = F.lit(None) if other.col is None else F.lit(None)
        x = col(other)
        return (x, null) if other is a else (null, x)
    if "date" in kinds:
        return as_date(a), as_date(b)
    if kinds & {"link", "file"}:
        return note_name(a), note_name(b)
    if kinds == {"list"}:
        return a.col, b.col
    if "number" in kinds or "duration" in kinds:
        return as_number(a), as_number(b)
    if kinds == {"boolean"}:
        return a.col, b.col
    return as_text(a), as_text(b)


def _member(n: Node, s: Scope) -> Value:
    name, v = n.value, evaluate(n.args[0], s)
    if v.type == "formulas":
        return formula(name, s)
    if v.type == "scope":
        return v.fields.get(name, NULL)
    if v.type == "null":
        return NULL
    if v.type == "file":
        row = v.fields.get("row")
        if row is not None and name in row:
            return row[name]
        path = col(v.fields["path"])
        base = F.regexp_replace(path, r"^.*/", "")
        parts = {"path": path, "name": base, "basename": F.regexp_replace(base, r"\.[^.]*$", ""), "folder": F.regexp_replace(path, r"/?[^/]*$", ""), "ext": F.regexp_extract(base, r"\.([^.]*)$", 1)}
        return Value(parts[name], "string") if name in parts else NULL
    if v.type == "date" and name in ("year", "month", "day", "hour", "minute", "second"):
        return Value(getattr(F, "dayofmonth" if name == "day" else name)(v.col).cast("double"), "number")
    if v.type == "date" and name == "millisecond":
        return Value(F.date_format(v.col, "SSS").cast("double"), "number")
    if v.type == "duration" and name in TOTALS:
        total = v.col if v.months is None else v.col + v.months * (30 * 86400e6)
        return Value(total / TOTALS[name], "number")
    if name == "length":
        if v.type == "list":
            return Value(F.size(v.col).cast("double"), "number")
        if v.type == "values":
            return Value(F.count(v.col).cast("double"), "number")
        return Value(F.char_length(as_text(v)).cast("double"), "number")
    if v.type == "object":
        return Value(F.try_element_at(v.col, F.lit(name)), v.inner)
    if v.fields and name in v.fields:
        return v.fields[name]
    raise ExpressionError(f"a {v.type} has no field {name}")


def _call(n: Node, s: Scope) -> Value:
    target, args = n.args[0], n.args[1:]
    if target.kind == "name":
        return _function(target.value, args, s)
    if target.kind != "member":
        raise ExpressionError("only functions and methods can be called")
    return _method(evaluate(target.args[0], s), target.value, args, s)


def unify(values: list[Value]) -> tuple[list[Column], str, str]:
    """Columns of one type for the branches of a choice."""
    kinds = {v.type for v in values if v.type != "null"}
    if len(kinds) > 1:  # an empty string beside another type means nothing
        values = [NULL if v.type == "string" and v.literal == "" else v for v in values]
        kinds = {v.type for v in values if v.type != "null"}
    if len(kinds) == 1:
        kind = kinds.pop()
        if kind not in ("link", "file", "image", "icon", "html"):
            inner = next(v.inner for v in values if v.type == kind)
            return [F.lit(None) if v.type == "null" else v.col for v in values], kind, inner
    if not kinds:
        return [null_col() for _ in values], "null", "any"
    return [F.lit(None).cast("string") if v.type == "null" else as_text(v) for v in values], "string", "any"


def _function(name: str, args: tuple, s: Scope) -> Value:
    v = [evaluate(a, s) for a in args]
    if name == "if":
        (yes, no), kind, inner = unify([v[1], v[2] if len(v) > 2 else NULL])
        return NULL if kind == "null" else Value(F.when(truth(v[0]), yes).otherwise(no), kind, inner)
    if name == "date":
        return v[0] if v[0].type == "date" else Value(as_date(v[0]), "date")
    if name == "now":
        return Value(s.now if s.now is not None else F.localtimestamp(), "date")
    if name == "today":
        return Value(F.date_trunc("DAY", s.now if s.now is not None else F.localtimestamp()).cast("timestamp_ntz"), "date")
    if name == "duration":
        if not isinstance(v[0].literal, str) or (d := duration_of(v[0].literal)) is None:
            raise ExpressionError("duration() takes a constant such as '1 day'")
        return d
    if name in ("min", "max"):
        if len(v) == 1:
            return Value(as_number(v[0]), "number")
        return Value((F.least if name == "min" else F.greatest)(*[as_number(x) for x in v]), "number")
    if name == "number":
        return Value(as_number(v[0]), "number")
    if name == "link":
        return link(*v)
    if name == "file":
        return v[0] if v[0].type == "file" else link(v[0], kind="file")
    if name == "list":
        return v[0] if v[0].type == "list" else _list([v[0]])
    if name in ("image", "icon", "html"):
        return Value(as_text(v[0]), name, fields={"path": v[0]})
    if name == "escapeHTML":
        c = as_text(v[0])
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return Value(c, "string")
    raise ExpressionError(f"no function {name}")


def _method(v: Value, name: str, args: tuple, s: Scope) -> Value:
    if name in ("filter", "map", "reduce") and v.type == "list":
        return _lambda(v, name, args, s)
    a = [evaluate(x, s) for x in args]
    if v.type == "values":
        direct = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
        if name in direct:
            return Value(direct[name](as_number(Value(v.col, v.inner))), "number")
        v = Value(F.collect_list(v.col), "list", v.inner)
    if name == "isTruthy":
        return Value(truth(v), "boolean")
    if name == "isType":
        want = a[0].literal
        return Value(F.lit(v.type == want) & (col(v).isNotNull() if v.type != "null" else F.lit(True)), "boolean")
    if name == "toString":
        return Value(as_text(v), "string")
    if name == "isEmpty":
        return Value(empty(v), "boolean")
    methods = {"date": _date_method, "number": _number_method, "list": _list_method, "file": _file_method, "link": _link_method, "object": _object_method, "regexp": _regexp_method, "string": _string_method}.get(v.type)
    if v.type == "null":  # a missing value: what a test says of nothing is false, all else is missing
        return Value(F.lit(False), "boolean") if name.startswith(("contains", "has", "in", "startsWith", "endsWith", "matches", "linksTo")) else NULL
    out = methods(v, name, a) if methods else None
    if out is None:
        raise ExpressionError(f"a {v.type} has no method {name}()")
    return out


def _lambda(v: Value, name: str, args: tuple, s: Scope) -> Value:
    kind: dict = {}
    local = lambda x, i, **more: s.with_local(value=Value(x, v.inner), index=Value(i.cast("double"), "number"), **more)
    if name == "filter":
        return Value(F.filter(v.col, lambda x, i: truth(evaluate(args[0], local(x, i)))), "list", v.inner)
    if name == "map":

        def one(x: Column, i: Column) -> Column:
            r = evaluate(args[0], local(x, i))
            kind["inner"] = r.type
            return col(r)

        return Value(F.transform(v.col, one), "list", kind.get("inner", "any"))
    start = evaluate(args[1], s) if len(args) > 1 else number(0)
    pairs = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def step(acc: Column, p: Column) -> Column:
        r = evaluate(args[0], local(p["x"], p["i"], acc=Value(acc, start.type, start.inner)))
        return as_text(r) if start.type == "string" else as_number(r) if start.type == "number" else r.col

    return Value(F.aggregate(pairs, start.col, step), start.type, start.inner)


def _whole(v: Value) -> Column:
    return as_number(v).cast("int")


def _slice(size: Column, a: list[Value]) -> tuple[Column, Column]:
    """Start (from 0) and length, as slice() of scripts has them."""
    place = lambda c: F.greatest(F.lit(0), F.least(size, F.when(c < 0, size + c).otherwise(c)))
    start = place(_whole(a[0]) if a else F.lit(0))
    end = place(_whole(a[1])) if len(a) > 1 and a[1].type != "null" else size
    return start, F.greatest(F.lit(0), end - start)


def _date_method(v: Value, name: str, a: list[Value]) -> Value | None:
    if name == "date":
        return Value(F.date_trunc("DAY", v.col).cast("timestamp_ntz"), "date")
    if name == "time":
        return Value(F.date_format(v.col, "HH:mm:ss"), "string")
    if name == "format":
        return Value(F.date_format(v.col, spark_format(a[0].literal)), "string")
    if name == "relative":
        return Value(_relative(v.col), "string")
    return None


def spark_format(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == "[" and "]" in pattern[at:]:  # a quoted part
            end = pattern.index("]", at)
            out += "'" + pattern[at + 1 : end].replace("'", "''") + "'"
            at = end + 1
            continue
        for letters, ours in FORMATS:
            if pattern.startswith(letters, at):
                out += ours
                at += len(letters)
                break
        else:
            c = pattern[at]
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            at += 1
    return out


def _relative(c: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", F.localtimestamp(), c)
    size = F.abs(seconds)
    said = F.lit("a few seconds")
    for unit, length, least in (("minute", 60, 45), ("hour", 3600, 2700), ("day", 86400, 79200), ("month", 2592000, 2246400), ("year", 31536000, 27648000)):
        n = F.greatest(F.lit(1), F.round(size / length).cast("int"))
        article = "an" if unit == "hour" else "a"
        said = F.when(size >= least, F.when(n == 1, f"{article} {unit}").otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s")))).otherwise(said)
    return F.when(seconds > 0, F.concat(F.lit("in "), said)).otherwise(F.concat(said, F.lit(" ago")))


def _number_method(v: Value, name: str, a: list[Value]) -> Value | None:
    if name in ("abs", "ceil", "floor"):
        return Value(getattr(F, name)(v.col).cast("double"), "number")
    if name == "round":
        return Value(F.round(v.col, int(a[0].literal) if a else 0), "number")
    if name == "toFixed":
        return Value(F.format_string(f"%.{int(a[0].literal) if a else 0}f", v.col), "string")
    return None


def _all(tests: list[Column], any_: bool = False) -> Value:
    out = F.lit(not any_)
    for t in tests:
        out = (out | t) if any_ else (out & t)
    return Value(F.coalesce(out, F.lit(False)), "boolean")


def _string_method(v: Value, name: str, a: list[Value]) -> Value | None:
    c, t = v.col, [as_text(x) if x.type != "regexp" else None for x in a]
    if name in ("contains", "containsAll", "containsAny"):
        return _all([F.contains(c, x) for x in t], name == "containsAny")
    if name in ("startsWith", "endsWith"):
        return Value(F.coalesce(c.startswith(t[0]) if name == "startsWith" else c.endswith(t[0]), F.lit(False)), "boolean")
    simple: dict[str, Callable] = {"lower": F.lower, "upper": F.upper, "title": F.initcap, "trim": F.trim, "reverse": F.reverse}
    if name in simple:
        return Value(simple[name](c), "string")
    if name == "replace":
        if a[0].type == "regexp":
            return Value(F.regexp_replace(c, java_regex(a[0].literal), a[1].literal if isinstance(a[1].literal, str) else t[1]), "string")
        return Value(F.replace(c, t[0], t[1]), "string")
    if name == "repeat":
        return Value(F.repeat(c, _whole(a[0])), "string")
    if name == "slice":
        start, length = _slice(F.char_length(c), a)
        return Value(F.substring(c, start + 1, length), "string")
    if name == "split":
        pattern = java_regex(a[0].literal) if a[0].type == "regexp" else re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", a[0].literal)
        parts = F.split(c, pattern)
        return Value(F.slice(parts, F.lit(1), _whole(a[1])) if len(a) > 1 else parts, "list", "string")
    return None


def _element(v: Value, x: Value) -> Column:
    return {"number": as_number, "date": as_date, "string": as_text}.get(v.inner, col)(x)


def _list_method(v: Value, name: str, a: list[Value]) -> Value | None:
    c = v.col
    if name in ("contains", "containsAll", "containsAny"):
        return _all([F.array_contains(c, _element(v, x)) for x in a], name == "containsAny")
    if name == "join":
        return Value(F.array_join(F.transform(c, lambda x: text_of(x, v.inner)), a[0].literal if a else ","), "string")
    if name == "slice":
        start, length = _slice(F.size(c), a)
        return Value(F.slice(c, start + 1, length), "list", v.inner)
    if name == "flat":
        return Value(F.flatten(c) if v.inner == "list" else c, "list", "any" if v.inner == "list" else v.inner)
    simple: dict[str, Callable] = {"reverse": F.reverse, "sort": F.array_sort, "unique": F.array_distinct}
    if name in simple:
        return Value(simple[name](c), "list", v.inner)
    numbers = {"sum": lambda s, n: s, "mean": lambda s, n: F.try_divide(s, n)}
    if name in numbers:
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
        return Value(numbers[name](total, F.size(c)), "number")
    if name in ("min", "max"):
        return Value((F.array_min if name == "min" else F.array_max)(c), v.inner)
    return None


def _row(v: Value, name: str) -> Value:
    return (v.fields.get("row") or {}).get(name, NULL)


def _file_method(v: Value, name: str, a: list[Value]) -> Value | None:
    if name == "asLink":
        return link(v.fields["path"], a[0] if a else None)
    if name == "hasLink":
        links = _row(v, "links")
        return Value(F.lit(False), "boolean") if links.type == "null" else Value(F.coalesce(F.exists(links.col, lambda x: note_name(Value(x, "string")) == note_name(a[0])), F.lit(False)), "boolean")
    if name == "hasTag":
        tags = _row(v, "tags")
        if tags.type == "null":
            return Value(F.lit(False), "boolean")
        want = [F.lower(F.regexp_replace(as_text(x), "^#", "")) for x in a]
        # a tag holds those nested in it
        hit = lambda t, w: (F.lower(t) == w) | F.startswith(F.lower(t), F.concat(w, F.lit("/")))
        has = lambda w: F.exists(tags.col, lambda t: hit(t, w))
        return _all([has(w) for w in want], any_=True)
    if name == "hasProperty":
        props = _row(v, "properties")
        return Value(F.lit(False), "boolean") if props.type == "null" else Value(F.coalesce(F.map_contains_key(props.col, as_text(a[0])), F.lit(False)), "boolean")
    if name == "inFolder":
        folder, want = col(_row(v, "folder")), F.regexp_replace(as_text(a[0]), "/$", "")
        return Value(F.coalesce((folder == want) | F.startswith(folder, F.concat(want, F.lit("/"))), F.lit(False)), "boolean")
    return None


def _link_method(v: Value, name: str, a: list[Value]) -> Value | None:
    if name == "asFile":
        return Value(v.col, "file", fields={"path": v.fields["path"]})
    if name == "linksTo":
        return Value(note_name(v) == note_name(a[0]), "boolean")
    return None


def _object_method(v: Value, name: str, a: list[Value]) -> Value | None:
    if name == "keys":
        return Value(F.map_keys(v.col), "list", "string")
    if name == "values":
        return Value(F.map_values(v.col), "list", v.inner)
    return None


def java_regex(literal: tuple[str, str]) -> str:
    body, flags = literal
    inline = "".join(f for f in flags if f in "ims")
    return f"(?{inline}){body}" if inline else body


def _regexp_method(v: Value, name: str, a: list[Value]) -> Value | None:
    return Value(F.coalesce(as_text(a[0]).rlike(java_regex(v.literal)), F.lit(False)), "boolean") if name == "matches" else None

"""Chat formatting by a finite-state machine over roles (native).

A ``ChatTemplate`` declares, per role, the marks before and after a text,
whether the text is trained on (loss), and the roles that may follow. From it
are derived the transitions, the escaping of control strings and the pattern
that reads a formatted conversation back.

``segments`` emits one row per text segment with its loss flag and the verdict
of the state machine; ``format_conversations`` puts a conversation together;
``read_back`` recovers roles and texts from the formatted string alone.

Escaping: a backslash becomes two, and after the first character of every
control string in a text ``\\.`` is put in. So no control string is left in a
text, and the inverse reads each backslash pair once from the left.

Defined cases: a null text is the empty text, a null role the empty role; roles
without an entry in the template get the generic marks with their name and
are invalid to the state machine; turns are ordered by turn (nulls first), then
role, then text, so ties have one order and repeated rows stay; a row with a null conv_id belongs
to no other and is a conversation of its own; an empty table gives an empty result. The texts of
one conversation meet in one task when they are put together, since they form
one string; validation itself needs the previous turn only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import text_or_empty


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False
    #: roles that may come next; None: the conversation may end here
    then: tuple[str | None, ...] = ()


@dataclass(frozen=True)
class ChatTemplate:
    roles: dict[str, Role]
    #: roles that may open a conversation
    start: tuple[str, ...]
    #: marks of roles without an entry: before + role + middle + text + after
    generic: tuple[str, str, str] = ("<|turn:", "|>", "<|end|>")
    #: further strings that mean something to the reader of the format
    more_controls: tuple[str, ...] = field(default=("<s>",))

    def controls(self) -> list[str]:
        marks = [m.strip() for r in self.roles.values() for m in (r.before, r.after)] + [m for m in self.generic] + list(self.more_controls)
        return sorted({m for m in marks if len(m) > 1}, key=lambda m: (-len(m), m))


DEFAULT = ChatTemplate(
    roles={
        "system": Role("<<SYS>> ", " <</SYS>>", then=("user",)),
        "user": Role("[INST] ", " [/INST]", then=("assistant",)),
        "assistant": Role("<|answer|> ", " </s>", loss=True, then=("user", None)),
    },
    start=("system", "user"),
)


def _quoted(s: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/<>-])", r"\\\1", s)


def escape(text: Column, template: ChatTemplate) -> Column:
    by_first: dict[str, list[str]] = {}
    for c in template.controls():
        by_first.setdefault(c[0], []).append(c[1:])
    pattern = "|".join(f"{_quoted(k)}(?={'|'.join(map(_quoted, v))})" for k, v in sorted(by_first.items()))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({pattern})", r"$1\\.")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\\.", "$1")


def _choose(role: Column, template: ChatTemplate, of, otherwise: Column) -> Column:
    out = otherwise
    for name, r in template.roles.items():
        out = F.when(role == name, of(r)).otherwise(out)
    return out


def _clean(df: DataFrame) -> DataFrame:
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    return df.select("conv_id", alone.alias("alone"), "turn", text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"))


def validated(df: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, alone (tells rows without a conv_id apart), turn, role, text, n, ok: whether the machine allows each turn where it stands (and, for the last, to end there)."""
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    rows = _clean(df).withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("role").over(order)).withColumn("after", F.lead("role").over(order))
    allowed = _choose(F.col("before"), template, lambda r: F.col("role").isin([x for x in r.then if x is not None]), F.lit(False))
    may_end = _choose(F.col("role"), template, lambda r: F.lit(None in r.then), F.lit(False))
    ok = F.when(F.col("before").isNull(), F.col("role").isin(list(template.start))).otherwise(allowed) & (F.col("after").isNotNull() | may_end)
    return rows.select("conv_id", "alone", "turn", "role", "text", "n", ok.alias("ok"))


def _parts(template: ChatTemplate) -> Column:
    """Of one turn: its segments, in order, as structs (text, loss)."""
    role, text = F.col("role"), F.col("text")
    a, b, c = template.generic
    before = _choose(role, template, lambda r: F.lit(r.before), F.concat(F.lit(a), escape(role, template), F.lit(b)))
    after = _choose(role, template, lambda r: F.lit(r.after), F.lit(c))
    loss = _choose(role, template, lambda r: F.lit(r.loss), F.lit(False))
    segment = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
    return F.array(segment(before, F.lit(False)), segment(escape(text, template), loss), segment(after, F.lit(False)))


def segments(df: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, n (turn's place), part (0 mark, 1 text, 2 mark), segment, loss, ok; no text is held beyond its row."""
    rows = validated(df, template).select("conv_id", "n", "ok", F.posexplode(_parts(template)).alias("part", "s"))
    return rows.select("conv_id", "n", "part", F.col("s.text").alias("segment"), F.col("s.loss").alias("loss"), "ok")


def format_conversations(df: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss), valid, first_error (place of the first refused turn)."""
    rows = validated(df, template).select("conv_id", "alone", "n", "ok", _parts(template).alias("parts"))
    whole = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("n", "parts"))).alias("turns"), F.min(F.when(~F.col("ok"), F.col("n"))).alias("first_error"))
    whole = whole.withColumn("segments", F.flatten(F.col("turns.parts")))
    return whole.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", F.col("first_error").isNull().alias("valid"), "first_error")


def read_back(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """Array of structs (role, text), parsed from the formatted string alone."""
    a, b, c = template.generic
    kinds = [(name, r.before, r.after) for name, r in template.roles.items()]
    pattern = "(?s)" + "|".join([f"{_quoted(p)}.*?{_quoted(q)}" for _, p, q in kinds] + [f"{_quoted(a)}.*?{_quoted(b)}.*?{_quoted(c)}"])
    inner = lambda turn, p, q: F.substring(turn, F.lit(len(p) + 1), F.char_length(turn) - len(p) - len(q))

    def turn(t: Column) -> Column:
        rest = F.substring(t, F.lit(len(a) + 1), F.char_length(t) - len(a) - len(c))
        role = F.substring_index(rest, b, 1)
        out = F.struct(unescape(role).alias("role"), unescape(F.substring(rest, F.char_length(role) + len(b) + 1, F.char_length(rest))).alias("text"))
        for name, p, q in reversed(kinds):
            out = F.when(t.startswith(p), F.struct(F.lit(name).alias("role"), unescape(inner(t, p, q)).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def digest(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Digests of what ``read_back`` and the loss flags give for each formatted conversation."""
    turns = read_back(F.col("formatted"), template)
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = formatted.select("conv_id", turns.alias("turns"), trained.alias("trained"), "formatted", "valid", "first_error")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_error",
    )

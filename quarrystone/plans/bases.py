"""Declarative views over any DataFrame: filters, formulas, grouping, order, limit and summaries.

A view definition (YAML) is compiled to one DataFrame plan: global filters and the view's
filters become ``where``, formulas columns, ``limit`` a top-k. Nothing is evaluated
in Python, so a view over a Parquet table prunes its columns and pushes its filters down.

Choices: rows go by the group, then by the view's sort columns (``tie``); summaries cover all
rows that the filters keep, whatever the limit; the standard deviation is that of the population.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.expression import FILE_FIELDS, NULL, ExpressionError, Node, Scope, Value, as_number, col, compile_expression, empty, filter_of, link, names_in, parse, string, truth, typed

SUMMARIES = ["Average", "Min", "Max", "Sum", "Range", "Median", "Stddev", "Earliest", "Latest", "Checked", "Unchecked", "Empty", "Filled", "Unique"]


def scope_of(df: DataFrame, formulas: dict[str, str] | None = None, now: Column | None = None, this: dict | None = None, file: dict[str, str] | None = None) -> Scope:
    """Every column is a property; ``file`` says which columns hold the file's fields (those named ``file_...`` do by default)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    held = file if file is not None else {f: f"file_{f}" for f in FILE_FIELDS if f"file_{f}" in types}
    value = lambda c: typed(F.col(f"`{c}`"), types[c])
    own = None
    if this is not None:
        path = string(this.get("path", ""))
        own = Value(path.col, "scope", fields={"file": link(path, kind="file"), **{k: string(str(v)) for k, v in this.items() if k != "path"}})
    return Scope({c: value(c) for c in types if c not in held.values()}, {f: value(c) for f, c in held.items()}, formulas or {}, own, now)


def condition(spec, scope: Scope, exact: bool = False) -> Column:
    """A filter: a string, or one of and, or, not with a list (or one filter); under ``not`` none of the list may hold.

    The column may be null where the filter does not hold, unless ``exact``.
    """
    if spec is None:
        return F.lit(True)
    if isinstance(spec, str):
        value = compile_expression(spec, scope)
        return truth(value) if exact else filter_of(value)
    if isinstance(spec, bool):
        return F.lit(spec)
    if not isinstance(spec, dict) or len(spec) != 1 or next(iter(spec)) not in ("and", "or", "not"):
        raise ExpressionError(f"a filter is a string or has exactly one of and, or, not: {spec!r}")
    (kind, parts), out = next(iter(spec.items())), None
    for c in (condition(p, scope, exact or kind == "not") for p in (parts if isinstance(parts, list) else [parts])):
        out = c if out is None else (out & c if kind == "and" else out | c)
    out = F.lit(kind != "or") if out is None else out
    return ~out if kind == "not" and parts else out


def property_node(name: str) -> Node:
    """``file.name``, ``formula.x``, ``note.y`` or a plain property, whatever characters it has."""
    head, dot, rest = name.partition(".")
    if dot and head in ("file", "formula", "note"):
        return Node("member", rest, (Node("name", head),))
    return Node("name", name)


@dataclass
class View:
    """One view over one table: ``rows`` is its result, ``summaries`` its summary rows."""

    base: Base
    spec: dict
    df: DataFrame
    scope: Scope

    def value(self, name: str) -> Value:
        from quarrystone.plans.expression import evaluate

        return evaluate(property_node(name), self.scope)

    def kept(self) -> DataFrame:
        return self.df.where(condition(self.base.spec.get("filters"), self.scope) & condition(self.spec.get("filters"), self.scope))

    @property
    def group(self) -> tuple[Value, bool] | None:
        g = self.spec.get("groupBy")
        if not g:
            return None
        name = g if isinstance(g, str) else g["property"]
        return self.value(name), not isinstance(g, str) and str(g.get("direction", "ASC")).upper() == "DESC"

    def label(self, name: str) -> str:
        shown = (self.base.spec.get("properties") or {}).get(name) or {}
        return shown.get("displayName") or name

    def rows(self, tie: list[str] | None = None, display_names: bool = False) -> DataFrame:
        """The view's columns, in its order; sorted by the group and ``tie`` and cut at the limit. A property that is nowhere gives nulls."""
        order = self.spec.get("order") or list(self.df.columns)
        taken: set[str] = set()
        shown = []
        for name in order:
            label = self.label(name) if display_names else name
            label = label if label not in taken and label else name
            taken.add(label)
            v = self.value(name)
            shown.append((col(v)).alias(label))
        kept = self.kept()
        sort = [c for c in (tie or []) if c in self.df.columns]
        keys = [F.col(f"`{c}`") for c in sort]
        if self.group:
            value, down = self.group
            keys = [col(value).desc_nulls_last() if down else col(value).asc_nulls_last(), *keys]
        if keys:
            kept = kept.orderBy(*keys)
        if self.spec.get("limit"):
            kept = kept.limit(int(self.spec["limit"]))
        return kept.select(*shown)

    def summaries(self) -> DataFrame:
        """grp (the group as text; null and total true for all rows), and a column for each summary, named property.summary."""
        wanted = self.spec.get("summaries") or {}
        source = self.kept()
        marked = {f"__v{i}": self.value(name) for i, name in enumerate(wanted)}
        rows = source.select((col(self.group[0]).cast("string") if self.group else F.lit(None).cast("string")).alias("grp"), *[col(v).alias(c) for c, v in marked.items()])
        aggs = []
        for (c, v), (name, summary) in zip(marked.items(), wanted.items(), strict=True):
            for s in summary if isinstance(summary, list) else [summary]:
                aggs.append(self.summary(s, Value(F.col(c), v.type, v.inner)).alias(f"{name}.{s}"))
        aggs = aggs or [F.count(F.lit(1)).alias("n")]
        if not self.group:
            return rows.agg(*aggs).select(F.lit(None).cast("string").alias("grp"), F.lit(True).alias("total"), "*")
        out = rows.groupingSets([["grp"], []], "grp").agg(F.grouping("grp").alias("__g"), *aggs)
        return out.select("grp", (F.col("__g") == 1).alias("total"), *[F.col(f"`{c}`") for c in out.columns if c not in ("grp", "__g")])

    def summary(self, name: str, v: Value) -> Column:
        custom = (self.base.spec.get("summaries") or {}).get(name)
        if custom:
            return col(compile_expression(custom, self.scope.with_local(values=Value(v.col, "values", v.type))))
        if v.type == "null":
            return F.lit(None).cast("double")
        n, blank = as_number(v) if v.type != "date" else v.col, empty(v) if v.type != "date" else v.col.isNull()
        if name == "Range":
            return F.timestamp_diff("SECOND", F.min(n), F.max(n)) / 86400.0 if v.type == "date" else F.max(n) - F.min(n)
        direct = {
            "Average": lambda: F.avg(n), "Min": lambda: F.min(n), "Max": lambda: F.max(n), "Sum": lambda: F.sum(n), "Median": lambda: F.median(n), "Stddev": lambda: F.stddev_pop(n),
            "Earliest": lambda: F.min(v.col), "Latest": lambda: F.max(v.col), "Checked": lambda: F.count_if(truth(v)), "Unchecked": lambda: F.count_if(~truth(v)),
            "Empty": lambda: F.count_if(blank), "Filled": lambda: F.count_if(~blank), "Unique": lambda: F.count_distinct(F.when(~blank, v.col)),
        }
        if name not in direct:
            raise ExpressionError(f"no summary {name}")
        return direct[name]()


@dataclass
class Base:
    """A parsed view definition."""

    spec: dict

    @staticmethod
    def of(text: str | dict) -> Base:
        """Checks the definition: filters, expressions, views; formulas may not be circular."""
        import yaml

        spec = yaml.safe_load(text) if isinstance(text, str) else text
        if not isinstance(spec, dict) or not isinstance(spec.get("views") or [], list):
            raise ExpressionError("a base is a mapping with a list of views")
        base = Base(spec)
        base.formula_order()
        return base

    @property
    def formulas(self) -> dict[str, str]:
        return {k: str(v) for k, v in (self.spec.get("formulas") or {}).items()}

    def formula_order(self) -> list[str]:
        """Formulas, each after those that it refers to."""
        needs = {k: {n.removeprefix("formula.") for n in names_in(parse(v))} & set(self.formulas) for k, v in self.formulas.items()}
        out: list[str] = []
        while len(out) < len(needs):
            ready = [k for k, n in needs.items() if k not in out and n <= set(out)]
            if not ready:
                raise ExpressionError("formulas refer to each other in a circle: " + ", ".join(k for k in needs if k not in out))
            out += ready
        return out

    @property
    def names(self) -> list[str]:
        return [v.get("name") or v.get("type", "") for v in self.spec.get("views") or []]

    def undefined_formulas(self) -> list[str]:
        """Formulas that views or properties name and nothing defines; they show as nulls."""
        named = set(self.spec.get("properties") or {})
        for v in self.spec.get("views") or []:
            named |= {*(v.get("order") or []), *(v.get("summaries") or {})}
        return sorted(n for n in named if n.startswith("formula.") and n.removeprefix("formula.") not in self.formulas)

    def view(self, df: DataFrame, name: str | int = 0, now: Column | None = None, this: dict | None = None, file: dict[str, str] | None = None) -> View:
        """The view of that name or place over the rows of ``df``."""
        views = self.spec.get("views") or [{}]
        spec = views[name] if isinstance(name, int) else next((v for v in views if v.get("name") == name), None)
        if spec is None:
            raise ExpressionError(f"no view {name!r}; views: {', '.join(self.names)}")
        return View(self, spec, df, scope_of(df, self.formulas, now, this, file))


def notes_table(notes: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Notes as a table for views: the file's fields (file_...) and a column for each property.

    Properties come from the frontmatter: ``types`` gives their Spark types, or ``property_types`` finds them.
    ``file_tags`` joins the frontmatter's tags and those in the text, ``file_backlinks`` the names of notes that link here.
    """
    from quarrystone.functions.text import embeds, inline_tags, link_target, wiki_links
    from quarrystone.operators.links import aliases_of, edges, links_of, names_of, resolved, targets
    from quarrystone.sources.notes import with_properties

    graph = edges(resolved(links_of(notes), targets(names_of(notes), aliases_of(notes))))
    back = graph.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("file_backlinks"))
    rows = with_properties(notes.drop("readable"))
    types = property_types(rows) if types is None else types
    none = F.array().cast("array<string>")
    front_tags = F.coalesce(F.try_element_at("props", F.lit("tags")), none)
    rows = rows.join(back, "path", "left")
    out = {
        "file_name": F.concat("name", F.lit(".md")), "file_basename": F.col("name"), "file_path": F.col("path"), "file_folder": F.col("folder"), "file_ext": F.lit("md"), "file_size": F.col("size"),
        "file_ctime": F.col("mtime"), "file_mtime": F.col("mtime"), "file_tags": F.array_distinct(F.concat(F.transform(front_tags, lambda t: F.regexp_replace(t, "^#", "")), inline_tags(F.coalesce("body", F.lit(""))))),
        "file_links": F.array_distinct(F.transform(wiki_links(F.coalesce("text", F.lit(""))), lambda x: link_target(x))), "file_backlinks": F.coalesce("file_backlinks", none), "file_embeds": embeds(F.coalesce("text", F.lit(""))), "file_properties": F.col("props"),
    }
    props = []
    for name, kind in types.items():
        values = F.try_element_at("props", F.lit(name))
        first = F.get(values, 0)
        c = values if kind.startswith("array") else first.try_cast("timestamp_ntz") if kind in ("date", "timestamp", "timestamp_ntz") else first.try_cast(kind)
        props.append(c.alias(name))
    return rows.select(*[c.alias(n) for n, c in out.items()], *props)


def property_types(rows: DataFrame) -> dict[str, str]:
    """A Spark type for each property name: list, number, boolean, date or text, by what all its values are. Names are as many as the notes' authors use."""
    each = rows.select(F.explode("props").alias("name", "values"))
    first = F.get("values", 0)
    # an inline list of one value and a scalar look the same here; longer lists tell
    found = each.groupBy("name").agg(
        F.max(F.size("values")).alias("most"), F.bool_and(first.try_cast("double").isNotNull()).alias("number"), F.bool_and(F.lower(first).isin("true", "false")).alias("boolean"),
        F.bool_and(first.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$")).alias("date"),
    ).collect()
    lists = {"tags", "aliases", "cssclasses", "systems", "spaces", "source"}
    return {r["name"]: "array<string>" if r["most"] > 1 or r["name"] in lists else "double" if r["number"] else "boolean" if r["boolean"] else "timestamp_ntz" if r["date"] else "string" for r in sorted(found, key=lambda r: r["name"])}


__all__ = ["NULL", "SUMMARIES", "Base", "View", "condition", "notes_table", "property_types", "scope_of"]

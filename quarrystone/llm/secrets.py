"""Secret scan with multipart credential linking (native).

*Base spans* are found in every text by three patterns: assignments to a
password-like name, access identifiers and long hexadecimal runs.

*Weak parts* are account names, bare 40-character keys and endpoints. Alone they
say nothing. Each is an interval of the text; it is reported when a
complementary part lies within ``reach`` code points of it in the same scope
(scopes end at blank lines):

* a bare ``key`` needs an access identifier or an ``ident``;
* an ``ident`` or an endpoint needs a secret: assign, hex or a key that is itself linked.

So what links a part is always reported with it. Weak parts that overlap a base span are
dropped before anything is linked. Intervals are joined by windows over the parts sorted by
place, once upwards and once downwards: what matters is the nearest complementary part
on either side, and every frame is a running one, so after the sort the work is linear in the
parts and no pairs are made.

Positions count code points, ends exclusive. A pattern's matches come from
``regexp_extract_all`` and the gaps between them from ``split``; a running sum of
both lengths gives the places. ``report`` shuffles only lengths, never texts; ``redact`` shuffles
the rows whose texts hold a part of any kind, with their columns, and passes all others through.

Defined cases: a null or empty text has no spans; a base match that is too
short is dropped but has used up its characters; repeated rows and null ids each
keep a row of their own; other columns are ignored, or carried where named.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?:[Cc]lient_?[Ii]d|[Uu]ser(?:_?name)?|[Ll]ogin|[Aa]ccount)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
#: a key may follow its name and '=' directly, as in env files; behind it '=' would be base64 padding
KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+|(?:[Hh]ost|[Ee]ndpoint|[Ss]erver)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
BREAK = r"\n[\x20\t\r]*\n"

#: in the order in which spans at the same place are listed
KINDS = ["assign", "access", "hex", "ident", "key", "endpoint", "break"]
BASE = 3
REACH = 300
MARK = "[REDACTED]"


def _may_hold(t: Column, kind: str) -> Column:
    """False only where plain characters that every match has are lacking: cheaper than the pattern."""
    if kind in ("assign", "ident", "endpoint"):
        return F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))
    return F.contains(t, F.lit({"access": "AKIA", "break": "\n"}.get(kind, "")))


def _pieces(t: Column, kind: str, pattern: str, keep=None) -> Column:
    """Array of structs (kind, n, gap, size, ok): the n-th match, the code points before it since the last, and whether it counts."""
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    oks = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda v: F.char_length(v) >= 8) if keep == "value" else F.transform(whole, lambda m: F.lit(True) if keep is None else keep(m))
    rows = F.transform(
        F.arrays_zip(whole.alias("m"), oks.alias("ok"), F.split(t, pattern, -1).alias("gap")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("n"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["m"]).alias("size"), x["ok"].alias("ok")),
    )
    # the piece after the last match pairs with no match
    return F.when(_may_hold(t, kind) & t.rlike(pattern), F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,n:int,gap:int,size:int,ok:boolean>>"))


def _parts(t: Column) -> Column:
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return F.concat(
        _pieces(t, "assign", ASSIGN, "value"),
        _pieces(t, "access", ACCESS, lambda m: F.char_length(m) >= 16),
        _pieces(t, "hex", HEX),
        _pieces(t, "ident", IDENT),
        _pieces(t, "key", KEY, mixed),
        _pieces(t, "endpoint", ENDPOINT),
    )


def find(docs: DataFrame, carry: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """doc (a struct of the columns ``carry``) and ``spans``: array of structs (start, kind, end, covered), by start, then kind; covered is how far earlier spans reach."""
    t = text_or_empty(F.col(text))
    none = "struct<kind:int,n:int,gap:int,size:int,ok:boolean>"
    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in carry]).alias("doc"), _parts(t).alias("parts"), t.alias("t"))
    # blank lines matter only where there is a part at all
    parts = parts.withColumn("parts", F.when(F.size("parts") > 0, F.concat("parts", _pieces(F.col("t"), "break", BREAK))).otherwise(F.col("parts")))
    # the first row of each document carries its columns, the others its parts
    rows = parts.select("row", "doc", F.posexplode(F.concat(F.array(F.lit(None).cast(none)), "parts")).alias("at", "p"))
    rows = rows.select("row", F.when(F.col("at") == 0, F.col("doc")).alias("doc"), "p.*")
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.where(F.col("kind").isNull() | F.col("ok"))
    kind = lambda *names: F.col("kind").isin([KINDS.index(x) for x in names])
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("scope", F.coalesce(F.sum(kind("break").cast("int")).over(order), F.lit(0))).where(F.col("kind").isNull() | ~kind("break"))
    # both frames run from the partition's edge to the row: a frame to its far end would be summed up anew for every row
    up = Window.partitionBy("row", "scope").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    reached = lambda *names: F.max(F.when(kind(*names), F.col("end"))).over(up)
    following = lambda *names: F.min(F.when(kind(*names), F.col("start"))).over(down)
    near = lambda *names: F.coalesce(F.col("start") - reached(*names) <= reach, F.lit(False)) | F.coalesce(following(*names) - F.col("end") <= reach, F.lit(False))
    kept = lambda rows, test: rows.withColumn("keep", test).where(F.col("kind").isNull() | F.col("keep"))
    base = kind(*KINDS[:BASE])
    inside = F.coalesce(reached(*KINDS[:BASE]) > F.col("start"), F.lit(False)) | F.coalesce(following(*KINDS[:BASE]) < F.col("end"), F.lit(False))
    rows = kept(rows, base | ~inside)
    rows = kept(rows, ~kind("key") | near("access", "ident"))
    rows = kept(rows, base | kind("key") | near("assign", "hex", "key"))
    rows = rows.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", "covered"))
    return rows.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the base spans, all spans, and the number of linked weak parts."""
    found = find(docs, ["doc_id"])
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select(
        "doc.doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] >= BASE)).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The columns of ``docs``; in texts with spans each stretch of overlapping spans is replaced by ``mark`` and n_chars follows.

    Rows whose texts hold no part of any kind are passed through as they are, unshuffled.
    """
    t = text_or_empty(F.col("text"))
    patterns = {"access": ACCESS, "assign": ASSIGN, "ident": IDENT, "endpoint": ENDPOINT, "hex": HEX, "key": KEY}
    any_part = functools.reduce(operator.or_, [_may_hold(t, kind) & t.rlike(p) for kind, p in patterns.items()])
    found = find(docs.where(any_part), docs.columns)
    text = F.col("doc.text")
    piece = lambda s: F.concat(F.substring(text, s["covered"].cast("int") + 1, F.greatest(s["start"] - s["covered"], F.lit(0)).cast("int")), F.when(s["start"] >= s["covered"], F.lit(mark)).otherwise(F.lit("")))
    reached = F.array_max(F.transform("spans", lambda s: s["end"])).cast("int")
    clean = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(text, reached + 1, F.char_length(text)))
    done = found.withColumn("new", F.when(F.size("spans") > 0, clean).otherwise(text))
    values = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.size("spans") > 0, F.char_length("new").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return docs.where(~any_part).unionByName(done.select(*[v.alias(c) for c, v in values.items()]))

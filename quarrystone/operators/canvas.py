"""Canvas documents: nodes and edges as rows, the eight validation rules, containment and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.reach import reached

NODE = "id:string,type:string,x:bigint,y:bigint,width:bigint,height:bigint,color:string,text:string,file:string,subpath:string,url:string,label:string,background:string,backgroundStyle:string"
EDGE = "id:string,fromNode:string,fromSide:string,fromEnd:string,toNode:string,toSide:string,toEnd:string,color:string,label:string"
SCHEMA = f"struct<nodes:array<struct<{NODE}>>,edges:array<struct<{EDGE}>>>"
# Fixed values of the format.
TYPES, SIDES, ENDS = ["text", "file", "link", "group"], ["top", "right", "bottom", "left"], ["none", "arrow"]
REQUIRED = {"text": "text", "file": "file", "link": "url"}
COLOR = r"^([1-6]|#[0-9A-Fa-f]{3}|#[0-9A-Fa-f]{6})$"
PLACED = ["x", "y", "width", "height"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """canvas (its path), json of each canvas below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.canvas").load(path)
    return raw.select(F.col("path").alias("canvas"), F.col("content").cast("string").alias("json"))


def _parsed(canvases: DataFrame) -> DataFrame:
    # of a text that breaks off the reader would keep what came before: what isn't JSON has no nodes at all
    valid = F.try_parse_json("json")
    return canvases.select("canvas", "json", F.when(valid.isNotNull(), F.from_json("json", SCHEMA, {"mode": "PERMISSIVE"})).alias("c"), valid.alias("v"))


def nodes(canvases: DataFrame) -> DataFrame:
    """canvas, z (0 is the bottom layer) and the node's columns."""
    return _parsed(canvases).select("canvas", F.posexplode("c.nodes").alias("z", "n")).select("canvas", "z", "n.*")


def edges(canvases: DataFrame) -> DataFrame:
    """canvas, n (place) and the edge's columns; ends default to none and arrow."""
    rows = _parsed(canvases).select("canvas", F.posexplode("c.edges").alias("n", "e")).select("canvas", "n", "e.*")
    return rows.withColumn("fromEnd", F.coalesce("fromEnd", F.lit("none"))).withColumn("toEnd", F.coalesce("toEnd", F.lit("arrow")))


def _held(canvases: DataFrame) -> DataFrame:
    """canvas, v (null for what isn't JSON), nodes and edges as arrays, empty where there are none."""
    p = _parsed(canvases)
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    return p.select("canvas", F.col("v").isNotNull().alias("v"), F.coalesce("c.nodes", none(NODE)).alias("nodes"), F.coalesce("c.edges", none(EDGE)).alias("edges"))


def violations(canvases: DataFrame) -> DataFrame:
    """canvas, rule (1 to 8), id, what: everything that breaks a rule; valid canvases have no row.

    Every rule is about one canvas, a row: it is parsed once and checked where it is.
    """

    def row(rule: int, id_: Column, what: Column | str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), id_.cast("string").alias("id"), (F.lit(what) if isinstance(what, str) else what).cast("string").alias("what"))

    def found(of: str, rule: int, when, what) -> Column:
        return F.transform(F.filter(of, lambda x: F.coalesce(when(x), F.lit(False))), lambda x: row(rule, x["id"], what(x)))

    def lacks(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, field in REQUIRED.items():
            out = F.when((x["type"] == kind) & x[field].isNull(), F.lit(field)).otherwise(out)
        for field in ["id", "type", *PLACED]:
            out = F.when(x[field].isNull(), F.lit(field)).otherwise(out)
        return out

    def known(of: str, rule: int, field: str, values: list[str]) -> Column:
        return found(of, rule, lambda x: x[field].isNotNull() & ~x[field].isin(values), lambda x: F.concat(F.lit(f"{field} "), x[field]))

    def dangling(end: str) -> Column:
        # array_except works by hashing: what is left are the names of no node, rarely any
        return found("edges", 2, lambda x: x[end].isNull() | F.array_contains("__gone", x[end]), lambda x: F.lit(f"{end} names no node"))

    color = lambda of: found(of, 7, lambda x: x["color"].isNotNull() & ~x["color"].rlike(COLOR), lambda x: F.concat(F.lit("color "), x["color"]))
    ids = F.array_sort(F.filter(F.concat(F.col("nodes.id"), F.col("edges.id")), lambda x: x.isNotNull()))
    rows = _held(canvases).withColumn("__gone", F.array_except(F.concat(F.col("edges.fromNode"), F.col("edges.toNode")), F.col("nodes.id"))).withColumn("__ids", ids)
    twice = F.array_distinct(F.filter("__ids", lambda x, i: (i > 0) & (x == F.get("__ids", i - 1))))
    parts = [
        F.transform(twice, lambda x: row(1, x, "id is used more than once")), dangling("fromNode"), dangling("toNode"), found("nodes", 3, lambda x: lacks(x).isNotNull(), lambda x: F.concat(lacks(x), F.lit(" is missing"))),
        known("nodes", 4, "type", TYPES), *[known("edges", 5, c, SIDES) for c in ("fromSide", "toSide")], *[known("edges", 6, c, ENDS) for c in ("fromEnd", "toEnd")], color("nodes"), color("edges"),
        F.when(~F.col("v"), F.array(row(8, F.lit(None), "not valid JSON"))).otherwise(F.array().cast("array<struct<rule:int,id:string,what:string>>")),
    ]
    return rows.select("canvas", F.explode(F.flatten(F.array(*parts))).alias("x")).select("canvas", "x.*")


def contained(canvases: DataFrame) -> DataFrame:
    """canvas, grp, id: nodes that lie within a group's bounds; each canvas is searched where it is."""

    def inside(n: Column, g: Column) -> Column:
        within = (n["x"] >= g["x"]) & (n["y"] >= g["y"]) & (n["x"] + n["width"] <= g["x"] + g["width"]) & (n["y"] + n["height"] <= g["y"] + g["height"])
        return (n["id"] != g["id"]) & within

    groups = F.filter("nodes", lambda n: n["type"] == "group")
    pairs = F.transform(groups, lambda g: F.transform(F.filter("nodes", lambda n: inside(n, g)), lambda n: F.struct(g["id"].alias("grp"), n["id"].alias("id"))))
    return _held(canvases).select("canvas", F.explode(F.flatten(pairs)).alias("x")).select("canvas", "x.*")


def reachable(canvases: DataFrame, starts: DataFrame) -> DataFrame:
    """canvas, node, hops: what the start nodes (canvas, node) lead to along the edges; cycles end."""
    return reached(edges(canvases).select("canvas", F.col("fromNode").alias("src"), F.col("toNode").alias("dst")), starts, ["canvas"])

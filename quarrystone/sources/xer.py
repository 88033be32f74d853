"""Schedule exports (XER) as DataFrames.

An export is lines of tab-separated cells: ``%T`` opens a table, ``%F`` names its
fields, ``%R`` is a row, ``ERMHDR`` the header; anything else is skipped. Which table and which
fields a row belongs to follows from the last such lines above it: a running
``last`` over the lines of one file. Any number of files is read at once; each is a
``file``, and all later operators treat it as part of every key.

Bytes are UTF-8 if they are valid UTF-8, else windows-1252, else (where they hold
one of the five bytes that it lacks) latin-1.

Defined cases: a short row is padded with empty cells, surplus cells are dropped, a
repeated ``%T`` adds to its table, rows before any ``%F`` are skipped; a field that
a table lacks reads as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.session import checkpoint_folder, remove_folder


class ScheduleError(ValueError):
    """What was asked for is not in the export, or the file isn't one."""


#: the bytes that windows-1252 and latin-1 read differently, and what the former makes of them
HIGH = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decoded(content: Column) -> Column:
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, HIGH)), bytes(HIGH).decode("cp1252"))
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).when(latin.rlike("[\u0081\u008d\u008f\u0090\u009d]"), latin).otherwise(windows)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line_no, tag, rest for every line that isn't empty."""
    files = spark.read.format("binaryFile").load(paths)
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(decoded(F.col("content")), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "\r+$", "")).where(F.col("line") != "")
    tag = F.substring_index("line", "\t", 1)
    return lines.select("file", "line_no", tag.alias("tag"), F.substring(F.col("line"), F.char_length(tag) + 2, F.char_length("line")).alias("rest"))


def rows_of(lines: DataFrame) -> DataFrame:
    """file, table, line_no, fields, cells: the rows of all tables."""
    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("tag") == "%T", F.trim("rest")), ignorenulls=True).over(above)
    # a table's start forgets the fields of the table before it
    heads = F.when(F.col("tag") == "%T", F.struct(F.lit(None).cast("array<string>").alias("fields"))).when(F.col("tag") == "%F", F.struct(F.split("rest", "\t", -1).alias("fields")))
    marked = lines.withColumn("table", opened).withColumn("fields", F.last(heads, ignorenulls=True).over(above)["fields"])
    rows = marked.where((F.col("tag") == "%R") & F.col("table").isNotNull() & F.col("fields").isNotNull())
    return rows.select("file", "table", "line_no", "fields", F.split("rest", "\t", -1).alias("cells"))


def cell(name: str) -> Column:
    """The cell under a field; of fields of the same name the last one counts."""
    place = F.size("fields") - F.array_position(F.reverse("fields"), name).cast("int")
    return F.when(F.array_contains("fields", name), F.coalesce(F.get("cells", place), F.lit(""))).otherwise(F.lit(""))


def table_of(rows: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """file, line_no and the named fields, all strings, of one table."""
    return rows.where(F.col("table") == table).select("file", "line_no", *[cell(f).alias(f) for f in fields])


def newest(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows with the same keys the last in the file; an aggregate, so copies meet combined."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "line_no").alias("__r")).select(*keys, "__r.*")


def headers(lines: DataFrame) -> DataFrame:
    """file, version, exported, user from the header line."""
    head = lines.where(F.col("tag") == "ERMHDR").groupBy("file").agg(F.max_by("rest", "line_no").alias("rest"))
    parts = F.split("rest", "\t", -1)
    return head.select("file", *[F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in ((0, "version"), (1, "exported"), (4, "user"))])


def declared(lines: DataFrame) -> DataFrame:
    """file, table: the tables that a file opens, empty ones too."""
    return lines.where(F.col("tag") == "%T").select("file", F.trim("rest").alias("table")).distinct()


def require_schedules(lines: DataFrame) -> None:
    """An error that names a file without TASK and PROJECT tables."""
    has = lambda t: F.max(((F.col("tag") == "%T") & (F.trim("rest") == t)).cast("int"))
    bad = lines.groupBy("file").agg(has("TASK").alias("t"), has("PROJECT").alias("p")).where("t = 0 or p = 0").select("file").limit(1).collect()
    if bad:
        raise ScheduleError(f"{bad[0]['file']} is not a schedule export (no PROJECT or TASK table)")


def export_tables(spark: SparkSession, paths: str | list[str], tables: list[str] | None, folder: str) -> DataFrame:
    """Writes each table as CSV below ``folder`` (a folder per table); returns table, n_rows (null: no such table).

    The two delete characters that stand for a line end inside a cell become one. The exports are read once: the rows go by table
    to the shared folder, and each table is written from its own part.
    """
    lines = read_lines(spark, paths)
    have = [r["table"] for r in declared(lines).select("table").distinct().orderBy("table").collect()]
    wanted = [t.strip().upper() for t in tables] if tables else have
    chosen = rows_of(lines).where(F.col("table").isin([t for t in wanted if t in have]))
    store = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
    chosen.write.partitionBy("table").parquet(store)
    rows = spark.read.schema(chosen.schema).parquet(store)
    out = []
    for t in wanted:
        if t not in have:
            out.append((t, None))
            continue
        own = rows.where(F.col("table") == t)
        first = own.agg(F.count(F.lit(1)).alias("n"), F.min_by("fields", F.struct("file", "line_no")).alias("fields")).first()
        names = list(dict.fromkeys(first["fields"] or []))
        if names:
            clean = [F.regexp_replace(cell(n), "\u007f\u007f", "\n").alias(n) for n in names]
            own.select(*clean).write.mode("overwrite").option("header", True).csv(f"{folder}/{t}")
        out.append((t, first["n"]))
    remove_folder(spark, store)
    return spark.createDataFrame(out, "table string, n_rows long")

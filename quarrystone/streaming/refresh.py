"""Recurring refreshes as Structured Streaming: new files are taken up once, whenever a run finds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, root: str, pattern: str = "*", per_run: int = 1000) -> DataFrame:
    """path, mtime, size, content of files as they arrive below ``root``; the source remembers which it has given."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_run).load(root)
    return raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def keep_texts(spark: SparkSession, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Extracts what arrived since the last run, appends it to the table at ``table`` and stops; the latest row of a path is its text."""
    from quarrystone.sources.files import _extract_rows

    arrived = arriving_files(spark, root).where(~F.substring_index("path", "/", -1).startswith("~$"))
    rows = arrived.withColumn("ext", F.lower(F.substring_index("path", ".", -1))).select("path", "size", "mtime", "ext", "content")
    texts = rows.mapInPandas(_extract_rows, "path string, size long, mtime timestamp, text string, pages int, status string")
    return texts.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(texts: DataFrame) -> DataFrame:
    """The newest row of each path."""
    rest = [c for c in texts.columns if c != "path"]
    return texts.groupBy("path").agg(F.max_by(F.struct(*rest), "mtime").alias("r")).select("path", "r.*")


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", key: str = "event_type", at: str = "ts", value: str = "value") -> DataFrame:
    """window_start, key, n, total per window of event time; rows later than ``late`` behind the newest are dropped. For batch and stream alike."""
    timed = events.withColumn("__t", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("__t", late) if events.isStreaming else timed
    return timed.groupBy(F.window("__t", length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def each_run(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands what arrived to ``do``, run by run, and stops when there is no more."""
    return stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

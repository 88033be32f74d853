"""The session: settings for large inputs, and checkpoints in the shared folder."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: left to the cluster: memory, cores, the checkpoint and warehouse folders
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def own_folder(master: str) -> str:
    """A folder of this machine for checkpoints: in a local session all workers see it, on a cluster it would be lost work."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="checkpoints")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session, as in tests, may do without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own_folder(sc.master))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage as ``checkpointed`` does, by Parquet below ``checkpoint_folder``: rows are made once, later reads take the columns they need.

    The folder is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = posixpath.join(checkpoint_folder(spark), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a written folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(module: str) -> None:
    """Has the module's functions sent to the workers by value, so that workers need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])

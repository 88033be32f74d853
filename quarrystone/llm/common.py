"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that setting is absent, in a local session (as in tests) one of our own, else an error."""
    from quarrystone.session import own_folder

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own_folder(sc.master))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a written folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def hex32(value: Column) -> Column:
    """Eight lowercase hex digits of the low 32 bits."""
    return F.lower(F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def ship(module: str) -> None:
    """Has the module's functions sent to the workers by value, so that they need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])

"""Tables written once to the shared scratch folder, to cut the lineage of a job that
goes in rounds or reads one result more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_root(spark).rstrip('/')}/rollcall/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: a lost executor's work is read
    again from there instead of being done again from the start."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that is not needed any more, if it is there."""
    place, files = _place(spark, path)
    files.delete(place, True)


def hand_over(spark: SparkSession, path: str, to: str) -> bool:
    """Move a written folder, whole or not at all; False if there is none."""
    (place, files), (target, _) = _place(spark, path), _place(spark, to)
    if not files.exists(place):
        return False
    files.mkdirs(target.getParent())
    if not files.rename(place, target):
        raise OSError(f"{path} could not be moved to {to}")
    return True

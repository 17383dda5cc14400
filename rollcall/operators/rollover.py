"""Season rollover (O-67).

The source system truncates five tables in one transaction.  Here a season
is a directory; the rollover writes the next season with the roster copied
and every fact table empty (declared schemas), then -- only after all
writes succeeded -- records it as current.  Nothing is deleted, so the old
season stays readable and a failed run leaves the current pointer alone.

Each attempt writes to a folder of its own, so a rerun after a crash starts
clean.  The pointer is a list of versions that only grows: a version counts
once Spark has committed it, and the newest one names the current season.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

FACT_TABLES = {
    "task_comments": schemas.TASK_COMMENTS,
    "task_assignments": schemas.TASK_ASSIGNMENTS,
    "tasks": schemas.TASKS,
    "attendance_corrections": schemas.ATTENDANCE_CORRECTIONS,
    "daily_sessions": schemas.DAILY_SESSIONS,
    "punches": schemas.PUNCHES,
}

CONFIRM_WORD = "RESET"     # fixed value: the typed confirmation
POINTER = "version long, season string, path string"


class RolloverRefused(Exception):
    """The guard that refused: ``rollover_not_allowed`` or ``rollover_not_confirmed``."""


def _newest(spark: SparkSession, root: str):
    try:
        versions = spark.read.schema(POINTER).parquet(f"{root.rstrip('/')}/_current")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.orderBy(F.desc("version"), "path").first()


def season_rollover(spark: SparkSession, students: DataFrame, root: str, season: str,
                    confirm: str | None, allowed: bool) -> str:
    """Create ``<root>/season=<season>/<attempt>`` and point ``<root>/_current`` at it.

    Both guards of the source are kept: the deployment switch (``allowed``)
    and the typed confirmation.  A season that was the current one before is
    refused (``season_exists``)."""
    if not allowed:
        raise RolloverRefused("rollover_not_allowed")
    if confirm != CONFIRM_WORD:
        raise RolloverRefused("rollover_not_confirmed")
    root = root.rstrip("/")
    last = _newest(spark, root)
    if last is not None and last["season"] == season:
        raise RolloverRefused("season_exists")
    base = f"{root}/season={season}/{uuid.uuid4().hex}"
    roster = schemas.conform(students, schemas.STUDENTS)
    roster.write.mode("errorifexists").parquet(f"{base}/students")
    for name, schema in FACT_TABLES.items():
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{base}/{name}")
    version = 1 if last is None else last["version"] + 1
    pointer = spark.createDataFrame([(version, season, base)], POINTER)
    pointer.write.mode("append").parquet(f"{root}/_current")
    return base


def current_season(spark: SparkSession, root: str) -> str | None:
    last = _newest(spark, root)
    return None if last is None else last["path"]


def seasons(spark: SparkSession, root: str) -> DataFrame:
    """The chain of seasons (version, season, path), oldest first by version."""
    try:
        return spark.read.schema(POINTER).parquet(f"{root.rstrip('/')}/_current").select("version", "season", "path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def read_season(spark: SparkSession, root: str, table: str, season: str | None = None) -> DataFrame:
    """A table as of a season, by its latest rollover; None for the current one."""
    chain = seasons(spark, root)
    if season is not None:
        chain = chain.where(F.col("season") == season)
    last = chain.orderBy(F.desc("version"), "path").first()
    if last is None:
        raise ValueError("season_unknown")
    schema = schemas.STUDENTS if table == "students" else FACT_TABLES[table]
    return spark.read.schema(schema).parquet(f"{last['path']}/{table}").select(*schema.fieldNames())


def append_facts(df: DataFrame, root: str, table: str) -> None:
    """Add rows to a fact table of the current season."""
    path = current_season(df.sparkSession, root)
    if path is None:
        raise ValueError("season_unknown")
    schemas.conform(df, FACT_TABLES[table]).write.mode("append").parquet(f"{path}/{table}")

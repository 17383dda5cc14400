"""Late set-events (approved corrections, manual entries) as a stream.

They name another meeting day than their own time, so they are not
windowed.  Each micro-batch is appended to a durable set-event log; the
days it touches are re-folded from the punch log plus the whole set-event
log and only those ``meeting_date`` partitions of the session table are
overwritten.  Re-running an epoch after a failure is harmless: duplicated
events do not change a last-writer fold and the overwrite replaces the
same partitions.

The session table holds the raw fold; auto-close is applied by readers at
their own ``as_of`` (``rollcall.operators.sessions.auto_close``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timez import eastern_date, eastern_day_bounds_utc, ts_lit
from ..operators.sessions import session_fold
from ..sources.sinks import overwrite_session_days
from ..sources.tables import read_parquet


def punches_on_days(punches: DataFrame, days: DataFrame) -> DataFrame:
    """Events that belong to any of ``days`` (a one-column ``meeting_date``
    frame).  The scan is cut to the time between the first and the last of the
    days (ordinary punches by their UTC range, set-events by the day they
    name), which Parquet can prune on; a semi-join picks the days."""
    span = days.agg(F.min("meeting_date").alias("lo"), F.max("meeting_date").alias("hi")).first()
    if span["lo"] is None:
        return punches.where(F.lit(False))
    lo, hi = eastern_day_bounds_utc(span["lo"], span["hi"])
    named = F.col("meeting_date").between(F.lit(span["lo"]), F.lit(span["hi"]))
    timed = F.col("meeting_date").isNull() & (F.col("at") >= ts_lit(lo)) & (F.col("at") < ts_lit(hi))
    tagged = punches.where(named | timed).withColumn(
        "_md", F.coalesce(F.col("meeting_date"), eastern_date("at")))
    keep = days.select(F.col("meeting_date").alias("_md")).distinct()
    return tagged.join(keep, "_md", "left_semi").drop("_md")


def day_refresher(spark: SparkSession, punch_log_path: str, set_log_path: str,
                  sessions_path: str):
    """The ``foreachBatch`` function."""
    def process(batch: DataFrame, epoch_id: int) -> None:
        batch = schemas.conform(batch, schemas.PUNCHES)
        batch.write.mode("append").parquet(set_log_path)
        days = batch.select("meeting_date").where(F.col("meeting_date").isNotNull()).distinct()
        log = read_parquet(spark, punch_log_path, schemas.PUNCHES).unionByName(
            read_parquet(spark, set_log_path, schemas.PUNCHES))
        overwrite_session_days(session_fold(punches_on_days(log, days)), sessions_path)
    return process


def run_correction_stream(spark: SparkSession, set_events_stream: DataFrame,
                          punch_log_path: str, set_log_path: str, sessions_path: str,
                          checkpoint_path: str) -> None:
    """Drain the available set-events and refresh the touched days."""
    q = (set_events_stream.writeStream
         .foreachBatch(day_refresher(spark, punch_log_path, set_log_path, sessions_path))
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()

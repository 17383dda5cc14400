"""Structured Streaming form of the session fold (O-39..O-43).

The meeting day is a tumbling one-day window over Eastern wall-clock time,
so ``(student_id, window)`` is the session key and the batch fold's
mergeable aggregates run unchanged as an ordinary streaming aggregation:
no custom state.  Append mode emits a day once the watermark has passed
it.  The default delay is one day plus one hour, because Eastern wall time
steps back an hour at the autumn change.

Set-events (corrections, manual entries) name another day than their own
time, so they are never windowed; they go through the batch fold, which
rewrites only the affected ``meeting_date`` partitions
(``rollcall.sources.sinks.overwrite_session_days``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import eastern_wall, micros_between, ts_lit
from ..operators.sessions import SESSION_COLUMNS, fold_aggregates

DEFAULT_DELAY = "25 hours"
EPOCH = "1970-01-01 00:00:00"


def session_fold_stream(punches: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Streaming DataFrame of ordinary punches -> streaming sessions."""
    # Watermarks need an instant-typed column.  Encode the Eastern wall time
    # as "that wall time read as UTC": day windows (epoch-aligned arithmetic)
    # then fall exactly on Eastern midnights, whatever the session zone.
    wall_micros = micros_between(ts_lit(EPOCH), eastern_wall("at"))
    ev = (punches.where(F.col("meeting_date").isNull())
          .withColumn("local_ts", F.timestamp_micros(wall_micros))
          .withWatermark("local_ts", delay))
    agg = ev.groupBy("student_id", F.window("local_ts", "1 day").alias("day")).agg(
        *fold_aggregates())
    day_number = F.floor(F.unix_micros(F.col("day.start")) / F.lit(86_400_000_000)).cast("int")
    return (agg.withColumn("meeting_date", F.date_from_unix_date(day_number))
            .select(*SESSION_COLUMNS))


def run_session_stream(spark: SparkSession, punches_stream: DataFrame, sink_path: str,
                       checkpoint_path: str, delay: str = DEFAULT_DELAY) -> None:
    """Drain what is available into a Parquet sink (append mode) and stop.

    ``checkpoint_path`` must be on the shared checkpoint filesystem so that
    the query survives executor or driver loss."""
    q = (session_fold_stream(punches_stream, delay).writeStream
         .format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True)
         .start(sink_path))
    q.awaitTermination()

"""Sessions from a stream of punches in any order (§2.9).

Append mode drops what comes after its day has been emitted.  Here every micro-batch is
merged into the days it touches instead:

1. its punches go to the punch log, a folder per epoch and meeting day;
2. punches of days that were closed already (the day ended more than ``delay`` before the
   latest time seen in earlier batches) are also written to the late log, with the epoch
   and that time, so that every late change can be audited;
3. the touched days are folded again from the punch log, and committed to the session
   table (``sources.day_table``) as one version, which notes the epoch and the time seen.

Nothing is dropped, and the table equals the batch fold of all punches so far after every
batch.  A batch that is run again after a failure writes the same log folders and commits
the same days.  A trigger's size is bounded by ``maxFilesPerTrigger`` or
``maxBytesPerTrigger`` on the stream.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timez import eastern_date, eastern_wall
from ..operators.sessions import session_fold
from ..sources.day_table import DayTable

DELAY = dt.timedelta(hours=25)
LATE = schemas.T.StructType([*schemas.PUNCHES.fields, schemas.T.StructField("epoch", schemas.T.LongType()),
                             schemas.T.StructField("seen_until", schemas.TS)])
LOGGED = schemas.T.StructType([*schemas.PUNCHES.fields, schemas.T.StructField("day", schemas.T.DateType())])


class SessionDays:
    """The stream's tables below one root: ``log``, ``late`` and ``sessions``."""

    def __init__(self, spark: SparkSession, root: str, delay: dt.timedelta = DELAY):
        self.spark, self.root, self.delay = spark, root.rstrip("/"), delay
        self.sessions = DayTable(spark, f"{self.root}/sessions", schemas.DAILY_SESSIONS)

    def logged(self, days) -> DataFrame:
        """All punches so far of a set of days."""
        log = self.spark.read.schema(LOGGED).option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")
        return log.where(F.col("day").isin(*days)).select(*schemas.PUNCHES.fieldNames())

    def late(self) -> DataFrame:
        """The audited log of late punches."""
        try:
            return self.spark.read.schema(LATE).parquet(f"{self.root}/late").select(*LATE.fieldNames())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LATE)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """The ``foreachBatch`` function."""
        base = self.sessions.newest()
        rows = (schemas.conform(batch, schemas.PUNCHES)
                .withColumn("day", F.coalesce(F.col("meeting_date"), eastern_date("at"))))
        # The epoch's folder is replaced whole, so a second run leaves what the first would have.
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/log/epoch={epoch}")
        mine = self.spark.read.schema(LOGGED).parquet(f"{self.root}/log/epoch={epoch}")
        seen = mine.groupBy("day").agg(F.max(eastern_wall("at")).alias("latest")).collect()      # a row per touched day
        if not seen:
            return
        # Run again, the epoch must judge lateness by what was seen before it.
        before = base.seen_until
        if base.epoch == epoch:
            base_before = self.sessions.newest(base.number - 1) if base.number > 1 else None
            before = base_before.seen_until if base_before else None
        if before is not None:
            closed = F.date_add("day", 1).cast("timestamp_ntz") <= F.lit(before - self.delay)
            (mine.where(closed).select(*schemas.PUNCHES.fieldNames(), F.lit(epoch).cast("long").alias("epoch"), F.lit(before).alias("seen_until"))
             .write.mode("overwrite").parquet(f"{self.root}/late/batch={epoch}"))
        days = {r["day"] for r in seen}
        latest = max(r["latest"] for r in seen)
        prepared = self.sessions.prepare(session_fold(self.logged(days)), base)
        self.sessions.commit(base, prepared, days, epoch=epoch, seen_until=max(latest, base.seen_until or latest))

    def drain(self, punches_stream: DataFrame) -> None:
        """Merge what is available, batch by batch, and stop; the checkpoint lies below the root."""
        q = (punches_stream.writeStream.foreachBatch(self.merge)
             .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()

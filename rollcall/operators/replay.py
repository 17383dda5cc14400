"""Exact replay of the stored auto-close (C-2, O-44).

The source stores an auto-close when a request happens to sweep: every clock-in and every
read first closes all sessions that have been open for more than four hours, at clock-in
plus four hours.  So what is stored depends on when sweeps came: a session swept before
its clock-in time was corrected keeps the close of the old time.  ``sessions.auto_close``
is the closed form at one reader's instant; this is what the table holds after the log and
all sweeps.

Only the time after a session's last write of its clock-out can matter, as that write
overrides any close before it.  From there the session is open or not, its clock-in time
only moves by corrections, and it closes at the first sweep that comes after one of those
moments, late enough, and before the next.  The first sweep after an instant is looked up
in steps (same minute, same day, a later day), so that no task holds all sweeps.

Order at one instant: sweeps come before the events.  Sweeps after ``as_of`` don't count.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timez import AUTO_CLOSE_HOURS, ts_lit
from ..sources.staging import staged
from .sessions import SESSION_COLUMNS, SESSION_KEY, fold_aggregates, punches_until, with_meeting_date

_CLOCK_KINDS = ["clock_in", "clock_out", "set_in", "set_out", "set_both"]


def sweeps(punches: DataFrame, reads: DataFrame, as_of) -> DataFrame:
    """The instants (``at``) at which a request sweeps: clock-ins of active students and reads."""
    ins = punches.where(F.col("kind") == "clock_in").select("at")
    return ins.unionByName(reads.select("at")).where(F.col("at") <= ts_lit(as_of)).distinct()


def first_after(rows: DataFrame, col: str, instants: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the first of ``instants`` (distinct ``at``) strictly after ``col``."""
    spark = rows.sparkSession
    minute, day = (lambda c: F.date_trunc("minute", c)), (lambda c: F.to_date(c))
    first = sorted((r["day"], r["at"]) for r in instants.groupBy(day("at").alias("day")).agg(F.min("at").alias("at")).collect())
    if not first:
        return rows.withColumn(name, F.lit(None).cast("timestamp_ntz"))
    # Within a minute: the nearest instant behind a row, both in one table.
    own = rows.withColumn("_t", F.col(col)).withColumn("_row", F.lit(1))
    marks = instants.select(F.col("at").alias("_t"), F.lit(0).alias("_row"))
    in_minute = Window.partitionBy("_minute").orderBy("_t", "_row").rowsBetween(1, Window.unboundedFollowing)
    near = (own.unionByName(marks, allowMissingColumns=True).withColumn("_minute", minute("_t"))
            .withColumn("_near", F.min(F.when(F.col("_row") == 0, F.col("_t"))).over(in_minute)).where(F.col("_row") == 1)
            .withColumn("_day", day("_t")))
    # Within a day: the first instant of a later minute, for every minute that rows ask for.
    minutes = instants.groupBy(day("at").alias("_day"), minute("at").alias("_minute")).agg(F.min("at").alias("_first"))
    asked = rows.select(day(col).alias("_day"), minute(col).alias("_minute")).where(F.col("_day").isNotNull()).distinct()
    later_minutes = Window.partitionBy("_day").orderBy("_minute").rowsBetween(1, Window.unboundedFollowing)
    rest = asked.join(minutes, ["_day", "_minute"], "full").withColumn("_in_day", F.min("_first").over(later_minutes)).select("_day", "_minute", "_in_day")
    # A later day: the driver pairs the days asked for, a row of the calendar each.
    starts = [d for d, _ in first]
    pairs = []
    for r in asked.select("_day").distinct().collect():
        k = bisect.bisect_right(starts, r["_day"])
        pairs.append((r["_day"], first[k][1] if k < len(first) else None))
    later = F.broadcast(spark.createDataFrame(pairs, "_day date, _later timestamp_ntz"))
    return (near.join(rest, ["_day", "_minute"], "left").join(later, "_day", "left")
            .withColumn(name, F.coalesce("_near", "_in_day", "_later")).select(*rows.columns, name))


def replayed_sessions(punches: DataFrame, reads: DataFrame, as_of) -> DataFrame:
    """The stored session table at ``as_of``: the fold of (gated) punches, with every sweep
    of clock-ins and ``reads`` (``at``) played."""
    log = with_meeting_date(punches_until(punches, as_of))
    fold = log.groupBy(*SESSION_KEY).agg(*fold_aggregates()).select(*SESSION_COLUMNS)

    w = Window.partitionBy(*SESSION_KEY).orderBy("at", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("kind")
    writes_out = kind.isin("clock_in", "clock_out", "set_out", "set_both")
    set_in = F.last(F.when(kind.isin("set_in", "set_both"), F.struct("set_in")), ignorenulls=True).over(so_far)
    clock = (log.where(kind.isin(*_CLOCK_KINDS))
             .withColumn("_in", F.coalesce(set_in["set_in"], F.min(F.when(kind == "clock_in", F.col("at"))).over(so_far)))
             .withColumn("_next", F.coalesce(F.lead("at").over(w), ts_lit(as_of)))
             .withColumn("_part", F.count_if(writes_out).over(so_far))
             .withColumn("_last", F.count_if(writes_out).over(Window.partitionBy(*SESSION_KEY))))
    four = F.make_dt_interval(F.lit(0), F.lit(AUTO_CLOSE_HOURS))
    # What stands after the last write of the clock-out, where that left the session open.
    opened = (F.col("_part") == F.col("_last")) & F.col("_in").isNotNull()
    tail = (clock.where(opened).select(*SESSION_KEY, "at", "seq", "_in", "_next")
            .withColumn("_from", F.greatest("at", F.col("_in") + four)))
    # Both are read several times.
    tail, instants = staged(tail, "replay-open"), staged(sweeps(punches, reads, as_of), "replay-sweeps")
    swept = first_after(tail, "_from", instants, "_swept").where(F.col("_swept") <= F.col("_next"))
    closed = swept.groupBy(*SESSION_KEY).agg(F.min(F.struct("at", "seq", (F.col("_in") + four).alias("out"), "_swept")).alias("c"))
    hit = F.col("clock_out_at").isNull() & F.col("c").isNotNull()
    return (fold.join(closed, SESSION_KEY, "left")
            .withColumn("updated_at", F.when(hit, F.greatest("updated_at", "c._swept")).otherwise(F.col("updated_at")))
            .withColumn("clock_out_at", F.when(hit, F.col("c.out")).otherwise(F.col("clock_out_at"))).select(*SESSION_COLUMNS))

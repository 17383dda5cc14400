"""Attendance read models over daily sessions: status board, tiles, need
queues, today's state, per-student history and the date-range report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timez import as_date, date_lit, eastern_date_of, micros_between
from .sessions import board_badge, clock_state, sessions_for_days

BOARD_COLUMNS = ["student_id", "full_name", "subteam", "meeting_date", "clock_in_at",
                 "clock_out_at", "working_on", "need_help", "need_task", "need_help_at",
                 "need_task_at", "updated_at"]

HISTORY_LIMIT = 30     # fixed value: sessions shown on a student card


def _active(students: DataFrame) -> DataFrame:
    return students.where(F.col("is_active"))


def status_board(students: DataFrame, punches: DataFrame, as_of, day=None) -> DataFrame:
    """O-19 (+ O-08/O-09): every active student with that day's session, if
    any.  ``day`` defaults to the Eastern date of ``as_of``.  Only the events
    that can reach that day are read.  The constant day replaces the source's
    cross join with a one-row relation."""
    day = as_date(day) if day is not None else eastern_date_of(as_of)
    ds = sessions_for_days(punches, day, day, as_of).where(
        F.col("meeting_date") == date_lit(day))
    s = _active(students).select("student_id", "full_name",
                                 F.col("subteam").alias("roster_subteam"))
    board = s.join(ds.withColumnRenamed("subteam", "session_subteam"), "student_id", "left")
    return board.select(
        "student_id", "full_name",
        F.coalesce("session_subteam", "roster_subteam").alias("subteam"),
        "meeting_date", "clock_in_at", "clock_out_at", "working_on", "need_help",
        "need_task", "need_help_at", "need_task_at", "updated_at",
        clock_state().alias("status"), board_badge().alias("badge"))


def status_tiles(board: DataFrame, by_subteam: bool = False) -> DataFrame:
    """O-10/O-27: tile counts in one pass.  ``help_or_task`` counts a
    student with both flags twice, as the dashboard does."""
    cin, cout = F.col("clock_in_at"), F.col("clock_out_at")
    aggs = [
        F.count_if(cin.isNotNull() & cout.isNull()).alias("clocked_in"),
        F.count_if(cin.isNotNull() & cout.isNotNull()).alias("clocked_out"),
        F.count_if(cin.isNull()).alias("not_clocked_in"),
        F.count_if(F.coalesce("need_help", F.lit(False))).alias("need_help"),
        F.count_if(F.coalesce("need_task", F.lit(False))).alias("need_task"),
    ]
    out = board.groupBy("subteam").agg(*aggs) if by_subteam else board.agg(*aggs)
    return out.withColumn("help_or_task", F.col("need_help") + F.col("need_task"))


def needs_queue(board: DataFrame) -> DataFrame:
    """O-10b: the help and the task queues as one table (``positions`` puts them in order)."""
    cols = ["student_id", "full_name", "subteam", "working_on"]
    help_ = board.where(F.col("need_help")).select(
        F.lit("help").alias("kind"), *cols, F.col("need_help_at").alias("requested_at"))
    task = board.where(F.col("need_task")).select(
        F.lit("task").alias("kind"), *cols, F.col("need_task_at").alias("requested_at"))
    return help_.unionByName(task)


def student_today(students: DataFrame, punches: DataFrame, as_of) -> DataFrame:
    """O-11 in batch form: each active student's state for the Eastern day
    of ``as_of``; no session -> not_clocked_in."""
    day = eastern_date_of(as_of)
    ds = sessions_for_days(punches, day, day, as_of).where(
        F.col("meeting_date") == date_lit(day))
    s = _active(students).select("student_id")
    t = s.join(ds, "student_id", "left")
    return t.select("student_id", date_lit(day).alias("day"), clock_state().alias("status"),
                    "clock_in_at", "clock_out_at", "subteam", "working_on", "need_help",
                    "need_task", "task_id")


def student_history(students: DataFrame, sessions: DataFrame,
                    limit: int = HISTORY_LIMIT) -> DataFrame:
    """O-35 for all students at once: each student's newest ``limit``
    sessions with the card header (inactive students included).  A ranked
    window with a ``<= limit`` filter, which Spark plans as a
    WindowGroupLimit on both sides of the shuffle, so a student with a very
    long history sends at most ``limit`` rows per input partition."""
    w = Window.partitionBy("student_id").orderBy(F.col("meeting_date").desc())
    recent = (sessions.withColumn("recent_rank", F.row_number().over(w).cast("long"))
              .where(F.col("recent_rank") <= limit))
    header = students.select("student_id", "full_name",
                             F.col("subteam").alias("student_subteam"))
    return header.join(recent, "student_id", "inner")


def attendance_report(students: DataFrame, sessions: DataFrame, start, end) -> DataFrame:
    """O-23..O-26, contract C-3, per active student over meeting days
    ``start..end`` (inclusive): days with a clock-in, last such day, and
    hours (out, else in, minus in) rounded half away from zero to 2 places.

    Sessions are aggregated per student first (partial aggregation before
    the shuffle), then joined to the roster so absentees stay with zeros.
    The sum is exact integer microseconds; rounding is integer arithmetic,
    so the result does not depend on floating-point summation order."""
    start, end = as_date(start), as_date(end)
    s = sessions.where(F.col("meeting_date").between(date_lit(start), date_lit(end))
                       & F.col("clock_in_at").isNotNull())
    micros = micros_between("clock_in_at", F.coalesce("clock_out_at", "clock_in_at"))
    per = s.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("days_clocked_in"),
        F.max("meeting_date").alias("last_day"),
        F.sum(micros).alias("micros"))
    r = _active(students).select("student_id", "full_name", "subteam").join(
        per, "student_id", "left")
    m = F.coalesce(F.col("micros"), F.lit(0))
    hundredths = F.expr("sign(micros_) * ((abs(micros_) + 18000000) div 36000000)")
    return (r.withColumn("micros_", m)
            .select("student_id", "full_name", "subteam",
                    F.coalesce("days_clocked_in", F.lit(0)).cast("long").alias("days_clocked_in"),
                    "last_day",
                    (hundredths.cast("double") / F.lit(100.0)).alias("hours_total")))


def board_display(board: DataFrame) -> DataFrame:
    """O-38n/O-38o/O-09: the board cards as text -- ``name (subteam)``, the
    badge, Eastern in/out times (an em dash when missing), the meeting day
    as MM/dd/yyyy ('' when none) and the flags as labels."""
    from ..functions.format import fmt_date, fmt_time
    from ..functions.text import name_with_subteam
    flags = F.concat_ws(" ", F.when(F.col("need_help"), F.lit("HELP")),
                        F.when(F.col("need_task"), F.lit("TASK")))
    return board.select(
        "student_id",
        name_with_subteam("full_name", "subteam").alias("label"),
        "badge",
        fmt_date("meeting_date").alias("day"),
        fmt_time("clock_in_at").alias("in_time"),
        fmt_time("clock_out_at").alias("out_time"),
        F.coalesce(F.col("working_on"), F.lit("")).alias("working_on"),
        flags.alias("flags"))

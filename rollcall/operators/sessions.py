"""Punch log -> daily sessions (O-39..O-44, contracts C-1 and C-2).

The source system mutates one row per (student, Eastern day) as requests
arrive.  Here the row is a pure function of the event log up to ``as_of``:
every column is a "last writer wins" or "first writer wins" aggregate over
the day's events in ``(at, seq)`` order.  All of them are mergeable, so the
fold is one ``groupBy`` with map-side partial aggregation: a student with a
huge number of punches is pre-aggregated inside each input partition before
anything is shuffled.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timez import (AUTO_CLOSE_HOURS, eastern_date, eastern_day_bounds_utc,
                               as_date, ts_lit)

SESSION_KEY = ["student_id", "meeting_date"]

SESSION_COLUMNS = ["student_id", "meeting_date", "clock_in_at", "clock_out_at", "subteam",
                   "working_on", "need_help", "need_help_at", "need_task", "need_task_at",
                   "task_id", "updated_at"]


def _order_key() -> Column:
    return F.struct(F.col("at"), F.col("seq"))


def last_write(cond: Column, value: Column) -> Column:
    """Value written by the last event (in ``(at, seq)`` order) for which
    ``cond`` holds; NULL when none does.  The value is wrapped in a struct so
    that a NULL *write* wins over earlier non-NULL ones."""
    return F.max_by(F.struct(value.alias("v")), F.when(cond, _order_key()))["v"]


def with_meeting_date(punches: DataFrame) -> DataFrame:
    """Ordinary punches belong to the Eastern day of ``at``; set-events keep
    the day they name."""
    return punches.withColumn("meeting_date",
                              F.coalesce(F.col("meeting_date"), eastern_date("at")))


def punches_until(punches: DataFrame, as_of) -> DataFrame:
    return punches.where(F.col("at") <= ts_lit(as_of))


def punches_for_days(punches: DataFrame, first, last) -> DataFrame:
    """Events that can touch meeting days ``first..last``.

    Expressed on the raw ``at`` column for ordinary punches so that Parquet
    row groups outside the window are skipped."""
    first, last = as_date(first), as_date(last)
    lo, hi = eastern_day_bounds_utc(first, last)
    md = F.col("meeting_date")
    return punches.where(
        (md.isNull() & (F.col("at") >= ts_lit(lo)) & (F.col("at") < ts_lit(hi)))
        | (md.isNotNull() & md.between(F.lit(first.isoformat()).cast("date"),
                                       F.lit(last.isoformat()).cast("date"))))


def session_fold(punches: DataFrame, as_of=None) -> DataFrame:
    """Fold (gated) punches into one row per (student, meeting_date).  C-1:

    * ``clock_in_at``  = last set-in value, else the first clock-in;
    * ``clock_out_at`` = value of the last of {clock_in -> NULL (re-open),
      clock_out -> at, set_out -> value, set_both -> value or NULL};
    * ``subteam`` = last non-empty subteam; ``working_on`` = last non-NULL
      (an empty string does overwrite), default '';
    * ``task_id`` = last task named by a clock-in;
    * need flags = last toggle; ``*_at`` = its time when the flag is on;
    * ``updated_at`` = last event time.

    No auto-close here: see ``auto_close``.
    """
    ev = punches if as_of is None else punches_until(punches, as_of)
    ev = with_meeting_date(ev)
    return ev.groupBy(*SESSION_KEY).agg(*fold_aggregates()).select(*SESSION_COLUMNS)


def last_write_sql(cond: str, value: str) -> str:
    """SQL text of ``last_write`` (one JVM call to build, same plan)."""
    return f"max_by(struct({value} AS v), CASE WHEN {cond} THEN struct(`at`, seq) END).v"


_IS_IN = "kind = 'clock_in'"
_SET_IN = "kind IN ('set_in', 'set_both')"
_WRITES_OUT = "kind IN ('clock_in', 'clock_out', 'set_out', 'set_both')"
_OUT_VALUE = ("CASE WHEN kind = 'clock_out' THEN `at` "
              "WHEN kind IN ('set_out', 'set_both') THEN set_out END")
_HELP, _TASK = "kind = 'need_help'", "kind = 'need_task'"
_FLAG = "coalesce(value, false)"
_FLAG_AT = "CASE WHEN coalesce(value, false) THEN `at` END"

def fold_sql(where: str = "true") -> list[tuple[str, str]]:
    """The C-1 aggregates, over the events for which ``where`` holds."""
    def last(cond, value):
        return last_write_sql(cond if where == "true" else f"({where}) AND ({cond})", value)

    def when(cond, value):
        return value if where == cond == "true" else f"CASE WHEN ({where}) AND ({cond}) THEN {value} END"
    return [
        ("clock_in_at", f"coalesce({last(_SET_IN, 'set_in')}, min({when(_IS_IN, '`at`')}))"),
        ("clock_out_at", last(_WRITES_OUT, _OUT_VALUE)),
        ("subteam", last("coalesce(subteam, '') <> ''", "subteam")),
        ("working_on", f"coalesce({last('working_on IS NOT NULL', 'working_on')}, '')"),
        ("need_help", f"coalesce({last(_HELP, _FLAG)}, false)"),
        ("need_help_at", last(_HELP, _FLAG_AT)),
        ("need_task", f"coalesce({last(_TASK, _FLAG)}, false)"),
        ("need_task_at", last(_TASK, _FLAG_AT)),
        ("task_id", last(f"{_IS_IN} AND task_id IS NOT NULL", "task_id")),
        ("updated_at", f"max({when('true', '`at`')})"),
    ]


def fold_aggregates() -> list[Column]:
    """The C-1 aggregates over one session's events (shared by the batch
    fold and the streaming fold)."""
    return [F.expr(sql).alias(name) for name, sql in fold_sql()]


def auto_close(sessions: DataFrame, as_of) -> DataFrame:
    """C-2 / O-44: a session still open more than 4 hours (strictly) before
    ``as_of`` is closed at clock-in + 4 h.  A closed form on the folded row."""
    four = F.make_dt_interval(F.lit(0), F.lit(AUTO_CLOSE_HOURS))
    cin, cout = F.col("clock_in_at"), F.col("clock_out_at")
    stale = cin.isNotNull() & cout.isNull() & (cin < ts_lit(as_of) - four)
    return sessions.withColumn("clock_out_at", F.when(stale, cin + four).otherwise(cout))


def daily_sessions(punches: DataFrame, as_of) -> DataFrame:
    """The session table as the source system would show it at ``as_of``."""
    return auto_close(session_fold(punches, as_of), as_of)


def sessions_for_days(punches: DataFrame, first, last, as_of) -> DataFrame:
    """``daily_sessions`` restricted to meeting days ``first..last``; reads
    only the events that can reach those days."""
    return daily_sessions(punches_for_days(punches, first, last), as_of)


def clock_state(clock_in: Column | str = "clock_in_at",
                clock_out: Column | str = "clock_out_at") -> Column:
    """O-08: clocked_in / clocked_out / not_clocked_in (an out-only row is
    'not clocked in')."""
    cin = F.col(clock_in) if isinstance(clock_in, str) else clock_in
    cout = F.col(clock_out) if isinstance(clock_out, str) else clock_out
    return (F.when(cin.isNotNull() & cout.isNull(), "clocked_in")
            .when(cin.isNotNull() & cout.isNotNull(), "clocked_out")
            .otherwise("not_clocked_in"))


def board_badge(clock_in: Column | str = "clock_in_at",
                clock_out: Column | str = "clock_out_at") -> Column:
    """O-09: IN / OUT / em dash."""
    st = clock_state(clock_in, clock_out)
    return F.when(st == "clocked_in", "IN").when(st == "clocked_out", "OUT").otherwise("—")


def session_states(sessions: DataFrame) -> DataFrame:
    """O-08 over a session table."""
    return sessions.select("student_id", "meeting_date",
                           clock_state().alias("status"))


def need_state(punches: DataFrame, as_of) -> DataFrame:
    """O-43: the help / task flags per session (toggle events only)."""
    ev = punches.where(F.col("kind").isin("need_help", "need_task"))
    return session_fold(ev, as_of).select(
        "student_id", "meeting_date", "need_help", "need_help_at", "need_task", "need_task_at")


# ------------------------------------------------------------ stored table

def store_sessions(punches: DataFrame, path: str) -> str:
    """Write the raw fold (no auto-close) as a table partitioned by
    ``meeting_date`` -- the date index of the source system becomes
    partition pruning.  Written to a new path; later corrections replace
    single days with ``rollcall.sources.sinks.overwrite_session_days``."""
    (session_fold(punches).write.mode("errorifexists")
     .partitionBy("meeting_date").parquet(path))
    return path


def load_sessions(spark, path: str, as_of, first=None, last=None) -> DataFrame:
    """Read a stored session table at ``as_of``: only the partitions of
    meeting days ``first..last`` are listed and read, then the auto-close
    is applied."""
    from .. import schemas
    df = spark.read.schema(schemas.DAILY_SESSIONS).parquet(path)
    if first is not None:
        df = df.where(F.col("meeting_date") >= F.lit(as_date(first).isoformat()).cast("date"))
    if last is not None:
        df = df.where(F.col("meeting_date") <= F.lit(as_date(last).isoformat()).cast("date"))
    return auto_close(df.select(*SESSION_COLUMNS), as_of)

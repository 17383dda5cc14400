"""Sessions as change rows (O-46, O-47, C-4): what a stretch of the event log did to the
session table, as rows taken out and rows put in.

Corrections are decided days after the day they name, so a reader of stored sessions needs
to know which rows a batch of decisions replaced.  One grouped pass over the log folds
every (student, day) twice, up to the first instant and up to the second; where the two
rows differ, the old one goes out and the new one comes in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sessions import SESSION_COLUMNS, SESSION_KEY, fold_sql, punches_until, with_meeting_date

VALUES = [c for c in SESSION_COLUMNS if c not in SESSION_KEY]


def session_changes(punches: DataFrame, since, until) -> DataFrame:
    """(op, session columns): ``out`` rows of the table as of ``since``, ``in`` rows of that
    as of ``until``.  ``since`` None: everything is new."""
    before = "false" if since is None else f"`at` <= TIMESTAMP_NTZ '{since}'"
    ev = with_meeting_date(punches_until(punches, until))

    def row(where):
        return "struct(" + ", ".join(f"{sql} AS {name}" for name, sql in fold_sql(where)) + ")"

    both = ev.groupBy(*SESSION_KEY).agg(F.expr(f"CASE WHEN count_if({before}) > 0 THEN {row(before)} END").alias("old"),
                                        F.expr(row("true")).alias("new"))
    changed = both.where(~F.col("old").eqNullSafe(F.col("new")))
    moves = F.array(F.struct(F.lit("out").alias("op"), F.col("old").alias("s")), F.struct(F.lit("in").alias("op"), F.col("new").alias("s")))
    return (changed.select(*SESSION_KEY, F.explode(moves).alias("m")).where(F.col("m.s").isNotNull())
            .select("m.op", *SESSION_KEY, *[F.col(f"m.s.{c}").alias(c) for c in VALUES]))


def apply_changes(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """The session table after the changes.  A row goes out only as it was put in, so
    changes that don't belong to this state of the table show up as double keys."""
    out = changes.where(F.col("op") == "out").select(*SESSION_COLUMNS)
    new = changes.where(F.col("op") == "in").select(*SESSION_COLUMNS)
    s, o = sessions.select(*SESSION_COLUMNS).alias("s"), out.alias("o")
    same = [F.col(f"s.{c}") == F.col(f"o.{c}") for c in SESSION_KEY] + [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in VALUES]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return s.join(o, cond, "left_anti").unionByName(new)

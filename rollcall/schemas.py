"""Declared schemas (O-04), enumerations and additive schema evolution.

Tables are never inferred: every input is conformed to one of these
``StructType`` s.  Timestamps are UTC instants held as ``timestamp_ntz`` so that
no session time zone can shift them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = T.TimestampNTZType()

# Fixed values (domain enumerations of the source system).
TASK_STATUSES = ["todo", "in_progress", "blocked", "done"]
CORRECTION_STATUSES = ["pending", "approved", "denied"]
AUTHOR_TYPES = ["student", "mentor"]
CLOCK_STATES = ["clocked_in", "clocked_out", "not_clocked_in"]
PUNCH_KINDS = ["clock_in", "clock_out", "update", "need_help", "need_task",
               "set_in", "set_out", "set_both"]


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


STUDENTS = T.StructType([
    _f("student_id", T.LongType(), False),
    _f("full_name", T.StringType(), False),
    _f("subteam", T.StringType()),
    _f("is_active", T.BooleanType(), False),
    _f("created_at", TS, False),
])

# One row per student event.  Ordinary punches take the Eastern day of ``at``;
# set-events and manual entries carry their own ``meeting_date``.
PUNCHES = T.StructType([
    _f("student_id", T.LongType(), False),
    _f("at", TS, False),
    _f("seq", T.LongType(), False),
    _f("kind", T.StringType(), False),
    _f("meeting_date", T.DateType()),
    _f("subteam", T.StringType()),
    _f("working_on", T.StringType()),
    _f("task_id", T.LongType()),
    _f("value", T.BooleanType()),
    _f("set_in", TS),
    _f("set_out", TS),
])

DAILY_SESSIONS = T.StructType([
    _f("student_id", T.LongType(), False),
    _f("meeting_date", T.DateType(), False),
    _f("clock_in_at", TS),
    _f("clock_out_at", TS),
    _f("subteam", T.StringType()),
    _f("working_on", T.StringType(), False),
    _f("need_help", T.BooleanType(), False),
    _f("need_help_at", TS),
    _f("need_task", T.BooleanType(), False),
    _f("need_task_at", TS),
    _f("task_id", T.LongType()),
    _f("updated_at", TS, False),
])

# Raw correction requests as submitted: dates and times are still strings.
CORRECTION_REQUESTS = T.StructType([
    _f("id", T.LongType(), False),
    _f("student_id", T.LongType()),
    _f("meeting_date", T.StringType()),
    _f("requested_clock_in", T.StringType()),
    _f("requested_clock_out", T.StringType()),
    _f("reason", T.StringType()),
    _f("created_at", TS, False),
])

CORRECTION_DECISIONS = T.StructType([
    _f("correction_id", T.LongType(), False),
    _f("at", TS, False),
    _f("seq", T.LongType(), False),
    _f("status", T.StringType()),
    _f("note", T.StringType()),
])

ATTENDANCE_CORRECTIONS = T.StructType([
    _f("id", T.LongType(), False),
    _f("student_id", T.LongType(), False),
    _f("meeting_date", T.DateType(), False),
    _f("requested_clock_in", T.StringType(), False),
    _f("requested_clock_out", T.StringType()),
    _f("reason", T.StringType(), False),
    _f("status", T.StringType(), False),
    _f("created_at", TS, False),
    _f("decided_at", TS),
    _f("decided_by", T.StringType()),
    _f("decision_note", T.StringType()),
])

# Manual attendance entries (mentor backfill), strings as submitted.
MANUAL_ENTRIES = T.StructType([
    _f("student_id", T.LongType()),
    _f("at", TS, False),
    _f("seq", T.LongType(), False),
    _f("meeting_date", T.StringType()),
    _f("clock_in_time", T.StringType()),
    _f("clock_out_time", T.StringType()),
    _f("subteam", T.StringType()),
    _f("working_on", T.StringType()),
])

TASKS = T.StructType([
    _f("id", T.LongType(), False),
    _f("title", T.StringType(), False),
    _f("subteam", T.StringType(), False),
    _f("status", T.StringType(), False),
    _f("description", T.StringType(), False),
    _f("archived", T.BooleanType(), False),
    _f("created_at", TS, False),
    _f("updated_at", TS, False),
])

TASK_ASSIGNMENTS = T.StructType([
    _f("id", T.LongType(), False),
    _f("task_id", T.LongType(), False),
    _f("student_id", T.LongType(), False),
    _f("assigned_at", TS, False),
    _f("unassigned_at", TS),
])

TASK_COMMENTS = T.StructType([
    _f("id", T.LongType(), False),
    _f("task_id", T.LongType(), False),
    _f("author_type", T.StringType(), False),
    _f("author_label", T.StringType(), False),
    _f("comment", T.StringType(), False),
    _f("created_at", TS, False),
])

# Task-side event log: create / patch / archive / unarchive / join / leave /
# assign / comment / clock_in (a clock-in that names the task).
TASK_EVENTS = T.StructType([
    _f("task_id", T.LongType(), False),
    _f("at", TS, False),
    _f("seq", T.LongType(), False),
    _f("kind", T.StringType(), False),
    _f("student_id", T.LongType()),
    _f("title", T.StringType()),
    _f("subteam", T.StringType()),
    _f("status", T.StringType()),
    _f("description", T.StringType()),
])

COMMENT_REQUESTS = T.StructType([
    _f("id", T.LongType(), False),
    _f("task_id", T.LongType(), False),
    _f("at", TS, False),
    _f("student_id", T.LongType()),
    _f("author_type", T.StringType()),
    _f("author_label", T.StringType()),
    _f("comment", T.StringType()),
])

ROSTER_CHANGES = T.StructType([
    _f("at", TS, False),
    _f("seq", T.LongType(), False),
    _f("student_id", T.LongType()),
    _f("full_name", T.StringType()),
    _f("subteam", T.StringType()),
    _f("is_active", T.BooleanType()),
])

# Declared defaults for columns added after a table first existed.
DEFAULTS: dict[str, dict[str, object]] = {
    "tasks": {"archived": False, "description": ""},
    "daily_sessions": {"task_id": None},
}


# What each file generation added to a table, with the defaults that older files get.
GENERATIONS: dict[str, dict] = {
    "tasks": {"schema": TASKS, "added": {2: DEFAULTS["tasks"]}},
    "daily_sessions": {"schema": DAILY_SESSIONS, "added": {2: DEFAULTS["daily_sessions"]}},
}


def conform(df: DataFrame, schema: T.StructType,
            defaults: dict[str, object] | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add missing ones
    from ``defaults`` (else NULL), drop undeclared ones.  Additive evolution as
    in ``add column if not exists ... default``."""
    defaults = defaults or {}
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            c = F.col(field.name)
            # A file written before the column existed reads back as NULL
            # under the declared schema: the declared default applies.
            if defaults.get(field.name) is not None:
                d = defaults[field.name]
                c = F.coalesce(c, d if isinstance(d, Column) else F.lit(d))
        else:
            d = defaults.get(field.name)
            c = d if isinstance(d, Column) else F.lit(d)
        cols.append(c.cast(field.dataType).alias(field.name))
    return df.select(*cols)


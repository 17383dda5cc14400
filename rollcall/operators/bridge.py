"""From punches and comments to the task side (O-53, O-54, O-57, O-58).

A clock-in that names a task also opens the student's assignment and moves a task from
'todo' to 'in_progress'; an accepted comment touches its task.  The router turns both into
rows of the task event log, in which one ``clock_in`` row is the opening that
``assignment_intervals`` reads and the promotion that ``task_fold`` reads.

The logs have sequence numbers of their own, so the order of rows of one instant is
composed: by the number within its log, then by the log (``SOURCE_RANK``).  Composed
numbers are unique when each log's are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TASK_EVENTS

SOURCE_RANK = {"tasks": 0, "punches": 1, "comments": 2}
RADIX = 4               # numbers of a log stay below 2^61


def composed_seq(seq: Column, source: str) -> Column:
    return seq * F.lit(RADIX) + F.lit(SOURCE_RANK[source])


def _row(**given) -> list[Column]:
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TASK_EVENTS.fields]


def punch_task_events(punches: DataFrame) -> DataFrame:
    """The task events of (gated) punches: one per clock-in that names a task."""
    return (punches.where((F.col("kind") == "clock_in") & F.col("task_id").isNotNull())
            .select(*_row(task_id=F.col("task_id"), at=F.col("at"), seq=composed_seq(F.col("seq"), "punches"),
                          kind=F.lit("clock_in"), student_id=F.col("student_id"))))


def comment_task_events(comments: DataFrame) -> DataFrame:
    """The touches of accepted comments."""
    return comments.select(*_row(task_id=F.col("task_id"), at=F.col("created_at"), seq=composed_seq(F.col("id"), "comments"),
                                 kind=F.lit("comment")))


def task_log(task_events: DataFrame, punches: DataFrame, comments: DataFrame) -> DataFrame:
    """One log of everything that happens to tasks."""
    own = task_events.withColumn("seq", composed_seq(F.col("seq"), "tasks")).select(*TASK_EVENTS.fieldNames())
    return own.unionByName(punch_task_events(punches)).unionByName(comment_task_events(comments))

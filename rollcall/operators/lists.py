"""Ordered lists of any length, in chunks (O-22, O-30).

``tasks.task_assignees`` gathers a task's list in one row.  Where a task may have very many
assignees, its list comes in chunks of bounded length instead: each pair gets its position
in its task (``positions``: ranges of the order, no window over a task), which names its
chunk, and only a chunk is gathered.  A sink that wants one text per task writes a task's
chunks one after the other: ``[`` + chunks joined by commas + ``]``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import with_position
from .tasks import open_assignments

CHUNK = 10_000


def assignee_chunks(assignments: DataFrame, students: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(task_id, chunk, n_before, assignees): the open assignees of a task by name, each
    student once, in chunks of ``chunk``."""
    pairs = open_assignments(assignments).select("task_id", "student_id").distinct()
    named = pairs.join(students.select("student_id", "full_name"), "student_id")
    placed = with_position(named, [F.col("full_name"), F.col("student_id")], within=["task_id"])
    which = F.floor((F.col("position") - 1) / F.lit(chunk)).cast("long")
    rows = (placed.groupBy("task_id", which.alias("chunk"))
            .agg(F.sort_array(F.collect_list(F.struct("position", "student_id", "full_name"))).alias("l")))
    return rows.select("task_id", "chunk", (F.col("chunk") * chunk).alias("n_before"),
                       F.transform("l", lambda x: F.struct(x["student_id"].alias("student_id"), x["full_name"].alias("full_name"))).alias("assignees"))

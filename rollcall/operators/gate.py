"""O-07: only events of existing, active students take effect.

The roster is a dimension: a semi-join, whose form Spark picks by the roster's size in
bytes (a broadcast below the threshold, else a sort-merge join, which AQE splits where a
student has very many events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_ids(students: DataFrame) -> DataFrame:
    return students.where(F.col("is_active")).select("student_id")


def gate_active(events: DataFrame, students: DataFrame) -> DataFrame:
    """Accepted events: those whose student exists and is active (a
    semi-join; Spark picks its form by the roster's size in bytes)."""
    return events.join(active_ids(students), "student_id", "left_semi")


def gate_rejects(events: DataFrame, students: DataFrame) -> DataFrame:
    """Refused events with their reason (missing or inactive student)."""
    return (events.join(active_ids(students), "student_id", "left_anti")
            .withColumn("reject_reason", F.lit("student_unknown")))

"""Sinks: CSV export (O-06) and session partitions (versions: ``day_table``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_cell(col) -> "F.Column":
    """One CSV cell as the dashboard writes it: always quoted, quotes doubled,
    NULL -> ``""``."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """The export as text lines: an unquoted header of the column names,
    then one line per row with every value quoted.  Rows follow
    ``order_by`` (a distributed range sort); the header sorts first."""
    order_by = order_by or []
    cols = df.columns
    body = df.select(F.lit(1).alias("_part"), *order_by,
                     F.concat_ws(",", *[csv_cell(c) for c in cols]).alias("value"))
    header = df.sparkSession.createDataFrame([(0, ",".join(cols))], "_part int, value string")
    both = header.unionByName(body, allowMissingColumns=True)
    return both.orderBy("_part", *[F.col(c).asc_nulls_last() for c in order_by]).select("value")


def format_report(report: DataFrame) -> DataFrame:
    """Report values as the server sends them: hours with two decimals,
    dates as YYYY-MM-DD."""
    return report.select(
        "student_id", "full_name", "subteam", "days_clocked_in",
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
        F.format_string("%.2f", F.col("hours_total")).alias("hours_total"))


def export_report_csv(report: DataFrame, path: str) -> str:
    """O-06: write the attendance report as CSV text under ``path``
    (name order, header first).  Returns ``path``."""
    lines = csv_lines(format_report(report), order_by=["full_name", "student_id"])
    lines.write.mode("errorifexists").text(path)
    return path


def overwrite_session_days(sessions: DataFrame, path: str) -> None:
    """Rewrite only the ``meeting_date`` partitions present in ``sessions``
    (dynamic partition overwrite): how late corrections reach a session
    table that is partitioned by day."""
    (sessions.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("meeting_date").parquet(path))

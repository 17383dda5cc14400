"""Positions of rows in a global order (O-01, O-02, O-33, O-36, O-37).

A position over a whole table is no window over it, which would be one task.  Rows are
dealt to tasks by ranges of the order and sorted there; that table is written, each row
with its place within its task.  The tasks' row counts, summed up in the order of the
ranges, tell where each task begins.  Positions within a group (a comment's place in its
task's feed) are differences to the group's first global position, so that a group of any
size is dealt to as many tasks as it fills.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

_IN_TASK = (1 << 33) - 1        # monotonically_increasing_id: the lower 33 bits count a task's rows


def with_position(df: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with a ``position`` from 1 in ``order``, or in its group of columns ``within``
    (the order then starts with these columns).  The order should end with a key; rows
    that are equal in it get positions next to each other."""
    spark = df.sparkSession
    if within:
        order = [*[F.col(c).asc_nulls_first() for c in within], *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Ranges come from a sample and may fall otherwise when the job runs again; the table
    # holds on to them.
    rows = staged(dealt.withColumn("_task", F.spark_partition_id())
                  .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))), "positions")
    counts = sorted((r["_task"], r["n"]) for r in rows.groupBy("_task").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = accumulate((n for _, n in counts), initial=0)
    # One row per task of the range exchange: ``parts`` rows at most.
    first = spark.createDataFrame([(t, s) for (t, _), s in zip(counts, starts)], "_task int, _start long")
    out = rows.join(F.broadcast(first), "_task").withColumn(name, F.col("_start") + F.col("_place") + 1)
    if within:
        base = out.groupBy(*within).agg((F.min(name) - 1).alias("_base"))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in within]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        out = (out.alias("o").join(base.alias("b"), cond)
               .select(*[F.col(f"o.{c}") for c in df.columns], (F.col(f"o.{name}") - F.col("b._base")).alias(name)))
    return out.select(*df.columns, name)

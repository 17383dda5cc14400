"""Unique names under a log of claims (O-64): who may take which name, and when.

Student names are unique.  An edit that would take a name which another student has at
that moment is refused as a whole; a name is free again from the moment its holder takes
another one.  Played one by one this is a loop over the log.  Here it goes in rounds, each
of which settles every claim whose outcome is already certain:

* a name that is held can't change hands before its holder's first unsettled claim, so
  every earlier claim of others is refused;
* a name that is free goes to the earliest claim on it, if that is also the first
  unsettled claim of its student;
* a student who claims the name they have keeps it.

The earliest claim of all is always certain, so the rounds end.  There are as many as the
longest chain of names passed on from one student to the next, however many claims there
are; a name that a third of all claims want is settled by two joins, not claim by claim.
Every round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

MERGE_EVERY = 16        # rounds whose settled claims are put into one table

KEY = ["student_id", "name", "at", "seq"]


def settle_claims(holders: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims (student_id, name, at, seq) with a column ``granted``.

    ``holders``: (name, holder), the unique names at the start.  Claims take effect in the
    order of ``(at, seq)``, then student and name; equal rows are one claim."""
    when = F.struct("at", "seq", "student_id", "name")
    open_ = staged(claims.select(*KEY).distinct(), "name-claims")
    wanted = open_.select("name").distinct()
    held = staged(holders.join(wanted, "name", "left_semi"), "name-holders")
    settled: list[DataFrame] = []
    while True:
        rows = open_.withColumn("ord", when)
        of_student = rows.groupBy("student_id").agg(F.min("ord").alias("first"))
        of_name = rows.groupBy("name").agg(F.min("ord").alias("first_on_name"))
        j = (rows.join(held, "name", "left")
             .join(of_name, "name")
             .join(of_student, "student_id")
             .join(of_student.select(F.col("student_id").alias("holder"), F.col("first").alias("holder_moves")), "holder", "left"))
        own, free = F.col("holder") == F.col("student_id"), F.col("holder").isNull()
        is_first = F.col("ord") == F.col("first")
        granted = (F.when(free & is_first & (F.col("ord") == F.col("first_on_name")), F.lit(True))
                   .when(own & is_first, F.lit(True))
                   .when(~free & ~own & (F.col("holder_moves").isNull() | (F.col("ord") < F.col("holder_moves"))), F.lit(False)))
        judged = staged(j.select(*KEY, granted.alias("granted"), free.alias("moves")), "name-claims")
        settled.append(judged.where(F.col("granted").isNotNull()).select(*KEY, "granted"))
        open_ = judged.where(F.col("granted").isNull()).select(*KEY)
        if open_.isEmpty():
            break
        movers = judged.where(F.col("granted") & F.col("moves")).select(F.col("student_id").alias("holder"), "name")
        held = staged(held.join(movers.select("holder"), "holder", "left_anti").select("name", "holder")
                      .unionByName(movers.select("name", "holder")), "name-holders")
        if len(settled) == MERGE_EVERY:
            settled = [staged(_all(settled), "name-settled")]
    return _all(settled)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out

"""Roster scans and maintenance (O-01, O-02, O-05, O-64..O-66)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim
from .name_claims import settle_claims
from .sessions import last_write


def roster_active(students: DataFrame) -> DataFrame:
    """O-01: active students for the sign-in list (sort at the sink)."""
    return students.where(F.col("is_active")).select("student_id", "full_name", "subteam")


def roster_all(students: DataFrame) -> DataFrame:
    """O-02: every student with the active flag."""
    return students.select("student_id", "full_name", "subteam", "is_active")


# ------------------------------------------------------------ maintenance


ID_MASK = 0x7FFFFFFFFFFFFFFF


def new_student_id(full_name) -> Column:
    """Spark has no sequences: a new student's id is a 63-bit hash of the
    (unique) name -- deterministic, computed where the row lives, and
    independent of how many other names arrive in the same batch."""
    return F.xxhash64(full_name).bitwiseAND(F.lit(ID_MASK))


def roster_upsert(students: DataFrame, requests: DataFrame, reactivate: bool = False):
    """O-66 (``reactivate=False``) and the seed load O-05
    (``reactivate=True``), contract C-4.

    Requests ``(at, seq, full_name, subteam)`` are collapsed per trimmed name
    (last one wins), then full-outer-joined to the roster by name: a new name
    is inserted (active); an existing one gets the requested subteam and,
    for the seed, is reactivated.  Returns ``(roster, rejects)``; the roster
    is a new snapshot -- write it to a new path.

    As in the source's handler, only a missing or empty name is refused; a
    name of spaces passes the check and is stored trimmed ('').  Likewise a
    missing or empty subteam becomes NULL, while one of spaces is stored
    trimmed ('')."""
    raw = F.col("full_name")
    missing = raw.isNull() | (raw == "")
    rejects = requests.where(missing).withColumn("reject_reason", F.lit("name_missing"))
    ok = requests.where(~missing).withColumn("full_name", js_trim(raw))
    st = F.col("subteam")
    sub = F.when(st.isNotNull() & (st != ""), js_trim(st))
    last = ok.groupBy("full_name").agg(
        last_write(F.lit(True), sub).alias("_req_subteam"),
        F.min("at").alias("_first_at"))
    cur = students.select("student_id", "full_name", "subteam", "is_active", "created_at")
    j = cur.join(last, "full_name", "full_outer")
    is_new = F.col("student_id").isNull()
    hit = F.col("_first_at").isNotNull()
    roster = j.select(
        F.when(is_new, new_student_id(F.col("full_name"))).otherwise(F.col("student_id"))
         .alias("student_id"),
        "full_name",
        F.when(hit, F.col("_req_subteam")).otherwise(F.col("subteam")).alias("subteam"),
        (F.when(is_new, F.lit(True)).when(hit, F.lit(True) if reactivate else F.col("is_active"))
         .otherwise(F.col("is_active"))).alias("is_active"),
        F.when(is_new, F.col("_first_at")).otherwise(F.col("created_at")).alias("created_at"),
        is_new.alias("is_new"))
    return roster, rejects


def judge_patches(students: DataFrame, patches: DataFrame) -> DataFrame:
    """The patches with a ``reject_reason``: ``student_unknown``, or ``name_taken`` where
    another student has the (trimmed) name when the patch comes."""
    name = js_trim(F.col("full_name"))
    rows = patches.join(students.select("student_id", F.lit(True).alias("_known")), "student_id", "left")
    claims = rows.where(F.col("_known") & (F.coalesce(name, F.lit("")) != "")).select("student_id", name.alias("name"), "at", "seq")
    holders = students.select(F.col("full_name").alias("name"), F.col("student_id").alias("holder"))
    refused = settle_claims(holders, claims).where(~F.col("granted")).select("student_id", F.col("name").alias("_name"), "at", "seq", F.lit(True).alias("_taken"))
    return (rows.withColumn("_name", name).join(refused, ["student_id", "_name", "at", "seq"], "left")
            .withColumn("reject_reason", F.when(F.col("_known").isNull(), F.lit("student_unknown"))
                        .when(F.col("_taken"), F.lit("name_taken")))
            .select(*patches.columns, "reject_reason"))


def roster_patch(students: DataFrame, patches: DataFrame):
    """O-64/O-65: per student id, the latest non-empty trimmed name, the
    latest non-NULL subteam (an empty string is kept as ''), the latest
    non-NULL active flag.  A patch of an unknown id is rejected, and so is one
    that names a student as another is named at that time: names are unique,
    and a refused patch changes nothing (``name_claims``).  Returns
    ``(roster, rejects)``."""
    judged = judge_patches(students, patches)
    ok = judged.where(F.col("reject_reason").isNull())
    name = js_trim(F.col("full_name"))
    per = ok.groupBy("student_id").agg(
        last_write(F.coalesce(name, F.lit("")) != "", name).alias("_name"),
        last_write(F.col("subteam").isNotNull(), F.col("subteam")).alias("_subteam"),
        last_write(F.col("is_active").isNotNull(), F.col("is_active")).alias("_active"))
    rejects = judged.where(F.col("reject_reason").isNotNull())
    j = students.join(per, "student_id", "left")
    roster = j.select(
        "student_id",
        F.coalesce("_name", "full_name").alias("full_name"),
        F.coalesce("_subteam", "subteam").alias("subteam"),
        F.coalesce("_active", "is_active").alias("is_active"),
        "created_at")
    return roster, rejects

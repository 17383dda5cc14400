"""Roster maintenance (O-05, O-64..O-66) and audits (O-61..O-63)."""

from conftest import T, by_key, students_df
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import audits as au
from rollcall.operators import roster as ro

STUDENTS = [(1, "Ada Quill", "Build", True), (2, "Bo Fenn", None, False)]


def changes(spark, rows):
    return spark.createDataFrame(rows, schemas.ROSTER_CHANGES)


def test_upsert_by_name(spark):
    st = students_df(spark, STUDENTS)
    req = changes(spark, [(T("2024-02-01"), 1, None, " Bo Fenn ", "  ", None),
                          (T("2024-02-01"), 2, None, "Cy Moor", "CAD/CAM", None),
                          (T("2024-02-02"), 3, None, "Cy Moor", "Programming", None),
                          (T("2024-02-02"), 4, None, "", "Build", None),
                          (T("2024-02-02"), 5, None, None, "Build", None)])
    r, rej = ro.roster_upsert(st, req)
    got = by_key(r, "full_name")
    # a subteam of spaces is stored trimmed (''), not as NULL
    assert got[("Bo Fenn",)]["subteam"] == "" and got[("Bo Fenn",)]["is_active"] is False
    assert got[("Cy Moor",)]["subteam"] == "Programming" and got[("Cy Moor",)]["is_new"]
    assert got[("Cy Moor",)]["student_id"] > 0
    assert got[("Ada Quill",)]["subteam"] == "Build"
    assert [x["reject_reason"] for x in rej.collect()] == ["name_missing"] * 2
    spaced, _ = ro.roster_upsert(st, changes(spark, [(T("2024-02-03"), 6, None, "   ", "", None)]))
    blank = by_key(spaced, "full_name")[("",)]
    assert blank["is_new"] and blank["subteam"] is None
    seeded = by_key(ro.roster_upsert(st, req, reactivate=True)[0], "full_name")
    assert seeded[("Bo Fenn",)]["is_active"] is True


def test_patch(spark):
    st = students_df(spark, STUDENTS)
    p = changes(spark, [(T("2024-02-01"), 1, 1, "  ", "", None),
                        (T("2024-02-01"), 2, 2, " Bo Fenwick ", None, True),
                        (T("2024-02-02"), 3, 2, None, None, None),
                        (T("2024-02-01"), 4, 7, "X", None, None)])
    r, rej = ro.roster_patch(st, p)
    got = by_key(r, "student_id")
    assert got[(1,)]["full_name"] == "Ada Quill" and got[(1,)]["subteam"] == ""
    assert got[(2,)]["full_name"] == "Bo Fenwick" and got[(2,)]["is_active"] is True
    assert [x["student_id"] for x in rej.collect()] == [7]


def test_audits(spark):
    st = students_df(spark, STUDENTS + [(3, "Ada Quill", None, True)])
    tasks = spark.createDataFrame([(10, "T", "Build", "weird", "", False, T("2024-01-01"),
                                    T("2024-01-01"))], schemas.TASKS)
    a = spark.createDataFrame([(1, 10, 1, T("2024-01-01"), None), (2, 10, 1, T("2024-01-02"), None),
                               (3, 11, 9, T("2024-01-02"), None)], schemas.TASK_ASSIGNMENTS)
    tables = {"students": st, "tasks": tasks, "task_assignments": a}
    u = {(r["table_name"], r["key_columns"], r["key_value"]) for r in au.audit_unique(tables).collect()}
    assert u == {("students", "full_name", "Ada Quill"), ("task_assignments", "task_id,student_id", "10,1")}
    fk = {(r["fk_column"], r["fk_value"]) for r in au.audit_fk(tables).collect()}
    assert fk == {("task_id", 11), ("student_id", 9)}
    dom = [(r["column_name"], r["bad_value"]) for r in au.audit_domain(tables).collect()]
    assert dom == [("status", "weird")]
    fixed = au.repair_fk(tables)
    assert sorted(r["id"] for r in fixed["task_assignments"].collect()) == [1, 2]


def test_many_keys_are_counted_in_parts(spark, monkeypatch):
    """No task counts more than about ``KEYS`` keys, however few bytes they pack into."""
    monkeypatch.setattr(au, "KEYS", 1 << 10)
    monkeypatch.setattr(au, "HOT", 1 << 11)
    n, often = 20_000, 5_000
    ids = (spark.range(n).union(spark.range(7)).union(spark.range(often).selectExpr("9L as id"))
           .union(spark.range(3).selectExpr("cast(null as long) as id")))
    counts = au._key_counts(ids, ["id"], ids)
    held = [r["k"] for r in counts.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("k")).collect()]
    assert sum(held) == n + 1 and max(held) < 2 << 10
    got = {(r["key_value"], r["n_rows"]) for r in au.duplicate_keys(ids, "t", ["id"]).collect()}
    assert got == {(str(k), 2) for k in range(7)} | {("9", often + 1), ("∅", 3)}

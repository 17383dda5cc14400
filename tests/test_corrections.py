"""Corrections (O-15, O-45..O-47, O-12/O-34) and manual entry (O-48/O-49)."""

import datetime as dt

from conftest import D, T, by_key, punches_df, students_df

from rollcall import schemas
from rollcall.operators import corrections as corr
from rollcall.operators import sessions as ses

STUDENTS = [(1, "Ada Quill", "Build", True), (2, "Bo Fenn", None, False)]


def requests(spark, rows):
    return spark.createDataFrame(rows, schemas.CORRECTION_REQUESTS)


def test_validation_rules_in_order(spark):
    st = students_df(spark, STUDENTS)
    c = T("2024-01-10 12:00")
    rows = [
        (1, 1, "2024-01-08", "17:00", None, "forgot", c),
        (2, None, "2024-01-08", "17:00", None, "forgot", c),
        (3, 1, "2024-1-8", "17:00", None, "forgot", c),
        (4, 1, "2024-01-08", "5pm", None, "forgot", c),
        (5, 1, "2024-01-08", "17:00", "7:30", "forgot", c),
        (6, 1, "2024-01-08", "17:00", "", "  x ", c),
        (7, 2, "2024-01-08", "17:00", None, "forgot", c),
        (8, 1, "2026-02-30", "17:00", None, "forgot", c),
        (9, 1, "2024-01-08", "99:99", None, "forgot", c),
        (10, 1, "2024-01-08", "24:00", "", "  forgot  ", c),
    ]
    valid, rejects = corr.validate_corrections(requests(spark, rows), st)
    rej = {r["id"]: r["reject_reason"] for r in rejects.collect()}
    assert rej == {2: "student_missing", 3: "meeting_date_format",
                   4: "clock_in_format", 5: "clock_out_format",
                   6: "reason_too_short", 7: "student_unknown",
                   8: "value_out_of_range",
                   9: "value_out_of_range"}
    ok = by_key(valid, "id")
    assert set(ok) == {(1,), (10,)}
    assert ok[(10,)]["requested_clock_out"] is None and ok[(10,)]["reason"] == "forgot"
    assert ok[(1,)]["status"] == "pending" and ok[(1,)]["meeting_date"] == D("2024-01-08")


def decisions(spark, rows):
    return spark.createDataFrame(rows, schemas.CORRECTION_DECISIONS)


def test_first_decision_wins_and_apply(spark):
    st = students_df(spark, STUDENTS)
    c = T("2024-01-10 12:00")
    valid, _ = corr.validate_corrections(requests(spark, [
        (1, 1, "2024-01-08", "17:00", "19:30", "forgot", c),
        (2, 1, "2024-01-09", "17:00", None, "forgot", c),
        (3, 1, "2024-01-09", "18:00", None, "forgot", c)]), st)
    dec = decisions(spark, [
        (1, T("2024-01-11 09:00"), 1, "Approved", "  fine  "),
        (1, T("2024-01-11 10:00"), 2, "denied", "no"),
        (2, T("2024-01-11 09:00"), 3, "denied", ""),
        (3, T("2024-01-11 09:00"), 4, "maybe", None),
        (9, T("2024-01-11 09:00"), 5, "approved", None),
        (3, T("2024-01-09 09:00"), 6, "approved", None),      # before the request existed
    ])
    final, rejects = corr.correction_decide(valid, dec)
    f = by_key(final, "id")
    assert f[(1,)]["status"] == "approved" and f[(1,)]["decision_note"] == "fine"
    assert f[(1,)]["decided_by"] == "mentor"
    assert f[(2,)]["status"] == "denied" and f[(2,)]["decision_note"] is None
    assert f[(3,)]["status"] == "pending" and f[(3,)]["decided_at"] is None
    rej = {r["seq"]: r["reject_reason"] for r in rejects.collect()}
    assert rej == {2: "already_approved",
                   4: "status_unknown",
                   5: "request_unknown", 6: "request_unknown"}
    ev = corr.correction_apply(final).collect()
    assert len(ev) == 1
    e = ev[0]
    assert e["kind"] == "set_both" and e["meeting_date"] == D("2024-01-08")
    assert e["set_in"] == T("2024-01-08 22:00") and e["set_out"] == T("2024-01-09 00:30")


def test_corrections_list_filters_and_top_k(spark):
    st = students_df(spark, STUDENTS)
    rows = [(i, 1 if i % 2 else 2, D("2024-01-08") + dt.timedelta(days=i % 3), "17:00", None,
             "forgot", "pending" if i % 4 else "approved",
             dt.datetime(2024, 1, 10) + dt.timedelta(minutes=i // 2), None, None, None)
            for i in range(1, 300)]
    corrs = spark.createDataFrame(rows, schemas.ATTENDANCE_CORRECTIONS)
    lst = corr.corrections_list(corrs, st, status="PENDING").collect()
    assert len(lst) == 200
    keys = [(r["created_at"], r["id"]) for r in lst]
    assert keys == sorted(keys, reverse=True)
    assert {r["status"] for r in lst} == {"pending"}
    assert "roster_subteam" in lst[0].asDict()
    allrows = corr.corrections_list(corrs, st, status="all", date="2024-01-09", limit=None)
    assert allrows.count() == sum(1 for r in rows if r[2] == D("2024-01-09"))


def manual(spark, rows):
    return spark.createDataFrame(rows, schemas.MANUAL_ENTRIES)


def test_manual_patch_vs_replace(spark):
    st = students_df(spark, STUDENTS)
    base = [dict(student_id=1, at=T("2024-01-08 22:00"), seq=1, kind="clock_in",
                 working_on="arm", subteam="Build"),
            dict(student_id=1, at=T("2024-01-09 00:00"), seq=2, kind="clock_out")]
    entry = [(1, T("2024-01-10 12:00"), 10, "2024-01-08", "16:00", "", "", "")]
    ev_p, _ = corr.manual_attendance(manual(spark, entry), st, "patch")
    ev_r, _ = corr.manual_attendance(manual(spark, entry), st, "replace")
    p = ses.daily_sessions(punches_df(spark, base).unionByName(ev_p), T("2024-01-11"))
    r = ses.daily_sessions(punches_df(spark, base).unionByName(ev_r), T("2024-01-11"))
    p, r = p.collect()[0], r.collect()[0]
    # patch: only the in time changes, the empty note clears working_on
    assert p["clock_in_at"] == T("2024-01-08 21:00") and p["clock_out_at"] == T("2024-01-09 00:00")
    assert p["working_on"] == "" and p["subteam"] == "Build"
    # replace: out overwritten by NULL (then auto-closed), working_on kept
    assert r["clock_in_at"] == T("2024-01-08 21:00")
    assert r["clock_out_at"] == T("2024-01-09 01:00")
    assert r["working_on"] == "arm"


def test_manual_rejects(spark):
    st = students_df(spark, STUDENTS)
    rows = [(2, T("2024-01-10"), 1, "2024-01-08", "16:00", "", None, None),
            (1, T("2024-01-10"), 2, "2024-01-08", "4pm", "", None, None),
            (1, T("2024-01-10"), 3, "2024-01-08", "", "", None, None)]
    ev, rej = corr.manual_attendance(manual(spark, rows), st, "patch")
    assert {r["seq"]: r["reject_reason"] for r in rej.collect()} == {
        1: "student_unknown", 2: "clock_in_format"}
    assert [r["kind"] for r in ev.collect()] == ["update"]
    _, rej_r = corr.manual_attendance(manual(spark, rows), st, "replace")
    assert {r["seq"] for r in rej_r.collect()} == {1, 2, 3}


def test_manual_entry_defaults_subteam_from_roster(spark):
    st = students_df(spark, STUDENTS)
    rows = [(1, T("2024-01-10"), 1, "2024-01-08", "16:00", "", None, None),
            (1, T("2024-01-10"), 2, "2024-01-09", "16:00", "", "", None)]
    ev, _ = corr.manual_attendance(manual(spark, rows), st, "patch")
    got = {r["seq"]: r["subteam"] for r in ev.collect()}
    assert got == {1: "Build", 2: ""}


def test_one_pass_over_requests_and_decisions(spark):
    """``settle_corrections`` gives what validation and decision give one after the other."""
    import random

    from pyspark.sql import functions as F

    from rollcall import schemas
    from rollcall.operators import corrections as corr
    rng = random.Random(4)
    st = students_df(spark, [(i, f"s{i}", None, i != 2) for i in range(4)])
    at = lambda: T("2024-01-10 12:00").replace(hour=rng.randrange(24), minute=rng.randrange(60))
    req = spark.createDataFrame([(i, rng.choice([None, 0, 1, 1, 3, 3, 2, 9]), rng.choice(["2024-01-09"] * 6 + ["2024-02-30", "x", None]), rng.choice(["09:00"] * 5 + ["99:99", None]),
                                  rng.choice([None, "", "18:00", "late"]), rng.choice(["forgot it"] * 5 + [" a ", None]), at()) for i in range(300)], schemas.CORRECTION_REQUESTS)
    dec = spark.createDataFrame([(rng.randrange(330), at(), k, rng.choice(["approved", "DENIED", "maybe", None]), rng.choice([" ok ", "", None])) for k in range(700)],
                                schemas.CORRECTION_DECISIONS)
    want = corr.correction_decide(corr.validate_corrections(req, st)[0], dec)[0]
    log = (req.select("id", F.lit(True).alias("is_request"), "student_id", "meeting_date", "requested_clock_in", "requested_clock_out", "reason", F.col("created_at").alias("at"))
           .unionByName(dec.select(F.col("correction_id").alias("id"), F.lit(False).alias("is_request"), "at", "seq", "status", "note"), allowMissingColumns=True))
    got = corr.settle_corrections(log, st).select(*want.columns)
    assert want.where("status <> 'pending'").count() > 5
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()

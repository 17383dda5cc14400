"""Contracts C-1 (session fold) and C-2 (auto-close) on tiny fixtures.
Winter dates: Eastern = UTC-5."""

import datetime as dt

from conftest import D, T, by_key, punches_df, students_df

from rollcall.functions.timez import eastern_date_of, local_to_utc
from rollcall.operators import attendance as att
from rollcall.operators import sessions as ses
from rollcall.operators.gate import gate_active, gate_rejects


def fold(spark, rows, as_of):
    return by_key(ses.daily_sessions(punches_df(spark, rows), as_of),
                  "student_id", "meeting_date")


def test_reclock_in_keeps_first_in_and_reopens(spark):
    rows = [
        dict(student_id=1, at=T("2024-01-10 20:00"), seq=1, kind="clock_in", working_on="a"),
        dict(student_id=1, at=T("2024-01-10 21:00"), seq=2, kind="clock_out"),
        dict(student_id=1, at=T("2024-01-10 22:00"), seq=3, kind="clock_in"),
    ]
    s = fold(spark, rows, T("2024-01-10 23:00"))[(1, D("2024-01-10"))]
    assert s["clock_in_at"] == T("2024-01-10 20:00")
    assert s["clock_out_at"] is None
    assert s["working_on"] == "a"
    assert s["updated_at"] == T("2024-01-10 22:00")
    # later, the re-opened session closes at first-in + 4 h
    s = fold(spark, rows, T("2024-01-11 03:00"))[(1, D("2024-01-10"))]
    assert s["clock_out_at"] == T("2024-01-11 00:00")


def test_out_without_in_is_not_clocked_in(spark):
    rows = [dict(student_id=1, at=T("2024-01-10 20:00"), seq=1, kind="clock_out")]
    s = ses.daily_sessions(punches_df(spark, rows), T("2024-01-11 00:00"))
    r = ses.session_states(s).collect()[0]
    assert r["status"] == "not_clocked_in"
    assert s.collect()[0]["clock_in_at"] is None


def test_explicit_out_after_auto_close_wins(spark):
    rows = [
        dict(student_id=1, at=T("2024-01-10 14:00"), seq=1, kind="clock_in"),
        dict(student_id=1, at=T("2024-01-10 23:30"), seq=2, kind="clock_out"),
    ]
    s = fold(spark, rows, T("2024-01-11 04:00"))[(1, D("2024-01-10"))]
    assert s["clock_out_at"] == T("2024-01-10 23:30")


def test_clock_out_after_eastern_midnight_lands_on_next_day(spark):
    rows = [
        dict(student_id=1, at=T("2024-01-10 23:00"), seq=1, kind="clock_in"),   # 18:00 EST
        dict(student_id=1, at=T("2024-01-11 05:30"), seq=2, kind="clock_out"),  # 00:30 EST next day
    ]
    out = fold(spark, rows, T("2024-01-11 12:00"))
    assert out[(1, D("2024-01-10"))]["clock_out_at"] == T("2024-01-11 03:00")   # auto-closed
    nxt = out[(1, D("2024-01-11"))]
    assert nxt["clock_in_at"] is None and nxt["clock_out_at"] == T("2024-01-11 05:30")


def test_auto_close_is_strict_at_four_hours(spark):
    rows = [dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in")]
    at4 = fold(spark, rows, T("2024-01-10 19:00"))[(1, D("2024-01-10"))]
    assert at4["clock_out_at"] is None
    after = fold(spark, rows, T("2024-01-10 19:00:00.000001"))[(1, D("2024-01-10"))]
    assert after["clock_out_at"] == T("2024-01-10 19:00")


def test_need_flags_and_times(spark):
    rows = [
        dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="need_help", value=True),
        dict(student_id=1, at=T("2024-01-10 15:05"), seq=2, kind="need_task", value=True),
        dict(student_id=1, at=T("2024-01-10 15:10"), seq=3, kind="need_help", value=True),
        dict(student_id=2, at=T("2024-01-10 15:00"), seq=4, kind="need_help", value=True),
        dict(student_id=2, at=T("2024-01-10 15:01"), seq=5, kind="need_help", value=False),
    ]
    out = fold(spark, rows, T("2024-01-10 16:00"))
    a = out[(1, D("2024-01-10"))]
    assert a["need_help"] and a["need_task"]
    assert a["need_help_at"] == T("2024-01-10 15:10")
    b = out[(2, D("2024-01-10"))]
    assert b["need_help"] is False and b["need_help_at"] is None


def test_empty_string_clears_working_on_but_not_subteam(spark):
    rows = [
        dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in",
             subteam="Build", working_on="gearbox"),
        dict(student_id=1, at=T("2024-01-10 15:10"), seq=2, kind="update",
             subteam="", working_on=""),
        dict(student_id=1, at=T("2024-01-10 15:20"), seq=3, kind="update",
             subteam=None, working_on=None),
    ]
    s = fold(spark, rows, T("2024-01-10 16:00"))[(1, D("2024-01-10"))]
    assert s["subteam"] == "Build"
    assert s["working_on"] == ""


def test_set_both_null_out_reopens_and_later_clock_in_keeps_set_in(spark):
    rows = [
        dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in"),
        dict(student_id=1, at=T("2024-01-10 16:00"), seq=2, kind="clock_out"),
        dict(student_id=1, at=T("2024-01-12 10:00"), seq=3, kind="set_both",
             meeting_date=D("2024-01-10"), set_in=T("2024-01-10 14:00"), set_out=None),
    ]
    s = fold(spark, rows, T("2024-01-12 11:00"))[(1, D("2024-01-10"))]
    assert s["clock_in_at"] == T("2024-01-10 14:00")
    # NULL write of the correction wins, then the 4-hour close applies
    assert s["clock_out_at"] == T("2024-01-10 18:00")


def test_negative_hours_in_report(spark):
    rows = [dict(student_id=1, at=T("2024-01-12 10:00"), seq=1, kind="set_both",
                 meeting_date=D("2024-01-10"), set_in=T("2024-01-10 20:00"),
                 set_out=T("2024-01-10 18:30"))]
    st = students_df(spark, [(1, "Ada Quill", "Build", True), (2, "Bo Fenn", None, True),
                             (3, "Cy Moor", None, False)])
    sessions = ses.daily_sessions(punches_df(spark, rows), T("2024-01-13 00:00"))
    rep = by_key(att.attendance_report(st, sessions, "2024-01-08", "2024-01-14"), "student_id")
    assert rep[(1,)]["hours_total"] == -1.5
    assert rep[(1,)]["days_clocked_in"] == 1
    assert rep[(2,)]["hours_total"] == 0.0 and rep[(2,)]["last_day"] is None
    assert (3,) not in rep


def test_report_rounds_half_away_from_zero(spark):
    # 1 h 0 min 18 s = 1.005 h exactly -> 1.01
    rows = [dict(student_id=1, at=T("2024-01-10 15:00:00"), seq=1, kind="clock_in"),
            dict(student_id=1, at=T("2024-01-10 16:00:18"), seq=2, kind="clock_out")]
    st = students_df(spark, [(1, "Ada Quill", "Build", True)])
    sessions = ses.daily_sessions(punches_df(spark, rows), T("2024-01-13 00:00"))
    rep = att.attendance_report(st, sessions, "2024-01-10", "2024-01-10").collect()[0]
    assert rep["hours_total"] == 1.01


def test_gate_rejects_inactive_and_unknown(spark):
    st = students_df(spark, [(1, "Ada Quill", None, True), (2, "Bo Fenn", None, False)])
    rows = [dict(student_id=i, at=T("2024-01-10 15:00"), seq=i, kind="clock_in")
            for i in (1, 2, 3)]
    p = punches_df(spark, rows)
    assert sorted(r["student_id"] for r in gate_active(p, st).collect()) == [1]
    rej = {r["student_id"]: r["reject_reason"] for r in gate_rejects(p, st).collect()}
    assert rej == {2: "student_unknown", 3: "student_unknown"}


def test_dst_gap_and_overlap(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 3, 8, 2, 30),), (dt.datetime(2026, 11, 1, 1, 30),),
                                (dt.datetime(2026, 7, 1, 12, 0),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(local_to_utc("t")).collect()]
    assert got == [dt.datetime(2026, 3, 8, 7, 30), dt.datetime(2026, 11, 1, 6, 30),
                   dt.datetime(2026, 7, 1, 16, 0)]
    assert eastern_date_of(T("2024-01-11 04:59")) == D("2024-01-10")


def test_status_board_and_tiles(spark):
    st = students_df(spark, [(1, "Ada Quill", "Build", True), (2, "Bo Fenn", "CAD/CAM", True),
                             (3, "Cy Moor", None, True), (4, "Di Vale", None, False)])
    rows = [
        dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in", subteam="Programming"),
        dict(student_id=2, at=T("2024-01-10 15:00"), seq=2, kind="clock_in"),
        dict(student_id=2, at=T("2024-01-10 16:00"), seq=3, kind="clock_out"),
        dict(student_id=2, at=T("2024-01-10 16:01"), seq=4, kind="need_help", value=True),
        dict(student_id=2, at=T("2024-01-10 16:02"), seq=5, kind="need_task", value=True),
        dict(student_id=3, at=T("2024-01-09 15:00"), seq=6, kind="clock_in"),
    ]
    board = att.status_board(st, punches_df(spark, rows), T("2024-01-10 17:00"))
    b = by_key(board, "student_id")
    assert set(b) == {(1,), (2,), (3,)}
    assert b[(1,)]["subteam"] == "Programming" and b[(1,)]["badge"] == "IN"
    assert b[(2,)]["status"] == "clocked_out" and b[(2,)]["subteam"] == "CAD/CAM"
    assert b[(3,)]["status"] == "not_clocked_in" and b[(3,)]["badge"] == "—"
    tiles = att.status_tiles(board).collect()[0].asDict()
    assert tiles == dict(clocked_in=1, clocked_out=1, not_clocked_in=1, need_help=1,
                         need_task=1, help_or_task=2)
    q = att.needs_queue(board).collect()
    assert sorted(r["kind"] for r in q) == ["help", "task"]


def test_student_history_keeps_newest_thirty(spark):
    rows = [dict(student_id=1, at=dt.datetime(2024, 1, 1, 15) + dt.timedelta(days=i), seq=i,
                 kind="clock_in") for i in range(35)]
    st = students_df(spark, [(1, "Ada Quill", None, False)])
    h = att.student_history(st, ses.daily_sessions(punches_df(spark, rows), T("2024-03-01")))
    dates = sorted(r["meeting_date"] for r in h.collect())
    assert len(dates) == 30 and dates[0] == D("2024-01-06")


def test_results_do_not_depend_on_session_time_zone(spark):
    rows = [dict(student_id=1, at=T("2024-01-11 04:30"), seq=1, kind="clock_in"),   # 23:30 EST
            dict(student_id=1, at=T("2024-03-10 06:30"), seq=2, kind="clock_in"),   # 01:30 EST
            dict(student_id=1, at=T("2024-11-03 05:30"), seq=3, kind="clock_in")]   # 01:30 EST
    st = students_df(spark, [(1, "Ada Quill", None, True)])

    def run():
        s = ses.daily_sessions(punches_df(spark, rows), T("2024-12-01"))
        rep = att.attendance_report(st, s, "2024-01-01", "2024-12-31")
        return sorted(map(tuple, s.collect())), sorted(map(tuple, rep.collect()))

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        base = run()
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert run() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    days = [r[1] for r in base[0]]
    assert days == [D("2024-01-10"), D("2024-03-10"), D("2024-11-03")]

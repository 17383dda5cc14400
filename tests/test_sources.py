"""Sources with declared schemas, additive evolution (O-03/O-04) and the
per-day session partition overwrite."""

import datetime as dt
import uuid

from conftest import T, punches_df, students_df

from rollcall import schemas
from rollcall.operators import attendance as att
from rollcall.operators import sessions as ses
from rollcall.session import checkpoint_root
from rollcall.sources import sinks, tables


def fresh(spark, name):
    return f"{checkpoint_root(spark).rstrip('/')}/rollcall-test-{name}-{uuid.uuid4().hex}"


def test_conform_adds_evolved_columns_with_defaults(spark):
    old = spark.createDataFrame(
        [(1, "Arm", "Build", "todo", T("2024-01-01"), T("2024-01-01"))],
        "id long, title string, subteam string, status string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz")
    root = fresh(spark, "tables")
    old.write.parquet(f"{root}/tasks.parquet")
    t = tables.load_tables(spark, root, ["tasks"])["tasks"]
    assert t.schema == schemas.TASKS or [f.name for f in t.schema] == schemas.TASKS.names
    r = t.collect()[0]
    assert r["archived"] is False and r["description"] == ""


def test_read_table_uses_declared_schema(spark):
    df = tables.read_table(spark, "/root/testdata/sf0.001", "events")
    assert df.schema.simpleString() == (
        "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,"
        "value:double,props:string>")


def test_overwrite_session_days_replaces_only_touched_days(spark):
    rows = [dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in"),
            dict(student_id=1, at=T("2024-01-11 15:00"), seq=2, kind="clock_in")]
    path = fresh(spark, "sessions")
    s = ses.daily_sessions(punches_df(spark, rows), T("2024-01-12"))
    sinks.overwrite_session_days(s, path)
    late = rows + [dict(student_id=1, at=T("2024-01-12 10:00"), seq=3, kind="set_out",
                        meeting_date=dt.date(2024, 1, 10), set_out=T("2024-01-10 16:00"))]
    fixed = ses.daily_sessions(punches_df(spark, late), T("2024-01-12 11:00")).where(
        "meeting_date = date'2024-01-10'")
    sinks.overwrite_session_days(fixed, path)
    got = {r["meeting_date"]: r["clock_out_at"] for r in spark.read.parquet(path).collect()}
    assert got == {dt.date(2024, 1, 10): T("2024-01-10 16:00"),
                   dt.date(2024, 1, 11): T("2024-01-11 19:00")}


def test_tiles_by_subteam(spark):
    st = students_df(spark, [(1, "Ada Quill", "Build", True), (2, "Bo Fenn", "Build", True),
                             (3, "Cy Moor", None, True)])
    rows = [dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in")]
    board = att.status_board(st, punches_df(spark, rows), T("2024-01-10 16:00"))
    t = {r["subteam"]: (r["clocked_in"], r["not_clocked_in"])
         for r in att.status_tiles(board, by_subteam=True).collect()}
    assert t == {"Build": (1, 1), None: (0, 1)}


def test_stored_session_table_prunes_days_and_matches(spark):
    from rollcall.plans.inputs import Inputs
    from rollcall.sources import views as V
    sf = "/root/testdata/sf0.001"
    i = Inputs.of(spark, sf)
    path = ses.store_sessions(i.all_punches, fresh(spark, "stored"))
    stored = ses.load_sessions(spark, path, V.ATTENDANCE_AS_OF, V.REPORT_START, V.REPORT_END)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(meeting_date" in plan
    direct = ses.sessions_for_days(i.all_punches, V.REPORT_START, V.REPORT_END,
                                   V.ATTENDANCE_AS_OF)
    a = att.attendance_report(i.students, stored, V.REPORT_START, V.REPORT_END)
    b = att.attendance_report(i.students, direct, V.REPORT_START, V.REPORT_END)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

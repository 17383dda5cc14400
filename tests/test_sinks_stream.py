"""CSV export (O-06), season rollover (O-67) and the streaming fold."""

import datetime as dt
import glob
import os
import uuid

import pytest
from conftest import T, punches_df, students_df

from rollcall.operators import rollover
from rollcall.operators import sessions as ses
from rollcall.session import checkpoint_root
from rollcall.sources import sinks
from rollcall.streaming.sessions_stream import run_session_stream


def fresh(spark, name):
    return f"{checkpoint_root(spark).rstrip('/')}/rollcall-test-{name}-{uuid.uuid4().hex}"


def test_csv_export_quotes_everything(spark):
    rep = spark.createDataFrame(
        [(2, 'Bo "B" Fenn', None, 0, None, 0.0), (1, "Ada, Quill", "Build", 3,
                                                  dt.date(2024, 1, 9), 7.5)],
        "student_id long, full_name string, subteam string, days_clocked_in long, "
        "last_day date, hours_total double")
    path = sinks.export_report_csv(rep, fresh(spark, "csv"))
    lines = []
    for f in sorted(glob.glob(os.path.join(path, "part-*"))):
        lines += open(f).read().splitlines()
    assert lines == [
        "student_id,full_name,subteam,days_clocked_in,last_day,hours_total",
        '"1","Ada, Quill","Build","3","2024-01-09","7.50"',
        '"2","Bo ""B"" Fenn","","0","","0.00"',
    ]


def test_rollover_guards_and_copy(spark):
    st = students_df(spark, [(1, "Ada Quill", None, True)])
    root = fresh(spark, "season")
    with pytest.raises(rollover.RolloverRefused):
        rollover.season_rollover(spark, st, root, "2025", "RESET", allowed=False)
    with pytest.raises(rollover.RolloverRefused):
        rollover.season_rollover(spark, st, root, "2025", "reset", allowed=True)
    base = rollover.season_rollover(spark, st, root, "2025", "RESET", allowed=True)
    assert rollover.current_season(spark, root) == base
    assert spark.read.parquet(f"{base}/students").count() == 1
    assert spark.read.parquet(f"{base}/daily_sessions").count() == 0
    with pytest.raises(rollover.RolloverRefused):
        rollover.season_rollover(spark, st, root, "2025", "RESET", allowed=True)
    again = rollover.season_rollover(spark, st, root, "2026", "RESET", allowed=True)
    assert rollover.current_season(spark, root) == again
    assert spark.read.parquet(f"{base}/students").count() == 1      # the old season stays


def test_stream_equals_batch_on_closed_days(spark):
    rows = []
    seq = 0
    for day in range(5):
        for sid in (1, 2):
            seq += 1
            start = dt.datetime(2024, 1, 8, 22) + dt.timedelta(days=day, minutes=sid)
            rows.append(dict(student_id=sid, at=start, seq=seq, kind="clock_in", working_on="w"))
            seq += 1
            rows.append(dict(student_id=sid, at=start + dt.timedelta(hours=2), seq=seq,
                             kind="clock_out"))
    src = fresh(spark, "src")
    punches_df(spark, rows).coalesce(1).write.parquet(src)
    from rollcall import schemas
    stream = spark.readStream.schema(schemas.PUNCHES).parquet(src)
    run = fresh(spark, "stream")
    run_session_stream(spark, stream, f"{run}/sink", f"{run}/ckpt")
    got = spark.read.parquet(f"{run}/sink")
    batch = ses.session_fold(punches_df(spark, rows))
    # the last day(s) are still inside the watermark delay
    assert got.count() >= 6
    assert got.select(*batch.columns).exceptAll(batch).count() == 0
    assert batch.where("meeting_date <= date'2024-01-10'").exceptAll(
        got.select(*batch.columns)).count() == 0


def test_correction_stream_refreshes_only_touched_days(spark):
    from rollcall import schemas
    from rollcall.streaming.corrections_stream import run_correction_stream
    rows = [dict(student_id=1, at=T("2024-01-10 15:00"), seq=1, kind="clock_in"),
            dict(student_id=1, at=T("2024-01-10 16:00"), seq=2, kind="clock_out"),
            dict(student_id=2, at=T("2024-01-11 15:00"), seq=3, kind="clock_in"),
            dict(student_id=2, at=T("2024-01-11 17:00"), seq=4, kind="clock_out")]
    punch_log, set_log = fresh(spark, "punch-log"), fresh(spark, "set-log")
    sessions_path = fresh(spark, "sessions")
    punches_df(spark, rows).write.parquet(punch_log)
    from rollcall.sources.sinks import overwrite_session_days
    overwrite_session_days(ses.session_fold(punches_df(spark, rows)), sessions_path)
    # an empty set-event log to start from
    spark.createDataFrame([], schemas.PUNCHES).write.parquet(set_log)
    late = [dict(student_id=1, at=T("2024-01-12 09:00"), seq=10, kind="set_both",
                 meeting_date=dt.date(2024, 1, 10), set_in=T("2024-01-10 14:00"),
                 set_out=T("2024-01-10 18:00")),
            dict(student_id=3, at=T("2024-01-12 09:05"), seq=11, kind="set_in",
                 meeting_date=dt.date(2024, 1, 9), set_in=T("2024-01-09 22:00"))]
    src = fresh(spark, "late")
    punches_df(spark, late).write.parquet(src)
    run = fresh(spark, "corr-stream")
    stream = spark.readStream.schema(schemas.PUNCHES).parquet(src)
    run_correction_stream(spark, stream, punch_log, set_log, sessions_path, f"{run}/ckpt")
    got = spark.read.parquet(sessions_path)
    want = ses.session_fold(punches_df(spark, rows + late))
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert want.exceptAll(got.select(*want.columns)).count() == 0

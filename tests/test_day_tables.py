"""Day tables commit at once; the day stream keeps late punches; both equal the batch fold."""

import datetime as dt
import random
import uuid

import pytest
from conftest import T, punches_df

from rollcall import schemas
from rollcall.operators import sessions as ses
from rollcall.session import checkpoint_root
from rollcall.sources.day_table import DayTable
from rollcall.streaming.session_days import SessionDays


def fresh(spark, name):
    return f"{checkpoint_root(spark).rstrip('/')}/rollcall-test-{name}-{uuid.uuid4().hex}"


def same(a, b):
    a = a.select(*b.columns)
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def log(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = dt.datetime(2024, 1, 5) + dt.timedelta(minutes=rng.randrange(12 * 24 * 60))
        kind = rng.choice(["clock_in", "clock_out", "update", "need_help", "set_both"])
        out.append(dict(student_id=rng.randrange(6), at=at, seq=k, kind=kind, working_on=rng.choice([None, "", "w"]), value=rng.random() < 0.5,
                        task_id=rng.choice([None, 3]), meeting_date=(at - dt.timedelta(days=3)).date() if kind == "set_both" else None,
                        set_in=at - dt.timedelta(days=3) if kind == "set_both" else None))
    return out


def test_days_change_together(spark):
    table = DayTable(spark, fresh(spark, "days"), schemas.DAILY_SESSIONS)
    assert table.read().count() == 0 and table.newest().number == 0
    rows = log(1, 200)
    first = ses.session_fold(punches_df(spark, rows[:150]))
    table.replace(first)
    same(table.read(), first)
    base = table.newest()
    second = ses.session_fold(punches_df(spark, rows))
    prepared = table.prepare(second, base)
    same(table.read(), first)                                  # a reader between the two steps
    table.commit(base, prepared, replaced=None, epoch=7, seen_until=T("2024-01-09 00:00"))
    same(table.read(), second)
    same(table.read(version=1), first)                         # the old version stays
    assert (table.newest().epoch, table.newest().seen_until) == (7, T("2024-01-09 00:00"))
    day = dt.date(2024, 1, 9)
    same(table.read(day, day), second.where("meeting_date = date'2024-01-09'"))
    one = second.where("meeting_date = date'2024-01-09' AND student_id = 1")
    table.replace(one, replaced=[day, dt.date(2024, 1, 10)])   # a day replaced by fewer rows, one by none
    same(table.read(), second.where("meeting_date NOT IN (date'2024-01-09', date'2024-01-10')").unionByName(one))


def test_reads_only_the_days_asked_for(spark):
    table = DayTable(spark, fresh(spark, "days"), schemas.DAILY_SESSIONS)
    table.replace(ses.session_fold(punches_df(spark, log(2, 100))))
    files = table.read(dt.date(2024, 1, 9), dt.date(2024, 1, 10)).inputFiles()
    assert files and all("meeting_date=2024-01-09" in f or "meeting_date=2024-01-10" in f for f in files)


def test_a_lost_race_fails(spark):
    table = DayTable(spark, fresh(spark, "days"), schemas.DAILY_SESSIONS)
    rows = ses.session_fold(punches_df(spark, log(3, 50)))
    base = table.newest()
    mine, theirs = table.prepare(rows, base), table.prepare(rows.limit(3), base)
    table.commit(base, theirs, None)
    with pytest.raises(Exception, match="already exists"):
        table.commit(base, mine, None)
    assert table.read().count() == 3


def test_late_punches_over_restarts(spark):
    rows = log(4, 300)
    src, root = fresh(spark, "src"), fresh(spark, "stream")
    for k, part in enumerate((rows[:100], rows[100:200], rows[200:])):     # every restart finds old and new days
        punches_df(spark, part).repartition(2).write.mode("append").parquet(src)
        days = SessionDays(spark, root)
        days.drain(spark.readStream.schema(schemas.PUNCHES).option("maxFilesPerTrigger", 1).parquet(src))
        same(days.sessions.read(), ses.session_fold(punches_df(spark, rows[: 100 * (k + 1)])))
    late = days.late()
    assert late.count() > 20 and late.select("epoch").distinct().count() >= 3


def test_an_epoch_run_again(spark):
    rows = log(5, 120)
    days = SessionDays(spark, fresh(spark, "again"))
    days.merge(punches_df(spark, rows[:60]), 0)
    days.merge(punches_df(spark, rows[60:]), 1)
    late = days.late()
    before = sorted(map(str, late.collect()))
    days.merge(punches_df(spark, rows[60:]), 1)
    same(days.sessions.read(), ses.session_fold(punches_df(spark, rows)))
    assert sorted(map(str, days.late().collect())) == before and before
    days.merge(punches_df(spark, []), 2)
    same(days.sessions.read(), ses.session_fold(punches_df(spark, rows)))

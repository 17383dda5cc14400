"""Property tests: the Spark folds against plain sequential interpreters of
the source system's request handlers, on random event logs (with ties in
time, NULL writes, re-opens and set-events), plus input-order invariance."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from conftest import punches_df

from rollcall import schemas
from rollcall.operators import sessions as ses
from rollcall.operators import tasks as tk

NY = ZoneInfo("America/New_York")
KINDS = ["clock_in", "clock_out", "update", "need_help", "need_task", "set_in", "set_out",
         "set_both"]


def eastern_date(at):
    return at.replace(tzinfo=dt.timezone.utc).astimezone(NY).date()


def interpret_sessions(events, as_of):
    """Apply the handlers one event at a time, in (at, seq) order."""
    rows = {}
    for e in sorted(events, key=lambda e: (e["at"], e["seq"])):
        if e["at"] > as_of:
            continue
        md = e.get("meeting_date") or eastern_date(e["at"])
        r = rows.setdefault((e["student_id"], md), dict(
            clock_in_at=None, clock_out_at=None, subteam=None, working_on="",
            need_help=False, need_help_at=None, need_task=False, need_task_at=None,
            task_id=None))
        r["updated_at"] = e["at"]
        k = e["kind"]
        if k == "clock_in":
            r["clock_in_at"] = r["clock_in_at"] or e["at"]
            r["clock_out_at"] = None
            if e.get("task_id") is not None:
                r["task_id"] = e["task_id"]
        elif k == "clock_out":
            r["clock_out_at"] = e["at"]
        elif k in ("need_help", "need_task"):
            v = bool(e.get("value"))
            r[k] = v
            r[k + "_at"] = e["at"] if v else None
        if k in ("set_in", "set_both"):
            r["clock_in_at"] = e["set_in"]
        if k in ("set_out", "set_both"):
            r["clock_out_at"] = e["set_out"]
        if e.get("subteam"):
            r["subteam"] = e["subteam"]
        if e.get("working_on") is not None:
            r["working_on"] = e["working_on"]
    for r in rows.values():
        if (r["clock_in_at"] is not None and r["clock_out_at"] is None
                and r["clock_in_at"] < as_of - dt.timedelta(hours=4)):
            r["clock_out_at"] = r["clock_in_at"] + dt.timedelta(hours=4)
    return rows


def random_log(rng, n_students=60):
    base = dt.datetime(2024, 1, 10, 12, 0)
    events, seq = [], 0
    for sid in range(n_students):
        t = base + dt.timedelta(minutes=rng.randint(0, 600))
        for _ in range(rng.randint(1, 14)):
            seq += 1
            if rng.random() > 0.2:               # 20 % of events share the previous time
                t = t + dt.timedelta(minutes=rng.randint(1, 240))
            k = rng.choice(KINDS)
            e = dict(student_id=sid, at=t, seq=rng.randint(0, 10 ** 6) * 1000 + seq, kind=k)
            if k in ("clock_in", "update", "set_in", "set_out", "set_both"):
                e["subteam"] = rng.choice([None, "", "Build", "Programming"])
                e["working_on"] = rng.choice([None, "", "arm", "drive"])
            if k == "clock_in":
                e["task_id"] = rng.choice([None, 7, 8])
            if k in ("need_help", "need_task"):
                e["value"] = rng.choice([True, False, None])
            if k.startswith("set_"):
                d = eastern_date(t) - dt.timedelta(days=rng.randint(0, 2))
                e["meeting_date"] = d
                start = dt.datetime.combine(d, dt.time(22, 0))
                e["set_in"] = start + dt.timedelta(minutes=rng.randint(0, 120))
                e["set_out"] = (None if k == "set_both" and rng.random() < 0.3
                                else start + dt.timedelta(minutes=rng.randint(-60, 300)))
            events.append(e)
    return events


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_session_fold_matches_sequential_handlers(spark, seed):
    rng = random.Random(seed)
    events = random_log(rng)
    as_of = dt.datetime(2024, 1, 12, 6, 0)
    want = interpret_sessions(events, as_of)
    shuffled = events[:]
    rng.shuffle(shuffled)
    df = punches_df(spark, shuffled).repartition(5)
    got = {(r["student_id"], r["meeting_date"]): r.asDict()
           for r in ses.daily_sessions(df, as_of).collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        for col, v in w.items():
            assert g[col] == v, (key, col, g[col], v)


def interpret_intervals(events):
    """join/assign/clock_in open (idempotent), leave closes (no-op if none)."""
    open_, out = {}, []
    for e in sorted(events, key=lambda e: (e["at"], e["seq"])):
        key = (e["task_id"], e["student_id"])
        if e["kind"] == "leave":
            if key in open_:
                out.append((*key, open_.pop(key), e["at"]))
        elif key not in open_:
            open_[key] = e["at"]
    out += [(*k, a, None) for k, a in open_.items()]
    return sorted(out, key=lambda x: (x[0], x[1], x[2]))


@pytest.mark.parametrize("seed", [4, 5])
def test_assignment_intervals_match_sequential_handlers(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    events = []
    for i in range(400):
        events.append(dict(task_id=rng.randint(1, 6), student_id=rng.randint(1, 8),
                           at=base + dt.timedelta(hours=rng.randint(0, 300)), seq=i,
                           kind=rng.choice(["join", "assign", "clock_in", "leave", "leave"])))
    rows = [tuple(e.get(f.name) for f in schemas.TASK_EVENTS.fields) for e in events]
    df = spark.createDataFrame(rows, schemas.TASK_EVENTS).repartition(3)
    got = sorted(((r["task_id"], r["student_id"], r["assigned_at"], r["unassigned_at"])
                  for r in tk.assignment_intervals(df).collect()),
                 key=lambda x: (x[0], x[1], x[2]))
    assert got == interpret_intervals(events)


def test_assignment_intervals_hot_pair_split_over_days(spark):
    """One (task, student) pair holding most of the log is split into the
    segments of its days; the carried state must stitch them, also over days
    without a change of state."""
    rng = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    events = []
    for i in range(900):
        hot = rng.random() < 0.8
        events.append(dict(task_id=1 if hot else rng.randint(2, 4),
                           student_id=1 if hot else rng.randint(1, 3),
                           at=base + dt.timedelta(minutes=rng.randint(0, 5000)), seq=i,
                           kind=rng.choice(["join", "join", "leave", "assign", "leave"])))
    rows = [tuple(e.get(f.name) for f in schemas.TASK_EVENTS.fields) for e in events]
    df = spark.createDataFrame(rows, schemas.TASK_EVENTS)
    for n in (1, 7):
        got = sorted(((r["task_id"], r["student_id"], r["assigned_at"], r["unassigned_at"])
                      for r in tk.assignment_intervals(df.repartition(n)).collect()),
                     key=lambda x: (x[0], x[1], x[2]))
        assert got == interpret_intervals(events), n


def test_fold_is_idempotent_under_replay(spark):
    """Re-delivered events (a retried micro-batch) do not change the fold."""
    rng = random.Random(11)
    events = random_log(rng, n_students=30)
    as_of = dt.datetime(2024, 1, 12, 6, 0)
    once = ses.daily_sessions(punches_df(spark, events), as_of)
    twice = ses.daily_sessions(punches_df(spark, events + events[::3]), as_of)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_roster_upsert_is_idempotent(spark):
    from conftest import students_df

    from rollcall.operators import roster as ro
    st = students_df(spark, [(1, "Ada Quill", "Build", True), (2, "Bo Fenn", None, False)])
    req = spark.createDataFrame(
        [(dt.datetime(2024, 2, 1), 1, None, "Cy Moor", "CAD/CAM", None),
         (dt.datetime(2024, 2, 1), 2, None, "Bo Fenn", "Build", None)], schemas.ROSTER_CHANGES)
    first, _ = ro.roster_upsert(st, req)
    first = first.drop("is_new").cache()
    second, _ = ro.roster_upsert(first, req)
    second = second.drop("is_new")
    assert first.exceptAll(second).count() == 0 and second.exceptAll(first).count() == 0
    first.unpersist()

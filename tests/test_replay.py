"""The replay against a plain interpreter of all requests in order; lookups by brute force;
change rows applied."""

import datetime as dt
import random

import pytest
from conftest import by_key, punches_df

from rollcall.operators import replay
from rollcall.operators import sessions as ses
from rollcall.operators.session_changes import apply_changes, session_changes

T0 = dt.datetime(2024, 1, 8, 14)
FOUR = dt.timedelta(hours=4)


def eastern(at):
    return (at - dt.timedelta(hours=5)).date()


def interpreted(log, reads, as_of):
    """(student, day) -> [in, out, updated], request by request."""
    rows = {}

    def sweep(t):
        for s in rows.values():
            if s[0] is not None and s[1] is None and s[0] < t - FOUR:
                s[1], s[2] = s[0] + FOUR, t

    todo = [(t, 0, 0, None) for t in reads] + [(e["at"], 0, 0, None) for e in log if e["kind"] == "clock_in"]
    todo += [(e["at"], 1, e["seq"], e) for e in log]
    for t, _, _, e in sorted(todo, key=lambda x: x[:3]):
        if t > as_of:
            break
        if e is None:
            sweep(t)
            continue
        s = rows.setdefault((e["student_id"], e.get("meeting_date") or eastern(t)), [None, None, None])
        s[2] = t
        if e["kind"] == "clock_in":
            s[0], s[1] = s[0] or t, None
        elif e["kind"] == "clock_out":
            s[1] = t
        elif e["kind"] in ("set_in", "set_both"):
            s[0] = e["set_in"]
        if e["kind"] in ("set_out", "set_both"):
            s[1] = e.get("set_out")
    return {k: tuple(v) for k, v in rows.items()}


def random_log(rng, n):
    out = []
    for k in range(n):
        at = T0 + dt.timedelta(minutes=rng.randrange(3 * 24 * 60), seconds=k % 60, microseconds=k)
        kind = rng.choice(["clock_in", "clock_in", "clock_out", "update", "set_in", "set_out", "set_both", "need_help"])
        e = dict(student_id=rng.randrange(4), at=at, seq=k, kind=kind, value=True)
        if kind.startswith("set"):
            day = eastern(T0 + dt.timedelta(days=rng.randrange(3)))
            clock = lambda: dt.datetime.combine(day, dt.time(14)) + dt.timedelta(minutes=rng.randrange(300))
            e |= dict(meeting_date=day, set_in=clock() if kind != "set_out" else None, set_out=rng.choice([None, clock()]) if kind != "set_in" else None)
        out.append(e)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_like_the_interpreter(spark, seed):
    rng = random.Random(seed)
    log = random_log(rng, 60)
    reads = [T0 + dt.timedelta(minutes=rng.randrange(4 * 24 * 60)) for _ in range(rng.choice([0, 3, 30]))]
    as_of = T0 + dt.timedelta(hours=rng.choice([30, 60, 200]))
    got = replay.replayed_sessions(punches_df(spark, log).repartition(3), spark.createDataFrame([(t,) for t in reads], "at timestamp_ntz"), as_of)
    assert {k: (v["clock_in_at"], v["clock_out_at"], v["updated_at"]) for k, v in by_key(got, "student_id", "meeting_date").items()} == interpreted(log, reads, as_of)


def test_a_close_before_the_correction_stays(spark):
    day = eastern(T0)
    log = [dict(student_id=1, at=T0, seq=1, kind="clock_in"),
           dict(student_id=1, at=T0 + dt.timedelta(hours=9), seq=2, kind="set_in", meeting_date=day, set_in=T0 + dt.timedelta(hours=1))]
    at = lambda h: spark.createDataFrame([(T0 + dt.timedelta(hours=h),)], "at timestamp_ntz")
    as_of = T0 + dt.timedelta(hours=12)
    out = lambda h: replay.replayed_sessions(punches_df(spark, log), at(h), as_of).first()["clock_out_at"]
    assert out(5) == T0 + FOUR                                  # swept before the correction
    assert out(10) == T0 + dt.timedelta(hours=5)                # only after it
    assert out(4) is None                                       # not yet four hours
    assert ses.daily_sessions(punches_df(spark, log), as_of).first()["clock_out_at"] == T0 + dt.timedelta(hours=5)


def test_first_after(spark):
    rng = random.Random(1)
    at = lambda: T0 + dt.timedelta(seconds=rng.choice([rng.randrange(300), rng.randrange(86400 * 2), rng.randrange(86400 * 40)]))
    instants, rows = {at() for _ in range(60)}, [at() for _ in range(200)]
    rows += rng.sample(sorted(instants), 20)
    df = spark.createDataFrame(list(enumerate(rows)), "k long, t timestamp_ntz")
    got = replay.first_after(df, "t", spark.createDataFrame([(t,) for t in instants], "at timestamp_ntz"), "nxt").collect()
    assert {r.k: r.nxt for r in got} == {k: min((i for i in instants if i > t), default=None) for k, t in enumerate(rows)}
    none = replay.first_after(df, "t", spark.createDataFrame([], "at timestamp_ntz"), "nxt")
    assert none.where("nxt IS NOT NULL").count() == 0 and none.count() == len(rows)


@pytest.mark.parametrize("since", [None, T0 + dt.timedelta(hours=20), T0 + dt.timedelta(hours=100)])
def test_changes_lead_from_one_table_to_the_other(spark, since):
    log, until = punches_df(spark, random_log(random.Random(7), 120)), T0 + dt.timedelta(hours=60)
    changes = session_changes(log, since, until)
    old, new = ses.session_fold(log, since or T0 - dt.timedelta(days=9)), ses.session_fold(log, until)
    if since is None or since < until:
        got = apply_changes(old, changes)
        assert got.exceptAll(new).count() == 0 == new.exceptAll(got).count()
    else:
        assert changes.count() == 0

"""Unique names under random logs of edits, against a loop over the log."""

import datetime as dt
import random

import pytest

from rollcall.operators import name_claims, roster
from conftest import students_df

T0 = dt.datetime(2024, 1, 1)
PATCHES = "at timestamp_ntz, seq long, student_id long, full_name string, subteam string, is_active boolean"


def played(students, patches):
    """(roster rows, rejects) of a loop over the log."""
    rows = {i: [n, s, a] for i, n, s, a in students}
    owner = {n: i for i, n, _, _ in students}
    rejects = []
    for at, seq, i, name, sub, active in sorted(patches, key=lambda p: (p[0], p[1])):
        new = (name or "").strip()
        if i not in rows:
            rejects.append((seq, "student_unknown"))
        elif new and owner.get(new, i) != i:
            rejects.append((seq, "name_taken"))
        else:
            if new:
                del owner[rows[i][0]]
                owner[new] = i
                rows[i][0] = new
            rows[i][1] = rows[i][1] if sub is None else sub
            rows[i][2] = rows[i][2] if active is None else active
    return sorted((i, *v) for i, v in rows.items()), sorted(rejects)


def held(spark, students, patches):
    out, rejects = roster.roster_patch(students_df(spark, students), spark.createDataFrame(patches, PATCHES))
    got = sorted(tuple(r) for r in out.select("student_id", "full_name", "subteam", "is_active").collect())
    assert (got, sorted((r.seq, r.reject_reason) for r in rejects.collect())) == played(students, patches)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs(spark, seed, monkeypatch):
    monkeypatch.setattr(name_claims, "MERGE_EVERY", 2)
    rng = random.Random(seed)
    n = 12
    students = [(i, f"s{i}", rng.choice([None, "Build"]), rng.random() < 0.8) for i in range(n)]
    names = [f"s{i}" for i in range(n)] + ["x", "y", "z"]
    patches = [(T0 + dt.timedelta(minutes=rng.randrange(40)), k, rng.choice([*range(n), 99]), rng.choice([None, "", "  ", *(f" {m} " for m in names)]),
                rng.choice([None, "", "Programming"]), rng.choice([None, True, False])) for k in range(80)]
    held(spark, students, patches)


def test_a_chain_of_names_and_a_wanted_one(spark):
    students = [(i, f"s{i}", None, True) for i in range(30)]
    moves = [(T0 + dt.timedelta(minutes=i), i, i, f"s{i - 1}" if 0 < i < 5 else "new" if i == 0 else "Captain", None, None) for i in range(30)]
    back = [(T0 + dt.timedelta(hours=1), 100, 5, "Mate", "a", False), (T0 + dt.timedelta(hours=2), 101, 7, "Captain", "b", False),
            (T0 + dt.timedelta(hours=3), 102, 8, "Captain", "c", False), (T0 + dt.timedelta(hours=3), 102, 8, "Captain", "c", False)]
    out, rejects = roster.roster_patch(students_df(spark, students), spark.createDataFrame(moves + back, PATCHES))
    names = {r.student_id: r.full_name for r in out.collect()}
    assert [names[i] for i in range(5)] == ["new", "s0", "s1", "s2", "s3"]
    assert (names[5], names[7], names[8]) == ("Mate", "Captain", "s8")
    assert sorted(r.seq for r in rejects.collect()) == [*range(6, 30), 102, 102]


def test_no_claims(spark):
    students = [(1, "a", None, True)]
    for patches in ([], [(T0, 1, 1, "  ", "x", None)]):
        held(spark, students, patches)

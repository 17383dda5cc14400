"""Positions by ranges, and what is routed into the task log."""

import random

from conftest import T, punches_df, students_df
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import bridge
from rollcall.operators import positions as pos
from rollcall.operators import tasks as tk


def test_positions_like_sorted(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, rng.randrange(50)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k long").repartition(5)
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    got = pos.with_position(df, [F.col("v").asc_nulls_first(), F.col("k")])
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r.position)] == sorted(rows, key=place)
    grouped = pos.with_position(df, [F.col("v").asc_nulls_first(), F.col("k")], within=["g"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in grouped if r.g == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [tuple(r)[:3] for r in mine] == sorted((r for r in rows if r[0] == g), key=place)


def test_positions_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(1,)] * 20, "k long")
    assert sorted(r.position for r in pos.with_position(df, [F.col("k")]).collect()) == list(range(1, 21))
    assert pos.with_position(df.where("k > 1"), [F.col("k")]).collect() == []


def test_clock_ins_reach_the_task_side(spark):
    st = students_df(spark, [(1, "Ada Quill", None, True), (2, "Bo Fenn", None, False)])
    own = spark.createDataFrame([(5, T("2024-01-01"), 1, "create", None, "Arm", "Build", "todo", ""),
                                 (6, T("2024-01-01"), 2, "create", None, "Leg", "Build", "done", "")], schemas.TASK_EVENTS)
    punches = punches_df(spark, [dict(student_id=1, at=T("2024-01-02"), seq=1, kind="clock_in", task_id=5),
                                 dict(student_id=1, at=T("2024-01-03"), seq=2, kind="clock_in", task_id=6),
                                 dict(student_id=1, at=T("2024-01-04"), seq=3, kind="clock_in"),
                                 dict(student_id=1, at=T("2024-01-04"), seq=4, kind="clock_out", task_id=5),
                                 dict(student_id=1, at=T("2024-01-05"), seq=5, kind="clock_in", task_id=99),
                                 dict(student_id=2, at=T("2024-01-05"), seq=6, kind="clock_in", task_id=5)])
    requests = spark.createDataFrame([(1, 5, T("2024-01-06"), None, None, None, " ok "), (2, 5, T("2024-01-07"), None, None, None, "  "),
                                      (3, 77, T("2024-01-07"), None, None, None, "lost")], schemas.COMMENT_REQUESTS)
    tasks = spark.createDataFrame([(5,), (6,)], "id long")
    comments, refused = tk.comment_attribute(requests, st, tasks)
    assert {r.id: r.reject_reason for r in refused.collect()} == {2: "comment_missing", 3: "task_unknown"}
    valid, rejects = tk.validate_task_events(bridge.task_log(own, punches, comments), st)
    assert sorted((r.task_id, r.reject_reason) for r in rejects.collect()) == [(5, "student_unknown"), (99, "task_unknown")]
    fold = {r.id: (r.status, r.updated_at) for r in tk.task_fold(valid).collect()}
    assert fold == {5: ("in_progress", T("2024-01-06")), 6: ("done", T("2024-01-03"))}     # a blank comment touches nothing
    open_ = tk.assignment_intervals(valid).collect()
    assert sorted((r.task_id, r.student_id, r.unassigned_at) for r in open_) == [(5, 1, None), (6, 1, None)]


def test_composed_numbers_stay_apart(spark):
    seq = spark.range(10).select(*[bridge.composed_seq(F.col("id"), s).alias(s) for s in bridge.SOURCE_RANK]).collect()
    assert len({v for r in seq for v in r}) == 30

"""Task board operators (O-28..O-32, O-50..O-60) and comments (O-57, O-37)."""

import json

from conftest import T, by_key, students_df

from rollcall import schemas
from rollcall.operators import tasks as tk

STUDENTS = [(1, "Cy Moor", None, True), (2, "Ada Quill", None, True),
            (3, "Bo Fenn", None, False)]


def tasks_df(spark, rows):
    return spark.createDataFrame(rows, schemas.TASKS)


def assign_df(spark, rows):
    return spark.createDataFrame(rows, schemas.TASK_ASSIGNMENTS)


def comments_df(spark, rows):
    return spark.createDataFrame(rows, schemas.TASK_COMMENTS)


def test_dedup_keeps_newest_open(spark):
    a = assign_df(spark, [
        (1, 10, 1, T("2024-01-01"), None),
        (2, 10, 1, T("2024-01-02"), None),
        (3, 10, 1, T("2024-01-02"), None),
        (4, 10, 1, T("2023-12-01"), T("2023-12-05")),
        (5, 10, 2, T("2024-01-01"), None)])
    d = by_key(tk.assignments_dedup(a, T("2024-02-01")), "id")
    assert d[(3,)]["unassigned_at"] is None
    assert d[(2,)]["unassigned_at"] == T("2024-02-01")
    assert d[(1,)]["unassigned_at"] == T("2024-02-01")
    assert d[(4,)]["unassigned_at"] == T("2023-12-05")
    assert d[(5,)]["unassigned_at"] is None


def test_board_activity_staleness_assignees_order(spark):
    t = tasks_df(spark, [
        (10, "Gearbox", "Build", "todo", "", False, T("2024-01-01"), T("2024-01-01")),
        (11, "Wiring", "Electrical", "weird", "", False, T("2024-01-01"), T("2024-01-05")),
        (12, "Old", "Build", "done", "", True, T("2024-01-01"), T("2024-01-01")),
        (13, "Fresh", "Build", "blocked", "", False, T("2024-01-01"), T("2024-01-07 00:00:01"))])
    a = assign_df(spark, [(1, 10, 1, T("2024-01-03"), None), (2, 10, 2, T("2024-01-02"), None),
                          (3, 10, 9, T("2024-01-04"), None), (4, 11, 1, T("2024-01-06"),
                                                                  T("2024-01-07"))])
    c = comments_df(spark, [(1, 11, "mentor", "Mentor", "hi", T("2024-01-06"))])
    st = students_df(spark, STUDENTS)
    board = tk.task_board(t, a, c, st, T("2024-01-10"))
    rows = board.collect()
    assert [r["id"] for r in rows] == [10, 13, 11]          # rank, then updated desc
    b = {r["id"]: r for r in rows}
    assert json.loads(b[10]["assignees"]) == [
        {"student_id": 2, "full_name": "Ada Quill"}, {"student_id": 1, "full_name": "Cy Moor"}]
    assert b[10]["last_activity_at"] == T("2024-01-04")     # unknown student still counts
    assert b[10]["is_stale"] is True
    assert b[11]["assignees"] == "[]" and b[11]["last_activity_at"] == T("2024-01-06")
    assert b[13]["is_stale"] is False                        # strictly older than 3 days
    assert b[11]["status_rank"] == 5
    cols = {r["column"]: r["n_tasks"] for r in tk.task_column_counts(t).collect()}
    assert cols == {"todo": 2, "in_progress": 0, "blocked": 1, "done": 0}
    only = tk.task_board(t, a, c, st, T("2024-01-10"), subteam=" Build ", include_archived=True)
    assert sorted(r["id"] for r in only.collect()) == [10, 12, 13]


def events_df(spark, rows):
    return spark.createDataFrame(rows, schemas.TASK_EVENTS)


def test_task_fold_patch_archive_and_promotion(spark):
    st = students_df(spark, STUDENTS)
    ev = events_df(spark, [
        (1, T("2024-01-01"), 1, "create", None, " Arm ", " Build ", "nonsense", " d "),
        (1, T("2024-01-02"), 2, "clock_in", 1, None, None, None, None),
        (2, T("2024-01-01"), 3, "create", None, "Drive", "Build", "todo", None),
        (2, T("2024-01-02"), 4, "patch", None, "  ", None, "done", ""),
        (2, T("2024-01-03"), 5, "clock_in", 2, None, None, None, None),
        (2, T("2024-01-04"), 6, "archive", None, None, None, None, None),
        (3, T("2024-01-01"), 7, "create", None, "Paint", "Imagery", "todo", None),
        (3, T("2024-01-02"), 8, "patch", None, "Paint v2", None, "todo", None),
        (3, T("2024-01-01 12:00"), 9, "clock_in", 1, None, None, None, None),
        (4, T("2024-01-01"), 10, "create", None, "   ", "Build", "todo", None),
        (5, T("2024-01-01"), 11, "patch", None, "Ghost", None, "done", None),
        (1, T("2024-01-05"), 12, "join", 3, None, None, None, None),
        (6, T("2023-12-30"), 13, "archive", None, None, None, None, None),
        (6, T("2023-12-30"), 14, "patch", None, "Early", None, "done", None),
        (6, T("2024-01-01"), 15, "create", None, "Late", "Build", "blocked", None),
    ])
    valid, rejects = tk.validate_task_events(ev, st)
    assert {r["seq"]: r["reject_reason"] for r in rejects.collect()} == {
        10: "title_missing", 12: "student_unknown",
        11: "task_unknown", 13: "task_unknown", 14: "task_unknown"}     # no create at or before them
    f = by_key(tk.task_fold(valid, T("2024-02-01")), "id")
    assert set(f) == {(1,), (2,), (3,), (6,)}
    assert f[(6,)]["archived"] is False and f[(6,)]["title"] == "Late"
    assert f[(6,)]["status"] == "blocked" and f[(6,)]["updated_at"] == T("2024-01-01")
    assert f[(1,)]["title"] == "Arm" and f[(1,)]["subteam"] == "Build"
    assert f[(1,)]["status"] == "in_progress" and f[(1,)]["description"] == "d"
    assert f[(2,)]["status"] == "done" and f[(2,)]["archived"] is True
    assert f[(2,)]["title"] == "Drive" and f[(2,)]["description"] == ""
    assert f[(2,)]["updated_at"] == T("2024-01-04")
    assert f[(3,)]["status"] == "todo" and f[(3,)]["title"] == "Paint v2"


def test_comment_attribution_and_feed(spark):
    st = students_df(spark, STUDENTS)
    req = spark.createDataFrame([
        (1, 10, T("2024-01-02"), 3, "mentor", "x", "  nice  "),
        (2, 10, T("2024-01-01"), None, "student", "  ", "ok"),
        (3, 10, T("2024-01-03"), None, None, " Coach K ", "go"),
        (4, 10, T("2024-01-03"), 42, None, None, "who"),
        (5, 10, T("2024-01-03"), None, None, None, " \n "),
    ], schemas.COMMENT_REQUESTS)
    ok, rej = tk.comment_attribute(req, st)
    o = by_key(ok, "id")
    assert o[(1,)]["author_type"] == "student" and o[(1,)]["author_label"] == "Bo Fenn"
    assert o[(1,)]["comment"] == "nice"
    assert o[(2,)]["author_type"] == "mentor" and o[(2,)]["author_label"] == "Mentor"
    assert o[(3,)]["author_label"] == "Coach K"
    assert {r["id"]: r["reject_reason"] for r in rej.collect()} == {
        4: "student_unknown", 5: "comment_missing"}
    feed = [r["id"] for r in tk.comment_feed(ok, task_id=10).collect()]
    assert feed == [2, 1, 3]


def test_my_tasks(spark):
    t = tasks_df(spark, [(10, "Gearbox", "Build", "in_progress", "", False, T("2024-01-01"),
                          T("2024-01-01"))])
    a = assign_df(spark, [(1, 10, 1, T("2024-01-03"), None), (2, 10, 1, T("2024-01-04"), None),
                          (3, 10, 2, T("2024-01-03"), T("2024-01-04"))])
    rows = tk.my_tasks(a, t).collect()
    assert [(r["student_id"], r["label"]) for r in rows] == [(1, "[Build] Gearbox (in progress)")]

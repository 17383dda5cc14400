"""Physical-plan properties of the registered queries at sf0.001."""

import pytest

import __spark_entry__ as E
from rollcall.plans import catalog

SF = "/root/testdata/sf0.001"


_PLANS: dict = {}


def executed(spark, name):
    """The executed and the optimized plan; some queries write tables while they are built,
    so each is built once."""
    if name not in _PLANS:
        spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
        q = E.queries()[name](spark, SF)._jdf.queryExecution()
        _PLANS[name] = q.executedPlan().toString(), q.optimizedPlan().toString()
    return _PLANS[name][0]


def plan(spark, name):
    return executed(spark, name) + _PLANS[name][1]


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n != "session_stream"])
def test_no_python_udf_or_cartesian(spark, name):
    p = plan(spark, name)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in p, (name, bad)


def test_history_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "student_history")


def test_board_prunes_events_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = E.queries()["status_board"](spark, SF)
    txt = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in txt and "LessThan(ts" in txt


def test_corrections_list_is_top_k(spark):
    df = E.queries()["corrections_list"](spark, SF)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_roster_joins_are_broadcast(spark):
    for name in ("gate_active", "attendance_report", "status_board"):
        p = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in p, name


def test_fold_pre_aggregates_before_shuffle(spark):
    p = E.queries()["session_fold"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # partial aggregate below the exchange, final above it
    assert p.count("SortAggregate") >= 2 or p.count("HashAggregate") >= 2


# Bounded single-task steps: a one-row global aggregate (one partial row per
# input partition reaches it), the top-200 lists and the newest of the seasons' versions.
SINGLE_TASK_OK = {"status_tiles": "SinglePartition", "season_current": "TakeOrderedAndProject",
                  **{f"corrections_list{x}": "TakeOrderedAndProject" for x in ("", "_all", "_denied", "_day")}}


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n != "session_stream"])
def test_nothing_whole_through_one_task(spark, name):
    p = executed(spark, name)
    found = {k for k in ("SinglePartition", "TakeOrderedAndProject", "CollectLimit") if k in p}
    allowed = {SINGLE_TASK_OK[name]} if name in SINGLE_TASK_OK else set()
    assert found <= allowed, (name, found)
    if name == "status_tiles":
        assert "partial_count" in p


def scans(spark, name):
    """The scans of the events in a query's plan, with every join by shuffle and no
    re-planning, so that nothing is shared or left out."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.maxMetadataStringLength")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        text = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return [line for line in text.splitlines() if "FileScan" in line and "events.parquet" in line]


@pytest.mark.parametrize("name", ["status_board", "student_today", "status_tiles", "attendance_report", "report_csv_lines"])
def test_boards_and_reports_read_events_twice_and_pruned(spark, name):
    found = scans(spark, name)
    assert 1 <= len(found) <= 2
    assert all("GreaterThanOrEqual(ts" in s and "LessThan(ts" in s for s in found)


@pytest.mark.parametrize("name,most", [("session_fold", 2), ("sessions_with_manual", 3), ("audit_fk", 3), ("audit_domain", 1)])
def test_scans_of_events(spark, name, most):
    assert 1 <= len(scans(spark, name)) <= most

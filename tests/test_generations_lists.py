"""File generations, season chains, and lists in chunks."""

import uuid

import pytest
from conftest import T, students_df
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import rollover
from rollcall.operators.lists import assignee_chunks
from rollcall.session import checkpoint_root
from rollcall.sources import generations as g


def fresh(spark, name):
    return f"{checkpoint_root(spark).rstrip('/')}/rollcall-test-{name}-{uuid.uuid4().hex}"


def test_defaults_only_for_columns_a_generation_lacks(spark):
    root = fresh(spark, "generations")
    assert g.read_generations(spark, root, "tasks").count() == 0
    old = spark.createDataFrame([(1, "Arm", "Build", "todo", T("2024-01-01"), T("2024-01-01"))],
                                "id long, title string, subteam string, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    g.write_generation(old, root, "tasks", 1)
    assert [(r.archived, r.description) for r in g.read_generations(spark, root, "tasks").collect()] == [(False, "")]
    new = old.select(F.lit(2).alias("id"), *old.columns[1:], F.lit(True).alias("archived"), F.lit(None).cast("string").alias("description"), F.lit(1).alias("extra"))
    g.write_generation(new, root, "tasks", 2)
    g.write_generation(old.withColumn("id", F.lit(3)), root, "tasks", 1)         # an old writer goes on
    got = g.read_generations(spark, root, "tasks")
    assert got.columns == schemas.TASKS.fieldNames()
    assert {r.id: (r.archived, r.description) for r in got.collect()} == {1: (False, ""), 2: (True, None), 3: (False, "")}
    with pytest.raises(ValueError, match="archived"):
        g.write_generation(old, root, "tasks", 2)


def test_seasons_are_read_as_of(spark):
    root = fresh(spark, "seasons")
    assert rollover.seasons(spark, root).count() == 0
    with pytest.raises(ValueError, match="season_unknown"):
        rollover.read_season(spark, root, "students")
    rollover.season_rollover(spark, students_df(spark, [(1, "Ada Quill", None, True)]), root, "2024", "RESET", True)
    facts = spark.createDataFrame([(1, 5, 1, T("2024-01-01"), None)], schemas.TASK_ASSIGNMENTS)
    rollover.append_facts(facts, root, "task_assignments")
    rollover.season_rollover(spark, students_df(spark, [(1, "Ada Quill", None, True), (2, "Bo Fenn", None, True)]), root, "2025", "RESET", True)
    count = lambda t, s=None: rollover.read_season(spark, root, t, s).count()
    assert (count("students", "2024"), count("students"), count("task_assignments", "2024"), count("task_assignments")) == (1, 2, 1, 0)
    with pytest.raises(ValueError, match="season_unknown"):
        count("students", "1999")


def test_a_task_with_very_many_assignees(spark):
    n, chunk = 100_000, 1000
    people = spark.range(n).select(F.col("id").alias("student_id"), F.concat(F.lit("s"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("string")).alias("full_name"))
    pairs = spark.range(2 * n).select(F.col("id"), F.lit(1).cast("long").alias("task_id"), (F.col("id") % n).alias("student_id"),
                                      F.lit(T("2024-01-01")).alias("assigned_at"), F.lit(None).cast("timestamp_ntz").alias("unassigned_at"))
    rows = assignee_chunks(pairs, people, chunk).orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(n // chunk)) and all(len(r.assignees) == chunk and r.n_before == chunk * r.chunk for r in rows)
    names = [a.full_name for r in rows for a in r.assignees]
    assert names == sorted(names) and len(set(names)) == n


def test_chunks_of_nothing(spark):
    none = spark.createDataFrame([], schemas.TASK_ASSIGNMENTS)
    assert assignee_chunks(none, students_df(spark, [(1, "Ada Quill", None, True)]), 2).collect() == []

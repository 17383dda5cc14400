"""Streaming assignment intervals and task table: equal to the batch operators under any split."""

import collections
import datetime as dt
import os
import random
import time

import pytest

from rollcall import schemas
from rollcall.operators.tasks import assignment_intervals
from rollcall.sources.staging import scratch_path
from rollcall.streaming.task_tables import INTERVALS, TASKS, TaskTables

START = dt.datetime(2024, 1, 1)
KINDS = ["join", "leave", "assign", "clock_in", "comment", "patch", "archive", "unarchive"]


def random_log(rng, n_tasks=12, n=400):
    out = [(t, START + dt.timedelta(hours=rng.randrange(30)), t, "create", None, f" task {t} ", rng.choice([None, "Build", " "]),
            rng.choice(["todo", "odd", None, "blocked"]), rng.choice([None, " some text "])) for t in range(n_tasks - 2)]
    for k in range(n):
        kind = rng.choice(KINDS)
        edit = (rng.choice([None, "  ", f" new {k} "]), rng.choice([None, "Code"]), rng.choice([None, "todo", "done", "odd"]),
                rng.choice([None, "", " kept as given "])) if kind == "patch" else (None,) * 4
        out.append((rng.randrange(n_tasks), START + dt.timedelta(hours=rng.randrange(200)), 1000 + k, kind, rng.choice([None, 1, 2, 3]), *edit))
    return out


def rows(df):
    return collections.Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def same(spark, tables, events):
    df = spark.createDataFrame(events, schemas.TASK_EVENTS)
    assert rows(tables.read(INTERVALS)) == rows(assignment_intervals(df))
    assert rows(tables.read(TASKS)) == rows(TASKS.fold(df))


@pytest.mark.parametrize("split", ["in order", "shuffled", "a late few"])
def test_equals_the_batch_operators(spark, split):
    rng = random.Random(f"21 {split}")
    log = random_log(rng)
    log.sort(key=lambda e: (e[1], e[2]))
    if split == "shuffled":
        rng.shuffle(log)
    if split == "a late few":
        late = set(rng.sample(log, 30))
        log = [e for e in log if e not in late] + sorted(late, key=lambda e: e[2])
    cuts = [0, 120, 260, len(log) - 30, len(log)]
    root = scratch_path(spark, "test-task-tables")
    for epoch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        tables = TaskTables(spark, root)                # a restart each time
        tables.merge(spark.createDataFrame(log[a:b], schemas.TASK_EVENTS), epoch)
        if epoch in (1, 3):
            same(spark, tables, log[:b])


def test_failed_repeated_and_empty_epochs(spark, monkeypatch):
    log = sorted(random_log(random.Random(5), 6, 120), key=lambda e: (e[1], e[2]))
    df = lambda part: spark.createDataFrame(part, schemas.TASK_EVENTS)
    tables = TaskTables(spark, scratch_path(spark, "test-task-tables"))
    assert tables.read(INTERVALS).count() == tables.read(TASKS).count() == 0
    tables.merge(df([]), 0)
    assert tables.read(INTERVALS).count() == tables.read(TASKS).count() == 0
    tables.merge(df(log[:60]), 1)
    merge = TaskTables._merge

    def breaks(self, fold, *rest):
        merge(self, fold, *rest)
        if fold is INTERVALS:
            raise RuntimeError("lost")

    monkeypatch.setattr(TaskTables, "_merge", breaks)
    with pytest.raises(RuntimeError):
        tables.merge(df(log[60:]), 2)
    monkeypatch.undo()
    same(spark, tables, log[:60])                       # nothing of the failed epoch is seen
    tables.merge(df(log[60:]), 2)
    tables.merge(df(log[60:]), 2)                       # committed already
    same(spark, tables, log)


def test_a_merge_leaves_no_shuffles_and_no_steps(spark):
    log = random_log(random.Random(9), 8, 200)
    root = scratch_path(spark, "test-task-tables")
    tables = TaskTables(spark, root)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    for epoch, part in enumerate((log[:100], log[100:])):
        before = shuffles()
        tables.merge(spark.createDataFrame(part, schemas.TASK_EVENTS), epoch)
        until = time.time() + 20                        # Spark deletes them in the background
        while shuffles() - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffles() - before
    assert sorted(os.listdir(f"{root}/intervals")) == sorted(os.listdir(f"{root}/tasks")) == ["heads", "rows"]
    same(spark, tables, log)

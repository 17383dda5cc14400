"""Task board (O-14, O-21, O-22, O-28..O-32, O-36, O-37, O-50..O-60).

Tasks, assignments and comments are either given as tables or derived
from a task event log (``task_fold``, ``assignment_intervals``).  All
per-task facts are pre-aggregated by ``task_id`` (partial aggregation
before the shuffle) and then joined once to the task table; the joins
reuse the ``task_id`` hash partitioning of the aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, is_blank, js_trim, task_label
from ..functions.timez import STALE_DAYS, ts_lit
from ..schemas import TASK_STATUSES
from .sessions import last_write

EPOCH = "1970-01-01 00:00:00"
# Board column order, unknown statuses rank last.
STATUS_RANK = {"todo": 1, "in_progress": 2, "blocked": 3, "done": 4}
OPENING_KINDS = ["join", "assign", "clock_in"]
FIELD_KINDS = ["create", "patch", "archive", "unarchive", "clock_in"]


def status_rank(status: Column | str = "status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    expr = None
    for name, rank in STATUS_RANK.items():
        expr = F.when(s == name, rank) if expr is None else expr.when(s == name, rank)
    return expr.otherwise(5)


def board_column(status: Column | str = "status") -> Column:
    """O-31: the kanban column; an unknown status shows under 'todo'."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isin(*TASK_STATUSES), s).otherwise(F.lit("todo"))


# ------------------------------------------------------------ assignments

def open_assignments(assignments: DataFrame) -> DataFrame:
    return assignments.where(F.col("unassigned_at").isNull())


def assignments_dedup(assignments: DataFrame, as_of) -> DataFrame:
    """O-32: among open assignments of one (task, student) keep the newest
    (``assigned_at`` desc, ``id`` desc) open and close the others at
    ``as_of``; closed rows pass through.

    The newest row per pair is found with a mergeable ``max`` aggregate and
    joined back, so a pair with very many duplicates is reduced inside each
    input partition before any shuffle (AQE splits the skewed join side)."""
    newest = open_assignments(assignments).groupBy("task_id", "student_id").agg(
        F.max(F.struct("assigned_at", "id")).alias("_newest"))
    dup = F.col("unassigned_at").isNull() & (F.struct("assigned_at", "id") != F.col("_newest"))
    return assignments.join(newest, ["task_id", "student_id"], "left").select(
        "id", "task_id", "student_id", "assigned_at",
        F.when(dup, ts_lit(as_of)).otherwise(F.col("unassigned_at")).alias("unassigned_at"))


def assignment_intervals(task_events: DataFrame, between: Callable = lambda df: df) -> DataFrame:
    """O-54..O-56: join / assign / clock-in-with-task open an assignment
    unless one is open; leave closes the open one (a no-op otherwise).

    Per (task, student) in ``(at, seq)`` order, keep only the events that
    change the state (open vs closed, starting closed); the openings are the
    intervals and the following change is their ``unassigned_at``.

    Skew: a pair's log is cut into segments, one per day.  ``lag``/``lead``
    run inside each (pair, day) segment, and what crosses a segment boundary
    is carried by summaries of one row per pair and day, so a pair with very
    many events is dealt to as many tasks as it has days.  ``between`` may write
    the changes out before they are read twice, and return what it wrote.
    """
    ev = task_events.where(F.col("kind").isin(*OPENING_KINDS, "leave")
                           & F.col("student_id").isNotNull())
    pair = ["task_id", "student_id"]
    seg_key = [*pair, "_day"]
    ev = ev.select("task_id", "student_id", "at", "seq", F.to_date("at").alias("_day"),
                   (F.col("kind") != "leave").alias("_opens"))
    w_seg = Window.partitionBy(*seg_key).orderBy("at", "seq")
    w_pair = Window.partitionBy(*pair).orderBy("_day")

    # 1. State before each event: the previous event of its segment, else the
    #    last state of the pair's previous segment, else closed.
    ev = ev.withColumn("_prev_local", F.lag("_opens").over(w_seg))
    seg = (ev.groupBy(*seg_key).agg(F.max(F.struct("at", "seq", "_opens")).alias("_last"))
           .withColumn("_carry", F.lag(F.col("_last._opens")).over(w_pair))
           .where("_carry").select(*seg_key, "_carry"))         # others start closed
    ev = ev.join(seg, seg_key, "left")
    prev = F.coalesce(F.col("_prev_local"), F.col("_carry"), F.lit(False))
    changes = between(ev.where(prev != F.col("_opens")).select(*seg_key, "at", "seq", "_opens"))

    # 2. Changes alternate open/close: an opening ends at the next change --
    #    in its segment, else the first change of the next segment that has one.
    changes = changes.withColumn("_next_local", F.lead("at").over(w_seg))
    cseg = (changes.groupBy(*seg_key).agg(F.min(F.struct("at", "seq")).alias("_first"))
            .withColumn("_carry_next", F.lead(F.col("_first.at")).over(w_pair))
            .where(F.col("_carry_next").isNotNull()).select(*seg_key, "_carry_next"))
    return (changes.where(F.col("_opens")).join(cseg, seg_key, "left")
            .select("task_id", "student_id", F.col("at").alias("assigned_at"),
                    F.coalesce("_next_local", "_carry_next").alias("unassigned_at")))


# ------------------------------------------------------------ per-task facts

def task_last_comment(comments: DataFrame) -> DataFrame:
    """O-28."""
    return comments.groupBy("task_id").agg(F.max("created_at").alias("last_comment_at"))


def task_last_assignment(assignments: DataFrame) -> DataFrame:
    """O-29: newest open assignment per task."""
    return open_assignments(assignments).groupBy("task_id").agg(
        F.max("assigned_at").alias("last_assigned_at"))


def _assignee_facts(assignments: DataFrame, students: DataFrame) -> DataFrame:
    """Per task: newest open assignment and the name-ordered list of open
    assignees (O-22/O-30).  One open row per (task, student) is counted once,
    as the unique index of the source guarantees; unknown students are left
    out of the list but still count as activity.  The list is bounded by the
    roster size, not by the number of assignment rows."""
    pairs = open_assignments(assignments).groupBy("task_id", "student_id").agg(
        F.max("assigned_at").alias("assigned_at"))
    named = pairs.join(students.select("student_id", "full_name"),
                       "student_id", "left")
    agg = named.groupBy("task_id").agg(
        F.max("assigned_at").alias("last_assigned_at"),
        F.sort_array(F.collect_list(F.when(F.col("full_name").isNotNull(),
                                           F.struct("full_name", "student_id")))).alias("_l"))
    return agg.select(
        "task_id", "last_assigned_at",
        F.transform("_l", lambda x: F.struct(x["student_id"].alias("student_id"),
                                             x["full_name"].alias("full_name")))
        .alias("assignees"))


def task_assignees(assignments: DataFrame, students: DataFrame) -> DataFrame:
    """O-22/O-30 per task with an open assignment: count and ordered list
    (nested ``array<struct<student_id, full_name>>``)."""
    f = _assignee_facts(assignments, students)
    return f.where(F.size("assignees") > 0).select(
        "task_id", F.size("assignees").cast("long").alias("n_assignees"), "assignees")


def assignees_json(col: Column | str = "assignees") -> Column:
    """JSON text of an assignee list, ``[]`` when empty (edge format only)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.to_json(c), F.lit("[]"))


def assignments_at(assignments: DataFrame, as_of) -> DataFrame:
    """The assignments as they stood at ``as_of``: later ones are not there yet, and one
    that is left later is still open."""
    left = F.when(F.col("unassigned_at") <= ts_lit(as_of), F.col("unassigned_at"))
    return assignments.where(F.col("assigned_at") <= ts_lit(as_of)).withColumn("unassigned_at", left)


def created_by(rows: DataFrame, as_of) -> DataFrame:
    """Tasks or comments that existed at ``as_of``."""
    return rows.where(F.col("created_at") <= ts_lit(as_of))


def _with_activity(tasks: DataFrame, comments: DataFrame, assignments: DataFrame,
                   students: DataFrame | None, as_of) -> DataFrame:
    tasks, comments = created_by(tasks, as_of), created_by(comments, as_of)
    assignments = assignments_at(assignments, as_of)
    lc = task_last_comment(comments).withColumnRenamed("task_id", "id")
    if students is None:
        la = task_last_assignment(assignments).withColumnRenamed("task_id", "id")
    else:
        la = _assignee_facts(assignments, students).withColumnRenamed("task_id", "id")
    t = tasks.join(lc, "id", "left").join(la, "id", "left")
    epoch = ts_lit(EPOCH)
    last = F.greatest(F.col("updated_at"), F.coalesce("last_comment_at", epoch),
                      F.coalesce("last_assigned_at", epoch))
    stale_before = ts_lit(as_of) - F.make_dt_interval(F.lit(STALE_DAYS))
    return (t.withColumn("last_activity_at", last)
            .withColumn("is_stale", F.col("last_activity_at") < stale_before))


def task_staleness(tasks: DataFrame, comments: DataFrame, assignments: DataFrame,
                   as_of) -> DataFrame:
    """O-59: last activity = greatest(updated, last comment, newest open
    assignment); stale when strictly older than 3 days before ``as_of``."""
    t = _with_activity(tasks, comments, assignments, None, as_of)
    return t.select(F.col("id").alias("task_id"), "last_activity_at", "is_stale")


def task_filter(tasks: DataFrame, subteam: str | None = None, status: str | None = None,
                include_archived: bool = False) -> DataFrame:
    """O-14: trimmed subteam and status filters, each only when non-empty;
    archived tasks hidden unless asked for."""
    df = tasks
    subteam = (subteam or "").strip()
    status = (status or "").strip()
    if subteam:
        df = df.where(F.col("subteam") == subteam)
    if status:
        df = df.where(F.col("status") == status)
    if not include_archived:
        df = df.where(~F.col("archived"))
    return df


def task_board(tasks: DataFrame, assignments: DataFrame, comments: DataFrame,
               students: DataFrame, as_of, subteam: str | None = None,
               status: str | None = None, include_archived: bool = False,
               sort: bool = True) -> DataFrame:
    """O-60: filter, activity, staleness, ordered assignee list and the
    board order (status rank, newest update first, id)."""
    t = task_filter(tasks, subteam, status, include_archived)
    t = _with_activity(t, comments, assignments, students, as_of)
    out = t.select(
        "id", "title", "subteam", "status", "description", "archived", "created_at",
        "updated_at", "last_activity_at", "is_stale",
        assignees_json(F.when(F.size("assignees") > 0, F.col("assignees"))).alias("assignees"),
        status_rank().alias("status_rank"))
    if sort:
        out = out.orderBy("status_rank", F.col("updated_at").desc(), "id")
    return out


def task_column_counts(tasks: DataFrame, subteam: str | None = None,
                       include_archived: bool = False) -> DataFrame:
    """O-31: tasks per kanban column, all four columns present."""
    t = task_filter(tasks, subteam, None, include_archived)
    counts = t.groupBy(board_column().alias("column")).agg(F.count(F.lit(1)).alias("n_tasks"))
    spark = tasks.sparkSession
    cols = spark.createDataFrame([(s, i + 1) for i, s in enumerate(TASK_STATUSES)],
                                 "column string, position int")
    return cols.join(counts, "column", "left").select(
        "column", "position", F.coalesce("n_tasks", F.lit(0)).cast("long").alias("n_tasks"))


def task_column_pivot(tasks: DataFrame, include_archived: bool = False) -> DataFrame:
    """O-31 as one row per subteam with a count per kanban column: a pivot
    over the fixed column list (no pass to discover the values)."""
    t = task_filter(tasks, None, None, include_archived)
    p = (t.withColumn("_col", board_column()).groupBy("subteam")
         .pivot("_col", TASK_STATUSES).agg(F.count(F.lit(1))))
    return p.select("subteam", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                 for c in TASK_STATUSES])


def my_tasks(assignments: DataFrame, tasks: DataFrame) -> DataFrame:
    """O-22b: for each student, the tasks they are currently on."""
    pairs = open_assignments(assignments).select("task_id", "student_id").distinct()
    t = tasks.select(F.col("id").alias("task_id"), "title", "subteam", "status", "archived")
    return pairs.join(t, "task_id", "inner").withColumn(
        "label", task_label("subteam", "title", "status"))


# ------------------------------------------------------------ comments

def comment_attribute(requests: DataFrame, students: DataFrame, tasks: DataFrame | None = None):
    """O-57: a comment naming a student is signed with the roster name (any
    student, even inactive); otherwise the author is always a mentor with
    the trimmed label or 'Mentor'.  With ``tasks``, comments on tasks that are
    not among them are refused.  Returns ``(comments, rejects)``."""
    s = students.select("student_id", F.col("full_name").alias("_name"))
    df = requests.join(s, "student_id", "left")
    has_student = F.col("student_id").isNotNull()
    reason = (F.when(is_blank("comment"), F.lit("comment_missing"))
              .when(has_student & F.col("_name").isNull(), F.lit("student_unknown")))
    if tasks is not None:
        known = tasks.select(F.col("id").alias("task_id"), F.lit(True).alias("_task"))
        df = df.join(known, "task_id", "left")
        reason = reason.when(F.col("_task").isNull(), F.lit("task_unknown"))
    df = df.withColumn("reject_reason", reason)
    label = js_trim(F.coalesce(F.col("author_label"), F.lit("")))
    ok = df.where(F.col("reject_reason").isNull()).select(
        "id", "task_id",
        F.when(has_student, "student").otherwise("mentor").alias("author_type"),
        F.when(has_student, F.col("_name"))
         .otherwise(F.coalesce(blank_to_null(label), F.lit("Mentor"))).alias("author_label"),
        js_trim("comment").alias("comment"),
        F.col("at").alias("created_at"))
    rejects = df.where(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason")
    return ok, rejects


def comment_feed(comments: DataFrame, task_id: int | None = None) -> DataFrame:
    """O-37: comments oldest first (per task).  A global sort: range
    partitioning splits even one very busy task across tasks."""
    df = comments if task_id is None else comments.where(F.col("task_id") == task_id)
    return df.select("id", "task_id", "author_type", "author_label", "comment",
                     "created_at").orderBy("task_id", "created_at", "id")


# ------------------------------------------------------------ task fold

def validate_task_events(events: DataFrame, students: DataFrame, between: Callable = lambda df: df):
    """O-16: create needs a non-blank title and subteam; join / assign /
    clock-in need an active student; every other event needs a task that was
    created before it (by ``(at, seq)``).  Returns ``(valid, rejects)``.

    The first create per task is a ``min`` over a struct, joined back by
    task, so a busy task is reduced before the shuffle.  ``between`` may write
    the events out between the two joins, and return what it wrote."""
    act = students.where(F.col("is_active")).select(
        "student_id", F.lit(True).alias("_active"))
    kind = F.col("kind")
    creates = events.where((kind == "create") & ~is_blank("title") & ~is_blank("subteam"))
    born = creates.groupBy("task_id").agg(F.min(F.struct("at", "seq")).alias("_born"))
    opening = kind.isin(*OPENING_KINDS)
    reason = (F.when((kind == "create") & is_blank("title"), F.lit("title_missing"))
              .when((kind == "create") & is_blank("subteam"), F.lit("subteam_missing"))
              .when(opening & F.col("student_id").isNull(), F.lit("student_missing"))
              .when(opening & F.col("_active").isNull(), F.lit("student_unknown")))
    df = between(events.join(act, "student_id", "left").withColumn("reject_reason", reason).select(*events.columns, "reject_reason"))
    exists = F.coalesce(F.struct("at", "seq") >= F.col("_born"), F.lit(False))
    unborn = F.when((kind != "create") & ~exists, F.lit("task_unknown"))
    df = df.join(born, "task_id", "left").withColumn("reject_reason", F.coalesce("reject_reason", unborn)).select(*events.columns, "reject_reason")
    valid = df.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = df.where(F.col("reject_reason").isNotNull())
    return valid, rejects


def task_fold(task_events: DataFrame, as_of=None) -> DataFrame:
    """O-50..O-53, O-58 (contract C-5): the task table as of ``as_of``.

    create sets every field (invalid status -> todo); patch sets title and
    subteam if non-empty, description if given (may be ''), status if
    valid; archive / unarchive set the flag; a clock-in naming the task
    promotes 'todo' to 'in_progress' when it comes after the last explicit
    status; every event touches ``updated_at``.  Tasks never created are
    dropped."""
    ev = task_events if as_of is None else task_events.where(F.col("at") <= ts_lit(as_of))
    # Events before a task's create cannot touch it (there is no row yet).
    # No join is needed for that: the create writes every field (archived
    # included) later than any such event, so no last-writer aggregate can
    # pick one, and their times are below the create's.
    kind = F.col("kind")
    is_create, is_patch = kind == "create", kind == "patch"
    valid_st = F.col("status").isin(*TASK_STATUSES)
    title_t, sub_t = js_trim(F.col("title")), js_trim(F.col("subteam"))
    st_write = is_create | (is_patch & valid_st)
    order = F.struct("at", "seq")
    # Pure touches (join, leave, assign, comment) only move updated_at: a
    # hash aggregate reduces them; only field-writing events go through the
    # sort-based last-writer aggregate.  Both results are keyed by task.
    writes_fields = kind.isin(*FIELD_KINDS)
    touched = ev.where(~writes_fields).groupBy("task_id").agg(F.max("at").alias("_touched_at"))
    folded = ev.where(writes_fields).groupBy("task_id").agg(
        F.min(F.when(is_create, F.col("at"))).alias("created_at"),
        last_write(is_create | (is_patch & (F.coalesce(title_t, F.lit("")) != "")),
                   title_t).alias("title"),
        last_write(is_create | (is_patch & (F.coalesce(sub_t, F.lit("")) != "")),
                   sub_t).alias("subteam"),
        last_write(is_create | (is_patch & F.col("description").isNotNull()),
                   F.when(is_create, js_trim(F.coalesce(F.col("description"), F.lit(""))))
                   .otherwise(F.col("description"))).alias("description"),
        last_write(st_write, F.when(valid_st, F.col("status")).otherwise(F.lit("todo")))
        .alias("_status"),
        F.max(F.when(st_write, order)).alias("_status_at"),
        F.max(F.when(kind == "clock_in", order)).alias("_promote_at"),
        F.coalesce(last_write(kind.isin("create", "archive", "unarchive"), kind == "archive"),
                   F.lit(False)).alias("archived"),
        F.max("at").alias("_written_at"))
    folded = (folded.where(F.col("created_at").isNotNull())
              .join(touched, "task_id", "left")
              .withColumn("updated_at", F.greatest("_written_at", "_touched_at")))
    promoted = ((F.col("_status") == "todo") & F.col("_promote_at").isNotNull()
                & (F.col("_promote_at") > F.col("_status_at")))
    return folded.select(
        F.col("task_id").alias("id"), "title", "subteam",
        F.when(promoted, F.lit("in_progress")).otherwise(F.col("_status")).alias("status"),
        "description", "archived", "created_at", "updated_at")

"""Registered queries of what crosses tables, or the order of rows: the task log with
punches and comments routed into it, positions, chosen list parameters, stored sessions,
day streams and the exact replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import attendance as att
from ..operators import bridge
from ..operators import corrections as corr
from ..operators import positions as pos
from ..operators import roster as ro
from ..operators import sessions as ses
from ..operators import tasks as tk
from ..operators.audits import repair_fk
from ..operators.gate import gate_active
from ..operators.lists import assignee_chunks
from ..operators.replay import replayed_sessions
from ..operators.rollover import append_facts, read_season, season_rollover, seasons
from ..operators.session_changes import apply_changes, session_changes
from ..sources import views as V
from ..sources.day_table import DayTable
from ..sources.generations import read_generations, write_generation
from ..session import shuffles_dropped
from ..sources.staging import discard, hand_over, scratch_path, staged
from ..sources.tables import read_table
from ..streaming.corrections_stream import punches_on_days
from ..streaming.session_days import SessionDays
from ..streaming.task_tables import INTERVALS, TASKS, TaskTables
from . import catalog as C
from . import oracle_views as O
from .catalog import query
from .inputs import Inputs

# ---------------------------------------------------------------- task log

_EDITS = f"""
task_edits AS (
  SELECT o_orderkey AS task_id, o_orderdate + INTERVAL 1 DAY AS "at", 2::BIGINT AS seq, 'patch' AS kind, NULL::BIGINT AS student_id,
         CASE o_custkey % 3 WHEN 0 THEN ' Order ' || o_orderkey || ' rev ' WHEN 1 THEN '  ' END AS title,
         CASE o_orderstatus WHEN 'P' THEN 'Build' WHEN 'O' THEN '' END AS subteam,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'blocked' WHEN '2' THEN 'paused' WHEN '4' THEN 'todo' END AS status,
         CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN ' see notes ' END AS description
  FROM orders
  UNION ALL
  SELECT o_orderkey, o_orderdate + INTERVAL 2 DAY, 3, 'unarchive', NULL, NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'F' AND left(o_orderpriority, 1) IN ('1', '2')
  UNION ALL
  SELECT l_orderkey, l_shipdate + INTERVAL 3 DAY, l_linenumber * 2 + 100, 'assign', l_suppkey, NULL, NULL, NULL, NULL
  FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL
  SELECT p_partkey + 1000000000, TIMESTAMP '1999-12-25 00:00:00', 0, 'create', NULL,
         CASE WHEN p_size % 5 = 0 THEN '   ' ELSE ' ' || p_name END, CASE WHEN p_size % 5 <> 1 THEN p_brand END, p_type, NULL
  FROM part
  UNION ALL
  SELECT p_partkey + 1000000000, TIMESTAMP '1999-12-26 00:00:00', 1, 'join', CASE WHEN p_size % 2 = 0 THEN p_partkey END, NULL, NULL, NULL, NULL
  FROM part
)"""
_PUNCH_EVENTS = """
punch_task_events AS (
  SELECT task_id, "at", 4 * seq + 1 AS seq, 'clock_in' AS kind, student_id, NULL::VARCHAR AS title, NULL::VARCHAR AS subteam,
         NULL::VARCHAR AS status, NULL::VARCHAR AS description
  FROM punches WHERE kind = 'clock_in' AND task_id IS NOT NULL
)"""
_LOG = (O.STUDENTS, O.PUNCHES, O.TASKS, C._COMMENT_REQUESTS, _EDITS, _PUNCH_EVENTS,
        O.TASK_EVENTS.replace("task_events AS (", "own_events AS (", 1), """
task_events AS (
  SELECT * REPLACE (4 * seq AS seq) FROM (SELECT * FROM own_events WHERE kind <> 'comment' UNION ALL FROM task_edits)
  UNION ALL FROM punch_task_events
  UNION ALL SELECT task_id, "at", 4 * id + 2, 'comment', NULL, NULL, NULL, NULL, NULL FROM judged WHERE reject_reason IS NULL
)""", C._VALID_TASK_EVENTS)


def _task_log(spark, sf_dir, **steps):
    i = Inputs.of(spark, sf_dir)
    own = i.task_events.where(F.col("kind") != "comment").unionByName(V.task_edits(spark, sf_dir))
    comments, _ = tk.comment_attribute(V.comment_requests(spark, sf_dir), i.students, i.tasks)
    return tk.validate_task_events(bridge.task_log(own, i.punches, comments), i.students, **steps)


@query("punch_task_events", O.with_(O.STUDENTS, O.PUNCHES, _PUNCH_EVENTS) + "FROM punch_task_events")
def q_punch_task_events(spark, sf_dir):
    """O-53/O-54: clock-ins that name a task, as events of the task log."""
    return bridge.punch_task_events(Inputs.of(spark, sf_dir).punches)


@query("task_log_rejects", O.with_(*_LOG) + "SELECT * FROM task_rejects WHERE reject_reason IS NOT NULL")
def q_task_log_rejects(spark, sf_dir):
    """O-16 over the whole log: every reason occurs."""
    return _task_log(spark, sf_dir)[1]


@query("task_log_fold", O.with_(*_LOG, C._task_fold_sql(O.ATT_AS_OF)) + C._TASK_FOLD_COLUMNS)
def q_task_log_fold(spark, sf_dir):
    """O-50..O-53, O-58 over the whole log: patches, unarchiving, promotion by clock-ins."""
    return tk.task_fold(_task_log(spark, sf_dir)[0], V.ATTENDANCE_AS_OF)


@query("task_log_intervals", O.with_(*_LOG, C._INTERVALS_SQL) + """
SELECT task_id, student_id, "at" AS assigned_at, nxt AS unassigned_at FROM c2 WHERE opens""")
def q_task_log_intervals(spark, sf_dir):
    """O-54..O-56 over the whole log: joins, assignments, clock-ins and leaves."""
    return tk.assignment_intervals(_task_log(spark, sf_dir)[0])


def _task_stream(spark, sf_dir, *folds) -> TaskTables:
    """The whole log in three deliveries: two spans of time, then the rest with all assignments, most of them late.
    It is written once, by delivery; a delivery is handed over by moving its folder, and dropped when it is merged."""
    root = scratch_path(spark, "task-tables")
    last = (F.col("at") >= F.lit("1997-01-01").cast("timestamp_ntz")) | (F.col("kind") == "assign")
    early = F.col("at") < F.lit("1995-01-01").cast("timestamp_ntz")

    def between(judged):
        judged.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/judged")
        return spark.read.schema(judged.schema).parquet(f"{root}/judged")

    with shuffles_dropped(spark):
        log = _task_log(spark, sf_dir, between=between)[0].select(*schemas.TASK_EVENTS.fieldNames())
        part = F.when(last, 2).when(early, 0).when(~early, 1)           # an event without a time is in none
        log.withColumn("delivery", part).where("delivery IS NOT NULL").write.partitionBy("delivery").option("compression", "zstd").parquet(f"{root}/log")
    discard(spark, f"{root}/judged")
    tables = TaskTables(spark, f"{root}/tables", folds)
    for k in range(3):
        if hand_over(spark, f"{root}/log/delivery={k}", f"{root}/in/{k}"):
            stream = spark.readStream.schema(schemas.TASK_EVENTS).option("maxBytesPerTrigger", str(64 << 30)).parquet(f"{root}/in/*")
            tables = TaskTables(spark, f"{root}/tables", folds)      # a restart each time
            tables.drain(stream)
            discard(spark, f"{root}/in/{k}")
    return tables


@query("task_intervals_stream", O.with_(*_LOG, C._INTERVALS_SQL) + """
SELECT task_id, student_id, "at" AS assigned_at, nxt AS unassigned_at FROM c2 WHERE opens""")
def q_task_intervals_stream(spark, sf_dir):
    """§2.9, O-54..O-56: the interval table after three deliveries; open intervals are carried across batches."""
    return _task_stream(spark, sf_dir, INTERVALS).read(INTERVALS)


@query("task_fold_stream", O.with_(*_LOG, C._task_fold_sql("TIMESTAMP '9999-12-31 00:00:00'")) + C._TASK_FOLD_COLUMNS)
def q_task_fold_stream(spark, sf_dir):
    """§2.9, O-50..O-53, O-58: the task table after three deliveries."""
    return _task_stream(spark, sf_dir, TASKS).read(TASKS).withColumnRenamed("task_id", "id")


# ---------------------------------------------------------------- positions


@query("roster_active_ordered", O.with_(O.STUDENTS) + """
SELECT student_id, full_name, subteam, row_number() OVER (ORDER BY full_name, student_id) AS position FROM students WHERE is_active""")
def q_roster_active_ordered(spark, sf_dir):
    """O-01 in the order of the sign-in list (O-33)."""
    return pos.with_position(ro.roster_active(Inputs.of(spark, sf_dir).students), [F.col("full_name"), F.col("student_id")])


@query("roster_all_ordered", O.with_(O.STUDENTS) + """
SELECT student_id, full_name, subteam, is_active, row_number() OVER (ORDER BY full_name, student_id) AS position FROM students""")
def q_roster_all_ordered(spark, sf_dir):
    """O-02 in name order."""
    return pos.with_position(ro.roster_all(Inputs.of(spark, sf_dir).students), [F.col("full_name"), F.col("student_id")])


@query("task_board_ordered", "SELECT *, row_number() OVER (ORDER BY status_rank, updated_at DESC, id) AS position FROM ("
       + C.ORACLE["task_board"] + ")")
def q_task_board_ordered(spark, sf_dir):
    """O-36: the board's cards in their order."""
    i = Inputs.of(spark, sf_dir)
    board = tk.task_board(i.tasks, i.assignments, i.comments, i.students, V.TASK_AS_OF, sort=False)
    return pos.with_position(board, [F.col("status_rank"), F.col("updated_at").desc(), F.col("id")])


@query("comment_feed_ordered", O.with_(O.COMMENTS) + """
SELECT id, task_id, author_type, author_label, comment, created_at,
       row_number() OVER (PARTITION BY task_id ORDER BY created_at, id) AS position FROM task_comments""")
def q_comment_feed_ordered(spark, sf_dir):
    """O-37: each comment's place in its task's feed."""
    c = Inputs.of(spark, sf_dir).comments.select("id", "task_id", "author_type", "author_label", "comment", "created_at")
    return pos.with_position(c, [F.col("created_at"), F.col("id")], within=["task_id"])


@query("needs_queue_ordered", "SELECT *, row_number() OVER (PARTITION BY kind ORDER BY requested_at NULLS LAST, student_id) AS position FROM ("
       + C.ORACLE["needs_queue"] + ")")
def q_needs_queue_ordered(spark, sf_dir):
    """O-10b: each request's place in its queue, oldest first."""
    i = Inputs.of(spark, sf_dir, C._BOARD_DAYS)
    queue = att.needs_queue(att.status_board(i.students, i.all_punches, V.BOARD_AS_OF))
    return pos.with_position(queue, [F.col("requested_at").asc_nulls_last(), F.col("student_id")], within=["kind"])


# ---------------------------------------------------------------- chosen parameters

_DAY = "2024-01-15"


def _listed_sql(where: str) -> str:
    return O.with_(*C._CORR_BASE) + f"""
SELECT c.*, s.full_name, s.subteam AS roster_subteam
FROM corrections c JOIN students s ON s.student_id = c.student_id WHERE {where}
ORDER BY c.created_at DESC, c.id DESC LIMIT 200"""


def _listed(name: str, where: str, **chosen):
    @query(name, _listed_sql(where))
    def q(spark, sf_dir):
        i = Inputs.of(spark, sf_dir)
        return corr.corrections_list(i.corrections, i.students, **chosen)
    q.__doc__ = f"O-12/O-13: the corrections list with {chosen}."


_listed("corrections_list_all", "true", status="ALL")
_listed("corrections_list_denied", "c.status = 'denied'", status="denied")
_listed("corrections_list_day", f"c.status = 'approved' AND c.meeting_date = DATE '{_DAY}'", status="Approved", date=_DAY)


def _board(name: str, where: str, **chosen):
    @query(name, "SELECT * FROM (" + C.ORACLE["task_board"].replace("FROM (FROM tasks WHERE NOT archived) shown", f"FROM (FROM tasks WHERE {where}) shown") + ")")
    def q(spark, sf_dir):
        i = Inputs.of(spark, sf_dir)
        return tk.task_board(i.tasks, i.assignments, i.comments, i.students, V.TASK_AS_OF, sort=False, **chosen)
    q.__doc__ = f"O-14: the task board with {chosen}."


_board("task_board_blocked_build", "NOT archived AND subteam = 'Build' AND status = 'blocked'", subteam=" Build ", status="blocked")
_board("task_board_archived", "subteam = 'CAD/CAM'", subteam="CAD/CAM", status=" ", include_archived=True)


@query("status_board_past_day", C._BOARD_SQL.replace(O.BOARD_DAY, "DATE '2024-01-10'") + "SELECT * FROM board")
def q_status_board_past_day(spark, sf_dir):
    """O-19 for a day that is over, seen from the board's instant."""
    import datetime as dt
    day = dt.date(2024, 1, 10)
    i = Inputs.of(spark, sf_dir, (day, day))
    return att.status_board(i.students, i.all_punches, V.BOARD_AS_OF, day=day)


# ---------------------------------------------------------------- stored sessions, streams


@query("sessions_stored", C.ORACLE["auto_close"])
def q_sessions_stored(spark, sf_dir):
    """C-4: sessions stored by day, the days of approved corrections replaced in one
    commit, read back at the attendance instant."""
    return ses.auto_close(_stored(spark, sf_dir).read(), V.ATTENDANCE_AS_OF)


@query("attendance_report_stored", C.ORACLE["attendance_report"])
def q_attendance_report_stored(spark, sf_dir):
    """The report from stored sessions: only the range's days are read."""
    days = _stored(spark, sf_dir).read(V.REPORT_START, V.REPORT_END)
    return att.attendance_report(Inputs.of(spark, sf_dir).students, ses.auto_close(days, V.ATTENDANCE_AS_OF), V.REPORT_START, V.REPORT_END)


def _stored(spark, sf_dir) -> DayTable:
    i = Inputs.of(spark, sf_dir)
    table = DayTable(spark, scratch_path(spark, "sessions-stored"), schemas.DAILY_SESSIONS)
    table.replace(ses.session_fold(i.punches, V.ATTENDANCE_AS_OF))
    late = staged(ses.punches_until(i.set_events, V.ATTENDANCE_AS_OF), "set-events")
    days = late.select("meeting_date").distinct()
    log = i.punches.unionByName(late)
    table.replace(ses.session_fold(punches_on_days(log, days), V.ATTENDANCE_AS_OF), {r[0] for r in days.collect()})
    return table


#: How the events reach the stream: three deliveries, each with all days, by what the devices send first.
DELIVERIES = [["signup", "purchase"], ["view"], ["click", "error"]]


def _streamed(spark, sf_dir) -> SessionDays:
    i = Inputs.of(spark, sf_dir)
    root = scratch_path(spark, "session-days")
    events = read_table(spark, sf_dir, "events")
    for kinds in DELIVERIES:
        events.where(F.col("event_type").isin(*kinds)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(V.EVENTS_SCHEMA).option("maxBytesPerTrigger", str(64 << 30)).parquet(f"{root}/in")
        days = SessionDays(spark, f"{root}/tables")        # a restart each time
        days.drain(gate_active(V.punches_from_events(stream), i.students))
    return days


@query("session_days_stream", O.with_(O.STUDENTS, O.PUNCHES, O.session_fold("punches", "TIMESTAMP '9999-12-31 00:00:00'")) + "SELECT * FROM sessions_raw")
def q_session_days_stream(spark, sf_dir):
    """§2.9: the session table after three deliveries in any order; nothing is dropped."""
    return _streamed(spark, sf_dir).sessions.read()


@query("session_late_punches", O.with_(O.STUDENTS, O.PUNCHES, f"""
delivered AS (
  SELECT *, CASE WHEN kind IN ('clock_in', 'clock_out') THEN 0 WHEN kind = 'update' THEN 1 ELSE 2 END AS epoch,
         timezone('America/New_York', timezone('UTC', "at")) AS wall
  FROM punches
),
latest AS (SELECT epoch, max(max(wall)) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_until FROM delivered GROUP BY epoch)""") + """
SELECT d.* EXCLUDE (wall, epoch), d.epoch::BIGINT AS epoch, seen_until FROM delivered d JOIN latest l ON l.epoch = d.epoch
WHERE CAST(CAST(wall AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= seen_until - INTERVAL 25 HOUR""")
def q_session_late_punches(spark, sf_dir):
    """§2.9: the audited log of punches that came after their day was closed."""
    return _streamed(spark, sf_dir).late()


_FOLDS = O.with_(*C._ATT_BASE, O.session_fold("all_punches", O.BOARD_AS_OF, "before"), O.session_fold("all_punches", O.ATT_AS_OF, "after"))


@query("session_changes", _FOLDS + """
SELECT 'out' AS op, * FROM (FROM before EXCEPT FROM after) UNION ALL SELECT 'in', * FROM (FROM after EXCEPT FROM before)""")
def q_session_changes(spark, sf_dir):
    """O-46/O-47: what the log between two instants did to the session table."""
    return session_changes(Inputs.of(spark, sf_dir).all_punches, V.BOARD_AS_OF, V.ATTENDANCE_AS_OF)


@query("session_changes_applied", _FOLDS + "FROM after")
def q_session_changes_applied(spark, sf_dir):
    """The stored table of the first instant after those changes: that of the second."""
    log = Inputs.of(spark, sf_dir).all_punches
    changes = staged(session_changes(log, V.BOARD_AS_OF, V.ATTENDANCE_AS_OF), "session-changes")
    return apply_changes(ses.session_fold(log, V.BOARD_AS_OF), changes)


# The state machine row by row: a close is taken when the session is open and a sweep falls
# between this event and the next.
_REPLAY = f"""
manual_in AS (
  SELECT student_id, "at", seq, 'set_in' AS kind, d AS meeting_date, NULL::VARCHAR AS subteam, NULL::VARCHAR AS working_on,
         NULL::BIGINT AS task_id, NULL::BOOLEAN AS value, {O.local_to_utc("d + CAST(clock_in_time AS TIME)")} AS set_in, NULL::TIMESTAMP AS set_out
  FROM manual_ok WHERE clock_in_time <> ''
),
replay_log AS (FROM all_punches UNION ALL FROM manual_in),
sweep AS (
  SELECT DISTINCT t FROM (SELECT "at" AS t FROM replay_log WHERE kind = 'clock_in' UNION ALL
                          SELECT ts + INTERVAL 90 MINUTE FROM events WHERE event_type = 'view')
  WHERE t <= {O.ATT_AS_OF}
),
ev AS (
  SELECT student_id, coalesce(meeting_date, {O.eastern_date('"at"')}) AS md, "at", seq, kind, set_in, set_out
  FROM replay_log WHERE "at" <= {O.ATT_AS_OF} AND kind IN ('clock_in', 'clock_out', 'set_in', 'set_out', 'set_both')
),
numbered_ev AS (
  SELECT *, row_number() OVER o AS n, coalesce(lead("at") OVER o, {O.ATT_AS_OF}) AS until,
         coalesce(struct_extract(last_value(CASE WHEN kind IN ('set_in', 'set_both') THEN {{'v': set_in}} END IGNORE NULLS) OVER o, 'v'),
                  min(CASE WHEN kind = 'clock_in' THEN "at" END) OVER o) AS cin
  FROM ev WINDOW o AS (PARTITION BY student_id, md ORDER BY "at", seq)
),
timed AS MATERIALIZED (
  SELECT e.*, s.t AS swept FROM (SELECT *, greatest("at", cin + INTERVAL 4 HOUR) AS due FROM numbered_ev) e ASOF LEFT JOIN sweep s ON s.t > e.due
),
machine AS (
  SELECT student_id, md, 0::BIGINT AS n, NULL::TIMESTAMP AS cout, NULL::TIMESTAMP AS closed FROM (SELECT DISTINCT student_id, md FROM ev)
  UNION ALL
  SELECT student_id, md, n, CASE WHEN written IS NULL AND closes THEN cin + INTERVAL 4 HOUR ELSE written END,
         CASE WHEN written IS NULL AND closes THEN swept END
  FROM (SELECT t.*, t.cin IS NOT NULL AND t.swept <= t.until AS closes,
               CASE t.kind WHEN 'clock_in' THEN NULL WHEN 'clock_out' THEN t."at" WHEN 'set_in' THEN m.cout ELSE t.set_out END AS written
        FROM machine m JOIN timed t ON t.student_id = m.student_id AND t.md = m.md AND t.n = m.n + 1)
),
at_end AS (SELECT student_id, md, arg_max({{'o': cout}}, n).o AS cout, max(closed) AS closed FROM machine GROUP BY ALL)"""


@query("sessions_replayed", (O.with_(*C._ATT_BASE, C._MANUAL_SQL, _REPLAY, O.session_fold("replay_log", O.ATT_AS_OF)) + """
SELECT s.* REPLACE (CASE WHEN e.md IS NULL THEN s.clock_out_at ELSE e.cout END AS clock_out_at, greatest(s.updated_at, e.closed) AS updated_at)
FROM sessions_raw s LEFT JOIN at_end e ON e.student_id = s.student_id AND e.md = s.meeting_date""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_sessions_replayed(spark, sf_dir):
    """C-2: the table with every sweep of clock-ins and dashboard reads played; clock-in
    times are also corrected by manual entries long after they were swept."""
    i = Inputs.of(spark, sf_dir)
    entries = V.manual_entries(spark, sf_dir).where(F.col("clock_in_time") != "").select(
        "student_id", "at", "seq", "meeting_date", "clock_in_time", F.lit("").alias("clock_out_time"), F.lit("").alias("subteam"),
        F.lit(None).cast("string").alias("working_on"))
    manual, _ = corr.manual_attendance(entries, i.students, "patch")
    return replayed_sessions(i.all_punches.unionByName(manual), V.dashboard_reads(spark, sf_dir), V.ATTENDANCE_AS_OF)


# ---------------------------------------------------------------- generations, seasons, repairs, chunks


def _generations(spark, table, old, new):
    root = scratch_path(spark, f"generations-{table}")
    write_generation(old, root, table, 1)
    write_generation(new, root, table, 2)
    return read_generations(spark, root, table)


@query("tasks_generations", O.with_(O.TASKS) + """
SELECT * REPLACE (archived AND created_at >= TIMESTAMP '1998-01-01' AS archived) FROM tasks""")
def q_tasks_generations(spark, sf_dir):
    """O-04: tasks made before 1998 lie in files without ``archived`` and ``description``."""
    t, young = Inputs.of(spark, sf_dir).tasks, F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return _generations(spark, "tasks", t.where(~young), t.where(young))


@query("sessions_generations", O.with_(*C._ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF)) + f"""
SELECT * REPLACE (CASE WHEN meeting_date >= {O.REPORT_START} THEN task_id END AS task_id) FROM sessions_raw""")
def q_sessions_generations(spark, sf_dir):
    """O-04: sessions before the report's first day lie in files without ``task_id``."""
    s = staged(ses.session_fold(Inputs.of(spark, sf_dir).all_punches, V.ATTENDANCE_AS_OF), "sessions")
    young = F.col("meeting_date") >= F.lit(V.REPORT_START)
    return _generations(spark, "daily_sessions", s.where(~young), s.where(young))


def _seasons(spark, sf_dir) -> str:
    """Three seasons: the roster as it was, after the edits, and after the upload; the
    second one also has that year's assignments."""
    i = Inputs.of(spark, sf_dir)
    root = scratch_path(spark, "seasons")
    season_rollover(spark, i.students, root, "2023", "RESET", True)
    season_rollover(spark, ro.roster_patch(read_season(spark, root, "students"), V.roster_patches(spark, sf_dir))[0], root, "2024", "RESET", True)
    append_facts(i.assignments, root, "task_assignments")
    season_rollover(spark, ro.roster_upsert(read_season(spark, root, "students", "2023"), V.roster_requests(spark, sf_dir), reactivate=True)[0].where(~F.col("is_new")),
                    root, "2025", "RESET", True)
    return root


_SEASON_SQL = O.with_(O.STUDENTS, C._PATCH_SQL, C._ROSTER_REQ_SQL) + """
SELECT '2023' AS season, * FROM students_full
UNION ALL
SELECT '2024', s.student_id, coalesce(nullif(trim(p.full_name), ''), s.full_name), coalesce(p.subteam, s.subteam),
       coalesce(p.is_active, s.is_active), s.created_at
FROM students_full s LEFT JOIN (FROM judged_patches WHERE reject_reason IS NULL) p ON p.student_id = s.student_id
UNION ALL
SELECT '2025', s.student_id, s.full_name, CASE WHEN r.full_name IS NULL THEN s.subteam ELSE r.req_subteam END,
       s.is_active OR r.full_name IS NOT NULL, s.created_at
FROM students_full s LEFT JOIN req_last r ON r.full_name = s.full_name"""


@query("season_rosters", _SEASON_SQL)
def q_season_rosters(spark, sf_dir):
    """O-67: every season's roster, read as of that season."""
    root = _seasons(spark, sf_dir)
    parts = [read_season(spark, root, "students", s).select(F.lit(s).alias("season"), "*") for s in ("2023", "2024", "2025")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("season_current", O.with_(O.STUDENTS, O.ASSIGNMENTS) + """
SELECT * FROM (VALUES (1::BIGINT, '2023', false), (2, '2024', false), (3, '2025', true)) v(version, season, is_current)
JOIN (SELECT count(*) AS n_students FROM students) ON true
JOIN (SELECT count(*) AS n FROM task_assignments) ON true
""".replace("SELECT * FROM (VALUES", "SELECT version, season, is_current, n_students, CASE season WHEN '2024' THEN n ELSE 0 END AS n_assignments FROM (VALUES"))
def q_season_current(spark, sf_dir):
    """O-67: the chain of seasons, which one is current, and what each holds when read."""
    root = _seasons(spark, sf_dir)
    chain = seasons(spark, root)
    now = chain.orderBy(F.desc("version")).limit(1).select("version", F.lit(True).alias("is_current"))
    rows = [read_season(spark, root, t, s).select(F.lit(s).alias("season"), F.lit(t).alias("t")) for s in ("2023", "2024", "2025") for t in ("students", "task_assignments")]
    held = reduce(DataFrame.unionByName, rows).groupBy("season").agg(
        F.count_if(F.col("t") == "students").alias("n_students"), F.count_if(F.col("t") == "task_assignments").alias("n_assignments"))
    return (chain.join(now, "version", "left").join(held, "season")
            .select("version", "season", F.coalesce("is_current", F.lit(False)).alias("is_current"), "n_students", "n_assignments"))


@query("fk_repaired", O.with_(*C._AUDIT_BASE) + """
SELECT 'task_assignments' AS table_name, id::VARCHAR AS row_key, task_id, student_id FROM task_assignments
WHERE task_id IN (SELECT id FROM restored_tasks) AND student_id IN (SELECT student_id FROM students)
UNION ALL SELECT 'task_comments', id::VARCHAR, task_id, NULL FROM restored_comments WHERE task_id IN (SELECT id FROM restored_tasks)
UNION ALL SELECT 'daily_sessions', student_id || ' ' || meeting_date, CASE WHEN task_id IN (SELECT id FROM restored_tasks) THEN task_id END, student_id
FROM sessions_raw WHERE student_id IN (SELECT student_id FROM students)""")
def q_fk_repaired(spark, sf_dir):
    """O-62: the tables after their foreign keys' policies, written and read back."""
    i = Inputs.of(spark, sf_dir)
    fixed = repair_fk({"students": i.students, "tasks": V.restored_tasks(spark, sf_dir), "task_assignments": i.assignments,
                       "task_comments": V.restored_comments(spark, sf_dir), "daily_sessions": ses.session_fold(i.all_punches, V.ATTENDANCE_AS_OF)})
    keys = {"task_assignments": F.col("id").cast("string"), "task_comments": F.col("id").cast("string"),
            "daily_sessions": F.concat_ws(" ", F.col("student_id"), F.col("meeting_date").cast("string"))}
    parts = [staged(fixed[t], t).withColumn("student_id", F.col("student_id") if t != "task_comments" else F.lit(None).cast("long"))
             .select(F.lit(t).alias("table_name"), key.alias("row_key"), "task_id", "student_id") for t, key in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("task_assignee_chunks", O.with_(*C._TASK_BASE) + """
SELECT task_id, chunk, 3 * chunk AS n_before,
       '[' || string_agg(CAST(json_object('student_id', student_id, 'full_name', full_name) AS VARCHAR), ',' ORDER BY full_name, student_id) || ']' AS assignees
FROM (SELECT *, (row_number() OVER (PARTITION BY task_id ORDER BY full_name, student_id) - 1) // 3 AS chunk
      FROM (SELECT DISTINCT task_id, student_id, full_name FROM task_assignments JOIN students USING (student_id) WHERE unassigned_at IS NULL))
GROUP BY task_id, chunk""")
def q_task_assignee_chunks(spark, sf_dir):
    """O-22/O-30: ordered assignee lists in chunks (of three, so that tasks have several)."""
    i = Inputs.of(spark, sf_dir)
    return assignee_chunks(i.assignments, i.students, 3).withColumn("assignees", tk.assignees_json("assignees"))

"""Registered queries: one per operator of the inventory, each a
``(spark, sf_dir) -> DataFrame`` over the shared test tables, with its DuckDB
oracle SQL next to it (``oracle_sql``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import JS_TRIM_RE
from ..functions.timez import eastern_date_of
from ..operators import attendance as att
from ..operators import audits as au
from ..operators import corrections as corr
from ..operators import roster as ro
from ..operators import sessions as ses
from ..operators import tasks as tk
from ..operators.gate import gate_rejects
from ..sources import views as V
from . import oracle_views as O
from .inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- roster

@query("roster_active", O.with_(O.STUDENTS) + """
SELECT student_id, full_name, subteam FROM students WHERE is_active""")
def q_roster_active(spark, sf_dir):
    from ..operators.roster import roster_active
    return roster_active(Inputs.of(spark, sf_dir).students)


@query("roster_all", O.with_(O.STUDENTS) + """
SELECT student_id, full_name, subteam, is_active FROM students""")
def q_roster_all(spark, sf_dir):
    from ..operators.roster import roster_all
    return roster_all(Inputs.of(spark, sf_dir).students)


# ---------------------------------------------------------------- gate

@query("gate_active", O.with_(O.STUDENTS, O.PUNCHES) + """
SELECT * FROM punches""")
def q_gate_active(spark, sf_dir):
    return Inputs.of(spark, sf_dir).punches


@query("gate_rejects", O.with_(O.STUDENTS, O.PUNCHES) + """
SELECT *, 'student_unknown' AS reject_reason FROM punches_all
WHERE student_id NOT IN (SELECT student_id FROM students WHERE is_active)""")
def q_gate_rejects(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return gate_rejects(i.raw_punches, i.students)


# ---------------------------------------------------------------- sessions

_ATT_BASE = (O.STUDENTS, O.PUNCHES, O.CORRECTIONS, O.ALL_PUNCHES)


@query("session_fold", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF)) + """
SELECT * FROM sessions_raw""")
def q_session_fold(spark, sf_dir):
    return ses.session_fold(Inputs.of(spark, sf_dir).all_punches, V.ATTENDANCE_AS_OF)


@query("auto_close", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF),
                             O.auto_close("sessions_raw", O.ATT_AS_OF)) + """
SELECT * FROM sessions""")
def q_auto_close(spark, sf_dir):
    return ses.daily_sessions(Inputs.of(spark, sf_dir).all_punches, V.ATTENDANCE_AS_OF)


_STATE_SQL = """CASE WHEN clock_in_at IS NOT NULL AND clock_out_at IS NULL THEN 'clocked_in'
     WHEN clock_in_at IS NOT NULL AND clock_out_at IS NOT NULL THEN 'clocked_out'
     ELSE 'not_clocked_in' END"""


@query("clock_state", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.BOARD_AS_OF),
                              O.auto_close("sessions_raw", O.BOARD_AS_OF)) + f"""
SELECT student_id, meeting_date, {_STATE_SQL} AS status FROM sessions""")
def q_clock_state(spark, sf_dir):
    s = ses.daily_sessions(Inputs.of(spark, sf_dir).all_punches, V.BOARD_AS_OF)
    return ses.session_states(s)


@query("need_state", O.with_(
    O.STUDENTS, O.PUNCHES,
    "\nneeds AS (SELECT * FROM punches WHERE kind IN ('need_help', 'need_task'))",
    O.session_fold("needs", O.BOARD_AS_OF)) + """
SELECT student_id, meeting_date, need_help, need_help_at, need_task, need_task_at
FROM sessions_raw""")
def q_need_state(spark, sf_dir):
    return ses.need_state(Inputs.of(spark, sf_dir).punches, V.BOARD_AS_OF)


_BOARD_SQL = O.with_(*_ATT_BASE, O.session_fold("all_punches", O.BOARD_AS_OF),
                     O.auto_close("sessions_raw", O.BOARD_AS_OF), f"""
phases(phase, status, badge) AS (
  VALUES (0, 'not_clocked_in', '—'), (1, 'clocked_in', 'IN'), (2, 'clocked_out', 'OUT')
),
that_day AS (
  SELECT *, CASE WHEN clock_in_at IS NULL THEN 0 ELSE 1 + (clock_out_at IS NOT NULL)::INT END AS phase
  FROM sessions WHERE meeting_date = {O.BOARD_DAY}
),
board AS (
  SELECT r.student_id, r.full_name, coalesce(x.subteam, r.subteam) AS subteam,
         x.* EXCLUDE (student_id, subteam, task_id, phase), p.status, p.badge
  FROM (FROM students WHERE is_active) r
  LEFT JOIN that_day x ON x.student_id = r.student_id
  JOIN phases p ON p.phase = coalesce(x.phase, 0)
)""")


_BOARD_DAYS = (eastern_date_of(V.BOARD_AS_OF),) * 2


def _board(spark, sf_dir):
    i = Inputs.of(spark, sf_dir, _BOARD_DAYS)
    return att.status_board(i.students, i.all_punches, V.BOARD_AS_OF)


@query("status_board", _BOARD_SQL + "SELECT * FROM board")
def q_status_board(spark, sf_dir):
    return _board(spark, sf_dir)


@query("status_tiles", _BOARD_SQL + """
SELECT count(*) FILTER (WHERE clock_in_at IS NOT NULL AND clock_out_at IS NULL) AS clocked_in,
       count(*) FILTER (WHERE clock_in_at IS NOT NULL AND clock_out_at IS NOT NULL) AS clocked_out,
       count(*) FILTER (WHERE clock_in_at IS NULL) AS not_clocked_in,
       count(*) FILTER (WHERE need_help) AS need_help,
       count(*) FILTER (WHERE need_task) AS need_task,
       count(*) FILTER (WHERE need_help) + count(*) FILTER (WHERE need_task) AS help_or_task
FROM board""")
def q_status_tiles(spark, sf_dir):
    return att.status_tiles(_board(spark, sf_dir))


@query("status_tiles_by_subteam", _BOARD_SQL + """
SELECT subteam,
       count(*) FILTER (WHERE clock_in_at IS NOT NULL AND clock_out_at IS NULL) AS clocked_in,
       count(*) FILTER (WHERE clock_in_at IS NOT NULL AND clock_out_at IS NOT NULL) AS clocked_out,
       count(*) FILTER (WHERE clock_in_at IS NULL) AS not_clocked_in,
       count(*) FILTER (WHERE need_help) AS need_help,
       count(*) FILTER (WHERE need_task) AS need_task,
       count(*) FILTER (WHERE need_help) + count(*) FILTER (WHERE need_task) AS help_or_task
FROM board GROUP BY subteam""")
def q_status_tiles_by_subteam(spark, sf_dir):
    return att.status_tiles(_board(spark, sf_dir), by_subteam=True)


@query("needs_queue", _BOARD_SQL + """
SELECT 'help' AS kind, student_id, full_name, subteam, working_on, need_help_at AS requested_at
FROM board WHERE need_help
UNION ALL
SELECT 'task', student_id, full_name, subteam, working_on, need_task_at FROM board WHERE need_task""")
def q_needs_queue(spark, sf_dir):
    return att.needs_queue(_board(spark, sf_dir))


def _fmt_time_sql(col):
    return (f"coalesce(strftime(timezone('America/New_York', timezone('UTC', {col})), "
            f"'%I:%M %p'), '—')")


@query("board_display", _BOARD_SQL + f"""
SELECT student_id,
       CASE WHEN coalesce(subteam, '') = '' THEN full_name
            ELSE full_name || ' (' || subteam || ')' END AS label,
       badge,
       coalesce(strftime(meeting_date, '%m/%d/%Y'), '') AS day,
       {_fmt_time_sql('clock_in_at')} AS in_time,
       {_fmt_time_sql('clock_out_at')} AS out_time,
       coalesce(working_on, '') AS working_on,
       concat_ws(' ', CASE WHEN need_help THEN 'HELP' END,
                 CASE WHEN need_task THEN 'TASK' END) AS flags
FROM board""")
def q_board_display(spark, sf_dir):
    return att.board_display(_board(spark, sf_dir))


@query("student_today", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.BOARD_AS_OF),
                                O.auto_close("sessions_raw", O.BOARD_AS_OF)) + f"""
SELECT s.student_id, {O.BOARD_DAY} AS day,
       {_STATE_SQL.replace('clock_', 'ds.clock_')} AS status,
       ds.clock_in_at, ds.clock_out_at, ds.subteam, ds.working_on, ds.need_help,
       ds.need_task, ds.task_id
FROM students s
LEFT JOIN sessions ds ON ds.student_id = s.student_id AND ds.meeting_date = {O.BOARD_DAY}
WHERE s.is_active""")
def q_student_today(spark, sf_dir):
    i = Inputs.of(spark, sf_dir, _BOARD_DAYS)
    return att.student_today(i.students, i.all_punches, V.BOARD_AS_OF)


@query("student_history", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF),
                                  O.auto_close("sessions_raw", O.ATT_AS_OF)) + """
SELECT * FROM (
  SELECT st.student_id, st.full_name, st.subteam AS student_subteam,
         ds.meeting_date, ds.clock_in_at, ds.clock_out_at, ds.subteam, ds.working_on,
         ds.need_help, ds.need_help_at, ds.need_task, ds.need_task_at, ds.task_id,
         ds.updated_at,
         row_number() OVER (PARTITION BY ds.student_id ORDER BY ds.meeting_date DESC)
           AS recent_rank
  FROM students st JOIN sessions ds ON ds.student_id = st.student_id
) WHERE recent_rank <= 30""")
def q_student_history(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return att.student_history(i.students,
                               ses.daily_sessions(i.all_punches, V.ATTENDANCE_AS_OF))


_PER_STUDENT_SQL = f"""
worked AS (
  SELECT student_id, meeting_date,
         date_diff('microsecond', clock_in_at, coalesce(clock_out_at, clock_in_at)) AS us
  FROM sessions
  WHERE clock_in_at IS NOT NULL
    AND meeting_date >= {O.REPORT_START} AND meeting_date <= {O.REPORT_END}
),
per_student AS (
  SELECT r.student_id, r.full_name, r.subteam,
         count(w.meeting_date) AS days_clocked_in, max(w.meeting_date) AS last_day,
         CAST(coalesce(sum(w.us), 0) AS BIGINT) AS us_total
  FROM (SELECT * FROM students WHERE is_active) r
  LEFT JOIN worked w USING (student_id)
  GROUP BY r.student_id, r.full_name, r.subteam
)"""


@query("attendance_report", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF),
                                    O.auto_close("sessions_raw", O.ATT_AS_OF), _PER_STUDENT_SQL) + """
SELECT student_id, full_name, subteam, days_clocked_in, last_day,
       CAST(sign(us_total) * ((abs(us_total) + 18000000) // 36000000) AS DOUBLE) / 100.0
         AS hours_total
FROM per_student""")
def q_attendance_report(spark, sf_dir):
    i = Inputs.of(spark, sf_dir, (V.REPORT_START, V.REPORT_END))
    sessions = ses.sessions_for_days(i.all_punches, V.REPORT_START, V.REPORT_END,
                                     V.ATTENDANCE_AS_OF)
    return att.attendance_report(i.students, sessions, V.REPORT_START, V.REPORT_END)


def _csv_cell_sql(expr):
    return f"""'"' || replace(coalesce(CAST({expr} AS VARCHAR), ''), '"', '""') || '"'"""


@query("report_csv_lines", O.with_(*_ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF),
                                   O.auto_close("sessions_raw", O.ATT_AS_OF), _PER_STUDENT_SQL, """
report AS (
  SELECT *, CAST(sign(us_total) * ((abs(us_total) + 18000000) // 36000000) AS BIGINT) AS hundredths
  FROM per_student
)""") + f"""
SELECT 'student_id,full_name,subteam,days_clocked_in,last_day,hours_total' AS value
UNION ALL
SELECT concat_ws(',', {_csv_cell_sql('student_id')}, {_csv_cell_sql('full_name')},
                 {_csv_cell_sql('subteam')}, {_csv_cell_sql('days_clocked_in')},
                 {_csv_cell_sql("strftime(last_day, '%Y-%m-%d')")},
                 {_csv_cell_sql("printf('%.2f', hundredths / 100.0)")})
FROM report""")
def q_report_csv_lines(spark, sf_dir):
    """O-06: the CSV export's lines (header first, then name order)."""
    from ..sources.sinks import csv_lines, format_report
    rep = q_attendance_report(spark, sf_dir)
    return csv_lines(format_report(rep), order_by=["full_name", "student_id"])


# ---------------------------------------------------------------- corrections

_CORR_BASE = (O.STUDENTS, O.CORRECTIONS)


@query("correction_requests", O.with_(*_CORR_BASE) + """
SELECT id, student_id, meeting_date, requested_clock_in, requested_clock_out, reason,
       status, created_at FROM valid_requests""")
def q_correction_requests(spark, sf_dir):
    return Inputs.of(spark, sf_dir).validated_corrections[0]


@query("correction_rejects", O.with_(*_CORR_BASE) + """
SELECT * FROM judged_requests WHERE reject_reason IS NOT NULL""")
def q_correction_rejects(spark, sf_dir):
    return Inputs.of(spark, sf_dir).validated_corrections[1]


@query("correction_decide", O.with_(*_CORR_BASE) + """
SELECT * FROM corrections""")
def q_correction_decide(spark, sf_dir):
    return Inputs.of(spark, sf_dir).corrections


@query("decision_rejects", O.with_(*_CORR_BASE, """
all_dec AS (
  SELECT d.*, lower(d.status) AS st, r.created_at AS rc
  FROM correction_decisions d LEFT JOIN valid_requests r ON r.id = d.correction_id
)""") + """
SELECT a.correction_id, a."at", a.seq, a.st AS status, a.note,
       CASE WHEN a.st NOT IN ('approved', 'denied') THEN 'status_unknown'
            WHEN a.rc IS NULL OR a."at" < a.rc THEN 'request_unknown'
            ELSE 'already_' || c.status END AS reject_reason
FROM all_dec a LEFT JOIN corrections c ON c.id = a.correction_id
WHERE a.st NOT IN ('approved', 'denied') OR a.rc IS NULL OR a."at" < a.rc
   OR (a."at", a.seq) <> (c.decided_at, c.decision_seq)""")
def q_decision_rejects(spark, sf_dir):
    return Inputs.of(spark, sf_dir).decided_corrections[1]


@query("correction_apply", O.with_(*_CORR_BASE) + """
SELECT * FROM set_events""")
def q_correction_apply(spark, sf_dir):
    return Inputs.of(spark, sf_dir).set_events


@query("corrections_list", O.with_(*_CORR_BASE) + """
SELECT c.*, s.full_name, s.subteam AS roster_subteam
FROM corrections c JOIN students s ON s.student_id = c.student_id
WHERE c.status = 'pending'
ORDER BY c.created_at DESC, c.id DESC LIMIT 200""")
def q_corrections_list(spark, sf_dir):
    from ..operators.corrections import corrections_list
    i = Inputs.of(spark, sf_dir)
    return corrections_list(i.corrections, i.students, status="pending")


# ---------------------------------------------------------------- tasks

_TASK_BASE = (O.STUDENTS, O.TASKS, O.ASSIGNMENTS, O.COMMENTS)
_TASK_BASE_AT = (O.STUDENTS, O.TASKS_AT, O.ASSIGNMENTS_AT, O.COMMENTS)
_ASSIGNEES_SQL = """
on_task AS (
  SELECT DISTINCT task_id, student_id, full_name
  FROM task_assignments JOIN students USING (student_id)
  WHERE unassigned_at IS NULL
),
on_task_list AS (
  SELECT task_id, count(*) AS n_assignees,
         '[' || string_agg(CAST(json_object('student_id', student_id, 'full_name', full_name) AS VARCHAR),
                           ',' ORDER BY full_name, student_id) || ']' AS assignees
  FROM on_task GROUP BY task_id
)"""
# Whatever happened to a task, as one (task, moment) table.
_ACTIVITY_SQL = f"""
moments AS (
  SELECT id AS task_id, updated_at AS moment FROM tasks
  UNION ALL SELECT task_id, created_at FROM task_comments
  UNION ALL SELECT task_id, assigned_at FROM task_assignments WHERE unassigned_at IS NULL
),
activity AS (
  SELECT task_id, max(moment) AS last_activity_at,
         count_if(moment >= {O.TASK_AS_OF} - INTERVAL 3 DAY) = 0 AS is_stale
  FROM moments GROUP BY task_id
)"""


@query("assignments_dedup", O.with_(O.ASSIGNMENTS) + f"""
SELECT id, task_id, student_id, assigned_at,
       CASE WHEN (assigned_at, id) <> max((assigned_at, id)) OVER (PARTITION BY task_id, student_id)
            THEN {O.CLEANUP_AT} END AS unassigned_at
FROM task_assignments WHERE unassigned_at IS NULL
UNION ALL
FROM task_assignments WHERE unassigned_at IS NOT NULL""")
def q_assignments_dedup(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.assignments_dedup(i.assignments, V.CLEANUP_AT)


_VALID_TASK_EVENTS = """
numbered AS (
  SELECT *, coalesce(trim(title), '') <> '' AND coalesce(trim(subteam), '') <> '' AS named,
         count(*) FILTER (WHERE kind = 'create' AND coalesce(trim(title), '') <> ''
                          AND coalesce(trim(subteam), '') <> '')
           OVER (PARTITION BY task_id ORDER BY "at", seq) AS creates_so_far
  FROM task_events
),
judged_task_events AS (
  SELECT * EXCLUDE (named, creates_so_far),
         CASE kind WHEN 'create' THEN
                CASE WHEN named THEN NULL WHEN coalesce(trim(title), '') = '' THEN 'title_missing'
                     ELSE 'subteam_missing' END
              ELSE
                CASE WHEN kind NOT IN ('join', 'assign', 'clock_in') THEN NULL
                     WHEN student_id IS NULL THEN 'student_missing'
                     WHEN student_id NOT IN (SELECT student_id FROM students WHERE is_active)
                       THEN 'student_unknown' END
         END AS early, creates_so_far
  FROM numbered
),
task_rejects AS (
  SELECT * EXCLUDE (early, creates_so_far),
         coalesce(early, CASE WHEN kind <> 'create' AND creates_so_far = 0 THEN 'task_unknown' END)
           AS reject_reason
  FROM judged_task_events
),
valid_task_events AS (SELECT * EXCLUDE (reject_reason) FROM task_rejects WHERE reject_reason IS NULL)"""


@query("task_event_rejects", O.with_(O.STUDENTS, O.TASK_EVENTS, _VALID_TASK_EVENTS) + """
SELECT * FROM task_rejects WHERE reject_reason IS NOT NULL""")
def q_task_event_rejects(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.validate_task_events(i.task_events, i.students)[1]


_INTERVALS_SQL = """
ev AS (
  SELECT task_id, student_id, "at", seq, kind <> 'leave' AS opens FROM valid_task_events
  WHERE kind IN ('join', 'assign', 'clock_in', 'leave') AND student_id IS NOT NULL
),
ch AS (
  SELECT *, coalesce(lag(opens) OVER (PARTITION BY task_id, student_id ORDER BY "at", seq),
                     false) AS prev_open
  FROM ev
),
c2 AS (
  SELECT *, lead("at") OVER (PARTITION BY task_id, student_id ORDER BY "at", seq) AS nxt
  FROM ch WHERE prev_open <> opens
)"""


@query("assignment_intervals", O.with_(O.STUDENTS, O.TASK_EVENTS, _VALID_TASK_EVENTS, _INTERVALS_SQL) + """
SELECT task_id, student_id, "at" AS assigned_at, nxt AS unassigned_at FROM c2 WHERE opens""")
def q_assignment_intervals(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    valid, _ = tk.validate_task_events(i.task_events, i.students)
    return tk.assignment_intervals(valid)


@query("task_last_comment", O.with_(O.COMMENTS) + """
SELECT task_id, max(created_at) AS last_comment_at FROM task_comments GROUP BY task_id""")
def q_task_last_comment(spark, sf_dir):
    return tk.task_last_comment(Inputs.of(spark, sf_dir).comments)


@query("task_last_assignment", O.with_(O.ASSIGNMENTS) + """
SELECT task_id, max(assigned_at) AS last_assigned_at FROM task_assignments
WHERE unassigned_at IS NULL GROUP BY task_id""")
def q_task_last_assignment(spark, sf_dir):
    return tk.task_last_assignment(Inputs.of(spark, sf_dir).assignments)


@query("task_assignees", O.with_(*_TASK_BASE, _ASSIGNEES_SQL) + """
SELECT task_id, n_assignees, assignees FROM on_task_list""")
def q_task_assignees(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    a = tk.task_assignees(i.assignments, i.students)
    return a.select("task_id", "n_assignees", tk.assignees_json("assignees").alias("assignees"))


@query("task_staleness", O.with_(*_TASK_BASE_AT, _ACTIVITY_SQL) + """
SELECT task_id, last_activity_at, is_stale FROM activity
WHERE task_id IN (SELECT id FROM tasks)""")
def q_task_staleness(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.task_staleness(i.tasks, i.comments, i.assignments, V.TASK_AS_OF)


@query("task_board", O.with_(*_TASK_BASE_AT, _ASSIGNEES_SQL, _ACTIVITY_SQL, """
lanes(status, lane) AS (VALUES ('todo', 1), ('in_progress', 2), ('blocked', 3), ('done', 4))""") + """
SELECT shown.*, last_activity_at, is_stale, coalesce(assignees, '[]') AS assignees,
       coalesce(lane, 5) AS status_rank
FROM (FROM tasks WHERE NOT archived) shown
JOIN activity v ON v.task_id = shown.id
LEFT JOIN on_task_list m ON m.task_id = shown.id
LEFT JOIN lanes l ON l.status = shown.status""")
def q_task_board(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.task_board(i.tasks, i.assignments, i.comments, i.students, V.TASK_AS_OF)


@query("task_column_counts", O.with_(O.TASKS) + """
SELECT c.col AS "column", c.position, coalesce(n.n_tasks, 0) AS n_tasks
FROM (VALUES ('todo', 1), ('in_progress', 2), ('blocked', 3), ('done', 4)) c(col, position)
LEFT JOIN (
  SELECT CASE WHEN status IN ('todo', 'in_progress', 'blocked', 'done') THEN status
              ELSE 'todo' END AS col, count(*) AS n_tasks
  FROM tasks WHERE NOT archived GROUP BY 1
) n ON n.col = c.col""")
def q_task_column_counts(spark, sf_dir):
    return tk.task_column_counts(Inputs.of(spark, sf_dir).tasks)


@query("task_column_pivot", O.with_(O.TASKS) + """
SELECT subteam,
       count(*) FILTER (WHERE coalesce(status, '') NOT IN ('in_progress', 'blocked', 'done')) AS todo,
       count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
       count(*) FILTER (WHERE status = 'blocked') AS blocked,
       count(*) FILTER (WHERE status = 'done') AS done
FROM tasks WHERE NOT archived GROUP BY subteam""")
def q_task_column_pivot(spark, sf_dir):
    return tk.task_column_pivot(Inputs.of(spark, sf_dir).tasks)


@query("my_tasks", O.with_(O.TASKS, O.ASSIGNMENTS) + """
SELECT DISTINCT a.task_id, a.student_id, t.title, t.subteam, t.status, t.archived,
       '[' || t.subteam || '] ' || t.title || ' (' || replace(t.status, '_', ' ') || ')' AS label
FROM task_assignments a JOIN tasks t ON t.id = a.task_id
WHERE a.unassigned_at IS NULL""")
def q_my_tasks(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.my_tasks(i.assignments, i.tasks)


_COMMENT_REQUESTS = f"""
comment_requests AS (
  SELECT conv_id * 100 + turn AS id, CASE WHEN turn = 7 THEN conv_id + 1000000000 ELSE conv_id END AS task_id,
         {O.COMMENT_TIME} AS "at",
         CASE WHEN role = 'user' THEN conv_id + CASE WHEN turn = 4 THEN 1000000000 ELSE 0 END END AS student_id,
         role AS author_type,
         CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '   ' END
           AS author_label,
         CASE WHEN turn = 6 THEN ' ' || chr(9) || ' ' ELSE text END AS comment
  FROM conversations
),
judged AS (
  SELECT r.*, s.full_name,
         CASE WHEN r.comment IS NULL OR regexp_replace(r.comment, '{JS_TRIM_RE}', '', 'g') = ''
                THEN 'comment_missing'
              WHEN r.student_id IS NOT NULL AND s.student_id IS NULL THEN 'student_unknown'
              WHEN r.task_id NOT IN (SELECT id FROM tasks) THEN 'task_unknown'
         END AS reject_reason
  FROM comment_requests r LEFT JOIN students s ON s.student_id = r.student_id
)"""


@query("comment_attribute", O.with_(O.STUDENTS, O.TASKS, _COMMENT_REQUESTS) + f"""
SELECT id, task_id,
       CASE WHEN student_id IS NOT NULL THEN 'student' ELSE 'mentor' END AS author_type,
       CASE WHEN student_id IS NOT NULL THEN full_name
            ELSE coalesce(nullif(regexp_replace(coalesce(author_label, ''), '{JS_TRIM_RE}', '', 'g'), ''),
                          'Mentor') END AS author_label,
       regexp_replace(comment, '{JS_TRIM_RE}', '', 'g') AS comment,
       "at" AS created_at
FROM judged WHERE reject_reason IS NULL""")
def q_comment_attribute(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.comment_attribute(V.comment_requests(spark, sf_dir), i.students, i.tasks)[0]


@query("comment_rejects", O.with_(O.STUDENTS, O.TASKS, _COMMENT_REQUESTS) + """
SELECT id, task_id, "at", student_id, author_type, author_label, comment, reject_reason
FROM judged WHERE reject_reason IS NOT NULL""")
def q_comment_rejects(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return tk.comment_attribute(V.comment_requests(spark, sf_dir), i.students, i.tasks)[1]


@query("comment_feed", O.with_(O.COMMENTS) + """
SELECT id, task_id, author_type, author_label, comment, created_at FROM task_comments""")
def q_comment_feed(spark, sf_dir):
    return tk.comment_feed(Inputs.of(spark, sf_dir).comments)


# The task table by ordered windows over the valid log: every column is the last value
# written so far; a clock-in since the last status makes a todo task one in progress.
def _task_fold_sql(as_of: str) -> str:
    return f"""
born AS (SELECT task_id, min(("at", seq)) AS b FROM valid_task_events WHERE kind = 'create' GROUP BY task_id),
written AS (
  SELECT v.*, kind = 'create' OR (kind = 'patch' AND coalesce(status IN ('todo', 'in_progress', 'blocked', 'done'), false)) AS sets_status
  FROM valid_task_events v JOIN born USING (task_id) WHERE ("at", seq) >= b AND "at" <= {as_of}
),
so_far AS (
  SELECT task_id AS id,
    last_value(nullif(trim(title), '') IGNORE NULLS) OVER log AS title,
    last_value(nullif(trim(subteam), '') IGNORE NULLS) OVER log AS subteam,
    last_value(CASE WHEN kind = 'create' THEN trim(coalesce(description, '')) ELSE description END IGNORE NULLS) OVER log AS description,
    last_value(CASE WHEN sets_status THEN CASE WHEN status IN ('in_progress', 'blocked', 'done') THEN status ELSE 'todo' END END IGNORE NULLS) OVER log AS lane,
    last_value(CASE kind WHEN 'create' THEN false WHEN 'archive' THEN true WHEN 'unarchive' THEN false END IGNORE NULLS) OVER log AS archived,
    count_if(sets_status) OVER log AS n_status,
    max(CASE WHEN sets_status THEN ("at", seq) END) OVER log AS status_at,
    max(CASE WHEN kind = 'clock_in' THEN ("at", seq) END) OVER log AS clock_in_at,
    min(CASE WHEN kind = 'create' THEN "at" END) OVER log AS created_at,
    "at" AS updated_at,
    row_number() OVER (PARTITION BY task_id ORDER BY "at" DESC, seq DESC) AS from_end
  FROM written
  WINDOW log AS (PARTITION BY task_id ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


_TASK_FOLD_COLUMNS = """
SELECT id, title, subteam, CASE WHEN lane = 'todo' AND clock_in_at > status_at THEN 'in_progress' ELSE lane END AS status,
       description, archived, created_at, updated_at
FROM so_far WHERE from_end = 1"""


@query("task_fold", O.with_(O.STUDENTS, O.TASK_EVENTS, _VALID_TASK_EVENTS, _task_fold_sql(O.TASK_AS_OF)) + _TASK_FOLD_COLUMNS)
def q_task_fold(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    valid, _ = tk.validate_task_events(i.task_events, i.students)
    return tk.task_fold(valid, V.TASK_AS_OF)


# ---------------------------------------------------------------- manual entry

_MANUAL_SQL = f"""
manual_raw AS (
  SELECT user_id AS student_id, ts + INTERVAL 3 DAY AS "at", event_id AS seq,
         strftime({O.eastern_date('ts')}, '%Y-%m-%d') AS meeting_date,
         CASE WHEN event_id % 2 = 0 THEN '16:00' ELSE '' END AS clock_in_time,
         CASE WHEN event_id % 3 <> 0 THEN '18:15' ELSE '' END AS clock_out_time,
         CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL
              ELSE 'Build' END AS subteam,
         CASE WHEN event_id % 7 = 0 THEN '' ELSE 'paper log' END AS working_on
  FROM events
),
manual_ok AS (
  SELECT m.* REPLACE (coalesce(m.subteam, s.subteam) AS subteam),
         CAST(m.meeting_date AS DATE) AS d
  FROM manual_raw m JOIN students s ON s.student_id = m.student_id
  WHERE s.is_active
)"""


def _manual_events_sql(policy):
    if policy == "patch":
        kind = """CASE WHEN clock_in_time <> '' AND clock_out_time <> '' THEN 'set_both'
                       WHEN clock_in_time <> '' THEN 'set_in'
                       WHEN clock_out_time <> '' THEN 'set_out' ELSE 'update' END"""
        where, wo = "", "working_on"
    else:
        kind, where, wo = "'set_both'", "WHERE clock_in_time <> ''", "nullif(working_on, '')"
    tin = O.local_to_utc("d + CAST(clock_in_time AS TIME)")
    tout = O.local_to_utc("d + CAST(clock_out_time AS TIME)")
    return f"""
SELECT student_id, "at", seq, {kind} AS kind, d AS meeting_date, subteam, {wo} AS working_on,
       CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS BOOLEAN) AS value,
       CASE WHEN clock_in_time <> '' THEN {tin} END AS set_in,
       CASE WHEN clock_out_time <> '' THEN {tout} END AS set_out
FROM manual_ok {where}"""


@query("manual_attendance", O.with_(O.STUDENTS, _MANUAL_SQL) + _manual_events_sql("patch"))
def q_manual_attendance(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return corr.manual_attendance(V.manual_entries(spark, sf_dir), i.students, "patch")[0]


@query("manual_attendance_replace", O.with_(O.STUDENTS, _MANUAL_SQL)
       + _manual_events_sql("replace"))
def q_manual_attendance_replace(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return corr.manual_attendance(V.manual_entries(spark, sf_dir), i.students, "replace")[0]


@query("manual_rejects", O.with_(O.STUDENTS, _MANUAL_SQL) + """
SELECT *, 'student_unknown' AS reject_reason FROM manual_raw
WHERE student_id NOT IN (SELECT student_id FROM students WHERE is_active)""")
def q_manual_rejects(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return corr.manual_attendance(V.manual_entries(spark, sf_dir), i.students, "patch")[1]


@query("sessions_with_manual", O.with_(
    *_ATT_BASE, _MANUAL_SQL,
    "\nmanual_events AS (" + _manual_events_sql("patch") + ")",
    "\nfull_log AS (SELECT * FROM all_punches UNION ALL SELECT * FROM manual_events)",
    O.session_fold("full_log", O.ATT_AS_OF),
    O.auto_close("sessions_raw", O.ATT_AS_OF)) + """
SELECT * FROM sessions""")
def q_sessions_with_manual(spark, sf_dir):
    """The full C-1 log: punches, approved corrections and manual entries."""
    i = Inputs.of(spark, sf_dir)
    manual, _ = corr.manual_attendance(V.manual_entries(spark, sf_dir), i.students, "patch")
    return ses.daily_sessions(i.all_punches.unionByName(manual), V.ATTENDANCE_AS_OF)


# ---------------------------------------------------------------- roster maintenance

_ROSTER_REQ_SQL = f"""
roster_requests AS (
  SELECT TIMESTAMP '2024-02-01 00:00:00' + to_seconds(s_suppkey) AS "at", s_suppkey AS seq,
         ' ' || s_name || ' ' AS full_name, n_name AS subteam
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 2 DAY, s_suppkey, s_name, 'Programming'
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0
  UNION ALL
  SELECT TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 DAY, c_custkey,
         CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey <> 4 THEN c_name END,
         CASE WHEN c_nationkey = 1 THEN NULL WHEN c_nationkey = 2 THEN '' WHEN c_custkey % 2 = 1 THEN 'Build'
              WHEN c_nationkey = 0 THEN '  ' ELSE ' Team ' || c_nationkey END
  FROM customer
),
req_last AS (
  SELECT trim(full_name) AS full_name,
         struct_extract(arg_max({{'v': CASE WHEN subteam <> '' THEN trim(subteam) END}},
                                ("at", seq)), 'v') AS req_subteam,
         min("at") AS first_at
  FROM roster_requests WHERE full_name <> '' GROUP BY 1
),
students_full AS (
  SELECT *, TIMESTAMP '2023-09-01 00:00:00' AS created_at FROM students
)"""


def _upsert_sql(reactivate):
    active = "true" if reactivate else "s.is_active"
    return f"""
SELECT s.student_id, coalesce(s.full_name, r.full_name) AS full_name,
       CASE WHEN r.full_name IS NOT NULL THEN r.req_subteam ELSE s.subteam END AS subteam,
       CASE WHEN s.student_id IS NULL THEN true
            WHEN r.full_name IS NOT NULL THEN {active} ELSE s.is_active END AS is_active,
       CASE WHEN s.student_id IS NULL THEN r.first_at ELSE s.created_at END AS created_at,
       s.student_id IS NULL AS is_new
FROM students_full s FULL OUTER JOIN req_last r ON r.full_name = s.full_name"""


def _known_ids(roster: DataFrame) -> DataFrame:
    """A new student's id is a hash that only Spark computes; all others are compared."""
    return roster.withColumn("student_id", F.when(~F.col("is_new"), F.col("student_id")))


@query("roster_upsert", O.with_(O.STUDENTS, _ROSTER_REQ_SQL) + _upsert_sql(False))
def q_roster_upsert(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return _known_ids(ro.roster_upsert(i.students, V.roster_requests(spark, sf_dir), reactivate=False)[0])


@query("roster_seed_upsert", O.with_(O.STUDENTS, _ROSTER_REQ_SQL) + _upsert_sql(True))
def q_roster_seed_upsert(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return _known_ids(ro.roster_upsert(i.students, V.roster_requests(spark, sf_dir), reactivate=True)[0])


@query("roster_upsert_rejects", O.with_(O.STUDENTS, _ROSTER_REQ_SQL) + """
SELECT *, 'name_missing' AS reject_reason FROM roster_requests WHERE coalesce(full_name, '') = ''""")
def q_roster_upsert_rejects(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return ro.roster_upsert(i.students, V.roster_requests(spark, sf_dir))[1]


_PATCH_SQL = """
patch_log AS (
  SELECT TIMESTAMP '2024-02-01 00:00:00' + to_seconds(c_custkey) AS "at", c_custkey AS seq,
         CASE WHEN c_nationkey = 4 THEN c_custkey + 1000000000 ELSE c_custkey END AS student_id,
         CASE WHEN c_nationkey = 0 THEN c_name || ' II' WHEN c_nationkey = 3 THEN '   '
              WHEN c_nationkey BETWEEN 5 AND 9 THEN ' ' || (SELECT p.c_name FROM customer p WHERE p.c_custkey = customer.c_custkey - 1) || ' '
              WHEN c_nationkey BETWEEN 10 AND 12 THEN 'Captain' END AS full_name,
         CASE WHEN c_nationkey = 2 THEN '' WHEN c_nationkey BETWEEN 5 AND 9 OR c_nationkey > 12 THEN 'Programming' END AS subteam,
         CASE WHEN c_nationkey = 1 AND c_acctbal < 0 THEN true WHEN c_nationkey = 4 THEN false END AS is_active,
         c_nationkey AS nk
  FROM customer
),
-- Edits come in the order of the keys, one a student.  Whoever claims the name before
-- theirs gets it if its holder has moved on: that runs along a chain of claims from the
-- last edit that was no such claim.
moves AS (
  SELECT *, CASE WHEN nk = 0 THEN true
                 WHEN nk BETWEEN 10 AND 12 THEN seq = min(seq) FILTER (WHERE nk BETWEEN 10 AND 12) OVER ()
                 WHEN nk BETWEEN 5 AND 9 THEN NULL ELSE false END AS moved
  FROM patch_log
),
judged_patches AS (
  SELECT *, CASE WHEN nk = 4 THEN 'student_unknown'
                 WHEN nk BETWEEN 10 AND 12 AND NOT moved THEN 'name_taken'
                 WHEN nk BETWEEN 5 AND 9 AND full_name IS NOT NULL AND NOT coalesce(
                   last_value(moved IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
                   THEN 'name_taken' END AS reject_reason
  FROM moves
)"""


@query("roster_patch", O.with_(O.STUDENTS, _PATCH_SQL) + """
SELECT s.student_id, coalesce(nullif(trim(p.full_name), ''), s.full_name) AS full_name,
       coalesce(p.subteam, s.subteam) AS subteam, coalesce(p.is_active, s.is_active) AS is_active,
       TIMESTAMP '2023-09-01 00:00:00' AS created_at
FROM students s LEFT JOIN (FROM judged_patches WHERE reject_reason IS NULL) p ON p.student_id = s.student_id""")
def q_roster_patch(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return ro.roster_patch(i.students, V.roster_patches(spark, sf_dir))[0]


@query("roster_patch_rejects", O.with_(O.STUDENTS, _PATCH_SQL) + """
SELECT "at", seq, student_id, full_name, subteam, is_active, reject_reason
FROM judged_patches WHERE reject_reason IS NOT NULL""")
def q_roster_patch_rejects(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return ro.roster_patch(i.students, V.roster_patches(spark, sf_dir))[1]


# ---------------------------------------------------------------- audits


def _audit_tables(spark, sf_dir):
    i = Inputs.of(spark, sf_dir)
    return {"students": i.students, "tasks": V.restored_tasks(spark, sf_dir), "task_assignments": i.assignments,
            "task_comments": V.restored_comments(spark, sf_dir),
            "daily_sessions": ses.session_fold(i.all_punches, V.ATTENDANCE_AS_OF),
            "attendance_corrections": corr.settle_corrections(V.correction_log(spark, sf_dir), i.students)}


_RESTORED = """
restored_tasks AS (
  SELECT t.* REPLACE (CASE WHEN o_orderpriority LIKE '5%' THEN 'finished' ELSE status END AS status,
                      CASE WHEN o_custkey % 10 <> 3 THEN title END AS title,
                      CASE WHEN o_custkey % 10 <> 4 THEN subteam END AS subteam)
  FROM tasks t JOIN orders ON o_orderkey = t.id WHERE o_orderstatus <> 'P'
),
restored_comments AS (
  SELECT c.* REPLACE (CASE author_label WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'bot' END AS author_type,
                      CASE WHEN author_label <> 'system' THEN author_label END AS author_label)
  FROM task_comments c
)"""
_AUDIT_BASE = (*_ATT_BASE, O.session_fold("all_punches", O.ATT_AS_OF), O.TASKS, O.ASSIGNMENTS,
               O.COMMENTS, _RESTORED)
_AUDITED = {"tasks": "restored_tasks", "task_comments": "restored_comments"}


def _dup_sql(table, cols, where=""):
    key = " || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), '∅')" for c in cols)
    return f"""SELECT '{table}' AS table_name, '{",".join(cols)}' AS key_columns,
       {key} AS key_value, count(*) AS n_rows
FROM {_AUDITED.get(table, table)} {where} GROUP BY {", ".join(cols)} HAVING count(*) > 1"""


@query("audit_unique", O.with_(*_AUDIT_BASE, "\nattendance_corrections AS (SELECT * FROM corrections)") + "\n"
       + "\nUNION ALL\n".join([
           _dup_sql("students", ["student_id"]), _dup_sql("students", ["full_name"]),
           _dup_sql("task_assignments", ["task_id", "student_id"], "WHERE unassigned_at IS NULL"),
           _dup_sql("tasks", ["id"]), _dup_sql("task_comments", ["id"]),
           _dup_sql("attendance_corrections", ["id"])]))
def q_audit_unique(spark, sf_dir):
    tables = _audit_tables(spark, sf_dir)
    del tables["daily_sessions"]            # a fold's result has one row per key
    sources = {"tasks": V.tasks(spark, sf_dir), "task_comments": V.task_comments(spark, sf_dir), "attendance_corrections": V.correction_requests(spark, sf_dir)}
    return au.audit_unique(tables, sources)


def _fk_sql(child, col, parent, key, policy):
    return f"""SELECT '{child}' AS table_name, '{col}' AS fk_column, '{parent}' AS parent_table,
       c.{col} AS fk_value, '{policy}' AS on_delete, count(*) AS n_rows
FROM {_AUDITED.get(child, child)} c WHERE c.{col} IS NOT NULL AND c.{col} NOT IN (SELECT {key} FROM {_AUDITED.get(parent, parent)})
GROUP BY c.{col}"""


@query("audit_fk", O.with_(*_AUDIT_BASE, "\ndaily_sessions AS (SELECT * FROM sessions_raw)",
                           "\nattendance_corrections AS (SELECT * FROM corrections)") + "\n"
       + "\nUNION ALL\n".join(_fk_sql(*fk) for fk in au.FOREIGN_KEYS))
def q_audit_fk(spark, sf_dir):
    return au.audit_fk(_audit_tables(spark, sf_dir))


def _domain_sql(table, col, allowed):
    if allowed is None:
        bad, rule = f"{col} IS NULL", "not null"
    else:
        vals = ", ".join(f"'{v}'" for v in allowed)
        bad, rule = f"{col} IS NULL OR {col} NOT IN ({vals})", "check"
    return f"""SELECT '{table}' AS table_name, '{col}' AS column_name, '{rule}' AS rule,
       CAST({col} AS VARCHAR) AS bad_value, count(*) AS n_rows
FROM {_AUDITED.get(table, table)} WHERE {bad} GROUP BY {col}"""


@query("audit_domain", O.with_(*_AUDIT_BASE, "\nattendance_corrections AS (SELECT * FROM corrections)")
       + "\n" + "\nUNION ALL\n".join(_domain_sql(*c) for c in au.DOMAIN_CHECKS))
def q_audit_domain(spark, sf_dir):
    return au.audit_domain(_audit_tables(spark, sf_dir))


# ---------------------------------------------------------------- streaming

@query("session_stream", O.with_(
    O.STUDENTS, O.PUNCHES, O.session_fold("punches", "TIMESTAMP '9999-12-31 00:00:00'"),
    f"""
wm AS (
  SELECT max(timezone('America/New_York', timezone('UTC', "at"))) - INTERVAL 25 HOUR AS w
  FROM punches
)""") + """
SELECT s.* FROM sessions_raw s, wm
WHERE CAST(s.meeting_date AS TIMESTAMP) + INTERVAL 1 DAY <= wm.w""")
def q_session_stream(spark, sf_dir):
    """The streaming fold drained over the events file; returns what the
    append-mode sink holds (every day the watermark has closed)."""
    import uuid

    from ..operators.gate import gate_active
    from ..session import checkpoint_root
    from ..streaming.sessions_stream import run_session_stream
    i = Inputs.of(spark, sf_dir)
    run = f"{checkpoint_root(spark).rstrip('/')}/rollcall-stream-{uuid.uuid4().hex}"
    stream = gate_active(V.punches_stream(spark, sf_dir), i.students)
    run_session_stream(spark, stream, f"{run}/sink", f"{run}/checkpoint")
    return spark.read.parquet(f"{run}/sink")


from . import lifecycle  # noqa: E402,F401  (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

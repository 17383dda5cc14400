"""DuckDB SQL for the domain views and the reference semantics.

These are the independent oracle: written from the source system's SQL
(range in the ON clause, FILTER aggregates, lateral-style lists), not from
our DataFrame plans.  Each oracle query is a self-contained ``WITH`` over
the raw test tables.
"""

from __future__ import annotations

# Parameters, as SQL literals (must equal rollcall.sources.views).
ATT_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
BOARD_AS_OF = "TIMESTAMP '2024-01-15 17:00:00'"
BOARD_DAY = "DATE '2024-01-15'"
REPORT_START = "DATE '2024-01-08'"
REPORT_END = "DATE '2024-01-21'"
TASK_AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"
CLEANUP_AT = "TIMESTAMP '2002-01-01 00:00:00'"


def eastern_date(ts: str) -> str:
    return f"CAST(timezone('America/New_York', timezone('UTC', {ts})) AS DATE)"


def local_to_utc(local_ts: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', {local_ts}))"


STUDENTS = """
students AS (
  SELECT c_custkey AS student_id, c_name AS full_name,
         nullif(c_mktsegment, 'HOUSEHOLD') AS subteam,
         c_acctbal >= 0 AS is_active
  FROM customer
)"""

PUNCHES = """
punches_all AS (
  SELECT user_id AS student_id, ts AS "at", event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'clock_in' WHEN 'purchase' THEN 'clock_out'
              WHEN 'view' THEN 'update' WHEN 'click' THEN 'need_help'
              WHEN 'error' THEN 'need_task' END AS kind,
         CAST(NULL AS DATE) AS meeting_date,
         CAST(NULL AS VARCHAR) AS subteam,
         CASE WHEN event_type IN ('signup', 'view')
              THEN 'k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) END
           AS working_on,
         CASE WHEN event_type = 'signup'
              THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS task_id,
         CASE WHEN event_type IN ('click', 'error')
              THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 END AS value,
         CAST(NULL AS TIMESTAMP) AS set_in,
         CAST(NULL AS TIMESTAMP) AS set_out
  FROM events
  WHERE event_type IN ('signup', 'purchase', 'view', 'click', 'error')
),
punches AS (
  SELECT * FROM punches_all
  WHERE student_id IN (SELECT student_id FROM students WHERE is_active)
)"""

# Correction requests / decisions / final table / set events.
CORRECTIONS = f"""
correction_requests AS (
  SELECT event_id AS id, CASE WHEN event_id % 100 <> 1 THEN user_id END AS student_id,
         CASE event_id % 100 WHEN 2 THEN 'Jan 9' WHEN 3 THEN '2024-02-30'
              ELSE strftime({eastern_date('ts')}, '%Y-%m-%d') END AS meeting_date,
         CASE event_id % 100 WHEN 4 THEN '5 pm' WHEN 5 THEN '99:99' ELSE '17:00' END
           AS requested_clock_in,
         CASE event_id % 100 WHEN 6 THEN 'late' WHEN 7 THEN '25:00'
              ELSE CASE WHEN event_id % 2 = 1 THEN '19:30' END END AS requested_clock_out,
         CASE event_id % 100 WHEN 8 THEN ' x ' ELSE '  missed punch ' || event_type || ' ' END
           AS reason,
         ts AS created_at
  FROM events
),
judged_requests AS (
  SELECT q.*, CASE
    WHEN student_id IS NULL THEN 'student_missing'
    WHEN NOT regexp_full_match(meeting_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'meeting_date_format'
    WHEN NOT regexp_full_match(requested_clock_in, '[0-9]{{2}}:[0-9]{{2}}') THEN 'clock_in_format'
    WHEN NOT regexp_full_match(coalesce(requested_clock_out, '00:00'), '[0-9]{{2}}:[0-9]{{2}}')
      THEN 'clock_out_format'
    WHEN length(trim(reason)) < 3 THEN 'reason_too_short'
    WHEN student_id NOT IN (SELECT student_id FROM students WHERE is_active) THEN 'student_unknown'
    WHEN TRY_CAST(meeting_date AS DATE) IS NULL OR TRY_CAST(requested_clock_in AS TIME) IS NULL
      OR TRY_CAST(coalesce(requested_clock_out, '00:00') AS TIME) IS NULL THEN 'value_out_of_range'
    END AS reject_reason
  FROM correction_requests q
),
correction_decisions AS (
  SELECT event_id AS correction_id, ts + to_days(CASE event_type WHEN 'click' THEN -1 ELSE 1 END) AS "at",
         event_id * 10 AS seq,
         CASE event_type WHEN 'signup' THEN 'approved' WHEN 'purchase' THEN 'approved'
              WHEN 'error' THEN 'maybe' ELSE 'DENIED' END AS status,
         CASE WHEN event_type IN ('signup', 'purchase') THEN '  ok  ' ELSE '' END AS note
  FROM events
  UNION ALL
  SELECT event_id, ts + INTERVAL 2 DAY, event_id * 10 + 1, 'denied', 'second look'
  FROM events WHERE event_type = 'purchase'
),
valid_requests AS (
  SELECT id, student_id, TRY_CAST(meeting_date AS DATE) AS meeting_date,
         requested_clock_in, requested_clock_out, trim(reason) AS reason,
         'pending' AS status, created_at
  FROM judged_requests WHERE reject_reason IS NULL
),
ranked_decisions AS (
  SELECT d.correction_id, d."at", d.seq, lower(d.status) AS status, d.note,
         row_number() OVER (PARTITION BY d.correction_id ORDER BY d."at", d.seq) AS rn
  FROM correction_decisions d
  JOIN valid_requests r ON r.id = d.correction_id AND d."at" >= r.created_at
  WHERE lower(d.status) IN ('approved', 'denied')
),
corrections AS (
  SELECT r.id, r.student_id, r.meeting_date, r.requested_clock_in, r.requested_clock_out,
         r.reason, coalesce(d.status, 'pending') AS status, r.created_at,
         d."at" AS decided_at, CASE WHEN d."at" IS NOT NULL THEN 'mentor' END AS decided_by,
         nullif(trim(d.note), '') AS decision_note, d.seq AS decision_seq
  FROM valid_requests r
  LEFT JOIN ranked_decisions d ON d.correction_id = r.id AND d.rn = 1
),
set_events AS (
  SELECT student_id, decided_at AS "at", decision_seq AS seq, 'set_both' AS kind,
         meeting_date, CAST(NULL AS VARCHAR) AS subteam, CAST(NULL AS VARCHAR) AS working_on,
         CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS BOOLEAN) AS value,
         {local_to_utc("meeting_date + TRY_CAST(requested_clock_in AS TIME)")} AS set_in,
         CASE WHEN requested_clock_out IS NULL THEN NULL ELSE
         {local_to_utc("meeting_date + TRY_CAST(requested_clock_out AS TIME)")} END AS set_out
  FROM corrections WHERE status = 'approved'
)"""


def session_fold(src: str, as_of: str, name: str = "sessions_raw") -> str:
    """C-1 played forward: after every event of a student's day, each column shows the last
    thing written so far; the day's last event has the session.  A written NULL is kept
    apart from nothing written by a list of one."""
    def shown(written):
        return f"last_value({written} IGNORE NULLS) OVER day"
    return f"""
{name}_ev AS (
  SELECT *, coalesce(meeting_date, {eastern_date('"at"')}) AS md FROM {src} WHERE "at" <= {as_of}
),
{name}_played AS (
  SELECT student_id, md AS meeting_date,
    {shown("CASE kind WHEN 'set_in' THEN [set_in] WHEN 'set_both' THEN [set_in] END")} AS said_in,
    first_value(CASE WHEN kind = 'clock_in' THEN "at" END IGNORE NULLS) OVER day AS came,
    {shown("""CASE kind WHEN 'clock_in' THEN [NULL::TIMESTAMP] WHEN 'clock_out' THEN ["at"]
              WHEN 'set_out' THEN [set_out] WHEN 'set_both' THEN [set_out] END""")} AS went,
    {shown("nullif(subteam, '')")} AS subteam,
    {shown("working_on")} AS working_on,
    {shown("CASE WHEN kind = 'need_help' THEN [CASE WHEN value THEN \"at\" END] END")} AS help,
    {shown("CASE WHEN kind = 'need_task' THEN [CASE WHEN value THEN \"at\" END] END")} AS task,
    {shown("CASE WHEN kind = 'clock_in' THEN task_id END")} AS task_id,
    "at" AS updated_at,
    row_number() OVER (PARTITION BY student_id, md ORDER BY "at" DESC, seq DESC) AS from_end
  FROM {name}_ev
  WINDOW day AS (PARTITION BY student_id, md ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
{name} AS (
  SELECT student_id, meeting_date, coalesce(said_in[1], came) AS clock_in_at, went[1] AS clock_out_at, subteam,
         coalesce(working_on, '') AS working_on, help[1] IS NOT NULL AS need_help, help[1] AS need_help_at,
         task[1] IS NOT NULL AS need_task, task[1] AS need_task_at, task_id, updated_at
  FROM {name}_played WHERE from_end = 1
)"""


def auto_close(src: str, as_of: str, name: str = "sessions") -> str:
    return f"""
{name} AS (
  SELECT student_id, meeting_date, clock_in_at,
         CASE WHEN clock_in_at IS NOT NULL AND clock_out_at IS NULL
                   AND clock_in_at < {as_of} - INTERVAL 4 HOUR
              THEN clock_in_at + INTERVAL 4 HOUR ELSE clock_out_at END AS clock_out_at,
         subteam, working_on, need_help, need_help_at, need_task, need_task_at,
         task_id, updated_at
  FROM {src}
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


ALL_PUNCHES = """
all_punches AS (
  SELECT * FROM punches UNION ALL SELECT * FROM set_events
)"""

TASKS = """
tasks AS (
  SELECT o_orderkey AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
         CASE o_custkey % 5 WHEN 0 THEN 'Build' WHEN 1 THEN 'Programming'
              WHEN 2 THEN 'Electrical' WHEN 3 THEN 'CAD/CAM' WHEN 4 THEN 'Imagery & Outreach' END
           AS subteam,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'todo' WHEN '2' THEN 'in_progress'
              WHEN '3' THEN 'blocked' WHEN '4' THEN 'done' WHEN '5' THEN 'done' END AS status,
         '' AS description, o_orderstatus = 'F' AS archived,
         o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders
)"""
# What the board sees at its as-of instant.
TASKS_AT = TASKS.replace("FROM orders", f"FROM orders WHERE o_orderdate <= {TASK_AS_OF}")

ASSIGNMENTS = """
task_assignments AS (
  SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
            round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT,
            round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))), 1, 15))::BIGINT AS id,
         l_orderkey AS task_id, l_suppkey AS student_id, l_shipdate AS assigned_at,
         CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 7 DAY END AS unassigned_at
  FROM lineitem
)"""
ASSIGNMENTS_AT = f"""
task_assignments AS (
  SELECT l_orderkey AS task_id, l_suppkey AS student_id, l_shipdate AS assigned_at,
         CASE WHEN l_returnflag = 'R' AND l_shipdate + INTERVAL 7 DAY <= {TASK_AS_OF}
              THEN l_shipdate + INTERVAL 7 DAY END AS unassigned_at
  FROM lineitem WHERE l_shipdate <= {TASK_AS_OF}
)"""

COMMENT_TIME = "(TIMESTAMP '1999-12-25 00:00:00' + to_hours(CAST(turn * 12 + conv_id % 48 AS BIGINT)))"

COMMENTS = f"""
task_comments AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS task_id,
         CASE WHEN role = 'user' THEN 'student' ELSE 'mentor' END AS author_type,
         role AS author_label, text AS comment,
         {COMMENT_TIME} AS created_at
  FROM conversations
)"""

TASK_EVENTS = f"""
task_events AS (
  SELECT * FROM (
    SELECT o_orderkey AS task_id, o_orderdate AS "at", CAST(0 AS BIGINT) AS seq, 'create' AS kind,
           CAST(NULL AS BIGINT) AS student_id,
           'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
           CASE o_custkey % 5 WHEN 0 THEN 'Build' WHEN 1 THEN 'Programming'
                WHEN 2 THEN 'Electrical' WHEN 3 THEN 'CAD/CAM' WHEN 4 THEN 'Imagery & Outreach' END
             AS subteam,
           coalesce(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'todo'
                WHEN '2' THEN 'in_progress' WHEN '3' THEN 'blocked' WHEN '4' THEN 'done'
                WHEN '5' THEN 'done' END, 'bogus') AS status,
           '' AS description
    FROM orders
    UNION ALL
    SELECT o_orderkey, o_orderdate, 1, 'archive', NULL, NULL, NULL, NULL, NULL
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT l_orderkey, l_shipdate, l_linenumber * 2 + 1, 'join', l_suppkey, NULL, NULL, NULL, NULL
    FROM lineitem
    UNION ALL
    SELECT l_orderkey, l_shipdate + INTERVAL 7 DAY, l_linenumber * 2, 'leave', l_suppkey,
           NULL, NULL, NULL, NULL
    FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL
    SELECT conv_id, {COMMENT_TIME}, conv_id * 100 + turn, 'comment', NULL, NULL, NULL, NULL, NULL
    FROM conversations
  )
)"""

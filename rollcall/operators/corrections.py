"""Attendance corrections and manual entry as late-arriving events
(O-12, O-13, O-15, O-18, O-34, O-45..O-49).

A correction is a request row plus decision events.  Approved corrections
and manual entries become *set events* in the punch log, carrying the
meeting day they name, so the one session fold applies them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, js_trim
from ..functions.timez import (HHMM_RE, ISO_DATE_RE, hhmm_minutes, local_date_time,
                               parse_iso_date)
from .gate import active_ids

LIST_LIMIT = 200          # fixed value: newest corrections shown to mentors


def _first_failure(rules):
    """CASE over (predicate-that-fails, message) pairs: first failure wins."""
    expr = None
    for bad, msg in rules:
        expr = F.when(bad, F.lit(msg)) if expr is None else expr.when(bad, F.lit(msg))
    return expr


def _with_active_flag(df: DataFrame, students: DataFrame) -> DataFrame:
    act = active_ids(students).withColumn("_active", F.lit(True))
    return df.join(act, "student_id", "left")


def _judged_requests(df: DataFrame, students: DataFrame) -> DataFrame:
    """Requests with the ``reject_reason`` of the first rule they break."""
    d = F.col("meeting_date")
    tin, tout = F.col("requested_clock_in"), F.col("requested_clock_out")
    has_out = tout.isNotNull() & (tout != "")
    reason = _first_failure([
        (F.col("student_id").isNull(), "student_missing"),
        (~F.coalesce(d.rlike(ISO_DATE_RE), F.lit(False)), "meeting_date_format"),
        (~F.coalesce(tin.rlike(HHMM_RE), F.lit(False)), "clock_in_format"),
        (has_out & ~tout.rlike(HHMM_RE), "clock_out_format"),
        (F.length(js_trim(F.coalesce(F.col("reason"), F.lit("")))) < 3, "reason_too_short"),
        (F.col("_active").isNull(), "student_unknown"),
        (parse_iso_date(d).isNull(), "value_out_of_range"),
        (hhmm_minutes(tin).isNull(), "value_out_of_range"),
        (has_out & hhmm_minutes(tout).isNull(), "value_out_of_range"),
    ])
    # Rows without a student are spread by their id; they find no one, or are refused
    # before that is asked.
    act = active_ids(students).select(F.col("student_id").alias("_who"), F.lit(True).alias("_active"))
    return (df.withColumn("_who", F.coalesce("student_id", "id")).join(act, "_who", "left")
            .withColumn("reject_reason", reason).drop("_who", "_active"))


def _request_values() -> list[Column]:
    """The columns of a stored request, from one that passed."""
    tout = F.col("requested_clock_out")
    return [F.col("student_id"), parse_iso_date(F.col("meeting_date")).alias("meeting_date"), F.col("requested_clock_in"),
            F.when(tout.isNotNull() & (tout != ""), tout).alias("requested_clock_out"),
            js_trim(F.coalesce(F.col("reason"), F.lit(""))).alias("reason")]


def validate_corrections(requests: DataFrame, students: DataFrame):
    """O-15 + O-07 + O-45.  Returns ``(valid, rejects)``.

    Shape rules run first (as the request handler does), then the active
    check, then the value checks the database's casts would make (a date
    like 2026-02-30 or a time like 99:99 passes the shape test but cannot
    be stored)."""
    df = _judged_requests(requests, students)
    valid = df.where(F.col("reject_reason").isNull()).select("id", *_request_values(), F.lit("pending").alias("status"), "created_at")
    rejects = df.where(F.col("reject_reason").isNotNull())
    return valid, rejects


def _decision_values() -> list[Column]:
    """What the first decision (``first``, or null) makes of a request."""
    at = F.col("first.at")
    return [F.coalesce(F.col("first.status"), F.lit("pending")).alias("status"), F.col("created_at"), at.alias("decided_at"),
            F.when(at.isNotNull(), F.lit("mentor")).alias("decided_by"), blank_to_null(js_trim(F.col("first.note"))).alias("decision_note"),
            F.col("first.seq").alias("decision_seq")]


def correction_decide(requests: DataFrame, decisions: DataFrame):
    """O-46: apply decisions; the first valid one per request (by
    ``(at, seq)``) wins.  Returns ``(corrections, rejects)``.

    The first decision is found with a ``min`` over a struct (a mergeable
    aggregate, pre-aggregated before the shuffle), not a window, so one
    request with very many decisions cannot pile up in one task."""
    st = F.lower(F.coalesce(F.col("status"), F.lit("")))
    dec = decisions.withColumn("status", st)
    bad_status = dec.where(~st.isin("approved", "denied")).withColumn(
        "reject_reason", F.lit("status_unknown"))
    ok = dec.where(st.isin("approved", "denied"))
    req_keys = requests.select(F.col("id").alias("correction_id"),
                               F.col("created_at").alias("_created_at"))
    matched = ok.join(req_keys, "correction_id", "left")
    found = F.col("_created_at").isNotNull() & (F.col("at") >= F.col("_created_at"))
    not_found = matched.where(~found).drop("_created_at").withColumn(
        "reject_reason", F.lit("request_unknown"))
    live = matched.where(found).drop("_created_at")
    first = live.groupBy("correction_id").agg(
        F.min(F.struct("at", "seq", "status", "note")).alias("first"))
    later = (live.join(first, "correction_id")
             .where(F.struct("at", "seq") != F.struct("first.at", "first.seq"))
             .withColumn("reject_reason",
                         F.concat(F.lit("already_"), F.col("first.status")))
             .drop("first"))
    rejects = bad_status.unionByName(not_found).unionByName(later)
    out = requests.join(first.withColumnRenamed("correction_id", "id"), "id", "left")
    corrections = out.select("id", "student_id", "meeting_date", "requested_clock_in", "requested_clock_out", "reason",
                             *_decision_values())
    return corrections, rejects


def settle_corrections(log: DataFrame, students: DataFrame) -> DataFrame:
    """O-45/O-46 from one log of requests and decisions (``id``, ``is_request``, and the
    columns of both): the table that ``validate_corrections`` and ``correction_decide``
    give, in one pass and one shuffle, by request.  For logs in which a request has few
    decisions; they meet in one task."""
    same = Window.partitionBy("id")
    ok = _judged_requests(log.withColumnRenamed("at", "created_at"), students)
    valid = F.col("is_request") & F.col("reject_reason").isNull()
    st = F.lower(F.coalesce(F.col("status"), F.lit("")))
    rows = ok.withColumn("_asked", F.max(F.when(valid, F.col("created_at"))).over(same))
    counts = ~F.col("is_request") & st.isin("approved", "denied") & (F.col("created_at") >= F.col("_asked"))
    d = F.struct(F.col("created_at").alias("at"), "seq", st.alias("status"), "note")
    rows = rows.withColumn("first", F.min(F.when(counts, d)).over(same)).where(valid)
    return rows.select("id", *_request_values(), *_decision_values())


def correction_apply(corrections: DataFrame) -> DataFrame:
    """O-47: each approved correction becomes a ``set_both`` event at its
    decision time: in := requested in, out := requested out *or NULL*."""
    ap = corrections.where(F.col("status") == "approved")
    return ap.select(
        "student_id",
        F.col("decided_at").alias("at"),
        F.col("decision_seq").alias("seq"),
        F.lit("set_both").alias("kind"),
        "meeting_date",
        F.lit(None).cast("string").alias("subteam"),
        F.lit(None).cast("string").alias("working_on"),
        F.lit(None).cast("long").alias("task_id"),
        F.lit(None).cast("boolean").alias("value"),
        local_date_time("meeting_date", "requested_clock_in").alias("set_in"),
        local_date_time("meeting_date", "requested_clock_out").alias("set_out"))


def corrections_list(corrections: DataFrame, students: DataFrame, status: str | None = "pending",
                     date=None, limit: int | None = LIST_LIMIT) -> DataFrame:
    """O-12/O-13/O-18/O-34: the mentor's list.  ``status`` is lower-cased;
    ``'all'`` means no status filter; ``date`` filters the meeting day.
    Inactive students are kept (plain inner join).  Newest first, top
    ``limit`` (a TakeOrderedAndProject, no full sort)."""
    status = (status or "pending").lower()
    if status not in ("pending", "approved", "denied", "all"):
        raise ValueError("unknown status")
    df = corrections
    if status != "all":
        df = df.where(F.col("status") == status)
    if date is not None:
        parsed = str(date)
        import re
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", parsed):
            raise ValueError("a date looks like 2024-01-31")
        df = df.where(F.col("meeting_date") == F.lit(parsed).cast("date"))
    s = students.select("student_id", "full_name", F.col("subteam").alias("roster_subteam"))
    out = df.join(s, "student_id", "inner")
    out = out.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return out.limit(limit) if limit else out


def manual_attendance(entries: DataFrame, students: DataFrame, policy: str = "patch"):
    """O-48 (``policy='patch'``, the live behaviour) and O-49
    (``policy='replace'``).  Returns ``(events, rejects)``; events feed the
    session fold.

    A NULL subteam takes the student's roster subteam (the form's default).

    patch:   each time only if non-empty; subteam if non-empty; working_on
             if non-NULL (an empty string clears it).
    replace: clock-in required; clock-out overwritten even by NULL; the
             working_on text kept when the new one is empty."""
    if policy not in ("patch", "replace"):
        raise ValueError("policy must be 'patch' or 'replace'")
    d = F.col("meeting_date")
    tin, tout = F.col("clock_in_time"), F.col("clock_out_time")
    has_in = tin.isNotNull() & (tin != "")
    has_out = tout.isNotNull() & (tout != "")
    df = _with_active_flag(entries, students)
    # O-22c: the entry form starts from the roster subteam; an entry that
    # does not name one (NULL, not '') carries that default.
    roster = students.select(
        "student_id", F.col("subteam").alias("_roster_subteam"))
    df = df.join(roster, "student_id", "left")
    in_rule = ((~F.coalesce(tin.rlike(HHMM_RE), F.lit(False))) if policy == "replace"
               else (has_in & ~tin.rlike(HHMM_RE)))
    reason = _first_failure([
        (F.col("student_id").isNull(), "student_missing"),
        (~F.coalesce(d.rlike(ISO_DATE_RE), F.lit(False)), "meeting_date_format"),
        (in_rule, "clock_in_format"),
        (has_out & ~tout.rlike(HHMM_RE), "clock_out_format"),
        (F.col("_active").isNull(), "student_unknown"),
        (parse_iso_date(d).isNull(), "value_out_of_range"),
        (has_in & hhmm_minutes(tin).isNull(), "value_out_of_range"),
        (has_out & hhmm_minutes(tout).isNull(), "value_out_of_range"),
    ])
    df = df.withColumn("reject_reason", reason)
    ok = df.where(F.col("reject_reason").isNull()).withColumn("_d", parse_iso_date(d))
    if policy == "patch":
        kind = (F.when(has_in & has_out, "set_both").when(has_in, "set_in")
                .when(has_out, "set_out").otherwise("update"))
        working_on = F.col("working_on")
    else:
        kind = F.lit("set_both")
        working_on = blank_to_null(F.col("working_on"))
    events = ok.select(
        "student_id", "at", "seq", kind.alias("kind"),
        F.col("_d").alias("meeting_date"),
        F.coalesce(F.col("subteam"), F.col("_roster_subteam")).alias("subteam"),
        working_on.alias("working_on"),
        F.lit(None).cast("long").alias("task_id"),
        F.lit(None).cast("boolean").alias("value"),
        F.when(has_in, local_date_time("_d", tin)).alias("set_in"),
        F.when(has_out, local_date_time("_d", tout)).alias("set_out"))
    rejects = df.where(F.col("reject_reason").isNotNull()).drop("_active", "_roster_subteam")
    return events, rejects

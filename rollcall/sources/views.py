"""Domain views over the shared test tables (``/root/testdata/sf*/``).

Each view maps a generic table onto one of the domain tables with plain
column expressions, so Spark can still prune columns and push filters into
the Parquet scan.  The same mappings are written in SQL for the DuckDB
oracle (``rollcall.plans.oracle_views``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import eastern_date, eastern_day_bounds_utc, ts_lit
from .tables import read_table

# Fixed parameters of the test views.
ATTENDANCE_AS_OF = dt.datetime(2024, 2, 1, 0, 0, 0)
BOARD_AS_OF = dt.datetime(2024, 1, 15, 17, 0, 0)      # noon Eastern
REPORT_START = dt.date(2024, 1, 8)
REPORT_END = dt.date(2024, 1, 21)
TASK_AS_OF = dt.datetime(2000, 1, 1, 0, 0, 0)
CLEANUP_AT = dt.datetime(2002, 1, 1, 0, 0, 0)        # the assignment cleanup's own time
ROSTER_CREATED_AT = dt.datetime(2023, 9, 1, 0, 0, 0)
COMMENT_EPOCH = dt.datetime(1999, 12, 25, 0, 0, 0)

# Subteam names offered by the sign-in screen, in order.
SUBTEAMS = ["Build", "Programming", "Electrical", "CAD/CAM", "Imagery & Outreach"]

# event_type -> punch kind.
EVENT_KIND = {"signup": "clock_in", "purchase": "clock_out", "view": "update",
              "click": "need_help", "error": "need_task"}


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("student_id"),
        F.col("c_name").alias("full_name"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("subteam"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        ts_lit(ROSTER_CREATED_AT).alias("created_at"),
    )


def _kind(event_type):
    expr = None
    for et, kind in EVENT_KIND.items():
        expr = (F.when(event_type == et, kind) if expr is None
                else expr.when(event_type == et, kind))
    return expr


def punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return punches_from_events(read_table(spark, sf_dir, "events"))


def correction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requests: every event asks to fix its own Eastern day.  The last two
    digits of the id decide which request carries which defect."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % 100
    none = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(k == 1, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("student_id"),
        F.when(k == 2, F.lit("Jan 9")).when(k == 3, F.lit("2024-02-30"))
         .otherwise(F.date_format(eastern_date("ts"), "yyyy-MM-dd")).alias("meeting_date"),
        F.when(k == 4, F.lit("5 pm")).when(k == 5, F.lit("99:99"))
         .otherwise(F.lit("17:00")).alias("requested_clock_in"),
        F.when(k == 6, F.lit("late")).when(k == 7, F.lit("25:00"))
         .when((F.col("event_id") % 2) == 0, none)
         .otherwise(F.lit("19:30")).alias("requested_clock_out"),
        F.when(k == 8, F.lit(" x ")).otherwise(
            F.concat(F.lit("  missed punch "), F.col("event_type"), F.lit(" "))).alias("reason"),
        F.col("ts").alias("created_at"),
    )


def correction_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentor decisions, one for every event, by its type: signup and purchase
    are approved and view denied a day after the request; click is decided a day
    before it was made and error with an unknown word, so these stay pending.
    Purchases get a second, contrary decision a day later, which must be refused.
    One scan: each event yields one or two decisions."""
    e = read_table(spark, sf_dir, "events")
    eid, kind = F.col("event_id"), F.col("event_type")
    first = F.struct(
        (F.when(kind == "click", F.col("ts") - F.expr("INTERVAL 1 DAY"))
         .otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY"))).alias("at"),
        (eid * 10).alias("seq"),
        F.when(kind.isin("signup", "purchase"), "approved").when(kind == "error", "maybe")
         .otherwise("DENIED").alias("status"),
        F.when(kind.isin("signup", "purchase"), F.lit("  ok  ")).otherwise(F.lit("")).alias("note"))
    second = F.when(kind == "purchase", F.struct(
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("at"),
        (eid * 10 + 1).alias("seq"),
        F.lit("denied").alias("status"),
        F.lit("second look").alias("note")))
    both = F.filter(F.array(first, second), lambda d: d.isNotNull())
    return (e.select(eid.alias("correction_id"), F.explode(both).alias("d"))
            .select("correction_id", "d.at", "d.seq", "d.status", "d.note"))


def correction_log(spark: SparkSession, sf_dir: str, first=None, last=None) -> DataFrame:
    """Requests and decisions of ``correction_requests`` and ``correction_decisions`` as
    one log, from one scan of the events.  With ``first`` and ``last``, only of requests
    for these days: a request names the Eastern day of its own time, so the scan is cut
    to their hours."""
    e = read_table(spark, sf_dir, "events")
    if first is not None:
        lo, hi = eastern_day_bounds_utc(first, last)
        e = e.where((F.col("ts") >= ts_lit(lo)) & (F.col("ts") < ts_lit(hi)))
    eid, kind, k = F.col("event_id"), F.col("event_type"), F.col("event_id") % 100
    none = F.lit(None).cast("string")

    def row(request, **given):
        types = {"student_id": "long", "meeting_date": "string", "requested_clock_in": "string", "requested_clock_out": "string", "reason": "string",
                 "at": "timestamp_ntz", "seq": "long", "status": "string", "note": "string"}
        return F.struct(F.lit(request).alias("is_request"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    request = row(
        True, student_id=F.when(k != 1, F.col("user_id")),
        meeting_date=F.when(k == 2, F.lit("Jan 9")).when(k == 3, F.lit("2024-02-30")).otherwise(F.date_format(eastern_date("ts"), "yyyy-MM-dd")),
        requested_clock_in=F.when(k == 4, F.lit("5 pm")).when(k == 5, F.lit("99:99")).otherwise(F.lit("17:00")),
        requested_clock_out=F.when(k == 6, F.lit("late")).when(k == 7, F.lit("25:00")).when((eid % 2) == 0, none).otherwise(F.lit("19:30")),
        reason=F.when(k == 8, F.lit(" x ")).otherwise(F.concat(F.lit("  missed punch "), kind, F.lit(" "))), at=F.col("ts"))
    approves = kind.isin("signup", "purchase")
    decision = row(
        False, at=F.when(kind == "click", F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY")), seq=eid * 10,
        status=F.when(approves, "approved").when(kind == "error", "maybe").otherwise(F.lit("DENIED")), note=F.when(approves, F.lit("  ok  ")).otherwise(F.lit("")))
    second = F.when(kind == "purchase", row(False, at=F.col("ts") + F.expr("INTERVAL 2 DAYS"), seq=eid * 10 + 1, status=F.lit("denied"), note=F.lit("second look")))
    rows = F.filter(F.array(request, decision, second), lambda d: d.isNotNull())
    return e.select(eid.alias("id"), F.explode(rows).alias("r")).select("id", "r.*")


def _task_status(priority):
    d = F.substring(priority, 1, 1)
    return (F.when(d == "1", "todo").when(d == "2", "in_progress")
            .when(d == "3", "blocked").when(d.isin("4", "5"), "done"))


def _subteam_of(custkey):
    m = custkey % len(SUBTEAMS)
    expr = None
    for i, name in enumerate(SUBTEAMS):
        expr = F.when(m == i, name) if expr is None else expr.when(m == i, name)
    return expr


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a task; an as-of instant is the business of the operators."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        _subteam_of(F.col("o_custkey")).alias("subteam"),
        _task_status(F.col("o_orderpriority")).alias("status"),
        F.lit("").alias("description"),
        (F.col("o_orderstatus") == "F").alias("archived"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def _lineitem_id():
    """60 bits of the MD5 of a line's columns (amounts in cents), so that any engine can
    name the same assignment."""
    cents = [F.round(F.col(c) * 100).cast("long") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    whole = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cents, "l_returnflag", "l_linestatus",
                        F.date_format("l_shipdate", "yyyy-MM-dd"))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def task_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as an assignment; returned ones are left after a week."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        _lineitem_id().alias("id"),
        F.col("l_orderkey").alias("task_id"),
        F.col("l_suppkey").alias("student_id"),
        F.col("l_shipdate").alias("assigned_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS")).alias("unassigned_at"),
    )


def _comment_time():
    hours = F.col("turn") * 12 + F.col("conv_id") % 48
    return ts_lit(COMMENT_EPOCH) + F.make_dt_interval(F.lit(0), hours.cast("int"))


def task_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("task_id"),
        F.when(F.col("role") == "user", "student").otherwise("mentor").alias("author_type"),
        F.col("role").alias("author_label"),
        F.col("text").alias("comment"),
        _comment_time().alias("created_at"),
    )


def comment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment posts as submitted: user turns name a student (the fifth turn one that
    does not exist), system turns carry a blank label, the seventh turn a blank comment,
    the eighth a task that does not exist."""
    c = read_table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    return c.select(
        (F.col("conv_id") * 100 + turn).alias("id"),
        F.when(turn == 7, F.col("conv_id") + 1000000000).otherwise(F.col("conv_id")).alias("task_id"),
        _comment_time().alias("at"),
        F.when((F.col("role") == "user") & (turn == 4), F.col("conv_id") + 1000000000)
         .when(F.col("role") == "user", F.col("conv_id")).alias("student_id"),
        F.col("role").alias("author_type"),
        F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant")
         .otherwise(F.lit("   ")).alias("author_label"),
        F.when(turn == 6, F.lit(" \t ")).otherwise(F.col("text")).alias("comment"),
    )


def _task_rows(df: DataFrame, **given) -> DataFrame:
    from ..schemas import TASK_EVENTS
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TASK_EVENTS.fields])


def task_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further events of the task log.  Every order is patched a day after it was made
    (the customer's key decides the title, the status what else) and closed ones of high
    priority are unarchived a day later; lineitems of linestatus O are assigned again
    three days after they were shipped; every part is a task of its own, whose size
    decides whether the create lacks its title or subteam and whether the join that
    follows lacks a student."""
    o, li, p = (read_table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    day = F.expr("INTERVAL 1 DAY")
    title = F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string"), F.lit(" rev "))
    patch = _task_rows(
        o, task_id=F.col("o_orderkey"), at=F.col("o_orderdate") + day, seq=F.lit(2), kind=F.lit("patch"),
        title=F.when(F.col("o_custkey") % 3 == 0, title).when(F.col("o_custkey") % 3 == 1, F.lit("  ")),
        subteam=F.when(F.col("o_orderstatus") == "P", F.lit("Build")).when(F.col("o_orderstatus") == "O", F.lit("")),
        status=F.when(F.col("o_orderpriority").startswith("1"), F.lit("blocked")).when(F.col("o_orderpriority").startswith("2"), F.lit("paused"))
                .when(F.col("o_orderpriority").startswith("4"), F.lit("todo")),
        description=F.when(F.col("o_orderstatus") == "P", F.lit("")).when(F.col("o_orderstatus") == "O", F.lit(" see notes ")))
    unarchive = _task_rows(o.where((F.col("o_orderstatus") == "F") & F.substring("o_orderpriority", 1, 1).isin("1", "2")),
                           task_id=F.col("o_orderkey"), at=F.col("o_orderdate") + day + day, seq=F.lit(3), kind=F.lit("unarchive"))
    assign = _task_rows(li.where(F.col("l_linestatus") == "O"), task_id=F.col("l_orderkey"), at=F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS"),
                        seq=F.col("l_linenumber") * 2 + 100, kind=F.lit("assign"), student_id=F.col("l_suppkey"))
    key, size, made = F.col("p_partkey") + 1000000000, F.col("p_size"), ts_lit(COMMENT_EPOCH)
    create = _task_rows(p, task_id=key, at=made, seq=F.lit(0), kind=F.lit("create"),
                        title=F.when(size % 5 != 0, F.concat(F.lit(" "), "p_name")).otherwise(F.lit("   ")),
                        subteam=F.when(size % 5 != 1, F.col("p_brand")), status=F.col("p_type"))
    join = _task_rows(p, task_id=key, at=made + day, seq=F.lit(1), kind=F.lit("join"), student_id=F.when(size % 2 == 0, F.col("p_partkey")))
    return patch.unionByName(unarchive).unionByName(assign).unionByName(create).unionByName(join)


def restored_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks as a faulty restore left them, for the audits: pending orders are gone,
    low priorities have a status nobody knows, and some customers' tasks lost their title
    or subteam."""
    t = tasks(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return (t.join(o, "id").where(F.col("o_orderstatus") != "P")
            .withColumn("status", F.when(F.col("o_orderpriority").startswith("5"), F.lit("finished")).otherwise(F.col("status")))
            .withColumn("title", F.when(F.col("o_custkey") % 10 != 3, F.col("title")))
            .withColumn("subteam", F.when(F.col("o_custkey") % 10 != 4, F.col("subteam")))
            .select(*t.columns))


def restored_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments of the same restore: the role stands where the author's type should,
    and a system turn has no label."""
    c = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role")
    t = task_comments(spark, sf_dir)
    return (t.join(c, "id").withColumn("author_type", F.when(F.col("role") == "user", F.lit("student")).when(F.col("role") == "assistant", F.lit("bot")))
            .withColumn("author_label", F.when(F.col("role") != "system", F.col("author_label"))).select(*t.columns))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task event log: create + archive from orders, join/leave from lineitem,
    comments from conversations."""
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    cv = read_table(spark, sf_dir, "conversations")
    none_s = F.lit(None).cast("string")
    none_l = F.lit(None).cast("long")
    order, line = F.col("o_orderkey"), F.col("l_orderkey")

    def event(task, at, seq, kind, student=none_l, title=none_s, subteam=none_s, status=none_s, description=none_s):
        return F.struct(task.alias("task_id"), at.alias("at"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), student.alias("student_id"),
                        title.alias("title"), subteam.alias("subteam"), status.alias("status"), description.alias("description"))

    def events(df, *some):
        """All events of a row from one scan; missing ones are null."""
        return df.select(F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("e")).select("e.*")

    tasks_ = events(
        o, event(order, F.col("o_orderdate"), F.lit(0), "create", title=F.concat(F.lit("Order "), order.cast("string")),
                 subteam=_subteam_of(F.col("o_custkey")), status=F.coalesce(_task_status(F.col("o_orderpriority")), F.lit("bogus")), description=F.lit("")),
        F.when(F.col("o_orderstatus") == "F", event(order, F.col("o_orderdate"), F.lit(1), "archive")))
    people = events(
        li, event(line, F.col("l_shipdate"), F.col("l_linenumber") * 2 + 1, "join", F.col("l_suppkey")),
        F.when(F.col("l_returnflag") == "R", event(line, F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS"), F.col("l_linenumber") * 2, "leave", F.col("l_suppkey"))))
    comment = cv.select(
        F.col("conv_id").alias("task_id"), _comment_time().alias("at"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.lit("comment").alias("kind"),
        F.lit(None).cast("long").alias("student_id"),
        none_s.alias("title"), none_s.alias("subteam"), none_s.alias("status"),
        none_s.alias("description"))
    return tasks_.unionByName(people).unionByName(comment)


UPSERT_AT = dt.datetime(2024, 2, 1, 0, 0, 0)


def roster_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster upload rows: every supplier as a new name (padded with spaces,
    subteam = its nation), suppliers with a negative balance sent again later, and
    every customer re-sent with a subteam that its nation decides (missing, empty,
    blank or named); nations 3 and 4 are sent without a name."""
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    c = read_table(spark, sf_dir, "customer")
    sn = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left")
    base = ts_lit(UPSERT_AT)
    new = sn.select(
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s_suppkey").cast("int")))
        .alias("at"),
        F.col("s_suppkey").alias("seq"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("full_name"),
        F.col("n_name").alias("subteam"))
    again = sn.where(F.col("s_acctbal") < 0).select(
        (base + F.expr("INTERVAL 2 DAYS")).alias("at"),
        F.col("s_suppkey").alias("seq"),
        F.col("s_name").alias("full_name"),
        F.lit("Programming").alias("subteam"))
    nk, even = F.col("c_nationkey"), (F.col("c_custkey") % 2) == 0
    old = c.select(
        (base + F.expr("INTERVAL 1 DAY")).alias("at"),
        F.col("c_custkey").alias("seq"),
        F.when(nk == 3, F.lit("")).when(nk != 4, F.col("c_name")).alias("full_name"),
        F.when(nk == 1, F.lit(None).cast("string")).when(nk == 2, F.lit("")).when((nk == 0) & even, F.lit("  "))
         .when(even, F.concat(F.lit(" Team "), nk.cast("string"))).otherwise(F.lit("Build"))
         .alias("subteam"))
    return new.unionByName(again).unionByName(old)


#: A name that many edits claim.
SHARED_NAME = "Captain"


def roster_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster edits, one for every customer, a second apart in the order of their keys;
    the nation says what the edit is: 0 takes a new name of its own, 1 reactivates
    (negative balances), 2 sends an empty subteam, 3 a blank name, 4 aims at an id that
    does not exist, 5 to 9 claim the name of the customer before them, 10 to 12 all claim
    one name; the rest set a subteam."""
    c = read_table(spark, sf_dir, "customer")
    nk, key = F.col("c_nationkey"), F.col("c_custkey")
    before = c.select((key + 1).alias("_after"), F.col("c_name").alias("_before"))
    claim = nk.between(5, 9)
    return c.join(before, key == F.col("_after"), "left").select(
        (ts_lit(UPSERT_AT) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), key.cast("int"))).alias("at"),
        key.alias("seq"),
        F.when(nk == 4, key + 1000000000).otherwise(key).alias("student_id"),
        F.when(nk == 0, F.concat("c_name", F.lit(" II"))).when(nk == 3, F.lit("   "))
         .when(claim, F.concat(F.lit(" "), "_before", F.lit(" "))).when(nk.between(10, 12), F.lit(SHARED_NAME)).alias("full_name"),
        F.when(nk == 2, F.lit("")).when(claim | (nk > 12), F.lit("Programming")).alias("subteam"),
        F.when((nk == 1) & (F.col("c_acctbal") < 0), F.lit(True)).when(nk == 4, F.lit(False)).alias("is_active"))


EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                 "value double, props string")


def punches_from_events(e: DataFrame) -> DataFrame:
    """The punch mapping for any events DataFrame (batch or streaming)."""
    kind = "CASE event_type " + " ".join(
        f"WHEN '{et}' THEN '{k}'" for et, k in EVENT_KIND.items()) + " END"
    k = "_k"
    # Parse the payload once per row (a non-trivial expression referenced
    # three times is not inlined back by the optimizer).
    e = e.where(F.col("event_type").isin(*EVENT_KIND)).withColumn(
        "_k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr(
        "user_id AS student_id",
        "ts AS `at`",
        "event_id AS seq",
        f"{kind} AS kind",
        "CAST(NULL AS DATE) AS meeting_date",
        "CAST(NULL AS STRING) AS subteam",
        f"CASE WHEN event_type IN ('signup', 'view') THEN concat('k', CAST({k} AS STRING)) END"
        " AS working_on",
        f"CASE WHEN event_type = 'signup' THEN {k} END AS task_id",
        f"CASE WHEN event_type IN ('click', 'error') THEN {k} % 2 = 0 END AS value",
        "CAST(NULL AS TIMESTAMP_NTZ) AS set_in",
        "CAST(NULL AS TIMESTAMP_NTZ) AS set_out",
    )


def punches_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a file stream (a glob naming the table).  All
    files there are make one batch: were they dealt to several, a file out of
    time order would fall behind the watermark and be lost."""
    e = (spark.readStream.schema(EVENTS_SCHEMA)
         .parquet(f"{sf_dir.rstrip('/')}/events.parq[u]et"))
    return punches_from_events(e)


def manual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper-record backfills: every event becomes a mentor entry for the
    student's Eastern day, three days later, with a mix of missing times,
    blank subteams and cleared notes."""
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        F.col("user_id").alias("student_id"),
        (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("at"),
        eid.alias("seq"),
        F.date_format(eastern_date("ts"), "yyyy-MM-dd").alias("meeting_date"),
        F.when((eid % 2) == 0, F.lit("16:00")).otherwise(F.lit("")).alias("clock_in_time"),
        F.when((eid % 3) != 0, F.lit("18:15")).otherwise(F.lit("")).alias("clock_out_time"),
        F.when((eid % 5) == 0, F.lit("")).when((eid % 11) == 0, F.lit(None).cast("string"))
         .otherwise(F.lit("Build")).alias("subteam"),
        F.when((eid % 7) == 0, F.lit("")).otherwise(F.lit("paper log")).alias("working_on"))


def dashboard_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When somebody looked at a dashboard: an hour and a half after every view."""
    e = read_table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "view").select((F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("at"))

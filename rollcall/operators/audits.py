"""Constraint audits (O-61..O-63) as long-form violation tables, and the
repair policies of the foreign keys.  Each check is a grouped count or an
anti-join: distributed, with partial aggregation before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import AUTHOR_TYPES, CORRECTION_STATUSES, TASK_STATUSES


KEYS = 1 << 19                  # keys that one task counts
BUCKETS = 1 << 16               # hash buckets that find very frequent keys
HOT = 1 << 20                   # rows of a bucket from which its keys are combined before the shuffle


def _key_text(cols):
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols])


def _key_counts(d: DataFrame, cols: list[str], whole: DataFrame) -> DataFrame:
    """Rows per key (``n_rows``).  Up to ``KEYS`` rows Spark deals them out by itself.  More
    are dealt by key into as many parts as they need, since merging parts by their packed
    bytes may give one task any number of keys; the keys of buckets with very many rows
    are combined before the shuffle instead.  ``whole`` has all keys of ``d`` at least."""
    n_rows = F.count(F.lit(1)).alias("n_rows")
    bucket = F.pmod(F.xxhash64(*cols), F.lit(BUCKETS))
    found = (whole.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > HOT, F.col("b"))).alias("hot")).first())
    parts = -(-(found["n"] or 0) // KEYS)
    if parts < 2:
        return d.groupBy(*cols).agg(n_rows)
    hot = bucket.isin(found["hot"])
    dealt = d.where(~hot).select(*cols).repartition(parts, *cols).groupBy(*cols).agg(n_rows)
    return dealt.unionByName(d.where(hot).groupBy(*cols).agg(n_rows)) if found["hot"] else dealt


def duplicate_keys(df: DataFrame, table: str, cols: list[str], where=None, whole: DataFrame | None = None) -> DataFrame:
    d = df if where is None else df.where(where)
    return (_key_counts(d, cols, df if whole is None else whole)
            .where(F.col("n_rows") > 1)
            .select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
                    _key_text(cols).alias("key_value"), "n_rows"))


def audit_unique(tables: dict[str, DataFrame], sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """O-61: primary keys, unique names, one session per student and day (for stored
    tables; the fold itself can't repeat a key), at most one open assignment per (task,
    student).  ``sources`` may name, for a table that is costly to derive, one with the same
    key columns and all its keys, from which the parts of the count are planned."""
    checks = []
    t = tables
    sources = sources or {}
    if "students" in t:
        checks += [duplicate_keys(t["students"], "students", ["student_id"]),
                   duplicate_keys(t["students"], "students", ["full_name"])]
    if "daily_sessions" in t:
        checks.append(duplicate_keys(t["daily_sessions"], "daily_sessions",
                                     ["student_id", "meeting_date"]))
    if "task_assignments" in t:
        checks.append(duplicate_keys(t["task_assignments"], "task_assignments",
                                     ["task_id", "student_id"],
                                     F.col("unassigned_at").isNull()))
    for name, key in (("tasks", "id"), ("task_comments", "id"),
                      ("attendance_corrections", "id")):
        if name in t:
            checks.append(duplicate_keys(t[name], name, [key], whole=sources.get(name)))
    return reduce(DataFrame.unionByName, checks)


# (child table, column, parent table, parent key, policy)
FOREIGN_KEYS = [
    ("task_assignments", "task_id", "tasks", "id", "cascade"),
    ("task_assignments", "student_id", "students", "student_id", "cascade"),
    ("task_comments", "task_id", "tasks", "id", "cascade"),
    ("daily_sessions", "student_id", "students", "student_id", "cascade"),
    ("daily_sessions", "task_id", "tasks", "id", "set_null"),
    ("attendance_corrections", "student_id", "students", "student_id", "cascade"),
]


def _long(tables, rows) -> DataFrame:
    """One (k, v) table of several columns: ``rows`` gives for each table its (k, column)
    pairs, all read in one scan of the table."""
    parts = []
    for name, cols in rows.items():
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in cols])
        parts.append(tables[name].select(F.explode(pairs).alias("p")).select("p.*"))
    return reduce(DataFrame.unionByName, parts)


def _named(index, values):
    """The value of a short fixed list at ``index``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(index) + 1)


def audit_fk(tables: dict[str, DataFrame]) -> DataFrame:
    """O-62: orphaned references, counted per missing key.  Every table is read once per
    side; references are counted per value first, so that a value of very many rows is one
    row when it meets the parents' keys."""
    keys = [(k, fk) for k, fk in enumerate(FOREIGN_KEYS) if fk[0] in tables and fk[2] in tables]
    children: dict[str, list] = {}
    parents: dict[str, list] = {}
    for k, (child, col, parent, key, _) in keys:
        children.setdefault(child, []).append((k, F.col(col).cast("long")))
        parents.setdefault(parent, []).append((k, F.col(key).cast("long")))
    counts = _long(tables, children).where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n_rows"))
    orphans = counts.join(_long(tables, parents), ["k", "v"], "left_anti")
    label = lambda at: _named("k", [fk[at] for fk in FOREIGN_KEYS])
    return orphans.select(label(0).alias("table_name"), label(1).alias("fk_column"), label(2).alias("parent_table"),
                          F.col("v").alias("fk_value"), label(4).alias("on_delete"), "n_rows")


def repair_fk(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Apply the declared delete policies to orphans: ``cascade`` drops the
    child row, ``set_null`` clears the column."""
    out = dict(tables)
    for child, col, parent, key, policy in FOREIGN_KEYS:
        if child not in out or parent not in tables:
            continue
        keys = tables[parent].select(F.col(key).alias("_k"), F.lit(True).alias("_ok")).distinct()
        df = out[child]
        if policy == "cascade":
            df = df.join(keys, df[col] == keys["_k"], "left_semi")
        else:
            j = df.join(keys, df[col] == keys["_k"], "left")
            df = j.withColumn(col, F.when(F.col("_ok"), F.col(col))).drop("_k", "_ok")
        out[child] = df
    return out


# (table, column, allowed values or None for NOT NULL only)
DOMAIN_CHECKS = [
    ("tasks", "status", TASK_STATUSES),
    ("tasks", "title", None),
    ("tasks", "subteam", None),
    ("task_comments", "author_type", AUTHOR_TYPES),
    ("task_comments", "author_label", None),
    ("task_comments", "comment", None),
    ("attendance_corrections", "status", CORRECTION_STATUSES),
    ("attendance_corrections", "requested_clock_in", None),
    ("students", "full_name", None),
]


def audit_domain(tables: dict[str, DataFrame]) -> DataFrame:
    """O-63: CHECK lists and NOT NULL columns; one row per offending value.  A table is
    read once for all its checks."""
    checks: dict[str, list] = {}
    for k, (table, col, allowed) in enumerate(DOMAIN_CHECKS):
        if table in tables:
            c = F.col(col)
            bad = c.isNull() if allowed is None else (c.isNull() | ~c.isin(*allowed))
            checks.setdefault(table, []).append((k, F.struct(bad.alias("bad"), c.cast("string").alias("value"))))
    rules = ["not null" if allowed is None else "check" for _, _, allowed in DOMAIN_CHECKS]
    counts = _long(tables, checks).where("v.bad").groupBy("k", F.col("v.value").alias("bad_value")).agg(F.count(F.lit(1)).alias("n_rows"))
    label = lambda at: _named("k", [check[at] for check in DOMAIN_CHECKS])
    return counts.select(label(0).alias("table_name"), label(1).alias("column_name"), _named("k", rules).alias("rule"), "bad_value", "n_rows")

"""Table sources (O-03).

Parquet is the default store: Spark prunes columns and pushes filters into
the scan.  A JDBC source is offered for reading a live database in parallel
slices; it needs a numeric partition column and the driver jar on the class
path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas

DOMAIN_SCHEMAS: dict[str, T.StructType] = {
    "students": schemas.STUDENTS,
    "tasks": schemas.TASKS,
    "task_assignments": schemas.TASK_ASSIGNMENTS,
    "task_comments": schemas.TASK_COMMENTS,
    "daily_sessions": schemas.DAILY_SESSIONS,
    "attendance_corrections": schemas.ATTENDANCE_CORRECTIONS,
    "punches": schemas.PUNCHES,
}


# Declared schemas of the shared source tables: reads never infer (no
# footer round trip on the driver, and a drifted file fails loudly).
SOURCE_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``<base_dir>/<name>.parquet`` (file or directory), with its declared
    schema when one is known."""
    return read_parquet(spark, f"{base_dir.rstrip('/')}/{name}.parquet",
                        SOURCE_SCHEMAS.get(name) or DOMAIN_SCHEMAS.get(name))


def load_tables(spark: SparkSession, base_dir: str, names=None) -> dict[str, DataFrame]:
    """Load domain tables stored as Parquet and conform them to the declared
    schemas (adding evolved columns with their defaults)."""
    names = names or list(DOMAIN_SCHEMAS)
    out = {}
    for name in names:
        df = read_table(spark, base_dir, name)
        out[name] = schemas.conform(df, DOMAIN_SCHEMAS[name], schemas.DEFAULTS.get(name))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int,
              properties: dict | None = None) -> DataFrame:
    """Parallel JDBC read: ``num_partitions`` range slices of ``partition_column``."""
    return spark.read.jdbc(url=url, table=table, column=partition_column,
                           lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})

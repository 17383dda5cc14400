"""Queries see what the tables hold now; file order doesn't change the stream's result."""

import uuid

from pyspark.sql import functions as F

from rollcall.operators.sessions import session_fold
from rollcall.plans import catalog
from rollcall.session import checkpoint_root
from rollcall.sources import views

SF = "/root/testdata/sf0.001"


def test_appended_rows_are_seen(spark, tmp_path):
    sf = tmp_path / "sf"
    before = catalog.queries()["roster_all"](spark, SF).count()
    base = spark.read.parquet(f"{SF}/customer.parquet")
    base.write.parquet(f"{sf}/customer.parquet")
    assert catalog.queries()["roster_all"](spark, str(sf)).count() == before
    more = base.withColumn("c_custkey", F.col("c_custkey") + 10_000_000).withColumn("c_name", F.concat("c_name", F.lit(" b")))
    more.write.mode("append").parquet(f"{sf}/customer.parquet")
    assert catalog.queries()["roster_all"](spark, str(sf)).count() == 2 * before


def test_stream_over_files_out_of_order(spark):
    from rollcall.streaming.sessions_stream import run_session_stream

    root = f"{checkpoint_root(spark).rstrip('/')}/rollcall-test-late-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(5, F.desc("ts")).write.parquet(f"{root}/events.parquet")
    run_session_stream(spark, views.punches_stream(spark, root), f"{root}/sink", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/sink")
    want = session_fold(views.punches(spark, SF))
    last = want.agg(F.max("meeting_date").alias("d")).first()["d"]
    key = ["student_id", "meeting_date", "clock_in_at", "clock_out_at"]
    closed = lambda df: df.where(F.datediff(F.lit(last), "meeting_date") > 2).select(*key)
    assert closed(want).count() > 100
    assert closed(want).exceptAll(closed(got)).count() == 0 == closed(got).exceptAll(closed(want)).count()

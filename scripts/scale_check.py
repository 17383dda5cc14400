"""Scale check: replicate a test-data event log N times into a
fresh scratch folder, then time the punch mapping, the session fold and a
fixed-width (hash-aggregatable) fold, and report spill from the event log.

    python scripts/scale_check.py [sf_dir] [copies] [scratch_parent]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    scratch = tempfile.mkdtemp(prefix="rollcall-scale-",
                               dir=sys.argv[3] if len(sys.argv) > 3 else None)
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false")
             .config("spark.eventLog.dir", f"file://{scratch}")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from rollcall.operators import sessions as ses
    from rollcall.sources import views as V
    from rollcall.sources.tables import SOURCE_SCHEMAS, read_parquet

    src = read_parquet(spark, f"{sf_dir}/events.parquet", SOURCE_SCHEMAS["events"])
    r = F.col("_r")
    big = (src.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
           .select((F.col("event_id") * copies + r).alias("event_id"),
                   (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                     r.cast("int"))).alias("ts"),
                   (F.col("user_id") + r * 1_000_000).alias("user_id"),
                   "event_type", "value", "props"))
    path = f"{scratch}/events.parquet"
    big.write.parquet(path)
    punches = V.punches_from_events(read_parquet(spark, path, SOURCE_SCHEMAS["events"]))

    def fixed_only(ev):
        ev = ses.with_meeting_date(ev)
        return ev.groupBy("student_id", "meeting_date").agg(
            F.expr("min(CASE WHEN kind = 'clock_in' THEN `at` END)").alias("a"),
            F.expr("max(CASE WHEN kind = 'clock_out' THEN `at` END)").alias("b"),
            F.max("at").alias("u"), F.count(F.lit(1)).alias("n"))

    out = {"events": spark.read.parquet(path).count(), "copies": copies}
    for label, df in (("scan_map_s", punches), ("fold_s", ses.session_fold(punches)),
                      ("fixed_width_fold_s", fixed_only(punches))):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out[label] = round(time.perf_counter() - t0, 2)
    spark.stop()
    spill = 0
    for f in glob.glob(f"{scratch}/*/events*") + glob.glob(f"{scratch}/local-*"):
        if os.path.isfile(f):
            for line in open(f):
                if '"Event":"SparkListenerTaskEnd"' in line:
                    spill += json.loads(line).get("Task Metrics", {}).get("Disk Bytes Spilled", 0)
    out["disk_bytes_spilled"] = spill
    out["scratch"] = scratch
    print(json.dumps(out))


if __name__ == "__main__":
    main()

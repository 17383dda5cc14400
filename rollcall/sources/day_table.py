"""A table of days whose versions appear at once (C-4, O-47).

Replacing the folders of several days one after the other shows readers a mix of old and
new days.  Here a change writes its days into a folder of its own and then one manifest
file, which names the folder of every day of the table.  The manifest's one rename is the
commit: readers take the newest manifest, so before it they see all old days, after it all
new ones.  Old versions stay readable; nothing is overwritten, and a failed attempt leaves
files that no manifest names.

One writer at a time: two writers of the same version would fail on its manifest
(``errorifexists``), and the loser starts again from the newest one.

The manifest holds a row per day, which the driver reads to list folders; it grows with
the calendar, not with the events.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = ("meeting_date date, data_version long, attempt string, "
            "epoch long, seen_until timestamp_ntz")
DAY = "meeting_date"


@dataclass(frozen=True)
class Version:
    """A committed version: the folder of each day, and what its writer noted."""

    number: int
    days: dict              # day -> (data_version, attempt)
    epoch: int | None
    seen_until: object


class DayTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def newest(self, number: int | None = None) -> Version:
        """The newest version, or that of the given number; version 0 is the empty table."""
        try:
            found = self.spark.read.schema(MANIFEST + ", version long").parquet(f"{self.root}/_manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return Version(0, {}, None, None)
        if number is None:
            number = found.agg(F.max("version")).first()[0]
        rows = found.where(F.col("version") == F.lit(number)).collect() if number else []
        if not rows:
            return Version(0, {}, None, None)
        head = next(r for r in rows if r[DAY] is None)
        return Version(number, {r[DAY]: (r["data_version"], r["attempt"]) for r in rows if r[DAY] is not None},
                       head["epoch"], head["seen_until"])

    def _folder(self, version: int, attempt: str) -> str:
        return f"{self.root}/data/version={version}/attempt={attempt}"

    def prepare(self, rows: DataFrame, base: Version) -> tuple[int, str]:
        """Write the rows of a coming version's days; nobody sees them yet."""
        number, attempt = base.number + 1, uuid.uuid4().hex
        # A day's rows meet, so that it has few files; a large day is split again by its size.
        (rows.select(*self.schema.fieldNames()).hint("rebalance", DAY)
         .write.mode("errorifexists").partitionBy(DAY).parquet(self._folder(number, attempt)))
        return number, attempt

    def commit(self, base: Version, prepared: tuple[int, str], replaced, epoch: int | None = None, seen_until=None) -> Version:
        """Publish prepared days.  ``replaced``: the days whose old rows go, even where no
        new ones came; None for all."""
        number, attempt = prepared
        written = {r[0] for r in self.spark.read.schema(self.schema).parquet(self._folder(number, attempt)).select(DAY).distinct().collect()}
        gone = set(base.days) if replaced is None else set(replaced)
        days = {d: at for d, at in base.days.items() if d not in gone} | {d: (number, attempt) for d in written}
        rows = [(None, None, None, epoch, seen_until), *((d, v, a, epoch, seen_until) for d, (v, a) in sorted(days.items()))]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
         .write.mode("errorifexists").parquet(f"{self.root}/_manifests/version={number}"))
        return Version(number, days, epoch, seen_until)

    def replace(self, rows: DataFrame, replaced=None, **noted) -> Version:
        base = self.newest()
        return self.commit(base, self.prepare(rows, base), replaced, **noted)

    def read(self, first=None, last=None, version: int | None = None, days=None) -> DataFrame:
        """The rows of the days ``first..last`` (or of the set ``days``): no other folder is read."""
        now = self.newest(version)
        paths = [f"{self._folder(v, a)}/{DAY}={d.isoformat()}" for d, (v, a) in sorted(now.days.items())
                 if (first is None or d >= first) and (last is None or d <= last) and (days is None or d in days)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return (self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data")
                .parquet(*paths).select(*self.schema.fieldNames()))

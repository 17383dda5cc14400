"""Shared inputs of the registered queries: the domain views over one
test-data directory, with the event gate and the correction pipeline
applied once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import corrections as corr
from ..operators.gate import gate_active
from ..sources import views


class Inputs:
    """Lazily built DataFrames (logical plans only -- nothing is cached or
    collected).  Each query takes a new set, so that it sees the files there
    are when it is built."""

    def __init__(self, spark: SparkSession, sf_dir: str, days=None):
        self.spark, self.sf_dir, self.days = spark, sf_dir, days

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, days=None) -> "Inputs":
        """``days``: (first, last) where a query asks for sessions of these days only, so
        that every reading of the events is cut to them."""
        return cls(spark, sf_dir, days)

    @cached_property
    def students(self) -> DataFrame:
        return views.students(self.spark, self.sf_dir)

    @cached_property
    def raw_punches(self) -> DataFrame:
        return views.punches(self.spark, self.sf_dir)

    @cached_property
    def punches(self) -> DataFrame:
        """Punches of active students only (O-07)."""
        return gate_active(self.raw_punches, self.students)

    @cached_property
    def validated_corrections(self):
        return corr.validate_corrections(
            views.correction_requests(self.spark, self.sf_dir), self.students)

    @cached_property
    def decided_corrections(self):
        valid, _ = self.validated_corrections
        return corr.correction_decide(valid, views.correction_decisions(self.spark, self.sf_dir))

    @cached_property
    def corrections(self) -> DataFrame:
        return self.decided_corrections[0]

    @cached_property
    def set_events(self) -> DataFrame:
        """The events of approved corrections, from one reading of requests and decisions."""
        log = views.correction_log(self.spark, self.sf_dir, *(self.days or (None, None)))
        return corr.correction_apply(corr.settle_corrections(log, self.students))

    @cached_property
    def all_punches(self) -> DataFrame:
        """The full event log: gated punches plus applied corrections."""
        return self.punches.unionByName(self.set_events)

    @cached_property
    def tasks(self) -> DataFrame:
        return views.tasks(self.spark, self.sf_dir)

    @cached_property
    def assignments(self) -> DataFrame:
        return views.task_assignments(self.spark, self.sf_dir)

    @cached_property
    def comments(self) -> DataFrame:
        return views.task_comments(self.spark, self.sf_dir)

    @cached_property
    def task_events(self) -> DataFrame:
        return views.task_events(self.spark, self.sf_dir)

"""Display formatting in Eastern time (O-38n): dates MM/dd/yyyy, times
hh:mm a, NULL -> '' for dates and an em dash for times.  DATE columns are
formatted as they are and never pass through a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timez import eastern_wall

EM_DASH = "—"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt_date(d) -> Column:
    return F.coalesce(F.date_format(_c(d), "MM/dd/yyyy"), F.lit(""))


def fmt_time(ts_utc) -> Column:
    return F.coalesce(F.date_format(eastern_wall(_c(ts_utc)), "hh:mm a"), F.lit(EM_DASH))


def fmt_date_time(ts_utc) -> Column:
    return F.coalesce(F.date_format(eastern_wall(_c(ts_utc)), "MM/dd/yyyy, hh:mm a"),
                      F.lit(EM_DASH))

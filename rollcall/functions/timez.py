"""Time-zone handling (meeting days are calendar days in US Eastern time).

All instants are UTC ``timestamp_ntz`` values; conversions name both zones
explicitly, so the session time zone never matters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the team meets on US Eastern time.
EASTERN = "America/New_York"

AUTO_CLOSE_HOURS = 4       # fixed value: forgotten clock-outs close after 4 h
STALE_DAYS = 3             # fixed value: a task is stale after 3 quiet days


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eastern_wall(ts_utc) -> Column:
    """UTC instant -> Eastern wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), _c(ts_utc))


def eastern_date(ts_utc) -> Column:
    """UTC instant -> Eastern calendar date (the meeting day)."""
    return F.to_date(eastern_wall(ts_utc))


def local_to_utc(local_ntz) -> Column:
    """Eastern wall-clock time -> UTC instant.

    In the autumn overlap a wall time happens twice; like PostgreSQL's
    ``at time zone`` we take the later instant (standard time).  Spark's
    conversion returns the earlier one, so shift by an hour when the later
    instant maps back to the same wall time.  Spring-gap times already agree.
    """
    local = _c(local_ntz)
    first = F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), local)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), later) == local,
                  later).otherwise(first)


HHMM_RE = r"^[0-9]{2}:[0-9]{2}$"
ISO_DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def parse_iso_date(s) -> Column:
    """'YYYY-MM-DD' -> date; NULL unless the shape matches and the date exists."""
    s = _c(s)
    return F.when(s.rlike(ISO_DATE_RE), F.try_to_date(s, "yyyy-MM-dd"))


def hhmm_minutes(s) -> Column:
    """'HH:MM' -> minutes after midnight; NULL if malformed or out of range.

    PostgreSQL's ``time`` accepts 24:00 (the next midnight), so do we."""
    s = _c(s)
    hh = F.substring(s, 1, 2).try_cast("int")
    mm = F.substring(s, 4, 2).try_cast("int")
    ok = s.rlike(HHMM_RE) & (mm <= 59) & ((hh <= 23) | ((hh == 24) & (mm == 0)))
    return F.when(ok, hh * 60 + mm)


def local_date_time(date_col, hhmm) -> Column:
    """date + 'HH:MM' (Eastern wall clock) -> UTC instant, or NULL."""
    mins = hhmm_minutes(hhmm)
    local = F.to_timestamp_ntz(_c(date_col).cast("string")) + F.make_dt_interval(
        F.lit(0), F.lit(0), mins, F.lit(0))
    return F.when(mins.isNotNull() & _c(date_col).isNotNull(), local_to_utc(local))


def micros_between(start, end) -> Column:
    """Exact signed microseconds from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def ts_lit(value: dt.datetime | str) -> Column:
    """A ``timestamp_ntz`` literal (UTC instant)."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: dt.date | str) -> Column:
    return F.lit(as_date(value).isoformat()).cast("date")


def as_datetime(value: dt.datetime | str) -> dt.datetime:
    return dt.datetime.fromisoformat(value) if isinstance(value, str) else value


def as_date(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def eastern_date_of(instant: dt.datetime | str) -> dt.date:
    """Driver-side: the Eastern date of a UTC instant (for parameters only)."""
    from zoneinfo import ZoneInfo
    inst = as_datetime(instant).replace(tzinfo=dt.timezone.utc)
    return inst.astimezone(ZoneInfo(EASTERN)).date()


def eastern_day_bounds_utc(first: dt.date, last: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """Driver-side: [start, end) in UTC covering Eastern days first..last.

    Used to turn a meeting-date range into a range on the raw ``at`` column,
    which Parquet can prune on."""
    from zoneinfo import ZoneInfo
    tz = ZoneInfo(EASTERN)
    lo = dt.datetime.combine(first, dt.time(0, 0), tz).astimezone(dt.timezone.utc)
    hi = dt.datetime.combine(last + dt.timedelta(days=1), dt.time(0, 0), tz).astimezone(dt.timezone.utc)
    return lo.replace(tzinfo=None), hi.replace(tzinfo=None)

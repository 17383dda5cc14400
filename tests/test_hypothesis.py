"""Hypothesis properties for the parsing and time helpers, checked in
batches (one Spark job per generated list) against Python references."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.functions import timez as tz

NY = ZoneInfo("America/New_York")

clockish = st.one_of(
    st.builds(lambda h, m: f"{h:02d}:{m:02d}", st.integers(0, 30), st.integers(0, 99)),
    st.text(alphabet="0123456789:ap ", max_size=6))
dateish = st.one_of(
    st.builds(lambda y, m, d: f"{y:04d}-{m:02d}-{d:02d}", st.integers(1990, 2040),
              st.integers(0, 13), st.integers(0, 32)),
    st.text(alphabet="0123456789-", max_size=11))


def py_minutes(s):
    if s is None or not re.fullmatch(r"[0-9]{2}:[0-9]{2}", s):
        return None
    h, m = int(s[:2]), int(s[3:])
    if m > 59 or h > 24 or (h == 24 and m != 0):
        return None
    return h * 60 + m


def py_date(s):
    if s is None or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s):
        return None
    try:
        return dt.date.fromisoformat(s)
    except ValueError:
        return None


@settings(max_examples=5, deadline=None)
@given(st.lists(clockish, min_size=1, max_size=60))
def test_hhmm_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(tz.hhmm_minutes("v")).collect()]
    assert got == [py_minutes(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(dateish, min_size=1, max_size=60))
def test_iso_date_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(tz.parse_iso_date("v")).collect()]
    assert got == [py_date(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(min_value=dt.datetime(2000, 1, 1),
                             max_value=dt.datetime(2040, 12, 31)), min_size=1, max_size=60))
def test_local_to_utc_matches_zoneinfo(spark, values):
    """Wall time -> instant; ambiguous times take the later (standard) one."""
    values = [v.replace(microsecond=0) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")
    got = [r[0] for r in df.select(tz.local_to_utc("t")).collect()]
    want = []
    for v in values:
        inst = v.replace(tzinfo=NY, fold=1).astimezone(dt.timezone.utc).replace(tzinfo=None)
        want.append(inst)
    # nonexistent (spring-gap) wall times are not compared: engines differ in convention
    for v, g, w in zip(values, got, want):
        back = w.replace(tzinfo=dt.timezone.utc).astimezone(NY).replace(tzinfo=None)
        if back == v:
            assert g == w, (v, g, w)

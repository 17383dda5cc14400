"""Scalar helpers (O-38): JavaScript-style trim and blanks, labels, Eastern
display formats, HH:MM / date parsing."""

import datetime as dt

from rollcall.functions import format as fm
from rollcall.functions import text as tx
from rollcall.functions import timez as tz


def one(spark, col, schema, value):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).collect()[0]["x"]


def test_js_trim_and_blanks(spark):
    s = " \t x y 　\n﻿"
    assert one(spark, tx.js_trim("v"), "v string", s) == "x y"
    assert one(spark, tx.is_blank("v"), "v string", "   ") is True
    assert one(spark, tx.is_blank("v"), "v string", None) is True
    assert one(spark, tx.blank_to_null("v"), "v string", "") is None
    assert one(spark, tx.blank_to_null("v"), "v string", " ") == " "


def test_labels(spark):
    df = spark.createDataFrame([("Ada", "Build", "Arm", "in_progress"), ("Bo", "", "Leg", "todo")],
                               "n string, s string, t string, st string")
    rows = df.select(tx.name_with_subteam("n", "s").alias("a"),
                     tx.task_label("s", "t", "st").alias("b")).collect()
    assert [r["a"] for r in rows] == ["Ada (Build)", "Bo"]
    assert rows[0]["b"] == "[Build] Arm (in progress)"


def test_eastern_display_formats(spark):
    schema = "t timestamp_ntz, d date"
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10, 23, 5), dt.date(2024, 1, 9)),
                                (dt.datetime(2024, 7, 1, 16, 30), None), (None, None)], schema)
    rows = df.select(fm.fmt_time("t").alias("a"), fm.fmt_date("d").alias("b"),
                     fm.fmt_date_time("t").alias("c")).collect()
    assert [r["a"] for r in rows] == ["06:05 PM", "12:30 PM", "—"]
    assert [r["b"] for r in rows] == ["01/09/2024", "", ""]
    assert rows[0]["c"] == "01/10/2024, 06:05 PM" and rows[2]["c"] == "—"


def test_hhmm_and_date_parsing(spark):
    vals = ["00:00", "23:59", "24:00", "24:01", "12:60", "7:30", "ab:cd", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tz.hhmm_minutes("v")).collect()]
    assert got == [0, 1439, 1440, None, None, None, None, None]
    dates = ["2024-02-29", "2023-02-29", "2024-13-01", "2024-1-01", None]
    df = spark.createDataFrame([(v,) for v in dates], "v string")
    got = [r[0] for r in df.select(tz.parse_iso_date("v")).collect()]
    assert got == [dt.date(2024, 2, 29), None, None, None, None]


def test_local_date_time_handles_24_00(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10), "24:00")], "d date, t string")
    got = df.select(tz.local_date_time("d", "t")).collect()[0][0]
    assert got == dt.datetime(2024, 1, 11, 5, 0)

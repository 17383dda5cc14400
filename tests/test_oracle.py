"""Every registered query against its DuckDB oracle at sf0.001."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from rollcall.plans import catalog

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
from check_oracle import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["student_id", "full_name", "subteam", "days_clocked_in", "last_day",
                          "hours_total"]


def test_every_query_has_an_oracle():
    missing = set(catalog.queries()) - set(catalog.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollcall import schemas  # noqa: E402
from rollcall.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app_name="rollcall-tests")
    yield s


def T(s: str) -> dt.datetime:
    """UTC instant from 'YYYY-MM-DD HH:MM[:SS]'."""
    return dt.datetime.fromisoformat(s)


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def punches_df(spark, rows):
    """rows: dicts with student_id, at, seq, kind and optional payload."""
    full = []
    for r in rows:
        full.append(tuple(r.get(f.name) for f in schemas.PUNCHES.fields))
    return spark.createDataFrame(full, schemas.PUNCHES)


def students_df(spark, rows):
    """rows: (student_id, full_name, subteam, is_active)."""
    return spark.createDataFrame(
        [(i, n, s, a, dt.datetime(2023, 9, 1)) for i, n, s, a in rows], schemas.STUDENTS)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}

import math
import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from wattline.schema import READINGS  # noqa: E402
from wattline.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test data")
    return TESTDATA


def golden_rows():
    """A month of two meters without noise: a commercial profile and a flat one, both with spikes."""
    # Hourly levels, weekend factor, days, hours and height of the spikes.
    rows = []
    for n in range(720):
        ts = datetime(2026, 1, 1) + timedelta(hours=n)
        hour = ts.hour
        base = 100 if hour < 6 else 300 if hour < 9 else 350 if hour < 18 else 200 if hour < 23 else 150
        spike = ts.day in (12, 22) and 9 <= hour <= 11
        rows.append(("1", ts, base * (0.65 if ts.weekday() > 4 else 1.0) + (80 if spike else 0)))
        rows.append(("2", ts, 300.0 + (30 if spike else 0)))
    return rows


def temperature(t):
    return 5 + 10 * math.sin(2 * math.pi * t / 24 - 2 * math.pi * 15 / 24)


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(golden_rows(), READINGS).cache()


@pytest.fixture(scope="session")
def make(spark):
    """Readings from (meter, hours after 2026-01-01 or None, value) rows."""

    def build(rows):
        start = datetime(2026, 1, 1)
        return spark.createDataFrame(
            [
                (m, None if h is None else start + timedelta(hours=h), None if v is None else float(v))
                for m, h, v in rows
            ],
            READINGS,
        )

    return build


def rows_of(df, *order, digits=6):
    """Rows as tuples, doubles rounded, sorted by `order` (default: all columns)."""
    out = [
        tuple(round(x, digits) + 0.0 if isinstance(x, float) else x for x in row)
        for row in df.select(*sorted(df.columns)).collect()
    ]
    return sorted(out, key=repr)

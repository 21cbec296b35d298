import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sunweave.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Telemetry with a hot site (three quarters of the rows), ties in time and NULLs."""
    start = datetime(2024, 3, 1)
    rows = []
    for i in range(400):
        site = "site_a" if i % 4 else "site_b"
        ts = start + timedelta(minutes=(i // 2) * 3)
        value = None if i % 7 == 0 else float((i * 37) % 101)
        rows.append((site, ts, i, value, float(i % 13), None if i % 11 == 0 else float((i * 53) % 997)))
    return spark.createDataFrame(
        rows, "site string, ts timestamp_ntz, row_id long, irr_horiz double, wind_speed double, target double"
    )


def rows_of(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r)) if not order else out

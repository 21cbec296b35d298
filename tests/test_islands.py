"""Islands between gaps: both layouts, block borders, and operators that stop at breaks."""

from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sunweave.operators import islands
from sunweave.operators.ordered import index_rows

GAP = "30 minutes"


@pytest.fixture(scope="module")
def gappy(spark):
    """Breaks of just the limit and beyond, on block borders of 10 and inside, and NULL times."""
    rows, ts = [], datetime(2024, 5, 1)
    steps = [15, 15, 30, 31, 15] * 3 + [15] * 14 + [120, 15, 15, 45, 15] + [15] * 26 + [31]
    for i, step in enumerate([0, *steps]):
        ts += timedelta(minutes=step)
        known = None if i in (12, 19, 20, 40) else ts
        rows.append(("a", known, i, float(i), None if i % 4 == 1 else float(i * 2)))
    rows += [("b", datetime(2024, 1, 1) + timedelta(days=i), i, float(i), 1.0) for i in range(5)] + [("c", None, 0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, idx long, irr_horiz double, target double").repartition(3)


def by_hand(rows):
    out = {}
    for site in {r.site for r in rows}:
        last, island, spot = None, 0, -1
        for r in sorted((r for r in rows if r.site == site), key=lambda r: r.idx):
            new = r.ts is not None and last is not None and r.ts - last > timedelta(minutes=30)
            island, spot = (island + 1, 0) if new else (island, spot + 1)
            last = r.ts or last
            out[site, r.idx] = (island, spot)
    return out


@pytest.mark.parametrize("layout", [{"bounded": True}, {"block_rows": 10}, {"block_rows": 7}, {}])
def test_islands_by_hand(gappy, layout):
    got = {(r.site, r.idx): (r.island, r.spot) for r in islands.mark_islands(gappy, GAP, **layout).collect()}
    want = by_hand(gappy.collect())
    assert got == want and len({i for i, _ in want.values()}) > 5


def test_features_fills_and_windows_stay_inside(gappy):
    for bounded in (False, True):
        marked = islands.mark_islands(gappy, GAP, bounded=bounded)
        rows = islands.island_features(marked, 40.0, lags=(1, 2), windows=(3,), bounded=bounded).collect()
        where = by_hand(gappy.collect())
        assert rows and all(where[r.site, r.idx][1] >= 2 and r.irr_horiz_lag2 == r.irr_horiz - 2 and r.irr_horiz_roll3_mean == r.irr_horiz - 1 for r in rows)
        assert len(rows) == sum(spot >= 2 for _, spot in where.values())
        filled = {(r.site, r.idx): r.target for r in islands.fill_within_islands(marked, 4, columns=["target"], bounded=bounded).collect()}
        for (site, i), (_, spot) in where.items():
            if site == "a" and i % 4 == 1:
                assert filled.get((site, i)) == (None if spot == 0 else 2.0 * (i - 1))
        seqs = islands.island_sequences(marked, ["irr_horiz"], "target", 3, keep=(), bounded=bounded).collect()
        assert len(seqs) == sum(spot >= 3 for _, spot in where.values())


def test_without_breaks_it_is_the_series(gappy):
    wide = islands.mark_islands(gappy, "400 days")
    assert wide.where("island <> 0 or spot <> idx").count() == 0
    assert islands.mark_islands(gappy.where("false"), GAP).count() == 0
    again = index_rows(wide.drop("idx").withColumn("row_id", F.col("irr_horiz")), order=("row_id",), bounded=True)
    assert rows_of(again.select("site", "idx")) == rows_of(wide.select("site", "spot"))

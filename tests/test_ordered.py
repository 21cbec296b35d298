import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sunweave.operators.features import add_lag_features, add_rolling_features, drop_warm_up, engineer_features
from sunweave.operators.ordered import index_rows, look_back, position_slice, reindex_rows
from sunweave.operators.sequences import build_sequences
from sunweave.operators.split import split_chronological


def with_plain_index(df):
    plain = Window.partitionBy("site").orderBy("ts", "row_id")
    return df.withColumn("idx", (F.row_number().over(plain) - 1).cast("bigint"))


def test_range_index_equals_plain(spark, series):
    assert rows_of(index_rows(series)) == rows_of(with_plain_index(series))


def test_index_of_empty_frame(spark, series):
    assert index_rows(series.where("false")).count() == 0


def test_reindex_after_drop(spark, series):
    kept = index_rows(series).where("row_id % 3 <> 1 and (site <> 'site_a' or idx > 40)")
    got = reindex_rows(kept, block_rows=16)
    want = with_plain_index(kept.drop("idx"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("block_rows", [8, 13, 10_000])
def test_blocks_equal_plain_windows(spark, series, block_rows):
    df = with_plain_index(series)
    got = add_rolling_features(
        add_lag_features(df, ["target"], block_rows=block_rows), ["irr_horiz"], block_rows=block_rows
    )
    want = add_rolling_features(add_lag_features(df, ["target"], bounded=True), ["irr_horiz"], bounded=True)
    assert rows_of(got) == rows_of(want.select(got.columns))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(reach=st.integers(1, 9), block=st.integers(9, 40), n=st.integers(1, 60))
def test_any_block_size(spark, reach, block, n):
    df = spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("idx"), (F.col("id") * 7 % 11).alias("v"))
    build = lambda w: {"total": F.sum("v").over(w.rowsBetween(-reach, 0)), "back": F.lag("v", reach).over(w)}
    got = look_back(df, reach, build, block_rows=block).orderBy("idx").collect()
    values = [i * 7 % 11 for i in range(n)]
    assert [r["total"] for r in got] == [sum(values[max(0, i - reach):i + 1]) for i in range(n)]
    assert [r["back"] for r in got] == [values[i - reach] if i >= reach else None for i in range(n)]


def test_look_back_guards(spark, series):
    with pytest.raises(ValueError, match="index_rows"):
        add_lag_features(series, ["target"])
    with pytest.raises(ValueError, match="exceeds"):
        add_lag_features(with_plain_index(series), ["target"], block_rows=4)


def test_rolling_edges(spark, series):
    one = with_plain_index(series.where("row_id = 1"))
    row = add_rolling_features(one, ["wind_speed"], windows=[4]).first()
    assert (row["wind_speed_roll4_mean"], row["wind_speed_roll4_std"]) == (1.0, 0.0)
    gone = one.withColumn("wind_speed", F.lit(None).cast("double"))
    row = add_rolling_features(gone, ["wind_speed"], windows=[4]).first()
    assert (row["wind_speed_roll4_mean"], row["wind_speed_roll4_std"]) == (None, 0.0)


def test_warm_up(spark, series):
    got = drop_warm_up(with_plain_index(series), 8)
    assert got.groupBy("site").agg(F.min("idx"), F.count("*")).where("site = 'site_b'").first()[1:] == (0, 92)
    assert position_slice(got, 0, 5).count() == 10


def test_features_do_not_see_the_future(spark, series):
    """Changing everything after a position leaves the features up to it unchanged."""
    df = with_plain_index(series)
    late = F.col("idx") > 60
    spoilt = df.withColumns({c: F.when(late, F.lit(1e6)).otherwise(F.col(c)) for c in ("irr_horiz", "target")})
    a, b = (
        engineer_features(x, latitude=40.0, block_rows=20).where("idx <= 52").drop("target", "irr_horiz")
        for x in (df, spoilt)
    )
    assert rows_of(a) == rows_of(b)


def test_split_sizes(spark):
    for n, want in ((20, (14, 3, 3)), (7, (4, 1, 2)), (1, (0, 0, 1))):
        df = spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("idx"), F.col("id").alias("ts"))
        for bounded in (True, False):
            parts = split_chronological(df, bounded=bounded)
            sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
            assert tuple(sizes.get(p, 0) for p in ("train", "val", "test")) == want
            order = parts.orderBy("idx").select("split").collect()
            assert [r[0] for r in order] == ["train"] * want[0] + ["val"] * want[1] + ["test"] * want[2]


def test_splits_are_per_series(spark, series):
    parts = split_chronological(with_plain_index(series))
    sizes = {(r["site"], r["split"]): r["count"] for r in parts.groupBy("site", "split").count().collect()}
    assert sizes[("site_a", "train")] == 210 and sizes[("site_b", "train")] == 70


@pytest.mark.parametrize("n,outputs", [(16, 0), (17, 1), (20, 4)])
def test_sequence_counts(spark, n, outputs):
    df = spark.range(n).select(
        F.lit("s").alias("site"), F.lit("train").alias("split"), F.col("id").alias("pos"), F.lit(0).alias("ts"),
        F.col("id").cast("double").alias("x"), (F.col("id") * 10).cast("double").alias("y"),
    )
    for layout in ({"block_rows": 16}, {}):
        got = build_sequences(df, ["x", "y"], "y", **layout).orderBy("pos").collect()
        assert len(got) == outputs
        for r in got:
            assert [s[0] for s in r["seq"]] == [float(i) for i in range(r["pos"] - 16, r["pos"])]
            assert r["y"] == r["pos"] * 10


def test_horizon_moves_the_window_back(spark):
    df = spark.range(10).select(
        F.lit("s").alias("site"), F.lit("t").alias("split"), F.col("id").alias("pos"), F.lit(0).alias("ts"),
        F.col("id").cast("double").alias("x"),
    )
    got = build_sequences(df, ["x"], "x", lookback=3, horizon=4).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [6, 7, 8, 9]
    assert [s[0] for s in got[0]["seq"]] == [0.0, 1.0, 2.0]


def test_sequences_do_not_cross_splits(spark, series):
    parts = split_chronological(with_plain_index(series))
    placed = index_rows(parts.drop("idx"), ("site", "split"), name="pos")
    seqs = build_sequences(placed, ["wind_speed"], "wind_speed")
    sizes = {(r["site"], r["split"]): r["count"] for r in placed.groupBy("site", "split").count().collect()}
    got = {(r["site"], r["split"]): r["count"] for r in seqs.groupBy("site", "split").count().collect()}
    assert got == {k: n - 16 for k, n in sizes.items() if n > 16}


def test_no_single_task_over_rows(spark, series):
    """Blocks and range index never gather all rows; only the block counts are summed per site."""
    df = add_lag_features(index_rows(series), ["target"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "hashpartitioning(site" in plan and "_block" in plan

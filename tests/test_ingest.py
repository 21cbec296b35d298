from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sunweave import sources
from sunweave.functions import parse_day_hour
from sunweave.schema import SITE_A_COLUMNS, column_map, get_site
from sunweave.session import staging_path
from sunweave.sources.site_csv import read_raw_csv


def parsed(spark, day, hour):
    df = spark.createDataFrame([(day, hour)], "d int, h string")
    return df.select(parse_day_hour(F.col("d"), F.col("h"))).first()[0]


@pytest.mark.parametrize("day,hour,expected", [
    (2024366, "00:00:00", datetime(2024, 12, 31)),
    (2023366, "00:00:00", None),
    (2022216, "13:45:00", datetime(2022, 8, 4, 13, 45)),
    (2022001, "9:05:00", datetime(2022, 1, 1, 9, 5)),
    (2022001, "25:00:00", None),
    (2022001, "nonsense", None),
    (None, "10:00:00", None),
    (2022001, None, None),
])
def test_day_hour(spark, day, hour, expected):
    assert parsed(spark, day, hour) == expected


def test_sentinels_and_nan_become_null(spark):
    df = spark.createDataFrame(
        [(1, 32767.0, 5), (2, 32766.0, -99), (3, -99.0, 32767), (4, float("nan"), 7), (5, 1.5, 8)],
        "row_id long, a double, b int",
    )
    got = [(r["a"], r["b"]) for r in sources.replace_sentinels(df).orderBy("row_id").collect()]
    assert got == [(None, 5), (None, None), (None, None), (None, 7), (1.5, 8)]


def write_site_csv(spark, text):
    path = staging_path(spark, "csv")
    spark.createDataFrame([(line,) for line in text.strip().split("\n")], "line string").coalesce(1).write.text(path)
    return path


CSV = """
,DAY,HOUR,FPHIRR,FAMBTM,EXTRA,INVPWR
0,2024001,08:00:00,100.5,20,x,500
1,2024001,08:01:00,32767,21,y,-99
2,2023366,08:02:00,1,1,z,1
"""


def test_site_csv(spark):
    path = write_site_csv(spark, CSV)
    rows = sources.load_site_csv(spark, "site_b", path).orderBy("row_id").collect()
    assert [(r["row_id"], r["site"], r["FPHIRR"], r["INVPWR"]) for r in rows] == [
        (0, "site_b", 100.5, 500.0), (1, "site_b", None, None),
    ]
    std = sources.load_and_standardise(spark, "site_b", path)
    assert std.columns == ["site", "ts", "row_id", "irr_horiz", "amb_temp", "target"]
    assert read_raw_csv(spark, "site_b", path).count() == 3


def test_files_of_a_folder_may_order_their_columns_differently(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",DAY,HOUR,INVPWR,FPHIRR,EXTRA,NOTE\n0,2024001,08:00:00,6000,110,32767,7\n")
    (tmp_path / "b.csv").write_text(",DAY,HOUR,FPHIRR,INVPWR,EXTRA,NOTE\n1,2024001,08:01:00,120,6100,3.5,x\n")
    rows = sources.load_and_standardise(spark, "site_b", str(tmp_path)).orderBy("row_id").collect()
    assert [(r["irr_horiz"], r["target"]) for r in rows] == [(110.0, 6000.0), (120.0, 6100.0)]
    light = sources.light_load(read_raw_csv(spark, "site_b", str(tmp_path)))
    assert {r["row_id"]: r["EXTRA"] for r in light.collect()} == {0: None, 1: 3.5} and "NOTE" not in light.columns


def test_missing_file_and_unknown_site(spark):
    with pytest.raises(FileNotFoundError, match="site_a"):
        sources.load_site_csv(spark, "site_a", "/nonexistent/file.csv")
    with pytest.raises(KeyError, match="unknown site"):
        get_site("elsewhere")


def test_column_map_is_a_copy():
    column_map("site_a")["irr_horiz"] = "other"
    assert column_map("site_a") == SITE_A_COLUMNS


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([("a", 1.0)], "site string, rain double")
    b = spark.createDataFrame([("b",)], "site string")
    assert {(r["site"], r["rain"]) for r in sources.union_sites([a, b]).collect()} == {("a", 1.0), ("b", None)}


def test_light_load_keeps_usable_targets(spark):
    path = write_site_csv(spark, CSV)
    raw = read_raw_csv(spark, "site_b", path)
    out = sources.light_load(raw)
    assert out.columns == ["ts", "row_id", "FPHIRR", "FAMBTM", "INVPWR"]
    assert [r["row_id"] for r in out.collect()] == [0]


def test_absent_result_raises(spark):
    with pytest.raises(FileNotFoundError):
        sources.read_result(spark, "/nonexistent/metrics", "label string")


def test_parquet_sink_prunes_sites(spark, series):
    path = staging_path(spark, "sink")
    sources.write_site_parquet(series, path)
    one = spark.read.parquet(path).where("site = 'site_b'")
    assert "PartitionFilters: [isnotnull(site" in one._jdf.queryExecution().toString()
    assert one.count() == series.where("site = 'site_b'").count()

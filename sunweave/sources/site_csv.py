"""Raw site files to standardised telemetry."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunweave.functions import null_if_sentinel, numeric_columns, parse_day_hour
from sunweave.schema import SENTINELS, get_site


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of ``path`` by their header line; only first lines are read, several files at a time."""
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda f: tuple(spark.read.option("header", True).csv(f).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, found):
        groups.setdefault(header, []).append(file)
    return groups


def _other_types(spark: SparkSession, files: list[str], names: list[str]) -> dict[str, T.DataType]:
    """Types of columns outside the site's map: DOUBLE if every value in all files is a number, else STRING."""
    if not names:
        return {}
    guessed = spark.read.option("header", True).option("inferSchema", True).csv(files).schema
    return {
        f.name: T.DoubleType() if isinstance(f.dataType, T.NumericType) else T.StringType()
        for f in guessed.fields if f.name in names
    }


def read_raw_csv(spark: SparkSession, site: str, path: str) -> DataFrame:
    """Header CSV with the site's explicit schema; column 0 is the writer's row index.

    Files of a folder may order their columns differently or lack some: those with one header are
    read together by that header, then stacked by name. Numeric columns outside the site's map stay
    numeric, which takes a pass over their files to see.
    """
    known = {f.name: f.dataType for f in get_site(site).raw_schema().fields}
    try:
        groups = headers(spark, path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(f"no raw file for {site!r} at {path}") from err
        raise
    types: dict[str, T.DataType] = {}
    for header, files in groups.items():
        for name, kind in _other_types(spark, files, [n for n in header[1:] if n not in known]).items():
            types[name] = kind if types.get(name, kind) == kind else T.StringType()
    frames = []
    for header, files in groups.items():
        schema = T.StructType([
            T.StructField(name, T.LongType() if i == 0 else known.get(name) or types[name]) for i, name in enumerate(header)
        ])
        raw = spark.read.option("header", True).schema(schema).csv(files)
        frames.append(raw.withColumnRenamed(header[0], "row_id"))
    return union_sites(frames)


def replace_sentinels(df: DataFrame, sentinels=SENTINELS, skip=("row_id", "idx")) -> DataFrame:
    """Fill codes become NULL in every numeric column, in one projection."""
    numeric = set(numeric_columns(df, skip))
    return df.select(*[
        null_if_sentinel(f.name, f.dataType, sentinels) if f.name in numeric else F.col(f.name)
        for f in df.schema.fields
    ])


def add_timestamp(df: DataFrame, day: str = "DAY", hour: str = "HOUR") -> DataFrame:
    """Build ``ts``, drop its two sources and the rows where it cannot be built."""
    stamped = df.withColumn("ts", parse_day_hour(F.col(day), F.col(hour)))
    return stamped.drop(day, hour).where(F.col("ts").isNotNull())


def prepare_raw(df: DataFrame, site: str) -> DataFrame:
    """Sentinels, timestamp and site label of one raw frame."""
    get_site(site)
    return df.transform(replace_sentinels).transform(add_timestamp).withColumn("site", F.lit(site))


def load_site_csv(spark: SparkSession, site: str, path: str) -> DataFrame:
    """One site's CSV, cleaned of fill codes, stamped and labelled."""
    return prepare_raw(read_raw_csv(spark, site, path), site)


def rename_to_standard(df: DataFrame, site: str) -> DataFrame:
    """Only the mapped columns that exist, under their standard names, with the keys."""
    present = set(df.columns)
    mapped = [F.col(raw).alias(std) for std, raw in get_site(site).columns.items() if raw in present]
    return df.select("site", "ts", "row_id", *mapped)


def load_and_standardise(spark: SparkSession, site: str, path: str) -> DataFrame:
    return rename_to_standard(load_site_csv(spark, site, path), site)


def union_sites(frames: list[DataFrame]) -> DataFrame:
    """Stack sites; a column one site lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_report(df: DataFrame, by=("site",)) -> DataFrame:
    """Rows kept and first/last time."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def light_load(df: DataFrame, target: str = "INVPWR", sentinels=SENTINELS) -> DataFrame:
    """All numeric raw columns under raw names, rows with a usable target only."""
    stamped = df.transform(lambda d: replace_sentinels(d, sentinels)).transform(add_timestamp)
    keys = [c for c in ("site", "ts", "row_id") if c in stamped.columns]
    return stamped.select(*keys, *numeric_columns(stamped)).where(
        (F.col(target) >= 0) & (F.col(target) != 32767.0)
    )


def raw_head(df: DataFrame, rows: int = 5, order: str = "row_id") -> DataFrame:
    """The first rows as they are, each with the frame's column count."""
    return df.orderBy(order).limit(rows).withColumn("n_columns", F.lit(len(df.columns)))


def raw_peek(df: DataFrame, rows: int = 200, order: str = "row_id") -> DataFrame:
    """NULLs per column among the first rows, before fill codes are removed."""
    head = df.orderBy(order).limit(rows)
    cols = [c for c in df.columns if c != order]
    counts = head.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "n_null")



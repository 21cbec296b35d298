"""Ordered operators that stop at breaks in time (Q6 for D02-D07 and P04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunweave.catalog.base import LAGGED, LATITUDE, ROLLED, SQL_CLEAN, clean_layout, query, rs, sql_clearness, sql_fill, sql_lags, sql_rolls, with_
from sunweave.catalog.order import RAW_ORDER, SQL_INDEXED, indexed
from sunweave.operators import islands as ops

GAP = "2 hours"
FILLED = ["irr_horiz", "amb_temp", "target"]


def _sql_islands(rows: str, gap: str) -> str:
    return f""",
steps AS (SELECT *, ts > lag(ts) OVER (PARTITION BY site ORDER BY idx) + INTERVAL '{gap}' AS far FROM {rows}),
numbered AS (SELECT *, CAST(sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY idx) AS BIGINT) AS island FROM steps),
isles AS (SELECT *, row_number() OVER (PARTITION BY site, island ORDER BY idx) - 1 AS spot FROM numbered)"""


def _apart(sql: str) -> str:
    """The same windows, island by island."""
    return sql.replace("PARTITION BY site ", "PARTITION BY site, island ")


SQL_ISLANDS = SQL_INDEXED + _sql_islands("pos", GAP)


def _raw_islands(spark, sf_dir):
    return ops.mark_islands(indexed(spark, sf_dir), GAP)


@query("d01_gap_islands", with_(SQL_ISLANDS, "SELECT site, row_id, idx, island, spot FROM isles"))
def gap_islands(spark, sf_dir):
    """Island and position in it of every reading at raw cadence."""
    return _raw_islands(spark, sf_dir).select("site", "row_id", "idx", "island", "spot")


@query("d06_features_in_islands", with_(SQL_ISLANDS + f""",
f AS (SELECT *, {sql_clearness()} AS clearness_index,
  {_apart(sql_lags(['irr_horiz', 'target'], order=RAW_ORDER))}, {_apart(sql_rolls('irr_horiz', order=RAW_ORDER))} FROM isles)""", f"""
SELECT site, row_id, island, spot, {rs(['clearness_index', *LAGGED, *ROLLED])} FROM f WHERE spot >= 8"""))
def features_in_islands(spark, sf_dir):
    """Lags and rolling values that do not read across a break."""
    rows = ops.island_features(_raw_islands(spark, sf_dir), LATITUDE)
    return rows.select("site", "row_id", "island", "spot", "clearness_index", *LAGGED, *ROLLED)


@query("p04_fill_in_islands", with_(SQL_ISLANDS + f""",
f AS (SELECT site, row_id, island, {', '.join(_apart(sql_fill(c, RAW_ORDER)) for c in FILLED)} FROM isles)""", f"""
SELECT site, row_id, island, {rs(FILLED)} FROM f WHERE target IS NOT NULL"""))
def fill_in_islands(spark, sf_dir):
    """Gaps in a sensor are filled from its own island only."""
    rows = ops.fill_within_islands(_raw_islands(spark, sf_dir), columns=FILLED)
    return rows.select("site", "row_id", "island", *FILLED)


@query("d07_sequences_in_islands", with_(SQL_CLEAN + _sql_islands("indexed", GAP) + """,
s AS (SELECT site, island, spot, ts, target AS y, count(*) OVER h AS n_steps, first_value(target) OVER h AS oldest, last_value(irr_horiz) OVER h AS newest
  FROM isles WINDOW h AS (PARTITION BY site, island ORDER BY spot ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""", f"""
SELECT site, island, spot, ts, n_steps, {rs(['y', 'oldest', 'newest'])} FROM s WHERE spot >= 4"""))
def sequences_in_islands(spark, sf_dir):
    """Windows of four cleaned bins with no night or longer break in between."""
    rows, bounded = clean_layout(spark, sf_dir)
    rows = ops.mark_islands(rows.select("site", "ts", "idx", "target", "irr_horiz"), GAP, bounded=bounded)
    seqs = ops.island_sequences(rows, ["target", "irr_horiz"], "target", 4, bounded=bounded)
    return seqs.select(
        "site", "island", "spot", "ts", F.size("seq").cast("long").alias("n_steps"), "y", F.col("seq")[0][0].alias("oldest"),
        F.element_at("seq", -1)[1].alias("newest"),
    )

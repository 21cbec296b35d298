"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores. Each query is built and fully executed twice; the better time counts, so that JVM and
code-generation warm-up is left out. Queries that train large models run once.
"""

from __future__ import annotations

import json
import os
import re
import time

from sunweave.catalog import QUERIES
from sunweave.session import build_session

HEADLINE = [
    "daytime_power_profile",
    "s12_load_and_standardise",
    "c01_resample_15min",
    "c06_describe_lineitem",
    "c08_correlations",
    "c11_histogram_price",
    "c12_monthly_box",
    "c13_best_day",
    "p04_fill_gaps",
    "p06_clean",
    "d01_row_index",
    "d06_features",
    "d06_features_raw_cadence",
    "d07_sequences",
    "d08_split",
    "f02_apply_scaler",
    "j01_prepare_cli13",
    "m01_ridge",
    "m13_flat_window",
    "e07_metrics",
    "e14_seasonal_metrics",
    "e17_prediction_band",
    "e21_classification_report",
]
# Dear ones run once, after the others.
ONCE = [
    "m03_forest",
    "m04_boosted",
    "m14_conv_window",
    "m15_recurrent_window",
    "m16_conv_recurrent_window",
    "e16_training_length",
    "j06_analysis_tables",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINE + ONCE:
        runs = []
        for _ in range(1 if name in ONCE else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total of best-of-two wall times (dear ones once)",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Command line of the training job (J04): ``spark-submit -m sunweave.plans.job --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from sunweave.models import loss_history
from sunweave.models.registry import MODELS, SEQUENCE, TABULAR
from sunweave.plans.prepare import PRESETS, prepare
from sunweave.plans.report import analysis_tables, write_tables
from sunweave.plans.train import compare, train_all
from sunweave.schema import SEED
from sunweave.session import build_session, stage
from sunweave.sources import load_and_standardise, write_csv_result

GROUPS = {"all": tuple(MODELS), "tabular": TABULAR, "sequence": SEQUENCE}


def parse_arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Train and compare solar power forecasters.")
    parser.add_argument("--site", required=True)
    parser.add_argument("--input", required=True, help="raw CSV of the site")
    parser.add_argument("--output", required=True, help="folder for models and tables")
    parser.add_argument("--latitude", type=float, required=True, help="site latitude in degrees")
    parser.add_argument("--models", nargs="+", default=["all"], help="model keys, or all, tabular, sequence")
    parser.add_argument("--preset", choices=PRESETS, default="documented")
    parser.add_argument("--seed", type=int, default=SEED)
    parser.add_argument("--trees", type=int, default=200, help="trees of the forest")
    parser.add_argument("--depth", type=int, default=12, help="depth limit of the forest, whose trees the driver holds (at most 30)")
    parser.add_argument("--rounds", type=int, default=300, help="most boosting rounds; patience on the validation rows stops earlier")
    parser.add_argument("--tables", action="store_true", help="also write the analysis tables")
    return parser.parse_args(argv)


def expand(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += GROUPS.get(name.strip().lower(), [name])
    return list(dict.fromkeys(out))


def main(argv=None) -> None:
    args = parse_arguments(argv)
    spark = build_session("sunweave-train")
    std = stage(load_and_standardise(spark, args.site, args.input), "std")
    bundle = prepare(std, preset=args.preset, latitude=args.latitude)
    params = {k: {"seed": args.seed} for k in ("rf", "gbt", "seq_conv", "seq_recurrent", "seq_conv_recurrent")}
    params["rf"] |= {"trees": args.trees, "depth": args.depth}
    params["gbt"] |= {"rounds": args.rounds}
    models, scored = train_all(bundle, expand(args.models), params)
    predictions = stage(scored, "predictions")
    for key, model in models.items():
        model.save(f"{args.output}/models/{key}")
    if bundle.audit:
        audit = spark.createDataFrame(bundle.audit.rows(), "stage string, n_rows long, n_null long")
        write_csv_result(audit.withColumn("dropped", F.lit(",".join(bundle.audit.dropped))), f"{args.output}/audit")
    bundle.scaler.save(spark, f"{args.output}/models/scaler")
    bundle.target_scaler.save(spark, f"{args.output}/models/target_scaler")
    write_csv_result(predictions, f"{args.output}/predictions")
    write_csv_result(compare(predictions), f"{args.output}/model_comparison")
    if "gbt" in models:
        write_csv_result(loss_history(models["gbt"], bundle.train, bundle.val), f"{args.output}/loss_history")
    if args.tables:
        write_tables(analysis_tables(std, args.site, predictions, bundle, models), f"{args.output}/tables")


if __name__ == "__main__":
    main()

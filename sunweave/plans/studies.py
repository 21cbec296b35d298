"""Computed studies: horizon, training length, model complexity."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunweave.functions import clamp_non_negative
from sunweave.models.base import Forecaster
from sunweave.models.registry import model_label
from sunweave.models.windows import WindowForecaster
from sunweave.operators.evaluate import metrics, persistence
from sunweave.operators.moments import Gram, grams
from sunweave.operators.ordered import series_lengths
from sunweave.plans.prepare import Bundle
from sunweave.plans.train import fit_sequence, score, score_horizons
from sunweave.schema import SEED
from sunweave.session import small_side

HORIZONS = (1, 2, 4, 8)


def persistence_horizons(df: DataFrame, horizons: Sequence[int] = HORIZONS, **layout) -> DataFrame:
    """Error of "the last known value" by steps ahead."""
    rows = persistence(df, horizons, **layout).withColumn(
        "horizon", F.regexp_extract("model", r"(\d+)$", 1).cast("int")
    )
    return metrics(rows.withColumn("model", F.lit("persistence")), ["model", "horizon"])


def learned_horizons(
    bundle: Bundle, name: str = "seq_flat", horizons: Sequence[int] = HORIZONS, **params
) -> DataFrame:
    """One sequence model per horizon: windows end ``h`` rows before the predicted row.

    Flat-window models of all horizons come from one scan of the training rows and one of the test rows.
    """
    models = fit_sequence(name, bundle, horizons=horizons, **params)
    return metrics(score_horizons(models, bundle.test, bundle), ["model", "horizon"], counts=True)


def hash_bucket(seed: int = SEED, keys: Sequence[str] = ("site", "ts")) -> Column:
    """A number from 0 to 999,999 by md5 of the row's key: the same on every run and in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 1_000_000


def hash_sample(df: DataFrame, fraction: float, seed: int = SEED, keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    """Keep the rows whose key hash falls below ``fraction``: the same rows on every run."""
    return df.where(hash_bucket(seed, keys) < int(fraction * 1_000_000))


def training_length(
    bundle: Bundle,
    ordered: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0),
    random: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5),
    alpha: float = 0.1,
    seed: int = SEED,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Test error of ridge after training on the oldest share or on a random share of the rows.

    Every row belongs to one cell: the shortest ordered share and the smallest random share that hold it. The Gram
    of each cell comes from one scan; a share is a sum of cells. All models score the test rows in one pass.
    """
    names = list(bundle.features if features is None else features)
    ordered, random = sorted(ordered), sorted(random)
    train = bundle.train.join(small_side(series_lengths(bundle.train)), "site")
    beyond = lambda value, limits: sum(((value >= limit).cast("int") for limit in limits), F.lit(0))
    late = beyond(F.col("pos"), [F.floor(F.col("n_rows") * F.lit(f)) for f in ordered])
    rare = beyond(hash_bucket(seed), [int(f * 1_000_000) for f in random])
    width = len(random) + 1
    cells = grams(train, names, bundle.target, late * width + rare)
    picks = [("ordered", f, [g for k, g in cells.items() if k // width <= i]) for i, f in enumerate(ordered)]
    picks += [("random", f, [g for k, g in cells.items() if k % width <= i]) for i, f in enumerate(random)]
    runs = []
    for selection, fraction, parts in picks:
        if not parts:
            raise ValueError(f"no training rows in the {selection} share {fraction}")
        gram = reduce(Gram.__add__, parts)
        weights, intercept = gram.ridge(alpha)
        value = sum((F.col(c) * float(w) for c, w in zip(names, weights)), F.lit(intercept))
        runs.append(F.struct(
            F.lit(selection).alias("selection"), F.lit(fraction).alias("fraction"), F.lit(int(gram.n)).alias("n_train"),
            clamp_non_negative(value).alias("predicted"),
        ))
    scored = bundle.test.select(F.lit(model_label("lr")).alias("model"), F.col(bundle.target).alias("actual"), F.inline(F.array(*runs)))
    return metrics(scored, ["model", "selection", "fraction", "n_train"], counts=True)


def model_size(model: Forecaster | WindowForecaster) -> int:
    """Coefficients of a linear model, nodes of a tree model."""
    if isinstance(model, WindowForecaster):
        return len(model.weights) + 1
    learner = model.learner
    if hasattr(learner, "totalNumNodes"):
        return int(learner.totalNumNodes)
    return int(learner.numFeatures) + 1


def complexity_table(models: dict[str, Forecaster | WindowForecaster], bundle: Bundle) -> DataFrame:
    """Measured fit time, size and scoring rate of each model on the test rows."""
    out = []
    for model in models.values():
        start = time.perf_counter()
        n, _ = score(model, bundle).agg(F.count("predicted"), F.sum("predicted")).first()
        spent = time.perf_counter() - start
        out.append((model.label, float(model.fit_seconds), model_size(model), n, n / spent))
    return bundle.rows.sparkSession.createDataFrame(
        out, "model string, fit_seconds double, size long, n_scored long, rows_per_second double"
    )


# Settings reported per learner, by the names Spark gives them.
REPORTED = (
    "regParam", "elasticNetParam", "solver", "numTrees", "maxIter", "maxDepth", "minInstancesPerNode",
    "stepSize", "subsamplingRate", "featureSubsetStrategy", "maxBins", "seed",
)


def fitted_parameters(models: dict[str, Forecaster | WindowForecaster]) -> DataFrame:
    """The settings each fitted model was trained with."""
    rows = []
    for model in models.values():
        if isinstance(model, WindowForecaster):
            settings = {"lookback": model.lookback, "horizon": model.horizon, "alpha": model.notes.get("alpha"), **model.shape}
            rows += [(model.label, k, str(v)) for k, v in settings.items()]
            continue
        learner = model.learner
        have = [p for p in REPORTED if learner.hasParam(p) and learner.isDefined(p)]
        rows += [(model.label, p, str(learner.getOrDefault(p))) for p in have]
    return SparkSession.active().createDataFrame(rows, "model string, hyperparameter string, value string")

"""Forecasters (M01-M16). Ridge with one feature has a closed form and so an SQL check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.catalog.base import LATITUDE, MODEL_FEATURES, SQL_METRICS, query, r, std, with_
from sunweave.catalog.scaling import SQL_ROWS, SQL_SCALED, usable_rows
from sunweave.models import (
    coefficients,
    feature_importance,
    fit_boosted,
    fit_forest,
    fit_ridge,
    imbalance,
    load_forecaster,
    loss_history,
)
from sunweave.plans import studies
from sunweave.plans.prepare import prepare
from sunweave.models.registry import MODELS, SEQUENCE, TABULAR, model_label
from sunweave.operators.evaluate import metrics
from sunweave.plans.train import fit_sequence, score_horizons, train_all, train_tabular
from sunweave.session import stage, staging_path

# The registered runs use the preset sizes (200 trees; up to 300 rounds with patience 20). The one bound
# is the forest's depth: trees are held by the driver, so their size must not grow with the data.
FOREST = {"depth": 12}
BOOSTED: dict = {}
SHAPE = {"filters": 64, "units": 64}

SQL_RIDGE = SQL_ROWS + """,
fit AS (SELECT w, my - w * mx AS b FROM (
  SELECT count(*) * covar_pop(target, irr_horiz) / (count(*) * var_pop(irr_horiz) + 0.1) AS w,
    avg(target) AS my, avg(irr_horiz) AS mx FROM usable WHERE split = 'train')),
scored AS (SELECT site, ts, target AS actual,
    CASE WHEN w * irr_horiz + b < 0 THEN 0 ELSE w * irr_horiz + b END AS predicted
  FROM usable JOIN fit ON true WHERE split = 'test')"""
SQL_RIDGE_ROWS = with_(SQL_RIDGE, f"SELECT site, ts, {r('actual', 'actual', 4)}, {r('predicted', 'predicted', 4)} FROM scored")


def _ridge(spark, sf_dir):
    rows = stage(usable_rows(spark, sf_dir), "split")
    return fit_ridge(rows.where("split = 'train'"), ["irr_horiz"]), rows.where("split = 'test'")


def _scores(model, rows):
    return model.predict(rows).select("site", "ts", F.col("target").alias("actual"), "predicted")


def bundle(spark, sf_dir):
    return prepare(std(spark, sf_dir), latitude=LATITUDE)


def skill(scored: DataFrame, data) -> DataFrame:
    """One row per model: scored test rows, the error of the training mean on them, and whether the model's is smaller."""
    mean = data.train.agg(F.avg(data.target)).first()[0]
    error = lambda p: F.sqrt(F.avg((F.col("actual") - p) ** 2))
    known = F.col("predicted").isNotNull() & ~F.isnan("predicted")
    return scored.groupBy("model").agg(
        F.count("*").alias("n_rows"), F.count_if(~known).alias("n_unscored"), error(F.lit(mean)).alias("mean_rmse"),
        (error(F.col("predicted")) < error(F.lit(mean))).alias("beats_mean"),
    )


def sql_skill(rows: str, late: dict[str, int], claimed=tuple(MODELS), order: str = "ts") -> str:
    """``late``: rows at the start of each site's test part that a model cannot score; ``claimed``: models that beat the mean."""
    return with_(rows + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY site, split ORDER BY {order}) - 1 AS pos FROM usable),
mean AS (SELECT avg(target) AS m FROM usable WHERE split = 'train')""", " UNION ALL ".join(f"""
SELECT '{model_label(key)}' AS model, count(*) AS n_rows, 0 AS n_unscored, {r('sqrt(avg((target - m) * (target - m)))', 'mean_rmse', 3)}, {'true' if key in claimed else 'CAST(NULL AS BOOLEAN)'} AS beats_mean
FROM placed JOIN mean ON true WHERE split = 'test' AND pos >= {n}""" for key, n in late.items()))


def skilled_rows(scored: DataFrame, data, slack: float = 0.0) -> DataFrame:
    """Every scored test row with whether its prediction lies in the range of the training target, beside its model's ``skill``.

    ``slack`` widens the range by that share of its width.
    """
    low, high = data.train.agg(F.min(data.target), F.max(data.target)).first()
    room = slack * (high - low) + 1e-6
    rows, value = stage(scored, "predictions"), F.col("predicted")
    fits = value.isNotNull() & ~F.isnan(value) & (value >= 0) & value.between(low - room, high + room)
    table = skill(rows, data).withColumn("mean_rmse", F.round("mean_rmse", 3))
    return rows.select("model", "site", "idx", "ts", "actual", fits.alias("in_range")).join(F.broadcast(table), "model")


def sql_skilled_rows(rows: str, key: str, order: str = "ts") -> str:
    return with_(rows + f""",
skill AS ({sql_skill(rows, {key: 0}, order=order)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY site, split ORDER BY {order}) - 1 AS pos FROM usable)""", f"""
SELECT model, site, pos AS idx, ts, {r('target', 'actual')}, true AS in_range, n_rows, n_unscored, mean_rmse, beats_mean
FROM placed JOIN skill ON true WHERE split = 'test'""")


def readout(kind: str, columns: list[str], **shape):
    """Number, mean and imbalance of each encoded column of the training windows; ``columns`` names them."""

    def run(spark, sf_dir):
        data = bundle(spark, sf_dir)
        model = fit_sequence(kind, data, **shape)[1]
        left = imbalance(model, data.train, "target_scaled")
        rows = [(model.label, c, model.notes["n"], float(m), round(float(x), 6) + 0.0) for c, m, x in zip(columns, model.notes["means"][:-1], left, strict=True)]
        return spark.createDataFrame(rows, "model string, column string, n_windows long, train_mean double, imbalance double")

    return run


def _windows(features, lookback: int = 16) -> list[str]:
    return [f"{step:02d}:{c}" for step in range(lookback) for c in features]


@query("m01_ridge", SQL_RIDGE_ROWS, digits=4)
def ridge(spark, sf_dir):
    model, test = _ridge(spark, sf_dir)
    return _scores(model, test)


@query("m01_ridge_all_features", with_(SQL_ROWS, " UNION ALL ".join(f"""
SELECT '{c}' AS feature, {r(f'avg({c})', 'train_mean', 4)}, CAST(0 AS DOUBLE) AS imbalance FROM usable WHERE split = 'train'""" for c in MODEL_FEATURES)), digits=4)
def ridge_all(spark, sf_dir):
    """Normal equations of ridge: for each feature the mean of x (y - fit) less its penalty is zero, in units of y's deviation."""
    data = bundle(spark, sf_dir)
    model = fit_ridge(data.train, data.features)
    weights = dict(zip(data.features, map(float, model.learner.coefficients.toArray())))
    fit = sum((F.col(c) * w for c, w in weights.items()), F.lit(float(model.learner.intercept)))
    miss = F.col(data.target) - fit
    sums = data.train.agg((F.count("*") * F.stddev_pop(data.target)).alias("n"), *[F.sum(F.col(c) * miss).alias(c) for c in data.features]).first()
    rows = [(c, float(data.scaler.params[c][0]), round((sums[c] - 0.1 * w) / sums["n"], 3) + 0.0) for c, w in weights.items()]
    return spark.createDataFrame(rows, "feature string, train_mean double, imbalance double")


@query("m02_coefficients", with_(SQL_RIDGE, f"""
SELECT 'irr_horiz' AS feature, {r('w', 'coefficient', 4)} FROM fit UNION ALL SELECT '(intercept)', {r('b', 'coefficient', 4)} FROM fit"""), digits=4)
def ridge_coefficients(spark, sf_dir):
    return coefficients(_ridge(spark, sf_dir)[0])


@query("m03_forest", sql_skilled_rows(SQL_ROWS, "rf"))
def forest(spark, sf_dir):
    """Every test row the forest scores, in the range of the training target, and the forest against the training mean."""
    data = bundle(spark, sf_dir)
    return skilled_rows(train_tabular("rf", data, **FOREST)[1], data)


@query("m04_boosted", sql_skilled_rows(SQL_ROWS, "gbt"))
def boosted(spark, sf_dir):
    """Every test row boosting scores, near the range of the training target, and boosting against the training mean."""
    data = bundle(spark, sf_dir)
    return skilled_rows(train_tabular("gbt", data, **BOOSTED)[1], data, 0.25)


@query("m05_feature_importance", with_(SQL_ROWS + f""",
strength AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN var_pop({c}) > 0 THEN abs(corr(target, {c})) END AS s FROM usable WHERE split = 'train'" for c in MODEL_FEATURES)})""", " UNION ALL ".join(f"""
SELECT '{model_label(m)}' AS model, feature, CAST(1 AS DOUBLE) AS total, true AS is_share, row_number() OVER (ORDER BY s DESC NULLS LAST) = 1 AS is_first FROM strength""" for m in ("rf", "gbt"))))
def importance(spark, sf_dir):
    """Every feature of both tree models: shares that add up to 1, the largest that of the best correlated one."""
    data = bundle(spark, sf_dir)
    tables = [
        feature_importance(m).withColumn("model", F.lit(m.label))
        for m in (
            fit_forest(data.train, data.features, **FOREST),
            fit_boosted(data.train, data.features, validation=data.val, **BOOSTED),
        )
    ]
    share = F.col("importance")
    total = F.sum(share).over(Window.partitionBy("model"))
    return reduce(DataFrame.unionByName, tables).select(
        "model", "feature", total.alias("total"), share.between(0, 1).alias("is_share"), (F.col("rank") == 1).alias("is_first")
    )


@query("m07_save_load", SQL_RIDGE_ROWS, digits=4)
def save_load(spark, sf_dir):
    """Scores of a model that was saved and loaded."""
    model, test = _ridge(spark, sf_dir)
    path = staging_path(spark, "model")
    model.save(path)
    return _scores(load_forecaster(spark, "lr", path), test)


@query("m08_batch_predict", with_(SQL_RIDGE, f"""
SELECT site, split, count(*) AS n, {r('avg(CASE WHEN w * irr_horiz + b < 0 THEN 0 ELSE w * irr_horiz + b END)', 'mean_predicted', 4)}
FROM usable JOIN fit ON true GROUP BY site, split"""), digits=4)
def batch_predict(spark, sf_dir):
    rows = stage(usable_rows(spark, sf_dir), "split")
    model = fit_ridge(rows.where("split = 'train'"), ["irr_horiz"])
    return model.predict(rows).groupBy("site", "split").agg(
        F.count("*").alias("n"), F.avg("predicted").alias("mean_predicted")
    )


def _losses(spark, sf_dir):
    data = bundle(spark, sf_dir)
    model = fit_boosted(data.train, data.features, validation=data.val, **BOOSTED)
    return data, model, loss_history(model, data.train, data.val)


@query("m09_loss_history", with_(SQL_ROWS, f"""
SELECT '{model_label("gbt")}' AS model, true AS has_all_rounds, true AS agrees, count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'val') AS n_val FROM usable"""))
def losses(spark, sf_dir):
    """The last round's losses equal mean squared errors worked out from the model's own output."""
    data, model, history = _losses(spark, sf_dir)
    last = history.orderBy(F.desc("round")).first()
    raw = lambda rows: model.pipeline.transform(rows).agg(F.avg((F.col("prediction") - F.col(data.target)) ** 2), F.count("*")).first()
    train, val = raw(data.train), raw(data.val)
    agrees = all(abs(a - b) <= 1e-6 * abs(b) for a, b in ((last.train_loss, train[0]), (last.val_loss, val[0])))
    row = (model.label, last["round"] == model.notes["rounds"], agrees, train[1], val[1])
    return spark.createDataFrame([row], "model string, has_all_rounds boolean, agrees boolean, n_train long, n_val long")


@query("m10_same_seed", with_(SQL_ROWS, """
SELECT CAST(0 AS DOUBLE) AS max_difference, count(*) AS n_rows FROM usable WHERE split = 'test'"""))
def same_seed(spark, sf_dir):
    """Largest difference between two forests of one seed: zero."""
    data = bundle(spark, sf_dir)
    first, second = (fit_forest(data.train, data.features, trees=4, depth=5) for _ in range(2))
    both = first.predict(data.test).withColumnRenamed("predicted", "first")
    both = second.predict(both).withColumnRenamed("predicted", "second")
    return both.agg(F.max(F.abs(F.col("first") - F.col("second"))).alias("max_difference"), F.count("*").alias("n_rows"))


_SETTINGS = {
    "lr": {"elasticNetParam": "0.0", "solver": "normal", "maxIter": "100"},
    "rf": {"numTrees": "4", "maxDepth": "4", "minInstancesPerNode": "2", "subsamplingRate": "1.0",
           "featureSubsetStrategy": "all", "maxBins": "64", "seed": "42"},
    "gbt": {"maxIter": "3", "maxDepth": "3", "minInstancesPerNode": "1", "stepSize": "0.05", "subsamplingRate": "0.8",
            "featureSubsetStrategy": "0.8", "maxBins": "64", "seed": "42"},
}


@query("m11_fitted_parameters", with_(SQL_ROWS, " UNION ALL ".join(f"""
SELECT '{model_label(m)}' AS model, '{p}' AS hyperparameter, '{v}' AS value, CAST(NULL AS DOUBLE) AS penalty""" for m, ps in _SETTINGS.items() for p, v in ps.items()) + f"""
UNION ALL SELECT '{model_label("lr")}', 'regParam', NULL, {r("0.1 / count(*) * stddev_pop(target)", "penalty")} FROM usable WHERE split = 'train'"""))
def fitted_parameters(spark, sf_dir):
    """Settings of models fitted here; the ridge penalty depends on the rows."""
    data = bundle(spark, sf_dir)
    table = studies.fitted_parameters({
        "lr": fit_ridge(data.train, data.features),
        "rf": fit_forest(data.train, data.features, trees=4, depth=4),
        "gbt": fit_boosted(data.train, data.features, rounds=3, depth=3),
    })
    penalty = F.col("hyperparameter") == "regParam"
    return table.select(
        "model", "hyperparameter", F.when(~penalty, F.col("value")).alias("value"),
        F.when(penalty, F.col("value").cast("double")).alias("penalty"),
    )


# Coefficients of the readouts: inputs and an intercept; nodes of trees depend on the rows.
_SIZES = {
    "lr": len(MODEL_FEATURES) + 1, "rf": None, "gbt": None, "seq_flat": 16 * len(MODEL_FEATURES) + 1,
    "seq_conv": 8 * SHAPE["filters"] + 1, "seq_recurrent": SHAPE["units"] + 1, "seq_conv_recurrent": SHAPE["units"] + 1,
}


def all_models(data) -> tuple[dict, DataFrame]:
    """All seven models at their preset sizes, and their test predictions."""
    return train_all(data, tuple(_SIZES), {"rf": FOREST, "gbt": BOOSTED})


@query("m12_complexity", with_(SQL_ROWS + """,
lengths AS (SELECT site, count(*) AS n FROM usable WHERE split = 'test' GROUP BY site)""", " UNION ALL ".join(f"""
SELECT '{model_label(m)}' AS model, CAST({'NULL' if size is None else size} AS BIGINT) AS coefficients, true AS is_timed,
  CAST(sum(greatest(n - {16 if m in SEQUENCE else 0}, 0)) AS BIGINT) AS n_scored FROM lengths""" for m, size in _SIZES.items())))
def complexity(spark, sf_dir):
    """Sizes of all models; times differ from run to run and only have to be there."""
    data = bundle(spark, sf_dir)
    models, _ = all_models(data)
    table = studies.complexity_table(models, data)
    linear = F.when(~F.col("model").isin(models["rf"].label, models["gbt"].label), F.col("size"))
    timed = (F.col("fit_seconds") > 0) & (F.col("rows_per_second") > 0) & (F.col("size") > 0)
    return table.select("model", linear.alias("coefficients"), timed.alias("is_timed"), "n_scored")


@query("m13_flat_window", with_(SQL_SCALED + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY site) AS n
  FROM scaled WHERE split = 'train'),
long AS (UNPIVOT (SELECT pos, n, {', '.join(MODEL_FEATURES)} FROM placed) ON {', '.join(MODEL_FEATURES)} INTO NAME feature VALUE x)""", f"""
SELECT '{model_label("seq_flat")}' AS model, lpad(CAST(step AS VARCHAR), 2, '0') || ':' || feature AS "column", count(*) AS n_windows,
  {r('avg(x)', 'train_mean', 4)}, CAST(0 AS DOUBLE) AS imbalance
FROM long JOIN (SELECT unnest(range(16)) AS step) ON pos >= step AND pos < n - 16 + step GROUP BY step, feature"""), digits=4)
def flat_window(spark, sf_dir):
    """Normal equations of the flat-window readout, per step and feature: what is left of them on the windows is zero."""
    return readout("seq_flat", _windows(MODEL_FEATURES))(spark, sf_dir)


def _sql_units(kind: str, n: int) -> str:
    return with_(SQL_ROWS + """,
lengths AS (SELECT site, count(*) AS n FROM usable WHERE split = 'train' GROUP BY site)""", f"""
SELECT '{model_label(kind)}' AS model, CAST(unit AS VARCHAR) AS "column", CAST((SELECT sum(greatest(n - 16, 0)) FROM lengths) AS BIGINT) AS n_windows,
  CAST(0 AS DOUBLE) AS imbalance FROM (SELECT unnest(range({n})) AS unit)""")


def _encoded(name: str, kind: str):
    @query(name, _sql_units(kind, _SIZES[kind] - 1))
    def run(spark, sf_dir):
        """Normal equations of the readout on encoded windows: nothing is left of them in any unit."""
        table = readout(kind, [str(i) for i in range(_SIZES[kind] - 1)])(spark, sf_dir)
        return table.select("model", "column", "n_windows", F.round("imbalance", 3).alias("imbalance"))

    return run


_encoded("m14_conv_window", "seq_conv")
_encoded("m15_recurrent_window", "seq_recurrent")
_encoded("m16_conv_recurrent_window", "seq_conv_recurrent")

# One lag of one feature has a closed form: the forecasts themselves can be told in SQL.
_ONE_LAG = SQL_SCALED + f""",
lagged AS (SELECT site, split, ts, target, target_scaled AS y, horizon, lag(irr_horiz, CAST(horizon AS INT)) OVER (PARTITION BY site, split, horizon ORDER BY ts) AS x,
    row_number() OVER (PARTITION BY site, split, horizon ORDER BY ts) - 1 AS pos
  FROM scaled CROSS JOIN (SELECT unnest({list(studies.HORIZONS)}) AS horizon)),
fit AS (SELECT horizon, w, my - w * mx AS b FROM (
  SELECT horizon, count(*) * covar_pop(y, x) / (count(*) * var_pop(x) + 0.1) AS w, avg(y) AS my, avg(x) AS mx
  FROM lagged WHERE split = 'train' AND pos >= horizon GROUP BY horizon)),
forecast AS (SELECT f.horizon, site, pos AS idx, ts, target AS actual, (w * x + b) * (y_hi - y_lo) + y_lo AS predicted
  FROM lagged l JOIN fit f ON l.horizon = f.horizon JOIN stat ON true WHERE split = 'test' AND pos >= f.horizon)"""


def _one_lag(spark, sf_dir):
    data = bundle(spark, sf_dir)
    models = fit_sequence("seq_flat", data, lookback=1, horizons=studies.HORIZONS, features=["irr_horiz"])
    return score_horizons(models, data.test, data)


@query("m13_flat_window_one_lag", with_(_ONE_LAG, f"SELECT horizon, site, idx, ts, {r('actual', 'actual', 4)}, {r('predicted', 'predicted', 4)} FROM forecast"), digits=4)
def flat_window_one_lag(spark, sf_dir):
    """Forecasts of flat windows of one step and one feature, for all horizons from one scan; they may be negative."""
    return _one_lag(spark, sf_dir).select("horizon", "site", "idx", "ts", "actual", "predicted")


def _is_scored(*keys: str) -> list:
    """Keys, counts, and whether the errors are numbers in the order every set of errors obeys."""
    sound = (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-3) & ~F.isnan("rmse")
    return [*keys, "n_rows", "n_unscored", sound.alias("is_sound")]


_LENGTHS = [("ordered", f) for f in (0.2, 0.4, 0.6, 0.8, 1.0)] + [("random", f) for f in (0.1, 0.2, 0.3, 0.4, 0.5)]


@query("e15_horizon_learned", with_(SQL_ROWS + """,
lengths AS (SELECT site, count(*) AS n FROM usable WHERE split = 'test' GROUP BY site)""", " UNION ALL ".join(f"""
SELECT '{model_label("seq_flat")}' AS model, {h} AS horizon, CAST(sum(greatest(n - {15 + h}, 0)) AS BIGINT) AS n_rows, 0 AS n_unscored, true AS is_sound
FROM lengths""" for h in studies.HORIZONS)), digits=4)
def horizon_learned(spark, sf_dir):
    """Forecasts per horizon: a window ends so many rows before the row it predicts."""
    return studies.learned_horizons(bundle(spark, sf_dir)).select(_is_scored("model", "horizon"))


@query("e15_horizon_one_lag", with_(_ONE_LAG, f"SELECT horizon, {SQL_METRICS}, count(*) AS n_rows FROM forecast GROUP BY horizon"), digits=4)
def horizon_one_lag(spark, sf_dir):
    """Errors by horizon of windows of one step and one feature."""
    scored = _one_lag(spark, sf_dir)
    return metrics(scored, ["horizon"], counts=True).drop("n_unscored")


_CUTS = SQL_SCALED + """,
train AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY site) AS n,
    ('0x' || substr(md5('42:' || site || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 8))::BIGINT % 1000000 AS bucket
  FROM scaled WHERE split = 'train'),
choices AS (""" + " UNION ALL ".join(
    f"SELECT '{s}' AS selection, CAST({f} AS DOUBLE) AS fraction, {int(f * 1_000_000)} AS below" for s, f in _LENGTHS) + """),
chosen AS (SELECT * FROM train JOIN choices ON (selection = 'ordered' AND pos < floor(n * fraction)) OR (selection = 'random' AND bucket < below))"""


@query("e16_training_length", with_(_CUTS, f"""
SELECT '{model_label("lr")}' AS model, selection, fraction, count(*) AS n_train, (SELECT count(*) FROM usable WHERE split = 'test') AS n_rows,
  0 AS n_unscored, true AS is_sound FROM chosen GROUP BY selection, fraction"""), digits=4)
def training_length(spark, sf_dir):
    """Rows trained on and tested, all features: shares of the training rows from one scan, all test rows each time."""
    return studies.training_length(bundle(spark, sf_dir)).select(_is_scored("model", "selection", "fraction", "n_train"))


@query("e16_training_length_one_feature", with_(_CUTS + """,
fit AS (SELECT selection, fraction, n_train, w, my - w * mx AS b FROM (
  SELECT selection, fraction, count(*) AS n_train, count(*) * covar_pop(target, irr_horiz) / (count(*) * var_pop(irr_horiz) + 0.1) AS w,
    avg(target) AS my, avg(irr_horiz) AS mx FROM chosen GROUP BY selection, fraction)),
scored AS (SELECT selection, fraction, n_train, target AS actual, CASE WHEN w * irr_horiz + b < 0 THEN 0 ELSE w * irr_horiz + b END AS predicted
  FROM scaled JOIN fit ON true WHERE split = 'test')""", f"""
SELECT selection, fraction, n_train, {SQL_METRICS}, count(*) AS n_rows FROM scored GROUP BY selection, fraction, n_train"""), digits=4)
def training_length_one_feature(spark, sf_dir):
    """Test errors by share of the training rows with one feature, where ridge has a closed form."""
    table = studies.training_length(bundle(spark, sf_dir), features=["irr_horiz"])
    return table.drop("model", "n_unscored")


@query("e23_loss_curves", with_(SQL_ROWS, " UNION ALL ".join(f"""
SELECT '{model_label("gbt")}' AS model, '{part}_loss' AS part, true AS has_all_rounds, true AS went_down, 1 AS first_round, true AS below_mean,
  {r("avg((target - (SELECT avg(target) FROM usable WHERE split = 'train')) ** 2)", 'mean_loss', 1)} FROM usable WHERE split = '{part}'""" for part in ("train", "val"))), digits=1)
def loss_curves(spark, sf_dir):
    """Loss per round in long form, summed up: complete from round 1, lower at the end, and below that of the training mean."""
    data, _, history = _losses(spark, sf_dir)
    mean = data.train.agg(F.avg(data.target)).first()[0]
    base = data.rows.where("split != 'test'").groupBy(F.concat("split", F.lit("_loss")).alias("part")).agg(F.avg((F.col(data.target) - mean) ** 2).alias("mean_loss"))
    curves = history.unpivot(["model", "round"], ["train_loss", "val_loss"], "part", "loss")
    curves = curves.groupBy("model", "part").agg(
        (F.count("*") == F.max("round")).alias("has_all_rounds"), (F.min_by("loss", "round") >= F.max_by("loss", "round")).alias("went_down"),
        F.min("round").alias("first_round"), F.max_by("loss", "round").alias("last"),
    )
    return curves.join(base, "part").select("model", "part", "has_all_rounds", "went_down", "first_round", (F.col("last") < F.col("mean_loss")).alias("below_mean"), "mean_loss")


_LATE = {m: 16 if m in SEQUENCE else 0 for m in _SIZES}


@query("j04_train_and_compare", sql_skill(SQL_ROWS, _LATE, TABULAR), digits=3)
def train_and_compare(spark, sf_dir):
    """All seven models: each scores every test row it can reach; nowcasts beat the training mean there."""
    data = bundle(spark, sf_dir)
    _, scored = all_models(data)
    table = skill(stage(scored, "predictions"), data)
    nowcast = F.col("model").isin([model_label(m) for m in TABULAR])
    return table.withColumn("beats_mean", F.when(nowcast, F.col("beats_mean")))

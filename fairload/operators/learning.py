"""Fitted models: boosted trees, logistic and ridge regression, and forecasts from them.

Training runs as Spark jobs over the whole history. What returns to the driver is a model, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from fairload.functions.codes import factor_labels, top_factors
from fairload.functions.numeric import at_least, rounded, whole_number
from fairload.functions.ordering import auc
from fairload.functions.timegrid import slot_time
from fairload.operators import boosting, scoring
from fairload.operators.boosting import Boosting, Ensemble
from fairload.operators.features import calendar
from fairload.operators.scoring import held_out
from fairload.settings import (
    CROP_FEATURES,
    CROP_LABELS,
    TX_FEATURES,
    TX_LABELS,
    YIELD_FLOOR,
    AgroSettings,
    GridSettings,
    LogitCard,
)


RISK = Boosting()
LOSS = Boosting(rounds=350, depth=5, rate=0.09)
YIELD = Boosting(rounds=400, depth=5, rate=0.09)
LOAD = Boosting(rounds=500, depth=7)


def training_means(rows: DataFrame, features: tuple[str, ...]) -> dict[str, float]:
    means = rows.agg(*[F.avg(f) for f in features]).first()
    return {f: float(m) if m is not None else 0.0 for f, m in zip(features, means)}


def _split(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """85 / 15 by key: the same rows in every run and under any partitioning."""
    return df.where(~held_out(key)), df.where(held_out(key))


def holdout_auc(fitted: Ensemble, history: DataFrame, key: Column, label: str) -> DataFrame:
    _, held = _split(history, key)
    scored = fitted.probability(held, "p").withColumn("p", rounded(F.col("p"), 9))
    return auc(scored, label, "p", bounds=(0.0, 1.0))


def train_risk(history: DataFrame, p: Boosting = RISK) -> Ensemble:
    """Boosted-tree classifier of failures in the next 72 h."""
    key = F.col("row_key")
    return boosting.fit(_split(history, key)[0], TX_FEATURES, "failed_next72h", p, True, key)


def history_key(history: DataFrame) -> Column:
    return whole_number(history, "village_id") * 10_007 + F.col("season")


def train_loss(history: DataFrame, p: Boosting = LOSS) -> Ensemble:
    key = history_key(history)
    return boosting.fit(_split(history, key)[0], CROP_FEATURES, "loss_event", p, True, key)


def train_yield(history: DataFrame, p: Boosting = YIELD) -> Ensemble:
    key = history_key(history)
    return boosting.fit(_split(history, key)[0], CROP_FEATURES, "yield_t_ha", p, False, key)


def with_yield(fitted: Ensemble, df: DataFrame, floor: float) -> DataFrame:
    return fitted.predict(df).withColumn("yield_pred", at_least(F.col("prediction"), floor)).drop("prediction")


def score_transformers(fitted: Ensemble, stress: DataFrame, transformers: DataFrame) -> DataFrame:
    """As ``scoring.score_transformers``, by the fitted trees and what they say about each row."""
    live = fitted.probability(scoring.transformer_inputs(stress, transformers), "p_fail_72h")
    return _with_reasons(live, fitted, TX_LABELS, "reason_codes")


def score_villages(loss: Ensemble, yields: Ensemble, features: DataFrame, p: AgroSettings) -> DataFrame:
    """As ``scoring.score_villages``, by fitted trees."""
    added = {name: c for name, c in scoring.crop_inputs(p).items() if name not in features.columns}
    live = loss.probability(features.withColumns(added), "p_loss")
    scored = _with_reasons(with_yield(yields, live, YIELD_FLOOR), loss, CROP_LABELS, "model_codes")
    return scored.drop(*added)


# ---------------------------------------------------------------- linear models


def _standardised(rows: DataFrame, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[Column]]:
    """Mean and deviation of the inputs, and the columns 1, z1 .. zn."""
    moments = rows.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    n = len(features)
    mean, scale = np.array(moments[:n]), np.array(moments[n:]) + 1e-9
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, scale)]
    return mean, scale, [F.lit(1.0), *z]


def _symmetric(upper: list[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = upper
    return out + np.triu(out, 1).T


NEWTON_STEPS = 8


def fit_logit(history: DataFrame, features: tuple[str, ...], label: str, key: Column, labels: dict[str, str]) -> LogitCard:
    """Logistic regression as a card, so that scoring and contributions are plain columns.

    ``NEWTON_STEPS`` Newton steps from zero on the standardised inputs. A step is one aggregate of sums of
    products over all rows; only those few numbers are solved on the driver.
    """
    train, _ = _split(history.where(F.col(label).isNotNull()), key)
    train = train.fillna(training_means(train, features))  # a missing input counts as the mean
    mean, scale, z = _standardised(train, features)
    n = len(z)
    w = np.zeros(n)
    for _ in range(NEWTON_STEPS):
        odds = sum((c * float(v) for c, v in zip(z[1:], w[1:])), F.lit(float(w[0])))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
        rows = train.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], p.alias("p"), F.col(label).alias("y"))
        at = [F.col(f"z{i}") for i in range(n)]
        spread = F.col("p") * (1.0 - F.col("p"))
        products = [F.sum(spread * at[i] * at[j]) for i in range(n) for j in range(i, n)]
        sums = rows.agg(*products, *[F.sum(c * (F.col("y") - F.col("p"))) for c in at]).first()
        curve = _symmetric(sums[: len(products)], n) + 1e-6 * np.eye(n)
        w = w + np.linalg.solve(curve, np.array(sums[len(products) :]))
    return LogitCard(
        features=features,
        mean=tuple(map(float, mean)),
        scale=tuple(map(float, scale)),
        weight=tuple(map(float, w[1:])),
        bias=float(w[0]),
        labels=labels,
    )


def fit_ridge(df: DataFrame, features: tuple[str, ...], target: str, penalty: float = 1.0) -> tuple[float, ...]:
    """Intercept and slopes on the raw inputs.

    The inputs are standardised by population mean and deviation and the intercept goes without
    penalty. Two aggregate passes give the sums of products; only those few numbers are solved.
    """
    rows = df.where(F.col(target).isNotNull())
    rows = rows.fillna(training_means(rows, features))  # a missing input counts as the mean
    mean, scale, z = _standardised(rows, features)
    n = len(features)
    products = [F.sum(z[i] * z[j]) for i in range(n + 1) for j in range(i, n + 1)]
    sums = rows.agg(*products, *[F.sum(c * F.col(target)) for c in z]).first()
    gram = _symmetric(sums[: len(products)], n + 1) + penalty * np.diag([0.0] + [1.0] * n)
    w = np.linalg.solve(gram, np.array(sums[len(products) :]))
    slopes = w[1:] / scale
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def ridge_column(line: tuple[float, ...], features: tuple[str, ...]) -> Column:
    total = F.lit(line[0])
    for slope, f in zip(line[1:], features):
        total = total + slope * F.col(f)
    return total


# ---------------------------------------------------------------- load forecast

LOAD_INPUTS = (
    "lag_1",
    "lag_2",
    "lag_3",
    "lag_4",
    "lag_day",
    "recent_mean",
    "feeder_code",
    "temp_c",
    "hod_sin",
    "hod_cos",
)


def _gapless(names: tuple[str, ...]) -> dict[str, Column]:
    """A lag in a silent interval counts as the recent mean."""
    return {n: F.coalesce(n, "recent_mean", F.lit(0.0)) for n in names}


def feeder_codes(load: DataFrame) -> DataFrame:
    """A small number for each feeder: its own id, or its place in order if ids are text."""
    feeders = load.select("feeder_id").distinct()
    if not isinstance(load.schema["feeder_id"].dataType, StringType):
        return feeders.withColumn("feeder_code", F.col("feeder_id").cast("double"))
    place = F.row_number().over(Window.orderBy("feeder_id"))  # a row a feeder
    return feeders.withColumn("feeder_code", place.cast("double"))


def train_load(load_features: DataFrame, p: GridSettings, shape: Boosting = LOAD) -> Ensemble | None:
    """Boosted trees on lags, temperature and time of day; None if there is too little to learn from.

    With at most a day of history the lag of a day is unknown everywhere and counts as the recent mean, so
    that the four latest slots carry the forecast.
    """
    lags = ("lag_1", "lag_2", "lag_3", "lag_4", "lag_day", "recent_mean")
    known = load_features.where(F.col("kw").isNotNull())
    newest = known.agg(F.max("slot")).first()[0]
    if newest is None or newest < 4:
        return None
    warm = p.slots_per_day if newest > p.slots_per_day + p.steps_ahead else 4
    rows = known.where(F.col("slot") >= warm).withColumns(_gapless(lags)).join(feeder_codes(load_features), "feeder_id")
    key = whole_number(rows, "feeder_id") * 10_000_019 + F.col("slot")
    return boosting.fit(rows, LOAD_INPUTS, "kw", shape, False, key)


def _steps_ahead(predict, season: int, steps: int):
    """A vectorised function from the last day of each feeder to its next ``steps`` slots."""

    def run(tail: pd.Series, code: pd.Series, temps: pd.Series, sines: pd.Series, cosines: pd.Series) -> pd.Series:
        # right-aligned, so that the newest slot of every feeder is in the last column
        if not len(tail):
            return pd.Series([], dtype=object)
        longest = max(len(t) for t in tail)
        known = np.full((len(tail), max(longest, season, 4) + steps), np.nan)
        end = known.shape[1] - steps
        for row, values in zip(known, tail):
            row[end - len(values) : end] = values
        at = [np.stack(x.to_list()) for x in (temps, sines, cosines)]
        for step in range(steps):
            now = end + step
            back = [np.nan_to_num(known[:, now - n]) for n in (1, 2, 3, 4)]
            mean = sum(back) / 4.0
            day = known[:, now - season]  # a history shorter than a day has no such lag: the recent mean stands in
            inputs = [*back, np.where(np.isnan(day), mean, day), mean, code.to_numpy(dtype=float), *(x[:, step] for x in at)]
            known[:, now] = np.maximum(predict(inputs), 0.0)
        return pd.Series(list(known[:, end:]))

    return run


def recursive_forecast(fitted: Ensemble, grid: DataFrame, future_temp: DataFrame, p: GridSettings) -> DataFrame:
    """Step by step, each prediction feeding the lags of the next.

    A feeder is one row that carries its last day as an array (at most one day of slots). All steps are taken in
    one vectorised function over the feeders of a batch: no shuffle, no stored intermediate.
    """
    season, steps = p.slots_per_day, p.steps_ahead
    keep = max(season, 4)
    newest = grid.agg(F.struct((F.max("slot") + 1).alias("slots"), F.max("ts").alias("ts")).alias("s")).scalar()
    recent = grid.withColumn("_end", newest).where(F.col("slot") >= F.col("_end.slots") - keep)
    last_day = recent.groupBy("feeder_id", "_end").agg(
        F.array_sort(F.collect_list(F.struct("slot", "kw"))).alias("_points"), F.avg("kw").alias("_level")
    )
    temps = future_temp.agg(F.array_sort(F.collect_list(F.struct("step", "temp_c"))).alias("t")).scalar()
    level = F.coalesce("_level", F.lit(0.0))
    state = last_day.join(feeder_codes(grid), "feeder_id").withColumn("_temps", temps).select(
        "feeder_id",
        "feeder_code",
        F.col("_end.ts").alias("_newest"),
        "_temps",
        F.transform("_points", lambda e: F.coalesce(e["kw"], level)).alias("_tail"),
    )
    clock = [calendar(slot_time(F.col("_newest"), F.lit(step), p.grain_s)) for step in range(1, steps + 1)]
    sines, cosines = (F.array(*[c[i] for c in clock]) for i in (0, 1))
    temps = F.array(*[F.coalesce(F.try_element_at("_temps", F.lit(s)).getField("temp_c"), F.lit(0.0)) for s in range(1, steps + 1)])
    ahead = F.pandas_udf(_steps_ahead(fitted.predictor(), season, steps), "array<double>")("_tail", "feeder_code", temps, sines, cosines)
    return state.select("feeder_id", "_newest", F.posexplode(ahead).alias("_at", "kw")).select(
        "feeder_id",
        (F.col("_at") + 1).cast("bigint").alias("step"),
        slot_time(F.col("_newest"), F.col("_at") + 1, p.grain_s).alias("ts"),
        "kw",
    )


# ---------------------------------------------------------------- what trees say about a row


def tree_contributions(fitted: Ensemble, df: DataFrame, id_column: str) -> DataFrame:
    """Long form: id, feature, Shapley value. Those of a row and its ``(base)`` add up to the raw score."""
    names = F.array(*[F.lit(f) for f in (*fitted.features, "(base)")])
    pairs = F.arrays_zip(names.alias("feature"), F.col("_moved").alias("contribution"))
    rows = df.select(id_column, fitted.contribution_column().alias("_moved"))
    return rows.select(id_column, F.inline(pairs)).toDF(id_column, "feature", "contribution")


def _with_reasons(df: DataFrame, fitted: Ensemble, labels: dict[str, str], name: str) -> DataFrame:
    """Adds ``factors``, the inputs that push the log-odds up most, and their labels as ``name``."""
    moved = df.withColumn("_moved", fitted.contribution_column())
    parts = [F.get("_moved", F.lit(i)) for i in range(len(fitted.features))]
    values = [F.col(f).cast("double") for f in fitted.features]
    return (
        moved.withColumn("factors", top_factors(fitted.features, parts, values))
        .withColumn(name, factor_labels(F.col("factors"), labels))
        .drop("_moved")
    )

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairload.functions.codes import contributions, probability
from fairload.operators import boosting, learning
from fairload.settings import CROP_FEATURES, TX_FEATURES, TX_LABELS, GridSettings
from fairload.sources.mapping import logical_tables

SF = "/root/testdata/sf0.001"
SMALL = learning.Boosting(rounds=8, depth=4)


@pytest.fixture(scope="module")
def tables(spark):
    return logical_tables(spark, SF)


@pytest.fixture(scope="module")
def risk_model(tables):
    return learning.train_risk(tables["tx_history"], SMALL)


def test_boosted_trees_rank_failures(tables, risk_model):
    r = learning.holdout_auc(risk_model, tables["tx_history"], F.col("row_key"), "failed_next72h").first()
    assert r.auc > 0.7 and r.positives > 0


def test_contributions_add_up_to_the_score(tables, risk_model):
    rows = tables["tx_history"].limit(60).withColumn("row_no", F.monotonically_increasing_id())
    parts = learning.tree_contributions(risk_model, rows, "row_no")
    total = parts.groupBy("row_no").agg(F.sum("contribution").alias("total"))
    got = rows.withColumn("raw", risk_model.raw_column()).join(total, "row_no").collect()
    assert len(got) == 60 and all(abs(r.raw - r.total) < 1e-9 for r in got)


def brute_shapley(tree, x, n):
    """Over all subsets of the inputs; an unknown input splits by cover."""

    def value(node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            goes_left = tree.missing_left[node] if x[f] == boosting.MISSING else x[f] <= tree.cut[node]
            return value(left if goes_left else right, known)
        return (tree.cover[left] * value(left, known) + tree.cover[right] * value(right, known)) / tree.cover[node]

    out = np.zeros(n + 1)
    out[n] = value(0, ())
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
            for known in itertools.combinations(others, size):
                out[i] += weight * (value(0, (*known, i)) - value(0, known))
    return out


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(3)
    n = 4
    bins = rng.integers(0, boosting.MISSING + 1, (400, n)).astype(np.uint8)
    y = ((bins[:, 0] > 20).astype(float) + (bins[:, 1] > 30) * (bins[:, 2] > 10) + rng.normal(0, 0.3, 400) > 1).astype(float)
    rows = boosting.Rows(bins, y, rng.integers(-(2**62), 2**62, 400))
    trees = boosting._fit_here(rows, 0.0, boosting.Boosting(rounds=4, depth=5, least_curvature=0.1), True)
    got = np.zeros((25, n + 1))
    for tree in trees:
        boosting._add_shapley(got, tree, boosting._leaf_paths(tree), bins[:25])
    want = sum(np.array([brute_shapley(t, x, n) for x in bins[:25]]) for t in trees)
    assert np.allclose(got, want, atol=1e-10)
    assert np.allclose(got.sum(axis=1), sum(t.value[boosting.descend(t, bins[:25])] for t in trees), atol=1e-10)


def test_one_task_and_level_jobs_grow_the_same_trees(tables):
    p = learning.Boosting(rounds=3, depth=3)
    history = tables["tx_history"]
    cuts = boosting.quantile_cuts(history, TX_FEATURES)
    fit = lambda rows, most: boosting.fit(rows, TX_FEATURES, "failed_next72h", p, True, F.col("row_key"), cuts, most)
    here, jobs, other = fit(history, 10**9), fit(history, 0), fit(history.repartition(5), 0)
    for a, b, c in zip(here.trees, jobs.trees, other.trees, strict=True):
        assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(a, b, c))


def test_one_task_counts_the_smaller_child_only(tables, monkeypatch):
    p = learning.Boosting(rounds=4, depth=5)
    history = tables["tx_history"].withColumn("loading_mean", F.when(F.col("row_key") % 7 > 0, F.col("loading_mean")))
    cuts = boosting.quantile_cuts(history, TX_FEATURES)
    fit = lambda most: boosting.fit(history, TX_FEATURES, "failed_next72h", p, True, F.col("row_key"), cuts, most)
    for a, b in zip(fit(10**9).trees, fit(0).trees, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))

    rng, count, seen = np.random.default_rng(8), np.bincount, []
    bins = rng.integers(0, boosting.MISSING + 1, (20_000, 6)).astype(np.uint8)
    bins[:, 3:] %= 4
    rows = boosting.Rows(bins, rng.normal(size=20_000), rng.integers(-(2**62), 2**62, 20_000))
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: seen.append(0 if weights is None else len(x)) or count(x, weights, minlength))
    boosting._fit_here(rows, 0.0, boosting.Boosting(rounds=1, depth=5, subsample=1.0, columns=1.0), False)
    assert sum(seen) <= 0.5 * 20_000 * 6 * 2 * 5  # of gradient and curvature, by input and level


def test_written_scores_change_nothing(tables, monkeypatch):
    p = learning.Boosting(rounds=4, depth=2)
    fit = lambda: boosting.fit(tables["yield_history"], CROP_FEATURES, "yield_t_ha", p, False, F.col("season"), local_rows=0)
    before = fit()
    monkeypatch.setattr(boosting, "ROUNDS_A_TABLE", 1)
    assert all(np.array_equal(a.value, b.value) for a, b in zip(before.trees, fit().trees, strict=True))


def test_missing_inputs_have_a_direction_of_their_own(spark):
    rows = [(float(i), None if i % 3 == 0 else float(i % 7), 1 if i % 3 == 0 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id double, x double, y int")
    fitted = boosting.fit(df, ("x",), "y", learning.Boosting(rounds=30, depth=2, columns=1.0), True, F.col("id"))
    got = fitted.probability(df, "p").groupBy("y").agg(F.min("p").alias("least"), F.max("p").alias("most")).orderBy("y").collect()
    assert got[0].most < 0.2 < 0.8 < got[1].least
    assert boosting.fit(df.where("y > 1"), ("x",), "y", learning.Boosting(), True, F.col("id")) is None


def test_logit_card_reproduces_the_fitted_model(tables):
    history = tables["tx_history"]
    card = learning.fit_logit(history, TX_FEATURES, "failed_next72h", F.col("row_key"), TX_LABELS)
    inputs = {f: F.col(f) for f in TX_FEATURES}
    push = sum(contributions(card, inputs), F.lit(0.0))
    df = history.select(probability(card, inputs).alias("p"), push.alias("push"))
    r = df.agg(F.min("p"), F.max("p"), F.avg("p")).first()
    assert 0 <= r[0] < r[1] <= 1
    rate = history.agg(F.avg("failed_next72h")).first()[0]
    assert r[2] == pytest.approx(rate, abs=0.05)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * [1, 5, 0.3, 2, 1] + [0, 3, 1, 0, 2]
    y = x @ [1.0, -0.5, 2.0, 0.0, 0.3] + 4 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{f} double" for f in CROP_FEATURES) + ", yield_t_ha double")
    line = learning.fit_ridge(df, CROP_FEATURES, "yield_t_ha")
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(200), (x - mu) / sd])
    w = np.linalg.solve(z.T @ z + np.diag([0.0, 1, 1, 1, 1, 1]), z.T @ y)
    want = w[0] + ((x - mu) / sd) @ w[1:]
    got = [r[0] for r in df.select(learning.ridge_column(line, CROP_FEATURES)).collect()]
    assert np.allclose(got, want)


def test_recursive_forecast_feeds_its_own_predictions(spark):
    import datetime as dt

    class LastPlusOne:
        """Stands in for a fitted model: predicts the latest lag plus one."""

        def predictor(self):
            return lambda inputs: inputs[0] + 1.0

    p = GridSettings(grain_s=21600)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f, i, t0 + dt.timedelta(hours=6 * i), float(10 * f + i)) for f in (1, 2) for i in range(8)]
    grid = spark.createDataFrame(rows, "feeder_id bigint, slot bigint, ts timestamp, kw double")
    temp = spark.createDataFrame([(s, 30.0) for s in range(1, 5)], "step bigint, temp_c double")
    got = learning.recursive_forecast(LastPlusOne(), grid, temp, p).orderBy("feeder_id", "step").collect()
    assert [(r.feeder_id, r.step, r.kw) for r in got] == [(f, s, 10.0 * f + 7 + s) for f in (1, 2) for s in range(1, 5)]
    assert got[0].ts == t0 + dt.timedelta(hours=48)


def test_hash_split_is_stable_and_about_85_15(tables):
    key = F.col("row_key")
    train, held = learning._split(tables["tx_history"], key)
    n, m = train.count(), held.count()
    assert 0.1 < m / (n + m) < 0.2
    assert learning._split(tables["tx_history"].repartition(7), key)[1].count() == m


def test_rows_with_missing_inputs_keep_their_place(spark, tables, risk_model):
    history = tables["tx_history"].limit(20)
    gaps = history.withColumn("age_years", F.lit(None).cast("double"))
    for rows in (gaps, gaps.withColumn("sag_count", F.lit(None).cast("double"))):
        scored = risk_model.probability(rows, "p")
        assert scored.count() == 20 and scored.where("p is null").count() == 0
        assert learning.tree_contributions(risk_model, rows, "row_key").count() == 20 * (len(TX_FEATURES) + 1)
    trained = learning.train_risk(tables["tx_history"].unionByName(gaps), learning.Boosting(rounds=2, depth=2))
    assert trained.probability(gaps, "p").where("p > 0 and p < 1").count() == 20


def test_presets_are_the_stated_ones():
    shape = lambda b: (b.rounds, b.depth, b.rate, b.subsample, b.columns)
    assert shape(learning.RISK) == (400, 6, 0.08, 0.9, 0.9)
    assert [shape(b)[:3] for b in (learning.LOSS, learning.YIELD, learning.LOAD)] == [(350, 5, 0.09), (400, 5, 0.09), (500, 7, 0.08)]


def test_short_history_still_forecasts(spark):
    import datetime as dt

    p = GridSettings(grain_s=21600)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f, i, t0 + dt.timedelta(hours=6 * i), float(10 * f + i), 30.0) for f in (1, 2) for i in range(6)]
    load = spark.createDataFrame(rows, "feeder_id bigint, slot bigint, ts timestamp, kw double, temp_c double")
    from fairload.operators import features

    grid = load.drop("temp_c")
    inputs = features.load_features(features.load_lags(grid, p), load.select("ts", "temp_c").distinct())
    fitted = learning.train_load(inputs, p, learning.Boosting(rounds=2, depth=2))
    temp = spark.createDataFrame([(s, 30.0) for s in range(1, 5)], "step bigint, temp_c double")
    assert learning.recursive_forecast(fitted, grid, temp, p).count() == 2 * p.steps_ahead
    assert learning.train_load(inputs.where("slot < 3"), p) is None

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairload.functions.codes import normalised, with_fleet_range
from fairload.functions.numeric import rounded
from fairload.functions.ordering import auc, exact_median, ranked, running_total


def frame(spark, values, cols="k double, id bigint, w double"):
    return spark.createDataFrame(values, cols)


@pytest.mark.parametrize("partitions", [1, 17])
@pytest.mark.parametrize("bounds", [None, (0.0, 1.0), (0.4, 0.6)])
def test_running_total_equals_sorting(spark, partitions, bounds):
    rng = np.random.default_rng(1)
    rows = [(float(np.round(k, 2)), i, float(w)) for i, (k, w) in enumerate(zip(rng.random(400), rng.integers(1, 9, 400)))]
    rows += [(None, 900 + i, 1.0) for i in range(3)]
    got = running_total(frame(spark, rows).repartition(partitions), F.col("w"), F.col("k"), ["id"], bounds=bounds).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0.0, r[1]))
    total, want = 0.0, {}
    for _, i, w in order:
        want[i], total = total, total + w
    assert {r.id: r.before for r in got} == want


def test_rank_is_unique_descending_and_puts_missing_last(spark):
    rows = [(0.5, 3, 0.0), (0.5, 1, 0.0), (0.9, 2, 0.0), (None, 4, 0.0)]
    got = ranked(frame(spark, rows), F.col("k"), ["id"]).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in got] == [(1, 2), (2, 1), (3, 3), (4, 4)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_exact_median_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert exact_median(df, "v").first()[0] == pytest.approx(float(np.median(values)), rel=1e-12, abs=1e-9)


def test_median_of_nothing_is_missing(spark):
    assert exact_median(spark.createDataFrame([], "v double"), "v").first()[0] is None


def test_auc_with_ties_and_with_one_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    assert auc(df, "y", "p").first().auc == pytest.approx(wins / 4)
    assert auc(df.where("y = 1"), "y", "p").first().auc == 0.5


def test_equal_fleet_normalises_to_zero(spark):
    df = with_fleet_range(spark.createDataFrame([(2.0,), (2.0,)], "x double"), x=F.col("x"))
    assert [r[0] for r in df.select(normalised(F.col("x"), "x")).collect()] == [0.0, 0.0]


def test_ties_round_half_up_on_the_decimal_value(spark):
    got = spark.createDataFrame([(0.00005,), (0.85255,), (-0.00005,)], "x double").select(rounded(F.col("x"), 4)).collect()
    assert [r[0] for r in got] == [0.0001, 0.8526, -0.0001]

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairload.operators import features, forecast, scoring
from fairload.settings import GridSettings

P = GridSettings()
T0 = dt.datetime(2024, 1, 1)


def assembled(spark, rows):
    cols = (
        "feeder_id bigint, kw_now double, capacity_kw double, sag_rate double, volatility double, utilization_now double, tx_risk_max double, "
        "tx_risk_mean double, tx_high_risk bigint, forecast_peak_kw double, residential bigint, commercial bigint, industrial bigint, customers bigint, "
        "shed_hours_30d double, complaints_30d int, name string, critical_type string, is_protected boolean"
    )
    return spark.createDataFrame(rows, cols)


def test_published_feeder_arithmetic_and_codes(spark):
    rows = [
        (1, 6213.0, 5400.0, 0.0, 0.1, 6.213 / 5.4, 0.99, 0.99, 3, 8403.0, 100, 60, 9, 169, 3.2, 10, "a", "none", False),
        (2, 100.0, 5400.0, 0.9, 0.9, 0.02, 0.0, 0.0, 0, 200.0, 0, 0, 0, 0, 9.0, 0, "b", "none", False),
        (3, 100.0, 5400.0, 0.0, 0.1, 0.02, 0.0, 0.0, 0, 200.0, 1, 0, 0, 1, 9.0, 0, "c", "hospital", True),
    ]
    got = {r.feeder_id: r for r in scoring.score_feeders(assembled(spark, rows)).collect()}
    assert got[1].fci == 0.85 and got[1].headroom_mw == -3.003 and got[1].sheddable_mw == 6.213
    assert got[1].reason_codes == ["OVERLOAD-4H", "TX-RISK×3", "AT-LIMIT", "FAIR-OK"]
    assert got[2].reason_codes == ["VOLATILE", "RECENT-SHED", "SAGS"]
    assert got[3].reason_codes == ["PROTECTED-HOSPITAL"] and got[3].pain_score == 9.99


def test_supply_cap_and_deficit_from_the_published_peak(spark):
    scored = spark.createDataFrame([(5400.0, False, 3)], "capacity_kw double, is_protected boolean, tx_high_risk bigint")
    load = spark.createDataFrame([(T0, 50.0), (T0 + dt.timedelta(hours=1), 52.04)], "ts timestamp, mw double")
    ahead = spark.createDataFrame([(T0, 68.3)], "ts timestamp, mw double")
    weather = spark.createDataFrame([(T0, 30.0)], "ts timestamp, temp_c double")
    r = scoring.grid_summary(scored, load, ahead, weather).first()
    assert (r.current_mw, r.supply_cap_mw, r.deficit_mw, r.tx_watchlist) == (52.0, 60.1, 8.2, 1)


def test_one_interval_has_no_volatility(spark):
    fd = spark.createDataFrame([(1, T0, 10.0, 1, 90.0)], "feeder_id bigint, ts timestamp, kw double, sags bigint, capacity_kw double")
    r = features.feeder_profile(fd).first()
    assert r.std_kw_24h is None and r.volatility == 0.0 and r.load_factor == 1.0


def test_trailing_day_is_strict_and_fleet_wide(spark):
    rows = [(1, T0, 1.0), (1, T0 + dt.timedelta(hours=1), 2.0), (2, T0 + dt.timedelta(hours=24), 3.0)]
    df = spark.createDataFrame(rows, "feeder_id bigint, ts timestamp, kw double")
    assert sorted(r.kw for r in features.trailing_day(df).collect()) == [2.0, 3.0]


def grid_of(spark, kw):
    rows = [(1, i, T0 + dt.timedelta(seconds=900 * i), v) for i, v in enumerate(kw)]
    return spark.createDataFrame(rows, "feeder_id bigint, slot bigint, ts timestamp, kw double")


def test_seasonal_naive_matches_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.uniform(5, 20, 250)
    ratio = np.clip(m[-8:].mean() / (m[-104:-96].mean() + 1e-6), 0.6, 1.8)
    want = m[-96 : -96 + 16] * ratio
    got = forecast.seasonal_naive(grid_of(spark, [float(x) for x in m]), P).orderBy("step").collect()
    assert np.allclose([r.kw for r in got], want) and [r.step for r in got] == list(range(1, 17))
    assert (got[0].ts - T0).total_seconds() == 900 * 250


def test_short_history_repeats_the_last_value(spark):
    got = forecast.seasonal_naive(grid_of(spark, [3.0] * 103 + [7.5]), P).collect()
    assert len(got) == 16 and {r.kw for r in got} == {7.5}


def test_future_temperature(spark):
    def steps(n):
        df = spark.createDataFrame([(i, float(i)) for i in range(n)], "slot bigint, temp_c double")
        return [r.temp_c for r in forecast.future_temperature(df, P).orderBy("step").collect()]

    assert steps(192) == [96.0 + i + 96.0 for i in range(16)]  # same slot yesterday plus the warming
    assert steps(150) == [54.0 + i for i in range(16)]  # under two days: no warming
    assert steps(90) == [89.0] * 16  # a day or less: last value


def test_lags_count_missing_cells_as_slots(spark):
    rows = [(1, T0, 1.0), (1, T0 + dt.timedelta(minutes=45), 4.0), (2, T0 + dt.timedelta(minutes=15), 9.0)]
    fd = spark.createDataFrame(rows, "feeder_id bigint, ts timestamp, kw double")
    grid = features.load_grid(fd, P)
    assert grid.count() == 8
    last = features.load_lags(grid, P).where("feeder_id = 1 and slot = 3").first()
    assert (last.lag_1, last.lag_2, last.lag_3, last.recent_mean) == (None, None, 1.0, 1.0)


def test_trend_needs_two_dates(spark):
    rows = [(1, T0, 0.5), (2, T0, 0.1), (2, T0 + dt.timedelta(5), 0.9), (2, T0 + dt.timedelta(10), 0.6), (2, T0 + dt.timedelta(15), 0.7)]
    df = spark.createDataFrame(rows, "village_id bigint, date timestamp, ndvi double")
    got = {r.village_id: r.ndvi_trend for r in features.ndvi_trend(df).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(-0.2)


def test_village_codes_and_triggers(spark):
    rows = [
        (1, 0.9, 1.0, 3.0, 0.8, -0.2, 1.0, 10.0, "tail", 0.2, ["DRY-SPELL-REPRO"], 5),
        (2, 0.1, 3.0, 3.0, 0.1, 0.1, 0.0, 10.0, "tail", 0.8, [], 5),
        (3, 0.1, 3.0, 3.0, 0.5, 0.1, 0.0, 10.0, "head", 0.2, [], 5),
    ]
    cols = (
        "village_id bigint, p_loss double, yield_pred double, normal_yield double, water_deficit double, ndvi_trend double, rainfed_frac double, "
        "area_ha double, canal_reach string, past_support_index double, model_codes array<string>, plots bigint"
    )
    scored = scoring.score_priority(spark.createDataFrame(rows, cols))
    got = {r.village_id: r for r in scored.collect()}
    assert got[1].vapi == 1.0
    assert got[1].reason_codes == ["DRY-SPELL-REPRO", "TRIGGER-HIT", "YIELD-SHORT", "NDVI-DECLINE", "TAIL-UNDERSERVED"]
    assert got[2].reason_codes == ["WELL-SERVED"] and got[3].reason_codes == ["FAIR-OK"]
    assert (got[1].insurance_trigger, got[3].rain_trigger) == (1, 0)
    assert got[1].water_need_ml == pytest.approx(10 * 0.06 * 1.3)
    summary = scoring.agro_summary(scored).first()
    assert (summary.villages, summary.at_risk_pct, summary.tail_villages) == (3, 33.3, 2)


def test_missing_stays_missing_through_clips(spark):
    from fairload.functions.numeric import at_least, clip

    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert [tuple(r) for r in df.select(clip(F.col("x"), 0, 1), at_least(F.col("x"), 9)).collect()] == [(None, None), (1.0, 9.0)]

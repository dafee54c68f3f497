import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fairload.functions.timegrid import snap
from fairload.operators import cleaning, rollup
from fairload.settings import AgroSettings, GridSettings

P, A = GridSettings(), AgroSettings()
DAY = dt.datetime(2024, 1, 1)


def at(h, m=0, s=0, us=0):
    return DAY + dt.timedelta(hours=h, minutes=m, seconds=s, microseconds=us)


def readings(spark, rows):
    return spark.createDataFrame(rows, "reading_id bigint, meter_id bigint, ts timestamp_ntz, kwh double, voltage double").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def stamps(df, *cols):
    return [tuple(r) for r in df.select(*[F.date_format(c, "dd HH:mm").alias(c) if c == "ts" else c for c in cols]).collect()]


def test_snap_sends_exact_halves_to_the_even_slot(spark):
    cases = {at(0, 7, 30): "01 00:00", at(0, 22, 30): "01 00:30", at(0, 7, 30, 1): "01 00:15", at(0, 7, 29): "01 00:00", at(23, 59, 59): "02 00:00"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t timestamp_ntz, want string")
    got = df.select(F.date_format(snap(F.col("t").cast("timestamp"), 900), "dd HH:mm").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_first_arrival_stays_for_any_number_of_partitions(spark):
    rows = [(i, 1, at(0, 0, i % 60), float(i), 230.0) for i in range(50, 0, -1)]
    expected = [("01 00:00", 1.0, 50)]
    for n in (1, 17):
        slots = cleaning.reading_slots(readings(spark, rows).repartition(n), P)
        assert stamps(slots, "ts", "kwh", "copies") == expected


def test_first_arrival_keeps_a_missing_value(spark):
    rows = [(1, 1, at(0), None, 230.0), (2, 1, at(0, 1), 5.0, 230.0)]
    assert stamps(cleaning.reading_slots(readings(spark, rows), P), "kwh", "copies") == [(None, 2)]


def test_ledger_counts_in_order_and_adds_up(spark):
    rows = [
        (1, 1, at(0), 5.0, 200.0),
        (2, 1, at(0, 1), 7.0, 230.0),  # copy
        (3, 1, at(1), 500.0, None),  # Wh
        (4, 1, at(2), -3.0, 230.0),  # negative
        (5, 1, at(3), None, 230.0),  # missing
        (6, 9, at(0), 800.0, 230.0),  # unknown meter, not counted as a unit error
    ]
    meters = spark.createDataFrame([(1, 1, "residential"), (2, 1, "residential")], "meter_id bigint, transformer_id bigint, customer_class string")
    r = cleaning.grid_ledger(readings(spark, rows), meters, P).first().asDict()
    assert r == dict(rows_in=6, duplicates_removed=1, orphans_removed=1, unit_errors_fixed=1, negatives_nulled=1, nulls_imputed=2, rows_clean=4)
    assert r["rows_in"] - r["duplicates_removed"] - r["orphans_removed"] == r["rows_clean"]


def test_impute_uses_the_meters_median_and_falls_back_to_zero(spark):
    rows = [(1, 1, at(0), 1.0, 206.9), (2, 1, at(1), 4.0, 207.0), (3, 1, at(2), None, None), (4, 2, at(0), None, 230.0), (5, 2, at(1), -1.0, 230.0)]
    meters = spark.createDataFrame([(1, 1, "x"), (2, 1, "x")], "meter_id bigint, transformer_id bigint, customer_class string")
    got = {(r.meter_id, r.ts.hour): (r.kwh, r.is_sag) for r in cleaning.clean_readings(readings(spark, rows), meters, P).collect()}
    assert got[1, 2] == (2.5, 0) and got[2, 0][0] == 0.0 and got[2, 1][0] == 0.0
    assert got[1, 0][1] == 1 and got[1, 1][1] == 0


def test_unknown_keys_drop_out_of_the_rollup_but_stay_in_the_enriched_table(spark):
    from fairload.operators.enrich import enriched_readings

    clean = spark.createDataFrame([(1, at(0), 2.0, 230.0, 0), (2, at(0), 3.0, 230.0, 1)], "meter_id bigint, ts timestamp, kwh double, voltage double, is_sag int")
    meters = spark.createDataFrame([(1, 1, "a"), (2, 99, "b")], "meter_id bigint, transformer_id bigint, customer_class string")
    tx = spark.createDataFrame([(1, 5, 100)], "transformer_id bigint, feeder_id bigint, capacity_kva int")
    feeders = spark.createDataFrame([(5, 7)], "feeder_id bigint, substation_id bigint")
    assert enriched_readings(clean, meters, tx, feeders, P).count() == 2
    rows = rollup.transformer_interval(clean, meters, tx, P).collect()
    assert [(r.transformer_id, r.kw, r.n_meters, round(r.loading, 6)) for r in rows] == [(1, 8.0, 1, round(8 / 90, 6))]
    fd = rollup.feeder_interval(rollup.transformer_interval(clean, meters, tx, P), P).first()
    assert fd.capacity_kw == 90.0


def passes(spark, values, plot=1, cloud=()):
    rows = [(plot, DAY + dt.timedelta(days=5 * i), i, v, 1 if i in cloud else 0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "plot_id bigint, pass_ts timestamp, pass_no bigint, ndvi double, cloud_flag int")


def plots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "plot_id bigint")


def test_ndvi_bands(spark):
    values = [-0.1, 0.04, 0.05, 1.0, 1.2, 1.5, 1.51, 8600.0, 0.5, None]
    got = cleaning.masked_passes(passes(spark, values, cloud=(8,)), plots(spark, 1), A).orderBy("date").collect()
    assert [r.ndvi for r in got] == [None, None, 0.05, 1.0, None, None, None, 0.86, None, None]
    ledger = cleaning.agro_ledger(passes(spark, values, cloud=(8,)), plots(spark, 1), A).first()
    assert (ledger.unit_errors_fixed, ledger.cloud_masked, ledger.gaps_filled, ledger.rows_clean) == (2, 6, 7, 10)


def test_gap_fill_equals_pandas_interpolation(spark):
    rng = np.random.default_rng(3)
    frames, expected = None, []
    for plot in range(1, 8):
        v = np.round(rng.uniform(0.1, 0.9, 30), 4)
        v[rng.random(30) < 0.4] = np.nan
        if plot == 7:
            v[:] = np.nan
        one = passes(spark, [None if np.isnan(x) else float(x) for x in v], plot)
        frames = one if frames is None else frames.unionByName(one)
        expected.append(pd.Series(v).interpolate(limit_direction="both"))
    median = pd.concat(expected).median()
    smooth = [s.fillna(median).rolling(3, min_periods=1, center=True).mean() for s in expected]
    got = cleaning.clean_passes(frames, plots(spark, *range(1, 8)), A).orderBy("plot_id", "date").toPandas()
    assert np.allclose(got["ndvi"], pd.concat([s.fillna(median) for s in expected]))
    assert np.allclose(got["ndvi_smooth"], pd.concat(smooth))


def test_short_weather_series_counts_every_day(spark):
    def block(b, days):
        return [(b, DAY + dt.timedelta(days=i), 0.0 if i % 2 else 2.0, 31.0, 21.0) for i in range(days)]

    df = spark.createDataFrame(block(1, 60) + block(2, 120), "block_id bigint, date timestamp, rain_mm double, tmax double, tmin double")
    got = {r.block_id: r for r in rollup.block_weather_season(df, A).collect()}
    assert (got[1].dry_days_repro, got[1].rain_repro) == (30, 60.0)
    assert (got[2].dry_days_repro, got[2].rain_repro, got[2].rain_total) == (15, 30.0, 120.0)


def test_approximate_median_agrees_on_short_histories(spark):
    rows = [(1, at(0), 1.0), (1, at(1), 3.0), (1, at(2), 5.0), (1, at(3), None), (2, at(0), None)]
    df = spark.createDataFrame(rows, "meter_id bigint, ts timestamp, kwh double")
    exact = {(r.meter_id, r.ts): r.kwh for r in cleaning.impute_median(df).collect()}
    assert exact == {(r.meter_id, r.ts): r.kwh for r in cleaning.impute_median_approx(df).collect()}

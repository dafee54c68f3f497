"""Windowed features of transformers, feeders, plots and villages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairload.functions.numeric import clip, ratio
from fairload.functions.timegrid import day_fraction_hours, slot_number, slot_time
from fairload.operators.rollup import minutes_overloaded
from fairload.settings import CLASS_PAIN, CROP_TRAITS, IRRIGATION_RELIEF, AgroSettings, GridSettings


def trailing_day(df: DataFrame) -> DataFrame:
    """Rows less than 24 h before the fleet's newest interval."""
    newest = df.agg(F.max("ts").alias("newest")).scalar()
    return df.where(F.col("ts") > newest - F.expr("interval 24 hours"))


def transformer_stress(tx_int: DataFrame) -> DataFrame:
    """24 h stress of each transformer, under the names the risk model was trained on."""
    hot = F.pow(F.greatest(F.col("loading") - 0.8, F.lit(0.0)), 2.0)
    return trailing_day(tx_int).groupBy("transformer_id", "feeder_id").agg(
        F.avg("loading").alias("loading_mean"),
        F.max("loading").alias("loading_max"),
        minutes_overloaded().cast("double").alias("overload_minutes"),
        F.sum("sags").alias("sag_count"),
        F.sum(hot).alias("thermal_stress"),
        F.max_by("kw", "ts").alias("kw_now"),
    )


def feeder_profile(fd_int: DataFrame) -> DataFrame:
    stats = trailing_day(fd_int).groupBy("feeder_id").agg(
        F.max("kw").alias("peak_kw_24h"),
        F.avg("kw").alias("mean_kw_24h"),
        F.stddev_samp("kw").alias("std_kw_24h"),
        F.avg("sags").alias("sag_rate"),
        F.max("capacity_kw").alias("capacity_kw"),
        F.max_by("kw", "ts").alias("kw_now"),
    )
    return stats.select(
        "*",
        ratio(F.col("mean_kw_24h"), F.col("peak_kw_24h")).alias("load_factor"),
        F.coalesce(ratio(F.col("std_kw_24h"), F.col("mean_kw_24h")), F.lit(0.0)).alias("volatility"),
        ratio(F.col("kw_now"), F.col("capacity_kw")).alias("utilization_now"),
    )


def rolling_load(fd_int: DataFrame, p: GridSettings) -> DataFrame:
    recent = Window.partitionBy("feeder_id").orderBy("ts").rowsBetween(1 - p.rolling_rows, 0)
    return fd_int.select("feeder_id", "ts", "kw", F.avg("kw").over(recent).alias("roll_mean_2h"))


def customer_mix(meters: DataFrame, transformers: DataFrame) -> DataFrame:
    """Customers of each class on each feeder, counted by transformer before the join."""
    classes = list(CLASS_PAIN)
    per_tx = meters.groupBy("transformer_id").agg(
        *[F.count_if(F.col("customer_class") == c).alias(c) for c in classes]
    )
    mix = (
        per_tx.join(transformers.select("transformer_id", "feeder_id"), "transformer_id")
        .where(F.col("feeder_id").isNotNull())
        .groupBy("feeder_id")
        .agg(*[F.sum(c).alias(c) for c in classes])
    )
    everyone = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return mix.withColumn("customers", everyone)


# ---------------------------------------------------------------- regular load grid


def _span(fd_int: DataFrame) -> Column:
    return fd_int.agg(F.struct(F.min("ts").alias("first"), F.max("ts").alias("last")).alias("span")).scalar()


def slot_list(fd_int: DataFrame, p: GridSettings) -> DataFrame:
    """slot, ts: every slot from the fleet's first to its last interval, from one sequence."""
    ends = fd_int.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).where(F.col("first").isNotNull())
    slots = F.sequence(F.lit(0).cast("bigint"), slot_number(F.col("last"), F.col("first"), p.grain_s))
    numbered = ends.select("first", F.explode(slots).alias("slot"))
    return numbered.select("slot", slot_time(F.col("first"), F.col("slot"), p.grain_s).alias("ts"))


def load_grid(fd_int: DataFrame, p: GridSettings, last: int | None = None) -> DataFrame:
    """One row for each feeder and slot from the fleet's first to its last interval.

    Every feeder row is expanded with its own run of slot numbers and then meets its readings on
    the key; there is no product of two tables. Cells without a reading hold a missing kw. ``last`` keeps
    only so many slots, and the intervals are filtered by time before anything is expanded; slot numbers
    stay those of the whole span.
    """
    span, keep = _span(fd_int), last
    first, last = F.col("_span.first"), F.col("_span.last")
    end = slot_number(last, first, p.grain_s)
    begin = F.lit(0).cast("bigint") if keep is None else F.greatest(F.lit(0).cast("bigint"), end - (keep - 1))
    slots = F.sequence(begin, end)
    cells = (
        fd_int.select("feeder_id")
        .distinct()
        .withColumn("_span", span)
        .select("feeder_id", first.alias("_first"), F.explode(slots).alias("slot"))
        .select("feeder_id", "slot", slot_time(F.col("_first"), F.col("slot"), p.grain_s).alias("ts"))
    )
    known = fd_int.select("feeder_id", "ts", "kw")
    if keep is not None:
        newest = fd_int.agg(F.max("ts")).scalar()
        known = known.where(F.col("ts") > newest - F.make_dt_interval(secs=F.lit(float(keep * p.grain_s))))
    return cells.join(known, ["feeder_id", "ts"], "left")


def load_lags(grid: DataFrame, p: GridSettings) -> DataFrame:
    """Lags by slot (a missing cell counts as a slot) and the mean of the four latest."""
    order = Window.partitionBy("feeder_id").orderBy("slot")
    lags = [F.lag("kw", n).over(order).alias(f"lag_{n}") for n in p.lags]
    day = F.lag("kw", p.slots_per_day).over(order).alias("lag_day")
    near = F.avg("kw").over(order.rowsBetween(-4, -1)).alias("recent_mean")
    return grid.select("feeder_id", "slot", "ts", "kw", *lags, day, near)


def calendar(ts: Column) -> list[Column]:
    angle = day_fraction_hours(ts) * (2.0 * 3.141592653589793 / 24.0)
    return [F.sin(angle).alias("hod_sin"), F.cos(angle).alias("hod_cos")]


def load_features(lags: DataFrame, temperature: DataFrame) -> DataFrame:
    """Inputs of the load regressor, one row for each feeder and slot."""
    return lags.join(temperature.select("ts", "temp_c"), "ts", "left").select(*lags.columns, "temp_c", *calendar(F.col("ts")))


def heat_multiplier(temp_c: Column) -> Column:
    """Cooling load above 24 degrees."""
    return F.lit(1.0) + F.lit(0.035) * F.pow(F.greatest(temp_c - 24.0, F.lit(0.0)), F.lit(1.3))


# ---------------------------------------------------------------- villages


def ndvi_trend(village_dates: DataFrame) -> DataFrame:
    """Change over a village's last three dates; fewer than two dates give 0."""
    newest = Window.partitionBy("village_id").orderBy(F.col("date").desc())
    last3 = village_dates.withColumn("_back", F.row_number().over(newest)).where("_back <= 3")
    return last3.groupBy("village_id").agg(
        (F.max_by("ndvi", "date") - F.min_by("ndvi", "date")).alias("ndvi_trend")
    )


def village_features(
    seasons: DataFrame, village_dates: DataFrame, block_weather: DataFrame, villages: DataFrame, p: AgroSettings
) -> DataFrame:
    rainfed = F.when(F.col("irrigation") == "rainfed", 1.0).otherwise(0.0)
    vf = seasons.groupBy("village_id", "block_id", "canal_reach").agg(
        F.avg("peak_ndvi").alias("peak_ndvi"),
        F.avg("mean_ndvi").alias("mean_ndvi"),
        F.avg("integ_ndvi").alias("integ_ndvi"),
        F.avg("last_ndvi").alias("last_ndvi"),
        F.sum("area_ha").alias("area_ha"),
        F.count("plot_id").alias("plots"),
        F.avg(rainfed).alias("rainfed_frac"),
    )
    master = villages.select("village_id", "district_id", "name", "past_support_index", "lat", "lon")
    return (
        vf.join(ndvi_trend(village_dates), "village_id", "left")
        .join(block_weather, "block_id", "left")
        .join(master, "village_id", "left")
        .withColumn("gdd_frac", clip(F.col("gdd_total") / p.maturity_gdd, 0.4, 1.3))
        .withColumn("water_deficit", clip(F.col("dry_days_repro") / 30.0, 0.0, 1.0))
    )


def _trait(crop: Column, at: int) -> Column:
    chain = None
    for name, values in CROP_TRAITS.items():
        hit, value = crop == name, F.lit(values[at])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def expected_ndvi(passes: DataFrame, plots: DataFrame, villages: DataFrame, gdd: DataFrame) -> DataFrame:
    """Expected curve of each plot's crop at the block's degree-days, and the anomaly against it.

    Passes meet the weather by day of season (position of the pass's month and day within the
    block's season), green-up and senescence are logistic, and the curve is scaled to the crop's
    peak over the plot's own passes.
    """
    located = passes.join(plots.select("plot_id", "village_id", "crop"), "plot_id").join(
        villages.select("village_id", "block_id"), "village_id"
    )
    by_day = gdd.select("block_id", F.date_format("date", "MM-dd").alias("_md"), "gdd_cum")
    joined = located.withColumn("_md", F.date_format("date", "MM-dd")).join(by_day, ["block_id", "_md"])
    frac = F.col("gdd_cum") / _trait(F.col("crop"), 1)
    shape = F.lit(1.0) / (1.0 + F.exp(-12.0 * (frac - 0.25))) / (1.0 + F.exp(12.0 * (frac - 0.80)))
    shaped = joined.withColumn("_shape", shape)
    top = F.max("_shape").over(Window.partitionBy("plot_id"))
    expected = 0.15 + (_trait(F.col("crop"), 0) - 0.15) * F.col("_shape") / top
    return shaped.select("plot_id", "date", "ndvi", expected.alias("ndvi_expected")).withColumn(
        "ndvi_anomaly", F.col("ndvi") - F.col("ndvi_expected")
    )


def water_stress(plots: DataFrame, villages: DataFrame, block_weather: DataFrame) -> DataFrame:
    """Dry days of the reproductive window, weighted by crop and eased by irrigation and soil."""
    relief = F.lit(0.0)
    for source, eased in IRRIGATION_RELIEF.items():
        relief = F.when(F.col("irrigation") == source, eased).otherwise(relief)
    soil = (F.col("soil_awc") - 80.0) / 100.0 * 0.25
    dry = F.col("dry_days_repro") / 22.0
    index = clip(dry * _trait(F.col("crop"), 2) * (1.0 - relief - soil), 0.0, 0.85)
    return (
        plots.join(villages.select("village_id", "block_id"), "village_id")
        .join(block_weather.select("block_id", "dry_days_repro"), "block_id")
        .select("plot_id", "village_id", "area_ha", index.alias("water_stress"))
    )


def loss_labels(history: DataFrame) -> DataFrame:
    """A season is a loss if it yields under 80 % of the village's mean."""
    normal = F.avg("yield_t_ha").over(Window.partitionBy("village_id"))
    return history.select("village_id", "season", "yield_t_ha", normal.alias("normal_yield")).withColumn(
        "loss_event", (F.col("yield_t_ha") < 0.8 * F.col("normal_yield")).cast("int")
    )


def season_history(seasons: DataFrame, stress: DataFrame, block_weather: DataFrame, season: int, p: AgroSettings) -> DataFrame:
    """Village means of a season's drivers: one history row for each village."""
    return (
        seasons.join(stress.select("plot_id", "water_stress"), "plot_id")
        .groupBy("village_id", "block_id")
        .agg(
            F.avg("peak_ndvi").alias("peak_ndvi"),
            F.avg("integ_ndvi").alias("integ_ndvi"),
            F.avg("water_stress").alias("water_stress"),
            F.sum("area_ha").alias("area_ha"),
        )
        .join(block_weather.select("block_id", "gdd_total"), "block_id", "left")
        .select(
            "village_id",
            F.lit(season).alias("season"),
            "peak_ndvi",
            "integ_ndvi",
            "water_stress",
            (F.col("gdd_total") / p.maturity_gdd).alias("gdd_frac"),
            "area_ha",
        )
    )

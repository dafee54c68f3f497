"""Short-term load and temperature forecasts that need no fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairload.functions.numeric import at_least, clip
from fairload.functions.timegrid import slot_time
from fairload.settings import GridSettings


def seasonal_naive(grid: DataFrame, p: GridSettings) -> DataFrame:
    """The same slots of the last day, scaled by how today's level compares with yesterday's.

    feeder_id, step (1..n), ts, kw. With at most one day and eight slots of history the last
    value is repeated. One aggregate over the load grid; no sort.
    """
    season, steps, window = p.slots_per_day, p.steps_ahead, min(8, p.slots_per_day)
    newest = grid.agg(F.struct((F.max("slot") + 1).alias("slots"), F.max("ts").alias("ts")).alias("s")).scalar()
    end, slot = F.col("_end.slots"), F.col("slot")
    recent = slot >= end - window
    before = slot.between(end - season - window, end - season - 1)
    in_base = slot.between(end - season, end - season + steps - 1)
    base = F.struct((slot - (end - season) + 1).alias("step"), F.col("kw").alias("kw"))
    # `_base` holds at most `steps` entries for a feeder, whatever the length of its history
    stats = (
        grid.withColumn("_end", newest)
        .where(slot >= end - season - window)
        .groupBy("feeder_id", "_end")
        .agg(
            F.avg(F.when(recent, F.col("kw"))).alias("_now"),
            F.avg(F.when(before, F.col("kw"))).alias("_then"),
            F.max(F.when(slot == end - 1, F.col("kw"))).alias("_last"),
            F.collect_list(F.when(in_base, base)).alias("_base"),
        )
    )
    level = clip(F.col("_now") / (F.col("_then") + 1e-6), 0.6, 1.8)
    every_step = F.sequence(F.lit(1).cast("bigint"), F.lit(steps).cast("bigint"))
    flat = F.transform(every_step, lambda s: F.struct(s.alias("step"), F.col("_last").alias("kw")))
    enough = end > season + 8
    value = F.when(F.col("_enough"), F.col("_b.kw") * F.col("_level")).otherwise(F.col("_b.kw"))
    return (
        stats.select(
            "feeder_id",
            F.col("_end.ts").alias("_newest"),
            enough.alias("_enough"),
            level.alias("_level"),
            F.explode(F.when(enough, F.col("_base")).otherwise(flat)).alias("_b"),
        )
        .select(
            "feeder_id",
            F.col("_b.step").alias("step"),
            slot_time(F.col("_newest"), F.col("_b.step"), p.grain_s).alias("ts"),
            at_least(value, 0.0).alias("kw"),
        )
    )


def forecast_peaks(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("feeder_id").agg(F.max("kw").alias("forecast_peak_kw"))


def system_forecast(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("step", "ts").agg((F.sum("kw") / 1000.0).alias("mw"))


def future_temperature(temperature: DataFrame, p: GridSettings) -> DataFrame:
    """step, temp_c: the same slot yesterday plus the warming from one day to the next.

    ``temperature`` is the regular fleet-wide series (slot, temp_c). Under two days of history the
    warming is 0; with one day or less the last value is repeated.
    """
    season, steps = p.slots_per_day, p.steps_ahead
    slot, slots = F.col("slot"), F.col("_slots")
    counted = temperature.withColumn("_slots", temperature.agg((F.max("slot") + 1).alias("n")).scalar())
    stats = counted.groupBy("_slots").agg(
        F.avg(F.when(slot >= slots - season, F.col("temp_c"))).alias("_today"),
        F.avg(F.when(slot.between(slots - 2 * season, slots - season - 1), F.col("temp_c"))).alias("_yesterday"),
        F.max_by("temp_c", "slot").alias("_last"),
        F.collect_list(
            F.when(slot.between(slots - season, slots - season + steps - 1), F.struct("slot", "temp_c"))
        ).alias("_base"),
    )
    warming = F.when(slots >= 2 * season, F.col("_today") - F.col("_yesterday")).otherwise(0.0)
    every_step = F.sequence(F.lit(1).cast("bigint"), F.lit(steps).cast("bigint"))
    flat = F.transform(every_step, lambda s: F.struct(s.alias("step"), F.col("_last").alias("temp_c")))
    warmed = F.transform(
        "_base",
        lambda e: F.struct(
            (e["slot"] - (F.col("_slots") - season) + 1).alias("step"), (e["temp_c"] + F.col("_warming")).alias("temp_c")
        ),
    )
    return stats.withColumn("_warming", warming).select(
        F.inline(F.when(slots > season, warmed).otherwise(flat))
    )

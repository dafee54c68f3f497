"""Joins of facts with their topology. No side is forced to broadcast: the planner does so only
where the measured size is under its threshold, and large dimensions are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairload.settings import GridSettings


def enriched_readings(
    clean: DataFrame, meters: DataFrame, transformers: DataFrame, feeders: DataFrame, p: GridSettings
) -> DataFrame:
    """Readings with transformer, feeder, substation and average power; unmatched keys stay null."""
    return (
        clean.join(meters.select("meter_id", "transformer_id", "customer_class"), "meter_id", "left")
        .join(transformers.select("transformer_id", "feeder_id", "capacity_kva"), "transformer_id", "left")
        .join(feeders.select("feeder_id", "substation_id"), "feeder_id", "left")
        .withColumn("kw", F.col("kwh") * p.kw_per_kwh)
    )


def enriched_passes(clean: DataFrame, plots: DataFrame, villages: DataFrame) -> DataFrame:
    return clean.join(
        plots.select("plot_id", "village_id", "crop", "area_ha", "irrigation"), "plot_id", "left"
    ).join(villages.select("village_id", "block_id", "district_id", "canal_reach"), "village_id", "left")


def weather_at(times: DataFrame, weather: DataFrame) -> DataFrame:
    """Latest temperature at or before each time, else the earliest one after it.

    ``times`` has one row for each distinct slot, so both series are bounded by the time span: a
    fleet of any size has 35 040 quarter-hour slots a year.
    """
    both = times.select("ts", F.lit(None).cast("double").alias("temp_c"), F.lit(True).alias("_asked")).unionByName(
        weather.select("ts", "temp_c", F.lit(False).alias("_asked"))
    )
    per_time = both.groupBy("ts").agg(F.max("temp_c").alias("temp_c"), F.max("_asked").alias("_asked"))
    order = Window.partitionBy(F.lit(0)).orderBy("ts")
    before = F.last("temp_c", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("temp_c", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = per_time.select("ts", "_asked", F.coalesce(before, after).alias("temp_c"))
    return filled.where("_asked").select("ts", "temp_c")

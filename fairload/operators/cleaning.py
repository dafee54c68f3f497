"""Raw telemetry and satellite passes to trustworthy series, with every fix counted.

Copies of one (entity, slot) are reduced by an aggregate with map-side combine before anything is
keyed by entity. After that step an entity holds at most one row a slot, so the windows by meter
or plot below are bounded by the time span of the data, however unevenly the raw rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairload.functions.ordering import exact_median
from fairload.functions.timegrid import snap
from fairload.settings import AgroSettings, GridSettings


def keep_first(df: DataFrame, keys: list[str], arrival: str, payload: list[str]) -> DataFrame:
    """One row for each key: the payload of the row that arrived first, and the number of copies.

    ``arrival`` is a unique whole number. With one primitive order column and primitive payloads
    this is a hash aggregate; ordering by a struct would make Spark sort every input row.
    """
    firsts = [F.min_by(c, arrival).alias(c) for c in payload]
    return df.groupBy(*keys).agg(*firsts, F.count(F.lit(1)).alias("copies"))


# ---------------------------------------------------------------- meter readings


def reading_slots(readings: DataFrame, p: GridSettings) -> DataFrame:
    """Snap to the grid and drop re-transmissions (the reading that arrived first stays)."""
    snapped = readings.withColumn("slot", snap(F.col("ts"), p.grain_s))
    slots = keep_first(snapped, ["meter_id", "slot"], "reading_id", ["kwh", "voltage"])
    return slots.withColumnRenamed("slot", "ts")


def repaired_kwh(kwh: Column, p: GridSettings) -> Column:
    """Wh reported as kWh."""
    return F.when(kwh > p.unit_error_kwh, kwh / 1000.0).otherwise(kwh)


def plausible_kwh(kwh: Column, p: GridSettings) -> Column:
    """Repaired, and missing where the meter reports an impossible negative."""
    fixed = repaired_kwh(kwh, p)
    return F.when(fixed >= 0, fixed)


def sag_flag(voltage: Column, p: GridSettings) -> Column:
    return F.coalesce((voltage < p.v_sag).cast("int"), F.lit(0))


def known_meters(readings: DataFrame, meters: DataFrame) -> DataFrame:
    return readings.join(meters.select("meter_id"), "meter_id", "left_semi")


def orphan_readings(readings: DataFrame, meters: DataFrame) -> DataFrame:
    return readings.join(meters.select("meter_id"), "meter_id", "left_anti")


def impute_median(readings: DataFrame) -> DataFrame:
    """Fill a missing kwh with the meter's exact median, or 0 if it never reported."""
    median = F.median("kwh").over(Window.partitionBy("meter_id"))
    return readings.withColumn("kwh", F.coalesce("kwh", median, F.lit(0.0)))


def impute_median_approx(readings: DataFrame, accuracy: int = 10000) -> DataFrame:
    """As ``impute_median``, from a fixed-size sketch, for meters with very long histories."""
    sketch = readings.groupBy("meter_id").agg(F.percentile_approx("kwh", 0.5, accuracy).alias("_median"))
    joined = readings.join(sketch, "meter_id")
    return joined.withColumn("kwh", F.coalesce("kwh", "_median", F.lit(0.0))).drop("_median")


def clean_readings(readings: DataFrame, meters: DataFrame, p: GridSettings) -> DataFrame:
    """meter_id, ts, kwh, voltage, is_sag: at most one row for each meter and slot."""
    known = known_meters(reading_slots(readings, p), meters)
    masked = known.withColumn("kwh", plausible_kwh(F.col("kwh"), p))
    return impute_median(masked).select(
        "meter_id", "ts", "kwh", "voltage", sag_flag(F.col("voltage"), p).alias("is_sag")
    )


def grid_ledger(readings: DataFrame, meters: DataFrame, p: GridSettings) -> DataFrame:
    """Counts of every fix, each taken on what the fixes before it left over."""
    return ledger_of_slots(reading_slots(readings, p), meters, p)


def ledger_of_slots(slots: DataFrame, meters: DataFrame, p: GridSettings) -> DataFrame:
    """As ``grid_ledger``, from one row for each meter and slot and its ``copies``."""
    marked = slots.join(meters.select("meter_id", F.lit(True).alias("_known")), "meter_id", "left")
    known = F.coalesce("_known", F.lit(False))
    fixed = repaired_kwh(F.col("kwh"), p)
    return marked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(~known).alias("orphans_removed"),
        F.count_if(known & (F.col("kwh") > p.unit_error_kwh)).alias("unit_errors_fixed"),
        F.count_if(known & (fixed < 0)).alias("negatives_nulled"),
        F.count_if(known & (fixed.isNull() | (fixed < 0))).alias("nulls_imputed"),
        F.count_if(known).alias("rows_clean"),
    )


# ---------------------------------------------------------------- satellite passes


def pass_days(ndvi: DataFrame) -> DataFrame:
    """One pass for each plot and day: the one that arrived first."""
    daily = ndvi.withColumn("date", F.date_trunc("day", "pass_ts"))
    return keep_first(daily, ["plot_id", "date"], "pass_no", ["ndvi", "cloud_flag"])


def repaired_ndvi(ndvi: Column, p: AgroSettings) -> Column:
    """Scaled-integer values."""
    return F.when(ndvi > p.unit_error_ndvi, ndvi / 10000.0).otherwise(ndvi)


def cloud_masked(fixed: Column, cloud_flag: Column, p: AgroSettings) -> Column:
    bad = (cloud_flag == 1) | (fixed < p.ndvi_floor) | (fixed > p.ndvi_ceiling)
    return F.coalesce(bad, F.lit(False))


def masked_passes(ndvi: DataFrame, plots: DataFrame, p: AgroSettings) -> DataFrame:
    """plot_id, date, ndvi with unreliable values missing; passes of unknown plots dropped."""
    known = pass_days(ndvi).join(plots.select("plot_id"), "plot_id", "left_semi")
    fixed = repaired_ndvi(F.col("ndvi"), p)
    good = ~cloud_masked(fixed, F.col("cloud_flag"), p)
    return known.select("plot_id", "date", F.when(good, fixed).alias("ndvi"))


def interpolated(passes: DataFrame) -> DataFrame:
    """Straight line between the nearest good passes by position, edges held."""
    order = Window.partitionBy("plot_id").orderBy("date")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = passes.withColumn("_at", F.row_number().over(order))
    point = F.when(F.col("ndvi").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("ndvi").alias("v")))
    bracketed = placed.withColumn("_point", point).select(
        "plot_id",
        "date",
        "ndvi",
        "_at",
        F.last("_point", ignorenulls=True).over(back).alias("_prev"),
        F.first("_point", ignorenulls=True).over(ahead).alias("_next"),
    )
    share = (F.col("_at") - F.col("_prev.at")) / (F.col("_next.at") - F.col("_prev.at"))
    between = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    inner = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    filled = F.coalesce(
        F.col("ndvi"), F.when(inner, between), F.col("_prev.v"), F.col("_next.v")
    )
    return bracketed.select("plot_id", "date", filled.alias("ndvi"))


def with_smooth(lines: DataFrame) -> DataFrame:
    """Centred three-pass mean beside the filled value."""
    near = Window.partitionBy("plot_id").orderBy("date").rowsBetween(-1, 1)
    return lines.withColumn("ndvi_smooth", F.avg("ndvi").over(near))


def fill_silent_plots(lines: DataFrame) -> DataFrame:
    """A plot with no good pass at all takes the median of everything that was filled.

    Only such plots still have missing values after interpolation.
    """
    fleet = exact_median(lines.select("ndvi"), "ndvi", bounds=(0.0, 1.0)).scalar()
    filled = lines.withColumn("_fleet", fleet)
    values = [c for c in ("ndvi", "ndvi_smooth") if c in lines.columns]
    return filled.withColumns({c: F.coalesce(c, "_fleet") for c in values}).drop("_fleet")


def gap_filled(passes: DataFrame) -> DataFrame:
    return fill_silent_plots(interpolated(passes))


def clean_passes(ndvi: DataFrame, plots: DataFrame, p: AgroSettings) -> DataFrame:
    """plot_id, date, ndvi, ndvi_smooth. Filling and smoothing share one shuffle and sort by plot."""
    return fill_silent_plots(with_smooth(interpolated(masked_passes(ndvi, plots, p))))


def agro_ledger(ndvi: DataFrame, plots: DataFrame, p: AgroSettings) -> DataFrame:
    days = pass_days(ndvi)
    marked = days.join(plots.select("plot_id", F.lit(True).alias("_known")), "plot_id", "left")
    known = F.coalesce("_known", F.lit(False))
    fixed = repaired_ndvi(F.col("ndvi"), p)
    bad = cloud_masked(fixed, F.col("cloud_flag"), p)
    return marked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_passes_removed"),
        F.count_if(~known).alias("orphan_plots_removed"),
        F.count_if(known & (F.col("ndvi") > p.unit_error_ndvi)).alias("unit_errors_fixed"),
        F.count_if(known & bad).alias("cloud_masked"),
        F.count_if(known & (bad | fixed.isNull())).alias("gaps_filled"),
        F.count_if(known).alias("rows_clean"),
    )

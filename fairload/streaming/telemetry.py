"""Meter telemetry as a stream: micro-batches of landed files through the batch operators.

Rows later than the watermark are dropped, and an interval is emitted once the watermark has
passed its end. State is kept by (interval, meter) and (interval, unit) only, so it is bounded by
what arrives within the watermark delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fairload.functions.timegrid import snap
from fairload.operators import cleaning, features, scoring
from fairload.operators.rollup import TX_KEYS, loading
from fairload.session import fresh_dir, staged
from fairload.settings import GridSettings

LATE = "45 minutes"


def landed_files(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Files of a landing folder as a stream, a bounded number for each micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def on_grid(readings: DataFrame, p: GridSettings, late: str = LATE) -> DataFrame:
    return readings.withColumn("slot", snap(F.col("ts"), p.grain_s)).withWatermark("slot", late)


def deduplicated(readings: DataFrame, p: GridSettings, late: str = LATE) -> DataFrame:
    """One reading for each meter and slot, state kept for the watermark delay only."""
    return on_grid(readings, p, late).dropDuplicatesWithinWatermark(["meter_id", "slot"])


def first_readings(readings: DataFrame, p: GridSettings, late: str = LATE) -> DataFrame:
    """As ``deduplicated``, but which copy stays does not depend on the order of arrival."""
    window = F.window("slot", f"{p.grain_s} seconds").alias("slot_window")
    return on_grid(readings, p, late).groupBy(window, "meter_id").agg(
        F.min_by("kwh", "reading_id").alias("kwh"), F.min_by("voltage", "reading_id").alias("voltage")
    )


def usable_readings(
    readings: DataFrame, meters: DataFrame, units: DataFrame, p: GridSettings, late: str = LATE
) -> DataFrame:
    """Closed slots of known meters as power, with the columns of their transformers in ``units``. Missing or
    impossible readings add nothing: a median over the meter's history is not known within a micro-batch.

    The planner sizes a stream by the new input of a micro-batch. When a batch only closes intervals it has none, and
    all rows that leave the state would be broadcast; so the stream meets the joined static tables in one merge join.
    """
    usable = first_readings(readings, p, late).select(
        F.window_time("slot_window").alias("at"),
        "meter_id",
        (F.coalesce(cleaning.plausible_kwh(F.col("kwh"), p), F.lit(0.0)) * p.kw_per_kwh).alias("kw"),
        cleaning.sag_flag(F.col("voltage"), p).alias("is_sag"),
    )
    places = meters.select("meter_id", "transformer_id").join(units, "transformer_id")
    return usable.join(places.hint("merge"), "meter_id")


def transformer_load(
    readings: DataFrame, meters: DataFrame, transformers: DataFrame, p: GridSettings, late: str = LATE
) -> DataFrame:
    """Closed intervals of transformer load, the topology joined as static tables."""
    placed = usable_readings(readings, meters, transformers.select(*TX_KEYS), p, late)
    window = F.window("at", f"{p.grain_s} seconds").alias("w")
    summed = placed.groupBy(window, *TX_KEYS).agg(
        F.sum("kw").alias("kw"), F.sum("is_sag").alias("sags"), F.count(F.lit(1)).alias("n_meters")
    )
    return summed.select(
        *TX_KEYS,
        F.col("w.start").alias("ts"),
        "kw",
        "sags",
        "n_meters",
        loading(F.col("kw"), F.col("capacity_kva"), p).alias("loading"),
    )


def feeder_load(
    readings: DataFrame, meters: DataFrame, transformers: DataFrame, p: GridSettings, late: str = LATE
) -> DataFrame:
    placed = usable_readings(readings, meters, transformers.select("transformer_id", "feeder_id"), p, late)
    summed = placed.groupBy(F.window("at", f"{p.grain_s} seconds").alias("w"), "feeder_id").agg(
        F.sum("kw").alias("kw"), F.sum("is_sag").alias("sags")
    )
    return summed.select("feeder_id", F.col("w.start").alias("ts"), "kw", "sags")


# ---------------------------------------------------------------- sinks


def run_to_table(
    stream: DataFrame, label: str, out: str | None = None, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Process all that has landed, append to a table, and return the table."""
    spark = stream.sparkSession
    folder = out or fresh_dir(spark, label)
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*partition_by)
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_each_batch(
    stream: DataFrame, label: str, work: Callable[[DataFrame, int], DataFrame], columns: str, out: str | None = None
) -> DataFrame:
    """Apply a batch function to every micro-batch. A batch replaces its own folder, so one that is
    tried again after a failure does not count twice."""
    spark = stream.sparkSession
    folder = out or fresh_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id).write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(f"{columns}, batch_id bigint").parquet(f"{folder}/table")


LEDGER = (
    "rows_in bigint, duplicates_removed bigint, orphans_removed bigint, unit_errors_fixed bigint, negatives_nulled bigint, "
    "nulls_imputed bigint, rows_clean bigint"
)


def batch_ledgers(readings: DataFrame, meters: DataFrame, p: GridSettings, out: str | None = None) -> DataFrame:
    """The data-quality ledger of every micro-batch; the ledgers add up to that of all readings.

    A reading sent again in a later batch counts as a duplicate there: each batch looks up its slots among
    those of earlier batches, which are kept by day, so only the days of the batch are read.
    """
    spark = readings.sparkSession
    folder = f"{out}/seen" if out else fresh_dir(spark, "ledger-seen")
    seen_schema = "batch_id bigint, day date, meter_id " + dict(meters.dtypes)["meter_id"] + ", ts timestamp"

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        slots = staged(cleaning.reading_slots(batch, p).withColumn("day", F.to_date("ts")), "ledger-batch")
        slots.select("day", "meter_id", "ts").write.mode("overwrite").partitionBy("day").parquet(
            f"{folder}/batch_id={batch_id}"
        )  # replaced if the batch is tried again
        days = [r["day"] for r in slots.select("day").distinct().collect()]  # the days of one batch
        before = (
            spark.read.schema(seen_schema)
            .parquet(folder)
            .where((F.col("batch_id") < batch_id) & F.col("day").isin(days))
            .select("meter_id", "ts", F.lit(True).alias("again"))
        )
        marked = slots.drop("day").join(before, ["meter_id", "ts"], "left")
        fresh = marked.where(F.col("again").isNull()).drop("again")
        repeats = marked.where("again").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).scalar()
        counted = cleaning.ledger_of_slots(fresh, meters, p)
        return counted.withColumns({c: F.col(c) + repeats for c in ("rows_in", "duplicates_removed")})

    return run_each_batch(readings, "ledger", work, LEDGER, out)


STRESS = (
    "transformer_id bigint, feeder_id bigint, loading_mean double, loading_max double, overload_minutes double, "
    "sag_count bigint, thermal_stress double, kw_now double, p_fail_72h double"
)


def rescored(intervals: DataFrame, history: Callable[[], DataFrame], transformers: DataFrame) -> DataFrame:
    """Sliding 24 h stress and risk after every micro-batch of closed intervals.

    A 24 h window sliding by 15 minutes would copy each row 96 times. Instead each batch names the
    newest interval, and only the trailing day of the interval table (``history``) is read again; a table that
    is partitioned by ``day`` opens two days of files for it.
    """

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        newest = batch.agg(F.max("ts").alias("t")).scalar()
        table = history()
        if "day" in table.columns:
            table = table.where(F.col("day") >= F.to_date(newest - F.expr("interval 24 hours"))).drop("day")
        recent = table.where(F.col("ts") > newest - F.expr("interval 24 hours")).where(F.col("ts") <= newest)
        scores = scoring.score_transformers(features.transformer_stress(recent), transformers)
        return scores.select(*[c.split()[0] for c in STRESS.split(", ")])

    return run_each_batch(intervals, "rescore", work, STRESS)

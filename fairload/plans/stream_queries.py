"""Streaming queries over the test tables: each runs a stream until all input is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairload.plans.queries import query
from fairload.session import fresh_dir
from fairload.settings import GridSettings
from fairload.sources.mapping import TEXTS, logical_tables, source_schema
from fairload.streaming import telemetry

SETTINGS = GridSettings()


def readings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All landed readings: a stream over the files of the events table."""
    schema = source_schema(spark, f"{sf_dir}/events.parquet")
    events = telemetry.landed_files(spark, sf_dir, schema, "events.parquet")
    return spark.sql(TEXTS["readings"], events=events)


@query("stream_dedupe", "meter_id ts")
def _(spark, d):
    logical_tables(spark, d)
    unique = telemetry.deduplicated(readings_stream(spark, d), SETTINGS)
    return telemetry.run_to_table(unique.select("meter_id", F.col("slot").alias("ts")), "stream_dedupe")


@query("stream_feeder_load", "feeder_id ts kw sags")
def _(spark, d):
    t = logical_tables(spark, d)
    load = telemetry.feeder_load(readings_stream(spark, d), t["meters"], t["transformers"], SETTINGS)
    return telemetry.run_to_table(load, "stream_feeder_load")


def _intervals(spark, d):
    t = logical_tables(spark, d)
    load = telemetry.transformer_load(readings_stream(spark, d), t["meters"], t["transformers"], SETTINGS)
    folder = fresh_dir(spark, "stream_tx_load")
    table = telemetry.run_to_table(load.withColumn("day", F.to_date("ts")), "stream_tx_load", folder, ("day",))
    return t, table, f"{folder}/table"


@query("stream_tx_load", "transformer_id feeder_id capacity_kva ts kw sags n_meters loading")
def _(spark, d):
    return _intervals(spark, d)[1]


@query("stream_sliding_stress", "transformer_id feeder_id loading_mean loading_max overload_minutes sag_count thermal_stress kw_now p_fail_72h")
def _(spark, d):
    t, table, path = _intervals(spark, d)
    closed = spark.readStream.schema(table.schema).parquet(path)
    return telemetry.rescored(closed, lambda: table, t["transformers"])


@query("stream_quality_ledger", "rows_in duplicates_removed orphans_removed unit_errors_fixed negatives_nulled nulls_imputed rows_clean")
def _(spark, d):
    t = logical_tables(spark, d)
    ledgers = telemetry.batch_ledgers(readings_stream(spark, d), t["meters"], SETTINGS)
    return ledgers.agg(*[F.sum(c).alias(c) for c in ledgers.columns if c != "batch_id"])

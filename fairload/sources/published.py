"""Result sets: nested JSON records for services, flat tables for a warehouse, backfill tables."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairload.operators import rollup
from fairload.settings import GridSettings

if TYPE_CHECKING:
    from fairload.plans.agro import AgroPlan
    from fairload.plans.grid import GridPlan

NESTED = "array<struct<feature string, contribution double, value double>>"
RESULT_DDL = {
    "feeders": "rank bigint, feeder_id bigint, name string, substation_id bigint, lat double, lon double, fci double, "
    "components struct<forecast_stress double, tx_risk double, utilization double, volatility double>, reason_codes array<string>, "
    "current_mw double, forecast_peak_mw double, capacity_mw double, headroom_mw double, sheddable_mw double, pain_score double, "
    "is_protected boolean, critical_type string, shed_hours_30d double, complaints_30d int, customers bigint, tx_high_risk bigint, "
    "utilization_now double, recent_mw array<double>, forecast_mw array<double>",
    "transformers": "transformer_id bigint, feeder_id bigint, p_fail_72h double, loading_max double, loading_mean double, "
    "overload_minutes double, sag_count bigint, age_years int, capacity_kva int, lat double, lon double, reason_codes array<string>, "
    f"contributions {NESTED}",
    "feeder_state": "feeder_id bigint, name string, sheddable_mw double, pain_score double, shed_hours_30d double, "
    "is_protected boolean, critical_type string, rank bigint",
    "villages": "rank bigint, village_id bigint, name string, district_id bigint, block_id bigint, canal_reach string, lat double, "
    "lon double, vapi double, components struct<loss_risk double, yield_shortfall double, ndvi_decline double, exposure double>, "
    "reason_codes array<string>, p_loss double, yield_pred double, normal_yield double, yield_shortfall_frac double, "
    "insurance_trigger int, trigger_score double, water_deficit double, area_ha double, plots bigint, rainfed_frac double, "
    "past_support_index double, yield_saveable_t double, water_need_ml double, ndvi_trend double, recent_ndvi array<double>, "
    f"contributions {NESTED}",
    "village_state": "village_id bigint, name string, yield_saveable_t double, water_need_ml double, past_support_index double, "
    "canal_reach string, p_loss double",
}
RESULT_DDL["triggers"] = RESULT_DDL["villages"]


def write_backfill(
    readings: DataFrame, meters: DataFrame, transformers: DataFrame, out: str, p: GridSettings
) -> None:
    """Both history tables; the daily one is built from the written interval table, so the readings
    are scanned once."""
    rollup.backfill_transformer_interval(readings, meters, transformers, p).write.mode("overwrite").parquet(
        f"{out}/tx_interval"
    )
    intervals = readings.sparkSession.read.parquet(f"{out}/tx_interval")
    rollup.feeder_daily(intervals).write.mode("overwrite").partitionBy("d").parquet(f"{out}/feeder_daily")


def system_record(plan: GridPlan) -> DataFrame:
    """The one-row system record: scalars, the last 96 points of load, and the forecast."""
    recent = rollup.latest_points(plan.system_load, 96).agg(F.array_sort(F.collect_list(F.struct("ts", "mw"))).alias("v"))
    ahead = plan.system_forecast.agg(F.array_sort(F.collect_list(F.struct("ts", "mw"))).alias("v"))
    warmth = rollup.latest_points(plan.tables["weather"].select("ts", "temp_c"), 192, every=4)
    coming = plan.future_temperature.select("step", "temp_c")
    return plan.summary.withColumns(
        {
            "risk_model_auc": _auc(plan.risk_auc),
            "data_quality": _ledger(plan.ledger),
            "system_load": recent.scalar(),
            "system_forecast": ahead.scalar(),
            "temperature": warmth.agg(F.array_sort(F.collect_list(F.struct("ts", "temp_c")))).scalar(),
            "future_temperature": coming.agg(F.array_sort(F.collect_list(F.struct("step", "temp_c")))).scalar(),
        }
    )


def _auc(held: DataFrame) -> Column:
    return held.select(F.round("auc", 4)).scalar()


def _ledger(ledger: DataFrame) -> Column:
    return ledger.select(F.struct("*")).scalar()


def agro_record(plan: AgroPlan) -> DataFrame:
    """The one-row system record: scalars, hold-out AUC, ledger, vegetation and rain by date (one entry a day)."""
    point = F.struct("date", F.round("value", 3).alias("value"))
    curve = lambda kind: plan.region_series.where(F.col("kind") == kind).agg(
        F.array_sort(F.collect_list(point))
    ).scalar()
    return plan.summary.withColumns(
        {
            "risk_model_auc": _auc(plan.loss_auc),
            "data_quality": _ledger(plan.ledger),
            "ndvi_curve": curve("ndvi"),
            "rain_curve": curve("rain"),
        }
    )


def write_grid_results(plan: GridPlan, out: str) -> None:
    plan.feeder_cards.write.mode("overwrite").json(f"{out}/feeders.json", ignoreNullFields=False)
    plan.watchlist().write.mode("overwrite").json(f"{out}/transformers.json", ignoreNullFields=False)
    plan.state.write.mode("overwrite").json(f"{out}/feeder_state.json", ignoreNullFields=False)
    system_record(plan).write.mode("overwrite").json(f"{out}/system.json", ignoreNullFields=False)


def write_agro_results(plan: AgroPlan, out: str) -> None:
    plan.village_cards.write.mode("overwrite").json(f"{out}/villages.json", ignoreNullFields=False)
    plan.triggers().write.mode("overwrite").json(f"{out}/triggers.json", ignoreNullFields=False)
    plan.state.write.mode("overwrite").json(f"{out}/village_state.json", ignoreNullFields=False)
    agro_record(plan).write.mode("overwrite").json(f"{out}/system.json", ignoreNullFields=False)


def write_plans(report: DataFrame, members: DataFrame, out: str) -> None:
    """The best plans, and their members as rows: a plan may have very many."""
    report.write.mode("overwrite").json(f"{out}/plans.json", ignoreNullFields=False)
    chosen = members.drop("place", "thresholds").join(
        report.select("scenario_id", "plan_id", "place"), ["scenario_id", "plan_id"]
    )
    chosen.write.mode("overwrite").json(f"{out}/plan_members.json", ignoreNullFields=False)


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A published result set with its declared schema."""
    return spark.read.schema(RESULT_DDL[name]).json(f"{folder}/{name}.json")


def flat_feeder_scores(cards: DataFrame) -> DataFrame:
    """Codes as text; nested columns left out."""
    return cards.drop("components", "recent_mw", "forecast_mw").withColumn(
        "reason_codes", F.array_join("reason_codes", ", ")
    )


def flat_transformer_scores(watchlist: DataFrame) -> DataFrame:
    return watchlist.drop("contributions").withColumn("reason_codes", F.array_join("reason_codes", ", "))


def publish_scores(cards: DataFrame, watchlist: DataFrame, database: str) -> None:
    """Replace the two score tables of the warehouse."""
    cards.sparkSession.sql(f"create database if not exists {database}")
    flat_feeder_scores(cards).write.mode("overwrite").saveAsTable(f"{database}.feeder_scores")
    flat_transformer_scores(watchlist).write.mode("overwrite").saveAsTable(f"{database}.transformer_scores")

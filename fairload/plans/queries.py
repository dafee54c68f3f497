"""Named queries over the test tables: one for each operator or report.

Each takes (spark, folder of the test tables) and returns a DataFrame over whole tables. Results
show doubles to six decimals, whole numbers as bigint and times without a zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType, TimestampType

from fairload.functions.numeric import rounded
from fairload.functions.ordering import auc
from fairload.operators import cleaning, features, plansearch, rollup, scoring, serving
from fairload.plans.agro import AgroPlan
from fairload.plans.grid import GridPlan
from fairload.session import fresh_dir, staged
from fairload.settings import GridSettings
from fairload.sources import published
from fairload.sources.mapping import logical_tables
from fairload.sources.tables import read_table, save_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRAIN = 21600  # test readings are about two a day for each meter
SHED_ASKED = [(1, 0.4), (2, 1.2), (3, 5.0)]  # MW
WATER_ASKED = [(1, 0.8), (2, 4.0), (3, 12.5)]  # ML
SHED = plansearch.Search()
WATER = plansearch.Search(fairness_w=0.35)


def present(df: DataFrame, columns: str) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    out = []
    for name in columns.split():
        c, kind = F.col(name), types[name]
        if isinstance(kind, (DoubleType, FloatType)):
            c = rounded(c)
        elif isinstance(kind, (IntegerType, ShortType, ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, columns: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(build(spark, sf_dir), columns)
        return build

    return register


def grid(spark: SparkSession, sf_dir: str, grain: int = 900, stage=None) -> GridPlan:
    plan = GridPlan(logical_tables(spark, sf_dir), GridSettings(grain_s=grain))
    if stage:
        plan.stage = stage
    return plan


def scored_grid(spark: SparkSession, sf_dir: str) -> GridPlan:
    return grid(spark, sf_dir, GRAIN, staged)


def agro(spark: SparkSession, sf_dir: str, stage=None) -> AgroPlan:
    plan = AgroPlan(logical_tables(spark, sf_dir))
    if stage:
        plan.stage = stage
    return plan


def joined(codes: str = "reason_codes"):
    return F.array_join(codes, ", ").alias("reason_codes")


# ---------------------------------------------------------------- grid telemetry


@query("snap_dedupe_readings", "meter_id ts kwh voltage copies")
def _(spark, d):
    g = grid(spark, d)
    return cleaning.reading_slots(g.tables["readings"], g.p)


@query("orphan_readings", "meter_id ts copies")
def _(spark, d):
    g = grid(spark, d)
    return cleaning.orphan_readings(cleaning.reading_slots(g.tables["readings"], g.p), g.tables["meters"])


@query("valid_readings", "meter_id ts kwh voltage")
def _(spark, d):
    g = grid(spark, d)
    return cleaning.known_meters(cleaning.reading_slots(g.tables["readings"], g.p), g.tables["meters"])


@query("unit_repair", "meter_id ts raw_kwh kwh")
def _(spark, d):
    g = grid(spark, d)
    known = cleaning.known_meters(cleaning.reading_slots(g.tables["readings"], g.p), g.tables["meters"])
    return known.select("meter_id", "ts", F.col("kwh").alias("raw_kwh"), cleaning.repaired_kwh(F.col("kwh"), g.p).alias("kwh"))


@query("negative_null", "meter_id ts kwh")
def _(spark, d):
    g = grid(spark, d)
    known = cleaning.known_meters(cleaning.reading_slots(g.tables["readings"], g.p), g.tables["meters"])
    return known.withColumn("kwh", cleaning.plausible_kwh(F.col("kwh"), g.p))


@query("median_impute", "meter_id ts kwh")
def _(spark, d):
    return grid(spark, d).clean


@query("sag_flags", "meter_id ts voltage is_sag")
def _(spark, d):
    return grid(spark, d).clean


@query("grid_quality_ledger", "rows_in duplicates_removed orphans_removed unit_errors_fixed negatives_nulled nulls_imputed rows_clean")
def _(spark, d):
    return grid(spark, d).ledger


@query("enriched_readings", "meter_id ts kwh voltage is_sag transformer_id customer_class feeder_id capacity_kva substation_id kw")
def _(spark, d):
    return grid(spark, d).enriched


@query("tx_interval_load", "transformer_id feeder_id capacity_kva ts kw sags n_meters loading")
def _(spark, d):
    return grid(spark, d).tx_int


@query("feeder_interval_load", "feeder_id ts kw sags capacity_kw")
def _(spark, d):
    return grid(spark, d).fd_int


@query("backfill_tx_interval", "transformer_id feeder_id capacity_kva ts kw sags loading")
def _(spark, d):
    g = grid(spark, d)
    t = g.tables
    return rollup.backfill_transformer_interval(t["readings"], t["meters"], t["transformers"], g.p)


@query("feeder_daily", "feeder_id d peak_kw mean_kw overload_minutes sags")
def _(spark, d):
    g = grid(spark, d)
    t = g.tables
    return rollup.feeder_daily(rollup.backfill_transformer_interval(t["readings"], t["meters"], t["transformers"], g.p))


@query("feeder_daily_backfill_table", "feeder_id d peak_kw mean_kw overload_minutes sags")
def _(spark, d):
    g = grid(spark, d)
    t = g.tables
    folder = fresh_dir(spark, "backfill")
    published.write_backfill(t["readings"], t["meters"], t["transformers"], folder, g.p)
    return spark.read.parquet(f"{folder}/feeder_daily")


@query("curated_feeder_load_view", "feeder_id ts kw")
def _(spark, d):
    t = logical_tables(spark, d)
    return rollup.curated_feeder_load(t["readings"], t["meters"], t["transformers"], GridSettings())


# ---------------------------------------------------------------- grid features


@query("tx_stress_24h", "transformer_id feeder_id loading_mean loading_max overload_minutes sag_count thermal_stress kw_now")
def _(spark, d):
    return grid(spark, d).tx_stress


@query(
    "feeder_profile_24h",
    "feeder_id peak_kw_24h mean_kw_24h std_kw_24h sag_rate capacity_kw kw_now load_factor volatility utilization_now",
)
def _(spark, d):
    return grid(spark, d).profile


@query("feeder_rolling_2h", "feeder_id ts kw roll_mean_2h")
def _(spark, d):
    g = grid(spark, d)
    return features.rolling_load(g.fd_int, g.p)


@query("customer_mix", "feeder_id residential commercial industrial customers")
def _(spark, d):
    return grid(spark, d).mix


@query("load_matrix", "feeder_id day slot_0 slot_1 slot_2 slot_3")
def _(spark, d):
    g = grid(spark, d, GRAIN)
    of_day = F.pmod("slot", F.lit(g.p.slots_per_day))
    cells = g.load_grid.select("feeder_id", F.floor(F.col("slot") / g.p.slots_per_day).alias("day"), F.concat(F.lit("slot_"), of_day).alias("_c"), "kw")
    names = [f"slot_{i}" for i in range(g.p.slots_per_day)]
    return cells.groupBy("feeder_id", "day").pivot("_c", names).agg(F.sum("kw"))


@query("load_lags", "feeder_id slot ts kw lag_1 lag_2 lag_3 lag_4 lag_day recent_mean")
def _(spark, d):
    g = grid(spark, d, GRAIN)
    return features.load_lags(g.load_grid, g.p)


@query("load_features", "feeder_id slot ts kw lag_1 lag_2 lag_3 lag_4 lag_day recent_mean temp_c hod_sin hod_cos")
def _(spark, d):
    return grid(spark, d, GRAIN, staged).load_features


@query("weather_asof", "slot ts temp_c")
def _(spark, d):
    return grid(spark, d, GRAIN).temperature


@query("heat_load_multiplier", "ts temp_c heat_multiplier")
def _(spark, d):
    weather = logical_tables(spark, d)["weather"]
    return weather.withColumn("heat_multiplier", features.heat_multiplier(F.col("temp_c")))


# ---------------------------------------------------------------- forecast


@query("seasonal_naive_forecast", "feeder_id step ts kw")
def _(spark, d):
    return grid(spark, d, GRAIN, staged).forecast


@query("forecast_peaks", "feeder_id forecast_peak_kw")
def _(spark, d):
    from fairload.operators.forecast import forecast_peaks

    return forecast_peaks(grid(spark, d, GRAIN, staged).forecast)


@query("system_forecast", "step ts mw")
def _(spark, d):
    return grid(spark, d, GRAIN, staged).system_forecast


@query("future_temperature", "step temp_c")
def _(spark, d):
    return grid(spark, d, GRAIN, staged).future_temperature


# ---------------------------------------------------------------- grid scores


@query("transformer_scored", "transformer_id feeder_id age_years capacity_kva loading_max p_fail_72h reason_codes")
def _(spark, d):
    scores = grid(spark, d, GRAIN).tx_scores
    return scores.withColumn("reason_codes", joined())


@query("risk_contributions", "transformer_id pos feature contribution value")
def _(spark, d):
    scores = grid(spark, d, GRAIN).tx_scores
    return scores.select("transformer_id", F.posexplode("factors").alias("pos", "_f")).select(
        "transformer_id", (F.col("pos") + 1).alias("pos"), "_f.feature", "_f.contribution", "_f.value"
    )


@query("tx_risk_rollup", "feeder_id tx_risk_max tx_risk_mean tx_high_risk")
def _(spark, d):
    return scoring.risk_by_feeder(grid(spark, d, GRAIN).tx_scores)


@query(
    "feeder_score_assembly",
    "feeder_id name substation_id critical_type is_protected kw_now capacity_kw sag_rate volatility utilization_now tx_risk_max "
    "tx_risk_mean tx_high_risk forecast_peak_kw residential commercial industrial customers shed_hours_30d complaints_30d",
)
def _(spark, d):
    return scored_grid(spark, d).assembled


@query("fci_ranking", "rank feeder_id fci c_forecast_stress c_tx_risk c_utilization c_volatility")
def _(spark, d):
    return scored_grid(spark, d).ranked


@query("pain_score", "feeder_id is_protected pain_score sheddable_mw headroom_mw")
def _(spark, d):
    return scored_grid(spark, d).scored


@query("grid_reason_codes", "feeder_id reason_codes")
def _(spark, d):
    return scored_grid(spark, d).scored.withColumn("reason_codes", joined())


@query("severity_bands", "feeder_id fci severity list_severity")
def _(spark, d):
    scored = scored_grid(spark, d).scored
    return scored.select(
        "feeder_id",
        "fci",
        scoring.severity(F.col("fci"), 0.8, 0.5).alias("severity"),
        scoring.severity(F.col("fci"), 0.66, 0.4).alias("list_severity"),
    )


SUMMARY = "current_mw forecast_peak_mw capacity_mw supply_cap_mw deficit_mw temp_now_c feeders protected_feeders tx_watchlist"


@query("grid_system_summary", SUMMARY)
def _(spark, d):
    return scored_grid(spark, d).summary


@query("system_load_series", "ts mw")
def _(spark, d):
    return rollup.latest_points(grid(spark, d).system_load, 96)


@query("temperature_series", "ts temp_c")
def _(spark, d):
    return rollup.latest_points(logical_tables(spark, d)["weather"].select("ts", "temp_c"), 192, every=4)


@query("risk_auc", "positives negatives auc")
def _(spark, d):
    history = logical_tables(spark, d)["tx_history"]
    return auc(scoring.history_scores(history), "failed_next72h", "p", bounds=(0.0, 1.0))


@query("hash_split_auc", "part positives negatives auc")
def _(spark, d):
    history = scoring.history_scores(logical_tables(spark, d)["tx_history"])
    part = F.when(scoring.held_out(F.col("row_key")), "holdout").otherwise("train")
    return auc(history.withColumn("part", part), "failed_next72h", "p", by=["part"], bounds=(0.0, 1.0))


# ---------------------------------------------------------------- agro passes


@query("agro_quality_ledger", "rows_in duplicate_passes_removed orphan_plots_removed unit_errors_fixed cloud_masked gaps_filled rows_clean")
def _(spark, d):
    return agro(spark, d).ledger


@query("ndvi_clean", "plot_id date ndvi")
def _(spark, d):
    a = agro(spark, d)
    return cleaning.masked_passes(a.tables["ndvi"], a.tables["plots"], a.p)


@query("ndvi_gapfill", "plot_id date ndvi")
def _(spark, d):
    a = agro(spark, d)
    return cleaning.gap_filled(cleaning.masked_passes(a.tables["ndvi"], a.tables["plots"], a.p))


@query("ndvi_smooth", "plot_id date ndvi ndvi_smooth")
def _(spark, d):
    return agro(spark, d).clean


@query("enriched_plots", "plot_id date ndvi_smooth village_id crop area_ha irrigation block_id district_id canal_reach")
def _(spark, d):
    return agro(spark, d).enriched


@query("plot_season", "plot_id village_id crop area_ha irrigation canal_reach block_id peak_ndvi mean_ndvi integ_ndvi last_ndvi")
def _(spark, d):
    return agro(spark, d).plot_season


@query("village_date_ndvi", "village_id date ndvi")
def _(spark, d):
    return agro(spark, d).village_date


@query("block_weather", "block_id gdd_total rain_total rain_repro dry_days_repro")
def _(spark, d):
    return agro(spark, d).block_weather


@query("cumulative_gdd", "block_id date gdd_cum rain_cum")
def _(spark, d):
    a = agro(spark, d)
    return rollup.cumulative_weather(a.tables["block_weather"], a.p)


@query("ndvi_trend", "village_id ndvi_trend")
def _(spark, d):
    return features.ndvi_trend(agro(spark, d).village_date)


@query(
    "village_features",
    "village_id block_id district_id name canal_reach peak_ndvi mean_ndvi integ_ndvi last_ndvi area_ha plots rainfed_frac ndvi_trend "
    "gdd_total rain_total rain_repro dry_days_repro past_support_index gdd_frac water_deficit",
)
def _(spark, d):
    a = agro(spark, d, staged)
    return a.village_features


@query("expected_ndvi_anomaly", "plot_id date ndvi ndvi_expected ndvi_anomaly")
def _(spark, d):
    a = agro(spark, d)
    gdd = rollup.cumulative_weather(a.tables["block_weather"], a.p)
    return features.expected_ndvi(a.clean, a.tables["plots"], a.tables["villages"], gdd)


@query("water_stress_index", "plot_id village_id area_ha water_stress")
def _(spark, d):
    return agro(spark, d).water_stress


@query("loss_labels", "village_id season yield_t_ha normal_yield loss_event")
def _(spark, d):
    return features.loss_labels(logical_tables(spark, d)["yield_history"])


@query("village_season_history", "village_id season peak_ndvi integ_ndvi water_stress gdd_frac area_ha")
def _(spark, d):
    a = agro(spark, d)
    return features.season_history(a.plot_season, a.water_stress, a.block_weather, 2024, a.p)


@query("region_series", "kind date value")
def _(spark, d):
    return agro(spark, d).region_series


# ---------------------------------------------------------------- agro scores


@query("village_scored", "village_id p_loss yield_pred model_codes")
def _(spark, d):
    scores = agro(spark, d, staged).village_scores
    return scores.withColumn("model_codes", F.array_join("model_codes", ", "))


@query("normal_yield", "village_id yield_pred normal_yield")
def _(spark, d):
    return agro(spark, d, staged).with_normal


@query("vapi_ranking", "rank village_id vapi c_loss_risk c_yield_shortfall c_ndvi_decline c_exposure")
def _(spark, d):
    return agro(spark, d, staged).ranked


@query("insurance_triggers", "village_id yield_trigger rain_trigger insurance_trigger trigger_score yield_saveable_t water_need_ml yield_shortfall_frac")
def _(spark, d):
    return agro(spark, d, staged).scored


@query("agro_reason_codes", "village_id reason_codes")
def _(spark, d):
    return agro(spark, d, staged).scored.withColumn("reason_codes", joined())


@query("village_severity", "village_id vapi severity")
def _(spark, d):
    scored = agro(spark, d, staged).scored
    return scored.withColumn("severity", scoring.severity(F.col("vapi"), 0.6, 0.38))


AGRO_SUMMARY = (
    "villages plots_total total_area_ha at_risk_area_ha at_risk_pct insurance_triggers mean_yield_pred mean_normal_yield "
    "yield_saveable_total_t water_need_total_ml tail_villages"
)


@query("agro_system_summary", AGRO_SUMMARY)
def _(spark, d):
    return agro(spark, d, staged).summary


# ---------------------------------------------------------------- plan search


def shed_inputs(spark, d):
    g = scored_grid(spark, d)
    return g, g.shed_units(SHED_ASKED, SHED)


def shed_best(units):
    return staged(plansearch.best_plans(plansearch.shed_plans(units, SHED), 8 * SHED.top_k), "shed_best")


@query("shed_eligible", "scenario_id target_mw feeder_id name rank mw pain shed_hours_30d fair")
def _(spark, d):
    return shed_inputs(spark, d)[1].withColumnRenamed("unit_id", "feeder_id")


@query("shed_greedy_plan", "scenario_id target_mw feeder_id mw pain fair")
def _(spark, d):
    units = shed_inputs(spark, d)[1]
    return plansearch.shed_greedy(units, SHED).withColumnRenamed("unit_id", "feeder_id")


@query("shed_candidates_topk", "scenario_id place plan_id n_members relief_mw pain_total fairness_penalty score")
def _(spark, d):
    best = plansearch.best_plans(plansearch.shed_plans(shed_inputs(spark, d)[1], SHED), 8 * SHED.top_k)
    return best.select(
        "scenario_id", "place", "plan_id", "n_members", F.col("mw").alias("relief_mw"), F.col("pain").alias("pain_total"),
        F.col("fair").alias("fairness_penalty"), "score",
    )


@query("shed_plan_members", "scenario_id plan_id place feeder_id name mw pain")
def _(spark, d):
    units = shed_inputs(spark, d)[1]
    best = shed_best(units)
    members = plansearch.plan_members(units, best, plansearch.shed_greedy(units, SHED), SHED)
    return members.join(best.select("scenario_id", "plan_id", "place"), ["scenario_id", "plan_id"]).withColumnRenamed("unit_id", "feeder_id")


@query("shed_refined_plans", "scenario_id plan_id place feeder_id mw pain fair")
def _(spark, d):
    units = shed_inputs(spark, d)[1]
    return plansearch.shed_refined_members(units, shed_best(units), SHED).withColumnRenamed("unit_id", "feeder_id")


@query("shed_plan_report", "scenario_id place plan_id target_mw n_feeders relief_mw pain_total fairness_penalty feasible score")
def _(spark, d):
    units = shed_inputs(spark, d)[1]
    members = staged(plansearch.shed_refined_members(units, shed_best(units), SHED), "shed_members")
    return plansearch.shed_report(members, SHED)


@query("scenario_sweep", "scenario_id asked_mw eligible_feeders protected_excluded too_small_excluded plans_evaluated equivalent_manual_hours best_score feasible_plans")
def _(spark, d):
    g, units = shed_inputs(spark, d)
    plans = plansearch.shed_plans(units, SHED).groupBy("scenario_id").agg(
        F.min("score").alias("best_score"), F.count_if(F.col("mw") >= F.col("target_mw") - 1e-6).alias("feasible_plans")
    )
    return plansearch.shed_counters(g.state, SHED_ASKED, SHED).join(plans, "scenario_id")


def water_inputs(spark, d):
    a = agro(spark, d, staged)
    return a, a.water_units(WATER_ASKED, WATER)


def water_best(units):
    return staged(plansearch.best_plans(plansearch.water_plans(units, WATER), 3 * WATER.top_k), "water_best")


@query("irrigation_eligible", "scenario_id budget_ml village_id benefit water fair")
def _(spark, d):
    return water_inputs(spark, d)[1].withColumnRenamed("unit_id", "village_id")


@query("irrigation_greedy_plan", "scenario_id budget_ml village_id benefit water fair")
def _(spark, d):
    return plansearch.water_greedy(water_inputs(spark, d)[1], WATER).withColumnRenamed("unit_id", "village_id")


@query("irrigation_candidates_topk", "scenario_id place plan_id n_members benefit water fair score")
def _(spark, d):
    return plansearch.best_plans(plansearch.water_plans(water_inputs(spark, d)[1], WATER), 3 * WATER.top_k)


@query("irrigation_refined_plans", "scenario_id plan_id place village_id benefit water fair")
def _(spark, d):
    units = water_inputs(spark, d)[1]
    return plansearch.water_refined_members(units, water_best(units), WATER).withColumnRenamed("unit_id", "village_id")


@query("irrigation_plan_report", "scenario_id place plan_id budget_ml n_villages yield_saved_t water_used_ml tail_share fairness_bonus within_budget score")
def _(spark, d):
    units = water_inputs(spark, d)[1]
    members = staged(plansearch.water_refined_members(units, water_best(units), WATER), "water_members")
    return plansearch.water_report(members, WATER)


@query("irrigation_sweep", "scenario_id asked_ml eligible_villages excluded plans_evaluated equivalent_manual_hours")
def _(spark, d):
    return plansearch.water_counters(agro(spark, d, staged).state, WATER_ASKED, WATER)


# ---------------------------------------------------------------- what users ask


@query("top_feeders", "rank feeder_id name fci reason_codes")
def _(spark, d):
    cards = scored_grid(spark, d).ranked.withColumn("reason_codes", joined())
    return serving.top(cards, "rank", 8)


@query("feeder_lookup", "feeder_id name fci")
def _(spark, d):
    return serving.lookup(scored_grid(spark, d).ranked, "feeder_id", "name", "nation_1", "rank")


@query("feeder_detail", "feeder_id name rank fci pain_score is_protected critical_type headroom_mw reason_codes")
def _(spark, d):
    ranked = scored_grid(spark, d).ranked.withColumn("reason_codes", joined())
    return serving.by_id(ranked, "feeder_id", 7)


WATCH = "transformer_id feeder_id p_fail_72h loading_max loading_mean overload_minutes sag_count age_years capacity_kva reason_codes"


@query("transformer_watchlist", WATCH)
def _(spark, d):
    return grid(spark, d, GRAIN).watchlist(250).withColumn("reason_codes", joined())


@query("tx_watchlist_query", "transformer_id p_fail_72h")
def _(spark, d):
    return grid(spark, d, GRAIN).watchlist(100)


@query("priority_villages", "rank village_id name district_id block_id canal_reach vapi p_loss yield_pred normal_yield reason_codes")
def _(spark, d):
    cards = agro(spark, d, staged).village_cards.withColumn("reason_codes", joined())
    return serving.top(cards, "rank", 300)


@query("village_detail", "village_id name rank vapi p_loss water_need_ml yield_saveable_t")
def _(spark, d):
    return serving.lookup(agro(spark, d, staged).village_cards, "village_id", "name", "#000000003", "rank")


@query("trigger_list", "rank village_id vapi insurance_trigger trigger_score water_deficit")
def _(spark, d):
    return agro(spark, d, staged).triggers(300)


@query("load_and_forecast_series", "kind ts mw")
def _(spark, d):
    g = grid(spark, d, GRAIN, staged)
    return serving.history_and_forecast(rollup.latest_points(g.system_load, 96), g.system_forecast)


@query("fleet_kpis", "domain metric value")
def _(spark, d):
    g = scored_grid(spark, d)
    newest = g.fd_int.agg(F.max("ts").alias("ts"))
    return serving.grid_kpis(g.summary, newest, g.p).unionByName(serving.agro_kpis(agro(spark, d, staged).summary))


@query("unit_counts", "domain unit_label units")
def _(spark, d):
    g, a = scored_grid(spark, d), agro(spark, d, staged)
    return serving.unit_counts({"grid": ("feeders", g.assembled), "agro": ("villages", a.village_features)})


@query("scalar_status", SUMMARY)
def _(spark, d):
    g = scored_grid(spark, d)
    return serving.scalars_only(published.system_record(g))


@query("nested_feeder_cards", "rank feeder_id fci forecast_stress tx_risk utilization volatility reason_codes current_mw forecast_peak_mw capacity_mw headroom_mw recent_mw forecast_mw")
def _(spark, d):
    folder = fresh_dir(spark, "cards")
    published.write_grid_results(scored_grid(spark, d), folder)
    cards = published.read_results(spark, folder, "feeders")
    text = lambda c: F.array_join(F.transform(c, lambda v: F.when(v.isNull(), "-").otherwise(F.format_string("%.3f", v))), " ").alias(c)
    return cards.select("*", "components.*").select(
        *[c for c in cards.columns if c not in ("reason_codes", "recent_mw", "forecast_mw")],
        "forecast_stress", "tx_risk", "utilization", "volatility", joined(), text("recent_mw"), text("forecast_mw"),
    )


@query("published_scores", "rank feeder_id name fci reason_codes pain_score headroom_mw customers")
def _(spark, d):
    return published.flat_feeder_scores(scored_grid(spark, d).feeder_cards)


@query("table_roundtrip", "table_name rows_parquet rows_csv key_total value_total")
def _(spark, d):
    tables, folder = logical_tables(spark, d), fresh_dir(spark, "roundtrip")
    out = None
    for name, key, value in (("readings", "reading_id", "kwh"), ("ndvi", "plot_id", "ndvi"), ("feeders", "feeder_id", "lat")):
        save_table(tables[name], f"{folder}/p", name)
        save_table(tables[name], f"{folder}/c", name, fmt="csv")
        back, plain = read_table(spark, f"{folder}/p", name), read_table(spark, f"{folder}/c", name)
        row = back.agg(F.count(F.lit(1)).alias("rows_parquet"), F.sum(key).alias("key_total")).select(
            F.lit(name).alias("table_name"),
            "rows_parquet",
            plain.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows_csv"),
            "key_total",
            plain.agg(F.sum(value).alias("v")).scalar().alias("value_total"),
        )
        out = row if out is None else out.unionByName(row)
    return out

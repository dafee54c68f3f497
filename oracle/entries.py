"""SQL twin of each named query."""

from __future__ import annotations

from oracle.ctes import CROP_HELD, GRAIN, LOSS_BOOSTED, PER, RISK_BOOSTED, SHED_ASKED, TX_HELD, WATER_ASKED, _logit, _push, _scenarios, dec, sql

MANUAL_HOURS = dec(f"{(1 + 3 * PER) * 5.0 / 60.0}e0", 1)
HISTORY_P = "cast(round(cast(" + _logit(
    [
        _push("age_years", 18.0, 10.0, 0.6), _push("capacity_kva", 170.0, 85.0, -0.3), _push("loading_mean", 0.6, 0.4, 0.8),
        _push("loading_max", 1.0, 0.6, 1.0), _push("overload_minutes", 30.0, 60.0, 0.7), _push("sag_count", 1.0, 2.0, 0.4),
        _push("thermal_stress", 0.3, 1.0, 0.5),
    ],
    -0.6,
) + " as decimal(28,10)), 9) as double)"


def _auc(part: str, y: str = "failed_next72h", p: str = HISTORY_P, source: str = "tx_history") -> str:
    """Mean ranks of the positives (Mann-Whitney)."""
    return f"""select part, count(*) filter (y = 1) as positives, count(*) filter (y <> 1) as negatives,
            case when count(*) filter (y = 1) > 0 and count(*) filter (y <> 1) > 0 then
              (sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0e0)
              / (cast(count(*) filter (y = 1) as double) * count(*) filter (y <> 1)) else 0.5e0 end as auc
          from (select part, y, rank() over (partition by part order by p) + (count(*) over (partition by part, p) - 1) / 2.0e0 as rk
            from (select {y} as y, {p} as p, {part} as part from {source}) h) r group by 1"""


BOOSTED_P = "cast(round(cast(1.0e0 / (1.0e0 + exp(-score)) as decimal(28,10)), 9) as double)"


SUMMARY = "current_mw:d forecast_peak_mw:d capacity_mw:d supply_cap_mw:d deficit_mw:d temp_now_c:d feeders:i protected_feeders:i tx_watchlist:i"
WATCH_BODY = f"""select transformer_id, feeder_id, {dec('p_fail_72h', 4)} as p_fail_72h, {dec('loading_max', 3)} as loading_max, {dec('loading_mean', 3)} as loading_mean,
            {dec('overload_minutes', 1)} as overload_minutes, sag_count, age_years, capacity_kva, coalesce(reason_codes, '') as reason_codes
          from tx_scores left join tx_codes using (transformer_id) order by {dec('p_fail_72h', 4)} desc nulls last, transformer_id"""
CARD_NUMBERS = lambda c, n: dec(c, n) + f" as {c}"
NDVI_SHAPE = """select p.plot_id, p.date, p.ndvi, 1.0e0 / (1.0e0 + exp(-12.0e0 * (frac - 0.25e0))) / (1.0e0 + exp(12.0e0 * (frac - 0.80e0))) as shape,
            case crop when 'rice' then 0.86e0 when 'cotton' then 0.78e0 when 'maize' then 0.82e0 when 'soybean' then 0.80e0 end as peak
          from (select n.plot_id, n.date, n.ndvi, q.crop, g.gdd_cum / case q.crop when 'rice' then 1650.0e0 when 'cotton' then 2100.0e0 when 'maize' then 1500.0e0 when 'soybean' then 1400.0e0 end as frac
            from ndvi_smooth n join plots q using (plot_id) join villages v using (village_id)
            join gdd_cum g on g.block_id = v.block_id and strftime(g.date, '%m-%d') = strftime(n.date, '%m-%d')) p"""
MEMBER = "scenario_id:i plan_id:i place:i feeder_id:i"

ORACLE: dict[str, str] = {
    # ------------------------------------------------------------ grid telemetry
    "snap_dedupe_readings": sql("meter_id:i ts:t kwh:d voltage:d copies:i", "select * from slots"),
    "orphan_readings": sql("meter_id:i ts:t copies:i", "select * from slots where meter_id not in (select meter_id from meters)"),
    "valid_readings": sql("meter_id:i ts:t kwh:d voltage:d", "select * from valid"),
    "unit_repair": sql("meter_id:i ts:t raw_kwh:d kwh:d", "select meter_id, ts, kwh as raw_kwh, fixed as kwh from repaired"),
    "negative_null": sql("meter_id:i ts:t kwh:d", "select * from masked"),
    "median_impute": sql("meter_id:i ts:t kwh:d", "select * from clean"),
    "sag_flags": sql("meter_id:i ts:t voltage:d is_sag:i", "select * from clean"),
    "grid_quality_ledger": sql(
        "rows_in:i duplicates_removed:i orphans_removed:i unit_errors_fixed:i negatives_nulled:i nulls_imputed:i rows_clean:i",
        """select (select count(*) from readings) as rows_in, (select count(*) from readings) - (select count(*) from slots) as duplicates_removed,
            (select count(*) from slots) - (select count(*) from valid) as orphans_removed,
            (select count(*) from valid where kwh > 100) as unit_errors_fixed, (select count(*) from repaired where fixed < 0) as negatives_nulled,
            (select count(*) from masked where kwh is null) as nulls_imputed, (select count(*) from clean) as rows_clean""",
    ),
    "enriched_readings": sql(
        "meter_id:i ts:t kwh:d voltage:d is_sag:i transformer_id:i customer_class:s feeder_id:i capacity_kva:i substation_id:i kw:d",
        "select * from enriched",
    ),
    "tx_interval_load": sql("transformer_id:i feeder_id:i capacity_kva:i ts:t kw:d sags:i n_meters:i loading:d", "select * from tx_int"),
    "feeder_interval_load": sql("feeder_id:i ts:t kw:d sags:i capacity_kw:d", "select * from fd_int"),
    "backfill_tx_interval": sql("transformer_id:i feeder_id:i capacity_kva:i ts:t kw:d sags:i loading:d", "select * from bf_tx"),
    "feeder_daily": sql("feeder_id:i d:a peak_kw:d mean_kw:d overload_minutes:i sags:i", "select * from bf_daily"),
    "feeder_daily_backfill_table": sql("feeder_id:i d:a peak_kw:d mean_kw:d overload_minutes:i sags:i", "select * from bf_daily"),
    "curated_feeder_load_view": sql(
        "feeder_id:i ts:t kw:d",
        """select feeder_id, ts, sum(power) as kw
           from (select transformer_id, ts, 4 * kwh as power
                 from (select * from readings where kwh >= 0 and kwh <= 100) plausible join meters using (meter_id)) p
           join (select transformer_id, feeder_id from transformers) placed using (transformer_id) group by all""",
    ),
    # ------------------------------------------------------------ grid features
    "tx_stress_24h": sql(
        "transformer_id:i feeder_id:i loading_mean:d loading_max:d overload_minutes:d sag_count:i thermal_stress:d kw_now:d", "select * from tx_stress"
    ),
    "feeder_profile_24h": sql(
        "feeder_id:i peak_kw_24h:d mean_kw_24h:d std_kw_24h:d sag_rate:d capacity_kw:d kw_now:d load_factor:d volatility:d utilization_now:d",
        "select * from profile",
    ),
    "feeder_rolling_2h": sql(
        "feeder_id:i ts:t kw:d roll_mean_2h:d",
        "select *, avg(kw) over (partition by feeder_id order by ts rows between 7 preceding and current row) as roll_mean_2h from fd_int",
    ),
    "customer_mix": sql("feeder_id:i residential:i commercial:i industrial:i customers:i", "select * from mix"),
    "load_matrix": sql(
        "feeder_id:i day:i slot_0:d slot_1:d slot_2:d slot_3:d",
        """select feeder_id, slot // 4 as day, sum(kw) filter (slot % 4 = 0) as slot_0, sum(kw) filter (slot % 4 = 1) as slot_1,
            sum(kw) filter (slot % 4 = 2) as slot_2, sum(kw) filter (slot % 4 = 3) as slot_3 from load_grid group by 1, 2""",
        GRAIN,
    ),
    "load_lags": sql("feeder_id:i slot:i ts:t kw:d lag_1:d lag_2:d lag_3:d lag_4:d lag_day:d recent_mean:d", "select * from lags", GRAIN),
    "load_features": sql(
        "feeder_id:i slot:i ts:t kw:d lag_1:d lag_2:d lag_3:d lag_4:d lag_day:d recent_mean:d temp_c:d hod_sin:d hod_cos:d",
        """select l.*, t.temp_c, sin(2 * pi() * (hour(l.ts) + minute(l.ts) / 60.0e0) / 24) as hod_sin, cos(2 * pi() * (hour(l.ts) + minute(l.ts) / 60.0e0) / 24) as hod_cos
           from lags l left join temperature t on t.ts = l.ts""",
        GRAIN,
    ),
    "weather_asof": sql("slot:i ts:t temp_c:d", "select * from temperature", GRAIN),
    "heat_load_multiplier": sql(
        "ts:t temp_c:d heat_multiplier:d", "select *, 1.0e0 + 0.035e0 * power(greatest(temp_c - 24.0e0, 0.0e0), 1.3e0) as heat_multiplier from weather"
    ),
    # ------------------------------------------------------------ forecast
    "seasonal_naive_forecast": sql("feeder_id:i step:i ts:t kw:d", "select * from forecast", GRAIN),
    "forecast_peaks": sql("feeder_id:i forecast_peak_kw:d", "select * from peaks", GRAIN),
    "system_forecast": sql("step:i ts:t mw:d", "select * from sys_forecast", GRAIN),
    "future_temperature": sql("step:i temp_c:d", "select * from future_temp", GRAIN),
    # ------------------------------------------------------------ grid scores
    "transformer_scored": sql(
        "transformer_id:i feeder_id:i age_years:i capacity_kva:i loading_max:d p_fail_72h:d reason_codes:s",
        "select s.*, coalesce(c.reason_codes, '') as reason_codes from tx_scores s left join tx_codes c using (transformer_id)",
        GRAIN,
    ),
    "risk_contributions": sql("transformer_id:i pos:i feature:s contribution:d value:d", "select * from tx_factors", GRAIN),
    "tx_risk_rollup": sql("feeder_id:i tx_risk_max:d tx_risk_mean:d tx_high_risk:i", "select * from tx_risk", GRAIN),
    "feeder_score_assembly": sql(
        "feeder_id:i name:s substation_id:i critical_type:s is_protected:b kw_now:d capacity_kw:d sag_rate:d volatility:d utilization_now:d tx_risk_max:d "
        "tx_risk_mean:d tx_high_risk:i forecast_peak_kw:d residential:i commercial:i industrial:i customers:i shed_hours_30d:d complaints_30d:i",
        "select * from assembled",
        GRAIN,
    ),
    "fci_ranking": sql("rank:i feeder_id:i fci:d c_forecast_stress:d c_tx_risk:d c_utilization:d c_volatility:d", "select * from ranked", GRAIN),
    "pain_score": sql("feeder_id:i is_protected:b pain_score:d sheddable_mw:d headroom_mw:d", "select * from scored", GRAIN),
    "grid_reason_codes": sql("feeder_id:i reason_codes:s", "select * from ranked", GRAIN),
    "severity_bands": sql(
        "feeder_id:i fci:d severity:s list_severity:s",
        """select *, case when fci > 0.8 then 'high' when fci > 0.5 then 'medium' else 'low' end as severity,
            case when fci > 0.66 then 'high' when fci > 0.4 then 'medium' else 'low' end as list_severity from scored""",
        GRAIN,
    ),
    "grid_system_summary": sql(SUMMARY, "select * from grid_summary", GRAIN),
    "system_load_series": sql("ts:t mw:d", "select * from sys_load order by ts desc limit 96"),
    "temperature_series": sql(
        "ts:t temp_c:d",
        "select * from (select *, row_number() over (order by ts) - 1 as spot from (select * from weather order by ts desc limit 192) w) q where spot % 4 = 0",
    ),
    "risk_auc": sql("positives:i negatives:i auc:d", f"select * from ({_auc('0')}) a"),
    "hash_split_auc": sql("part:s positives:i negatives:i auc:d", f"select * from ({_auc(chr(39).join(['case when ((row_key % 1000003) * 7919 + (row_key % 998244353) * 104729 + 17) % 10007 % 100 >= 85 then ', 'holdout', ' else ', 'train', ' end']))}) a"),
    # ------------------------------------------------------------ agro passes
    "agro_quality_ledger": sql(
        "rows_in:i duplicate_passes_removed:i orphan_plots_removed:i unit_errors_fixed:i cloud_masked:i gaps_filled:i rows_clean:i",
        """select (select count(*) from ndvi) as rows_in, (select count(*) from ndvi) - (select count(*) from days) as duplicate_passes_removed,
            (select count(*) from days) - (select count(*) from ndvi_fixed) as orphan_plots_removed, (select count(*) from ndvi_fixed where ndvi > 1.5) as unit_errors_fixed,
            (select count(*) from ndvi_fixed where cloud_flag = 1 or fixed < 0.05 or fixed > 1) as cloud_masked,
            (select count(*) from ndvi_masked where ndvi is null) as gaps_filled, (select count(*) from ndvi_smooth) as rows_clean""",
    ),
    "ndvi_clean": sql("plot_id:i date:t ndvi:d", "select * from ndvi_masked"),
    "ndvi_gapfill": sql("plot_id:i date:t ndvi:d", "select * from ndvi_filled"),
    "ndvi_smooth": sql("plot_id:i date:t ndvi:d ndvi_smooth:d", "select * from ndvi_smooth"),
    "enriched_plots": sql(
        "plot_id:i date:t ndvi_smooth:d village_id:i crop:s area_ha:d irrigation:s block_id:i district_id:i canal_reach:s", "select * from passes"
    ),
    "plot_season": sql(
        "plot_id:i village_id:i crop:s area_ha:d irrigation:s canal_reach:s block_id:i peak_ndvi:d mean_ndvi:d integ_ndvi:d last_ndvi:d", "select * from plot_season"
    ),
    "village_date_ndvi": sql("village_id:i date:t ndvi:d", "select * from village_date"),
    "block_weather": sql("block_id:i gdd_total:d rain_total:d rain_repro:d dry_days_repro:i", "select * from block_season"),
    "cumulative_gdd": sql("block_id:i date:t gdd_cum:d rain_cum:d", "select * from gdd_cum"),
    "ndvi_trend": sql("village_id:i ndvi_trend:d", "select * from trend"),
    "village_features": sql(
        "village_id:i block_id:i district_id:i name:s canal_reach:s peak_ndvi:d mean_ndvi:d integ_ndvi:d last_ndvi:d area_ha:d plots:i rainfed_frac:d ndvi_trend:d "
        "gdd_total:d rain_total:d rain_repro:d dry_days_repro:i past_support_index:d gdd_frac:d water_deficit:d",
        "select * from vf",
    ),
    "expected_ndvi_anomaly": sql(
        "plot_id:i date:t ndvi:d ndvi_expected:d ndvi_anomaly:d",
        f"""select plot_id, date, ndvi, e as ndvi_expected, ndvi - e as ndvi_anomaly from (
            select *, 0.15e0 + (peak - 0.15e0) * shape / max(shape) over (partition by plot_id) as e from ({NDVI_SHAPE}) s) x""",
    ),
    "water_stress_index": sql("plot_id:i village_id:i area_ha:d water_stress:d", "select * from stress_index"),
    "loss_labels": sql(
        "village_id:i season:i yield_t_ha:d normal_yield:d loss_event:i",
        """select y.village_id, season, yield_t_ha, n as normal_yield, case when yield_t_ha < 0.8e0 * n then 1 else 0 end as loss_event
           from yield_history y join (select village_id, avg(yield_t_ha) as n from yield_history group by 1) m on m.village_id = y.village_id""",
    ),
    "village_season_history": sql(
        "village_id:i season:i peak_ndvi:d integ_ndvi:d water_stress:d gdd_frac:d area_ha:d",
        """select s.village_id, 2024 as season, avg(peak_ndvi) as peak_ndvi, avg(integ_ndvi) as integ_ndvi, avg(water_stress) as water_stress,
            max(gdd_total) / 1650.0e0 as gdd_frac, sum(s.area_ha) as area_ha
           from plot_season s join stress_index x on x.plot_id = s.plot_id join block_season b on b.block_id = s.block_id group by 1""",
    ),
    "region_series": sql(
        "kind:s date:t value:d",
        """select 'ndvi' as kind, date, avg(ndvi) as value from village_date group by 2 union all
           select 'rain', date, value from (select date, avg(rain_mm) as value, row_number() over (order by date) - 1 as spot from block_weather group by 1) r where spot % 3 = 0""",
    ),
    # ------------------------------------------------------------ agro scores
    "village_scored": sql(
        "village_id:i p_loss:d yield_pred:d model_codes:s",
        "select s.*, coalesce(c.model_codes, '') as model_codes from v_scores s left join v_codes c using (village_id)",
    ),
    "normal_yield": sql("village_id:i yield_pred:d normal_yield:d", "select * from v_normal"),
    "vapi_ranking": sql("rank:i village_id:i vapi:d c_loss_risk:d c_yield_shortfall:d c_ndvi_decline:d c_exposure:d", "select * from v_ranked"),
    "insurance_triggers": sql(
        "village_id:i yield_trigger:i rain_trigger:i insurance_trigger:i trigger_score:d yield_saveable_t:d water_need_ml:d yield_shortfall_frac:d",
        "select * from v_scored",
    ),
    "agro_reason_codes": sql("village_id:i reason_codes:s", "select * from v_ranked"),
    "village_severity": sql(
        "village_id:i vapi:d severity:s", "select *, case when vapi > 0.6 then 'high' when vapi > 0.38 then 'medium' else 'low' end as severity from v_scored"
    ),
    "agro_system_summary": sql(
        "villages:i plots_total:i total_area_ha:d at_risk_area_ha:d at_risk_pct:d insurance_triggers:i mean_yield_pred:d mean_normal_yield:d "
        "yield_saveable_total_t:d water_need_total_ml:d tail_villages:i",
        "select * from agro_summary",
    ),
    # ------------------------------------------------------------ plan search
    "shed_eligible": sql(
        "scenario_id:i target_mw:d feeder_id:i name:s rank:i mw:d pain:d shed_hours_30d:d fair:d", "select *, unit_no as feeder_id from shed_units", GRAIN
    ),
    "shed_greedy_plan": sql("scenario_id:i target_mw:d feeder_id:i mw:d pain:d fair:d", "select *, unit_no as feeder_id from shed_greedy", GRAIN),
    "shed_candidates_topk": sql(
        "scenario_id:i place:i plan_id:i n_members:i relief_mw:d pain_total:d fairness_penalty:d score:d",
        "select *, mw as relief_mw, pain as pain_total, fair as fairness_penalty from shed_best",
        GRAIN,
    ),
    "shed_plan_members": sql("scenario_id:i plan_id:i place:i feeder_id:i name:s mw:d pain:d", "select *, unit_no as feeder_id from shed_best_members", GRAIN),
    "shed_refined_plans": sql("scenario_id:i plan_id:i place:i feeder_id:i mw:d pain:d fair:d", "select *, unit_no as feeder_id from shed_refined_members", GRAIN),
    "shed_plan_report": sql(
        "scenario_id:i place:i plan_id:i target_mw:d n_feeders:i relief_mw:d pain_total:d fairness_penalty:d feasible:b score:d",
        """select scenario_id, place, plan_id, target_mw, n_members as n_feeders, mw as relief_mw, pain as pain_total, fair as fairness_penalty,
            mw >= target_mw - 1e-6 as feasible, score
           from (select *, row_number() over (partition by scenario_id order by score, plan_id) as place from shed_final) f where place <= 5""",
        GRAIN,
    ),
    "scenario_sweep": sql(
        "scenario_id:i asked_mw:d eligible_feeders:i protected_excluded:i too_small_excluded:i plans_evaluated:i equivalent_manual_hours:d best_score:d feasible_plans:i",
        f"""select s.scenario_id, asked_mw, eligible_feeders, protected_excluded, too_small_excluded, {1 + 3 * PER} as plans_evaluated,
            {MANUAL_HOURS} as equivalent_manual_hours, best_score, feasible_plans
           from ({_scenarios(SHED_ASKED, 'asked_mw')}) s,
            (select count(*) filter (not is_protected and sheddable_mw > 0.01) as eligible_feeders, count(*) filter (is_protected) as protected_excluded,
              count(*) filter (not is_protected and sheddable_mw <= 0.01) as too_small_excluded from ranked) c,
            (select scenario_id, min(score) as best_score, count(*) filter (mw >= target_mw - 1e-6) as feasible_plans from shed_scored group by 1) p
           where p.scenario_id = s.scenario_id""",
        GRAIN,
    ),
    "irrigation_eligible": sql("scenario_id:i budget_ml:d village_id:i benefit:d water:d fair:d", "select *, unit_no as village_id from water_units"),
    "irrigation_greedy_plan": sql("scenario_id:i budget_ml:d village_id:i benefit:d water:d fair:d", "select *, unit_no as village_id from water_greedy"),
    "irrigation_candidates_topk": sql("scenario_id:i place:i plan_id:i n_members:i benefit:d water:d fair:d score:d", "select * from water_best"),
    "irrigation_refined_plans": sql("scenario_id:i plan_id:i place:i village_id:i benefit:d water:d fair:d", "select *, unit_no as village_id from water_refined"),
    "irrigation_plan_report": sql(
        "scenario_id:i place:i plan_id:i budget_ml:d n_villages:i yield_saved_t:d water_used_ml:d tail_share:d fairness_bonus:d within_budget:b score:d",
        f"""select scenario_id, place, plan_id, budget_ml, n_members as n_villages, benefit as yield_saved_t, water as water_used_ml, {dec('tail_share', 2)} as tail_share,
            fair as fairness_bonus, water <= budget_ml + 1e-6 as within_budget, score
           from (select *, row_number() over (partition by scenario_id order by water <= budget_ml + 1e-6 desc, benefit desc, plan_id) as place from water_final) f where place <= 5""",
    ),
    "irrigation_sweep": sql(
        "scenario_id:i asked_ml:d eligible_villages:i excluded:i plans_evaluated:i equivalent_manual_hours:d",
        f"""select scenario_id, asked_ml, eligible_villages, n - eligible_villages as excluded, {1 + 3 * PER} as plans_evaluated, {MANUAL_HOURS} as equivalent_manual_hours
           from ({_scenarios(WATER_ASKED, 'asked_ml')}) s,
            (select count(*) as n, count(*) filter (water_need_ml > 1e-3 and yield_saveable_t > 1e-3) as eligible_villages from v_scored) c""",
    ),
    # ------------------------------------------------------------ streams
    "stream_dedupe": sql("meter_id:i ts:t", "select distinct meter_id, slot as ts from slots_of"),
    "stream_feeder_load": sql("feeder_id:i ts:t kw:d sags:i", "select feeder_id, ts, sum(kw) as kw, sum(sag) as sags from st_rows group by 1, 2"),
    "stream_tx_load": sql("transformer_id:i feeder_id:i capacity_kva:i ts:t kw:d sags:i n_meters:i loading:d", "select * from st_tx"),
    "stream_sliding_stress": sql(
        "transformer_id:i feeder_id:i loading_mean:d loading_max:d overload_minutes:d sag_count:i thermal_stress:d kw_now:d p_fail_72h:d", "select * from st_scores"
    ),
    # ------------------------------------------------------------ what users ask
    "top_feeders": sql("rank:i feeder_id:i name:s fci:d reason_codes:s", "select * from ranked order by rank limit 8", GRAIN),
    "feeder_lookup": sql(
        "feeder_id:i name:s fci:d",
        "select * from ranked where cast(feeder_id as varchar) = 'nation_1' or contains(lower(name), 'nation_1') order by rank limit 1",
        GRAIN,
    ),
    "feeder_detail": sql(
        "feeder_id:i name:s rank:i fci:d pain_score:d is_protected:b critical_type:s headroom_mw:d reason_codes:s", "select * from ranked where feeder_id = 7", GRAIN
    ),
    "transformer_watchlist": sql(
        "transformer_id:i feeder_id:i p_fail_72h:d loading_max:d loading_mean:d overload_minutes:d sag_count:i age_years:i capacity_kva:i reason_codes:s",
        WATCH_BODY + " limit 250",
        GRAIN,
    ),
    "tx_watchlist_query": sql("transformer_id:i p_fail_72h:d", WATCH_BODY + " limit 100", GRAIN),
    "priority_villages": sql(
        "rank:i village_id:i name:s district_id:i block_id:i canal_reach:s vapi:d p_loss:d yield_pred:d normal_yield:d reason_codes:s",
        f"""select rank, village_id, name, district_id, block_id, canal_reach, vapi, {dec('p_loss', 4)} as p_loss, {dec('yield_pred', 2)} as yield_pred,
            {dec('normal_yield', 2)} as normal_yield, reason_codes from v_ranked order by rank limit 300""",
    ),
    "village_detail": sql(
        "village_id:i name:s rank:i vapi:d p_loss:d water_need_ml:d yield_saveable_t:d",
        f"""select village_id, name, rank, vapi, {dec('p_loss', 4)} as p_loss, water_need_ml, yield_saveable_t from v_ranked
           where cast(village_id as varchar) = '#000000003' or contains(lower(name), '#000000003') order by rank limit 1""",
    ),
    "trigger_list": sql(
        "rank:i village_id:i vapi:d insurance_trigger:i trigger_score:d water_deficit:d",
        f"select rank, village_id, vapi, insurance_trigger, trigger_score, {dec('water_deficit', 3)} as water_deficit from v_ranked where insurance_trigger = 1 order by rank limit 300",
    ),
    "load_and_forecast_series": sql(
        "kind:s ts:t mw:d",
        "select 'history' as kind, ts, mw from (select * from sys_load order by ts desc limit 96) h union all select 'forecast', ts, mw from sys_forecast",
        GRAIN,
    ),
    "fleet_kpis": sql(
        "domain:s metric:s value:d",
        f"""select 'grid' as domain, metric, value from (
            select unnest(['system_load_mw', 'forecast_peak_mw', 'supply_deficit_mw', 'headroom_mw', 'tx_watchlist', 'blocks_to_day_end']) as metric,
              unnest([current_mw, forecast_peak_mw, deficit_mw, {dec('capacity_mw - forecast_peak_mw', 0)}, cast(tx_watchlist as double),
                cast(date_diff('second', newest, date_trunc('day', newest) + interval 1 day) as double) / {GRAIN}]) as value
            from grid_summary, (select max(ts) as newest from fd_int) n) g
           union all select 'agro', metric, value from (
            select unnest(['villages', 'area_at_risk_pct', 'triggers_hit', 'mean_yield_pred', 'mean_normal_yield', 'yield_saveable_t']) as metric,
              unnest([cast(villages as double), at_risk_pct, cast(insurance_triggers as double), mean_yield_pred, mean_normal_yield, yield_saveable_total_t]) as value
            from agro_summary) a""",
        GRAIN,
    ),
    "unit_counts": sql(
        "domain:s unit_label:s units:i",
        "select 'grid' as domain, 'feeders' as unit_label, count(*) as units from assembled union all select 'agro', 'villages', count(*) from vf",
        GRAIN,
    ),
    "scalar_status": sql(SUMMARY, "select * from grid_summary", GRAIN),
    "nested_feeder_cards": sql(
        "rank:i feeder_id:i fci:d forecast_stress:d tx_risk:d utilization:d volatility:d reason_codes:s current_mw:d forecast_peak_mw:d capacity_mw:d headroom_mw:d recent_mw:s forecast_mw:s",
        f"""select r.rank, r.feeder_id, fci, c_forecast_stress as forecast_stress, c_tx_risk as tx_risk, c_utilization as utilization, c_volatility as volatility, reason_codes,
            {dec('kw_now / 1000.0e0', 3)} as current_mw, {dec('forecast_peak_kw / 1000.0e0', 3)} as forecast_peak_mw, {dec('capacity_kw / 1000.0e0', 3)} as capacity_mw, headroom_mw,
            coalesce(recent_mw, '') as recent_mw, coalesce(forecast_mw, '') as forecast_mw
           from ranked r
           left join (select feeder_id, string_agg(coalesce(printf('%.3f', {dec('kw / 1000.0e0', 3)}), '-'), ' ' order by ts) as recent_mw
             from (select *, row_number() over (partition by feeder_id order by ts) - 1 as spot from fd_day) q where spot % 4 = 0 group by 1) s using (feeder_id)
           left join (select feeder_id, string_agg(coalesce(printf('%.3f', {dec('kw / 1000.0e0', 3)}), '-'), ' ' order by step) as forecast_mw from forecast group by 1) f using (feeder_id)""",
        GRAIN,
    ),
    "published_scores": sql("rank:i feeder_id:i name:s fci:d reason_codes:s pain_score:d headroom_mw:d customers:i", "select * from ranked", GRAIN),
    "table_roundtrip": sql(
        "table_name:s rows_parquet:i rows_csv:i key_total:i value_total:d",
        """select 'readings' as table_name, count(*) as rows_parquet, count(*) as rows_csv, sum(reading_id) as key_total, sum(kwh) as value_total from readings
           union all select 'ndvi', count(*), count(*), sum(plot_id), sum(ndvi) from ndvi
           union all select 'feeders', count(*), count(*), sum(feeder_id), sum(lat) from feeders""",
    ),
    # ------------------------------------------------------------ fitted models
    "risk_two_rounds": sql("row_key:i p:d", f"select row_key, 1.0e0 / (1.0e0 + exp(-score)) as p from {RISK_BOOSTED}"),
    "risk_two_rounds_auc": sql("positives:i negatives:i auc:d", _auc("true", "y", BOOSTED_P, f"(select * from {RISK_BOOSTED} where out) q")),
    "loss_two_rounds_auc": sql("positives:i negatives:i auc:d", _auc("true", "y", BOOSTED_P, f"(select * from {LOSS_BOOSTED} where out) q")),
    "risk_logit_scores": sql(
        "transformer_id:i feeder_id:i p_fail_72h:d reason_codes:s",
        "select s.*, coalesce(reason_codes, '') as reason_codes from rl_scores s left join rl_codes using (transformer_id)",
        GRAIN,
    ),
    "village_logit_scores": sql(
        "village_id:i p_loss:d yield_pred:d model_codes:s",
        "select l.*, yield_pred, coalesce(model_codes, '') as model_codes from ll_scores l join yr_live using (village_id) left join ll_codes using (village_id)",
    ),
    "yield_ridge": sql("village_id:i season:i yield_t_ha:d yield_fit:d", "select * from yr_fit"),
}

# counted by stream batches, the ledger adds up to that of the whole table
ORACLE["stream_quality_ledger"] = ORACLE["grid_quality_ledger"]

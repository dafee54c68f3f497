"""Building blocks of the checking SQL, written for DuckDB and kept apart from the Spark code.

``sql(columns, body)`` collects the blocks that ``body`` names, in order, and casts the result to
the agreed column types: i bigint, d double (six decimals), t timestamp, s text, b boolean, a date.
"""

from __future__ import annotations

import re

from fairload.sources.mapping import SOURCE_TABLES, TEXTS
from oracle import fits

GRAIN = 21600  # seconds between grid points in queries that need a dense load grid


def dec(x: str, places: int = 6) -> str:
    return f"cast(round(cast({x} as decimal(28,10)), {places}) as double)"


def _clip(x: str, low: float, high: float) -> str:
    return f"case when ({x}) is not null then least(greatest({x}, {low}), {high}) end"


def _norm(x: str, name: str) -> str:
    return f"case when {name}_hi - {name}_lo > 1e-9 then ({x} - {name}_lo) / ({name}_hi - {name}_lo) else ({x}) * 0.0 end"


def _logit(parts: list[str], bias: float) -> str:
    return f"1.0e0 / (1.0e0 + exp(-({bias} + " + " + ".join(parts) + ")))"


def _push(x: str, mean: float, scale: float, weight: float) -> str:
    return f"((cast({x} as double) - {mean}e0) / {scale}e0 * ({weight}e0))"


TX_PUSH = {
    "age_years": _push("age_years", 18.0, 10.0, 0.6),
    "capacity_kva": _push("capacity_kva", 170.0, 85.0, -0.3),
    "loading_mean": _push("loading_mean", 0.6, 0.4, 0.8),
    "loading_max": _push("loading_max", 1.0, 0.6, 1.0),
    "overload_minutes": _push("overload_minutes", 30.0, 60.0, 0.7),
    "sag_count": _push("sag_count", 1.0, 2.0, 0.4),
    "thermal_stress": _push("thermal_stress", 0.3, 1.0, 0.5),
}
TX_CODE = {
    "age_years": "AGED-ASSET", "capacity_kva": "SMALL-DT", "loading_mean": "SUSTAINED-LOAD",
    "loading_max": "PEAK-OVERLOAD", "overload_minutes": "OVERLOAD-TIME", "sag_count": "VOLTAGE-SAGS",
    "thermal_stress": "THERMAL-STRESS",
}
CROP_PUSH = {
    "peak_ndvi": ("peak_ndvi", _push("peak_ndvi", 0.75, 0.12, -0.7)),
    "integ_ndvi": ("integ_ndvi", _push("integ_ndvi", 14.0, 6.0, -0.5)),
    "water_stress": ("water_deficit", _push("water_deficit", 0.35, 0.25, 1.4)),
    "gdd_frac": ("gdd_frac", _push("gdd_frac", 0.9, 0.2, -0.3)),
    "pest_index": ("0.15e0", _push("0.15e0", 0.17, 0.12, 0.6)),
}
CROP_CODE = {
    "peak_ndvi": "LOW-CANOPY", "integ_ndvi": "LOW-BIOMASS", "water_stress": "DRY-SPELL-REPRO",
    "gdd_frac": "HEAT-STRESS", "pest_index": "PEST-PRESSURE",
}


def _factor_rows(source: str, key: str, pushes: dict[str, tuple[str, str]], codes: dict[str, str]) -> str:
    rows = " union all ".join(
        f"select {key}, {i} as idx, '{n}' as feature, '{codes[n]}' as code, {p} as contribution, cast({v} as double) as value from {source}"
        for i, (n, (v, p)) in enumerate(pushes.items())
    )
    return (
        f"select {key}, feature, code, contribution, value, row_number() over (partition by {key} order by place) as pos "
        f"from (select *, row_number() over (partition by {key} order by abs(contribution) desc, idx) as place "
        f"from ({rows}) u) r where place <= 3 and contribution > 0.01"
    )


def _coin(plan: str, unit: str, seed: int) -> str:
    h = f"(({plan} * 7919 + {unit} * 104729 + {seed * 15485863 + 11}) % 2147483647)"
    return f"(({h} * {h} + {plan} * 31 + {unit} * 17) % 2147483647) / 2147483647.0e0"


def _scenarios(rows: list[tuple[int, float]], name: str) -> str:
    return " union all ".join(f"select cast({i} as bigint) as scenario_id, {a}e0 as {name}" for i, a in rows)


SHED_ASKED = [(1, 0.4), (2, 1.2), (3, 5.0)]
WATER_ASKED = [(1, 0.8), (2, 4.0), (3, 12.5)]
PER = 20000 // 3

BLOCKS: dict[str, str] = {
    # ------------------------------------------------------------ grid telemetry
    "slots_of": """select * from (select *,
            row_number() over (partition by meter_id, slot order by ts, reading_id) as rn,
            count(*) over (partition by meter_id, slot) as copies
          from (select *, make_timestamp(cast(round_even(epoch_us(ts) / <us>.0e0, 0) as bigint) * <us>) as slot from readings) s) d where rn = 1""",
    "slots": "select meter_id, slot as ts, kwh, voltage, copies from slots_of",
    "valid": "select * from slots where meter_id in (select meter_id from meters)",
    "repaired": "select *, case when kwh > 100 then kwh / 1000.0e0 else kwh end as fixed from valid",
    "masked": "select meter_id, ts, copies, voltage, case when fixed < 0 then null else fixed end as kwh from repaired",
    "clean": """select meter_id, ts, voltage, coalesce(kwh, median(kwh) over (partition by meter_id), 0.0e0) as kwh,
            case when voltage < 207 then 1 else 0 end as is_sag from masked""",
    "enriched": """select c.*, m.transformer_id, m.customer_class, t.feeder_id, t.capacity_kva, f.substation_id, c.kwh * 4 as kw
          from clean c left join meters m using (meter_id) left join transformers t using (transformer_id)
          left join feeders f using (feeder_id)""",
    "tx_int": """select transformer_id, feeder_id, capacity_kva, ts, sum(kw) as kw, sum(is_sag) as sags, count(meter_id) as n_meters,
            sum(kw) / (capacity_kva * 0.9e0) as loading
          from enriched where transformer_id is not null and feeder_id is not null and capacity_kva is not null group by 1, 2, 3, 4""",
    "fd_int": "select feeder_id, ts, sum(kw) as kw, sum(sags) as sags, sum(capacity_kva) * 0.9e0 as capacity_kw from tx_int group by 1, 2",
    "tx_day": "select * from tx_int where ts > (select max(ts) from tx_int) - interval 24 hours",
    "fd_day": "select * from fd_int where ts > (select max(ts) from fd_int) - interval 24 hours",
    "tx_stress": """select transformer_id, feeder_id, avg(loading) as loading_mean, max(loading) as loading_max,
            sum(case when loading > 1 then 15.0e0 else 0.0e0 end) as overload_minutes, sum(sags) as sag_count,
            sum(power(greatest(loading - 0.8e0, 0.0e0), 2)) as thermal_stress, arg_max(kw, ts) as kw_now
          from tx_day group by 1, 2""",
    "fd_stats": """select feeder_id, max(kw) as peak_kw_24h, avg(kw) as mean_kw_24h, stddev_samp(kw) as std_kw_24h, avg(sags) as sag_rate,
            max(capacity_kw) as capacity_kw, arg_max(kw, ts) as kw_now from fd_day group by 1""",
    "profile": """select *, mean_kw_24h / greatest(peak_kw_24h, 1e-6) as load_factor,
            coalesce(std_kw_24h / greatest(mean_kw_24h, 1e-6), 0.0e0) as volatility, kw_now / greatest(capacity_kw, 1e-6) as utilization_now
          from fd_stats""",
    "mix": """select feeder_id, count(*) filter (customer_class = 'residential') as residential,
            count(*) filter (customer_class = 'commercial') as commercial, count(*) filter (customer_class = 'industrial') as industrial,
            count(*) as customers
          from meters join transformers using (transformer_id) group by 1""",
    # ------------------------------------------------------------ backfill
    "bf_clean": """select m.transformer_id, b.minute as ts, b.fixed as kwh, b.voltage from (
            select *, case when kwh > 100 then kwh / 1000.0e0 else kwh end as fixed,
              row_number() over (partition by meter_id, minute order by ts, reading_id) as rn
            from (select *, date_trunc('minute', ts) as minute from readings) q) b join meters m using (meter_id)
          where rn = 1 and fixed >= 0""",
    "bf_tx": """select transformer_id, feeder_id, capacity_kva, ts, sum(kwh * 4) as kw, sum(case when voltage < 207 then 1 else 0 end) as sags,
            sum(kwh * 4) / (capacity_kva * 0.9e0) as loading
          from bf_clean join transformers using (transformer_id) group by 1, 2, 3, 4""",
    "bf_daily": """select feeder_id, cast(ts as date) as d, max(kw) as peak_kw, avg(kw) as mean_kw,
            sum(case when loading > 1 then 15 else 0 end) as overload_minutes, sum(sags) as sags from bf_tx group by 1, 2""",
    # ------------------------------------------------------------ streams: closed intervals only
    "closing": "select max(slot) - interval 45 minutes as upto from slots_of",
    "st_slots": """select meter_id, slot as ts, voltage, case when kwh > 100 then kwh / 1000.0e0 when kwh >= 0 then kwh else 0.0e0 end as kwh
          from slots_of, closing where slot + interval 15 minutes <= upto""",
    "st_rows": """select feeder_id, transformer_id, capacity_kva, ts, coalesce(kwh, 0.0e0) * 4 as kw, case when voltage < 207 then 1 else 0 end as sag
          from st_slots join meters using (meter_id) join transformers using (transformer_id)""",
    "st_tx": "select transformer_id, feeder_id, capacity_kva, ts, sum(kw) as kw, sum(sag) as sags, count(*) as n_meters, sum(kw) / (capacity_kva * 0.9e0) as loading from st_rows group by 1, 2, 3, 4",
    "st_stress": """select transformer_id, feeder_id, avg(loading) as loading_mean, max(loading) as loading_max,
            sum(case when loading > 1 then 15.0e0 else 0.0e0 end) as overload_minutes, sum(sags) as sag_count,
            sum(power(greatest(loading - 0.8e0, 0.0e0), 2)) as thermal_stress, arg_max(kw, ts) as kw_now
          from st_tx where ts > (select max(ts) from st_tx) - interval 24 hours group by 1, 2""",
    "st_scores": f"""select *, {_logit(list(TX_PUSH.values()), -0.6)} as p_fail_72h from (
            select s.*, t.age_years, t.capacity_kva from st_stress s left join transformers t using (transformer_id)) x""",
    # ------------------------------------------------------------ load grid and forecast
    "span": "select min(ts) as first_ts, max(ts) as last_ts, cast(date_diff('second', min(ts), max(ts)) / <grain> as bigint) as last_slot from fd_int",
    "load_grid": """select c.feeder_id, c.slot, c.ts, f.kw from (
            select feeder_id, slot, first_ts + to_seconds(cast(slot * <grain> as bigint)) as ts
            from (select distinct feeder_id from fd_int) i, (select unnest(generate_series(0, last_slot)) as slot, first_ts from span) s) c
          left join fd_int f on f.feeder_id = c.feeder_id and f.ts = c.ts""",
    "lags": """select *, lag(kw, 1) over w as lag_1, lag(kw, 2) over w as lag_2, lag(kw, 3) over w as lag_3, lag(kw, 4) over w as lag_4,
            lag(kw, <season>) over w as lag_day,
            avg(kw) over (partition by feeder_id order by slot rows between 4 preceding and 1 preceding) as recent_mean
          from load_grid window w as (partition by feeder_id order by slot)""",
    "slot_times": "select distinct slot, ts from load_grid",
    "temperature": """select s.slot, s.ts, coalesce(
            (select arg_max(temp_c, w.ts) from weather w where w.ts <= s.ts),
            (select arg_min(temp_c, w.ts) from weather w where w.ts > s.ts)) as temp_c from slot_times s""",
    "fc_stats": """select feeder_id, n, <steps> as steps,
            avg(kw) filter (slot >= n - least(8, <season>)) as now_kw,
            avg(kw) filter (slot >= n - <season> - least(8, <season>) and slot < n - <season>) as then_kw,
            max(kw) filter (slot = n - 1) as last_kw
          from load_grid, (select last_slot + 1 as n from span) z group by 1, 2""",
    "forecast": f"""select s.feeder_id, cast(step as bigint) as step, z.last_ts + to_seconds(cast(step * <grain> as bigint)) as ts,
            case when s.n > <season> + 8 then
              case when g.kw * level is not null then greatest(g.kw * level, 0) end
            else case when s.last_kw is not null then greatest(s.last_kw, 0) end end as kw
          from (select *, {_clip('now_kw / (then_kw + 1e-6)', 0.6, 1.8)} as level from fc_stats) s, span z,
            (select unnest(generate_series(1, <steps>)) as step) k, load_grid g
          where g.feeder_id = s.feeder_id and g.slot = greatest(s.n - <season>, 0) + step - 1""",
    "peaks": "select feeder_id, max(kw) as forecast_peak_kw from forecast group by 1",
    "future_temp": """select cast(t.slot - (n - <season>) + 1 as bigint) as step, t.temp_c + case when n >= 2 * <season> then today - yesterday else 0 end as temp_c
          from temperature t, (select max(slot) + 1 as n from temperature) c,
            (select avg(temp_c) filter (slot >= m - <season>) as today, avg(temp_c) filter (slot < m - <season> and slot >= m - 2 * <season>) as yesterday
             from temperature, (select max(slot) + 1 as m from temperature) q) d
          where t.slot >= n - <season> and t.slot < n - <season> + <steps>""",
    # ------------------------------------------------------------ grid scores
    "tx_inputs": "select s.*, t.age_years, t.capacity_kva, t.lat, t.lon from tx_stress s left join transformers t using (transformer_id)",
    "tx_scores": f"select *, {_logit(list(TX_PUSH.values()), -0.6)} as p_fail_72h from tx_inputs",
    "tx_factors": _factor_rows("tx_scores", "transformer_id", {n: (n, p) for n, p in TX_PUSH.items()}, TX_CODE),
    "tx_codes": "select transformer_id, string_agg(code, ', ' order by pos) as reason_codes from tx_factors group by 1",
    "tx_risk": """select feeder_id, max(p_fail_72h) as tx_risk_max, avg(p_fail_72h) as tx_risk_mean, count(*) filter (p_fail_72h > 0.5) as tx_high_risk
          from tx_scores group by 1""",
    "assembled": """select p.*, coalesce(tx_risk_max, 0) as tx_risk_max, coalesce(tx_risk_mean, 0) as tx_risk_mean, coalesce(tx_high_risk, 0) as tx_high_risk,
            forecast_peak_kw, residential, commercial, industrial, customers, coalesce(shed_hours_30d, 0) as shed_hours_30d,
            coalesce(complaints_30d, 0) as complaints_30d, f.name, f.substation_id, f.critical_type, f.is_protected, f.lat, f.lon,
            forecast_peak_kw / greatest(capacity_kw, 1e-6) as forecast_stress
          from profile p left join tx_risk using (feeder_id) left join peaks using (feeder_id) left join mix using (feeder_id)
          left join shed_history using (feeder_id) left join feeders f using (feeder_id)""",
    "fleet": """select min(forecast_stress) as fs_lo, max(forecast_stress) as fs_hi, min(0.6e0 * tx_risk_max + 0.4e0 * tx_risk_mean) as tr_lo,
            max(0.6e0 * tx_risk_max + 0.4e0 * tx_risk_mean) as tr_hi, min(utilization_now) as ut_lo, max(utilization_now) as ut_hi,
            min(volatility) as vo_lo, max(volatility) as vo_hi, min(shed_hours_30d) as sh_lo, max(shed_hours_30d) as sh_hi,
            min(complaints_30d) as co_lo, max(complaints_30d) as co_hi from assembled""",
    "components": f"""select a.*, {_norm('forecast_stress', 'fs')} as n_fs, {_norm('(0.6e0 * tx_risk_max + 0.4e0 * tx_risk_mean)', 'tr')} as n_tr,
            {_norm('utilization_now', 'ut')} as n_ut, {_norm('volatility', 'vo')} as n_vo, {_norm('shed_hours_30d', 'sh')} as n_sh,
            {_norm('cast(complaints_30d as double)', 'co')} as n_co from assembled a, fleet""",
    "scored": f"""select *, {dec('0.35e0 * n_fs + 0.30e0 * n_tr + 0.20e0 * n_ut + 0.15e0 * n_vo', 4)} as fci,
            {dec('n_fs', 4)} as c_forecast_stress, {dec('n_tr', 4)} as c_tx_risk, {dec('n_ut', 4)} as c_utilization, {dec('n_vo', 4)} as c_volatility,
            case when is_protected then 9.99e0 else {dec('0.45e0 * ((0.35e0 * residential + 0.50e0 * commercial + 0.65e0 * industrial) / greatest(customers, 1)) + 0.35e0 * n_sh + 0.20e0 * n_co', 4)} end as pain_score,
            {dec('kw_now / 1000.0e0', 3)} as sheddable_mw, {dec('(capacity_kw - forecast_peak_kw) / 1000.0e0', 3)} as headroom_mw
          from components""",
    "ranked": """select *, row_number() over (order by fci desc nulls last, feeder_id) as rank,
            concat_ws(', ', case when forecast_stress > 0.95 then 'OVERLOAD-4H' end,
              case when tx_high_risk >= 1 then 'TX-RISK×' || cast(tx_high_risk as varchar) end,
              case when utilization_now > 0.9 then 'AT-LIMIT' end, case when c_volatility > 0.7 then 'VOLATILE' end,
              case when is_protected then 'PROTECTED-' || upper(critical_type) when shed_hours_30d > 8 then 'RECENT-SHED' else 'FAIR-OK' end,
              case when sag_rate > 0.5 then 'SAGS' end) as reason_codes
          from scored""",
    "sys_load": "select ts, sum(kw) / 1000.0e0 as mw from fd_int group by 1",
    "sys_forecast": "select step, ts, sum(kw) / 1000.0e0 as mw from forecast group by 1, 2",
    "grid_summary": f"""select {dec('now_mw', 1)} as current_mw, {dec('peak', 1)} as forecast_peak_mw, {dec('cap_kw / 1000.0e0', 1)} as capacity_mw,
            {dec('0.88e0 * peak', 1)} as supply_cap_mw, greatest({dec('peak - ' + dec('0.88e0 * peak', 1), 1)}, 0.0e0) as deficit_mw,
            temp_now_c, feeders, protected_feeders, tx_watchlist
          from (select sum(capacity_kw) as cap_kw, count(*) as feeders, count(*) filter (is_protected) as protected_feeders,
                  count(*) filter (tx_high_risk > 0) as tx_watchlist from scored) f,
            (select arg_max(mw, ts) as now_mw from sys_load) n, (select max(mw) as peak from sys_forecast) p,
            (select arg_max(temp_c, ts) as temp_now_c from weather) w""",
    # ------------------------------------------------------------ shed plans
    "shed_elig": "select * from ranked where not is_protected and sheddable_mw > 0.01",
    "shed_fleet": "select sum(sheddable_mw) as total, max(shed_hours_30d) as hours from shed_elig",
    "shed_units": f"""select scenario_id, {dec('least(asked_mw, 0.95e0 * total)')} as target_mw, total, feeder_id as unit_no, name, rank,
            sheddable_mw as mw, pain_score as pain, shed_hours_30d, shed_hours_30d / (hours + 1e-6) as fair
          from shed_elig, shed_fleet, ({_scenarios(SHED_ASKED, 'asked_mw')}) s""",
    "shed_greedy": f"""select * from (select *, coalesce(sum(mw) over (partition by scenario_id order by cost, unit_no
              rows between unbounded preceding and 1 preceding), 0) as before
            from (select *, cast(round(cast((pain + 0.3e0 * fair) / greatest(mw, 1e-3) as decimal(28,10)), 9) as double) as cost from shed_units) c) g
          where {dec('before')} < target_mw""",
    "shed_draws": f"""select u.*, p.plan_id from shed_units u, (select unnest(generate_series(1, {3 * PER})) as plan_id) p
          where {_coin('plan_id', 'unit_no', 0)} < least(0.95e0, least(0.9e0, target_mw / greatest(total, 1e-6)) *
            case (plan_id - 1) // {PER} when 0 then 0.8e0 when 1 then 1.0e0 else 1.3e0 end)""",
    "shed_members": """select scenario_id, target_mw, unit_no, name, rank, mw, pain, fair, plan_id from shed_draws
          union all select scenario_id, target_mw, unit_no, name, rank, mw, pain, fair, 0 from shed_greedy""",
    "shed_all": f"""select p.scenario_id, p.target_mw, p.plan_id, coalesce(n, 0) as n_members, coalesce(mw, 0) as mw, coalesce(pain, 0) as pain, coalesce(fair, 0) as fair
          from (select distinct scenario_id, target_mw, unnest(generate_series(0, {3 * PER})) as plan_id from (select distinct scenario_id, target_mw from shed_units) q) p
          left join (select scenario_id, plan_id, count(*) as n, {dec('sum(mw)')} as mw, {dec('sum(pain)')} as pain, {dec('sum(fair)')} as fair
            from shed_members group by 1, 2) t on t.scenario_id = p.scenario_id and t.plan_id = p.plan_id""",
    "shed_scored": f"""select *, {dec('pain + 0.3e0 * fair + 10.0e0 * greatest(target_mw - mw, 0) + 0.15e0 * greatest(mw - target_mw, 0)')} as score from shed_all""",
    "shed_best": "select * from (select *, row_number() over (partition by scenario_id order by score, plan_id) as place from shed_scored) b where place <= 40",
    "shed_best_members": "select m.*, b.place, b.mw as relief from shed_members m join shed_best b using (scenario_id, plan_id)",
    "shed_line": "select *, row_number() over (partition by scenario_id, plan_id order by rank, unit_no) as pos from shed_best_members",
    "shed_refined_members": "select l.* from shed_line l join shed_walk w using (scenario_id, plan_id, pos) where w.kept",
    "shed_sets": "select scenario_id, plan_id, place, string_agg(cast(unit_no as varchar), ',' order by unit_no) as members from shed_refined_members group by 1, 2, 3",
    "shed_firsts": "select scenario_id, arg_min(plan_id, place) as plan_id from shed_sets group by scenario_id, members",
    "shed_final": f"""select *, {dec('pain + 0.3e0 * fair + 10.0e0 * greatest(target_mw - mw, 0) + 0.15e0 * greatest(mw - target_mw, 0)')} as score from (
            select scenario_id, plan_id, target_mw, count(*) as n_members, {dec('sum(m.mw)')} as mw, {dec('sum(pain)')} as pain, {dec('sum(fair)')} as fair
            from shed_refined_members m join shed_firsts using (scenario_id, plan_id) group by 1, 2, 3) t""",
    # ------------------------------------------------------------ agro passes
    "days_of": """select *, row_number() over (partition by plot_id, date order by pass_ts, pass_no) as rn,
            count(*) over (partition by plot_id, date) as copies
          from (select *, date_trunc('day', pass_ts) as date from ndvi) d""",
    "days": "select plot_id, date, ndvi, cloud_flag, copies from days_of where rn = 1",
    "ndvi_fixed": "select *, case when ndvi > 1.5 then ndvi / 10000.0e0 else ndvi end as fixed from days where plot_id in (select plot_id from plots)",
    "ndvi_masked": "select plot_id, date, case when cloud_flag = 1 or fixed < 0.05 or fixed > 1.0 then null else fixed end as ndvi from ndvi_fixed",
    "ndvi_pos": "select *, row_number() over (partition by plot_id order by date) as spot from ndvi_masked",
    "ndvi_near": """select *, max(case when ndvi is not null then spot end) over (partition by plot_id order by spot) as spot_prev,
            min(case when ndvi is not null then spot end) over (partition by plot_id order by spot desc) as spot_next from ndvi_pos""",
    "ndvi_line": """select n.plot_id, n.date, coalesce(n.ndvi, p.ndvi + (x.ndvi - p.ndvi) * (n.spot - n.spot_prev) / cast(n.spot_next - n.spot_prev as double), p.ndvi, x.ndvi) as ndvi
          from ndvi_near n left join ndvi_pos p on p.plot_id = n.plot_id and p.spot = n.spot_prev
          left join ndvi_pos x on x.plot_id = n.plot_id and x.spot = n.spot_next""",
    "ndvi_filled": "select plot_id, date, coalesce(ndvi, (select median(ndvi) from ndvi_line)) as ndvi from ndvi_line",
    "ndvi_smooth": "select *, avg(ndvi) over (partition by plot_id order by date rows between 1 preceding and 1 following) as ndvi_smooth from ndvi_filled",
    "passes": """select s.*, p.village_id, p.crop, p.area_ha, p.irrigation, v.block_id, v.district_id, v.canal_reach
          from ndvi_smooth s left join plots p using (plot_id) left join villages v using (village_id)""",
    "plot_season": """select plot_id, village_id, crop, area_ha, irrigation, canal_reach, block_id, max(ndvi_smooth) as peak_ndvi, avg(ndvi_smooth) as mean_ndvi,
            sum(ndvi_smooth) as integ_ndvi, arg_max(ndvi_smooth, date) as last_ndvi
          from passes where village_id is not null and block_id is not null group by 1, 2, 3, 4, 5, 6, 7""",
    "village_date": "select village_id, date, avg(ndvi_smooth) as ndvi from passes where village_id is not null group by 1, 2",
    "weather_days": """select *, row_number() over (partition by block_id order by date) as day_no, count(*) over (partition by block_id) as n_days,
            greatest((tmax + tmin) / 2.0e0 - 10.0e0, 0.0e0) as gdd from block_weather""",
    "block_season": """select block_id, sum(gdd) as gdd_total, sum(rain_mm) as rain_total,
            coalesce(sum(rain_mm) filter (n_days < 84 or day_no between 55 and 84), 0) as rain_repro,
            count(*) filter ((n_days < 84 or day_no between 55 and 84) and rain_mm < 1) as dry_days_repro from weather_days group by 1""",
    "trend": """select village_id, arg_max(ndvi, date) - arg_min(ndvi, date) as ndvi_trend
          from (select *, row_number() over (partition by village_id order by date desc) as back from village_date) t where back <= 3 group by 1""",
    "vf": f"""select s.*, ndvi_trend, gdd_total, rain_total, rain_repro, dry_days_repro, v.district_id, v.name, v.past_support_index, v.lat, v.lon,
            {_clip('gdd_total / 1650.0e0', 0.4, 1.3)} as gdd_frac, {_clip('dry_days_repro / 30.0e0', 0.0, 1.0)} as water_deficit
          from (select village_id, block_id, canal_reach, avg(peak_ndvi) as peak_ndvi, avg(mean_ndvi) as mean_ndvi, avg(integ_ndvi) as integ_ndvi,
              avg(last_ndvi) as last_ndvi, sum(area_ha) as area_ha, count(*) as plots, avg(case when irrigation = 'rainfed' then 1.0e0 else 0.0e0 end) as rainfed_frac
            from plot_season group by 1, 2, 3) s
          left join trend using (village_id) left join block_season using (block_id) left join villages v using (village_id)""",
    "stress_index": """select plot_id, village_id, area_ha, case when dry_days_repro is not null then least(greatest(dry_days_repro / 22.0e0 *
            case crop when 'rice' then 1.0e0 when 'cotton' then 0.7e0 when 'maize' then 0.85e0 when 'soybean' then 0.8e0 end *
            (1.0e0 - case irrigation when 'canal' then 0.55e0 when 'borewell' then 0.75e0 else 0.0e0 end - (soil_awc - 80) / 100.0e0 * 0.25e0), 0.0e0), 0.85e0) end as water_stress
          from plots join villages using (village_id) join block_season using (block_id)""",
    "gdd_cum": "select block_id, date, sum(gdd) over (partition by block_id order by date) as gdd_cum, sum(rain_mm) over (partition by block_id order by date) as rain_cum from weather_days",
    # ------------------------------------------------------------ agro scores
    "v_scores": f"""select *, {_logit([p for _, p in CROP_PUSH.values()], -0.4)} as p_loss,
            greatest(1.1e0 + 1.6e0 * peak_ndvi + 0.03e0 * integ_ndvi - 1.2e0 * water_deficit + 0.8e0 * gdd_frac - 1.0e0 * 0.15e0, 0.2e0) as yield_pred from vf""",
    "v_factors": _factor_rows("v_scores", "village_id", CROP_PUSH, CROP_CODE),
    "v_codes": "select village_id, string_agg(code, ', ' order by pos) as model_codes from v_factors group by 1",
    "v_normal": """select v.*, coalesce(h.normal_yield, (select median(yield_pred) from v_scores)) as normal_yield from v_scores v
          left join (select village_id, avg(normal_yield) as normal_yield from yield_history group by 1) h using (village_id)""",
    "v_short": f"select *, {_clip('(normal_yield - yield_pred) / greatest(normal_yield, 1e-6)', -0.5, 1.0)} as yield_shortfall_frac from v_normal",
    "v_raw": "select *, greatest(yield_shortfall_frac, 0) as up, greatest(-ndvi_trend, 0) as fall, rainfed_frac * ln(1 + area_ha) as expo from v_short",
    "v_fleet": "select min(p_loss) as pl_lo, max(p_loss) as pl_hi, min(up) as up_lo, max(up) as up_hi, min(fall) as fa_lo, max(fall) as fa_hi, min(expo) as ex_lo, max(expo) as ex_hi from v_raw",
    "v_parts": f"""select r.*, {_norm('p_loss', 'pl')} as n_pl, {_norm('up', 'up')} as n_up, {_norm('fall', 'fa')} as n_fa, {_norm('expo', 'ex')} as n_ex,
            case when yield_pred < 0.8e0 * normal_yield then 1 else 0 end as yield_trigger, case when water_deficit > 0.5 then 1 else 0 end as rain_trigger
          from v_raw r, v_fleet""",
    "v_scored": f"""select *, {dec('0.35e0 * n_pl + 0.30e0 * n_up + 0.20e0 * n_fa + 0.15e0 * n_ex', 4)} as vapi, {dec('n_pl', 4)} as c_loss_risk,
            {dec('n_up', 4)} as c_yield_shortfall, {dec('n_fa', 4)} as c_ndvi_decline, {dec('n_ex', 4)} as c_exposure,
            {dec('0.6e0 * up + 0.4e0 * water_deficit', 4)} as trigger_score,
            {dec('p_loss * greatest(water_deficit, 0.05e0) * yield_pred * area_ha * 0.35e0', 3)} as yield_saveable_t,
            {dec('area_ha * 0.06e0 * (0.5e0 + water_deficit)', 3)} as water_need_ml, greatest(yield_trigger, rain_trigger) as insurance_trigger
          from v_parts""",
    "v_ranked": """select s.*, row_number() over (order by vapi desc nulls last, village_id) as rank,
            concat_ws(', ', model_codes, case when insurance_trigger = 1 then 'TRIGGER-HIT' end, case when yield_shortfall_frac > 0.25 then 'YIELD-SHORT' end,
              case when ndvi_trend < -0.05 then 'NDVI-DECLINE' end,
              case when canal_reach = 'tail' and past_support_index < 0.4 then 'TAIL-UNDERSERVED' when past_support_index > 0.7 then 'WELL-SERVED' else 'FAIR-OK' end) as reason_codes
          from v_scored s left join v_codes using (village_id)""",
    "agro_summary": f"""select count(*) as villages, sum(plots) as plots_total, {dec('sum(area_ha)', 1)} as total_area_ha,
            {dec('coalesce(sum(area_ha) filter (p_loss > 0.5), 0)', 1)} as at_risk_area_ha,
            {dec('100.0e0 * coalesce(sum(area_ha) filter (p_loss > 0.5), 0) / greatest(sum(area_ha), 1e-6)', 1)} as at_risk_pct,
            sum(insurance_trigger) as insurance_triggers, {dec('avg(yield_pred)', 2)} as mean_yield_pred, {dec('avg(normal_yield)', 2)} as mean_normal_yield,
            {dec('sum(yield_saveable_t)', 1)} as yield_saveable_total_t, {dec('sum(water_need_ml)', 1)} as water_need_total_ml,
            count(*) filter (canal_reach = 'tail') as tail_villages from v_scored""",
    # ------------------------------------------------------------ irrigation plans
    "water_elig": "select * from v_scored where water_need_ml > 1e-3 and yield_saveable_t > 1e-3",
    "water_units": f"""select scenario_id, {dec('least(asked_ml, total)')} as budget_ml, total, village_id as unit_no, name, canal_reach, yield_saveable_t as benefit,
            water_need_ml as water, 1.0e0 - past_support_index as fair, case when canal_reach = 'tail' then 1.0e0 else 0.0e0 end as tail
          from water_elig, (select sum(water_need_ml) as total from water_elig) t, ({_scenarios(WATER_ASKED, 'asked_ml')}) s""",
    "water_line": """select *, row_number() over (partition by scenario_id order by density desc, unit_no) as pos from (
            select *, cast(round(cast((benefit + 0.35e0 * fair) / greatest(water, 1e-3) as decimal(28,10)), 9) as double) as density from water_units) d""",
    "water_greedy": "select l.* from water_line l join water_walk w using (scenario_id, pos) where w.kept",
    "water_draws": f"""select u.*, p.plan_id from water_units u, (select unnest(generate_series(1, {3 * PER})) as plan_id) p
          where {_coin('plan_id', 'unit_no', 0)} < case (plan_id - 1) // {PER} when 0 then least(0.95e0, budget_ml / greatest(total, 1e-6)) * 0.8e0
            when 1 then least(0.95e0, budget_ml / greatest(total, 1e-6)) * 1.0e0
            else least(0.97e0, least(0.95e0, budget_ml / greatest(total, 1e-6)) * 1.3e0) end""",
    "water_members": """select scenario_id, budget_ml, unit_no, name, benefit, water, fair, tail, plan_id from water_draws
          union all select scenario_id, budget_ml, unit_no, name, benefit, water, fair, tail, 0 from water_greedy""",
    "water_all": f"""select p.scenario_id, p.budget_ml, p.plan_id, coalesce(n, 0) as n_members, coalesce(benefit, 0) as benefit, coalesce(water, 0) as water, coalesce(fair, 0) as fair
          from (select scenario_id, budget_ml, unnest(generate_series(0, {3 * PER})) as plan_id from (select distinct scenario_id, budget_ml from water_units) q) p
          left join (select scenario_id, plan_id, count(*) as n, {dec('sum(benefit)')} as benefit, {dec('sum(water)')} as water, {dec('sum(fair)')} as fair
            from water_members group by 1, 2) t on t.scenario_id = p.scenario_id and t.plan_id = p.plan_id""",
    "water_scored": f"select *, {dec('-(benefit + 0.35e0 * fair) + 100.0e0 * greatest(water - budget_ml, 0)')} as score from water_all",
    "water_best": "select * from (select *, row_number() over (partition by scenario_id order by score, plan_id) as place from water_scored) b where place <= 15",
    "water_inside": "select m.*, b.place, b.water as used from water_members m join water_best b using (scenario_id, plan_id)",
    "water_outside": """select u.scenario_id, b.plan_id, b.place, u.budget_ml, u.unit_no, u.benefit, u.water, u.fair, u.tail, b.water as used
          from water_units u join water_best b on b.scenario_id = u.scenario_id
          where not exists (select 1 from water_members m where m.scenario_id = u.scenario_id and m.plan_id = b.plan_id and m.unit_no = u.unit_no)""",
    "water_add1": f"select * from (select *, row_number() over (partition by scenario_id, plan_id order by benefit desc, unit_no) as pick from water_outside where {dec('used + water')} <= budget_ml) a where pick = 1",
    "water_left1": "select o.scenario_id, o.plan_id, o.place, o.budget_ml, o.unit_no, o.benefit, o.water, o.fair, o.tail, o.used + a.water as used from water_outside o join water_add1 a using (scenario_id, plan_id) where o.unit_no <> a.unit_no",
    "water_add2": f"select * from (select *, row_number() over (partition by scenario_id, plan_id order by benefit desc, unit_no) as pick from water_left1 where {dec('used + water')} <= budget_ml) a where pick = 1",
    "water_left2": "select o.scenario_id, o.plan_id, o.place, o.budget_ml, o.unit_no, o.benefit, o.water, o.fair, o.tail, o.used + a.water as used from water_left1 o join water_add2 a using (scenario_id, plan_id) where o.unit_no <> a.unit_no",
    "water_add3": f"select * from (select *, row_number() over (partition by scenario_id, plan_id order by benefit desc, unit_no) as pick from water_left2 where {dec('used + water')} <= budget_ml) a where pick = 1",
    "water_refined": """select scenario_id, plan_id, place, budget_ml, unit_no, benefit, water, fair, tail from water_inside
          union all select scenario_id, plan_id, place, budget_ml, unit_no, benefit, water, fair, tail from water_add1
          union all select scenario_id, plan_id, place, budget_ml, unit_no, benefit, water, fair, tail from water_add2
          union all select scenario_id, plan_id, place, budget_ml, unit_no, benefit, water, fair, tail from water_add3""",
    "water_sets": "select scenario_id, plan_id, place, string_agg(cast(unit_no as varchar), ',' order by unit_no) as members from water_refined group by 1, 2, 3",
    "water_firsts": "select scenario_id, arg_min(plan_id, place) as plan_id from water_sets group by scenario_id, members",
    "water_final": f"""select *, {dec('-(benefit + 0.35e0 * fair) + 100.0e0 * greatest(water - budget_ml, 0)')} as score from (
            select scenario_id, plan_id, budget_ml, count(*) as n_members, {dec('sum(benefit)')} as benefit, {dec('sum(water)')} as water, {dec('sum(fair)')} as fair, avg(tail) as tail_share
            from water_refined join water_firsts using (scenario_id, plan_id) group by 1, 2, 3) t""",
}

# walks in order, one row at a time
RECURSIVE: dict[str, str] = {
    "shed_walk": """select scenario_id, plan_id, cast(0 as bigint) as pos, false as kept, max(relief) as relief from shed_line group by 1, 2
          union all
          select l.scenario_id, l.plan_id, l.pos, not (s.change < -1e-6), case when s.change < -1e-6 then w.relief - l.mw else w.relief end
          from shed_walk w join shed_line l on l.scenario_id = w.scenario_id and l.plan_id = w.plan_id and l.pos = w.pos + 1,
            lateral (select 10.0e0 * greatest(l.target_mw - (w.relief - l.mw), 0) + 0.15e0 * greatest(w.relief - l.mw - l.target_mw, 0)
              - 10.0e0 * greatest(l.target_mw - w.relief, 0) - 0.15e0 * greatest(w.relief - l.target_mw, 0) - l.pain - 0.3e0 * l.fair as change) s""",
    "water_walk": """select distinct scenario_id, cast(0 as bigint) as pos, false as kept, cast(0 as double) as used from water_line
          union all
          select l.scenario_id, l.pos, w.used + l.water <= l.budget_ml + 1e-9, case when w.used + l.water <= l.budget_ml + 1e-9 then w.used + l.water else w.used end
          from water_walk w join water_line l on l.scenario_id = w.scenario_id and l.pos = w.pos + 1""",
}

# fitted models: rows that are not held out, weights, and live rows with the push of each input
TX_HELD = "((row_key % 1000003) * 7919 + (row_key % 998244353) * 104729 + 17) % 10007 % 100 >= 85"
CROP_HELD = "(((village_id * 10007 + season) % 1000003) * 7919 + ((village_id * 10007 + season) % 998244353) * 104729 + 17) % 10007 % 100 >= 85"


def _fitted_push(inputs: list[str]) -> list[str]:
    return [f"((cast({v} as double) - m{i}) / s{i} * x{i})" for i, v in enumerate(inputs, 1)]


_RISK_FIT, _RISK_W = fits.logit(f"select * from tx_history where not ({TX_HELD})", tuple(TX_PUSH), "failed_next72h", "rl")
_LOSS_FIT, _LOSS_W = fits.logit(f"select * from yield_history where not ({CROP_HELD})", tuple(CROP_PUSH), "loss_event", "ll")
_YIELD_FIT, _YIELD_W = fits.ridge("select * from yield_history", tuple(CROP_PUSH), "yield_t_ha", "yr")
_RISK_BOOST, RISK_BOOSTED = fits.boosted("select * from tx_history", TX_HELD, tuple(TX_PUSH), "failed_next72h", "rb", rounds=2, depth=3, cuts=15, rate=0.3)
_LOSS_BOOST, LOSS_BOOSTED = fits.boosted("select * from yield_history", CROP_HELD, tuple(CROP_PUSH), "loss_event", "lb", rounds=2, depth=3, cuts=15, rate=0.3)
_CROP_LIVE = [v for v, _ in CROP_PUSH.values()]
_ONES = lambda parts: "1.0e0 / (1.0e0 + exp(-(x0 + " + " + ".join(parts) + ")))"
BLOCKS |= dict(_RISK_FIT + _LOSS_FIT + _YIELD_FIT + _RISK_BOOST + _LOSS_BOOST) | {
    "rl_live": f"select t.*, m.*, w.* from tx_inputs t, rl_m m, {_RISK_W} w",
    "rl_factors": _factor_rows("rl_live", "transformer_id", dict(zip(TX_PUSH, zip(TX_PUSH, _fitted_push(list(TX_PUSH))))), TX_CODE),
    "rl_codes": "select transformer_id, string_agg(code, ', ' order by pos) as reason_codes from rl_factors group by 1",
    "rl_scores": f"select transformer_id, feeder_id, {_ONES(_fitted_push(list(TX_PUSH)))} as p_fail_72h from rl_live",
    "ll_live": f"select v.*, m.*, w.* from vf v, ll_m m, {_LOSS_W} w",
    "ll_factors": _factor_rows("ll_live", "village_id", dict(zip(CROP_PUSH, zip(_CROP_LIVE, _fitted_push(_CROP_LIVE)))), CROP_CODE),
    "ll_codes": "select village_id, string_agg(code, ', ' order by pos) as model_codes from ll_factors group by 1",
    "ll_scores": f"select village_id, {_ONES(_fitted_push(_CROP_LIVE))} as p_loss from ll_live",
    "yr_live": f"select village_id, greatest(x0 + {' + '.join(_fitted_push(_CROP_LIVE))}, 0.2e0) as yield_pred from vf, yr_m, {_YIELD_W}",
    "yr_fit": f"select village_id, season, yield_t_ha, x0 + {' + '.join(_fitted_push(list(CROP_PUSH)))} as yield_fit from yield_history, yr_m, {_YIELD_W}",
}

_MAPPED = {
    name: text.replace("{days}", "unnest(generate_series(0, 119))").format(**{t: t for t in SOURCE_TABLES})
    for name, text in TEXTS.items()
}
_ALL = {**_MAPPED, **BLOCKS, **RECURSIVE}
_WORD = re.compile(r"[a-z_][a-z0-9_]*")
# block names only count where a table is read
_READ = re.compile(r"(?:from|join|,)\s+\(?\s*([a-z_][a-z0-9_]*)")


def _needs(text: str, own: str) -> list[str]:
    return [w for w in dict.fromkeys(_READ.findall(text)) if w in _ALL and w != own]


def _collect(text: str, own: str, done: dict[str, str]) -> None:
    for name in _needs(text, own):
        if name not in done:
            _collect(_ALL[name], name, done)
            done[name] = _ALL[name]


_TYPES = {
    "i": lambda c: f"cast({c} as bigint) as {c}",
    "d": lambda c: f"{dec(c)} as {c}",
    "t": lambda c: f"cast({c} as timestamp) as {c}",
    "s": lambda c: f"cast({c} as varchar) as {c}",
    "b": lambda c: f"cast({c} as boolean) as {c}",
    "a": lambda c: f"cast({c} as date) as {c}",
}


def sql(columns: str, body: str, grain: int = 900) -> str:
    done: dict[str, str] = {}
    _collect(body, "", done)
    recursive = "recursive " if any(n in RECURSIVE for n in done) else ""
    blocks = ",\n".join(f"{n} as ({t})" for n, t in done.items())
    picked = ", ".join(_TYPES[kind](name) for name, kind in (c.split(":") for c in columns.split()))
    text = (f"with {recursive}{blocks}\n" if blocks else "") + f"select {picked} from (\n{body}\n) result"
    season = 86400 // grain
    for key, value in {"us": grain * 1_000_000, "grain": grain, "season": season, "steps": min(16, season)}.items():
        text = text.replace(f"<{key}>", str(value))
    return text

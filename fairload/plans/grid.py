"""The grid job: readings to ranked feeders, forecasts and shed plans.

Every stage is a lazy DataFrame. ``stage`` decides what happens to results that several later
stages read: nothing (one big lazy plan), or ``session.staged`` (written once to shared storage).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairload.functions.numeric import rounded
from fairload.functions.ordering import auc, ranked
from fairload.operators import cleaning, enrich, features, forecast, learning, plansearch, rollup, scoring
from fairload.settings import GridSettings

Stage = Callable[[DataFrame, str], DataFrame]


def as_is(df: DataFrame, label: str) -> DataFrame:
    return df


@dataclass(frozen=True)
class GridModels:
    """How the models of the job are boosted."""

    risk: learning.Boosting = learning.RISK
    load: learning.Boosting = learning.LOAD


class GridPlan:
    """``models`` None: closed-form stand-ins for risk and a seasonal forecast, which SQL can check."""

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        settings: GridSettings = GridSettings(),
        stage: Stage = as_is,
        models: GridModels | None = None,
    ):
        self.tables, self.p, self.stage, self.models = tables, settings, stage, models

    # ---- telemetry
    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.clean_readings(self.tables["readings"], self.tables["meters"], self.p)

    @cached_property
    def ledger(self) -> DataFrame:
        return cleaning.grid_ledger(self.tables["readings"], self.tables["meters"], self.p)

    @cached_property
    def enriched(self) -> DataFrame:
        t = self.tables
        return enrich.enriched_readings(self.clean, t["meters"], t["transformers"], t["feeders"], self.p)

    @cached_property
    def tx_int(self) -> DataFrame:
        t = self.tables
        return self.stage(rollup.transformer_interval(self.clean, t["meters"], t["transformers"], self.p), "tx_int")

    @cached_property
    def fd_int(self) -> DataFrame:
        return self.stage(rollup.feeder_interval(self.tx_int, self.p), "fd_int")

    # ---- features
    @cached_property
    def tx_stress(self) -> DataFrame:
        return features.transformer_stress(self.tx_int)

    @cached_property
    def profile(self) -> DataFrame:
        return features.feeder_profile(self.fd_int)

    @cached_property
    def mix(self) -> DataFrame:
        return features.customer_mix(self.tables["meters"], self.tables["transformers"])

    @cached_property
    def load_grid(self) -> DataFrame:
        return features.load_grid(self.fd_int, self.p)

    @cached_property
    def temperature(self) -> DataFrame:
        """slot, ts, temp_c on the regular grid of the load."""
        slots = features.slot_list(self.fd_int, self.p)
        return slots.join(enrich.weather_at(slots, self.tables["weather"]), "ts")

    @cached_property
    def load_features(self) -> DataFrame:
        return features.load_features(features.load_lags(self.load_grid, self.p), self.temperature)

    # ---- forecast
    @cached_property
    def forecast(self) -> DataFrame:
        fitted = self.models and learning.train_load(self.load_features, self.p, self.models.load)
        if fitted:
            ahead = learning.recursive_forecast(fitted, self.recent_grid, self.future_temperature, self.p)
            return self.stage(ahead, "forecast")
        return forecast.seasonal_naive(self.recent_grid, self.p)

    @cached_property
    def recent_grid(self) -> DataFrame:
        """The load grid of the last day and a window before it, all that a forecast looks at."""
        return features.load_grid(self.fd_int, self.p, last=self.p.slots_per_day + 8)

    @cached_property
    def future_temperature(self) -> DataFrame:
        return forecast.future_temperature(self.temperature, self.p)

    # ---- scores
    @cached_property
    def risk_model(self) -> learning.Ensemble:
        return learning.train_risk(self.tables["tx_history"], self.models.risk)

    @cached_property
    def risk_auc(self) -> DataFrame:
        """One row: positives, negatives and auc of the held-out history."""
        history, key = self.tables["tx_history"], F.col("row_key")
        if self.models:
            return learning.holdout_auc(self.risk_model, history, key, "failed_next72h")
        held = scoring.history_scores(history).where(scoring.held_out(key))
        return auc(held, "failed_next72h", "p", bounds=(0.0, 1.0))

    @cached_property
    def tx_scores(self) -> DataFrame:
        if self.models:
            fitted = learning.score_transformers(self.risk_model, self.tx_stress, self.tables["transformers"])
            return self.stage(fitted, "tx_scores")
        return scoring.score_transformers(self.tx_stress, self.tables["transformers"])

    @cached_property
    def assembled(self) -> DataFrame:
        t = self.tables
        return self.stage(
            scoring.assemble_feeders(
                self.profile,
                scoring.risk_by_feeder(self.tx_scores),
                forecast.forecast_peaks(self.forecast),
                self.mix,
                t["shed_history"],
                t["feeders"],
            ),
            "feeders",
        )

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score_feeders(self.assembled)

    @cached_property
    def ranked(self) -> DataFrame:
        return ranked(self.scored, F.col("fci"), ["feeder_id"], bounds=(0.0, 1.0))

    @cached_property
    def state(self) -> DataFrame:
        cols = scoring.feeder_state(self.ranked).columns
        return self.stage(self.ranked.select(*cols, "rank"), "feeder_state")

    @cached_property
    def system_load(self) -> DataFrame:
        return rollup.system_load(self.fd_int)

    @cached_property
    def system_forecast(self) -> DataFrame:
        return forecast.system_forecast(self.forecast)

    @cached_property
    def summary(self) -> DataFrame:
        return scoring.grid_summary(self.scored, self.system_load, self.system_forecast, self.tables["weather"])

    # ---- plans
    def default_target(self) -> float:
        """The supply deficit, at least 5 MW."""
        row = self.summary.select("deficit_mw").first()
        return max(row[0] or 0.0, 5.0)

    def shed_units(self, scenarios: list[plansearch.Scenario], search: plansearch.Search) -> DataFrame:
        return self.stage(plansearch.shed_units(self.state, scenarios, search), "shed_units")

    # ---- result records
    @cached_property
    def recent_series(self) -> DataFrame:
        """Last day of each feeder in MW, every fourth interval, as one array for each feeder.

        A feeder has at most one day of intervals here, so the array is short.
        """
        day = features.trailing_day(self.fd_int)
        points = day.groupBy("feeder_id").agg(F.array_sort(F.collect_list(F.struct("ts", "kw"))).alias("_s"))
        every4 = F.filter("_s", lambda e, i: i % 4 == 0)
        return points.select("feeder_id", F.transform(every4, lambda e: rounded(e["kw"] / 1000.0, 3)).alias("recent_mw"))

    @cached_property
    def forecast_series(self) -> DataFrame:
        points = self.forecast.groupBy("feeder_id").agg(F.array_sort(F.collect_list(F.struct("step", "kw"))).alias("_s"))
        return points.select("feeder_id", F.transform("_s", lambda e: rounded(e["kw"] / 1000.0, 3)).alias("forecast_mw"))

    @cached_property
    def feeder_cards(self) -> DataFrame:
        """One nested record for each ranked feeder."""
        parts = F.struct(
            *[F.col(f"c_{k}").alias(k) for k in ("forecast_stress", "tx_risk", "utilization", "volatility")]
        ).alias("components")
        empty = F.array().cast("array<double>")
        return (
            self.ranked.join(self.recent_series, "feeder_id", "left")
            .join(self.forecast_series, "feeder_id", "left")
            .select(
                "rank",
                "feeder_id",
                "name",
                "substation_id",
                "lat",
                "lon",
                "fci",
                parts,
                "reason_codes",
                rounded(F.col("kw_now") / 1000.0, 3).alias("current_mw"),
                rounded(F.col("forecast_peak_kw") / 1000.0, 3).alias("forecast_peak_mw"),
                rounded(F.col("capacity_kw") / 1000.0, 3).alias("capacity_mw"),
                "headroom_mw",
                "sheddable_mw",
                "pain_score",
                "is_protected",
                "critical_type",
                "shed_hours_30d",
                "complaints_30d",
                "customers",
                "tx_high_risk",
                rounded(F.col("utilization_now"), 3).alias("utilization_now"),
                F.coalesce("recent_mw", empty).alias("recent_mw"),
                F.coalesce("forecast_mw", empty).alias("forecast_mw"),
            )
        )

    def watchlist(self, top: int | None = None) -> DataFrame:
        """Transformers, the most likely to fail first if ``top`` asks for so many; all without it."""
        detail = F.transform(
            "factors",
            lambda e: F.struct(
                e["feature"].alias("feature"),
                rounded(e["contribution"], 3).alias("contribution"),
                rounded(e["value"], 2).alias("value"),
            ),
        ).alias("contributions")
        best = self.tx_scores.withColumn("p_fail_72h", rounded(F.col("p_fail_72h"), 4))
        if top is not None:
            best = best.orderBy(F.col("p_fail_72h").desc_nulls_last(), "transformer_id").limit(top)
        return best.select(
            "transformer_id",
            "feeder_id",
            "p_fail_72h",
            rounded(F.col("loading_max"), 3).alias("loading_max"),
            rounded(F.col("loading_mean"), 3).alias("loading_mean"),
            rounded(F.col("overload_minutes"), 1).alias("overload_minutes"),
            "sag_count",
            "age_years",
            "capacity_kva",
            "lat",
            "lon",
            "reason_codes",
            detail,
        )

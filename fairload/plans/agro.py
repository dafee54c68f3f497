"""The agro job: satellite passes to ranked villages, triggers and irrigation plans."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairload.functions.numeric import rounded
from fairload.functions.ordering import auc, ranked
from fairload.operators import cleaning, enrich, features, learning, plansearch, rollup, scoring
from fairload.plans.grid import Stage, as_is
from fairload.settings import AgroSettings


@dataclass(frozen=True)
class AgroModels:
    """How the models of the job are boosted."""

    loss: learning.Boosting = learning.LOSS
    yields: learning.Boosting = learning.YIELD


class AgroPlan:
    """``models`` None: closed-form stand-ins for loss and yield, which SQL can check."""

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        settings: AgroSettings = AgroSettings(),
        stage: Stage = as_is,
        models: AgroModels | None = None,
    ):
        self.tables, self.p, self.stage, self.models = tables, settings, stage, models

    # ---- passes
    @cached_property
    def clean(self) -> DataFrame:
        masked = cleaning.masked_passes(self.tables["ndvi"], self.tables["plots"], self.p)
        lines = self.stage(cleaning.with_smooth(cleaning.interpolated(masked)), "ndvi_lines")
        if self.stage is not as_is and lines.where("ndvi is null").isEmpty():
            return lines  # written and complete: the fleet median is not needed
        return cleaning.fill_silent_plots(lines)

    @cached_property
    def ledger(self) -> DataFrame:
        return cleaning.agro_ledger(self.tables["ndvi"], self.tables["plots"], self.p)

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enriched_passes(self.clean, self.tables["plots"], self.tables["villages"])

    # ---- roll-ups and features
    @cached_property
    def plot_season(self) -> DataFrame:
        return rollup.plot_season(self.clean, self.tables["plots"], self.tables["villages"])

    @cached_property
    def village_date(self) -> DataFrame:
        return rollup.village_date(self.clean, self.tables["plots"])

    @cached_property
    def block_weather(self) -> DataFrame:
        return rollup.block_weather_season(self.tables["block_weather"], self.p)

    @cached_property
    def village_features(self) -> DataFrame:
        return features.village_features(
            self.plot_season, self.village_date, self.block_weather, self.tables["villages"], self.p
        )

    @cached_property
    def water_stress(self) -> DataFrame:
        return features.water_stress(self.tables["plots"], self.tables["villages"], self.block_weather)

    # ---- scores
    @cached_property
    def loss_model(self) -> learning.Ensemble:
        return learning.train_loss(self.tables["yield_history"], self.models.loss)

    @cached_property
    def loss_auc(self) -> DataFrame:
        """One row: positives, negatives and auc of the held-out history."""
        history, key = self.tables["yield_history"], learning.history_key(self.tables["yield_history"])
        if self.models:
            return learning.holdout_auc(self.loss_model, history, key, "loss_event")
        held = scoring.crop_history_scores(history).where(scoring.held_out(key))
        return auc(held, "loss_event", "p", bounds=(0.0, 1.0))

    @cached_property
    def village_scores(self) -> DataFrame:
        if self.models:
            yields = learning.train_yield(self.tables["yield_history"], self.models.yields)
            return learning.score_villages(self.loss_model, yields, self.village_features, self.p)
        return scoring.score_villages(self.village_features, self.p)

    @cached_property
    def with_normal(self) -> DataFrame:
        villages = self.stage(scoring.with_mean_yield(self.village_scores, self.tables["yield_history"]), "villages")
        if self.stage is not as_is and villages.where("normal_yield is null").isEmpty():
            return villages
        return scoring.fill_normal_yield(villages)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score_priority(self.with_normal)

    @cached_property
    def ranked(self) -> DataFrame:
        return ranked(self.scored, F.col("vapi"), ["village_id"], bounds=(0.0, 1.0))

    @cached_property
    def summary(self) -> DataFrame:
        return scoring.agro_summary(self.scored)

    @cached_property
    def region_series(self) -> DataFrame:
        return rollup.region_series(self.village_date, self.tables["block_weather"])

    # ---- plans
    @cached_property
    def state(self) -> DataFrame:
        return self.stage(scoring.village_state(self.scored), "village_state")

    def default_budget(self) -> float:
        """35 % of the water needed, at least 5 ML."""
        row = self.summary.select("water_need_total_ml").first()
        return max(round((row[0] or 0.0) * 0.35, 1), 5.0)

    def water_units(self, scenarios: list[plansearch.Scenario], search: plansearch.Search) -> DataFrame:
        return self.stage(plansearch.water_units(self.state, scenarios, search), "water_units")

    # ---- result records
    @cached_property
    def ndvi_series(self) -> DataFrame:
        """All dates of a village as one array: one entry a date, so bounded by the season."""
        points = self.village_date.groupBy("village_id").agg(F.array_sort(F.collect_list(F.struct("date", "ndvi"))).alias("_s"))
        return points.select("village_id", F.transform("_s", lambda e: rounded(e["ndvi"], 3)).alias("recent_ndvi"))

    @cached_property
    def village_cards(self) -> DataFrame:
        parts = F.struct(
            *[F.col(f"c_{k}").alias(k) for k in ("loss_risk", "yield_shortfall", "ndvi_decline", "exposure")]
        ).alias("components")
        detail = F.transform(
            "factors",
            lambda e: F.struct(
                e["feature"].alias("feature"),
                rounded(e["contribution"], 3).alias("contribution"),
                rounded(e["value"], 3).alias("value"),
            ),
        ).alias("contributions")
        r = lambda name, places: rounded(F.col(name), places).alias(name)
        return self.ranked.join(self.ndvi_series, "village_id", "left").select(
            "rank",
            "village_id",
            "name",
            "district_id",
            "block_id",
            "canal_reach",
            "lat",
            "lon",
            "vapi",
            parts,
            "reason_codes",
            r("p_loss", 4),
            r("yield_pred", 2),
            r("normal_yield", 2),
            r("yield_shortfall_frac", 3),
            "insurance_trigger",
            "trigger_score",
            r("water_deficit", 3),
            r("area_ha", 1),
            "plots",
            r("rainfed_frac", 2),
            "past_support_index",
            "yield_saveable_t",
            "water_need_ml",
            r("ndvi_trend", 3),
            F.coalesce("recent_ndvi", F.array().cast("array<double>")).alias("recent_ndvi"),
            detail,
        )

    def triggers(self, top: int | None = None) -> DataFrame:
        """Triggered villages: all, or the first ``top`` in priority order."""
        hit = self.village_cards.where("insurance_trigger = 1")
        return hit if top is None else hit.orderBy("rank").limit(top)

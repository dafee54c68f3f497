"""Search over allocation plans: which feeders to shed, which villages to irrigate.

A plan is a set of units. Sampled plans are never stored: whether unit u belongs to plan p is a
coin fixed by (p, u, seed), so totals are computed from the coins and the members of the few
plans that survive are looked up again from the same coins.

Totals of all plans are a matrix product (plans x units) times (units x measures). Units are cut
into tiles and plans into runs; each (tile, run) is one dense block of work, emits one partial
row for each plan, and the partial rows are summed by plan. No unit-plan pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairload.functions.folding import ordered_accept
from fairload.functions.numeric import rounded, unit_uniform, whole_number
from fairload.functions.ordering import running_total
from fairload.session import staged

MODULUS = 2147483647
INTENSITIES = (0.8, 1.0, 1.3)
TILE_UNITS = 512
RUN_PLANS = 2048  # plans of one dense product
RANGE_PLANS = 1 << 18  # plans whose sums a task holds at once
HELD_RANGES = 16
WALK_ROWS = 10_000  # rows of all requests that one task may walk in order


@dataclass(frozen=True)
class Search:
    n_candidates: int = 20000
    top_k: int = 5
    seed: int = 0
    fairness_w: float = 0.30
    overshoot_w: float = 0.15
    top_up: int = 3  # villages that refining may add to an irrigation plan

    @property
    def per_intensity(self) -> int:
        return self.n_candidates // 3

    @property
    def evaluated(self) -> int:
        return 1 + 3 * self.per_intensity


Scenario = tuple[int, float]  # (scenario_id, amount asked for)


def for_scenarios(units: DataFrame, scenarios: list[Scenario], name: str) -> DataFrame:
    """One copy of the unit table for each request with a positive amount."""
    asked = [(i, float(a)) for i, a in scenarios if a > 0]
    if not asked:
        return units.select(F.lit(0).cast("bigint").alias("scenario_id"), F.lit(0.0).alias(name), "*").where("false")
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("scenario_id"), F.lit(a).alias(name)) for i, a in asked])
    return units.select(F.inline(rows), "*")


# ---------------------------------------------------------------- sampled plans


def plan_number(per: int) -> Column:
    """Which intensity a plan was drawn at: 0, 1 or 2."""
    return F.floor((F.col("plan_id") - 1) / F.lit(per)).cast("int")


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**31 - 1 for 0 <= x < 2**62, by shifts: a Mersenne prime needs no division."""
    x = (x & MODULUS) + (x >> 31)
    x = (x & MODULUS) + (x >> 31)
    return np.where(x >= MODULUS, x - MODULUS, x)


def _coins(plans: np.ndarray, units: np.ndarray, seed: int) -> np.ndarray:
    """Whole numbers below ``MODULUS`` fixed by (plan, unit, seed), as ``unit_uniform`` tosses them."""
    plan_a, plan_b = plans * 7919 % MODULUS, plans * 31 % MODULUS
    unit_a, unit_b = (units * 104729 + (seed * 15485863 + 11)) % MODULUS, units * 17 % MODULUS
    mixed = _reduced(plan_a[:, None] + unit_a[None, :])
    mixed *= mixed
    return _reduced(_reduced(mixed) + plan_b[:, None] + unit_b[None, :])


def _limits(thresholds: np.ndarray) -> np.ndarray:
    """For each threshold the number of coins below it: ``coin / MODULUS < threshold`` on whole numbers."""
    count = np.floor(thresholds * MODULUS).astype(np.int64) + 2
    for _ in range(4):  # the division is rounded, so step down to the exact place
        count = np.where((count - 1) / float(MODULUS) >= thresholds, count - 1, count)
    return count


def plan_totals(units: DataFrame, measures: list[str], search: Search) -> DataFrame:
    """scenario_id, plan_id, n_members and the sum of each measure, for all sampled plans.

    ``units`` has scenario_id, unit_id, unit_no, thresholds (one inclusion probability for each intensity)
    and the measures. A tile of units travels once for each range of plans, and a task adds up the
    tiles it sees before it gives out a row: what is shuffled afterwards is plans x tasks, not plans x tiles.
    """
    per, seed = search.per_intensity, search.seed
    if per == 0:
        per_schema = "scenario_id bigint, plan_id bigint, n_members bigint"
        empty = ", ".join(f"{m} double" for m in measures)
        return units.sparkSession.createDataFrame([], f"{per_schema}, {empty}")
    tiles = F.greatest(F.lit(1), F.ceil(units.agg(F.count(F.lit(1)).alias("n")).scalar() / TILE_UNITS))
    as_double = [F.collect_list(F.col(m).cast("double")).alias(m) for m in measures]
    parallel = 2 * units.sparkSession.sparkContext.defaultParallelism
    tiled = (
        units.fillna(0.0, subset=measures)  # lists leave missing values out and would come apart
        .withColumn("n_tiles", tiles)
        .withColumn("tile", F.pmod(F.xxhash64("unit_id"), F.col("n_tiles")))
        .groupBy("scenario_id", "tile", "n_tiles")
        # about TILE_UNITS entries each, as the number of tiles grows with the unit table
        .agg(F.first("thresholds").alias("thresholds"), F.collect_list("unit_no").alias("unit_no"), *as_double)
    )
    # as many ranges as keep all tasks busy when tiles are few, and none larger than RANGE_PLANS
    least = -(-3 * per // RANGE_PLANS)
    ranges = F.greatest(F.lit(least).cast("bigint"), F.ceil(F.lit(parallel) / F.col("n_tiles")))
    ranges = F.least(ranges, F.lit(-(-3 * per // RUN_PLANS)).cast("bigint"))
    blocks = tiled.withColumn("ranges", ranges).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ranges") - 1)).alias("range")
    )
    # a stated number of partitions: blocks are few bytes but much work, and sizing by bytes would
    # put them all into one task
    blocks = blocks.repartition(parallel, "scenario_id", "tile", "range")
    schema = "scenario_id bigint, plan_id bigint, n_members bigint, " + ", ".join(f"{m} double" for m in measures)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for (scenario, first, _), sums in held.items():
                out = {"scenario_id": np.int64(scenario), "plan_id": first + np.arange(len(sums), dtype=np.int64)}
                out["n_members"] = sums[:, 0].astype(np.int64)
                out.update({m: sums[:, i + 1] for i, m in enumerate(measures)})
                yield pd.DataFrame(out)
            held.clear()

        for batch in batches:
            for row in batch.to_dict("records"):
                share = -(-3 * per // row["ranges"])
                first = 1 + row["range"] * share
                end = min(first + share, 3 * per + 1)
                if first >= end:
                    continue
                numbers = np.asarray(row["unit_no"], dtype=np.int64)
                values = np.column_stack([np.ones(len(numbers)), *(row[m] for m in measures)])
                limits = _limits(np.asarray(row["thresholds"], dtype=float))
                key = (row["scenario_id"], first, end)
                if key not in held and len(held) >= HELD_RANGES:
                    yield from flushed()
                sums = held.setdefault(key, np.zeros((end - first, values.shape[1])))
                for at in range(first, end, RUN_PLANS):
                    plans = np.arange(at, min(at + RUN_PLANS, end), dtype=np.int64)
                    chosen = _coins(plans, numbers, seed) < limits[(plans - 1) // per][:, None]
                    sums[at - first : at - first + len(plans)] += chosen.astype(float) @ values
        yield from flushed()

    partial = blocks.mapInPandas(dense, schema)
    return partial.groupBy("scenario_id", "plan_id").agg(
        F.sum("n_members").alias("n_members"), *[F.sum(m).alias(m) for m in measures]
    )


def best_plans(scored: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` lowest scores of each scenario, with their place. Each task first keeps only
    its own best, so no scenario's plans are gathered whole."""
    order = Window.partitionBy("scenario_id").orderBy("score", "plan_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def plan_members(units: DataFrame, plans: DataFrame, greedy: DataFrame, search: Search) -> DataFrame:
    """Rows (plan, unit) of the given plans. ``plans`` is a best-of list: at most 8 * top_k rows
    for each scenario, which is why it may be broadcast."""
    sampled = plans.where("plan_id > 0").select("scenario_id", "plan_id", plan_number(search.per_intensity).alias("_level"))
    drawn = (
        units.join(F.broadcast(sampled), "scenario_id")
        .where(
            unit_uniform(F.col("plan_id"), F.col("unit_no"), search.seed)
            < F.element_at("thresholds", F.col("_level") + 1)
        )
        .select("plan_id", *units.columns)
    )
    seeded = greedy.join(F.broadcast(plans.where("plan_id = 0").select("scenario_id", "plan_id")), "scenario_id")
    return drawn.unionByName(seeded.select("plan_id", *units.columns))


def distinct_plans(members: DataFrame) -> DataFrame:
    """Plans with different member sets: of equal sets the one that came first. Sets are compared
    by size and three independent order-free digests, not by gathering members."""
    a, b = F.xxhash64("unit_id"), F.xxhash64("unit_id", F.lit("b"))
    wide = lambda c: c.cast("decimal(38,0)")
    digests = members.groupBy("scenario_id", "plan_id", "place").agg(
        F.count(F.lit(1)).alias("n"), F.sum(wide(a)).alias("a"), F.sum(wide(b)).alias("b"), F.bit_xor(a).alias("x")
    )
    firsts = digests.groupBy("scenario_id", "n", "a", "b", "x").agg(F.min_by("plan_id", "place").alias("plan_id"))
    return firsts.select("scenario_id", "plan_id")


# ---------------------------------------------------------------- load shedding


def shed_units(state: DataFrame, scenarios: list[Scenario], search: Search) -> DataFrame:
    """Feeders that may be shed, with each request's target and sampling thresholds.

    ``state`` is the feeder state with ``rank`` (position in the criticality order).
    """
    eligible = state.where("not is_protected and sheddable_mw > 0.01")
    fleet = eligible.agg(
        F.struct(F.sum("sheddable_mw").alias("total"), F.max("shed_hours_30d").alias("hours")).alias("s")
    ).scalar()
    total, hours = F.col("_fleet.total"), F.col("_fleet.hours")
    target = rounded(F.least(F.col("asked_mw"), 0.95 * total), 6)
    base = F.least(F.lit(0.9), F.col("target_mw") / F.greatest(total, F.lit(1e-6)))
    return (
        for_scenarios(eligible, scenarios, "asked_mw")
        .withColumn("_fleet", fleet)
        .withColumn("target_mw", target)
        .withColumn("thresholds", F.array(*[F.least(F.lit(0.95), base * m) for m in INTENSITIES]))
        .select(
            "scenario_id",
            "target_mw",
            "thresholds",
            F.col("feeder_id").alias("unit_id"),
            whole_number(eligible, "feeder_id").alias("unit_no"),
            "name",
            "rank",
            F.col("sheddable_mw").alias("mw"),
            F.col("pain_score").alias("pain"),
            "shed_hours_30d",
            (F.col("shed_hours_30d") / (hours + 1e-6)).alias("fair"),
        )
    )


def shed_greedy(units: DataFrame, search: Search) -> DataFrame:
    """Cheapest pain for each MW first, until the target is met."""
    cost = rounded((F.col("pain") + search.fairness_w * F.col("fair")) / F.greatest("mw", F.lit(1e-3)), 9)
    placed = running_total(units.withColumn("cost", cost), F.col("mw"), F.col("cost"), ["unit_id"], ["scenario_id"])
    return placed.where(rounded(F.col("before"), 6) < F.col("target_mw")).drop("before", "cost")


def shed_score(totals: DataFrame, search: Search) -> DataFrame:
    """Totals to six decimals, then the score: pain, unfairness, and missing or surplus MW."""
    t = totals.withColumns({m: rounded(F.col(m), 6) for m in ("mw", "pain", "fair")})
    short = F.greatest(F.col("target_mw") - F.col("mw"), F.lit(0.0))
    over = F.greatest(F.col("mw") - F.col("target_mw"), F.lit(0.0))
    score = F.col("pain") + search.fairness_w * F.col("fair") + 10.0 * short + search.overshoot_w * over
    return t.withColumn("score", rounded(score, 6))


def _with_targets(totals: DataFrame, units: DataFrame, column: str) -> DataFrame:
    targets = units.groupBy("scenario_id").agg(F.first(column).alias(column))
    return totals.join(targets, "scenario_id")


def shed_plans(units: DataFrame, search: Search) -> DataFrame:
    """Score of every candidate: plan 0 is the greedy one."""
    measures = ["mw", "pain", "fair"]
    greedy = shed_greedy(units, search).groupBy("scenario_id").agg(
        F.lit(0).cast("bigint").alias("plan_id"),
        F.count(F.lit(1)).alias("n_members"),
        *[F.sum(m).alias(m) for m in measures],
    )
    every = plan_totals(units, measures, search).unionByName(greedy)
    return shed_score(_with_targets(every, units, "target_mw"), search)


def shed_refined_members(units: DataFrame, best: DataFrame, search: Search) -> DataFrame:
    """Drop members that the plan is better without.

    The rule is: drop the first member (in criticality order) whose removal lowers the score by
    more than 1e-6, then start over. The penalty on relief is convex, so a member that was worth
    keeping stays so as relief shrinks; starting over can therefore change nothing that was already
    passed, and one walk in order gives the same plan.
    """
    fw, ow = search.fairness_w, search.overshoot_w
    members = plan_members(units, best, shed_greedy(units, search), search)
    joined = members.join(F.broadcast(best.select("scenario_id", "plan_id", "place", F.col("mw").alias("relief"))), ["scenario_id", "plan_id"])

    def start(mw, pain, fair, target, relief):
        return relief

    def step(relief, mw, pain, fair, target, _):
        penalty = lambda r: 10.0 * max(target - r, 0.0) + ow * max(r - target, 0.0)
        change = penalty(relief - mw) - penalty(relief) - pain - fw * fair
        return (False, relief - mw) if change < -1e-6 else (True, relief)

    walked = ordered_accept(
        joined, ["scenario_id", "plan_id"], ["rank", "unit_id"], ["mw", "pain", "fair", "target_mw", "relief"], start, step
    )
    return walked.where("accepted").drop("accepted", "relief")


def shed_report(members: DataFrame, search: Search) -> DataFrame:
    """Totals of the distinct plans, best score first, ``top_k`` for each scenario."""
    keep = distinct_plans(members)
    totals = members.join(keep, ["scenario_id", "plan_id"]).groupBy("scenario_id", "plan_id", "target_mw").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("mw").alias("mw"), F.sum("pain").alias("pain"), F.sum("fair").alias("fair")
    )
    best = best_plans(shed_score(totals, search), search.top_k)
    return best.select(
        "scenario_id",
        "place",
        "plan_id",
        "target_mw",
        F.col("n_members").alias("n_feeders"),
        F.col("mw").alias("relief_mw"),
        F.col("pain").alias("pain_total"),
        F.col("fair").alias("fairness_penalty"),
        (F.col("mw") >= F.col("target_mw") - 1e-6).alias("feasible"),
        "score",
    )


def shed_counters(state: DataFrame, scenarios: list[Scenario], search: Search) -> DataFrame:
    """Fleet counters beside each request. Protected and too-small feeders are counted apart."""
    small = ~F.col("is_protected") & (F.col("sheddable_mw") <= 0.01)
    fleet = state.agg(
        F.count_if("is_protected").alias("protected_excluded"),
        F.count_if(small).alias("too_small_excluded"),
        F.count_if(~F.col("is_protected") & (F.col("sheddable_mw") > 0.01)).alias("eligible_feeders"),
    )
    return for_scenarios(fleet, scenarios, "asked_mw").select(
        "scenario_id",
        "asked_mw",
        "eligible_feeders",
        "protected_excluded",
        "too_small_excluded",
        F.lit(search.evaluated).cast("bigint").alias("plans_evaluated"),
        rounded(F.lit(search.evaluated * 5.0 / 60.0), 1).alias("equivalent_manual_hours"),
    )


# ---------------------------------------------------------------- irrigation


def water_units(state: DataFrame, scenarios: list[Scenario], search: Search) -> DataFrame:
    """Villages that water would help, with each request's budget and sampling thresholds."""
    eligible = state.where("water_need_ml > 1e-3 and yield_saveable_t > 1e-3")
    total = eligible.agg(F.sum("water_need_ml").alias("t")).scalar()
    budget = rounded(F.least(F.col("asked_ml"), F.col("_total")), 6)
    base = F.least(F.lit(0.95), F.col("budget_ml") / F.greatest("_total", F.lit(1e-6)))
    levels = [base * INTENSITIES[0], base * INTENSITIES[1], F.least(F.lit(0.97), base * INTENSITIES[2])]
    fair = 1.0 - F.col("past_support_index")
    return (
        for_scenarios(eligible, scenarios, "asked_ml")
        .withColumn("_total", total)
        .withColumn("budget_ml", budget)
        .withColumn("thresholds", F.array(*levels))
        .select(
            "scenario_id",
            "budget_ml",
            "thresholds",
            F.col("village_id").alias("unit_id"),
            whole_number(eligible, "village_id").alias("unit_no"),
            "name",
            "canal_reach",
            F.col("yield_saveable_t").alias("benefit"),
            F.col("water_need_ml").alias("water"),
            fair.alias("fair"),
            (F.col("canal_reach") == "tail").cast("double").alias("tail"),
        )
    )


def water_greedy(units: DataFrame, search: Search) -> DataFrame:
    """Best value for each megalitre first; a village that no longer fits is passed over.

    Up to the first village that does not fit this is a running total; the villages after it that are small
    enough for what is left get another round. Once at most ``WALK_ROWS`` are left they are walked in order.
    """
    density = rounded((F.col("benefit") + search.fairness_w * F.col("fair")) / F.greatest("water", F.lit(1e-3)), 9)
    dense = units.withColumn("density", density)
    placed = running_total(dense, F.col("water"), F.col("density"), ["unit_id"], ["scenario_id"], descending=True)
    fits = rounded(F.col("before") + F.col("water"), 6) <= F.col("budget_ml")
    bulk = placed.where(fits).drop("before")
    bulk, rest = _still_fitting(bulk, placed.where(~fits).drop("before"))
    while not rest.limit(WALK_ROWS + 1).offset(WALK_ROWS).isEmpty():
        # another round of the running total: what fits in a row is taken, what no longer fits is left out
        asked = staged(rest, "water-rest")
        placed = running_total(asked, F.col("water"), F.col("density"), ["unit_id"], ["scenario_id"], descending=True)
        fits = rounded(F.col("used") + F.col("before") + F.col("water"), 6) <= F.col("budget_ml")
        bulk = staged(bulk.unionByName(placed.where(fits).select(bulk.columns)), "water-bulk")
        bulk, rest = _still_fitting(bulk, placed.where(~fits).select(bulk.columns))

    def start(water, budget, used):
        return used

    def step(used, water, budget, _):
        fits_now = used + water <= budget + 1e-9
        return fits_now, (used + water if fits_now else used)

    walked = ordered_accept(
        rest, ["scenario_id"], [F.col("density").desc(), F.col("unit_id")], ["water", "budget_ml", "used"], start, step
    )
    extra = walked.where("accepted").drop("accepted", "used")
    return bulk.unionByName(extra).drop("density")


def _still_fitting(bulk: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows taken, and those of the others that what they leave can still afford, with ``used``."""
    used = bulk.groupBy("scenario_id").agg(F.sum("water").alias("used"))
    open_rows = rest.join(used, "scenario_id", "left").withColumn("used", F.coalesce("used", F.lit(0.0)))
    return bulk, open_rows.where(rounded(F.col("used") + F.col("water"), 6) <= F.col("budget_ml"))


def water_score(totals: DataFrame, search: Search) -> DataFrame:
    t = totals.withColumns({m: rounded(F.col(m), 6) for m in ("water", "benefit", "fair")})
    over = F.greatest(F.col("water") - F.col("budget_ml"), F.lit(0.0))
    score = -(F.col("benefit") + search.fairness_w * F.col("fair")) + 100.0 * over
    return t.withColumn("score", rounded(score, 6))


def water_plans(units: DataFrame, search: Search) -> DataFrame:
    measures = ["benefit", "water", "fair"]
    greedy = water_greedy(units, search).groupBy("scenario_id").agg(
        F.lit(0).cast("bigint").alias("plan_id"),
        F.count(F.lit(1)).alias("n_members"),
        *[F.sum(m).alias(m) for m in measures],
    )
    every = plan_totals(units, measures, search).unionByName(greedy)
    return water_score(_with_targets(every, units, "budget_ml"), search)


def water_refined_members(units: DataFrame, best: DataFrame, search: Search) -> DataFrame:
    """Add to each plan the most beneficial villages it can still afford, at most ``search.top_up``.

    Water left only shrinks, so a village that did not fit once never fits later: one walk in order
    of benefit adds the same villages as starting over after each.
    """
    greedy, most = water_greedy(units, search), search.top_up
    members = plan_members(units, best, greedy, search)
    label = best.select("scenario_id", "plan_id", "place", F.col("water").alias("used"))
    inside = members.join(F.broadcast(label), ["scenario_id", "plan_id"])
    outside = (
        units.join(F.broadcast(label), "scenario_id")
        .where(rounded(F.col("used") + F.col("water"), 6) <= F.col("budget_ml"))
        .join(members.select("scenario_id", "plan_id", "unit_id"), ["scenario_id", "plan_id", "unit_id"], "left_anti")
    )

    def start(water, budget, used):
        return used, 0

    def step(state, water, budget, _):
        used, added = state
        take = added < most and used + water <= budget + 1e-9
        return take, ((used + water, added + 1) if take else state)

    walked = ordered_accept(
        outside,
        ["scenario_id", "plan_id"],
        [F.col("benefit").desc(), F.col("unit_id")],
        ["water", "budget_ml", "used"],
        start,
        step,
    )
    extra = walked.where("accepted").drop("accepted", "used")
    return inside.drop("used").unionByName(extra.select(*[c for c in inside.columns if c != "used"]))


def water_report(members: DataFrame, search: Search) -> DataFrame:
    """Plans within the budget first, then most yield saved, ``top_k`` for each scenario."""
    keep = distinct_plans(members)
    totals = members.join(keep, ["scenario_id", "plan_id"]).groupBy("scenario_id", "plan_id", "budget_ml").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.sum("benefit").alias("benefit"),
        F.sum("water").alias("water"),
        F.sum("fair").alias("fair"),
        F.avg("tail").alias("tail_share"),
    )
    scored = water_score(totals, search).withColumn("within_budget", F.col("water") <= F.col("budget_ml") + 1e-6)
    order = Window.partitionBy("scenario_id").orderBy(F.col("within_budget").desc(), F.col("benefit").desc(), "plan_id")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= search.top_k)
    return best.select(
        "scenario_id",
        "place",
        "plan_id",
        "budget_ml",
        F.col("n_members").alias("n_villages"),
        F.col("benefit").alias("yield_saved_t"),
        F.col("water").alias("water_used_ml"),
        rounded(F.col("tail_share"), 2).alias("tail_share"),
        F.col("fair").alias("fairness_bonus"),
        "within_budget",
        "score",
    )


def water_counters(state: DataFrame, scenarios: list[Scenario], search: Search) -> DataFrame:
    fleet = state.agg(
        F.count_if(F.expr("water_need_ml > 1e-3 and yield_saveable_t > 1e-3")).alias("eligible_villages"),
        F.count(F.lit(1)).alias("villages"),
    )
    return for_scenarios(fleet, scenarios, "asked_ml").select(
        "scenario_id",
        "asked_ml",
        "eligible_villages",
        (F.col("villages") - F.col("eligible_villages")).alias("excluded"),
        F.lit(search.evaluated).cast("bigint").alias("plans_evaluated"),
        rounded(F.lit(search.evaluated * 5.0 / 60.0), 1).alias("equivalent_manual_hours"),
    )

"""Batch and stream jobs: ``python -m fairload <job> --data <folder> --out <folder>``.

``grid`` and ``agro`` fit their models on the history first; ``--models stand-in`` uses closed-form
coefficients instead. ``backfill`` writes the history tables, ``stream`` keeps closed intervals of telemetry and
its ledgers up to date with what has landed, ``load`` copies a landing folder into a warehouse, and ``publish``
replaces the score tables of a warehouse.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from fairload.operators import learning, plansearch
from fairload.plans.agro import AgroModels, AgroPlan
from fairload.plans.grid import GridModels, GridPlan
from fairload.session import get_or_create, run_folder, staged
from fairload.settings import GridSettings
from fairload.sources import published
from fairload.sources.schemas import schema_of
from fairload.sources.tables import agro_bundle, grid_bundle, load_warehouse, read_bundle
from fairload.streaming import telemetry


def grid_plan(spark, args) -> GridPlan:
    fit = lambda p: p.shortened(args.rounds)
    models = GridModels(fit(learning.RISK), fit(learning.LOAD)) if args.models == "fitted" else None
    return GridPlan(grid_bundle(spark, args.data, args.text_ids), GridSettings(), staged, models)


def agro_plan(spark, args) -> AgroPlan:
    fit = lambda p: p.shortened(args.rounds)
    models = AgroModels(fit(learning.LOSS), fit(learning.YIELD)) if args.models == "fitted" else None
    return AgroPlan(agro_bundle(spark, args.data, args.text_ids), stage=staged, models=models)


def run_grid(spark, args) -> None:
    plan = grid_plan(spark, args)
    published.write_grid_results(plan, args.out)
    plan.ledger.write.mode("overwrite").json(f"{args.out}/quality.json")
    search = plansearch.Search(n_candidates=args.candidates, seed=args.seed)
    units = plan.shed_units([(1, args.amount or plan.default_target())], search)
    best = staged(plansearch.best_plans(plansearch.shed_plans(units, search), 8 * search.top_k), "best")
    members = staged(plansearch.shed_refined_members(units, best, search), "members")
    published.write_plans(plansearch.shed_report(members, search), members, args.out)


def run_agro(spark, args) -> None:
    plan = agro_plan(spark, args)
    published.write_agro_results(plan, args.out)
    plan.ledger.write.mode("overwrite").json(f"{args.out}/quality.json")
    search = plansearch.Search(n_candidates=args.candidates, seed=args.seed, fairness_w=0.35, top_up=args.top_up)
    units = plan.water_units([(1, args.amount or plan.default_budget())], search)
    best = staged(plansearch.best_plans(plansearch.water_plans(units, search), 3 * search.top_k), "best")
    members = staged(plansearch.water_refined_members(units, best, search), "members")
    published.write_plans(plansearch.water_report(members, search), members, args.out)


def run_backfill(spark, args) -> None:
    tables = grid_bundle(spark, args.data, args.text_ids)
    published.write_backfill(tables["readings"], tables["meters"], tables["transformers"], args.out, GridSettings())


def run_stream(spark, args) -> None:
    """Process what has landed since the last run; state and tables stay in the output folder."""
    p, dims = GridSettings(), read_bundle(spark, args.data, ("meters", "transformers"), args.text_ids)
    landed = telemetry.landed_files(
        spark, args.data, schema_of("readings", args.text_ids), "readings_*.parquet", args.files_per_batch
    )
    load = telemetry.transformer_load(landed, dims["meters"], dims["transformers"], p)
    days = load.withColumn("day", F.to_date("ts"))
    telemetry.run_to_table(days, "stream", f"{args.out}/tx_interval", partition_by=("day",))
    ledgers = telemetry.batch_ledgers(landed, dims["meters"], p, f"{args.out}/ledger")
    ledgers.coalesce(1).write.mode("overwrite").json(f"{args.out}/quality.json")


def run_load(spark, args) -> None:
    bundle = agro_bundle if args.domain == "agro" else grid_bundle
    load_warehouse(spark, bundle(spark, args.data, args.text_ids), args.database)


def run_publish(spark, args) -> None:
    plan = grid_plan(spark, args)
    published.publish_scores(plan.feeder_cards, plan.watchlist(), args.database)


JOBS = {
    "grid": run_grid,
    "agro": run_agro,
    "backfill": run_backfill,
    "stream": run_stream,
    "load": run_load,
    "publish": run_publish,
}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fairload", description=__doc__)
    parser.add_argument("job", choices=tuple(JOBS))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", help="folder of the results (grid, agro, backfill, stream)")
    parser.add_argument("--amount", type=float, help="MW to shed, or ML of water to share out")
    parser.add_argument("--candidates", type=int, default=20000)
    parser.add_argument("--top-up", type=int, default=3, help="villages that refining may add to a plan")
    parser.add_argument("--seed", type=int, default=11)
    parser.add_argument("--models", choices=("fitted", "stand-in"), default="fitted")
    parser.add_argument("--rounds", type=int, help="at most so many boosting rounds")
    parser.add_argument("--files-per-batch", type=int, help="files of a micro-batch")
    parser.add_argument("--domain", choices=("grid", "agro"), default="grid", help="tables that load copies")
    parser.add_argument("--database", default="fairload", help="warehouse database (load, publish)")
    parser.add_argument("--text-ids", action="store_true", help="ids are text (needed for CSV input)")
    return parser.parse_args(argv)


def main() -> None:
    args = parse()
    spark = get_or_create("fairload-" + args.job)
    with run_folder(spark):
        JOBS[args.job](spark, args)


if __name__ == "__main__":
    main()

import datetime as dt
import itertools
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from fairload.session import staged  # noqa: E402
from fairload.plans.agro import AgroPlan  # noqa: E402
from fairload.plans.grid import GridPlan  # noqa: E402
from fairload.settings import GridSettings  # noqa: E402
from fairload.sources import published, tables  # noqa: E402
from fairload.sources.mapping import logical_tables  # noqa: E402
from fairload.streaming import telemetry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize(
    "name",
    ["grid_quality_ledger", "tx_interval_load", "feeder_daily", "fci_ranking", "ndvi_smooth", "vapi_ranking", "shed_plan_report", "irrigation_plan_report", "stream_feeder_load"],
)
def test_query_equals_its_sql_twin(spark, duck, name):
    assert compare.differences(queries()[name](spark, SF), duck, oracle_sql()[name]) is None


def test_every_twin_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_ranks_feeders(spark):
    rows = entry(spark).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


def test_tables_fall_back_to_csv_and_say_when_absent(spark, tmp_path):
    t = logical_tables(spark, SF)
    folder = str(tmp_path)
    tables.save_table(t["shed_history"], folder, "shed_history", fmt="csv")
    back = tables.read_table(spark, folder, "shed_history")
    assert back.dtypes == t["shed_history"].dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t["shed_history"].collect()))
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, folder, "feeders")


def test_part_files_read_as_one_table_and_nan_becomes_missing(spark, tmp_path):
    t = logical_tables(spark, SF)["readings"]
    t.where("reading_id < 400").write.parquet(f"{tmp_path}/readings_0000.parquet")
    nan = t.where("reading_id >= 400").withColumn("kwh", F.when(F.col("reading_id") == 500, F.lit(float("nan"))).otherwise(F.col("kwh")))
    nan.write.parquet(f"{tmp_path}/readings_0001.parquet")
    back = tables.read_table(spark, str(tmp_path), "readings", "readings_*")
    assert back.count() == t.count()
    assert back.where("reading_id = 500").first().kwh is None
    with pytest.raises(ValueError, match="lacks kwh"):
        t.drop("kwh").write.parquet(f"{tmp_path}/bad.parquet")
        tables.read_table(spark, str(tmp_path), "readings", "bad")


def test_whole_grid_and_agro_results_round_trip(spark, tmp_path):
    logical = logical_tables(spark, SF)
    grid = GridPlan(logical, GridSettings(grain_s=21600), staged)
    published.write_grid_results(grid, str(tmp_path))
    cards = published.read_results(spark, str(tmp_path), "feeders").collect()
    assert cards and all(len(c.forecast_mw) == 4 and c.components is not None for c in cards)
    assert published.read_results(spark, str(tmp_path), "transformers").count() == grid.tx_scores.count()
    agro = AgroPlan(logical, stage=staged)
    published.write_agro_results(agro, str(tmp_path / "agro"))
    villages = published.read_results(spark, str(tmp_path / "agro"), "villages")
    hits = published.read_results(spark, str(tmp_path / "agro"), "triggers")
    assert villages.count() == agro.village_features.count()
    assert hits.count() == villages.where("insurance_trigger = 1").count()
    published.publish_scores(grid.feeder_cards, grid.watchlist(), "scores_test")
    flat = spark.table("scores_test.feeder_scores")
    assert dict(flat.dtypes)["reason_codes"] == "string" and "components" not in flat.columns
    assert tables.load_warehouse(spark, {"feeders": logical["feeders"]}, "raw_test") == ["raw_test.feeders"]
    assert grid.default_target() >= 5.0 and agro.default_budget() >= 5.0


def test_lazy_and_staged_plans_agree(spark):
    lazy, stored = AgroPlan(logical_tables(spark, SF)), AgroPlan(logical_tables(spark, SF), stage=staged)
    pick = lambda plan: sorted((r.village_id, round(r.vapi, 4)) for r in plan.scored.select("village_id", "vapi").collect())
    assert pick(lazy) == pick(stored)


def test_intervals_that_close_without_input_are_not_broadcast(spark, tmp_path):
    p, t0 = GridSettings(), dt.datetime(2024, 1, 1)
    rows = [(m * 10 + k, m, t0 + dt.timedelta(hours=k), 1.0, 230.0) for m in range(200) for k in range(6)]
    readings = spark.createDataFrame(rows, "reading_id bigint, meter_id bigint, ts timestamp, kwh double, voltage double")
    readings.coalesce(1).write.parquet(str(tmp_path / "land"))
    meters = spark.range(200).selectExpr("id as meter_id", "id % 3 as transformer_id")
    tx = spark.createDataFrame([(1, 7, 100), (2, 8, 100), (2, 8, 100)], "transformer_id bigint, feeder_id bigint, capacity_kva int")
    for load in (telemetry.transformer_load, telemetry.feeder_load):
        stream = telemetry.landed_files(spark, str(tmp_path / "land"), readings.schema)
        name = f"closed_{load.__name__}"
        run = load(stream, meters, tx, p).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination()
        plan = run._jsq.explainInternal(False).split("\n")  # of the last batch, which has no input
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        assert sum("StateStoreSave" in line for line in plan) == 2
        for at, line in enumerate(plan):
            if "BroadcastExchange" in line:  # of static tables only
                below = itertools.takewhile(lambda x: depth(x) > depth(line), plan[at + 1 :])
                assert not any("StateStore" in x for x in below)
        got = spark.table(name).groupBy("feeder_id").agg(F.sum("kw"), F.countDistinct("ts")).collect()
        assert {r.feeder_id: tuple(r)[1:] for r in got} == {7: (67 * 4.0 * 5, 5), 8: (66 * 2 * 4.0 * 5, 5)}


def test_late_rows_are_dropped_and_batches_add_up(spark, tmp_path):
    p, t0 = GridSettings(), dt.datetime(2024, 1, 1)
    schema = "reading_id bigint, meter_id bigint, ts timestamp, kwh double, voltage double"
    batches = [
        [(1, 1, t0, 1.0, 200.0), (2, 1, t0, 9.0, 230.0), (3, 2, t0, 2.0, 230.0)],
        [(4, 1, t0 + dt.timedelta(hours=3), 1.0, 230.0)],
        [(5, 1, t0 + dt.timedelta(hours=4), 2.0, 230.0)],  # a row is late against the watermark of the batch before
        [(6, 2, t0 + dt.timedelta(minutes=15), 5.0, 230.0), (7, 1, t0 + dt.timedelta(hours=6), 1.0, 230.0)],
    ]
    land = str(tmp_path / "land")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        for name in os.listdir(land):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.utime(f"{land}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
                os.rename(f"{land}/{name}", f"{land}/b{i}.parquet")
    meters = spark.createDataFrame([(1, 1), (2, 1)], "meter_id bigint, transformer_id bigint")
    tx = spark.createDataFrame([(1, 7, 100)], "transformer_id bigint, feeder_id bigint, capacity_kva int")
    from pyspark.sql.types import StructType

    stream = telemetry.landed_files(spark, land, StructType.fromDDL(schema), files_per_batch=1)
    got = telemetry.run_to_table(telemetry.feeder_load(stream, meters, tx, p), "late").orderBy("ts").collect()
    # the copy of meter 1 and the reading that came hours late do not count
    assert [((r.ts - t0).total_seconds() / 3600, r.kw, r.sags) for r in got] == [(0.0, 12.0, 1), (3.0, 4.0, 0), (4.0, 8.0, 0)]
    again = telemetry.landed_files(spark, land, StructType.fromDDL(schema), files_per_batch=1)
    ledgers = telemetry.batch_ledgers(again, meters, p).orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows_in, r.duplicates_removed) for r in ledgers] == [(0, 3, 1), (1, 1, 0), (2, 1, 0), (3, 2, 0)]


def test_landing_layout_with_text_ids_runs_to_plans(spark, tmp_path):
    """Text ids, no arrival numbers, extra columns, CSV facts in parts: read, scored and planned."""
    from fairload.operators import plansearch as ps

    logical, land = logical_tables(spark, SF), str(tmp_path)
    text = lambda df: df.select(*[F.concat(F.lit(f"{c[:-3].upper()}-"), c).alias(c) if c.endswith("_id") else F.col(c) for c in df.columns])
    for name in ("meters", "transformers", "feeders", "substations", "shed_history", "weather"):
        tables.save_table(text(logical[name]), land, name)
    tables.save_table(text(logical["tx_history"].drop("row_key")), land, "tx_history")
    facts = text(logical["readings"].drop("reading_id")).withColumn("pf", F.lit(0.9))
    tables.save_table(facts.where("month(ts) = 1 and day(ts) < 15"), land, "readings_0000", fmt="csv")
    tables.save_table(facts.where("not (month(ts) = 1 and day(ts) < 15)"), land, "readings_0001", fmt="csv")
    bundle = tables.grid_bundle(spark, land, text_ids=True)
    assert dict(bundle["readings"].dtypes)["meter_id"] == "string"
    plan = GridPlan(bundle, GridSettings(grain_s=21600), staged)
    numbers = GridPlan(logical, GridSettings(grain_s=21600), staged)
    pick = lambda p: sorted((r["name"], r["fci"], r["pain_score"]) for r in p.scored.select("name", "fci", "pain_score").collect())
    assert pick(plan) == pick(numbers)
    search = ps.Search(n_candidates=300)
    units = plan.shed_units([(1, 0.1)], search)
    best = ps.best_plans(ps.shed_plans(units, search), 8)
    assert ps.shed_report(ps.shed_refined_members(units, best, search), search).count() >= 1


def test_first_copy_is_by_file_order_whatever_the_sizes(spark, tmp_path):
    """A copy in a later, larger part file never beats the one in the earlier file; nor does a later row."""
    schema = "meter_id bigint, ts timestamp, kwh double, voltage double"
    t0 = dt.datetime(2024, 1, 1)
    parts = [[(1, t0, 1.0, 230.0), (1, t0, 2.0, 230.0)], [(1, t0, 3.0, 230.0)] + [(k, t0, 4.0, 230.0) for k in range(2, 20_000)]]
    for fmt in ("parquet", "csv"):
        land = str(tmp_path / fmt)
        for i, rows in enumerate(parts):
            tables.save_table(spark.createDataFrame(rows, schema).coalesce(1), land, f"readings_{i:04d}", fmt=fmt)
        back = tables.read_table(spark, land, "readings", "readings_*")
        assert back.select("reading_id").distinct().count() == 20_001
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        try:
            from fairload.operators import cleaning

            slots = cleaning.reading_slots(tables.read_table(spark, land, "readings", "readings_*"), GridSettings())
            assert slots.where("meter_id = 1").first().kwh == 1.0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_ledgers_add_up_to_the_batch_ledger(spark, tmp_path):
    """Copies that arrive in later files count as duplicates, whatever the batches."""
    from fairload.operators import cleaning

    readings, meters = (logical_tables(spark, SF)[n] for n in ("readings", "meters"))
    land = str(tmp_path / "land")
    again = readings.where("reading_id % 5 = 0").withColumn("reading_id", F.col("reading_id") + 1_000_000)
    for k in range(3):
        part = readings.where(F.col("reading_id") % 3 == k)
        (part.unionByName(again) if k == 2 else part).coalesce(1).write.mode("append").parquet(land)
    stream = telemetry.landed_files(spark, land, readings.schema, files_per_batch=1)
    ledgers = telemetry.batch_ledgers(stream, meters, GridSettings())
    counted = [c for c in ledgers.columns if c != "batch_id"]
    assert ledgers.count() == 3
    total = ledgers.agg(*[F.sum(c).alias(c) for c in counted]).first()
    whole = cleaning.grid_ledger(readings.unionByName(again), meters, GridSettings()).first()
    exact = ("rows_in", "duplicates_removed", "orphans_removed", "rows_clean")
    assert [total[c] for c in exact] == [whole[c] for c in exact]


def test_every_branch_occurs_in_the_test_tables(spark):
    plan = AgroPlan(logical_tables(spark, "/root/testdata/sf0.01"), stage=staged)
    seen = plan.scored.agg(
        F.count_if(F.expr("rain_trigger = 1")).alias("rain"),
        F.count_if(F.expr("yield_trigger = 1")).alias("yield"),
        F.count_if(F.expr("yield_shortfall_frac > 0.25")).alias("short"),
        F.count_if(F.expr("insurance_trigger = 0")).alias("calm"),
        F.count_if(F.array_contains("reason_codes", "TRIGGER-HIT")).alias("hit"),
        F.count_if(F.array_contains("reason_codes", "YIELD-SHORT")).alias("code"),
    ).first()
    assert min(seen) > 0
    from fairload.operators import cleaning

    masked = cleaning.masked_passes(plan.tables["ndvi"], plan.tables["plots"], plan.p)
    assert masked.groupBy("plot_id").agg(F.count("ndvi").alias("n")).where("n = 0").count() > 0
    assert plan.village_scores.join(plan.tables["yield_history"], "village_id", "left_anti").count() > 0


def test_workers_find_the_package_from_a_foreign_folder(tmp_path):
    import subprocess

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', sys.argv[2]).getOrCreate()\n"
        "import __spark_entry__\n"
        "print('ROWS', __spark_entry__.queries()['irrigation_greedy_plan'](spark, sys.argv[3]).count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    args = [sys.executable, "-c", code, root, str(tmp_path / "shared"), SF]
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in done.stdout, done.stderr[-2000:]

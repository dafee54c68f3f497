from pyspark.sql import functions as F

from fairload import __main__ as batch
from fairload.plans.grid import GridPlan
from fairload.sources import tables
from fairload.sources.mapping import logical_tables
from fairload.sources.tables import grid_bundle

SF = "/root/testdata/sf0.001"


def test_batch_jobs_read_a_landing_folder_and_write_all_results(spark, tmp_path):
    logical, land = logical_tables(spark, SF), str(tmp_path / "land")
    for name in ("meters", "transformers", "feeders", "substations", "shed_history", "weather", "tx_history"):
        tables.save_table(logical[name], f"{land}/grid", name)
    tables.save_table(logical["readings"], f"{land}/grid", "readings_0000")
    for name in ("plots", "villages", "blocks", "districts", "yield_history"):
        tables.save_table(logical[name], f"{land}/agro", name)
    tables.save_table(logical["block_weather"], f"{land}/agro", "weather")
    tables.save_table(logical["ndvi"].withColumnRenamed("pass_ts", "date"), f"{land}/agro", "ndvi_0000")

    def args(domain, amount):
        given = [domain, "--data", f"{land}/{domain}", "--out", str(tmp_path / domain), "--candidates", "300"]
        return batch.parse(given + (["--amount", str(amount)] if amount else []) + ["--rounds", "3"])

    batch.run_grid(spark, args("grid", 0.1))
    batch.run_agro(spark, args("agro", 2.0))
    read = lambda domain, name: spark.read.json(str(tmp_path / domain / f"{name}.json"))
    for domain in ("grid", "agro"):
        plans, members = read(domain, "plans"), read(domain, "plan_members")
        assert plans.count() >= 1
        assert members.select("scenario_id", "plan_id").distinct().count() == plans.count()
        assert read(domain, "quality").first().rows_in > 0
    assert read("grid", "system").count() == 1 and read("agro", "villages").count() > 0
    system, state = read("grid", "system").first(), read("grid", "transformers")
    assert 0.5 < system.risk_model_auc <= 1 and system.data_quality.rows_in > 0
    assert len(system.temperature) > 0 and len(system.future_temperature) > 0
    crop = read("agro", "system").first()
    assert crop.data_quality.rows_in > 0 and len(crop.ndvi_curve) > 0 and len(crop.rain_curve) > 0
    # fitted by default: other scores than the stand-ins, for every live transformer
    plain = GridPlan(grid_bundle(spark, f"{land}/grid")).watchlist()
    both = state.select("transformer_id", "p_fail_72h").join(plain.select("transformer_id", F.col("p_fail_72h").alias("q")), "transformer_id")
    assert both.count() == state.count() == plain.count() and both.where("p_fail_72h <> q").count() > 0
    backfill = batch.parse(["backfill", "--data", f"{land}/grid", "--out", str(tmp_path / "curated")])
    batch.run_backfill(spark, backfill)
    assert spark.read.parquet(f"{backfill.out}/feeder_daily").count() > 0

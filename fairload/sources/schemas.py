"""Declared schema of every logical table (lists of ``name type`` in DDL form)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType
from pyspark.sql.window import Window

DDL = {
    # grid
    "readings": "reading_id bigint, meter_id bigint, ts timestamp, kwh double, voltage double",
    "meters": "meter_id bigint, transformer_id bigint, customer_class string",
    "transformers": "transformer_id bigint, feeder_id bigint, capacity_kva int, age_years int, lat double, lon double",
    "feeders": "feeder_id bigint, substation_id bigint, name string, critical_type string, is_protected boolean, lat double, lon double",
    "substations": "substation_id bigint, name string",
    "shed_history": "feeder_id bigint, shed_hours_30d double, complaints_30d int",
    "weather": "ts timestamp, temp_c double, humidity double",
    "tx_history": "transformer_id bigint, row_key bigint, age_years double, capacity_kva double, loading_mean double, loading_max double, overload_minutes double, sag_count double, thermal_stress double, failed_next72h int",
    # agro
    "ndvi": "plot_id bigint, pass_ts timestamp, pass_no bigint, ndvi double, cloud_flag int",
    "plots": "plot_id bigint, village_id bigint, crop string, irrigation string, area_ha double, soil_awc double",
    "villages": "village_id bigint, block_id bigint, district_id bigint, name string, canal_reach string, past_support_index double, lat double, lon double",
    "blocks": "block_id bigint, district_id bigint",
    "districts": "district_id bigint, name string",
    "block_weather": "block_id bigint, date timestamp, rain_mm double, tmax double, tmin double",
    "yield_history": "village_id bigint, season int, peak_ndvi double, integ_ndvi double, water_stress double, gdd_frac double, pest_index double, yield_t_ha double, normal_yield double, loss_event int",
}

GRID_TABLES = ("readings", "meters", "transformers", "feeders", "substations", "shed_history", "weather", "tx_history")
AGRO_TABLES = ("ndvi", "plots", "villages", "blocks", "districts", "block_weather", "yield_history")
# fact tables arrive in many part files named <prefix>_0000, <prefix>_0001, ...
FACT_TABLES = ("readings", "ndvi")


# counters that the engine adds itself when a table comes without them
ARRIVAL = {"readings": "reading_id", "ndvi": "pass_no"}


def schema_of(name: str, text_ids: bool = False) -> StructType:
    """Declared schema; ``text_ids`` for deployments whose ids are text and not numbers."""
    ddl = DDL[name]
    if text_ids:
        counters = set(ARRIVAL.values()) | {"row_key"}
        ddl = ", ".join(
            c.replace(" bigint", " string") if c.endswith("_id bigint") and c.split()[0] not in counters else c
            for c in ddl.split(", ")
        )
    return StructType.fromDDL(ddl)


ROWS_A_FILE = 1 << 40


def with_arrival(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file table in file order: by path, then by place in the file.

    Spark reads large files first and cuts them into splits, so the order in which tasks see rows says
    nothing. Parquet rows carry their place in the file. Lines of text files do not; they are counted by
    split, which costs a second read.
    """
    place = df.select("*", F.col("_metadata.file_path").alias("_path"), _place_in_file(df).alias("_place"))
    columns = [c for c in place.columns if c not in ("_path", "_place")]
    if dict(place.dtypes)["_place"] == "bigint":
        found = _with_file_number(place, df.select(F.col("_metadata.file_path").alias("_path")))  # reads footers only
        return found.select(*columns, (F.col("_file") * ROWS_A_FILE + F.col("_place")).alias(name))
    split = [F.col("_path"), F.col("_place.start").alias("_start")]
    sizes = place.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_place.row").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = place.withColumn("_start", F.col("_place.start")).join(starts, ["_path", "_start"])
    found = _with_file_number(found, sizes.select("_path"))
    at = F.col("_before") + F.col("_place.row") - F.col("_first")
    return found.select(*columns, (F.col("_file") * ROWS_A_FILE + at).alias(name))


def _with_file_number(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``_file``: the place of each row's ``_path`` among the sorted paths.

    The paths are those that the rows themselves carry: a file listing may spell them in another way. The
    driver holds a name a file, as it does when it lists them. A row whose path has no number is an error.
    """
    names = sorted(r[0] for r in paths.distinct().collect())
    numbered = rows.sparkSession.createDataFrame([(p, n) for n, p in enumerate(names)], "_path string, _file bigint")
    missing = F.raise_error(F.concat(F.lit("no number for file "), F.col("_path")))
    return rows.join(F.broadcast(numbered), "_path", "left").withColumn("_file", F.coalesce("_file", missing.cast("bigint")))


def _place_in_file(df: DataFrame) -> Column:
    """Row number in the file where the format knows it, else the split and a number that grows within it."""
    try:
        df.select("_metadata.row_index")
        return F.col("_metadata.row_index")
    except AnalysisException:
        return F.struct(
            F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
        )


def with_keys(df: DataFrame, name: str) -> DataFrame:
    """Bring a table of the landing layout to ours: arrival numbers by file order, a row key for
    history rows, and the pass time under its name here."""
    if name == "ndvi" and "pass_ts" not in df.columns and "date" in df.columns:
        df = df.withColumnRenamed("date", "pass_ts")
    arrival = ARRIVAL.get(name)
    if arrival and arrival not in df.columns:
        df = with_arrival(df, arrival)
    if name == "tx_history" and "row_key" not in df.columns:
        df = df.withColumn("row_key", F.pmod(F.xxhash64(*df.columns), F.lit(2147483647)))
    return df


def conform(df: DataFrame, name: str) -> DataFrame:
    """Check and cast a table that brings its own schema; NaN becomes a missing value and text ids
    stay text."""
    df = with_keys(df, name)
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    declared = schema_of(name, text_ids=any(c.endswith("_id") for c in texts))
    absent = [f.name for f in declared if f.name not in df.columns]
    if absent:
        raise ValueError(f"table {name} lacks {', '.join(absent)}")
    floating = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    columns = []
    for f in declared:
        c = F.col(f.name)
        if f.name in floating:
            c = F.when(~F.isnan(c), c)
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)

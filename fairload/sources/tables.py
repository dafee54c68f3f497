"""Reading and writing logical tables: parquet first, CSV with the declared schema otherwise."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from fairload.sources.schemas import AGRO_TABLES, FACT_TABLES, GRID_TABLES, conform, schema_of, with_keys

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _typed(rows: DataFrame, declared: StructType) -> DataFrame:
    """Text columns of a CSV file to their declared types; columns that are not declared go."""
    columns = []
    for f in declared:
        if f.name in rows.columns:
            c = F.col(f.name)
            timed = isinstance(f.dataType, TimestampType)
            columns.append((F.to_timestamp(c, TIMESTAMP_FORMAT) if timed else c.cast(f.dataType)).alias(f.name))
    return rows.select(*columns)


def read_table(
    spark: SparkSession, folder: str, name: str, pattern: str | None = None, text_ids: bool = False
) -> DataFrame:
    """``<folder>/<name>.parquet`` or, failing that, ``<folder>/<name>.csv`` (columns by header).

    ``pattern`` (for example ``readings_*``) reads all part files of a fact table as one table.
    Any file system that Spark can open will do.
    """
    stem = f"{folder.rstrip('/')}/{pattern or name}"
    try:
        return conform(spark.read.parquet(f"{stem}.parquet"), name)
    except AnalysisException as error:
        if not _missing(error):
            raise
    try:
        rows = with_keys(spark.read.csv(f"{stem}.csv", header=True), name)
        return conform(_typed(rows, schema_of(name, text_ids)), name)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"neither {stem}.parquet nor {stem}.csv exists") from error
        raise


def read_bundle(spark: SparkSession, folder: str, names: tuple[str, ...], text_ids: bool = False) -> dict[str, DataFrame]:
    patterns = {**{n: f"{n}_*" for n in FACT_TABLES}, "block_weather": "weather" if "ndvi" in names else None}
    return {name: read_table(spark, folder, name, patterns.get(name), text_ids) for name in names}


def grid_bundle(spark: SparkSession, folder: str, text_ids: bool = False) -> dict[str, DataFrame]:
    """One fact table in parts and its dimensions, from a landing folder."""
    return read_bundle(spark, folder, GRID_TABLES, text_ids)


def agro_bundle(spark: SparkSession, folder: str, text_ids: bool = False) -> dict[str, DataFrame]:
    return read_bundle(spark, folder, AGRO_TABLES, text_ids)


def save_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write (replacing what is there) and return the path that ``read_table`` will look for."""
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, timestampFormat=TIMESTAMP_FORMAT)
    else:
        writer.format(fmt).save(path)
    return path


def load_warehouse(spark: SparkSession, tables: dict[str, DataFrame], database: str) -> list[str]:
    """Replace one catalog table for each logical table."""
    spark.sql(f"create database if not exists {database}")
    names = []
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        names.append(f"{database}.{name}")
    return names

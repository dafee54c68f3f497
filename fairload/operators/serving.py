"""Read queries over scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from fairload.functions.numeric import rounded
from fairload.settings import GridSettings


def top(cards: DataFrame, rank: str, n: int) -> DataFrame:
    return cards.orderBy(rank).limit(n)


def by_id(cards: DataFrame, id_column: str, wanted: int | str) -> DataFrame:
    return cards.where(F.col(id_column) == wanted)


def lookup(cards: DataFrame, id_column: str, name_column: str, asked: str, rank: str) -> DataFrame:
    """First card in rank order whose id is the asked text, or whose name contains it (any case)."""
    exact = F.col(id_column).cast("string") == asked
    inside = F.contains(F.lower(name_column), F.lit(asked.lower()))
    return cards.where(exact | inside).orderBy(rank).limit(1)


def history_and_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Measured and forecast points of one display series."""
    return history.select(F.lit("history").alias("kind"), "ts", "mw").unionByName(
        forecast.select(F.lit("forecast").alias("kind"), "ts", "mw")
    )


def _metrics(domain: str, row: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()]
    )
    return row.select(F.inline(pairs)).select(F.lit(domain).alias("domain"), "metric", "value")


def grid_kpis(summary: DataFrame, newest: DataFrame, p: GridSettings) -> DataFrame:
    """Headline numbers. Freshness is measured against the end of the newest interval's day, in
    dispatch blocks, so that the result depends on the data alone."""
    c = F.col
    day_end = F.date_trunc("day", "ts") + F.expr("interval 1 day")
    behind = newest.select(((F.unix_micros(day_end) - F.unix_micros("ts")) / (p.grain_s * 1e6)).alias("v")).scalar()
    return _metrics(
        "grid",
        summary.withColumn("_behind", behind),
        {
            "system_load_mw": c("current_mw"),
            "forecast_peak_mw": c("forecast_peak_mw"),
            "supply_deficit_mw": c("deficit_mw"),
            "headroom_mw": rounded(c("capacity_mw") - c("forecast_peak_mw"), 0),
            "tx_watchlist": c("tx_watchlist"),
            "blocks_to_day_end": c("_behind"),
        },
    )


def agro_kpis(summary: DataFrame) -> DataFrame:
    c = F.col
    return _metrics(
        "agro",
        summary,
        {
            "villages": c("villages"),
            "area_at_risk_pct": c("at_risk_pct"),
            "triggers_hit": c("insurance_triggers"),
            "mean_yield_pred": c("mean_yield_pred"),
            "mean_normal_yield": c("mean_normal_yield"),
            "yield_saveable_t": c("yield_saveable_total_t"),
        },
    )


def unit_counts(domains: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for domain, (label, units) in domains.items():
        row = units.agg(F.count(F.lit(1)).alias("units")).select(
            F.lit(domain).alias("domain"), F.lit(label).alias("unit_label"), "units"
        )
        out = row if out is None else out.unionByName(row)
    return out


def scalars_only(record: DataFrame) -> DataFrame:
    """The fields of a result record that are not lists or nested."""
    return record.select(*[f.name for f in record.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))])

"""Reason codes and fleet normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.settings import LogitCard


def code_list(*codes: Column) -> Column:
    """Array of the codes that apply, in the order given."""
    return F.array_compact(F.array(*codes))


def with_fleet_range(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``_fleet``: (min, max) of several columns over the whole fleet, from a single pass."""
    parts = []
    for name, c in columns.items():
        parts += [F.min(c).alias(f"{name}_lo"), F.max(c).alias(f"{name}_hi")]
    return df.withColumn("_fleet", df.agg(F.struct(*parts).alias("range")).scalar())


def normalised(c: Column, name: str) -> Column:
    """Min-max over the fleet; a fleet of equal values gives 0."""
    low, width = F.col(f"_fleet.{name}_lo"), F.col(f"_fleet.{name}_hi") - F.col(f"_fleet.{name}_lo")
    return F.when(width > 1e-9, (c - low) / width).otherwise(c * 0.0)


def contributions(card: LogitCard, inputs: dict[str, Column]) -> list[Column]:
    """Signed push of each input on the log-odds, relative to the training mean."""
    return [
        (inputs[f] - F.lit(m)) / F.lit(s) * F.lit(w)
        for f, m, s, w in zip(card.features, card.mean, card.scale, card.weight)
    ]


def probability(card: LogitCard, inputs: dict[str, Column]) -> Column:
    total = F.lit(card.bias)
    for part in contributions(card, inputs):
        total = total + part
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def top_factors(names: tuple[str, ...], parts: list[Column], values: list[Column], keep: int = 3) -> Column:
    """The ``keep`` largest contributions by size, then only those that push the risk up."""
    entries = F.array(
        *[
            F.struct(
                (-F.abs(p)).alias("order"),
                F.lit(i).alias("idx"),
                F.lit(n).alias("feature"),
                p.alias("contribution"),
                v.cast("double").alias("value"),
            )
            for i, (n, p, v) in enumerate(zip(names, parts, values))
        ]
    )
    largest = F.slice(F.array_sort(entries), 1, keep)
    return F.filter(largest, lambda e: e.getField("contribution") > 0.01)


def factor_labels(factors: Column, labels: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform(factors, lambda e: pairs[e.getField("feature")])

"""Running totals, ranks, exact medians and AUC that never sort a whole table in one task.

Each works the same way: rows are placed in value bins of equal width, the bins (at most
``BINS`` + 1 of them, whatever the size of the table) are totalled and accumulated, and only rows
of the same bin are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 65536


def _binned(
    df: DataFrame, by: list[str], key: Column, descending: bool, bounds: tuple[float, float] | None
) -> DataFrame:
    """Add ``_bin``: equal-width bins of ``key``, numbered in sort order, missing keys last.

    Given ``bounds`` save looking up the range; values beyond them share the outermost bins.
    """
    position = (-key if descending else key).cast("double")
    placed = df.withColumn("_pos", position)
    extremes = F.min("_pos").alias("lo"), F.max("_pos").alias("hi")
    if bounds:
        low, high = (-bounds[1], -bounds[0]) if descending else bounds
        placed = placed.withColumn("_span", F.struct(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi")))
    elif by:
        placed = placed.join(placed.groupBy(*by).agg(F.struct(*extremes).alias("_span")), by, "left")
    else:
        placed = placed.withColumn("_span", placed.agg(F.struct(*extremes).alias("s")).scalar())
    width = F.col("_span.hi") - F.col("_span.lo")
    at = F.floor((F.col("_pos") - F.col("_span.lo")) / width * BINS)
    inside = F.when(width > 0, F.greatest(F.least(at, F.lit(BINS - 1)), F.lit(0))).otherwise(F.lit(0))
    # the last bin number is reserved for missing keys
    number = F.when(F.col("_pos").isNull(), F.lit(BINS)).otherwise(inside)
    return placed.withColumn("_bin", number.cast("int")).drop("_span")


def running_total(
    df: DataFrame,
    value: Column,
    key: Column,
    tie: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    name: str = "before",
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Add ``name``: the total of ``value`` over all rows ordered strictly before this one.

    Order is ``key`` (missing last), then ``tie``; ``by`` gives independent orders. ``key`` must
    come out the same each time it is computed: round it if it stems from a sum of doubles.
    """
    by = by or []
    binned = _binned(df.withColumn("_val", value), by, key, descending, bounds)
    totals = binned.groupBy(*by, "_bin").agg(F.sum("_val").alias("_bin_total"))
    over_bins = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = over_bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_bin", F.coalesce(F.sum("_bin_total").over(earlier), F.lit(0)).alias("_start")
    )
    within = (
        Window.partitionBy(*by, "_bin")
        .orderBy(F.col("_pos").asc_nulls_last(), *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = binned.join(starts, [*by, "_bin"])
    return joined.withColumn(
        name, F.col("_start") + F.coalesce(F.sum("_val").over(within), F.lit(0))
    ).drop("_val", "_pos", "_bin", "_start")


def ranked(
    df: DataFrame,
    key: Column,
    tie: list[str],
    by: list[str] | None = None,
    name: str = "rank",
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Add ``name``: position 1..N by ``key`` descending, missing last, then ``tie``."""
    counted = running_total(df, F.lit(1).cast("bigint"), key, tie, by, descending=True, name=name, bounds=bounds)
    return counted.withColumn(name, (F.col(name) + 1).cast("bigint"))


def exact_median(df: DataFrame, column: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """One row, column ``median``: the middle value (mean of the middle two), missing ignored."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    placed = running_total(counts, F.col("_n"), F.col("_v"), [], bounds=bounds)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).scalar()
    # 0-based positions of the two middle rows; equal when the count is odd
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("_n"))
    middle = placed.withColumn("_total", total).where(holds(low) | holds(high))
    return middle.agg(
        ((F.min(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median")
    )


def auc(
    df: DataFrame, label: str, score: str, by: list[str] | None = None, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """Area under the ROC curve by rank sum; tied scores share their mean rank; 0.5 if one class
    is absent. One row for each ``by`` group, with ``positives``, ``negatives`` and ``auc``."""
    by = by or []
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_v")).agg(
        F.count_if(F.col(label) == 1).alias("_pos_n"), F.count_if(F.col(label) != 1).alias("_neg_n")
    )
    placed = running_total(counts, F.col("_neg_n"), F.col("_v"), [], by, name="_neg_before", bounds=bounds)
    wins = F.col("_pos_n").cast("double") * (F.col("_neg_before") + F.col("_neg_n") / 2.0)
    totals = placed.groupBy(*by) if by else placed.groupBy()
    summed = totals.agg(
        F.coalesce(F.sum("_pos_n"), F.lit(0)).cast("bigint").alias("positives"),
        F.coalesce(F.sum("_neg_n"), F.lit(0)).cast("bigint").alias("negatives"),
        F.coalesce(F.sum(wins), F.lit(0.0)).alias("_wins"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return summed.withColumn("auc", F.when(pairs > 0, F.col("_wins") / pairs).otherwise(F.lit(0.5))).drop("_wins")

"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rounded(c: Column, places: int = 6) -> Column:
    """Round half up on the decimal value, so that ties do not depend on binary noise."""
    return F.round(c.cast("decimal(28,10)"), places).cast("double")


def clip(c: Column, low: float, high: float) -> Column:
    """Keep missing values missing: ``least``/``greatest`` alone would skip them."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def at_least(c: Column, low: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def ratio(top: Column, bottom: Column, floor: float = 1e-6) -> Column:
    """Division with a floored denominator."""
    return top / at_least(bottom, floor)


def unit_uniform(plan: Column, unit: Column, seed: int) -> Column:
    """A number in [0, 1] fixed by (plan, unit, seed): a coin that every engine tosses alike."""
    modulus = 2147483647
    mixed = F.pmod(plan * 7919 + unit * 104729 + F.lit(seed).cast("bigint") * 15485863 + 11, F.lit(modulus))
    return F.pmod(mixed * mixed + plan * 31 + unit * 17, F.lit(modulus)) / F.lit(float(modulus))


def whole_number(df: DataFrame, id_column: str) -> Column:
    """A whole number for an id: the id itself, or a digest below 2^31 if it is text."""
    if isinstance(df.schema[id_column].dataType, StringType):
        return F.pmod(F.xxhash64(id_column), F.lit(2147483647))
    return F.col(id_column).cast("bigint")

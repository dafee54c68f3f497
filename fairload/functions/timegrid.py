"""Placing timestamps on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap(ts: Column, grain_s: int) -> Column:
    """Nearest grid point; an exact half goes to the even slot. Whole-number arithmetic only."""
    grain = grain_s * 1_000_000
    micros = F.unix_micros(ts)
    past = F.pmod(micros, F.lit(grain))
    start = micros - past
    odd_slot = F.pmod((start / grain).cast("bigint"), F.lit(2)) == 1
    up = (past * 2 > grain) | ((past * 2 == grain) & odd_slot)
    return F.timestamp_micros(start + F.when(up, F.lit(grain)).otherwise(F.lit(0)))


def slot_number(ts: Column, first: Column, grain_s: int) -> Column:
    """How many grid steps after ``first``; both are already on the grid."""
    return ((F.unix_micros(ts) - F.unix_micros(first)) / (grain_s * 1_000_000)).cast("bigint")


def slot_time(first: Column, slot: Column, grain_s: int) -> Column:
    return F.timestamp_micros(F.unix_micros(first) + slot.cast("bigint") * (grain_s * 1_000_000))


def day_fraction_hours(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0

"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def py_round(col: Column | str, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(col, digits)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def floor_div(value: Column, step: int) -> Column:
    """Integer floor division that stays in longs (no double round-off)."""
    step = F.lit(step).cast("long")
    return ((value - F.pmod(value, step)) / step).cast("long")


def bucket_index(ts: Column | str, anchor: str, interval_s: int) -> Column:
    """Index of the fixed bucket [anchor + k*interval, ...) that holds ``ts``."""
    return floor_div(micros(ts) - micros(F.lit(anchor).cast("timestamp")), interval_s * 1_000_000)


def bucket_start(k: Column | str, anchor: str, interval_s: int) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return F.timestamp_micros(micros(F.lit(anchor).cast("timestamp")) + k * F.lit(interval_s * 1_000_000).cast("long"))


def time_chunk(ts: Column | str, chunk_s: int = 3600) -> Column:
    """Fixed time slice used to split one machine's rows over many tasks."""
    return floor_div(micros(ts), chunk_s * 1_000_000)


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR_US))


def local_time(ts: Column | str, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def compact(*cols: Column) -> Column:
    """Array of the non-null arguments, in order."""
    return F.array_compact(F.array(*cols))

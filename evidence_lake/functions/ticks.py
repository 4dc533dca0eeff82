"""Tick arithmetic: fixed-width buckets of nanosecond epoch time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TICK_SECONDS

NANOS = 1_000_000_000


def floor_div(value: Column, width: int) -> Column:
    """Integer division that rounds down below zero too, on BIGINT throughout."""
    divisor = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def tick_index(ns: Column, tick_seconds: int = TICK_SECONDS) -> Column:
    return floor_div(ns, tick_seconds * NANOS)


def tick_start_ns(tick: Column, tick_seconds: int = TICK_SECONDS) -> Column:
    return tick * F.lit(tick_seconds * NANOS).cast("bigint")


def tick_end_ns(tick: Column, tick_seconds: int = TICK_SECONDS) -> Column:
    """Last nanosecond of the tick (inclusive)."""
    return tick_start_ns(tick, tick_seconds) + F.lit(tick_seconds * NANOS - 1).cast("bigint")

"""Quote and trade validity, price grid and depth expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def mid_price(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0) & (ask >= bid), (bid + ask) / 2.0)


def near_limit(mid: Column, upper: Column, lower: Column, tick: Column, buffer_ticks: float) -> Column:
    """Mid within the buffer of a price limit; limits that are null or not positive are ignored."""
    return _yes((upper > 0) & (mid >= upper - buffer_ticks * tick)) | _yes((lower > 0) & (mid <= lower + buffer_ticks * tick))


def quote_valid(tradable: Column, bid: Column, ask: Column, mid: Column, upper: Column, lower: Column,
                tick: Column, buffer_ticks: float = 2.0) -> Column:
    book = _yes((bid > 0) & (ask > 0) & (ask >= bid) & (mid > 0))
    return _yes(tradable) & book & ~near_limit(mid, upper, lower, tick, buffer_ticks)


def trade_eligible(tradable: Column, last: Column, upper: Column, lower: Column) -> Column:
    """Tradable, and the last price strictly inside the price limits."""
    return _yes(tradable) & ~_yes((lower > 0) & (last <= lower)) & ~_yes((upper > 0) & (last >= upper))


def floor_to_tick(price: Column, tick: Column) -> Column:
    return F.round(F.floor(price / tick + F.lit(1e-9)) * tick, 10)


def round_to_tick(price: Column, tick: Column) -> Column:
    return F.round(F.rint(price / tick) * tick, 10)


def bps(ticks: Column, tick: Column, fair: Column) -> Column:
    return ticks * tick / fair * 10_000

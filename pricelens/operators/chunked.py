"""Ordered operators that never need a whole ordered group in one task.

Two devices are used:

* *halo chunks* for bounded frames - every row is sent to its own chunk and to the neighbouring chunks
  whose frames can reach it, frames are evaluated inside (keys, chunk), and only the chunk's own rows stay;
* *carried chunks* for unbounded frames (previous row, last known value, running sum) - evaluated inside
  (keys, chunk), plus one small row per chunk that carries the state of all earlier chunks.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"
CORE = "_core"


def chunk_of(order: str | Column, width: int) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(width)).cast("bigint")


def halo_chunks(df: DataFrame, order: str, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Adds ``_chunk``/``_core``; a row is copied to each chunk whose frames [-back, +ahead] may contain it."""
    key = F.col(order)
    spread = F.sequence(chunk_of(key - F.lit(ahead), width), chunk_of(key + F.lit(back), width))
    return df.withColumn(CHUNK, F.explode(spread)).withColumn(CORE, F.col(CHUNK) == chunk_of(key, width))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(CHUNK, CORE)


def ordered_state(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: str | None = None,
    previous: Mapping[str, Column] | None = None,
    last_known: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Adds per row, in (keys, order):

    ``previous``   value of the expression on the row just before,
    ``last_known`` last non-null value strictly before,
    ``running``    running sum including the row (nulls count as zero).

    ``chunk`` names a column that is non-decreasing along ``order``; None evaluates whole groups. ``clustered``
    says that ``df`` is already distributed by (keys, chunk), so the rows are not shuffled again.
    ``order`` must be unique inside a group.
    """
    previous, last_known, running = dict(previous or {}), dict(last_known or {}), dict(running or {})
    part = [*keys, chunk] if chunk else list(keys)
    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    if not chunk:
        return df.withColumns(
            {name: F.lag(expr).over(w) for name, expr in previous.items()}
            | {name: F.last(expr, ignorenulls=True).over(before) for name, expr in last_known.items()}
            | {name: F.coalesce(F.sum(expr).over(upto), F.lit(0)) for name, expr in running.items()}
        )

    if not clustered:
        df = df.repartition(*part)
    position = F.struct(*order)
    # Touching every column keeps the chunk summary's input identical to the row branch's input, so both read one
    # shuffle instead of computing everything upstream twice.
    tails = [F.max(F.xxhash64(*df.columns)).alias("_touch")]
    if previous:
        tails.append(F.max_by(F.struct(*[e.alias(n) for n, e in previous.items()]), position).alias("_tail"))
    for name, expr in last_known.items():
        tails.append(F.max_by(expr, F.when(expr.isNotNull(), position)).alias(f"_known_{name}"))
    for name, expr in running.items():
        tails.append(F.sum(expr).alias(f"_sum_{name}"))
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*part).agg(*tails).select(
        *part, F.col("_touch"),
        *([F.lag("_tail").over(by_chunk).alias("_carry_tail")] if previous else []),
        *[F.last(f"_known_{n}", ignorenulls=True).over(earlier).alias(f"_carry_known_{n}") for n in last_known],
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_carry_sum_{n}") for n in running],
    )
    local = df.withColumns(
        {f"_first_{CHUNK}": F.row_number().over(w) == 1}
        | {name: F.lag(expr).over(w) for name, expr in previous.items()}
        | {name: F.last(expr, ignorenulls=True).over(before) for name, expr in last_known.items()}
        | {name: F.coalesce(F.sum(expr).over(upto), F.lit(0)) for name, expr in running.items()}
    )
    joined = local.join(carried, part, "left")
    fixed = {
        name: F.when(F.col(f"_first_{CHUNK}"), F.col(f"_carry_tail.{name}")).otherwise(F.col(name))
        for name in previous
    }
    fixed |= {name: F.coalesce(F.col(name), F.col(f"_carry_known_{name}")) for name in last_known}
    fixed |= {name: F.col(name) + F.col(f"_carry_sum_{name}") for name in running}
    leftovers = [c for c in carried.columns if c not in part] + [f"_first_{CHUNK}"]
    return joined.withColumns(fixed).drop(*leftovers)


def islands(
    df: DataFrame, keys: list[str], order: list[str], starts: Mapping[str, Column], is_start: Column,
    island: str = "island", chunk: str | None = None,
) -> DataFrame:
    """Numbers runs of rows. ``starts`` names previous-row values that ``is_start`` may refer to."""
    with_prev = ordered_state(df, keys, order, chunk, previous=starts)
    flagged = with_prev.withColumn("_start", F.when(is_start, 1).otherwise(0).cast("bigint"))
    return ordered_state(
        flagged, keys, order, chunk, running={island: F.col("_start")}, clustered=True
    ).drop("_start", *starts)


def gap_islands(
    df: DataFrame, keys: list[str], order: str, max_gap: int, island: str = "island",
    tie: str | None = None, chunk_width: int | None = None,
) -> DataFrame:
    """Runs of rows whose neighbours are at most ``max_gap`` apart."""
    chunk = None
    if chunk_width:
        df = df.withColumn(CHUNK, chunk_of(order, chunk_width))
        chunk = CHUNK
    ordering = [order, tie] if tie else [order]
    out = islands(
        df, keys, ordering, {"_prev_order": F.col(order)},
        F.col("_prev_order").isNull() | (F.col(order) - F.col("_prev_order") > max_gap), island, chunk,
    )
    return out.drop(CHUNK)

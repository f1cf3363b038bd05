"""As-of, forward as-of and nearest joins with a tolerance.

Both sides are unioned and ordered inside (keys, time chunk); the right side is copied to the chunks its
tolerance can reach. One shuffle, no pair expansion, and task size is bounded by the chunk width.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .chunked import CHUNK, chunk_of


def _sides(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str,
           width: int, reach_back: int, reach_ahead: int, left_rank: int, right_rank: int) -> DataFrame:
    pick = F.struct(*[F.col(c) for c in left.columns])
    rpick = F.struct(*[F.col(c) for c in right.columns if c not in on])
    # Rows without a key cannot match; spreading them keeps them out of one common partition.
    keyless = -1 - F.pmod(F.xxhash64(*left.columns), F.lit(1021))
    lside = left.select(
        *on, F.col(left_key).cast("bigint").alias("_key"), F.coalesce(chunk_of(left_key, width), keyless).alias(CHUNK),
        F.lit(left_rank).alias("_side"), pick.alias("_l"),
    )
    rkey = F.col(right_key).cast("bigint")
    rside = right.select(
        *on, rkey.alias("_key"),
        F.explode(F.sequence(chunk_of(rkey - reach_back, width), chunk_of(rkey + reach_ahead, width))).alias(CHUNK),
        F.lit(right_rank).alias("_side"), rpick.alias("_r"),
    )
    return lside.unionByName(rside, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str,
              tolerance: int, match: str = "matched", width: int = 600_000) -> DataFrame:
    """Left rows plus struct ``match``: the latest right row with key in [left_key - tolerance, left_key].

    Right keys are expected to be unique per ``on``; later filters apply to the matched row only.
    """
    both = _sides(left, right, on, left_key, right_key, width, 0, tolerance, 1, 0)
    w = Window.partitionBy(*on, CHUNK).orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    fresh = F.col("_key") - F.col(f"_m.{right_key}") <= tolerance
    return found.select("_l.*", F.when(fresh, F.col("_m")).alias(match))


def forward_join(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str,
                 tolerance: int, match: str = "matched", width: int = 600_000, tie: str | None = None) -> DataFrame:
    """Left rows plus struct ``match``: the first right row with key in [left_key, left_key + tolerance]."""
    both = _sides(left, right, on, left_key, right_key, width, tolerance, 0, 0, 1)
    order = ["_key", "_side"] + ([F.col(f"_r.{tie}")] if tie else [])
    w = Window.partitionBy(*on, CHUNK).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_m", F.first("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 0)
    near = F.col(f"_m.{right_key}") - F.col("_key") <= tolerance
    return found.select("_l.*", F.when(near, F.col("_m")).alias(match))


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str,
                 tolerance: int, match: str = "matched", width: int = 600_000) -> DataFrame:
    """Left rows plus the right row with the smallest key distance (earlier key on ties) within ``tolerance``."""
    back = asof_join(left, right, on, left_key, right_key, tolerance, "_before", width)
    both = forward_join(back, right, on, left_key, right_key, tolerance, "_after", width)
    before_gap = F.col(left_key) - F.col(f"_before.{right_key}")
    after_gap = F.col(f"_after.{right_key}") - F.col(left_key)
    pick = (
        F.when(F.col("_before").isNull(), F.col("_after"))
        .when(F.col("_after").isNull() | (before_gap <= after_gap), F.col("_before"))
        .otherwise(F.col("_after"))
    )
    return both.withColumn(match, pick).drop("_before", "_after")

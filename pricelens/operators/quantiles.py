"""Exact linear-interpolated quantiles of groups of any size.

Value counts (combined map-side) are cut into slices at approximate quantiles, slice totals give each slice its first
rank, and only the slices that contain a requested rank are ordered. A group gets a slice for each ``SLICE_VALUES`` of
its distinct values, up to ``MOST_SLICES``; no group stands in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE_VALUES = 50_000
MOST_SLICES = 1024


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with non-null values: ``keys``, ``n`` and one column per entry of ``probs``."""
    src = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return _ranked(src, keys, probs)


def _same(keys: list[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(left.format(k)).eqNullSafe(F.col(right.format(k)))
    return condition


def _ranked(src: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    counts = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.percentile_approx("_v", [i / MOST_SLICES for i in range(1, MOST_SLICES)], F.lit(10_000)).alias("_cuts"),
        F.count(F.lit(1)).alias("_values"),
        # Reading the count keeps this branch's plan equal to the others, so one exchange serves them all.
        F.max("_c").alias("_peak"),
    )
    wanted = F.least(F.lit(MOST_SLICES), F.ceil(F.col("_values") / SLICE_VALUES)).cast("int")
    cuts = cuts.withColumn("_wanted", wanted).withColumn("_cuts", F.array_distinct(F.filter("_cuts", lambda c, i: F.floor((i + 1) * F.col("_wanted") / MOST_SLICES) > F.floor(i * F.col("_wanted") / MOST_SLICES))))
    sliced = counts.join(cuts, _same(keys, "{}", "_k_{}")).select(
        *keys, "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_slice")
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_slice_n")).withColumns({
        "_end": F.sum("_slice_n").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.sum("_slice_n").over(Window.partitionBy(*keys)),
    })
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs.values())])
    asked = totals.select(
        *keys, "n", "_slice", (F.col("_end") - F.col("_slice_n")).alias("_begin"), "_end", F.explode(wanted).alias("_w")
    ).select(
        *keys, "n", "_slice", "_begin", "_end", F.col("_w.q").alias("_q"),
        (F.col("_w.p") * (F.col("n") - 1)).alias("_pos"),
    ).withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos")}).filter(
        ((F.col("_lo") >= F.col("_begin")) & (F.col("_lo") < F.col("_end")))
        | ((F.col("_hi") >= F.col("_begin")) & (F.col("_hi") < F.col("_end")))
    ).groupBy(*keys, "n", "_slice", "_begin").agg(F.collect_list(F.struct("_q", "_pos", "_lo", "_hi")).alias("_asked"))
    asked = asked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", F.col("_slice").alias("_k__slice"), "_begin", "_asked")
    w = Window.partitionBy(*keys, "_slice").orderBy("_v")
    ranked = sliced.join(asked, _same([*keys, "_slice"], "{}", "_k_{}")).withColumn(
        "_last", F.col("_begin") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    )
    first = F.col("_last") - F.col("_c") + 1
    hits = ranked.withColumn("_first", first).select(
        *keys, "n", "_v", "_first", "_last", F.explode("_asked").alias("_w")
    ).groupBy(*keys, "n", F.col("_w._q").alias("_q"), F.col("_w._pos").alias("_pos")).agg(
        F.max(F.when(F.col("_w._lo").between(F.col("_first"), F.col("_last")), F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_w._hi").between(F.col("_first"), F.col("_last")), F.col("_v"))).alias("_b"),
    )
    valued = hits.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
    return valued.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(name) for i, name in enumerate(probs)]
    )

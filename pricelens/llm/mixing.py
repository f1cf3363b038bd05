"""Mixing sources to target weights with a curriculum that changes over training time.

Each source has a weight and a slope: at training time t in [0, 1] it is drawn with weight * (1 + slope * (2t - 1)).
The schedule's integral up to t, as a share of the whole, is F(t) = (1 - slope) t + slope t^2. A source's documents
stand in a fixed pseudo-random order; the words taken before a document, as a share y of all words the mix takes
from its source, are its cumulative demand, and its training position is the t at which F(t) = y.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)
CAP = 3
#: Leading hex digits of the order key that name a bucket: 4096 buckets in each source, so no source is one group.
BUCKET_DIGITS = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """From (source, source_size): adds target and slope. One row per source, null the last.

    Weights repeat over the sources in code point order. Sources stand by size over weight; one is held at `cap`
    times its size when that is no more than its share of what the ones before it leave. What is held back is shared
    by weight among the rest.
    """
    ranked = sizes.withColumn("rank_", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w_", _cycle(weights, F.col("rank_")).cast("long")).withColumn("slope", _cycle(slopes, F.col("rank_")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("w_"), "rank_")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    share = F.col("w_") * (total - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)))
    held = ranked.withColumn("held_", F.lit(cap) * F.col("source_size") * F.sum("w_").over(onward) <= share)
    free = F.sum("source_size").over(every) - F.sum(F.when(F.col("held_"), F.lit(cap) * F.col("source_size")).otherwise(F.lit(0))).over(every)
    weight = F.nullif(F.sum(F.when(F.col("held_"), F.lit(0)).otherwise(F.col("w_"))).over(every), F.lit(0))
    target = F.when(F.col("held_"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise((F.col("w_") * free).cast("double") / weight)
    return held.withColumn("target", target).select("source", "source_size", "target", "slope")


def mix(docs: DataFrame, keep: list[str], weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """One row per row of `docs`: struct `row` of the columns `keep`, size, source_size, target, taken, position.

    Whole passes over a source come first; the rest of its target is one more pass over the first documents of its
    order, up to the one that brings the sum nearest. So no document is taken more than `cap` times, and a source's
    sum is within half a document of its target. position is that of the first pass, null where nothing is taken.
    Null ids stand in the order as empty text, ties by id and size; null texts have size 0; the null source is one of
    its own; columns named like ours are kept inside `row`.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("source"), F.col("doc_id").alias("id_"), word_count(F.col("text")).alias("size"), key.alias("key_"))
    rows = rows.withColumn("bucket_", F.substring("key_", 1, BUCKET_DIGITS))
    sums = docs.select("source", word_count(F.col("text")).alias("size"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket_")).groupBy("source", "bucket_").agg(F.sum("size").alias("bucket_size"))
    starts = sums.withColumn("start_", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, slopes, cap)
    plan = starts.join(targets.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "bucket_size")
    plan = plan.withColumnRenamed("source", "s_").withColumnRenamed("bucket_", "b_")
    inner = Window.partitionBy("source", "bucket_").orderBy("key_", "id_", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto_", F.sum("size").over(inner)).join(plan, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket_") == F.col("b_")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(F.lit(0))
    placed = placed.withColumn("passes_", passes).withColumn("before_", F.col("start_") + F.col("upto_") - F.col("size"))
    rest = F.col("target") - F.col("passes_") * F.col("source_size")
    placed = placed.withColumn("passes", F.col("passes_") + (F.col("before_") + F.col("size") / F.lit(2.0) <= rest).cast("long"))
    placed = placed.withColumn("passes", F.least(F.col("passes"), F.lit(cap).cast("long"))).withColumn("taken", F.col("size") * F.col("passes"))
    first = F.when(F.col("taken") > 0, position(F.col("before_") / F.nullif(F.col("target"), F.lit(0.0)), F.col("slope")))
    return placed.select("row", "size", "source_size", "target", "taken", first.alias("position"), "passes", "before_", "slope")


def position(share: Column, slope: Column) -> Column:
    """Training time at which the schedule has asked for `share` of the source's words."""
    y = F.least(share, F.lit(1.0))
    start = F.lit(1.0) - slope
    return F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (start + F.sqrt(start * start + F.lit(4.0) * slope * y)))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training sequence: the columns of `docs`, then mix_pass and mix_position; one row for each pass of a document.

    Rows are sorted by position across range partitions. Documents that the mix does not take are not in it.
    """
    placed = mix(docs, docs.columns, **options).where(F.col("taken") > 0)
    each = placed.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    share = ((F.col("mix_pass") - 1) * F.col("source_size") + F.col("before_")) / F.col("target")
    each = each.withColumn("mix_position", position(share, F.col("slope")))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns], "mix_pass", "mix_position").orderBy("mix_position", "doc_id", "mix_pass")

"""Interval joins on a bucketed key instead of a nested loop."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .chunked import CHUNK, chunk_of


def range_join(intervals: DataFrame, points: DataFrame, on: list[str], start: str | Column, end: str | Column, point: str,
               width: int = 60_000, extra: Column | None = None, tasks: int | None = None, dealt: bool = False, once: bool = False) -> DataFrame:
    """Inner join of each interval [start, end] with the points it contains.

    An interval is copied once per bucket it touches and a point lives in exactly one bucket, so the equi-join
    on (on, bucket) yields every pair once. Skewed buckets are split by adaptive execution. Long intervals need wide
    buckets, or their copies outgrow the input. The copies are merged and never broadcast, for Spark's estimate of
    their size leaves out the explode. ``tasks`` keeps that many join tasks where few bytes give many pairs.
    Bounds given as expressions are not shuffled with the copies. ``dealt`` says that the points hold their bucket and
    are distributed by (on, bucket) to that many tasks already. With ``once`` equal intervals count as one.
    """
    low, high = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    spans = intervals.filter(high >= low).withColumn(CHUNK, F.explode(F.sequence(chunk_of(low, width), chunk_of(high, width))))
    keyed = points if dealt else points.withColumn(CHUNK, chunk_of(point, width))
    if tasks:
        spans = spans.repartition(tasks, *on, CHUNK)
        keyed = keyed if dealt else keyed.repartition(tasks, *on, CHUNK)
    if once:
        spans = spans.dropDuplicates()
    inside = F.col(point).between(low, high)
    # The side on the right is held a bucket at a time: the intervals, and pairs come out point by point, which packs well.
    joined = keyed.join(spans.hint("merge"), [*on, CHUNK]).filter(inside if extra is None else inside & extra)
    rest = lambda df: [c for c in df.columns if c not in (*on, CHUNK)]
    return joined.select(*on, *rest(intervals), *rest(points))

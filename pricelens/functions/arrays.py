"""Small-array statistics and ordered sets, evaluated inside the row."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def array_median(arr: Column) -> Column:
    """Median of a short array; nulls are ignored, an empty array gives null."""
    s = F.sort_array(F.array_compact(arr))
    n = F.size(s)
    lo = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def array_mad_sigma(arr: Column) -> Column:
    """1.4826 x median absolute deviation of a short array."""
    med = array_median(arr)
    return F.lit(1.4826) * array_median(F.transform(arr, lambda x: F.abs(x - med)))


def ordered_subset(values: Column, order: tuple[str, ...]) -> Column:
    """The members of ``order`` present in ``values``, in that order."""
    wanted = F.array(*[F.lit(v) for v in order])
    return F.filter(wanted, lambda v: F.array_contains(values, v))


def flags(*pairs: tuple[Column, str]) -> Column:
    """Sorted distinct names of the conditions that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))))

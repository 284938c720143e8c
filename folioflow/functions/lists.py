"""Index and order operations on array columns. Index specs are fixed when the plan is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick_at(arr: Column, n: int) -> Column:
    """The n-th element (negative counts from the end) as an array; empty when out of range."""
    start = F.lit(n + 1) if n >= 0 else F.size(arr) + n + 1
    inside = (F.size(arr) > n) if n >= 0 else (F.size(arr) >= -n)
    return F.when(inside, F.slice(arr, start, F.lit(1))).otherwise(F.slice(arr, 1, 0))


def pick_slice(arr: Column, start: int | None = None, end: int | None = None) -> Column:
    """Half-open slice. With two descending negative bounds: from the second bound to the end."""
    if start is not None and end is not None and start < 0 and end < 0 and start > end:
        start, end = end, None
    size = F.size(arr)

    def bound(n: int | None, default: Column) -> Column:
        if n is None:
            return default
        return F.greatest(size + n, F.lit(0)) if n < 0 else F.least(F.lit(n), size)

    low, high = bound(start, F.lit(0)), bound(end, size)
    return F.slice(arr, low + 1, F.greatest(high - low, F.lit(0)))


def exclude_at(arr: Column, n: int) -> Column:
    """All elements but the n-th (negative counts from the end)."""
    at = F.lit(n) if n >= 0 else F.size(arr) + n
    return F.filter(arr, lambda _, i: i != at)


def exclude_two(arr: Column, a: int, b: int) -> Column:
    """Exclude element ``a``, then element ``b`` of the list that is left."""
    first = exclude_at(arr, a)
    at = F.lit(b) if b >= 0 else F.size(first) + b
    return F.filter(first, lambda _, i: i != at)


def reverse_list(arr: Column) -> Column:
    return F.reverse(arr)

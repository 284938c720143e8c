"""Joins of many rows with one row for each group, where a few groups may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot with more than 1/SHARE of all rows, so fewer than SHARE groups can be hot.
SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row for each ``key``, ``size`` rows of ``rows`` in it); drops ``size``.

    Rows of hot groups meet the broadcast rows of their groups, of which there are fewer than SHARE whatever the input;
    the rest is shuffled by key, where no group holds more than 1/SHARE of the rows. ``groups`` is a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > total / SHARE).drop(size)
    cold = groups.filter(F.col(size) <= total / SHARE).drop(size)
    some = F.broadcast(hot)
    return rows.join(some, key).unionByName(rows.join(some.select(key), key, "left_anti").join(cold, key, "left"))

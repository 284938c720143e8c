"""Row numbers and previous rows inside groups of any size.

A plain window sends a whole group to one task. Row numbers come from one sort by ranges instead: the ranges are of
about equal size whatever the groups are, rows are counted by group and range, and the counts of the ranges before
are added. Previous rows are carried over blocks of the order column. A group that holds a third of the table is
spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import settle

FAN = 65536
# Bits of a row's number inside its partition, as Spark numbers rows.
PLACE = 33


def ordinal(df: DataFrame, keys: list[str], block: Column, order: list[Column], out: str = "rn") -> DataFrame:
    """Number the rows of each group from 1 in the given order; the input is evaluated once.

    ``block`` is a whole number that does not decrease along the order; it sorts first. Rows that are equal in everything are
    told apart by where they lie, so even they are spread over the ranges. Null keys are groups like any other.
    """
    spark = df.sparkSession
    rows = settle(df.withColumn("_b0", block.cast("long")), "to-number").withColumn("_row", F.monotonically_increasing_id())
    by = [*[F.asc(k) for k in keys], F.asc("_b0"), *order, F.asc("_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ranges = settle(ranges.drop("_b0", "_row"), "numbered")
    ranges = ranges.withColumns({"_part": F.shiftright("_id", PLACE), "_place": F.col("_id").bitwiseAND((1 << PLACE) - 1)})
    runs = ranges.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    # One row for each group and range: a group has as many as it has ranges at most.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    marks = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before.alias("_add"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = ranges.join(marks, same).withColumn(out, F.col("_place") + F.col("_add"))
    return numbered.select(*[c for c in df.columns if c != out], out)


def previous(df: DataFrame, keys: list[str], block: Column, order: str, out: str) -> DataFrame:
    """The order value of the row before, inside groups of any size."""
    cut = df.withColumn("_b0", block.cast("long"))
    ends = cut.groupBy(*keys, "_b0").agg(F.max(order).alias("_end"))
    ends = ends.withColumn("_b1", F.floor(F.col("_b0") / FAN))
    tops = ends.groupBy(*keys, "_b1").agg(F.max("_end").alias("_end1"))
    tops = tops.withColumn("_top", F.lag("_end1").over(Window.partitionBy(*keys).orderBy("_b1"))).drop("_end1")
    ends = (
        ends.withColumn("_low", F.lag("_end").over(Window.partitionBy(*keys, "_b1").orderBy("_b0")))
        .join(tops, [*keys, "_b1"])
        .select(*keys, "_b0", F.coalesce("_low", "_top").alias("_carry"))
    )
    local = F.lag(order).over(Window.partitionBy(*keys, "_b0").orderBy(order))
    return (
        cut.withColumn("_local", local)
        .join(ends, [*keys, "_b0"])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_b0", "_local", "_carry")
    )

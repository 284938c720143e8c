"""Mixing sources to target weights by Pfair scheduling.

The texts of a source, in the order of a hash of doc_id, are laid end to end and cut into blocks of ``BLOCK`` characters;
a document belongs to the block it starts in. Block k of a source with weight w may run from slot floor(k / w) and is due
before slot ceil((k + 1) / w). Earliest deadline first over these windows gives every source its share of every prefix
to within less than one block. Weights are exact fractions: a number counts as the decimal it is written as, and a source
has its weight over the sum of all, so nothing is rounded and no error adds up. The driver schedules blocks, not
documents, with one heap entry for each source, and writes the placed blocks ``FRAME`` at a time.

No document is dropped or repeated. When a source ends, its later blocks are no longer there and the others keep to their
windows, so they keep their proportions.
Running totals inside a source are cut into as many hash ranges as the root of the row count, so a source that holds a
third of all rows is spread over tasks, and so few ranges that adding them up stays small. A null source is a source of its own; a null or empty text takes no room; rows that
repeat are laid one after the other. Other columns are passed over.
"""

from __future__ import annotations

import heapq
import itertools
import math

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.frames import table, written
from folioflow.llm.registry import query

BLOCK = 65_536
#: Shares in a repeating frame.
SHARES = 1_000
#: Placed blocks that the driver holds at a time.
FRAME = 500_000


def shares_of(weights: dict, shares: int = SHARES) -> dict:
    """Whole shares, at least one each, by largest remainder; weights of zero or less raise an error."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total, shares = sum(weights.values()), max(shares, len(weights))
    spare = shares - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (math.floor(exact[s]) - exact[s], s is not None, str(s)))
    for s in order[: shares - sum(out.values())]:
        out[s] += 1
    return out


def exact_weights(weights: dict) -> dict:
    """Whole numbers in the exact proportion of the weights; weights of zero or less raise an error."""
    exact = {s: Fraction(w) if isinstance(w, (int, Fraction)) else Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, k, release, deadline, slot) of every block by slot: earliest deadline first over the released blocks.

    ``weights`` are whole numbers, ``blocks`` the number of blocks of each source.
    """
    size = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is not None, str(s)))
    share = [weights[s] for s in names]
    end = [blocks[s] for s in names]
    waiting = [(0, -(-size // w), i, 0) for i, w in enumerate(share) if end[i] > 0]
    ready: list[tuple[int, int, int, int]] = []
    heapq.heapify(waiting)
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k, release))
        due, i, k, release = heapq.heappop(ready)
        yield names[i], k, release, due, slot
        slot, k = slot + 1, k + 1
        if k < end[i]:
            heapq.heappush(waiting, (k * size // share[i], -(-(k + 1) * size // share[i]), i, k))


def frame(shares: dict) -> list[tuple]:
    """(source, k, slot) of a repeating frame: each source has as many blocks as whole shares."""
    return [(s, k, slot) for s, k, _, _, slot in schedule(shares, shares)]


def place(docs: DataFrame, n_rows: int, block: int = BLOCK) -> DataFrame:
    """doc_id, source, chars and the offset of each document inside its source."""
    ranges = max(1, math.isqrt(n_rows))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        F.xxhash64(F.col("doc_id"), F.lit("mix")).alias("_order"),
        F.xxhash64("text").alias("_tie"),
    )
    rows = rows.withColumn("_range", F.pmod(F.shiftrightunsigned("_order", 16), F.lit(ranges)))
    rows = written(rows, "mix")
    sums = rows.groupBy("source", "_range").agg(F.sum("chars").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), before.alias("_before")), "starts")
    inside = Window.partitionBy("source", "_range").orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    rows = rows.join(starts, rows.source.eqNullSafe(starts._s) & (rows._range == starts._r))
    return rows.select("doc_id", "source", "chars", "_tie", (F.col("_before") + F.col("_inside")).alias("offset"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, chars, offset, block, release, deadline and slot of every row.

    ``weights`` maps sources to positive numbers; sources it leaves out raise an error. By default a source weighs the
    square root of its size, which lifts small sources.
    """
    spark = docs.sparkSession
    placed = written(place(docs, docs.count(), block).withColumn("block", F.expr(f"offset div {block}")), "placed")
    sizes = {r.source: r for r in placed.groupBy("source").agg(F.sum("chars").alias("chars"), F.max("block").alias("last")).collect()}
    if weights is None:
        weights = {s: math.sqrt(r.chars + 1) for s, r in sizes.items()}
    elif missing := set(sizes) - set(weights):
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    # The rest of a long last document takes blocks that no document starts in.
    blocks = {s: max(r.last + 1, -(-r.chars // block)) for s, r in sizes.items()}
    slots = _slots(spark, schedule(exact_weights({s: weights[s] for s in sizes}), blocks))
    rows = placed.join(slots, placed.source.eqNullSafe(slots._s) & (placed.block == slots._k))
    return rows.select("doc_id", "source", "chars", "offset", "block", "release", "deadline", "slot", "_tie")


def _slots(spark: SparkSession, placed: Iterator[tuple]) -> DataFrame:
    """The scheduled blocks as a table on the shared folder."""
    names, kinds = ["_s", "_k", "release", "deadline", "slot"], [pa.string(), *[pa.int64()] * 4]
    out = spark.createDataFrame([], "_s string, _k long, release long, deadline long, slot long")
    while part := list(itertools.islice(placed, FRAME)):
        rows = pa.table([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)
        out = out.unionByName(written(spark.createDataFrame(rows), "slots"))
    return out


def scheduled(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The same documents with mix_block, mix_slot and mix_offset, the place of each in the schedule.

    Rows with the same doc_id and text get the places of their copies in any order, one each.
    """
    names = ["mix_block", "mix_slot", "mix_offset"]
    docs = docs.drop(*names)
    nth = F.row_number().over(Window.partitionBy("doc_id", "_s", "_t").orderBy("offset"))
    keys = mix(docs, weights).withColumnsRenamed({"source": "_s", "_tie": "_t"}).withColumn("_n", nth)
    keys = keys.select(F.col("doc_id").alias("_id"), "_s", "_t", "_n", *(F.col(n[4:]).alias(n) for n in names))
    columns = docs.columns
    inner = docs.toDF(*(f"in_{k}" for k in range(len(columns))))
    number, text, source = (F.col(f"in_{columns.index(c)}") for c in ("doc_id", "text", "source"))
    inner = inner.withColumns({"_h": F.xxhash64(text), "_c": source.cast("string")})
    inner = inner.withColumn("_m", F.row_number().over(Window.partitionBy(number, "_c", "_h").orderBy("_h")))
    rows = inner.join(keys, number.eqNullSafe(F.col("_id")) & F.col("_c").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_t")) & (F.col("_m") == F.col("_n")))
    return rows.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(columns)), *names)


def stage(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The same documents in the order of the schedule: rows of earlier slots stand in earlier files."""
    rows = scheduled(docs, weights)
    return rows.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset").select(*docs.columns)


@query("op5_pfair_mix")
def op5(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("_tie")

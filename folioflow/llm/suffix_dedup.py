"""Removal of repeated byte strings by two-stage suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in the same text or another, is
removed. Equal strings of that length hold the same smallest ``K``-byte k-mer at the same place, so texts are cut into
segments of windows that share their smallest k-mer (the anchor). A window can only repeat in a segment with the same
anchor: segments whose anchor occurs once are dropped before any text moves, equal segments are counted instead
of sent, and the distinct ones of an anchor meet in one task.

There their suffixes are sorted in two stages: only suffixes smaller than their successors are sorted directly, the others
follow by scanning the buckets of first bytes from small to large, and then the common prefixes of neighbours are
compared. A window repeats if a neighbour shares ``LENGTH`` bytes or its segment occurs more than once. An anchor with more
than ``HOT`` distinct segments (the edge of a passage that very many texts share) is no single task's work: its
windows are counted one by one by a 128-bit digest instead, spread over all tasks.

A null text is an empty one and has nothing to remove. Rows are told apart by doc_id and a hash of the text; rows that
repeat in full are copies of each other and lose their repeats alike. A null doc_id is a value. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import kernel
from folioflow.llm.frames import keyed, packed, table, written
from folioflow.llm.registry import query

LENGTH = 200
K = 32
#: Distinct segments of one anchor that one task sorts: seven megabytes at most.
HOT = 20_000
#: Bytes of segments sorted at a time; texts longer than a piece are cut into overlapping pieces.
CHUNK = 400_000
PIECE = 4_000_000

_PLACE = np.uint64((1 << 24) - 1)


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, anchor and digest of every segment; starts count inside the text."""
    none = np.zeros(0, np.int64)
    m = len(raw) - K + 1
    if len(raw) < length:
        return none, none, none, none, none
    power, inverse = kernel.power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(kernel.BYTE_CODE[raw] * power[: len(raw)], out=sums[1:])
        code = kernel.mix((sums[K:] - sums[:m]) * inverse[:m])
    rank = (code & ~_PLACE) | np.arange(m, dtype=np.uint64)
    anchor = (kernel.sliding_min(rank, length - K + 1) & _PLACE).astype(np.int64)
    n = len(anchor)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = of[:n] == of[length - 1 : length - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (of[1:n] != of[: n - 1])
    first = np.flatnonzero(new & valid)
    if not len(first):
        return none, none, none, none, none
    edge = np.append(np.flatnonzero(new | ~valid), n)
    count = edge[np.searchsorted(edge, first, "right")] - first
    ends = first + count + length - 1
    with np.errstate(over="ignore"):
        digest = kernel.mix((sums[ends] - sums[first]) * inverse[first] + (anchor[first] - first).astype(np.uint64))
    text = of[first]
    return text, first - offsets[text], count, code[anchor[first]].view(np.int64), digest.view(np.int64)


def suffix_order(parts: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all parts in the order of their first ``depth`` bytes, as places in the joined text.

    Parts are joined with a separator after each, which is smaller than any byte and different for each part. Returns the
    order, the joined text with bytes raised by one, and the end of the part that each place lies in.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(sizes) - 1
    joined = b"\0".join(parts) + b"\0"
    x = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    x[ends] = 0
    end_of = np.repeat(ends, sizes)
    n = len(x)
    # A run of equal bytes is smaller than its successors if the byte after it is greater. A part ends with a descent.
    change = np.flatnonzero(np.append(x[1:] != x[:-1], True) | (x == 0))
    following = np.append(x[1:], 0)[change]
    smaller = np.repeat(following > x[change], np.diff(np.append(-1, change)))
    smaller[ends] = True
    direct = np.flatnonzero(smaller & (x > 0))
    # Sorted two bytes at a time, so that only the suffixes with the same beginning are held as keys.
    pair = x[direct].astype(np.int32) * 257 + x[np.minimum(direct + 1, n - 1)]
    by = np.argsort(pair, kind="stable")
    direct, pair = direct[by], pair[by]
    cuts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])).tolist() if len(pair) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(pair)]):
        if hi - lo > 1:
            own = direct[lo:hi]
            until = np.minimum(own + depth, end_of[own]).tolist()
            keys = [joined[i:j] for i, j in zip(own.tolist(), until)]
            direct[lo:hi] = own[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    size = np.bincount(x, minlength=257)
    tail = np.cumsum(size)
    head = tail - size
    first_byte = x[direct]
    cuts = np.searchsorted(first_byte, np.arange(258))
    order = np.empty(n, np.int64)
    order[: len(ends)] = ends
    fill = head.copy()
    fill[0] = tail[0]

    def induce(done: np.ndarray, c: int) -> None:
        """Put the predecessors of finished suffixes of bucket c at the heads of the greater buckets."""
        before = done[done > 0] - 1
        greater = before[x[before] > c]
        if not len(greater):
            return
        letters = x[greater]
        by = np.argsort(letters, kind="stable")
        greater, letters = greater[by], letters[by]
        start = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
        counts = np.diff(np.append(start, len(letters)))
        rank = np.arange(len(letters)) - np.repeat(start, counts)
        order[fill[letters] + rank] = greater
        fill[letters[start]] += counts

    induce(ends, 0)
    for c in range(1, 257):
        if not size[c]:
            continue
        at = head[c]
        while at < fill[c]:  # larger than their successors: first those placed, then runs of the same byte
            done = order[at : fill[c]]
            at = fill[c]
            before = done[done > 0] - 1
            run = before[x[before] == c]
            order[at : at + len(run)] = run
            fill[c] = at + len(run)
        own = direct[cuts[c] : cuts[c + 1]]
        order[fill[c] : tail[c]] = own
        induce(order[head[c] : tail[c]], c)
    return order, x, end_of


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For every place of the joined parts: does a window of ``length`` bytes start there that starts elsewhere too?"""
    order, _, end_of = suffix_order(parts, length)
    joined = b"\0".join(parts) + b"\0" * (length + 8)
    words = np.lib.stride_tricks.as_strided(np.frombuffer(joined, np.uint8)[:8].view(np.uint64), (len(joined) - 7,), (1,))
    whole = end_of[order] - order >= length
    a, b = order[:-1], order[1:]
    alive = np.flatnonzero(whole[:-1] & whole[1:])
    for d in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[a[alive] + d] == words[b[alive] + d]]
    out = np.zeros(len(order), bool)
    out[a[alive]] = True
    out[b[alive]] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of whole texts; a text longer than a piece comes in pieces that overlap by a window less one byte."""
    for lo, hi in kernel.slices(offsets):
        size = int(offsets[hi] - offsets[lo])
        if hi - lo > 1 or size <= PIECE:
            yield lo, 0, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            continue
        for at in range(0, size - LENGTH + 1, PIECE - LENGTH + 1):
            part = raw[offsets[lo] + at : offsets[lo] + min(size, at + PIECE)]
            yield lo, at, part, np.array([0, len(part)])


def _segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = kernel.utf8(batch.column(2))
            for lo, at, part, places in _pieces(raw, offsets):
                text, first, count, anchor, digest = segments(part, places)
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(((first + at) << 16) | count), pa.array(anchor), pa.array(digest)],
                    names=["doc_id", "x", "place", "anchor", "digest"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, x int, place long, anchor long, digest long")


def _on_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_id", "x": "_x"})
    return left.join(right, left.doc_id.eqNullSafe(right._id) & left.x.eqNullSafe(right._x), how).drop("_id", "_x")


def _texts_of(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of one occurrence of every distinct segment."""
    wanted = distinct.select("row.doc_id", "row.x", F.struct("row.place", "anchor", "digest", "copies", "hot").alias("s"))
    wanted = wanted.groupBy("doc_id", "x").agg(F.collect_list("s").alias("wanted"))  # bounded by the text's length

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    names = ["anchor", "digest", "n", "copies", "hot", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                for text, found in zip(map(open_, part.column(0).to_pylist()), part.column(1).to_pylist()):
                    for s in found:
                        at, n = s["place"] >> 16, s["place"] & 0xFFFF
                        out.append((s["anchor"], s["digest"], n, s["copies"], s["hot"], text[at : at + n + LENGTH - 1]))
                    if len(out) >= 4000:
                        yield batch_of()
                        out.clear()
        if out:
            yield batch_of()

    rows = _on_document(packed(docs), wanted, "inner").select("packed", "wanted")
    return rows.mapInArrow(run, "anchor long, digest long, n int, copies long, hot boolean, bytes binary")


MARKS = "anchor long, digest long, n int, first int, run int"


def _sorted_marks(segs: DataFrame) -> DataFrame:
    """Repeated windows of the segments of ordinary anchors, by suffix sorting whole anchors a chunk at a time."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[4] for r in rows])
        out, at = [], 0
        for anchor, digest, n, copies, data in rows:
            own = flags[at : at + n]
            found = [(0, n)] if copies > 1 else _runs(own)
            out += [(anchor, digest, n, a, size) for a, size in found]
            at += len(data) + 1
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "digest", "n", "first", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield marks(held)

    rows = segs.filter("not hot").select("anchor", "digest", "n", "copies", "bytes")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(run, MARKS)


def _counted_marks(segs: DataFrame) -> DataFrame:
    """Repeated windows of hot anchors, by counting windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                n = part.column(2).to_numpy()
                index = np.repeat(np.arange(len(n)), n)
                first = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
                digests = [hashlib.blake2b(t[k : k + LENGTH], digest_size=16).digest() for t, m in zip(part.column(4).to_pylist(), n) for k in range(m)]
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                rows = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in range(4)), pa.array(first.astype(np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    names=["anchor", "digest", "n", "copies", "first", "w1", "w2"],
                )

    rows = segs.filter("hot").select("anchor", "digest", "n", "copies", "bytes")
    windows = rows.mapInArrow(run, "anchor long, digest long, n int, copies long, first int, w1 long, w2 long")
    often = written(windows.groupBy("w1", "w2").agg(F.sum("copies").alias("c")).filter("c > 1").drop("c"), "windows")
    return windows.join(often, ["w1", "w2"]).select("anchor", "digest", "n", "first", F.lit(1).alias("run"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, x and spans of every text that has repeats: sorted maximal runs (start, end) of bytes to remove."""
    rows = _segments(docs)
    shared = written(rows.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "anchors")
    found = written(rows.join(shared, "anchor"), "occurrences").withColumn("n", F.col("place").bitwiseAND(0xFFFF).cast("int"))
    distinct = found.groupBy("anchor", "digest", "n").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "x", "place")).alias("row"))
    distinct = written(distinct, "distinct")
    hot = written(distinct.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    distinct = distinct.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    segs = written(_texts_of(distinct, docs), "segments")
    marks = written(_sorted_marks(segs).unionByName(_counted_marks(segs)), "marks")
    covered = found.join(marks, ["anchor", "digest", "n"])
    start = F.shiftright("place", 16) + F.col("first")
    covered = covered.select("doc_id", "x", F.struct(start.alias("start"), (start + F.col("run") + (LENGTH - 1)).alias("end")).alias("span"))
    return covered.groupBy("doc_id", "x").agg(F.collect_set("span").alias("spans"))  # bounded by the text's length


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching runs joined."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end in bytes) and kept (the remaining bytes) of every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                sizes, spans, kept = [], [], []
                for packed, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text = open_(packed)
                    own = merged(found or [])
                    edges = [0, *(e for s in own for e in s), len(text)]
                    sizes.append(len(text))
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = _on_document(packed(docs), written(repeats(docs), "spans"), "left").select("doc_id", "packed", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

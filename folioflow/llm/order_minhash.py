"""Near duplicates by Order MinHash, verified by banded alignment.

Every text gets ``SKETCHES`` samples. A sample is the two smallest of its k-mers of ``K`` words under one of so many orders,
each k-mer labelled with its occurrence, kept in text order. The second k-mer lies at least a third of the text away from
the first, so a passage that unrelated texts share does not make them meet. Texts with a sample in common are candidates.
A candidate pair is a link if the edit similarity of its words, 1 - distance / longer length, is 0.8 or more; the
distance comes from a bit-parallel alignment inside the band that this bound allows. The k-mers only find candidates; they are
shorter than five words because edits at every fifth word, which that similarity allows, leave no five-word k-mer whole.

Texts with the same words (lower-cased in A-Z) are one node from the start. In a bucket every node is compared with a pivot,
the bucket's first node, so a group of near copies costs one comparison each. The nodes of a bucket that are not linked to its
pivot all meet each other, but those that the links make one class. Edit distance is a metric, so a node that is farther from the pivot than
two links reach cannot be linked to a node that is linked to the pivot; a node in between can be, and meets the nodes linked
to that pivot that the two distances allow. Where nodes meet, the words that two texts have in common are counted: a link leaves four fifths of the
longer text's words, each as often as it occurs in both. Pairs that have them are compared, the others cannot be links. The words are counted for tiles
of at most ``TILE`` by ``TILE`` nodes, so memory and tasks are bounded, a group of n nodes makes n * n / ``TILE`` rows, and pairs become rows only if they may be links.

A pair whose labelled k-mers have Jaccard similarity J meets with probability about 1 - (1 - J^2)^64: 0.98 at 0.25, which is
the least that an edit similarity of 0.8 by substitutions leaves. Null and empty texts are one class of texts without words;
texts under ``K`` words have one k-mer. Rows that repeat fall into one class; of a class the row with the smallest doc_id
stays, and null is the smallest. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import kernel
from folioflow.llm.components import components
from folioflow.llm.frames import table, written
from folioflow.llm.registry import query

K = 3
SKETCHES = 64
SIMILAR = 0.8
#: Nodes, and words of them, on each side of a tile in which all are held against all; groups of one tile share tasks of this size.
TILE = 512
TILE_WORDS = 400_000
#: Bytes of text that are sampled at once: the arrays stay in a core's cache, and memory follows them, not the batch.
SLICE = 250_000

_rng = np.random.Generator(np.random.PCG64(7))
_ORDERS = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)
_FAR = np.uint64(2**64 - 1)


def kmers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their texts; k-mer hashes with their occurrence labels, and their texts."""
    starts, ends, owner = kernel.words(raw, offsets)
    word = kernel.span_hashes(kernel.LOWER[raw], starts, ends)
    codes, at = kernel.windows(word, owner, K)
    of = owner[at]
    n = len(offsets) - 1
    count = kernel.count_by(owner, n)
    short = np.flatnonzero((count > 0) & (count < K))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(K - 1):
                live = count[short] > j
                whole[live] = whole[live] * np.uint64(0x9E3779B97F4A7C15) + word[first[short[live]] + j]
        codes, of = np.concatenate([codes, kernel.mix(whole)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        codes, of = codes[order], of[order]
    order = np.lexsort((codes, of))
    c, o = codes[order], of[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    group = np.flatnonzero(new)
    nth = np.empty(len(c), np.uint64)
    nth[order] = np.arange(len(c)) - np.repeat(group, np.diff(np.append(group, len(c))))
    with np.errstate(over="ignore"):
        codes = np.where(nth > 0, kernel.mix(codes + nth * np.uint64(0xD6E8FEB86659FD93)), codes)
    return word, owner, codes, of


def sketches(codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The samples of each text, one row per text; texts without k-mers have zeros."""
    out = np.zeros((n, SKETCHES), np.uint64)
    if not len(codes):
        return out
    has, first, size = np.unique(of, return_index=True, return_counts=True)
    local = np.arange(len(codes), dtype=np.uint64) & _PLACE
    away, end = np.maximum(size // 3, 1), first + size
    rank = np.empty(len(codes) + 1, np.uint64)
    rank[-1] = _FAR
    cuts = np.empty((len(first), 3), np.int64)
    cuts[:, 0] = first
    with np.errstate(over="ignore"):
        for k, order in enumerate(_ORDERS):
            np.multiply(codes, order, out=rank[:-1])
            rank[:-1] &= ~_PLACE
            rank[:-1] |= local
            p = first + ((np.minimum.reduceat(rank, first) & _PLACE).astype(np.int64) - first) % (1 << 24)
            # The least before and the least behind the words that are too near; an empty range gives a neighbour's rank.
            cuts[:, 1], cuts[:, 2] = np.maximum(p - away + 1, first), np.minimum(p + away, end)
            least = np.minimum.reduceat(rank, cuts.ravel()).reshape(-1, 3)
            before = np.where(cuts[:, 1] > first, least[:, 0], _FAR)
            behind = np.where(cuts[:, 2] < end, least[:, 2], _FAR)
            least = np.minimum(before, behind)
            q = np.where(least == _FAR, p, first + ((least & _PLACE).astype(np.int64) - first) % (1 << 24))
            lo, hi = np.minimum(p, q), np.maximum(p, q)
            out[has, k] = kernel.mix(codes[lo] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[hi] + np.uint64(k))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, x (a hash that tells texts of one doc_id apart), t1, t2, n_words and samples of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = kernel.utf8(batch.column(2))
            for lo, hi in kernel.slices(offsets, SLICE):
                at = offsets[lo : hi + 1] - offsets[lo]
                word, owner, codes, of = kmers(raw[offsets[lo] : offsets[hi]], at)
                t1, t2 = kernel.identity(word, owner, hi - lo)
                flat = sketches(codes, of, hi - lo).view(np.int64).ravel()
                ends = pa.array(np.arange(0, (hi - lo + 1) * SKETCHES, SKETCHES), pa.int32())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(t1), pa.array(t2), pa.array(kernel.count_by(owner, hi - lo)), pa.ListArray.from_arrays(ends, pa.array(flat))],
                    names=["doc_id", "x", "t1", "t2", "n_words", "samples"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("x"), "text")
    return rows.mapInArrow(run, "doc_id long, x long, t1 long, t2 long, n_words long, samples array<long>")


def banded(a: list[int], b: list[int], most: int) -> int:
    """The edit distance of two sequences, or ``most + 1`` if it is larger; bit-parallel inside the band of ``most``."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < end - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    match: dict[int, int] = {}
    for i, w in enumerate(a):
        match[w] = match.get(w, 0) | 1 << i
    get = match.get
    if most >= n:  # the band would cover everything
        full, top = (1 << n) - 1, 1 << (n - 1)
        vp, vn, score = full, 0, n
        for w in b:
            x = get(w, 0) | vn
            d0 = ((((x & vp) + vp) ^ vp) | x) & full
            hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
            score += 1 if hp & top else -1 if hn & top else 0
            hp, hn = (hp << 1 | 1) & full, hn << 1 & full
            vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        return min(score, most + 1)
    # Bit k of the vectors is row j - most + k of column j; the score runs down the lowest diagonal, then along the last row.
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, score = full & ~((1 << most) - 1), 0, most
    slack = most + (m - (n - most)) if n - most < m else most
    for j in range(1, m + 1):
        bits, shift = get(b[j - 1], 0), j - most - 1
        x = (bits >> shift if shift >= 0 else bits << -shift) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + most <= n:
            if not d0 & top:
                score += 1
                if score > slack + most:
                    return most + 1
        else:
            bit = 1 << (n - j + most)
            score += 1 if hp & bit else -1 if hn & bit else 0
        d0 >>= 1
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
    return min(score, most + 1)


def _hashes(column: pa.Array) -> list[np.ndarray]:
    """The word hashes of every text."""
    raw, offsets = kernel.utf8(column)
    out: list[np.ndarray] = []
    for lo, hi in kernel.slices(offsets, SLICE):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, owner = kernel.words(part, offsets[lo : hi + 1] - offsets[lo])
        hashes = kernel.span_hashes(kernel.LOWER[part], starts, ends)
        cut = np.searchsorted(owner, np.arange(hi - lo + 1))
        out += [hashes[x:y] for x, y in zip(cut[:-1], cut[1:])]
    return out


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, their distance d, the words n of b, and how far the pair is: 'link', 'between' or 'far'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                far, kind, size = [], [], []
                for u, v in zip(_hashes(part.column(2)), _hashes(part.column(3))):
                    longer = max(len(u), len(v))
                    # A node linked to u is at most a quarter longer; two links reach this far.
                    reach = int(0.25 * len(u) + 0.2 * max(1.25 * len(u), len(v))) + 1
                    d = banded(u.tolist(), v.tolist(), reach)
                    far.append(d)
                    size.append(len(v))
                    kind.append("link" if d <= (1 - SIMILAR) * longer + 1e-9 else "between" if d <= reach else "far")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(far, pa.int64()), pa.array(size, pa.int64()), pa.array(kind, pa.string())], names=["a", "b", "d", "n", "kind"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_u"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_v"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "_u", "_v")
    return written(rows.mapInArrow(run, "a long, b long, d long, n long, kind string"), "verified")


def _meetings(against: DataFrame, checked: DataFrame, roots: DataFrame) -> DataFrame:
    """Which nodes meet after the pivots: place (a bucket, or a pivot if ``around``), node, root, open and d.

    The open nodes of a bucket meet each other. The open nodes of a pivot, those in between, meet the nodes linked to it; d is
    the distance to the pivot. Places whose nodes are all of one class are left out.
    """
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    rest = against.join(checked.filter("kind <> 'link'").select("a", "b"), ["a", "b"]).join(of("b"), "b", "left")
    rest = rest.select(F.lit(False).alias("around"), F.col("bucket").alias("place"), F.col("b").alias("node"), F.coalesce("_b", "b").alias("root"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("d"))
    between = checked.filter("kind = 'between'").join(of("a"), "a").join(of("b"), "b", "left").withColumn("_b", F.coalesce("_b", "b")).filter("_a <> _b")
    between = written(between.select("a", "b", "_b", "d", "n"), "between")
    # A node linked to one of n words has 1.25 n at most, so its distance to the pivot is less by a quarter of n at most.
    least = between.groupBy("a").agg(F.min(F.col("d") - 0.25 * F.col("n")).alias("_least"))
    linked = checked.filter("kind = 'link'").join(least, "a").filter(F.col("d") >= F.col("_least") - 1e-6).join(of("a"), "a")
    side = lambda rows, root, free: rows.select(F.lit(True).alias("around"), F.col("a").alias("place"), F.col("b").alias("node"), F.col(root).alias("root"), F.lit(free).alias("open"), "d")
    rows = written(rest.unionByName(side(between, "_b", True)).unionByName(side(linked, "_a", False)), "meetings")
    several = rows.groupBy("around", "place").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.min("open").alias("_held"))
    several = several.filter("_r < _s and (not around or not _held)")
    return rows.join(several.select("around", "place"), ["around", "place"])


def _likely(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a < b of nodes of two classes that meet and have as many words in common as a link needs."""
    rows = written(rows.join(nodes.select("node", F.col("n_words").alias("n")), "node"), "meetings")
    part = lambda flag, value: F.sum(F.when(F.col("open") == flag, F.col(value)).otherwise(0))
    one = F.lit(1).alias("_one")
    sizes = rows.select("*", one).groupBy("around", "place").agg(part(True, "_one").alias("k"), part(True, "n").alias("w"), part(False, "_one").alias("l"), part(False, "n").alias("v"))
    tiles = lambda k, w: F.ceil(F.greatest(F.col(k) / TILE, F.col(w) / TILE_WORDS)).cast("int")
    whole = (F.col("k") + F.col("l") <= TILE) & (F.col("w") + F.col("v") <= TILE_WORDS)
    sizes = written(sizes.select("around", "place", "k", "l", "w", "v", tiles("k", "w").alias("free"), tiles("l", "v").alias("held"), whole.alias("whole")), "sizes")
    small = sizes.filter("whole").agg(F.sum(F.greatest((F.col("k") + F.col("l")) / TILE, (F.col("w") + F.col("v")) / TILE_WORDS))).first()[0] or 0
    bins = int(small) + 1
    rows = rows.join(sizes.drop("k", "l", "w", "v"), ["around", "place"])
    own = F.when(F.col("open"), F.pmod(F.xxhash64("node"), "free")).otherwise(F.col("free") + F.pmod(F.xxhash64("node"), "held")).cast("int")
    rows = rows.withColumn("tile", F.when(F.col("whole"), F.lit(-1)).otherwise(own))
    # Open nodes meet all of a bucket and the held ones of a pivot; held ones meet the open ones.
    others = F.when(F.col("whole"), F.array(F.lit(-1))).when(F.col("open") & F.col("around"), F.sequence(F.col("free"), F.col("free") + F.col("held") - 1))
    others = others.otherwise(F.sequence(F.lit(0), F.col("free") - 1))
    what = F.struct("around", "place", "root", "open", "d", "n", "tile", others.alias("others"))
    lists = rows.groupBy("node").agg(F.collect_list(what).alias("all"))  # bounded by the samples of a text and its pivots

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                for node, found, hashes in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _hashes(part.column(2))):
                    code = (hashes >> np.uint64(48)).astype(np.uint16).tobytes()
                    out = [(m["around"], m["place"], node, m["root"], m["open"], m["d"], m["n"], m["tile"], min(m["tile"], t), max(m["tile"], t)) for m in found for t in m["others"]]
                    step = max(1, 4_000_000 // max(len(code), 1))
                    for at in range(0, len(out), step):
                        columns = [pa.array(c, k) for c, k in zip(zip(*out[at : at + step]), kinds)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([code] * len(columns[0]), pa.binary())], names=names)

    def meet(rows: pa.Table) -> pa.Table:
        around, place, node, root, free, d, n, tile = (rows.column(c).to_numpy() for c in names[:8])
        low, words = rows.column("i").to_numpy(), rows.column("words").to_pylist()
        order = np.lexsort((place, around))
        new = np.ones(len(order), bool)
        new[1:] = (place[order][1:] != place[order][:-1]) | (around[order][1:] != around[order][:-1])
        found = []
        for group in np.split(order, np.flatnonzero(new)[1:]):
            side = free[group] & (tile[group] == low[group])
            left = np.flatnonzero(side)
            if around[group[0]]:
                right = np.flatnonzero(~free[group])
            else:
                right = left if side.all() else np.flatnonzero(~side)
            if not len(left) or not len(right):
                continue
            a, b = group[left], group[right]
            longer = np.maximum(n[a][:, None], n[b])
            near = kernel.shared_words([words[k] for k in group], left, right) >= SIMILAR * longer - 1e-3
            near &= root[a][:, None] != root[b]
            if around[group[0]]:
                near &= d[b] >= d[a][:, None] - (1 - SIMILAR) * longer - 1e-9
            x, y = np.nonzero(near)
            found.append(np.stack([node[a[x]], node[b[y]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    names = ["around", "place", "node", "root", "open", "d", "n", "tile", "i", "j", "words"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    schema = "around boolean, place long, node long, root long, open boolean, d long, n long, tile int, i int, j int, words binary"
    rows = lists.join(texts, "node").select("node", "all", "text").mapInArrow(spread, schema)
    # Groups of one tile share tasks' worth of rows.
    rows = rows.withColumn("g", F.when(F.col("i") < 0, F.pmod(F.xxhash64("place", "around"), F.lit(bins))).otherwise(F.xxhash64("place", "around")))
    found = rows.groupBy("g", "i", "j").applyInArrow(lambda t: meet(t.select(names)), "a long, b long")
    return found.filter("a < b").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, x, class_id (the smallest doc_id of the class), class_size and kept for every row."""
    rows = written(_rows(docs), "samples")
    nodes = rows.groupBy("t1", "t2").agg(
        F.min(F.struct("doc_id", "x")).alias("row"), F.count("*").alias("size"), F.first("samples").alias("samples"), F.max("n_words").alias("n_words")
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.filter("n_words > 0").select("node", F.explode(F.array_distinct("samples")).alias("bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "buckets")
    members = written(members.join(shared, "bucket"), "members")
    used = members.select("node").distinct().join(nodes.select("node", "row.doc_id", "row.x"), "node")
    used = used.select("node", F.col("doc_id").alias("_id"), F.col("x").alias("_x"))
    plain = docs.select(F.col("doc_id").cast("long"), "text").withColumn("x", F.xxhash64("text"))
    texts = plain.join(used, plain.doc_id.eqNullSafe(used._id) & (plain.x == used._x)).select("node", "text")
    if not rows.groupBy("doc_id", "x").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    texts = written(texts, "texts")
    pivots = members.groupBy("bucket").agg(F.min("node").alias("a"))
    against = written(members.join(pivots, "bucket").filter("a < node").select("bucket", "a", F.col("node").alias("b")), "against")
    labelled = nodes.select("node", "t1", "t2", "size", F.col("row.doc_id").alias("first_id"))
    if not against.isEmpty():
        checked = _verify(against.select("a", "b").distinct(), texts)
        roots = written(components(checked.filter("kind = 'link'").select("a", "b")), "roots")
        likely = written(_likely(_meetings(against, checked, roots), nodes, texts), "likely")
        more = _verify(likely, texts).filter("kind = 'link'").select("a", "b")
        if not more.isEmpty():
            whole = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
            roots = written(components(whole), "roots")
        labelled = labelled.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        labelled = labelled.withColumn("root", F.col("node"))
    labelled = written(labelled, "labelled")
    best = F.min(F.struct(F.col("first_id"), F.col("node"))).alias("best")
    sizes = written(labelled.groupBy("root").agg(best, F.sum("size").alias("class_size")), "sizes")
    per_node = labelled.join(sizes, "root").select("t1", "t2", "node", "best", "class_size")
    out = rows.select("doc_id", "x", "t1", "t2").join(written(per_node, "per-node"), ["t1", "t2"])
    return out.select(
        "doc_id",
        "x",
        F.col("best.first_id").alias("class_id"),
        F.col("class_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.first_id")) & (F.col("node") == F.col("best.node"))).alias("kept"),
    )


def stage(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns it came with."""
    rows = written(classes(docs), "classes").filter("kept").groupBy("doc_id", "x").agg(F.count("*").alias("n"))
    keys = written(rows.select(F.col("doc_id").alias("_id"), F.col("x").alias("_x"), "n"), "kept")
    out = docs.join(keys, docs.doc_id.cast("long").eqNullSafe(keys._id) & (F.xxhash64(docs.text) == keys._x), "left_semi")
    if not keys.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.select(*docs.columns)


@query("op9_order_minhash")
def op9(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).drop("x")

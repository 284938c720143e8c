"""Two tokenizers aligned byte by byte, with corpus-wide counts of the id pairs that overlap.

Every text is encoded by a byte-level BPE (A, of blank and text) and by a SentencePiece BPE (B, which adds the blank).
Both cut the same bytes, so a link, an A and a B token that overlap, is a stretch between two neighbouring ends of either,
and bytes where both end cut the text into groups.

Counts: distinct pairs of ids are sharded by a hash, and each shard gets a minimal perfect hash: levels of bits, a key has the
first level in which no other key meets it, and its index is the number of bits before its own. Tasks count links into
dense vectors at these indexes, vectors are added up in a tree, and the key stored at an index tells whether a pair is
the one that was meant. A second pass over the encoded texts aligns them again and looks the counts up. The index that a pass sends
to its tasks holds at most ``block`` pairs (13 bytes each); with more pairs there are more passes, whose sums are added.

Texts that are null or empty, or whose tokens do not join to blank and text, have no tokens, no groups and no links.
Rows that repeat are documents of their own and count each. Only doc_id and text are used, of any other columns.
An empty table gives no row. A text is encoded whole; nothing else is held whole in a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.byte_bpe import byte_letters
from folioflow.llm.frames import table, written
from folioflow.llm.kernel import mix
from folioflow.llm.registry import query

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of an index that is sent to the tasks; pairs of a shard; bytes of all vectors at the leaves of the tree of sums,
#: beyond which there are only as many leaves as cores; most leaves; vectors added in one step.
BLOCK, SHARD, VECTORS, LEAVES, FAN = 8_000_000, 32_768, 8_000_000_000, 4_096, 16
#: Bits of a level for each of its keys. Units of text that a worker remembers. Bytes of text aligned at once.
ROOM, REMEMBERED, SLICE = 2, 400_000, 2_000_000
UNIT = re.compile(r" *[^ \n]+|\n| +")
IDS = "row long, doc_id long, a binary, b binary"
RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---- tokens


class ByteLevel:
    """The byte-level BPE of a tokenizer file, by tiktoken from the file's own vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if any(vocab[m.replace(" ", "")] != 256 + n for n, m in enumerate(merges)) or max(self.bytes) >= 1 << 16:
            raise ValueError("ids must be the ranks of the merges, below 65536")
        ranks = {t: i for i, t in self.bytes.items()}
        self._encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """Ids as two bytes each."""
        return array("H", self._encode(" " + text)).tobytes()


class Pieces:
    """A SentencePiece BPE. No piece holds a line feed or a blank behind another sign, so texts are encoded unit by unit:
    a line feed, or blanks with the word they lead to. Units that were met before are remembered."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        plain = [not self.model.is_byte(i) and not self.model.is_control(i) for i in range(n)]
        if n >= 1 << 16 or any(p and ("\n" in t or "▁" in t.lstrip("▁")) for p, t in zip(plain, names)):
            raise ValueError("pieces must not reach over units, and there must be fewer than 65536")
        self.bytes = {i: bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)}
        self.known: dict[str, bytes | None] = {}
        self.lead = self.model.encode("\n")

    def _learn(self, units: list[str]) -> None:
        # Behind a line feed a unit stands as it does inside a text, without the blank that the model adds at the front.
        for unit, ids in zip(units, self.model.encode(["\n" + u for u in units], num_threads=1)):
            ids = ids[len(self.lead) :]
            same = b"".join(map(self.bytes.__getitem__, ids)) == unit.encode()
            self.known[unit] = array("H", ids).tobytes() if same else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as two bytes each; none where they do not join to the text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        units = [UNIT.findall(" " + t) for t in texts]
        new = list(set().union(*units).difference(self.known))
        for lo in range(0, len(new), 20_000):
            self._learn(new[lo : lo + 20_000])
        out = []
        for own in units:
            ids = [self.known[u] for u in own]
            out.append(b"" if None in ids else b"".join(ids))
        return out


class Tokens(NamedTuple):
    """Both tokenizers of a worker, and the bytes of each id."""

    a: ByteLevel
    b: Pieces
    a_size: np.ndarray
    b_size: np.ndarray


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens_of(paths: tuple[str, str]) -> Tokens:
    """Loaded once for each Python worker."""
    if paths not in _tokens:
        a, b = ByteLevel(paths[0]), Pieces(paths[1])
        sizes = []
        for one in (a, b):
            size = np.zeros(1 << 16, np.int64)
            for i, t in one.bytes.items():
                size[i] = len(t)
            sizes.append(size)
        _tokens[paths] = Tokens(a, b, *sizes)
    return _tokens[paths]


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def encode(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """row (a number for each input row), doc_id, a and b: the ids of both tokenizers, two bytes each."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens_of(paths)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(2).to_pylist()]
                b = [x if t else b"" for x, t in zip(t.b.encode(texts), texts)]
                a = [t.a.encode(x) if ids else b"" for x, ids in zip(texts, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, IDS)


# ---- alignment


class Aligned(NamedTuple):
    """Some documents: ids of all tokens, ids at both ends of each link, and where each document's parts end."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray  # tokens of A up to the end of each group
    group_b: np.ndarray
    a_ends: np.ndarray  # for each document, tokens, groups and links up to its end
    b_ends: np.ndarray
    groups: np.ndarray
    links: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return self.link_a.astype(np.uint64) << np.uint64(16) | self.link_b


def align(a_ids: list[bytes], b_ids: list[bytes], t: Tokens) -> Aligned:
    a, b = np.frombuffer(b"".join(a_ids), np.uint16), np.frombuffer(b"".join(b_ids), np.uint16)
    a_to, b_to = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    n = int(a_to[-1]) if len(a) else 0
    a_end, b_end = np.zeros(n, bool), np.zeros(n, bool)
    a_end[a_to - 1] = True
    b_end[b_to - 1] = True
    ends = np.flatnonzero(a_end | b_end)
    in_a, in_b = a_end[ends], b_end[ends]
    # A link belongs to the tokens that hold the byte before its end.
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    both = np.flatnonzero(in_a & in_b)
    a_ends, b_ends = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) // 2 for x in (a_ids, b_ids))
    doc_to = np.concatenate([[0], a_to])[a_ends]
    links = np.searchsorted(ends, doc_to, "left")
    return Aligned(a, b, a[at_a], b[at_b], at_a[both] + 1, at_b[both] + 1, a_ends, b_ends, np.searchsorted(both, links, "left"), links)


def spelled(x: Aligned, names: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2`` for each document; ``names`` has each id before , | , and ;"""
    size_a, size_b = np.diff(x.group_a, prepend=0), np.diff(x.group_b, prepend=0)
    code_a, code_b = x.a.astype(np.int64), x.b.astype(np.int64) + (2 << 16)
    code_a[x.group_a - 1] += 1 << 16
    code_b[x.group_b - 1] += 1 << 16
    order = np.empty(len(x.a) + len(x.b), np.int64)
    order[np.arange(len(x.a)) + np.repeat(x.group_b - size_b, size_a)] = code_a
    order[np.arange(len(x.b)) + np.repeat(x.group_a, size_b)] = code_b
    out, lo, name = [], 0, names.__getitem__
    for hi in (x.a_ends + x.b_ends).tolist():
        out.append("".join(map(name, order[lo:hi].tolist()))[:-1])
        lo = hi
    return out


def spellings() -> list[str]:
    return [f"{i}{mark}" for mark in ",|,;" for i in range(1 << 16)]


def _slices(batches: Iterator[pa.RecordBatch], t: Tokens) -> Iterator[tuple[list[int], list[int], Aligned]]:
    """Rows and documents with their alignment, some megabytes of text at a time."""
    for batch in batches:
        rows, docs, a, b = (c.to_pylist() for c in batch.columns)
        lo, size = 0, 0
        for hi in range(1, len(rows) + 1):
            size += len(a[hi - 1])
            if size > SLICE // 2 or hi == len(rows):
                yield rows[lo:hi], docs[lo:hi], align(a[lo:hi], b[lo:hi], t)
                lo, size = hi, 0


# ---- minimal perfect hash


def _shard_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0x51ED27))


def _place(keys: np.ndarray, level: int, room: np.ndarray) -> np.ndarray:
    """The place of each key in a level of ``room`` bits."""
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return ((mix(keys ^ seed) >> np.uint64(32)) * room.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def hash_levels(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of the levels of one shard, and its distinct keys in the order of their indexes."""
    levels, ordered, left = [], [], keys
    while len(left):
        room = max(64, ROOM * len(left))
        at = _place(left, len(levels), np.array(room))
        alone = np.bincount(at, minlength=room) == 1
        mine = alone[at]
        ordered.append(left[mine][np.argsort(at[mine])])
        levels.append(alone)
        left = left[~mine]
    return levels, np.concatenate(ordered) if ordered else keys


class PairIndex:
    """Minimal perfect hash of the pairs of one block: shards of levels, one run of bits."""

    def __init__(self, shards: list[tuple[int, list[int], bytes, bytes]], n_shards: int):
        """Rows of (shard, rooms of its levels, its packed bits, its keys), in the order of shards."""
        self.n_shards = n_shards
        depth = max([len(s[1]) for s in shards], default=0)
        self.room = np.zeros((n_shards, depth), np.int64)
        self.start = np.zeros((n_shards, depth), np.int64)
        bits, at = [], 0
        for shard, rooms, packed, _ in shards:
            self.room[shard, : len(rooms)] = rooms
            self.start[shard, : len(rooms)] = at + np.cumsum([0, *rooms[:-1]])
            at += sum(rooms)
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(rooms)))
        bits = np.concatenate([*bits, np.zeros(-at % 64 + 64, np.uint8)])
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.concatenate([np.frombuffer(s[3], np.uint32) for s in shards]) if shards else np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1 for a pair that is not in this block. The stored key decides."""
        out = np.full(len(keys), -1, np.int64)
        shard = (_shard_hash(keys) % np.uint64(max(1, self.n_shards))).astype(np.int64)
        left = np.arange(len(keys))
        for level in range(self.room.shape[1]):
            room = self.room[:, level][shard]
            at = self.start[:, level][shard] + _place(keys, level, room)
            word = self.words[at >> 6]
            shift = (at & 63).astype(np.uint64)
            hit = ((word >> shift) & np.uint64(1)).astype(bool) & (room > 0)
            low = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            found = self.before[at[hit] >> 6] + np.bitwise_count(low)
            same = self.keys[found] == keys[hit]
            out[left[hit][same]] = found[same]
            stay = ~hit
            keys, shard, left = keys[stay], shard[stay], left[stay]
            if not len(left):
                break
        return out


def pairs(ids: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The distinct pairs that are linked anywhere (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for _, _, x in _slices(batches, tokens_of(paths)):
            new = np.setdiff1d(np.unique(x.keys), seen, assume_unique=True)
            # What this task has given already is not given again, as far as it is remembered.
            seen = np.union1d(seen, new) if len(seen) < 1_000_000 else new
            yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int64))], names=["key"])

    return ids.mapInArrow(run, "key long").distinct()


def index_shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """Rooms, bits and ordered keys of each shard (shard, rooms, bits, keys); shards are built in tasks of their own."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.uint64)
            shard = (_shard_hash(key) % np.uint64(n_shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard)], names=["key", "shard"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        levels, ordered = hash_levels(rows.column("key").to_numpy().astype(np.uint64))
        bits = np.packbits(np.concatenate(levels)).tobytes()
        columns = [[key[0].as_py()], [[len(x) for x in levels]], [bits], [ordered.astype(np.uint32).tobytes()]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "rooms", "bits", "keys"])

    named = keys.mapInArrow(name, "key long, shard long")
    return named.groupBy("shard").applyInArrow(build, "shard long, rooms array<long>, bits binary, keys binary")


def count_vectors(ids: DataFrame, shared, paths: tuple[str, str]) -> DataFrame:
    """Links of each pair (chunk, counts): the dense vector by index, in chunks of SHARD, added up in a tree."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sums = np.zeros(len(index.keys), np.int64)
        for _, _, x in _slices(batches, tokens_of(paths)):
            keys, n = np.unique(x.keys, return_counts=True)
            at = index.find(keys)
            sums[at[at >= 0]] += n[at >= 0]
        yield from chunks_of(sums, TaskContext.get().partitionId())

    def chunks_of(sums: np.ndarray, lane: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(sums), SHARD):
            columns = [pa.array([k // SHARD]), pa.array([lane]), pa.array([sums[k : k + SHARD].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "lane", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("counts"):
                more = np.frombuffer(part.as_buffer(), np.int64)
                total = more.copy() if total is None else total + more
        columns = [pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "lane", "counts"])

    schema = "chunk long, lane long, counts binary"
    cores = ids.sparkSession.sparkContext.defaultParallelism
    lanes = min(LEAVES, max(cores, VECTORS // (8 * max(1, len(shared.value.keys)))))
    sums = ids.coalesce(lanes).mapInArrow(leaf, schema)
    while lanes > 1:
        lanes = -(-lanes // FAN)
        sums = sums.withColumn("lane", F.floor(F.col("lane") / FAN)).groupBy("chunk", "lane").applyInArrow(add, schema)
    return sums.select("chunk", "counts")


# ---- both passes


class Counted(NamedTuple):
    """An index with the counts of its pairs and the highest count of each B id over all blocks."""

    index: PairIndex
    counts: np.ndarray
    best: np.ndarray


def _looked_up(ids: DataFrame, shared, first: bool, paths: tuple[str, str]) -> DataFrame:
    """Rows of RESULT with what the pairs of one block add; only with ``first`` the columns that need no counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counted = shared.value
        names = spellings() if first else []
        columns = [c.split(" ")[0] for c in RESULT.split(", ")]
        for rows, docs, x in _slices(batches, tokens_of(paths)):
            at = known.index.find(x.keys)
            here = at >= 0
            count = np.zeros(len(at), np.int64)
            count[here] = known.counts[at[here]]
            best = here & (count == known.best[x.link_b])

            def summed(v: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(v)])[x.links], prepend=0)

            sizes = [np.diff(v, prepend=0) if first else np.zeros(len(rows), np.int64) for v in (x.a_ends, x.b_ends, x.groups, x.links)]
            shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled(x, names)] if first else [None] * len(rows)
            arrays = [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), *map(pa.array, sizes), pa.array(summed(best)), pa.array(summed(count)), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return ids.mapInArrow(run, RESULT)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Every document with the columns of RESULT but ``row``."""
    paths = paths or default_paths()
    spark = docs.sparkSession
    ids = written(encode(docs, paths), "align-ids")
    keys = written(pairs(ids, paths), "align-pairs")
    blocks = max(1, -(-keys.count() // block))
    # A block is a range of hashes, so its share of the pairs is even.
    keys = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    found = []
    for k in range(blocks):
        mine = keys.filter(F.col("block") == k).select("key")
        n_shards = max(1, -(-mine.count() // SHARD))
        shards = [(r.shard, r.rooms, r.bits, r.keys) for r in written(index_shards(mine, n_shards), "align-index").orderBy("shard").collect()]
        index = PairIndex(shards, n_shards)
        shared = spark.sparkContext.broadcast(index)
        parts = written(count_vectors(ids, shared, paths), "align-counts").orderBy("chunk").collect()
        shared.unpersist()
        found.append((index, np.frombuffer(b"".join(r.counts for r in parts), np.int64)))
    best = np.zeros(1 << 16, np.int64)
    for index, counts in found:
        np.maximum.at(best, index.keys & np.uint32(0xFFFF), counts)
    rows = [_looked_up(ids, spark.sparkContext.broadcast(Counted(index, counts, best)), k == 0, paths) for k, (index, counts) in enumerate(found)]
    if blocks > 1:
        sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        rows = [reduce(DataFrame.unionByName, rows).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))]
    return rows[0].drop("row")


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return aligned(table(spark, sf_dir, "documents"))

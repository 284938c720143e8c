"""Tries over the shared beginnings of conversations, as double arrays.

A conversation is the sequence of its turns; a turn is named by 128 bits of a digest of role and text. Sorted sequences
are cut into ranges of about equal size, the prefix shards: a node whose conversations all lie in one shard is finished
there, and only nodes on the first and the last sequence of a shard (its border) can go on in another one. Each shard numbers
its turns densely, packs its sequences into BASE and CHECK arrays and walks them for the members of each node. Borders
of up to ``FAN`` neighbouring shards are merged by the same arrays in rounds until one is left, so that no task holds more than
its range or 2 * FAN border paths, and a beginning shared by all conversations is spread over all shards.

A whole conversation (24 bytes for each turn) has to fit in one task; nothing else is held whole. Rows with a null conv_id belong
to no conversation. Turns are ordered by ``turn``, null first; rows of one conversation with equal turns by their digest.
Null role or text counts as empty. Repeated rows are turns of their own. An empty table has no node, not even the root.
Only the columns conv_id, turn, role and text are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.frames import table, written
from folioflow.llm.registry import query
from folioflow.llm.skew import join_groups

#: Bytes of a turn in a sequence: digest, then the words of its text. Bytes of sequences in a shard, shards merged at once.
ELEMENT, SHARD_BYTES, FAN = 20, 4_000_000, 64
#: Free places tried one by one before all free places are tested at once.
TRIES = 32
NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
BORDER = "shard long, pre long, side int, b_depth long, element binary, b_convs long, b_conv_id long, b_children long, b_leaves long, b_saved long"
ENDS = "e_key binary, e_place long, e_ids binary"
#: Ids listed in one row of a border node.
PIECE = 512


# ---- sequences


def element(role: Column, text: Column) -> Column:
    """Name and word count of a turn as ELEMENT bytes."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))
    return F.unhex(F.concat(F.substring(name, 1, 32), F.lpad(F.hex(words.cast("long")), 8, "0")))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq, the elements of its turns in order, from rows of (conv_id, turn, role, text)."""
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), element(F.col("role"), F.col("text")).alias("e")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("k"), "turn", "e")))
    listed = rows.groupBy("conv_id").agg(ordered.alias("p"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["e"])), "")).alias("seq"))


def rebuilt(seqs: DataFrame, block: int = 20) -> DataFrame:
    """Conversations that begin like the first of their block: h = crc32(conv_id) % 4 turns of it, then their own after h."""
    c = F.col("conv_id")
    named = written(seqs, "trie-own").withColumn("h", (F.crc32(c.cast("string").cast("binary")) % 4 * ELEMENT).cast("int"))
    heads = named.filter(c % block == 0).select(c.alias("base"), F.col("seq").substr(1, 3 * ELEMENT).alias("head"))
    rows = named.withColumn("base", c - c % block).join(heads, "base", "left")
    head = F.coalesce(F.col("head"), F.lit(b"")).substr(F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, F.col("seq").substr(F.col("h") + 1, F.octet_length("seq"))).alias("seq"))


# ---- double arrays


class Partial(NamedTuple):
    """What is known of a node: conversations, the smallest one, and sums over what is finished below it."""

    n_convs: int
    conv_id: int
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0


class DoubleArray:
    """A trie in BASE and CHECK: state t is the child of state s by turn id c if t = BASE[s] + c and CHECK[t] = s."""

    def __init__(self, children: list[list[int]], ids: list[int]):
        """Packs the nodes of a trie, given for each its children and its turn id; node 0 is the root and state 0."""
        self.base = np.zeros(1, np.int64)
        self.check = np.zeros(1, np.int64)  # -1: free
        self.state = [0] * len(children)
        self._free = 1
        level = [0]
        while level:
            below = []
            for node in level:
                if not children[node]:
                    continue
                wanted = [ids[k] for k in children[node]]
                at, base = self.state[node], self._place(wanted)
                self._reserve(base + max(wanted) + 1)
                self.base[at] = base
                for k, c in zip(children[node], wanted):
                    self.check[base + c] = at
                    self.state[k] = base + c
                below += children[node]
            level = below
        self.base, self.check = self.base.tolist(), self.check.tolist()

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, ids: list[int]) -> int:
        """The first base at which all of these children fall on free states."""
        check, low = self.check, min(ids)
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        for free in range(self._free, min(self._free + TRIES, len(check))):
            if check[free] < 0 and all(free - low + c >= len(check) or check[free - low + c] < 0 for c in ids):
                return free - low
        if self._free + TRIES >= len(check):
            return len(check) - low
        spots = np.flatnonzero(check[self._free :] < 0) + self._free
        for c in ids:
            at = spots - low + c
            spots = spots[(at >= len(check)) | (check[np.minimum(at, len(check) - 1)] < 0)]
        return int(spots[0] if len(spots) else len(check)) - low

    def step(self, state: int, c: int) -> int:
        """The child of a state by a turn id, or -1."""
        at = self.base[state] + c
        return at if 0 < at < len(self.check) and self.check[at] == state else -1


def _listed(ids: list[int]) -> bytes:
    return b",".join(b"%d" % c for c in ids)


class Trie:
    """Nodes in the order in which they were met, parents first; a double array once ``packed``."""

    def __init__(self) -> None:
        self.turn, self.depth, self.parent, self.turn_ids = [b""], [0], [-1], [0]
        self.children: list[list[int]] = [[]]
        self.known: list[Partial | None] = [None]
        #: Dense ids of the turns of this shard, from 1.
        self.ids: dict[bytes, int] = {}
        self._met: dict[tuple[int, bytes], int] = {}

    def child(self, parent: int, turn: bytes) -> int:
        """The child of a node by a turn, made where it is missing."""
        node = self._met.get((parent, turn))
        if node is None:
            node = self._met[parent, turn] = len(self.turn)
            self.children[parent].append(node)
            self.children.append([])
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.turn.append(turn)
            self.turn_ids.append(self.ids.setdefault(turn, len(self.ids) + 1))
            self.known.append(None)
        return node

    def pack(self) -> None:
        self._met.clear()
        self.array = DoubleArray(self.children, self.turn_ids)
        self.node_at = dict(zip(self.array.state, range(len(self.turn))))

    def step(self, node: int, turn: bytes) -> int:
        """The child of a node by BASE and CHECK."""
        return self.node_at[self.array.step(self.array.state[node], self.ids[turn])]

    def add(self, node: int, p: Partial) -> None:
        k = self.known[node]
        if k is not None:
            p = Partial(k.n_convs + p.n_convs, min(k.conv_id, p.conv_id), k.n_children + p.n_children, k.n_leaves + p.n_leaves, k.saved + p.saved)
        self.known[node] = p

    def finish(self, border: set[int]) -> None:
        """Sums over subtrees, children first. What is finished below a border node becomes a part of what is known of it."""
        for node in range(len(self.turn) - 1, -1, -1):
            if node in border:
                continue
            k = self.known[node]
            leaves = k.n_leaves + (k.n_children == 0)
            k = self.known[node] = k._replace(n_leaves=leaves, saved=k.saved + (k.n_convs - 1) * self.words(node))
            if node:
                up = self.known[self.parent[node]]
                self.known[self.parent[node]] = up._replace(n_children=up.n_children + 1, n_leaves=up.n_leaves + leaves, saved=up.saved + k.saved)

    def words(self, node: int) -> int:
        return int.from_bytes(self.turn[node][16:], "big")

    def keys(self, nodes: list[int]) -> dict[int, bytes]:
        """Names of 128 bits of the whole paths of these nodes, ancestors first and among them."""
        chains = {}
        for node in nodes:
            chain = chains[self.parent[node]].copy() if node else hashlib.sha256()
            chain.update(self.turn[node])
            chains[node] = chain
        return {node: chain.digest()[:16] for node, chain in chains.items()}

    def results(self, shard: int, sides: dict[int, int], keys: dict[int, bytes], ends: dict[int, list[int]]) -> Iterator[tuple]:
        """Finished nodes, border nodes (those with a side) in preorder, and the conversations that end at border nodes."""
        for node in range(len(self.turn)):
            k, own = self.known[node], ends.get(node, [])
            if node in sides:
                yield (None,) * 10 + (shard, node, sides[node], self.depth[node], self.turn[node], *k) + (None,) * 3
                for lo in range(0, len(own), PIECE):
                    yield (None,) * 20 + (keys[node], shard << 32 | lo, _listed(own[lo : lo + PIECE]))
                continue
            up = self.parent[node]
            above = (None, keys[up]) if up in sides else (self.known[up].conv_id if node else None, None)
            yield (k.conv_id, self.depth[node], *above, keys.get(node), *k[:1], *k[2:], hashlib.sha256(_listed(own)).hexdigest()) + (None,) * 13


SHAPE = f"{NODE}, {BORDER}, {ENDS}"


def _packed(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    columns = [c.split(" ") for c in schema.split(", ")]
    while chunk := list(islice(rows, 10_000)):
        arrays = [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*chunk), columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in columns])


def _solve_shard(shard: int, rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
    """A shard from its sorted (seq, conv_id)."""
    trie = Trie()
    members: list[tuple[bytes, list[int]]] = []
    for seq, conv_id in rows:
        if members and members[-1][0] == seq:
            members[-1][1].append(conv_id)
            continue
        members.append((seq, [conv_id]))
        node = 0
        for lo in range(0, len(seq), ELEMENT):
            node = trie.child(node, seq[lo : lo + ELEMENT])
    trie.pack()
    ends: dict[int, list[int]] = {}
    sides: dict[int, int] = {}
    for n, (seq, own) in enumerate(members):
        side = (n == 0) + 2 * (n == len(members) - 1)
        node, p = 0, Partial(len(own), own[0])
        for lo in range(0, len(seq) + 1, ELEMENT):
            trie.add(node, p)
            if side:
                sides[node] = sides.get(node, 0) | side
            if lo < len(seq):
                node = trie.step(node, seq[lo : lo + ELEMENT])
        ends[node] = own
    trie.finish(set(sides))
    return trie.results(shard, sides, trie.keys(sorted(sides)), ends)


def _solve_borders(group: int, rows: list[dict], last: bool) -> Iterator[tuple]:
    """The borders of neighbouring shards, each in preorder; with ``last`` nothing stays open."""
    trie = Trie()
    for build in (True, False):
        path: list[int] = [0]
        sides: dict[int, int] = {}
        for r in rows:
            del path[r["b_depth"] :]
            if r["b_depth"]:
                path.append(trie.child(path[-1], r["element"]) if build else trie.step(path[-1], r["element"]))
            else:
                path = [0]
            if not build:
                trie.add(path[-1], Partial(r["b_convs"], r["b_conv_id"], r["b_children"], r["b_leaves"], r["b_saved"]))
                side = (r["side"] & 1) * (r["shard"] == rows[0]["shard"]) | (r["side"] & 2) * (r["shard"] == rows[-1]["shard"])
                if side:
                    sides[path[-1]] = sides.get(path[-1], 0) | side
        if build:
            trie.pack()
    sides = {} if last else sides
    trie.finish(set(sides))
    return trie.results(group, sides, trie.keys(list(range(len(trie.turn)))), {})


def _shards(rows: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        first = next(rows, None)
        if first is not None:
            yield from _packed(_solve_shard(TaskContext.get().partitionId(), chain([first], rows)), SHAPE)

    cut = rows.select("seq", "conv_id").repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return cut.mapInArrow(run, SHAPE)


def _merged(borders: DataFrame, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        for group, own in groupby(rows, lambda r: r["shard"] // FAN):
            yield from _packed(_solve_borders(group, list(own), last), SHAPE)

    rows = borders.select(*[c.split(" ")[0] for c in BORDER.split(", ")])
    return rows.repartition(F.floor(F.col("shard") / FAN)).sortWithinPartitions("shard", "pre").mapInArrow(run, SHAPE)


def _digests(ends: DataFrame) -> DataFrame:
    """e_key and e_sha, the digest of the ids of each key in order. Ids pass as a stream, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = chain.from_iterable(zip(b.column(0), b.column(2)) for b in batches)

        def rows() -> Iterator[tuple]:
            for key, own in groupby(((k.as_py(), ids) for k, ids in pieces), lambda x: x[0]):
                digest = None
                for _, ids in own:
                    if digest is None:
                        digest = hashlib.sha256()
                    else:
                        digest.update(b",")
                    digest.update(ids.as_buffer())
                yield key, digest.hexdigest()

        yield from _packed(rows(), "e_key binary, e_sha string")

    return ends.select("e_key", "e_place", "e_ids").repartition("e_key").sortWithinPartitions("e_key", "e_place").mapInArrow(run, "e_key binary, e_sha string")


def nodes(seqs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The nodes of the trie over (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    seqs = written(seqs, "trie-sequences")
    size = seqs.agg(F.sum(F.octet_length("seq") + 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    solved = written(_shards(seqs, parts), "trie-shards")
    rounds, ends = [solved], solved.filter("e_key is not null")
    while True:
        parts = -(-parts // FAN)
        rounds.append(written(_merged(rounds[-1].filter("shard is not null and e_key is null"), parts <= 1), "trie-borders"))
        if parts <= 1:
            break
    found = reduce(DataFrame.unionByName, [r.filter("conv_id is not null").select(*[c.split(" ")[0] for c in NODE.split(", ")]) for r in rounds])
    # Nodes that were once on a border have a key; their children and the conversations that end there are joined by it.
    open_ = written(found.filter("key is not null").join(_digests(ends).withColumnRenamed("e_key", "key"), "key", "left"), "trie-open")
    open_ = open_.withColumn("ends_sha256", F.coalesce("e_sha", "ends_sha256")).drop("e_sha")
    every = found.filter("key is null").unionByName(open_)
    parents = open_.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"), F.greatest("n_children", F.lit(1)).alias("n"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    joined = join_groups(every.filter("parent_key is not null"), parents, "parent_key", "n").withColumn("parent_conv_id", F.col("up"))
    return every.filter("parent_key is null").select(columns).unionByName(joined.select(columns))


SQL = r"""
with o as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as t,
         row_number() over (partition by conv_id order by turn nulls first) as n
  from conversations where conv_id is not null),
own as (select conv_id, list({'r': r, 't': t} order by n) as s from o group by conv_id),
bits as (
  select conv_id, s, flatten(list_transform(string_split(cast(conv_id as varchar), ''),
         lambda x: list_transform(range(8), lambda b: (ascii(x) >> b) & 1))) as m from own),
cut as (
  select conv_id, s, (xor(list_reduce(list_prepend(cast(4294967295 as bigint), m),
         lambda a, b: xor(a >> 1, cast(3988292384 as bigint) * xor(a & 1, b))), 4294967295) % 4) as h from bits),
reb as (
  select c.conv_id, list_concat(case when b.s is null then [] else b.s[1:c.h] end, c.s[c.h + 1:]) as s
  from cut c left join own b on b.conv_id = c.conv_id - c.conv_id % 20),
pre as (select conv_id, d, s[1:d] as p, d = len(s) as ends from reb, unnest(range(0, len(s) + 1)) as u(d)),
node as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from pre group by p, d),
kid as (select p[1:d - 1] as p, d - 1 as d, count(*) as n from node where d > 0 group by 1, 2),
full_ as (
  select node.*, coalesce(kid.n, 0) as n_children,
         (n_convs - 1) * case when node.d = 0 then 0 else len(regexp_extract_all(node.p[node.d].t, '[^ 	-
]+')) end as saved
  from node left join kid on kid.p = node.p and kid.d = node.d),
tree as (
  select f.p[1:u.d] as p, u.d as d, count_if(n_children = 0) as n_leaves, sum(saved) as saved_tokens
  from full_ f, unnest(range(0, f.d + 1)) as u(d) group by 1, 2)
select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(tree.n_leaves as bigint) as n_leaves,
       cast(tree.saved_tokens as bigint) as saved_tokens, f.ends_sha256
from full_ f join tree on tree.p = f.p and tree.d = f.d
left join node up on up.p = f.p[1:f.d - 1] and up.d = f.d - 1 and f.d > 0
"""


@query("op12_prefix_trie", SQL)
def op12(spark, sf_dir):
    return nodes(rebuilt(sequences(table(spark, sf_dir, "conversations"))))

"""The trie of conversations against brute force over dictionaries of prefixes."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from folioflow.llm import prefix_trie as trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, seq string, key int"


def named(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(WORD.findall(text)).to_bytes(4, "big")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, named(role, text)))
    own = {c: [e for *_, e in sorted(v)] for c, v in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        out[c] = tuple(own.get(base, [])[:h] + s[h:])
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = int.from_bytes(p[-1][16:], "big") if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def rows_of():
    rng = random.Random(3)
    say = ["hi", "hello there", "a b  c\n d", "", None, "é漢 😀 x", "long " * 3000]
    rows = []
    for c in [*range(-25, 300), 10**15, -(10**15)]:
        if c in (40, 60):
            continue  # conversations without a first one of their block
        n = 1 if c % 7 == 0 else rng.randint(1, 6)
        # A third of all begin alike, with copies among them.
        text = [say[0], say[1], say[2]] if c % 3 == 0 else [rng.choice(say) for _ in range(3)]
        for t in range(n):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None, ""]) if c % 3 else "user", text[t] if t < 3 else rng.choice(say)))
    rows += [(500, 1, "user", "tie b"), (500, 1, "user", "tie a"), (500, 1, "user", "tie a"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(600 + k, t, "user", f"deep {t}") for k in range(5) for t in range(150 + k)]
    rng.shuffle(rows)
    return [(*r, "clash", 1) for r in rows]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(4)


def test_rebuilt(spark, frame):
    got = {r.conv_id: bytes(r.seq) for r in trie.rebuilt(trie.sequences(frame)).collect()}
    assert got == {c: b"".join(s) for c, s in rebuilt(rows_of()).items()}


@pytest.mark.parametrize("shard_bytes", [4_000_000, 100])
def test_nodes(spark, frame, shard_bytes):
    """With small shards there are hundreds of them and two rounds of merging."""
    seqs = trie.rebuilt(trie.sequences(frame))
    assert collected(trie.nodes(seqs, shard_bytes)) == brute(rebuilt(rows_of()))


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}", "", 0) for c in range(2000) for t in range(3)]
    got = collected(trie.nodes(trie.sequences(spark.createDataFrame(rows, SCHEMA)), 1000))
    assert got == brute({c: tuple(named("user", f"same {t}") for t in range(3)) for c in range(2000)})


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.nodes(trie.rebuilt(trie.sequences(none))).count() == 0


def test_double_array():
    """Every child is found by its turn id and nothing else is, with wide, scattered and single children."""
    rng = random.Random(4)
    children, ids, kid_ids = [[]], [0], [set()]
    for node in range(1, 3000):
        while (up := rng.choice([0, rng.randrange(node), node - 1])) is None or (c := rng.randint(1, 900)) in kid_ids[up]:
            pass
        children[up].append(node)
        kid_ids[up].add(c)
        children.append([])
        kid_ids.append(set())
        ids.append(c)
    array = trie.DoubleArray(children, ids)
    assert len(set(array.state)) == len(children)
    for node, kids in enumerate(children):
        by_id = {ids[k]: array.state[k] for k in kids}
        for c in [*by_id, *rng.sample(range(1, 900), 20)]:
            assert array.step(array.state[node], c) == by_id.get(c, -1)

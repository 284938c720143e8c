"""Token alignment against brute force over byte ranges, with both tokenizers as their libraries run them."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from conftest import SCHEMA, row
from tokenizers import Tokenizer

from folioflow.llm import token_alignment as ta

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(ta.default_paths()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.default_paths()[1])


def token_bytes(plain, text):
    """Ids and bytes of the tokens of both tokenizers, by their own names of tokens."""
    a, b = plain
    letters = {c: k for k, c in enumerate(ta.byte_letters())}
    out_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    out_b = []
    for i in b.encode(text):
        name = b.id_to_piece(i)
        m = re.fullmatch(r"<0x([0-9A-F]{2})>", name)
        out_b.append((i, bytes([int(m[1], 16)]) if m else name.replace("▁", " ").encode()))
    return out_a, out_b


def ranges(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(plain, rows):
    docs = []
    for doc_id, text in rows:
        a, b = token_bytes(plain, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            docs.append((doc_id, [], [], [], ""))
            continue
        a, b = ranges(a), ranges(b)
        links, lo = [], 0
        for x, s, e in a:
            while lo < len(b) and b[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        groups = []
        start_a = start_b = 0
        ends_b = {e: k + 1 for k, (_, _, e) in enumerate(b)}
        for k, (_, _, e) in enumerate(a, 1):
            if e in ends_b:
                one = ",".join(str(x[0]) for x in a[start_a:k]) + "|" + ",".join(str(x[0]) for x in b[start_b : ends_b[e]])
                groups.append(one)
                start_a, start_b = k, ends_b[e]
        docs.append((doc_id, a, b, links, ";".join(groups)))
    count = Counter(link for d in docs for link in d[3])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, a, b, links, groups in docs:
        n_best = sum(count[x] == best[x[1]] for x in links)
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), groups.count(";") + bool(groups), len(links), n_best, sum(count[x] for x in links), sha))
    return Counter(out)


ODD = ["▁ here", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "  two  blanks ", "\n\n\nlines \n x\n", " ", "\n", "\0", "x\0y", "tab\tand\r\nnbsp\xa0end", "漢字かな😀👍🏽", "ﬁ ſ Å é", "don't we'll I'M", "1234567890 " * 30]


def test_against_brute_force(spark, plain, hard_rows, empty):
    rows = hard_rows + [row(700 + k, t) for k, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(plain, [(r[0], r[1]) for r in rows])
    for block in (ta.BLOCK, 400):
        # The small block takes several passes, whose sums are added.
        got = ta.aligned(frame, block=block)
        assert got.columns == COLUMNS
        assert Counter(tuple(r) for r in got.collect()) == want
    assert ta.aligned(empty).count() == 0


def test_units_encode_like_whole_texts(plain):
    rng = random.Random(8)
    signs = [" ", " ", " ", "\n", "  ", "▁", "\t", "e", "n", "th", "ing", "é", "漢", "😀", "\0", "\x7f", ".", "1", " ", "<0x0A>"]
    pieces, level = ta.Pieces(ta.default_paths()[1]), ta.ByteLevel(ta.default_paths()[0])
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 30)))
        ids = np.frombuffer(pieces.encode([text])[0], np.uint16).tolist()
        assert ids == ([] if "▁" in text else plain[1].encode(text)), repr(text)
        assert np.frombuffer(level.encode(text), np.uint16).tolist() == plain[0].encode(" " + text, add_special_tokens=False).ids


def test_long_runs(plain):
    """Runs without a place to cut, as long texts have them."""
    pieces, level = ta.Pieces(ta.default_paths()[1]), ta.ByteLevel(ta.default_paths()[0])
    for text in ("ab" * 100_000, " " * 200_000, "\n" * 100_000, "=" * 100_000):
        assert np.frombuffer(pieces.encode([text])[0], np.uint16).tolist() == plain[1].encode(text)
        ids = np.frombuffer(level.encode(text), np.uint16).tolist()
        assert b"".join(level.bytes[i] for i in ids) == (" " + text).encode()


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 32, n).astype(np.uint64))
    n_shards = max(1, n // 600)
    shard = (ta._shard_hash(keys) % np.uint64(n_shards)).astype(int)
    shards = []
    for s in range(n_shards):
        levels, ordered = ta.hash_levels(keys[shard == s])
        if len(ordered):
            shards.append((s, [len(x) for x in levels], np.packbits(np.concatenate(levels)).tobytes(), ordered.astype(np.uint32).tobytes()))
    index = ta.PairIndex(shards, n_shards)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 32, 3000).astype(np.uint64), keys)
    assert (index.find(other) == -1).all()

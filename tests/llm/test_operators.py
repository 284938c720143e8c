"""The operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import prose  # noqa: F401

from folioflow.llm import block_naming, byte_bpe, chaining, mixing, order_minhash, quality, rollups, secrets, suffix_dedup, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def key(doc_id):
    return (doc_id is not None, doc_id)


# ---- 1 quality


def labels_of(spark, rows, column):
    other = {"quality": "toxic", "toxic": "quality"}[column]
    data = [(i, v, 0) for i, v in rows] + [(None, 1, 1), (None, 0, 0), (10**9, None, None)]
    return spark.createDataFrame(data, f"doc_id long, {column} int, {other} int")


def test_quality_counts(spark, hard, hard_rows):
    got = quality.score(hard, quality.Model(None, 0.0, 1.0, 0.0)).select("doc_id", "text", *quality.COUNTS, "base_failed").collect()
    assert len(got) == len(hard_rows)
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(5)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in quality.COUNTS) == expected
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_learns(spark, empty):
    rng = random.Random(2)
    rows = [(k, prose(rng, 80) if k % 3 else " | ".join(prose(rng, 1).upper() + "!!" for _ in range(60))) for k in range(150)]
    docs = spark.createDataFrame(rows + [(None, "x"), (7, None)], "doc_id long, text string")
    labels = labels_of(spark, [(k, int(k % 3 > 0)) for k in range(0, 150, 2)], "quality")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.kept for r in quality.score(docs.filter("text is not null and doc_id is not null"), model).collect()}
    assert [k for k in range(150) if got[k] != (k % 3 > 0)] == []
    none = quality.fit(empty, labels.limit(0))
    assert none.weights is None and quality.score(empty, none).count() == 0
    assert quality.stage(docs, labels.limit(0)).columns == docs.columns


# ---- 2 exact


def test_quality_measures_small_slices(spark, empty, monkeypatch):
    """What a task holds for counting follows ``SLICE``, not the rows of an Arrow batch."""
    import pyarrow as pa

    model = quality.fit(empty, labels_of(spark, [], "quality"))
    run, sizes, measure = [], [], quality.measure
    monkeypatch.setattr(quality, "measure", lambda texts, m: sizes.append(sum(map(len, texts.to_pylist()))) or measure(texts, m))

    class Docs:
        schema, columns = empty.select("doc_id", "text").schema, ["doc_id", "text"]
        drop = lambda self, *names: self
        mapInArrow = lambda self, f, schema: run.append(f)

    quality.score(Docs(), model)
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(["word " * 600] * 900)], names=["doc_id", "text"])
    out = list(run[0]([batch]))
    assert sum(len(b) for b in out) == 900 and sum(sizes) == 900 * 3000 and max(sizes) <= 250_000


def expected_groups(rows):
    groups, copies = defaultdict(set), Counter()
    for r in rows:
        plain = (r[1] or "").translate(LOWER)
        groups[plain].add(r[0])
        copies[plain] += 1
    return {(i, p): (max(ids, key=key), copies[p]) for p, ids in groups.items() for i in ids}


def test_exact(spark, hard, hard_rows, empty):
    expected = expected_groups(hard_rows)
    got = block_naming.exact_groups(hard).collect()
    by = {(i, hashlib.sha256(p.encode()).hexdigest()): v for (i, p), v in expected.items()}
    assert {(r.doc_id, r.digest.hex()): (r.keep_id, r.group_size) for r in got} == by and len(got) == len(by)
    assert all(r.kept == (r.keep_id == r.doc_id) for r in got)
    kept = block_naming.stage(hard)
    assert kept.columns == hard.columns
    assert sorted(((r.doc_id, (r.text or "").translate(LOWER)) for r in kept.collect()), key=str) == sorted(((k, p) for (i, p), (k, _) in expected.items() if i == k), key=str)
    assert block_naming.exact_groups(empty).count() == 0 and block_naming.stage(empty).count() == 0


# ---- 3 suffix sorting


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice([2, 3, 256])
        parts = [bytes(rng.randrange(letters) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        order, x, end = suffix_dedup.suffix_order(parts)
        shown = [x[i : end[i]].tolist() for i in order]
        assert shown == sorted(shown) and sorted(order.tolist()) == list(range(len(x)))
        joined = b"\0".join(parts) + b"\0"
        windows = Counter(joined[i : i + 8] for i in range(len(x)) if end[i] - i >= 8)
        assert suffix_dedup.repeated_windows(parts, 8).tolist() == [bool(end[i] - i >= 8 and windows[joined[i : i + 8]] > 1) for i in range(len(x))]


def brute_removal(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        out.append(tuple(map(tuple, spans)))
    return out


@pytest.mark.parametrize("hot", [500, 2])
def test_suffix_dedup(spark, hard, hard_rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 5_000)
    texts = [(r[1] or "").encode() for r in hard_rows]
    expected = Counter((r[0], len(t), s) for r, t, s in zip(hard_rows, texts, brute_removal(texts)))
    got = suffix_dedup.remove_repeats(hard).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans)) for r in got) == expected
    assert all(len(r.kept) == r.n_bytes - sum(s.end - s.start for s in r.spans) for r in got)
    if hot == 2:
        assert suffix_dedup.remove_repeats(empty).count() == 0


# ---- 4 rollups


def test_rollups(spark, hard, hard_rows, empty):
    labels = labels_of(spark, [(3, 0), (5, 1)], "quality")
    counts = rollups.document_counts(hard, labels)
    rollup = rollups.Rollup(spark)
    rollup.commit("a", rollups.inserts(counts))
    first = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    expected = defaultdict(lambda: [0, 0])
    for r in hard_rows:
        for name, pattern in rollups.TOKENIZERS.items():
            expected[r[3], r[2], name][0] += 1
            expected[r[3], r[2], name][1] += len(re.findall(pattern, r[1] or ""))
    assert first == {k: tuple(v) for k, v in expected.items()}
    for _ in range(2):  # a replay counts once
        rollup.commit("b", rollups.deletes(counts.filter("doc_id = 3")))
    rollup.commit("c", rollups.revisions(counts.filter("doc_id = 5")))
    text = {r[0]: r[1] for r in hard_rows}
    pattern = rollups.TOKENIZERS["words-1"]
    change = -len(re.findall(pattern, text[3]))
    again = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert again["s0", "en", "words-1"] == (first["s0", "en", "words-1"][0] - 1, first["s0", "en", "words-1"][1] + change)
    nothing = rollups.Rollup(spark)
    nothing.commit("a", rollups.inserts(rollups.document_counts(empty, labels)))
    assert nothing.totals().count() == 0


# ---- 5 mixing


def test_frame_keeps_every_prefix_within_a_block():
    rng = random.Random(4)
    for _ in range(60):
        shares = mixing.shares_of({f"s{k}": rng.random() + 0.01 for k in range(rng.randint(1, 9))}, rng.choice([10, 37, 200]))
        size, given = sum(shares.values()), Counter()
        slots = mixing.frame(shares)
        assert [t for _, _, t in slots] == list(range(size))
        for s, k, t in slots:
            assert k == given[s] and k * size // shares[s] <= t < -(-(k + 1) * size // shares[s])
            given[s] += 1
            assert all(abs(given[x] * size - shares[x] * (t + 1)) < size for x in shares)
        assert given == shares


def test_mix(spark, hard, hard_rows, empty):
    rows = mixing.mix(hard, block=2000).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in hard_rows)
    by = defaultdict(list)
    for r in rows:
        assert r.release <= r.slot < r.deadline and r.block == r.offset // 2000
        by[r.source].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: (r.offset, r.chars)):
            assert r.offset == at
            at += r.chars
    out = mixing.stage(hard)
    assert out.columns == hard.columns and Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in hard_rows)
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(hard, {"s0": 1.0})


def assert_within_a_block(rows, weights):
    """rows: (source, block, slot) of every block; the counts of every prefix against the given weights."""
    total = sum(weights.values())
    blocks = Counter(s for s, _, _ in rows)
    given, at = Counter(), 0
    for source, k, slot in sorted(rows, key=lambda r: r[2]):
        assert slot >= at and k == given[source]
        at = slot + 1
        given[source] += 1
        assert abs(given[source] - weights[source] / total * at) < 1
        if len(blocks) < 10:
            assert all(abs(given[s] - weights[s] / total * at) < 1 for s in weights if given[s] < blocks[s])


def test_schedule_keeps_the_given_weights():
    from fractions import Fraction as Part

    for given, n in (({"a": 0.9, "b": 0.1}, 4000), ({"a": 0.7, "b": 0.2, "c": 0.09, None: 0.01}, 3000), ({"a": 2**0.5, "b": 3**0.5, "c": 1}, 2000)):
        weights = {s: Part(str(w)) for s, w in given.items()}
        rows = [(s, k, t) for s, k, _, _, t in mixing.schedule(mixing.exact_weights(given), dict.fromkeys(given, n))]
        assert len(rows) == n * len(given) and len({t for _, _, t in rows}) == len(rows)
        assert_within_a_block(rows, weights)


def test_mix_keeps_the_given_weights(spark):
    from fractions import Fraction as Part

    rng = random.Random(12)
    for names, weight in ((["a", "b"], {"a": 0.9, "b": 0.1}), ([f"s{k:04}" for k in range(1200)], {f"s{k:04}": 1 + k % 7 for k in range(1200)})):
        each = 2400 // len(names)
        docs = spark.createDataFrame([(k, "x" * rng.randint(5, 10), names[k % len(names)]) for k in range(each * len(names))], "doc_id long, text string, source string")
        rows = mixing.mix(docs, weight, block=5).collect()
        weights = {s: Part(str(w)) for s, w in weight.items()}
        total = sum(weights.values())
        for r in rows:
            w = weights[r.source] / total
            assert r.release == r.block // w and r.deadline == -(-(r.block + 1) // w) and r.release <= r.slot < r.deadline
        owner = {}
        for r in rows:
            assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    with pytest.raises(ValueError):
        mixing.mix(docs, dict.fromkeys(names, 0))


# ---- 6 secrets


def test_secrets(spark, hard, hard_rows, empty):
    model = secrets.fit(hard)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = {}
    for r in secrets.scan(hard, model).collect():
        found.setdefault(r.doc_id, []).append([(s.start, s.end, s.kind) for s in r.spans if s.kind != "crf"])
    for r in hard_rows:
        t = r[1] or ""
        own = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        own += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        own += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(own, key=lambda s: (s[0], secrets.KINDS.index(s[2]))) in found[r[0]]
    assert secrets.scan(empty, secrets.fit(empty)).count() == 0


def test_field_finds_what_the_patterns_miss(spark):
    rng = random.Random(8)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f"{prose(rng, 30)} token = \"{code(40)}\" {prose(rng, 30)}" if k % 2 else prose(rng, 60)) for k in range(120)]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    hidden = code(22) + "A" + code(17)
    text = f"{prose(rng, 20)} pass = \"{hidden}\" {prose(rng, 20)}"
    clean = prose(rng, 60)
    spans = secrets.spans_of(__import__("pyarrow").array([text, clean, None]), model)
    assert [(text[a:b], kind) for a, b, kind in spans[0]] == [(hidden, "crf")] and spans[1:] == [[], []]


def test_rare_secrets_train_the_field(spark):
    from pyspark.sql import functions as F

    rng = random.Random(14)
    code = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    ids = [r.id for r in spark.range(22_000).orderBy(F.xxhash64("id", F.lit("secret"))).collect()]
    rows = [(k, prose(rng, 8)) for k in ids[:21_900]]
    rows += [(k, f"{prose(rng, 30)} token = \"{code(40)}\" {prose(rng, 30)}") for k in ids[21_900:]]
    rows[:3000] = [(k, f"{t} {code(30, '0123456789ABCDEF')}") for k, t in rows[:3000]]  # no base match
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    hidden = code(22) + "A" + code(17)
    text = f"{prose(rng, 20)} token \"{code(40)}\" pass = \"{hidden}\" {prose(rng, 20)}"
    assert model.weights is not None
    assert (hidden, "crf") in [(text[a:b], kind) for a, b, kind in secrets.spans_of(__import__("pyarrow").array([text]), model)[0]]


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        owner = np.sort(rng.integers(0, 2, n))
        emit, moves = rng.normal(size=(n, 3)) * 3, rng.normal(size=(3, 3))
        emit[:, 0] += rng.choice([0, 8], n)
        got = secrets.viterbi(emit, owner, moves)
        value = lambda s: sum(emit[i, s[i]] + (moves[s[i - 1], s[i]] if i and owner[i] == owner[i - 1] else 0) for i in range(n))
        assert abs(value(got) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-9


# ---- 7 chaining


def test_chaining(spark, hard, hard_rows, empty):
    got = chaining.find_passages(hard).collect()
    assert len(got) == len(hard_rows)
    texts = [words(r[1]) for r in hard_rows]
    where = defaultdict(set)
    for k, w in enumerate(texts):
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append([(s.start, s.end) for s in r.spans])
    for k, w in enumerate(texts):
        need = {i + j for i in range(len(w) - 49) if len(where[tuple(w[i : i + 50])]) > 1 for j in range(50)}
        assert any(all(any(a <= i < b for a, b in own) for i in need) for own in spans[hard_rows[k][0]]), hard_rows[k][0]
    assert all(s == [[]] for d, s in spans.items() if d in (20, 21, 400, 403, 405, 406, 407, 408))
    assert chaining.find_passages(empty).count() == 0


def test_fuzzy_passage(spark):
    rng = random.Random(6)
    passage = prose(rng, 120).split()
    fuzzy = [w if k % 17 else "changed" for k, w in enumerate(passage)]
    del fuzzy[60]
    one, two = prose(rng, 100).split(), prose(rng, 90).split()
    docs = spark.createDataFrame([(1, " ".join(one + passage + one[::-1])), (2, " ".join(two + fuzzy + two[::-1])), (3, prose(rng, 200))], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chaining.find_passages(docs).collect()}
    (a, b), (c, d) = got[1][0], got[2][0]
    assert abs(a - 100) < 6 and abs(b - 220) < 6 and abs(c - 90) < 6 and abs(d - 209) < 6 and got[3] == []


def brute_passages(u, v, least=50):
    """Words of u in exact common windows of ``least`` words."""
    known = {tuple(v[j : j + least]) for j in range(len(v) - least + 1)}
    return {i + k for i in range(len(u) - least + 1) if tuple(u[i : i + least]) in known for k in range(least)}


@pytest.mark.parametrize("between", [20, 60, 150, 300])
def test_chain_over_unlike_words_falls_into_its_parts(spark, between):
    rng = random.Random(between)
    head, foot, stray, body = (prose(rng, n).split() for n in (60, 60, 5, 60))
    new = lambda n: [f"{w}{rng.randrange(10**6)}" for w in prose(rng, n).split()]
    rows = [(k, head + new(between) + foot) for k in (1, 2)]
    rows += [(3, new(30) + stray + new(40) + body + new(20)), (4, new(9) + stray + new(41) + body + new(30))]
    rows += [(5, new(30) + (last := prose(rng, 60).split()) + new(40) + stray[::-1] + new(9)), (6, new(9) + last + new(40) + stray[::-1])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r.doc_id: {i for s in r.spans for i in range(s.start, s.end)} for r in chaining.find_passages(docs).collect()}
    text = {k: words(" ".join(w)) for k, w in rows}
    for a, b in ((1, 2), (3, 4), (5, 6)):
        for x, y in ((a, b), (b, a)):
            need = brute_passages(text[x], text[y])
            assert need and need <= got[x]
    if between > 60:
        assert len(got[1]) < 130 and len(got[3]) < 70


@pytest.mark.parametrize("similarity, least", [(0.95, 1.0), (0.9, 1.0), (0.85, 0.99), (0.8, 0.97)])
def test_recall_of_short_fuzzy_passages(spark, similarity, least):
    """Passages of 50 words with changed, dropped and added words among unlike ones."""
    rng = random.Random(int(similarity * 100))
    new = lambda n: [f"{w}{rng.randrange(10**6)}" for w in prose(rng, n).split()]
    rows, there = [], {}
    for k in range(300):
        one = new(50)
        two = list(one)
        for at in rng.sample(range(2, 48), int(50 * (1 - similarity) + 1e-9)):
            two[at] = rng.choice([new(1)[0]] * 3 + ["", f"{two[at]} {new(1)[0]}"])
        two = " ".join(w for w in two if w).split()
        longer = max(len(one), len(two))
        assert order_minhash.banded(one, two, 50) <= (1 - similarity) * longer + 1e-9 or len(two) < 50
        there[k] = len(two) >= 45 and order_minhash.banded(one, two, 50) <= 0.2 * longer + 1e-9
        rows += [(2 * k, " ".join(new(30) + one + new(30))), (2 * k + 1, " ".join(new(20) + two + new(40)))]
    got = {r.doc_id: r for r in chaining.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [bool(got[2 * k].spans) and got[2 * k + 1].class_id == 2 * k for k in there if there[k]]
    print(similarity, len(found), sum(found) / len(found))
    assert len(found) > 150 and sum(found) >= least * len(found)


def test_passage_of_frequent_lines(spark):
    """Two texts share three lines that other texts have one at a time; every text is the first and last of some seed."""
    rng = random.Random(21)
    new = lambda n: [f"{w}{rng.randrange(10**6)}" for w in prose(rng, n).split()]
    lines = [new(20) for _ in range(3)]
    rows = [(k, new(30) + lines[k % 3] + new(30)) for k in range(150)]
    rows += [(k, new(20) + lines[0] + new(1) + lines[1] + new(1) + lines[2] + new(30)) for k in (1000, 1001)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in chaining.find_passages(docs).collect()}
    for k in (1000, 1001):
        assert got[k].links == 1 and got[k].class_id == 1000
        assert set(range(20, 82)) <= {i for s in got[k].spans for i in range(s.start, s.end)}
    assert all(got[k].spans == [] and got[k].class_id == k for k in range(150))


def test_passage_with_one_frequent_line(spark):
    """Passages of fifty words around a line that many texts have, with no other five words in a row in common."""
    rng = random.Random(22)
    new = lambda n: [f"{w}{rng.randrange(10**6)}" for w in prose(rng, n).split()]
    line = new(22)
    rows = [(k, new(30) + line + new(30)) for k in range(60)]
    for k in range(100, 120, 2):
        head, tail = new(14), new(14)
        for d in (0, 1):
            edits = lambda w, r: [x if (j + r) % 4 or not d else new(1)[0] for j, x in enumerate(w)]
            rows.append((k + d, new(30) + edits(head, 3) + [f"own{k}{d}"] + line + [f"its{k}{d}"] + edits(tail, 0)[:14] + new(20)))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in chaining.find_passages(docs).collect()}
    for k in range(100, 120):
        assert got[k].links == 1 and got[k].class_id == k - k % 2, k
    assert all(got[k].spans == [] and got[k].class_id == k for k in range(60))


def test_all_texts_with_a_passage_are_compared(spark):
    """Thirty texts hold one passage; two pairs of them go on alike on both sides of it, which only their own comparison tells."""
    rng = random.Random(24)
    new = lambda n: [f"{w}{rng.randrange(10**6)}" for w in prose(rng, n).split()]
    passage, heads, tails = new(60), [new(12) for _ in range(2)], [new(12) for _ in range(2)]
    rows = [(k, new(20) + (heads[k % 2] if k in (10, 11, 20, 21) else new(12)) + passage + (tails[k % 2] if k in (10, 11, 20, 21) else new(12)) + new(9)) for k in range(30)]
    got = {r.doc_id: r for r in chaining.find_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()}
    assert all(r.links == 29 and r.class_id == 0 for r in got.values())
    for k in (10, 11, 20, 21):
        assert set(range(20, 104)) <= {i for s in got[k].spans for i in range(s.start, s.end)}


def test_few_surroundings_are_counted_as_tiles_are():
    rng = random.Random(25)
    lists = [np.array([rng.randrange(40) for _ in range(rng.randrange(1, 86))], np.uint16).tobytes() for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    want = chaining._shared_words(lists, np.arange(40), np.arange(40))[left, right] >= chaining.EQUAL
    assert (chaining._met_few(lists, left, right) == want).all() and 0 < want.sum() < len(want)


def test_shared_words_of_surroundings():
    rng = random.Random(23)
    lists = [[rng.randrange(12) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    left, right = np.arange(0, 20), np.arange(10, 30)
    got = chaining._shared_words([np.array(w, np.uint16).tobytes() for w in lists], left, right)
    for x in left:
        for y in right:
            assert x == y or got[x, y - 10] == sum((Counter(lists[x]) & Counter(lists[y])).values())


# ---- 8 toxicity


def test_toxicity(spark, empty):
    rng = random.Random(9)
    bad = ["idiot", "moron", "scum"]

    def text(k):
        w = prose(rng, 70).split()
        if k % 4 == 0:
            w[10] = rng.choice(bad)
        if k % 50 == 1:
            w[5:7] = ["noble", "scum"]  # an exception phrase
        return " ".join(w)

    rows = [(k, text(k)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(k, int(k % 4 == 0)) for k in range(400)], "toxic").filter(~toxicity.held_out())
    model = toxicity.fit(toxicity.sample_rows(docs, labels))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((scores[k] >= 0.5) == (k % 4 == 0) for k in range(400))
    assert right >= 390
    probe = spark.createDataFrame([(1, "you 1d10t here now", 1, 1.0), (2, "quite fine words here", 1, 1.0), (3, None, 1, 1.0), (4, "", 1, 1.0), (5, "ІDІОТ indeed my good friend", 1, 1.0)], "doc_id long, text string, hits int, score double")
    out = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert out[1] > 0.5 and out[5] > 0.5 and max(out[2], out[3], out[4]) < 0.5
    none = toxicity.fit(toxicity.sample_rows(empty, labels))
    assert toxicity.score(empty, none).count() == 0 and all(r.score < 0.01 for r in toxicity.score(probe, none).collect())


# ---- 9 near duplicates


def test_banded():
    rng = random.Random(3)
    for _ in range(3000):
        letters = rng.choice([2, 5, 50])
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.8 else [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randrange(letters) for _ in range(rng.randint(0, 1))]
        most = rng.randint(0, 20)
        assert order_minhash.banded(a, b, most) == min(distance(a, b), most + 1)


def brute_classes(rows):
    texts = sorted({tuple(words(r[1])) for r in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        longer = max(len(a), len(b))
        if a and b and min(len(a), len(b)) >= 0.8 * longer and order_minhash.banded(list(a), list(b), int(0.2 * longer + 1e-9)) <= 0.2 * longer + 1e-9:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for r in rows:
        groups[find(tuple(words(r[1])))].append(r[0])
    return {g: (min(v, key=key), len(v)) for g, v in groups.items()}, find


def edited(rng, text, similarity, even):
    """The words of a text with as many substitutions as the similarity allows, at even or at random places."""
    out, n = list(text), round(len(text) * (1 - similarity))
    places = [int((k + 0.5) * len(text) / n) for k in range(n)] if even else rng.sample(range(len(text)), n)
    for k in places:
        out[k] = f"edit{rng.randrange(10**9)}"
    return out


def test_candidates_reach_the_similarity():
    import pyarrow as pa

    from folioflow.llm import kernel

    rng = random.Random(21)
    for similarity, even in itertools.product((0.8, 0.85, 0.9), (False, True)):
        texts = []
        for _ in range(200):
            one = [f"w{rng.randrange(50_000)}" for _ in range(200)]
            texts += [" ".join(one), " ".join(edited(rng, one, similarity, even))]
        raw, offsets = kernel.utf8(pa.array(texts))
        _, _, codes, of = order_minhash.kmers(raw, offsets)
        samples = order_minhash.sketches(codes, of, len(texts))
        met = (samples[::2] == samples[1::2]).any(axis=1).mean()
        print(f"recall at {similarity}, {'even' if even else 'random'}: {met:.3f}")
        assert met >= 0.9


def test_groups_of_near_copies(spark):
    rng = random.Random(22)
    rows = []
    for g in range(3):
        one = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows += [" ".join(edited(rng, one, rng.choice([0.97, 0.92, 0.88, 0.84]), False)) for _ in range(60)]
    rows = list(enumerate(rows))
    groups, find = brute_classes(rows)
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {(r[0], *groups[find(tuple(words(r[1])))]) for r in rows}


@pytest.mark.parametrize("tile", [512, 8])
def test_common_passage_makes_no_pairs_of_unlike_texts(spark, monkeypatch, tile):
    """Texts that meet by a passage that all have are not compared pair by pair, and no link among them is lost."""
    rng = random.Random(24)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = new(50)
    rows = [new(25) + passage + new(25) for _ in range(150)]
    rows += [edited(rng, rows[k], 0.82, True) for k in range(0, 60, 3)]
    for _ in range(3):
        one = new(25) + passage + new(25)
        rows += [edited(rng, one, rng.choice([0.97, 0.92, 0.88, 0.84]), False) for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    compared, verify = [], order_minhash._verify
    monkeypatch.setattr(order_minhash, "_verify", lambda pairs, texts: compared.append(pairs.count()) or verify(pairs, texts))
    monkeypatch.setattr(order_minhash, "TILE", tile, raising=False)
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups, find = brute_classes(rows)
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {(r[0], *groups[find(tuple(words(r[1])))]) for r in rows}
    print(compared)
    assert len(compared) == 2 and sum(compared) < 15 * len(rows)


def test_samples_do_not_depend_on_slices():
    import pyarrow as pa

    from folioflow.llm import kernel

    rng = random.Random(25)
    raw, offsets = kernel.utf8(pa.array([" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(300)]))
    ends = [0, 1, 2, 50, 51, 200, 300]

    def samples(lo, hi):
        _, _, codes, of = order_minhash.kmers(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        return order_minhash.sketches(codes, of, hi - lo)

    assert (samples(0, 300) == np.concatenate([samples(lo, hi) for lo, hi in zip(ends[:-1], ends[1:])])).all()


def test_near_duplicates(spark, hard, hard_rows, empty):
    groups, find = brute_classes(hard_rows)
    expected = Counter((r[0], *groups[find(tuple(words(r[1])))]) for r in hard_rows)
    got = order_minhash.classes(hard).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    kept = order_minhash.stage(hard)
    assert kept.columns == hard.columns and sorted((key(r.doc_id) for r in kept.collect()), key=str) == sorted((key(v[0]) for v in groups.values()), key=str)
    assert order_minhash.classes(empty).count() == 0 and order_minhash.stage(empty).count() == 0


# ---- 10 byte-level BPE


def test_byte_bpe(spark, hard, hard_rows, empty):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(hard))
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows.collect())
    assert got == Counter((r[0], tuple(plain.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in hard_rows)
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    rng = random.Random(1)
    letters = [0, 9, 10, 13, 28, 32, 32, 32, 0x85, 0xA0, 0x2028, 0x3000, 0x2581, 0x27, 0xE9, 0x4E00, 0x1F600, *range(0x30, 0x7B)]
    texts = ["".join(chr(rng.choice(letters)) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    ids, at = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain.encode_ordinary(t) for t in texts]

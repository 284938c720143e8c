"""Secret scans: base patterns, and a linear-chain conditional random field that tags further tokens.

Tokens are runs of letters, digits and ``+/_.=-`` or runs of other signs. The field tags each as outside, begin or
inside of a secret from its shape, length and class changes, the words around it and features of the whole text. It is
trained by gradient ascent on forward-backward marginals over windows of a bounded sample of texts (``SAMPLE_WITH`` and ``SAMPLE_WITHOUT``, in the order
of a hash of doc_id), labelled by the base patterns; weights are a fixed-size table that travels with the task.

Decoding is exact Viterbi over the whole text. A token whose score for "outside" leads by more than any transitions
could win back is outside on the best path, so only the stretches between such tokens are decoded, all of a slice at
once. Scanning is one pass without a shuffle. Null and empty texts have no spans. Without any base match in the sample
the field adds nothing. Rows that repeat are scanned each on its own; other columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import kernel
from folioflow.llm.frames import table, written
from folioflow.llm.registry import query

#: Texts looked at for training, those of them with and without base matches that are used, and their characters.
SAMPLE_WITH, SAMPLE_WITHOUT, SAMPLE_CHARS = 1_200, 800, 16_000_000
WINDOW = 12
BITS = 16
ROUNDS = 80
KINDS = ["assign", "access", "hex", "crf"]

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = ("passw", "secret", "token", "api")
SPARK_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

_CLASS = np.full(256, 5, np.uint8)  # other signs
for _bytes, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"+/_.=-", 4)):
    _CLASS[list(_bytes)] = _kind
_CLASS[128:] = 2
_CLASS[list(kernel.BREAKS)] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def base_spans(text: str, may_hex: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if may_hex:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each token, in bytes."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    c = _CLASS[raw]
    group = np.where(c == 0, 0, np.where(c == 5, 2, 1)).astype(np.int8)
    new = np.ones(len(raw), bool)
    new[1:] = group[1:] != group[:-1]
    first = offsets[:-1]
    new[first[first < len(raw)]] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(raw))
    real = group[at] > 0
    starts, ends = at[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def features(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashed features of each token as places in the weight table; one row per token."""
    n = len(starts)
    c = _CLASS[raw]
    word = kernel.span_hashes(_LOWER[raw], starts, ends)
    run = np.ones(len(raw), bool)
    run[1:] = c[1:] != c[:-1]
    run[starts] = True
    run &= c > 0
    kept = np.flatnonzero(run)
    lo, hi = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    shape = kernel.span_hashes(c[kept], lo, np.minimum(hi, lo + 6))
    length = np.minimum(ends - starts, 60)
    size = np.where(length < 12, length, 12 + length // 8).astype(np.uint64)
    turns = np.minimum(hi - lo, 12).astype(np.uint64)
    of = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    digit, upper = of(c == 3), of(c == 1)
    digits = np.minimum(digit[ends] - digit[starts], 15).astype(np.uint64)
    uppers = np.minimum(upper[ends] - upper[starts], 7).astype(np.uint64)
    total = np.maximum(np.diff(offsets), 1)
    share = (10 * (digit[offsets[1:]] - digit[offsets[:-1]]) // total).astype(np.uint64)
    signs = of(c == 5)
    noisy = (10 * (signs[offsets[1:]] - signs[offsets[:-1]]) // total).astype(np.uint64)
    nothing = np.uint64(0x51ED270B)

    def beside(x: np.ndarray, step: int) -> np.ndarray:
        out = np.full(n, nothing)
        if n > abs(step):
            src, dst = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            same = owner[src] == owner[dst]
            out[dst] = np.where(same, x[src], nothing)
        return out

    before = beside(word, 1)
    parts = [
        shape,
        size,
        size * np.uint64(64) + turns,
        digits * np.uint64(64) + turns,
        uppers * np.uint64(64) + size,
        word,
        before,
        beside(word, 2),
        beside(word, 3),
        beside(word, -1),
        beside(shape, 1),
        beside(shape, -1),
        (share[owner] * np.uint64(16) + noisy[owner]) * np.uint64(64) + np.minimum(size, np.uint64(24)) // np.uint64(6),
        before ^ size,
    ]
    out = np.empty((n, len(parts)), np.int32)
    with np.errstate(over="ignore"):
        for k, x in enumerate(parts):
            out[:, k] = kernel.mix(x + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return out


class Model(NamedTuple):
    weights: np.ndarray | None  # places x 3
    moves: np.ndarray  # from x to; outside, begin, inside


def viterbi(emit: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best states of every text's token sequence, exact."""
    n = len(emit)
    states = np.zeros(n, np.int8)
    bound = 2 * (moves.max() - moves.min())
    open_ = np.flatnonzero(emit[:, 0] - emit[:, 1:].max(axis=1) <= bound)
    if not len(open_):
        return states
    new = np.ones(len(open_), bool)
    new[1:] = (open_[1:] != open_[:-1] + 1) | (owner[open_[1:]] != owner[open_[:-1]])
    first = open_[new]
    size = np.diff(np.append(np.flatnonzero(new), len(open_)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    start = (first == 0) | (owner[first] != owner[first - 1])
    last = first + size - 1
    stop = (last == n - 1) | (owner[last] != owner[np.minimum(last + 1, n - 1)])
    score = emit[first] + np.where(start[:, None], 0.0, moves[0])
    back = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))
        step = score[:live, :, None] + moves
        best = step.argmax(axis=1).astype(np.int8)
        score[:live] = np.take_along_axis(step, best[:, None, :].astype(np.int64), 1)[:, 0] + emit[first[:live] + t]
        back.append(best)
    state = (score + np.where(stop[:, None], 0.0, moves[:, 0])).argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        states[first[:live] + t] = state[:live]
        if t:
            state[:live] = back[t - 1][np.arange(live), state[:live]]
    return states


def tag(raw: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text of the spans that the field finds."""
    starts, ends, owner = tokens(raw, offsets)
    if model.weights is None or not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    places = features(raw, offsets, starts, ends, owner)
    emit = np.zeros((len(starts), 3), np.float64)
    for k in range(places.shape[1]):
        emit += model.weights[places[:, k]]
    state = viterbi(emit, owner, model.moves)
    inside = np.zeros(len(state), bool)
    inside[1:] = (state[1:] == 2) & (state[:-1] > 0) & (owner[1:] == owner[:-1])
    head = np.flatnonzero((state > 0) & ~inside)
    tail = np.flatnonzero((state > 0) & ~np.append(inside[1:], False))
    return starts[head], ends[tail], owner[head]


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, states and mask of training windows, all of one length."""
    raw, offsets = kernel.utf8(pa.array(texts, pa.string()))
    starts, ends, owner = tokens(raw, offsets)
    places = features(raw, offsets, starts, ends, owner)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    state = np.zeros(len(starts), np.int8)
    centres = []
    for k, t in enumerate(texts):
        lo, hi = np.searchsorted(owner, [k, k + 1])
        at = points[starts[lo:hi]] - points[offsets[k]]
        to = points[ends[lo:hi]] - points[offsets[k]]
        found = base_spans(t)
        for a, b, kind in found:
            if kind == "assign":  # the value, not the name before it
                a = next(m.start(2) for m in ASSIGN.finditer(t, a) if m.end() == b)
            hit = lo + np.flatnonzero((at < b) & (to > a))
            state[hit] = np.where(np.arange(len(hit)) == 0, 1, 2)
            centres += list(hit[:1])
        if hi > lo:  # negative windows, spread evenly
            centres += list(range(lo, hi, max(1, (hi - lo) // 4)))
    centres = np.array(sorted(set(map(int, centres))))
    span = np.arange(-WINDOW, WINDOW + 1)
    index = np.clip(centres[:, None] + span, 0, len(starts) - 1)
    mask = (centres[:, None] + span == index) & (owner[index] == owner[centres][:, None])
    return places[index], np.where(mask, state[index], 0), mask


def train(places: np.ndarray, state: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS, penalty: float = 2e-4) -> Model:
    """AdaGrad on the conditional log-likelihood; marginals by forward-backward in the log domain."""
    n, width, k = places.shape
    w, moves = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    grown, moved = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    flat = places[mask]
    gold = np.zeros((n, width, 3))
    np.put_along_axis(gold, state[:, :, None].astype(np.int64), 1.0, 2)
    gold *= mask[:, :, None]
    pair = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1] * pair[:, :, None], gold[:, 1:])
    logsum = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    total = mask.sum()
    for _ in range(rounds):
        emit = np.zeros((n, width, 3))
        emit[mask] = w[flat].sum(axis=1)
        ahead, behind = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, width):
            step = logsum(ahead[:, t - 1, :, None] + moves, 1)
            ahead[:, t] = emit[:, t] + np.where(pair[:, t - 1, None], step, 0.0)
        for t in range(width - 2, -1, -1):
            step = logsum(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(pair[:, t, None], step, 0.0)
        both = ahead + behind
        p = np.exp(both - logsum(both, 2)[:, :, None]) * mask[:, :, None]
        joint = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :]
        joint = np.exp(joint - logsum(joint.reshape(n, width - 1, 9), 2)[:, :, None, None]) * pair[:, :, None, None]
        error = ((p - gold)[mask]) / total
        g = np.stack([np.bincount(flat.ravel(), np.repeat(error[:, s], k), minlength=1 << BITS) for s in range(3)], 1) + penalty / total * w
        gm = (joint.sum(axis=(0, 1)) - gold_moves) / total + penalty / total * moves
        grown += g * g
        moved += gm * gm
        w -= 0.3 * g / np.sqrt(grown)
        moves -= 0.1 * gm / np.sqrt(moved)
    return Model(w.astype(np.float32), moves)


def fit(docs: DataFrame) -> Model:
    """Train on a bounded sample of the texts with and one of those without base matches, both chosen from all texts."""
    order = F.xxhash64("doc_id", F.lit("secret"))
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").withColumn("_x", F.xxhash64("text"))
    # The patterns run once over all texts; the texts of the chosen rows are then found by their keys.
    flags = written(rows.select("doc_id", "_x", F.col("text").rlike(SPARK_BASE).alias("_with")), "flags")
    sizes = ((True, SAMPLE_WITH), (False, SAMPLE_WITHOUT))
    ids = [flags.filter(F.col("_with") == flag).distinct().orderBy(order, "_x").limit(n) for flag, n in sizes]
    rows = rows.join(F.broadcast(ids[0].unionByName(ids[1])), ["doc_id", "_x"])
    sample = written(rows.dropDuplicates(["doc_id", "_x"]), "sample")
    taken = []
    for flag, _ in sizes:
        size = 0
        for r in sample.filter(F.col("_with") == flag).orderBy(order, "_x").select("text").toLocalIterator():
            size += len(r.text)
            if size > SAMPLE_CHARS // 2:
                break
            taken.append(r.text)
    if not any(base_spans(t) for t in taken):
        return Model(None, np.zeros((3, 3)))
    parts = [_windows(taken[lo : lo + 200]) for lo in range(0, len(taken), 200)]
    parts = [p for p in parts if len(p[0])]
    places, state, mask = (np.concatenate(x) for x in zip(*parts))
    limit = 12_000  # windows; those with a secret first
    order = np.argsort(~(state > 0).any(axis=1), kind="stable")[:limit]
    return train(places[order], state[order], mask[order])


def spans_of(texts: pa.Array, model: Model) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: base spans, and those of the field that touch none of them."""
    raw, offsets = kernel.utf8(texts)
    plain = texts.to_pylist()
    out: list[list] = [[] for _ in plain]
    for lo, hi in kernel.slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = raw[offsets[lo] : offsets[hi]]
        # Texts with a long run of hexadecimal digits; a run ends where its text ends.
        new = np.ones(len(part) + 1, bool)
        new[1:-1] = _HEX[part[1:]] != _HEX[part[:-1]]
        new[at] = True
        run = np.flatnonzero(new)
        long_ = run[:-1][(np.diff(run) >= LEAST["hex"]) & _HEX[part[run[:-1]]]]
        hexed = set((np.searchsorted(at, long_, "right") - 1).tolist())
        for k in range(lo, hi):
            if plain[k]:
                out[k] = base_spans(plain[k], k - lo in hexed)
        starts, ends, owner = tag(part, at, model)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        for a, b, k in zip(points[starts] - points[at[owner]], points[ends] - points[at[owner]], owner):
            own = out[lo + k]
            if not any(a < y and x < b for x, y, _ in own):
                own.append((int(a), int(b), "crf"))
        for k in set(owner.tolist()):
            out[lo + k].sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """The input's other columns and ``spans``, an array of (start, end, kind) in code points, end exclusive."""
    keep = [c for c in docs.columns if c not in ("text", "spans")]
    rows = docs.select(F.col("text").alias("__text"), *keep)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                found = spans_of(part.column(0), model)
                listed = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], listed], names=schema.names)

    return rows.mapInArrow(run, schema)


@query("op6_secret_scan")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = joined(F.filter("spans", lambda s: s["kind"] != "crf"))
    return rows.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

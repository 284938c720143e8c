"""Quality rules: counted base rules, then a hashed n-gram logistic regression with calibrated probabilities.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of doc_id, so the same rows each
time): four fifths fit the weights, the rest calibrates them (Platt scaling). Everything else reads all rows and whole
texts: counts and scores are computed in Arrow batches in the scan, without a shuffle. The weights, one fixed-size table
of ``2**BITS`` numbers, travel with the task.

A document is kept if the base rules hold and the probability of good quality is at least ``THRESHOLD``. Null and empty
texts have no words and fail the base rules. Rows whose label or doc_id is null are not learnt from. Without labels of both
classes the probability is 1. Rows that repeat are scored alike, each on its own; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import kernel, linear
from folioflow.llm.frames import table
from folioflow.llm.registry import query

#: Labelled rows of each class that the model is fitted on at most, and the characters of text they may hold together.
SAMPLE = 2_000
SAMPLE_CHARS = 12_000_000
BITS = 17
ROUNDS = 120
PENALTY = 1e-5
THRESHOLD = 0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = "".join(map(chr, kernel.BREAKS))

#: Bytes of text that are measured and scored at once.
SLICE = 250_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Model(NamedTuple):
    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The calibrated probability of good quality."""
        if self.weights is None:
            return np.ones(len(offsets) - 1)
        z = linear.margins(raw, offsets, self.weights, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    worded = [line for line in lines if line.strip(BLANKS)]
    return len(worded) - len(set(worded))


def repeat_words(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a window of five words found twice or more in it."""
    codes, at = kernel.windows(hashes, owner, WINDOW)
    if not len(codes):
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        key = codes ^ kernel.mix(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    twin = np.zeros(len(key), bool)
    equal = ranked[1:] == ranked[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    first = at[order[twin]]
    covered = np.zeros(len(hashes), bool)
    for j in range(WINDOW):
        covered[first + j] = True
    return np.bincount(owner, covered, minlength=n).astype(np.int64)


def measure(texts: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """The counts and the probability of every text."""
    raw, offsets = kernel.utf8(texts)
    n = len(offsets) - 1
    out = {name: np.zeros(n, np.int64) for name in COUNTS}
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    for lo, hi in kernel.slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, owner = kernel.words(part, at)
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        out["n_words"][lo:hi] = kernel.count_by(owner, hi - lo)
        out["word_chars"][lo:hi] = sums(~kernel.IS_BREAK[part] & ((part & 0xC0) != 0x80))
        out["n_symbols"][lo:hi] = sums(symbol[part])
        out["n_repeat_words"][lo:hi] = repeat_words(kernel.span_hashes(part, starts, ends), owner, hi - lo)
    out["n_dup_lines"][:] = [dup_lines(t) if t else 0 for t in texts.to_pylist()]
    out["probability"] = model.probability(raw, offsets)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit and calibrate on at most ``sample`` labelled rows of each class."""
    good = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    chosen = good.filter("quality = 0").orderBy(order).limit(sample).unionByName(good.filter("quality = 1").orderBy(order).limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id", F.lit("quality")))
    # The bound on characters is a bound on the driver's memory: rows are taken in hash order until it is full.
    taken, size = [], 0
    for r in rows.toLocalIterator():
        taken.append(r)
        size += len(r.text)
        if size > SAMPLE_CHARS:
            break
    y = np.array([r.quality for r in taken])
    hold = np.arange(len(y)) % 5 == 4
    if min((y[~hold] == 1).sum(initial=0), (y[~hold] == 0).sum(initial=0)) == 0:
        return Model(None, 0.0, 1.0, 0.0)
    raw, offsets = kernel.utf8(pa.array([t.text for t, h in zip(taken, hold) if not h]))
    weights, bias = linear.fit(raw, offsets, y[~hold], BITS, ROUNDS, PENALTY)
    raw, offsets = kernel.utf8(pa.array([t.text for t, h in zip(taken, hold) if h], pa.string()))
    slope, offset = linear.calibrate(linear.margins(raw, offsets, weights, bias), y[hold])
    return Model(weights.astype(np.float32), bias, slope, offset)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The input with the five counts, base_failed, the probability and kept, which replace columns of these names."""
    added = [T.StructField(c, T.LongType()) for c in COUNTS]
    added += [T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo, hi in kernel.slices(kernel.utf8(batch.column(at))[1], SLICE):
                part = batch.slice(lo, hi - lo)
                m = measure(part.column(at), model)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
                kept = ~failed & (m["probability"] >= threshold)
                columns = [*part.columns, *(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(m["probability"]), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    columns = docs.columns
    inner = docs.toDF(*(f"in_{k}" for k in range(len(columns))))
    # The text goes to the tasks once, under the name it has there.
    rows = score(inner, fit(docs, labels), text=f"in_{columns.index('text')}").filter("kept")
    return rows.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(columns)))


@query("op1_quality_rules")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).drop("text")

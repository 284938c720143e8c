"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, maps look-alike letters of other scripts and digits that stand for letters to plain ones, and turns
everything else into blanks. Lexicon entries are word beginnings and whole words whose share of toxic documents is
significantly above that of clean ones; an entry weighs its log ratio. Exception phrases are words, alone or with the
word before, that hold an entry but are at home in clean documents; entries inside them do not count. A text's
score is a logistic function of its weight and of its weight per word.

The lexicon is learnt from a bounded sample of labelled rows (``SAMPLE`` of each class, in the order of a hash of
doc_id); counting is spread over tasks and only significant entries reach the driver. Scoring reads every whole text in
the scan, without a shuffle. Null and empty texts score as texts without any entry. Label, language, source and doc_id
are not inputs of the score. Labels other than 0 and 1 and null doc_ids are not learnt from; without both classes all
texts score 0. Repeated rows are scored each on its own; other columns are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.frames import table, written
from folioflow.llm.registry import query

#: Labelled rows of each class that the lexicon is learnt from at most.
SAMPLE = 6_000
#: Word beginnings of these lengths may be entries.
STEMS = range(3, 9)
#: G squared that an entry needs, its least log ratio, and the toxic documents it must be in.
SIGNIFICANT, LEAST_RATIO, LEAST_DOCS = 30.0, 2.0, 4
PHRASE_DOCS = 3

# Look-alikes of Latin letters, and digits or signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнɑαβεικνορτυχ", "aeopcyxijsdhkmtbhaabeiknoptux"))
DIGITS = dict(zip("01345789", "oieastbg"))
SIGNS = dict(zip("@$!", "asi"))


def _fold_table() -> np.ndarray:
    out = np.full(1 << 16, 0x20, np.uint32)
    for cp in range(1 << 16):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            out[cp] = cp
    for source, plain in {**LOOKALIKES, **DIGITS}.items():
        out[ord(source)] = ord(plain)
    for wide in range(26):  # full-width letters
        out[0xFF41 + wide] = ord("a") + wide
    return out


_FOLD = _fold_table()


def fold(text: str) -> str:
    """The folded text: letters and single-character blanks, with a blank at both ends."""
    cp = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    out = _FOLD[np.minimum(cp, 0xFFFF)]
    out[cp > 0xFFFF] = 0x20
    letter = np.zeros(len(out), bool)
    letter[:-1] = out[1:] != 0x20
    for sign, plain in SIGNS.items():
        out[(cp == ord(sign)) & letter] = ord(plain)
    return out.tobytes().decode("utf-32-le")


class Model(NamedTuple):
    entries: dict[str, float]
    phrases: list[str]
    slope: tuple[float, float]
    bias: float

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.phrases:
            machine.add_word(phrase, (len(phrase), 0.0))
        machine.make_automaton()
        return machine

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.slope[0] * np.log1p(weight) + self.slope[1] * np.log1p(100 * weight / np.maximum(words, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hits(machine: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
    """Entries in a folded text as (start, end, weight), without those inside an exception phrase."""
    if not len(machine):
        return []
    found = [(end + 1 - n, end + 1, w) for end, (n, w) in machine.iter(folded)]
    spared = [(a, b) for a, b, w in found if w == 0]
    return [(a, b, w) for a, b, w in found if w > 0 and not any(x <= a and b <= y for x, y in spared)]


def _weigh(machine: ahocorasick.Automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list]]:
    """Weight, words and hits of each text."""
    weight, words, spans = np.zeros(len(texts)), np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        folded = fold(t) if t else ""
        found = hits(machine, folded)
        weight[k], words[k] = sum(w for _, _, w in found), len(folded.split())
        spans.append(found)
    return weight, words, spans


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """In how many toxic and clean documents each key of ``keys_of(text)`` occurs; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                both = (Counter(), Counter())
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    both[y].update(keys_of(t))
                keys = list(both[0] | both[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array([both[0][k] for k in keys], pa.int64())],
                    names=["key", "toxic", "clean"],
                )

    parts = rows.select("text", "label").mapInArrow(run, "key string, toxic long, clean long")
    return parts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beginnings(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w[:n]}" for w in words for n in STEMS if n <= len(w)} | {f" {w} " for w in words if len(w) > 1}


def _g2(t: int, c: int, n_t: int, n_c: int) -> float:
    """The log-likelihood ratio of independence of word and class."""
    n = n_t + n_c
    cells = ((t, n_t * (t + c)), (c, n_c * (t + c)), (n_t - t, n_t * (n - t - c)), (n_c - c, n_c * (n - t - c)))
    return 2 * sum(o * math.log(o * n / e) for o, e in cells if o and e)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and label of at most ``sample`` labelled rows of each class."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit("toxic"))
    chosen = usable.filter("label = 1").orderBy(order).limit(sample).unionByName(usable.filter("label = 0").orderBy(order).limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").select("text", "label")


def fit(rows: DataFrame) -> Model:
    """Lexicon, exceptions and calibration from rows of text and label."""
    rows = written(rows, "toxic-sample")
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = size.get(1, 0), size.get(0, 0)
    if not n_t or not n_c:
        return Model({}, [], (0.0, 0.0), -30.0)
    ratio = lambda t, c: math.log((t + 0.5) / (n_t + 1)) - math.log((c + 0.5) / (n_c + 1))
    often = _counted(rows, _beginnings).filter(
        (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * n_c > 4 * F.col("clean") * n_t)
    )
    ranked = sorted(
        ((_g2(r.toxic, r.clean, n_t, n_c), ratio(r.toxic, r.clean), r.key) for r in often.collect()),
        key=lambda x: (-round(x[0], 6), len(x[2]), x[2]),
    )
    entries: dict[str, float] = {}
    for g2, weight, key in ranked:
        stem = key.rstrip()
        related = any(stem.startswith(e.rstrip()) or e.startswith(stem) for e in entries)
        if g2 >= SIGNIFICANT and weight >= LEAST_RATIO and not related:
            entries[key] = weight
    bare = Model(entries, [], (1.0, 0.0), 0.0)

    def holders(text: str) -> set[str]:
        folded, out = fold(text), set()
        for a, _, _ in hits(bare.automaton(), folded):
            end = folded.find(" ", a + 1)
            before = folded.rfind(" ", 0, len(folded[:a].rstrip()))
            out |= {folded[a : end + 1], folded[max(before, 0) : end + 1]}
        return out

    homely = _counted(rows, holders).filter(F.col("clean") >= PHRASE_DOCS) if entries else None
    phrases = sorted(r.key for r in homely.collect() if ratio(r.toxic, r.clean) < 0 and r.key not in entries) if entries else []
    model = Model(entries, phrases, (1.0, 0.0), 0.0)
    seen = score(rows.withColumn("_label", F.col("label")), model).select("weight", "words", "_label").toPandas()
    x = np.stack([np.log1p(seen.weight), np.log1p(100 * seen.weight / np.maximum(seen.words, 1)), np.ones(len(seen))], 1)
    y = seen._label.to_numpy(float)
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * s[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (p - y) + 0.05 * beta)
        beta -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
    return Model(entries, phrases, (float(beta[0]), float(beta[1])), float(beta[2]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The input's other columns with weight, words, hits (entries with their place in the folded text) and score.

    Input columns with the names of results are replaced.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    added = [T.StructField("weight", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("score", T.DoubleType())]
    keep = [c for c in docs.columns if c not in {"text", *(f.name for f in added)}]
    rows = docs.select(F.col("text").alias("__text"), *keep)
    schema = T.StructType([*rows.schema.fields[1:], *added])
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                weight, words, spans = _weigh(machine, part.column(0).to_pylist())
                listed = pa.array([[{"start": a, "end": b, "weight": w} for a, b, w in s] for s in spans], hit_type)
                columns = [*part.columns[1:], pa.array(weight), pa.array(words), listed, pa.array(model.score(weight, words))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out() -> Column:
    """True for the fifth of rows that labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = table(spark, sf_dir, "labels").filter(~held_out())
    rows = score(docs, fit(sample_rows(docs, learnt)))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "weight",
        F.size("hits").cast("long").alias("n_hits"),
    )

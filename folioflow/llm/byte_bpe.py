"""Byte-level BPE by a SentencePiece model that is serialised straight from a rank file.

Nothing is trained. Every token of the rank file becomes a piece whose bytes are mapped to printable characters and
whose score is its negative rank, so SentencePiece merges in rank order; normalisation is the identity. Texts are cut
into pre-tokens by the vocabulary's pattern, each distinct pre-token is encoded once per task (the memory of encoded
pre-tokens is bounded and refilled), and ids are decoded by the inverse mapping.

Nulls encode like empty texts: no ids. Other columns stay as they are, but an input column with the name of a result is
replaced. Rows that repeat are encoded each on its own; an empty table stays empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.registry import query
from folioflow.llm.frames import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct units remembered by a worker; when full, the memory starts anew.
REMEMBERED = 250_000
#: Any sign of white space that is neither a single blank nor a single line feed inside the text; the first ones stand alone.
ODD_SPACE = [*map(chr, (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C)))]
ODD_SPACE += [*map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)), "  ", " \n", "\n ", "\n\n"]
GROUP = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_letters() -> list[str]:
    """A printable, distinct character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Field numbers are those of the public sentencepiece_model.proto."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for token in order:
        piece = "".join(letters[b] for b in token).encode()
        score = np.float32(-ranks[token]).tobytes()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + score + _field(3, 1))
    out += _field(1, _field(1, "<unk>".encode()) + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _field(3, 2))
    unknown = len(order)
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown)
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encoder and decoder of one rank file.

    A text is cut at blanks and line feeds into units, which are whole runs of pre-tokens: the pattern always starts a
    pre-token at a blank or single line feed between other characters. Texts with any other white space are cut by the
    pattern itself. Encoded units are remembered, so a repeated unit costs one look-up.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self._model = None
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    @property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        """Built when something is encoded; decoding does without it."""
        if self._model is None:
            self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        return self._model

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pretokens: dict[str, tuple[int, ...]] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in ODD_SPACE):
            return self.split(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def learn(self, new: list[str]) -> None:
        """Encode units that are not remembered yet."""
        parts = [self.split(u) for u in new]
        fresh = list(set(chain.from_iterable(parts)).difference(self.pretokens))
        raws = [p.encode() for p in fresh]
        merged = [k for k, r in enumerate(raws) if r not in self.ranks]
        mapped = [raws[k].decode("latin-1").translate(self.letters) for k in merged]
        self.pretokens.update((p, (self.ranks[r],)) for p, r in zip(fresh, raws) if r in self.ranks)
        self.pretokens.update((fresh[k], tuple(ids)) for k, ids in zip(merged, self.model.encode(mapped, num_threads=1)))
        get = self.pretokens.__getitem__
        encoded = [get(part[0]) if len(part) == 1 else tuple(chain.from_iterable(map(get, part))) for part in parts]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids start."""
        if len(self.index) > REMEMBERED:
            self.forget()
        split = [self.units(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.index))
        for lo in range(0, len(new), 20_000):
            self.learn(new[lo : lo + 20_000])
        n_units = np.array([len(u) for u in split], np.int64)
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(n_units.sum()))
        sizes = self.at[which + 1] - self.at[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.at[which] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[source], ends[np.concatenate([[0], np.cumsum(n_units)])]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self.ends[ids] - ends, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.joined[source]


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(path: str, pattern: str) -> Codec:
    """One codec for each Python worker, kept between its tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _nested(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return batch.append_column(name, column)


def encode(docs: DataFrame, out: str = "ids", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add the token ids of each whole text as ``out``, an array of int; null and empty texts have none."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    pattern = public_tokenizers.PATTERN
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), GROUP):
                part = batch.slice(lo, GROUP)
                flat, at = codec.encode(part.column(part.schema.get_field_index(text)).to_pylist())
                yield _nested(part, out, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)))

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, out: str = "decoded", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add the bytes that the ids stand for as ``out`` (binary); null ids decode to nothing."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    pattern = public_tokenizers.PATTERN
    encoded = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), GROUP):
                part = batch.slice(lo, GROUP)
                lists = part.column(part.schema.get_field_index(ids))
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(codec.sizes[flat])])[at].astype(np.int64)
                data = codec.decode(flat)
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield _nested(part, out, column.cast(pa.binary()))

    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, *keep: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, one row for each row of the input."""
    rows = decode(encode(docs.select(*keep, "text")).drop("text"))
    return rows.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(docs: DataFrame, *keep: str) -> DataFrame:
    """The last pipeline stage: each document with its ids, the digest of what they decode to and the columns to keep."""
    encoded = encode(docs.select("doc_id", "source", "lang", *keep, "text"))
    rows = decode(encoded.drop("text"))
    return rows.select(
        "doc_id",
        "source",
        "lang",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *keep,
    )


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), "doc_id")

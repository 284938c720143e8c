"""Helpers for Arrow batches of texts: UTF-8 buffers, words and rolling hashes as numpy arrays.

Nothing here knows Spark; operators call these inside ``mapInArrow``. Batches are cut into slices of whole
texts of about ``SLICE`` bytes, so memory follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2_000_000
#: Words that are counted at once.
COLUMNS = 2048
#: Words are what lies between these bytes: blank, tab, line feed, vertical tab, form feed, carriage return.
BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and where each text starts; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in bytes, and the index of its text."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_BREAK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1]] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge[len(raw)] = True
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = power_tables(max(len(raw), 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_CODE[raw] * power[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row inside one text, and the index of each window's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1 : width - 1 + n])
    return mix(out[at]), at


def count_by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def identity(word: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each text's word sequence, in two halves."""
    size = count_by(owner, n)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = (np.arange(len(word)) - np.repeat(first, size)).astype(np.uint64)
    halves = []
    with np.errstate(over="ignore"):
        for salt in (0x165667B19E3779F9, 0x27D4EB2F165667C5):
            total = np.zeros(len(word) + 1, np.uint64)
            np.cumsum(mix((word ^ np.uint64(salt)) + mix(place + np.uint64(salt))), out=total[1:])
            halves.append(mix(total[first + size] - total[first] + size.astype(np.uint64)).view(np.int64))
    return halves[0], halves[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def shared_words(around: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words the lists left and right (of 16-bit word codes) have in common at most, for all pairs; a word counts as often as it occurs in both."""
    code = np.frombuffer(b"".join(around), np.uint16).astype(np.int64)
    size = np.array([len(w) // 2 for w in around])
    owner = np.repeat(np.arange(len(around)), size)
    order = np.lexsort((code, owner))
    code = code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    group = np.flatnonzero(new)
    nth = np.arange(len(code)) - np.repeat(group, np.diff(np.append(group, len(code))))
    _, column, count = np.unique(code << 32 | nth, return_inverse=True, return_counts=True)
    often = count > 1
    place = (np.cumsum(often) - 1)[column]
    shared = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        here = often[column] & (place >= lo) & (place < lo + COLUMNS)
        has = np.zeros((len(around), min(COLUMNS, int(often.sum()) - lo)), np.float32)
        has[owner[here], place[here] - lo] = 1
        shared += has[left] @ has[right].T
    return shared

"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes of one class. Both classes used here hold all bytes from 0x80 on, so
words found in UTF-8 bytes are the words found in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(excluded) -> np.ndarray:
    keep = np.ones(256, dtype=bool)
    keep[list(excluded)] = False
    return keep


#: [^\x20\x09-\x0D]
NON_SPACE = _class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
LETTERS = _class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """hash, start, end: per word, start and end in the bytes of all texts; first: per text, its first word's index, and the total at the end."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of size words within a text, and per text the index of its first run."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            out = mix(out * np.uint64(_BASE) + self.hash[at + j])
        return out, first


def words(texts: pa.Array, kind: np.ndarray = NON_SPACE) -> Words:
    """The words of a large_string array without nulls, A-Z taken as a-z."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    low, high = int(off[0]), int(off[-1])
    body = texts.buffers()[2] if n else None
    data = _LOWER[np.frombuffer(body, dtype=np.uint8)[low:high]] if high > low else np.zeros(0, np.uint8)
    off = off - low
    inside = kind[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[off[:-1]] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[off[1:]] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    code = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(code, start, end, np.searchsorted(start, off), data)


def distinct_sets(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's codes, sorted and without repeats, and their offsets."""
    parts = [np.unique(codes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct size-word shingles of each text; a shorter text's whole sequence is one shingle."""
    codes, first = found.windows(size)
    short = [i for i, n in enumerate(np.diff(found.first)) if 0 < n < size]
    if short:
        parts, at = [], 0
        for i in short:
            a, b = found.first[i], found.first[i + 1]
            whole = np.full(1, b - a, dtype=np.uint64)
            for j in range(a, b):
                whole = mix(whole * np.uint64(_BASE) + found.hash[j : j + 1])
            parts += [codes[at : first[i]], whole]
            at = first[i]
        codes = np.concatenate([*parts, codes[at:]])
        first = first + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(first) - 1), short))])
    return distinct_sets(codes, first)


def lines(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each line that has words; a text's end ends a line."""
    if not len(found.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(found.first, np.arange(len(found.hash)), "right")
    line = np.searchsorted(np.flatnonzero(found.data == 10), found.start) + text
    cuts = np.flatnonzero(np.diff(line)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(line)]])


def anchors(found: Words, gram: int, reach: int) -> np.ndarray:
    """Words where the hash of gram words is the least of its text within reach words to both sides.

    Equal passages have equal anchors, but for those that lie within reach of a passage's ends.
    """
    codes, first = found.windows(gram)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least = np.ones(len(codes), dtype=bool)
    for d in range(1, min(reach, len(codes) - 1) + 1):
        apart = owner[d:] != owner[:-d]
        lower = codes[:-d] <= codes[d:]
        least[:-d] &= lower | apart
        least[d:] &= ~lower | apart
    at = np.flatnonzero(least)
    return at - first[owner[at]] + found.first[owner[at]]


def run_codes(found: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    power, inverse = _power_tables(len(found.hash) + 1)
    sums = np.zeros(len(found.hash) + 1, dtype=np.uint64)
    np.cumsum(mix(found.hash) * power[: len(found.hash)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def run_minhashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, count: int) -> np.ndarray:
    """count minima over codes[start:end] of each run, one row a run; runs are not empty but may overlap."""
    out = np.zeros((len(start), count), dtype=np.uint64)
    if len(start):
        salts = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
        ends = np.stack([start, end], axis=1).ravel()
        turned = np.zeros(len(codes) + 1, dtype=np.uint64)
        for j in range(count):
            np.multiply(codes ^ salts[2 * j], salts[2 * j + 1] | np.uint64(1), out=turned[:-1])
            out[:, j] = np.minimum.reduceat(turned, ends)[::2]
    return out


def sums_by_set(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the values of each set; 0 for an empty one."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def minhashes(values: np.ndarray, first: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """count minima for each set, one row a set; zeros for an empty set."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, count), dtype=np.uint64)
    if len(full):
        salts = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(seed << 20))
        for j in range(count):
            turned = (values ^ salts[2 * j]) * (salts[2 * j + 1] | np.uint64(1))
            out[full, j] = np.minimum.reduceat(turned, first[full])
    return out


def joined_rows(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix."""
    out = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = mix(out * np.uint64(_BASE) + rows[:, j])
    return out


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), int64(values))

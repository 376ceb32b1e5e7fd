"""Wavelet matrix of token ids: one file a shard, with access, counting and occurrence lookup.

File format, little-endian: the magic b"WVM1", version (u32), documents (u64), tokens (u64), planes
(u32), the length of the packed header (u64); then zlib-packed document ids (i64) and token offsets
(u64, one more than documents); then for each plane, from the highest bit, its number of zeros (u64),
the length of its packed bits (u64) and the bits, 8 a byte, zlib-packed where that is shorter. Ranks
are counted again on opening: one number for each 512 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_HEAD = struct.Struct("<4sIQQIQ")
_PLANE = struct.Struct("<QQ")
_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _pack(raw: bytes) -> bytes:
    packed = zlib.compress(raw, 1)
    return b"\x01" + packed if len(packed) < 0.9 * len(raw) else b"\x00" + raw


def _unpack(stored: bytes) -> bytes:
    return zlib.decompress(stored[1:]) if stored[:1] == b"\x01" else bytes(stored[1:])


def build(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, planes: int) -> bytes:
    """The file of a shard: ids of all documents in a row, document i from offsets[i]."""
    header = zlib.compress(doc_ids.astype("<i8").tobytes() + offsets.astype("<u8").tobytes(), 1)
    out = [_HEAD.pack(b"WVM1", 1, len(doc_ids), len(ids), planes, len(header)), header]
    for level in range(planes - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << level)).astype(bool)
        body = _pack(np.packbits(ones, bitorder="little").tobytes())
        zeros = ids.compress(~ones)
        out += [_PLANE.pack(len(zeros), len(body)), body]
        ids = np.concatenate([zeros, ids.compress(ones)])
    return b"".join(out)


class WaveletMatrix:
    """An opened file. Positions count tokens of the shard from 0."""

    def __init__(self, blob: bytes):
        magic, version, docs, self.size, self.planes, length = _HEAD.unpack_from(blob)
        if magic != b"WVM1" or version != 1:
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size
        header = zlib.decompress(blob[at : at + length])
        self.doc_ids = np.frombuffer(header, "<i8", docs)
        self.offsets = np.frombuffer(header, "<u8", docs + 1, 8 * docs).astype(np.int64)
        at += length
        self.zeros, self.bits, self._ranks = [], [], []
        for _ in range(self.planes):
            zeros, length = _PLANE.unpack_from(blob, at)
            at += _PLANE.size
            self.zeros.append(zeros)
            self.bits.append(np.frombuffer(_unpack(blob[at : at + length]), np.uint8))
            self._ranks.append(None)
            at += length

    def _rank(self, level: int, at: int) -> int:
        """Ones before position at in a plane."""
        if self._ranks[level] is None:
            counts = _ONES[self.bits[level]]
            counts = np.pad(counts, (0, -len(counts) % (_BLOCK // 8))).reshape(-1, _BLOCK // 8)
            self._ranks[level] = np.concatenate([[0], np.cumsum(counts.sum(axis=1, dtype=np.int64))])
        block, byte = at // _BLOCK, at // 8
        n = int(self._ranks[level][block]) + int(_ONES[self.bits[level][block * _BLOCK // 8 : byte]].sum())
        return n + (int(_ONES[self.bits[level][byte] & ((1 << at % 8) - 1)]) if at % 8 else 0)

    def _select(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a plane, by bisection on ranks."""
        low, high = 0, self.size
        while low < high:
            mid = (low + high) // 2
            n = self._rank(level, mid + 1)
            if (n if one else mid + 1 - n) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, at: int) -> int:
        """The token at a position."""
        value = 0
        for level in range(self.planes):
            one = self.bits[level][at // 8] >> (at % 8) & 1
            ones = self._rank(level, at)
            at = self.zeros[level] + ones if one else at - ones
            value = value << 1 | int(one)
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where a token's occurrences before stop lie after the last plane."""
        low, high = 0, stop
        for level in range(self.planes):
            a, b = self._rank(level, low), self._rank(level, high)
            if token >> (self.planes - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, stop: int | None = None) -> int:
        """Occurrences of a token before position stop, or in all."""
        if token >> self.planes:
            return 0
        low, high = self._range(token, self.size if stop is None else stop)
        return high - low

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.size)[0] + k
        for level in range(self.planes - 1, -1, -1):
            one = bool(token >> (self.planes - 1 - level) & 1)
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All tokens in order: planes are undone from the last to the first."""
        ids = np.zeros(self.size, dtype=dtype)
        for level in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits[level], count=self.size, bitorder="little").view(bool)
            zeros, back = self.zeros[level], np.empty_like(ids)
            back[~ones] = ids[:zeros]
            back[ones] = ids[zeros:] | dtype(1 << (self.planes - 1 - level))
            ids = back
        return ids

"""Vectorised word and line scanning over the UTF-8 bytes of an Arrow string column.

All separators used by the operators are ASCII, so scanning bytes and scanning code
points give the same words. Hashes are 64-bit: a polynomial over random byte values,
from prefix sums modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Prefix:
    """Prefix sums of a sequence of 64-bit values: hashes of any stretch in O(1)."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def byte_prefix(raw: np.ndarray) -> Prefix:
    return Prefix(_BYTE[raw])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, end to end, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts hold about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        _, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of every text: ``starts``/``ends`` in the bytes, ``doc`` (row), 64-bit ``hash``, ``first``/``count`` per row."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, alphabet: np.ndarray, fold: bool = True):
        low = LOWER[raw] if fold else raw
        inside = alphabet[low]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offs[:-1][offs[:-1] < len(raw)]
        begin[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        end[edges] = inside[edges]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.hash = byte_prefix(low).hash(self.starts, self.ends)
        self.count = np.bincount(self.doc, minlength=len(offs) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def grams(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all runs of ``m`` words within one text."""
        n = len(self.hash) - m + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:n] == self.doc[m - 1 :])
        return at, Prefix(self.hash).hash(at, at + m)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each stretch of ``w`` values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Lookup:
    """Membership and position of 64-bit values in a sorted list, with a bit table in front."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(U64))
        bits = max(10, min(24, int(len(self.keys) * 16).bit_length()))
        self.shift = U64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the values that are in the list, and their places in it."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(values >> self.shift).astype(np.int64)])
        place = np.searchsorted(self.keys, values[at])
        place[place == len(self.keys)] = 0
        good = self.keys[place] == values[at]
        return at[good], place[good]

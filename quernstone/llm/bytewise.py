"""Vectorised work on the UTF-8 bytes of many texts at once: words, hashes, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GAMMA)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(2 * n, CHUNK_BYTES) + 1
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask of the bytes in the closed ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Letters and digits of ASCII and every byte of a character beyond it.
ALNUM = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Whatever is not ASCII white space.
NON_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Texts:
    """Bytes of some texts laid end to end; start and stop index each text."""

    def __init__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: int):
        self.data, self.start, self.stop, self.first = data, start, stop, first

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes that don't cross texts: begin, end, and for each text the index
        of its first run (one more entry than texts)."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.start] = True
        edge[self.stop] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return begin, end, np.searchsorted(begin, np.append(self.start, n))

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, from differences of one running sum."""
        up, down = _powers_to(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _GAMMA)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value per byte over each text."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.stop] - total[self.start]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cuts a column of strings (nulls count as empty) into pieces of about limit bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        base = offs[i]
        yield Texts(raw[base : offs[j]], offs[i:j] - base, offs[i + 1 : j + 1] - base, i)
        i = j


def owners(first: np.ndarray) -> np.ndarray:
    """For each run the index of its text, from the first runs of the texts."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside one text: (index of the first word, hash)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= last)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out * _P + h[at + j] + np.uint64(j + 1))
    return at, out


def grouped(owner: np.ndarray, h: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs with their counts: owner, hash, count, and for each input its pair.
    bits are kept for the owner, the other high bits for the hash."""
    low = np.uint64(64 - bits)
    key = (owner.astype(np.uint64) << low) | (h >> np.uint64(bits))
    found, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return (found >> low).astype(np.int64), found & np.uint64((1 << int(low)) - 1), count, back

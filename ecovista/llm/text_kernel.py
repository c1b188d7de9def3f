"""Vectorised word splitting and hashing of many texts at once (numpy).

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Words and shingles become
64-bit hashes: two different words share one with a chance of about 2**-57.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes handled in one go; longer texts are cut at white space.
PIECE = 1 << 18
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240817))
_WEIGHT = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of texts in order: text i has words offsets[i]:offsets[i+1]; start and end are byte positions in it."""

    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def _pieces(texts: list[bytes]):
    """(text number, byte offset, piece): pieces end at white space unless one word is longer than PIECE."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE:
            cut = at + PIECE
            while cut < len(t) and not _SPACE[t[cut]]:
                cut += 1
            yield i, at, t[at:cut]
            at = cut
        yield i, at, t[at:] if at else t


def _groups(texts: list[bytes]):
    group, size = [], 0
    for piece in _pieces(texts):
        if group and size + len(piece[2]) > PIECE:
            yield group
            group, size = [], 0
        group.append(piece)
        size += len(piece[2]) + 1
    if group:
        yield group


def hash_words(texts: list[bytes]) -> Words:
    owners, hashes, starts, ends = [], [], [], []
    for group in _groups(texts):
        data = np.frombuffer(b"\n".join(p for _, _, p in group) + b"\n", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        first, last = edge[0::2], edge[1::2]
        if not len(first):
            continue
        length = last - first
        place = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
        weight = _WEIGHT[place & 4095]
        if length.max() > 4096:
            weight = weight * (2 * (place >> 12) + 1).astype(np.uint64)
        h = np.add.reduceat(_VALUE[data[first[0] :]] * weight, first - first[0])
        sizes = np.array([len(p) + 1 for _, _, p in group])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owner = np.searchsorted(begins, first, "right") - 1
        shift = np.array([o for _, o, _ in group])[owner] - begins[owner]
        owners.append(np.array([i for i, _, _ in group])[owner])
        hashes.append(mix(h + length.astype(np.uint64)))
        starts.append(first + shift)
        ends.append(last + shift)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    counts = np.bincount(cat(owners, np.int64), minlength=len(texts))
    return Words(np.concatenate(([0], np.cumsum(counts))), cat(hashes, np.uint64), cat(starts, np.int64), cat(ends, np.int64))


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the k-word shingles of every text by position; a text of 1 to k-1 words has its whole sequence as one."""
    h, counts = words.hashes, words.counts
    n = len(h)
    full = np.zeros(n, np.uint64)
    for j in range(k):
        part = h[j:] * _STEP[j]
        full[: n - j] += part
    room = np.repeat(words.offsets[1:], counts) - np.arange(n)
    keep = room >= k
    short = (counts > 0) & (counts < k)
    for i in np.flatnonzero(short):
        a, b = words.offsets[i], words.offsets[i + 1]
        full[a] = (h[a:b] * _STEP[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        keep[a] = True
    sizes = np.where(short, 1, np.maximum(counts - k + 1, 0))
    return np.concatenate(([0], np.cumsum(sizes))), mix(full[keep])


def distinct_sets(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(offsets) - 1)))), hashes[new]


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

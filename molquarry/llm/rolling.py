"""Hashes of words and of windows over them, for many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 21
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, x, _U)]), dtype=_U) for x in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about SLICE bytes: first and last index, their bytes, and where each begins and the last ends."""
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


#: Keys of the word hash; words of more than LONG bytes are hashed one by one.
_KEY, _STEP, LONG = _U(0x8D0E5A7C36F1B249), _U(0xD6E8FEB86659FD93), 64
_APART = np.zeros(256, bool)
_APART[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bytes of a block of eight that belong to a word with so many bytes left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A keyed hash of each word: its length and its blocks of eight bytes, mixed one after the other."""
    length = end - begin
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    hashes = mixed(length.astype(_U) * _STEP ^ _KEY)
    active = np.flatnonzero(length <= LONG)
    for k in range(0, LONG, 8):
        if k:
            active = active[length[active] > k]
        if not len(active):
            break
        block = eight[begin[active] + k] & _LEFT[np.minimum(length[active] - k, 8)]
        hashes[active] = mixed((hashes[active] ^ block) * _STEP + _KEY)
    for i in np.flatnonzero(length > LONG).tolist():
        digest = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8, key=_KEY.tobytes()).digest()
        hashes[i] = _U(int.from_bytes(digest, "little"))
    return hashes


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some texts begin and end, in order."""
    apart = _APART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.append(True, apart[:-1]), np.append(apart[1:], True)
    return np.flatnonzero(~apart & (edge[:-1] | before)), np.flatnonzero(~apart & (edge[1:] | after)) + 1


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of some texts, in order: the hash and the index of the text. ``lower`` takes A-Z as a-z."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    begin, end = word_bounds(data, offsets)
    hashes = _word_hashes(_LOWER[data] if lower else data, begin, end)
    return hashes, np.searchsorted(offsets, begin, side="right") - 1


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of every run of ``width`` words, whichever texts they are of."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    rng = np.random.default_rng(seed)
    total = np.zeros(n, _U)
    for k in range(width):
        total += hashes[k : k + n] * _U(int(rng.integers(1, 1 << 63)) * 2 + 1)
    return mixed(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values that follow each other, by doubling."""
    n, reach, low = len(x) - width + 1, 1, x
    if n <= 0:
        return x[:0]
    while reach * 2 <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    return np.minimum(low[:n], low[width - reach : width - reach + n])

"""Suffix arrays of byte strings by induced sorting, and their permuted common prefixes.

Suffixes are S or L as they are smaller or larger than the next one. The leftmost S suffixes of each run are
sorted by their substrings (induced from their first bytes), renamed, and sorted as a shorter string; all
other suffixes follow from them in one pass up and one pass down the buckets of first bytes. A pass takes a
bucket at a time and, inside it, the chain of equal first bytes in waves, so that each step is one operation
on whole arrays and the work is linear.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last one, the sentinel, is."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def _dealt(to: list[list[np.ndarray]], s: np.ndarray, positions: np.ndarray) -> None:
    """Positions put at the end of their first bytes' buckets, in order."""
    if not len(positions):
        return
    first = s[positions]
    order = np.argsort(first, kind="stable")
    positions, first = positions[order], first[order]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
    for part, c in zip(np.split(positions, cuts), first[np.append(0, cuts)].tolist(), strict=True):
        to[c].append(part)


def _chain(s: np.ndarray, wanted: np.ndarray, c: int, wave: np.ndarray) -> np.ndarray:
    """The bucket's first members, followed by those that precede them with the same byte, wave by wave."""
    waves = []
    while len(wave):
        waves.append(wave)
        before = wave[wave > 0] - 1
        wave = before[wanted[before] & (s[before] == c)]
    return np.concatenate(waves) if waves else wave


def _induced(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes, from the leftmost S suffixes in an order that holds within each bucket."""
    alphabet = range(int(s.max()) + 1)
    none = np.zeros(0, np.int64)
    lms: list[list[np.ndarray]] = [[] for _ in alphabet]
    up: list[list[np.ndarray]] = [[] for _ in alphabet]
    down: list[list[np.ndarray]] = [[] for _ in alphabet]
    _dealt(lms, s, leftmost)
    large = ~small
    for c in alphabet:
        own = _chain(s, large, c, np.concatenate(up[c])) if up[c] else none
        up[c] = [own]
        scanned = np.concatenate([own, *lms[c]])
        before = scanned[scanned > 0] - 1
        before = before[large[before]]
        _dealt(up, s, before[s[before] > c])
    for c in reversed(alphabet):
        own = _chain(s, small, c, np.concatenate(down[c])) if down[c] else none
        down[c] = [own]
        scanned = np.concatenate([own, up[c][0][::-1]])
        before = scanned[scanned > 0] - 1
        before = before[small[before]]
        _dealt(down, s, before[s[before] < c])
    # The sentinel precedes all and is induced by nothing.
    return np.concatenate([np.array([len(s) - 1])] + [x for c in alphabet for x in (up[c][0], down[c][0][::-1])])


def _ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order, by doubling the names' reach until they differ.

    ``order`` has them by their first name alone and ``new`` says where another name begins. A rank is the
    first place of a suffix's group, so that only groups of several are sorted again.
    """
    n, reach = len(order), 1
    order, new, place = order.copy(), new.copy(), np.arange(len(order))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    while len(tied := np.flatnonzero(~(new & np.append(new[1:], True)))):
        some = order[tied]
        ahead = some + reach
        key = rank[some] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        some, key = some[by_key], key[by_key]
        first = np.append(True, key[1:] != key[:-1])
        order[tied], new[tied] = some, first
        rank[some] = tied[np.maximum.accumulate(np.where(first, place[: len(tied)], 0))]
        reach *= 2
    return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of ``s`` (unsigned bytes that end with the only 0) in order."""
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induced(s, small, lms)
    index = np.full(len(s), -1)
    index[lms] = np.arange(len(lms))
    ordered = _induced(s, small, lms)
    ordered = ordered[index[ordered] >= 0]
    # Each of their substrings reaches to the next one; they are compared in full, by eight bytes at once.
    k = index[ordered]
    end = np.append(lms[1:], len(s) - 1)[k]
    length = end - ordered + 1
    same = length[1:] == length[:-1]
    common = common_prefix(s, ordered[1:][same], ordered[:-1][same], int(length.max()) + 8)
    same[same] = common >= length[1:][same]
    return _induced(s, small, lms[_ranked(k, np.append(True, ~same))])


def common_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes agree from each pair of positions on, up to ``most`` or the end of ``s``."""
    n = len(s)
    padded = np.append(s, np.zeros(16, np.uint8))
    eight = np.ndarray(n + 8, "<u8", padded, 0, (1,))
    out, left, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(left) and k < most:
        inside = np.minimum(np.maximum(a[left], b[left]) + k, n)
        differ = eight[np.minimum(a[left] + k, n)] ^ eight[np.minimum(b[left] + k, n)]
        whole = (differ == 0) & (inside < n)
        low = differ & (~differ + np.uint64(1))
        out[left] = k + np.where(whole, 8, np.where(differ == 0, 0, (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)))
        left, k = left[whole], k + 8
    return np.minimum(out, n - np.maximum(a, b))


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: the position just before it in the suffix array, and their common prefix.

    A prefix is one less than that of the position to the left, unless the bytes before the two differ; only
    those are compared.
    """
    before = np.full(len(s), -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(len(s))
    at = (before >= 0) & ((i == 0) | (before == 0) | (s[i - 1] != s[np.maximum(before, 1) - 1]))
    reach = np.zeros(len(s), np.int64)
    reach[at] = i[at] + common_prefix(s, i[at], before[at], len(s))
    return before, np.maximum(np.maximum.accumulate(reach) - i, 0)


def repeated(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, whether the ``width`` bytes from each position on start elsewhere too, in any of them.

    The strings are bytes of UTF-8, so that 0 and 1 are free once every byte is raised by two.
    """
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    lengths = np.array([len(x) for x in strings])
    ends = np.cumsum(lengths + 1) - 1
    s = np.append(joined + np.uint8(2), np.uint8(0))
    s[ends] = 1
    before, prefix = permuted_prefixes(s, suffix_array(s))
    rest = np.repeat(ends, lengths + 1) - np.arange(len(s) - 1)
    hit = np.flatnonzero((prefix[:-1] >= width) & (rest >= width))
    mark = np.zeros(len(s), bool)
    mark[hit] = True
    mark[before[hit]] = True
    return [mark[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]

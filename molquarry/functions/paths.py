"""Shortest paths of all molecules of a batch at once.

The atoms of a batch are the nodes of one block-diagonal graph. Each carries a row of bits, one for each atom of
its own molecule that it has reached; a step joins the rows of its neighbours. Molecules of more than LARGE atoms
have few new pairs a step compared with their rows, so these are followed as lists of pairs instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LARGE = 1024


class Paths:
    """Of each atom the distance to the farthest atom, and the sum of distances; of each molecule the pairs by distance.

    ``near`` has for each molecule the neighbours of each of its atoms, by their places in the molecule.
    Unreachable pairs count nowhere. ``counts`` holds the numbers of pairs at distance 1, 2, ... of one molecule
    after the other, ``longest`` how many these are; ``first`` and ``second`` the pairs themselves in the same
    order, as far as ``listed``, the longest distance whose pairs are wanted (None for all); ``listed_steps`` and
    ``listed_counts`` are the lengths of these lists.
    """

    def __init__(self, near: Sequence[Sequence[Sequence[tuple[int, int]]]], listed: int | None = 0):
        self.sizes = np.array([len(m) for m in near], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        total = int(self.begin[-1])
        self.farthest, self.sums = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self._listed = total if listed is None else listed
        #: Of each step: molecules and their numbers of pairs; molecules and atoms of the pairs.
        self._numbers: list[tuple[int, np.ndarray, np.ndarray]] = []
        self._pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if total:
            degrees = np.fromiter((len(x) for m in near for x in m), np.int64, total)
            flat = np.fromiter((b for m in near for x in m for b, _ in x), np.int64, int(degrees.sum()))
            owner = np.repeat(np.arange(total), degrees)
            slot = np.arange(len(flat)) - np.repeat(np.cumsum(degrees) - degrees, degrees)
            beside = np.repeat(np.arange(total)[:, None], max(int(degrees.max()), 1), axis=1)
            beside[owner, slot] = flat + np.repeat(self.begin[:-1], self.sizes)[owner]
            words = np.ceil(np.log2(np.maximum(1, -(-self.sizes // 64)))).astype(np.int64)
            small = (self.sizes > 0) & (self.sizes <= LARGE)
            for w in np.unique(words[small]):
                self._by_bits(np.flatnonzero(small & (words == w)), 1 << int(w), beside)
            for k in np.flatnonzero(self.sizes > LARGE):
                self._by_pairs(int(k), beside)
        self._gather(len(near))

    def _gather(self, n: int) -> None:
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        of = joined([m for _, m, _ in self._numbers])
        step = joined([np.full(len(m), s) for s, m, _ in self._numbers])
        order = np.lexsort((step, of))
        self.longest = np.bincount(of, minlength=n)
        self.counts = joined([c for _, _, c in self._numbers])[order]
        shown = step[order] <= self._listed
        self.listed_counts = self.counts[shown]
        self.listed_steps = np.bincount(of[order][shown], minlength=n)
        of = joined([m for _, m, _, _ in self._pairs])
        order = np.lexsort((joined([np.full(len(m), s) for s, m, _, _ in self._pairs]), of))
        self.first, self.second = (joined([p[k] for p in self._pairs])[order] for k in (2, 3))

    def _by_bits(self, molecules: np.ndarray, words: int, beside: np.ndarray) -> None:
        sizes = self.sizes[molecules]
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(molecules)), sizes)
        place = np.arange(len(of)) - starts[of]
        atoms = self.begin[molecules][of] + place
        here = np.zeros(int(self.begin[-1]), np.int64)
        here[atoms] = np.arange(len(atoms))
        steps_to = here[beside[atoms]]
        reached = np.zeros((len(atoms), words), np.uint64)
        reached[np.arange(len(atoms)), place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
        step = 0
        while True:
            step += 1
            joined = reached[steps_to[:, 0]]
            for c in range(1, steps_to.shape[1]):
                joined |= reached[steps_to[:, c]]
            fresh = joined & ~reached
            count = np.bitwise_count(fresh).sum(axis=1).astype(np.int64)
            if not count.any():
                return
            reached |= fresh
            self.sums[atoms] += step * count
            self.farthest[atoms[count > 0]] = step
            per = np.add.reduceat(count, starts)
            some = np.flatnonzero(per)
            self._numbers.append((step, molecules[some], per[some] // 2))
            if step <= self._listed:
                row, bit = np.nonzero(np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little"))
                later = bit > place[row]
                row, bit = row[later], bit[later]
                self._pairs.append((step, molecules[of[row]], place[row], bit))

    def _by_pairs(self, k: int, beside: np.ndarray) -> None:
        n, base = int(self.sizes[k]), int(self.begin[k])
        near = beside[base : base + n] - base
        seen = np.eye(n, dtype=bool)
        root = at = np.arange(n)
        step = 0
        while True:
            step += 1
            new = np.concatenate([root * n + near[at, c] for c in range(near.shape[1])])
            new = np.unique(new[~seen.ravel()[new]])
            if not len(new):
                return
            seen.ravel()[new] = True
            root, at = np.divmod(new, n)
            count = np.bincount(root, minlength=n)
            self.sums[base : base + n] += step * count
            self.farthest[base : base + n][count > 0] = step
            self._numbers.append((step, np.array([k]), np.array([len(new) // 2])))
            if step <= self._listed:
                later = at > root
                self._pairs.append((step, np.full(int(later.sum()), k), root[later], at[later]))

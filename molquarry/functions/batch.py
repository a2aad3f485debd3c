"""Counting in texts, a whole Arrow batch at a time.

The texts of a batch are joined with a character between them that none of them holds. A pattern is then
matched once over all of them, and the matches are dealt to their rows by position; a literal is looked for
only if it occurs at all. Patterns are rewritten so that no match reaches over the end of a text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between texts; in a text it counts as the replacement character.
END = "\x00"
#: Bytes of texts whose characters are counted at once.
SLICE = 1 << 21
#: Bytes of texts that are joined; a longer text stands alone. Masks and positions take tens of bytes for each.
JOINED = 1 << 20


@functools.lru_cache(maxsize=None)
def bounded(pattern: str) -> re.Pattern:
    """The pattern with ^ and $ at the ends of each text, and no class that takes in the character between."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^" + END)
                i += 1
        else:
            out.append({"^": f"(?<={END})", "$": f"(?={END})", ".": f"[^\n{END}]"}.get(c, c))
        i += 1
    return re.compile("".join(out))


@functools.lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...] | None:
    """Plain texts of which every match holds one, or None if that can't be told: the longest of each alternative."""
    found = []
    for alternative in _alternatives(pattern):
        plain, best = "", ""
        i = 0
        while i < len(alternative):
            c = alternative[i]
            step = 1
            if c == "\\" and alternative[i + 1 : i + 2] and not alternative[i + 1].isalnum():
                c, step = alternative[i + 1], 2
                literal = True
            else:
                literal = c not in "\\[](){}.*+?^$|"
            if not literal:
                best, plain = max(best, plain, key=len), ""
                # What stands in a class or a group, or is repeated, isn't looked into.
                i = _past(alternative, i)
                continue
            if alternative[i + step : i + step + 1] in tuple("*?{"):
                best, plain = max(best, plain, key=len), ""
            else:
                plain += c
            i += step
        best = max(best, plain, key=len)
        if not best:
            return None
        found.append(best)
    return tuple(dict.fromkeys(found))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives outside all groups and classes."""
    out, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _past(pattern: str, i: int) -> int:
    """The index after the class, group or sign at i."""
    if pattern[i] == "\\":
        return i + 2
    if pattern[i] == "{":
        return pattern.index("}", i) + 1
    if pattern[i] == "[":
        i += 2
        while pattern[i] != "]":
            i += 2 if pattern[i] == "\\" else 1
        return i + 1
    if pattern[i] == "(":
        depth = 0
        while True:
            c = pattern[i]
            if c == "\\":
                i += 1
            elif c == "[":
                i = _past(pattern, i) - 1
            elif c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    return i + 1
            i += 1
    return i + 1


@functools.lru_cache(maxsize=None)
def in_arrow(pattern: str) -> bool:
    """Whether Arrow counts a pattern's matches alike: it looks neither around nor back, as it goes on behind each match on its own, and has ASCII classes only."""
    return not re.search(r"\(\?|\\[A-Za-z0-9]", pattern) and "^" not in pattern.replace("[^", "[") and not re.compile(pattern).match("")


_CLASS = re.compile(r"\(?(\[[^\^\]\\][^\]\\]*\])(\+?)\)?")
_BEFORE_DIGIT = re.compile(r"\[a-z\]\*([a-z])\[a-z\]\*\[0-9\]")


@functools.lru_cache(maxsize=None)
def _members(of_class: str) -> np.ndarray:
    """By code up to 255, which stands for all larger ones, whether a character is of an ASCII class."""
    found = re.compile(of_class)
    return np.array([0 < k < 128 and found.fullmatch(chr(k)) is not None for k in range(256)])


class Texts:
    """A batch of texts, joined.

    NUL, which stands between the texts, counts inside a text as U+FFFD: no pattern or literal means either.
    """

    def __init__(self, texts: Sequence[str]):
        self.texts = [t.replace(END, "�") if END in t else t for t in texts]
        self.joined = END + END.join(self.texts) + END
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        #: Where each text begins in the joined one.
        self.begin = 1 + np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) if len(self.texts) else np.zeros(0, np.int64)
        self._histogram: np.ndarray | None = None
        self._codes: np.ndarray | None = None
        self._arrow: pa.Array | None = None

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The rows of positions in the joined text."""
        return np.searchsorted(self.begin, at, side="right") - 1

    def _per_row(self, at: list[int]) -> np.ndarray:
        return np.bincount(self.rows(np.array(at, np.int64)), minlength=len(self.texts)) if at else np.zeros(len(self.texts), np.int64)

    def characters(self) -> np.ndarray:
        """How often each ASCII character is found in each text: rows by 128."""
        if self._histogram is None:
            n, codes = len(self.texts), np.frombuffer(self.joined.encode("utf-8"), np.uint8)
            ends = np.flatnonzero(codes == 0)
            counts = np.zeros((n, 128), np.int64)
            # Some texts at a time, so that what is worked on stays small however large the batch.
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1)
                part = codes[ends[a] : ends[b]]
                row = np.cumsum(part == 0, dtype=np.int32) - 1
                plain = (part < 128) & (part > 0)
                counts[a:b] = np.bincount(row[plain].astype(np.int64) * 128 + part[plain], minlength=128 * (b - a)).reshape(-1, 128)
                a = b
            self._histogram = counts
        return self._histogram

    def where(self, of_class: str) -> np.ndarray:
        """Whether each character of the joined texts is of a class of ASCII characters, such as [a-z]."""
        if self._codes is None:
            self._codes = np.minimum(np.frombuffer(self.joined.encode("utf-32-le"), np.uint32), 255).astype(np.uint8)
        return _members(of_class)[self._codes]

    def _counted(self, mask: np.ndarray) -> np.ndarray:
        """How many characters of each text a mask of the joined texts takes."""
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[self.begin + self.lengths] - upto[self.begin]

    def _before_digits(self, inside: str) -> np.ndarray:
        """Runs of small letters, a given one among them, that end at a digit."""
        small = self.where("[a-z]")
        step = np.diff(small.astype(np.int8), prepend=0)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # a text never ends in a run: END follows
        upto = np.concatenate([[0], np.cumsum(self.where(f"[{inside}]"))])
        fit = self.where("[0-9]")[end] & (upto[end] > upto[first])
        mask = np.zeros(len(small), bool)
        mask[first[fit]] = True
        return self._counted(mask)

    def literal(self, text: str) -> np.ndarray:
        """Occurrences that don't overlap."""
        if len(text) == 1 and ord(text) < 128:
            return self.characters()[:, ord(text)]
        return self.pattern(re.escape(text)) if text in self.joined else np.zeros(len(self.texts), np.int64)

    def pattern(self, pattern: str) -> np.ndarray:
        """Matches that don't overlap. Single characters of a class, and runs of them, are taken from masks; most patterns are counted by Arrow."""
        if m := _CLASS.fullmatch(pattern):
            mask = self.where(m[1])
            return self._counted(mask & ~np.concatenate([[False], mask[:-1]]) if m[2] else mask)
        if m := _BEFORE_DIGIT.fullmatch(pattern):
            return self._before_digits(m[1])
        guards = needed(pattern)
        if guards is not None and not any(g in self.joined for g in guards):
            return np.zeros(len(self.texts), np.int64)
        if in_arrow(pattern):
            if self._arrow is None:
                self._arrow = pa.array(self.texts, pa.large_string())
            return pc.count_substring_regex(self._arrow, pattern).to_numpy(zero_copy_only=False)
        return self._per_row([m.start() for m in bounded(pattern).finditer(self.joined)])

    def positions(self, characters: str) -> tuple[np.ndarray, np.ndarray]:
        """The rows and positions, from 1, at which one of some ASCII characters stands."""
        at = np.flatnonzero(self.where("[" + re.escape(characters) + "]"))
        row = self.rows(at) if len(at) else at
        return row, at - self.begin[row] + 1 if len(at) else at

    def over_positions(self, what: str, characters: str) -> np.ndarray:
        """The sum, or the sum of squares, or the spread, of the positions of some characters in each text."""
        row, at = self.positions(characters)
        out = np.zeros(len(self.texts), np.int64)
        if what == "spread":
            low = np.full(len(self.texts), np.iinfo(np.int64).max)
            np.minimum.at(low, row, at)
            np.maximum.at(out, row, at)
            return np.where(out > 0, out - low, 0)
        np.add.at(out, row, at if what == "sum" else at * at)
        return out


def joined(batch: pa.Array) -> Iterator[Texts]:
    """The texts of a batch some at a time, so that memory follows neither the rows of a batch nor their lengths together."""
    upto = np.cumsum(pc.binary_length(batch).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + JOINED, side="right")))
        yield Texts(batch.slice(a, b - a).to_pylist())
        a = b


def add_counts(df: DataFrame, text: Column, wanted: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """``df`` with an array column of whole numbers, one for each (kind, what); a null text is empty.

    Kinds are literal and pattern, for the number of them in the text, and sum, squares and spread of the
    positions of some characters.
    """

    @F.arrow_udf("array<bigint>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            table, at = np.empty((len(batch), len(wanted)), np.int64), 0
            for texts in joined(batch):
                rows = slice(at, at + len(texts.texts))
                for k, (kind, what) in enumerate(wanted):
                    table[rows, k] = texts.literal(what) if kind == "literal" else texts.pattern(what) if kind == "pattern" else texts.over_positions(kind, what)
                at = rows.stop
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(wanted), pa.int32()), pa.array(table.ravel()))

    return df.withColumn(name, counted(F.coalesce(text, F.lit(""))))


def add_values(df: DataFrame, text: Column, names: Sequence[str], of: Callable[[Texts, Sequence[str]], dict[str, np.ndarray]], name: str) -> DataFrame:
    """``df`` with a struct column of doubles, worked out for a batch of texts at a time; a null text is empty."""

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def valued(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [of(texts, names) for texts in joined(batch)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([np.asarray(v[n], float) for v in parts] or [np.zeros(0)])) for n in names], list(names))

    return df.withColumn(name, valued(F.coalesce(text, F.lit(""))))

"""Secret scans: fixed patterns, and windows of high Shannon entropy inside candidate strings.

A candidate is a long run of characters that keys are made of. For each character class, a window slides
over the candidate's longest runs of that class; its entropy is kept up to date from the counts of its
characters as one enters and one leaves. Windows over the class's limit are merged into spans. What is on the
allow-list (placeholders, version-4 ids, digits, words) gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import record_batch

#: kind, pattern, group whose length counts, least length. Fixed values.
PATTERNS = (
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Longest runs that are looked at again: matches that the least length drops anyway are never made.
_QUICK = {"hex": re.compile(r"[0-9a-f]{24,}")}
#: Character class, runs of its members that are long enough for it, window in characters, limit in bits per character.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
    ("entropy_alnum", re.compile(r"[0-9A-Za-z]{20,}"), 20, 3.6),
    ("entropy_base64", re.compile(r"[0-9A-Za-z+/=_-]{24,}"), 24, 3.8),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
#: Whole parts between marks that stand for something else: placeholders, sequences, one repeated character.
PLACEHOLDER = re.compile(r"(?i)(?:example|sample|placeholder|changeme|lorem|ipsum|your|dummy|redacted|0123456789(?:abcdef)?|1234567890?|abcdefgh[a-z]*|(.)\1*)")
#: Identifiers that are no secrets, version-4 ids.
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PART = re.compile(r"[A-Za-z0-9]+")
_CASED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONSONANTS = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{7}")
_ORDER = {k: i for i, k in enumerate([p[0] for p in PATTERNS] + [c[0] for c in CLASSES])}


def windows_over(text: str, width: int, limit: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy in bits exceeds the limit; one window if the text is shorter.

    With counts c of n characters the entropy is log2 n - sum(c log2 c) / n, so the sum is all that a step
    has to update.
    """
    n = min(width, len(text))
    if not n:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 2)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(text):
        had = counts.get(c, 0)
        total += term[had + 1] - term[had]
        counts[c] = had + 1
        if i >= n:
            gone = text[i - n]
            total += term[counts[gone] - 1] - term[counts[gone]]
            counts[gone] -= 1
        elif i < n - 1:
            continue
        if math.log2(n) - total / n > limit:
            start = i - n + 1
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns: leftmost, non-overlapping per kind, short ones dropped."""
    found = []
    for kind, pattern, group, least in PATTERNS:
        for m in _QUICK.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return found


def looks_like_words(part: str) -> bool:
    """Whether letters read as words: runs of one case of three letters or more on average, with vowels among them."""
    if not part.isalpha():
        return False
    runs = _CASED.findall(part)
    vowels = sum(c in "aeiouyAEIOUY" for c in part)
    return len(part) >= 3 * len(runs) and 5 * vowels >= len(part) and not _CONSONANTS.search(part)


def _ordinary(part: str) -> bool:
    return part.isdigit() or looks_like_words(part)


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the sliding windows in the candidates, class by class.

    A placeholder suppresses the part that it is, and no more. A run that is digits or words throughout gives
    none, nor does one with marks in which these make up half or more; a run of a narrower class is left to it.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        s, at = m.group(), m.start()
        if UUID.fullmatch(s):
            continue
        for x in _PART.finditer(s):
            if PLACEHOLDER.fullmatch(x.group()):
                s = s[: x.start()] + " " * (x.end() - x.start()) + s[x.end() :]
        taken: set[tuple[int, int]] = set()
        for kind, runs, width, limit in CLASSES:
            for r in runs.finditer(s):
                parts = _PART.findall(r.group())
                plain = sum(len(p) for p in parts if _ordinary(p))
                if r.span() in taken or 2 * plain >= sum(map(len, parts)):
                    continue
                taken.add(r.span())
                found += [(kind, at + r.start() + a, at + r.start() + b) for a, b in windows_over(r.group(), width, limit)]
    return found


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _ORDER[s[0]])))


_FOUND = {"id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            out.append((i, *(kinds.count(p[0]) for p in PATTERNS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(base + entropy_spans(text))))
        yield record_batch(out, _FOUND)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; the
    digest is over those of the fixed patterns alone. Null texts are empty; very long ones are scanned whole,
    in one pass for each pattern. Spans that begin together stand in the order of the kinds. Repeated rows,
    and rows that share an id or have none, are scanned each; an empty table gives no rows; other columns,
    whatever their names, are not looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = rows.mapInArrow(_scanned, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)

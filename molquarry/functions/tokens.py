"""Token-interaction statistics.

A SMILES text of N tokens spans an N x N grid with four planes: equal token texts, atom beside bond, equal
ring-closure texts, and distance |i - j| / (N - 1). Most statistics have closed forms in the token
histogram; those run in Catalyst. The others are worked out from classes of equal tokens in NumPy, text by text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.dialect import Dialect
from molquarry.functions.family import Family

# Two-letter elements of the token grammar.
TWO_LETTERS = (
    "Ac", "Ag", "Al", "Am", "Ar", "As", "At", "Au", "Ba", "Bh", "Bi", "Bk", "Br", "Cd", "Ce", "Cf",
    "Cl", "Cm", "Cn", "Co", "Cr", "Cs", "Cu", "Db", "Ds", "Dy", "Er", "Es", "Eu", "Fe", "Fl", "Fm",
    "Fr", "Ga", "Gd", "Ge", "He", "Hf", "Hg", "Ho", "Hs", "In", "Ir", "Kr", "La", "Li", "Lr", "Lu",
    "Mc", "Md", "Mg", "Mn", "Mo", "Mt", "Na", "Nb", "Nd", "Ne", "Nh", "Ni", "No", "Np", "Os", "Pa",
    "Pb", "Pd", "Pm", "Po", "Pr", "Pt", "Pu", "Ra", "Rb", "Re", "Rf", "Rg", "Rh", "Rn", "Ru", "Sb",
    "Sc", "Se", "Sg", "Si", "Sm", "Sn", "Sr", "Ta", "Tb", "Tc", "Te", "Th", "Ti", "Tl", "Tm", "Ts",
    "Og", "Yb", "Zn", "Zr",
)
TOKEN = r"\[[^\]]*\]|(?:" + "|".join(TWO_LETTERS) + r")|%[0-9][0-9]|(?s:.)"
#: Token types: 0 other, 1 atom, 2 bracket atom, 3 aromatic letter, 4 bond, 5 ring closure, 6 and 7 branch, 8 dot.
TYPES = ((2, r"^\[[^\]]*\]$"), (3, "^[cnosp]$"), (1, r"^([A-Za-z*]|[A-Z][a-z])$"), (5, "^([0-9]|%.*)$"), (4, "^[=~#$:-]$"), (6, r"^\($"), (7, r"^\)$"), (8, r"^\.$"))
ATOM_TYPES, BOND_TYPE, RING_TYPE = (1, 2, 3), 4, 5


def _tokens(d: Dialect) -> dict[str, str]:
    return {"t": d.found("s", TOKEN)}


def _types(d: Dialect) -> dict[str, str]:
    kind = lambda x: "CASE " + " ".join(f"WHEN {d.like(x, p)} THEN {k}" for k, p in TYPES) + " ELSE 0 END"
    return {"n": d.size("t"), "ty": d.map("t", kind), "texts": d.distinct("t")}


def _histogram(d: Dialect) -> dict[str, str]:
    times = lambda xs, x: d.size(d.keep(xs, lambda y: f"{y} = {x}", "y"))
    of = lambda k: d.size(d.keep("ty", lambda x: f"{x} = {k}"))
    rings = d.map(d.keep(d.positions("n"), lambda i: f"{d.at('ty', i)} = {RING_TYPE}", "i"), lambda i: d.at("t", i), "i")
    where = lambda x, i: f"{d.at('t', i)} = {x}"
    parity = lambda x, odd: d.size(d.keep(d.positions("n"), lambda i: f"{where(x, i)} AND {i} % 2 = {odd}", "i"))
    spots = lambda x: d.keep(d.positions("n"), lambda i: where(x, i), "i")
    return {
        "counts": d.map("texts", lambda x: d.number(times("t", x))),
        "rings": rings,
        "by_type": d.array(*[d.number(of(k)) for k in range(9)]),
        "board": d.map("texts", lambda x: f"({parity(x, 0)} - {parity(x, 1)})"),
        "spans": d.map("texts", lambda x: f"({d.max(spots(x))} - {d.min(spots(x))})"),
        "centre": d.map("texts", lambda x: f"({d.sum(d.map(spots(x), lambda i: d.number(f'{i} - 1'), 'i'))} * {times('t', x)})"),
        "steps": d.map(d.positions("n - 1"), lambda i: f"({d.at('ty', i)} * 10 + {d.at('ty', f'{i} + 1')})", "i"),
        "triples": d.size(d.keep(d.positions("n - 2"), lambda i: f"{d.at('t', i)} = {d.at('t', f'{i} + 1')} AND {d.at('t', i)} = {d.at('t', f'{i} + 2')}", "i")),
    }


def _sums(d: Dialect) -> dict[str, str]:
    times = lambda xs, x: d.size(d.keep(xs, lambda y: f"{y} = {x}", "y"))
    return {
        "m": d.number("n"),
        "sn2": d.sum(d.map("counts", lambda x: f"{x} * {x}")),
        "ring_counts": d.map(d.distinct("rings"), lambda x: d.number(times("rings", x))),
        "a": "(" + " + ".join(d.at("by_type", k + 1) for k in ATOM_TYPES) + ")",
        "b": d.at("by_type", BOND_TYPE + 1),
        "r": d.at("by_type", RING_TYPE + 1),
        "step_counts": d.map(d.distinct("steps"), lambda x: d.struct(f=f"floor({x} / 10.0)", c=d.number(times("steps", x)))),
        "from_counts": d.array(*[d.number(d.size(d.keep("steps", lambda x, k=k: f"floor({x} / 10.0) = {k}"))) for k in range(9)]),
    }


def _planes(d: Dialect) -> dict[str, str]:
    return {"sr2": d.sum(d.map("ring_counts", lambda x: f"{x} * {x}")), "ab2": "2.0 * a * b", "dots": d.at("by_type", 9), "clogc": d.sum(d.map(d.slice("by_type", 1, "8"), lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0.0 END")), "far": "m * (m + 1) / 3.0", "far2": "CASE WHEN n < 2 THEN 0.0 ELSE m * m * (m + 1) / (6.0 * (m - 1)) END"}


def _closed(d: Dialect) -> dict[str, str]:
    least = lambda k, v: d.when((f"n >= {k}", v))
    total, cells = "(sn2 + ab2 + sr2 + far)", "(sn2 + ab2 + sr2 + m * (m - 1))"
    sample = lambda s1, s2: f"(({s2}) - ({s1}) * ({s1}) / (m * m)) / (m * m - 1)"
    p0, p1, p2 = "(sn2 / (m * m))", "(ab2 / (m * m))", "(sr2 / (m * m))"
    bit = lambda p: f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0 ELSE -({p}) * log2({p}) - (1 - {p}) * log2(1 - {p}) END"
    # Cells of the distance plane that are exactly 1 are the two corners, once N > 1; those that are 0 the diagonal.
    corner = bit("(2.0 / (m + 2.0))")
    per_from = d.sum(d.map("step_counts", lambda x: f"-({x}.c / {d.at('from_counts', f'{x}.f + 1')}) * log2({x}.c / {d.at('from_counts', f'{x}.f + 1')})"))
    ring_most = d.max("ring_counts")
    return {
        "SpitTokenSymmetryIndex": least(2, "(sn2 - m) / (m * (m - 1))"),
        "SpitMeanTokenIndexDistance": least(2, "(m + 1) / (3.0 * m)"),
        "SpitMatchingTokenPairCount": "(sn2 - m) / 2.0",
        "SpitActivationDensity": least(2, f"{cells} / (4.0 * m * m)"),
        "SpitMeanOfFeaturePlanes": least(2, f"{total} / (4.0 * m * m)"),
        "SpitMatrixTraceScore": "(m + r) / 4.0",
        "SpitRingSymmetryIndex": least(2, d.ratio("sr2 - r", "r")),
        "SpitStdDevTokenIndexDistances": least(2, f"sqrt({sample('far', 'far2')})"),
        "SpitMaxDiagonalActivity": least(1, "CASE WHEN r > 0 THEN 2.0 ELSE 1.0 END"),
        "SpitMeanOffDiagonalSimilarity": least(2, "(sn2 - m) / (m * (m - 1))"),
        "SpitLowerTriangleActivationRatio": least(2, "1.0"),
        "SpitDiagonalDominanceIndex": least(2, f"(m + r) / ({total} - m - r)"),
        "SpitBondAtomInteractionCount": "a * b",
        "SpitRingRelatedTokenPairCount": "(sr2 - r) / 2.0",
        "SpitSelfPairCount": "a + r",
        "SpitRepetitiveTokenMotifCount": "triples",
        "SpitTokenRepeatSpan": d.max("spans"),
        "SpitMostFrequentInteractionPattern": least(2, "greatest(a * (a - 1) / 2, a * b, a * r, b * (b - 1) / 2, b * r, r * (r - 1) / 2)"),
        "SpitTokenTransitionEntropy": least(2, f"{per_from}"),
        "SpitNonZeroCellsPerFeature": least(2, f"{cells} / 4.0"),
        "SpitVarianceOfFeaturePlanes": least(2, f"({sample('sn2', 'sn2')} + {sample('ab2', 'ab2')} + {sample('sr2', 'sr2')} + {sample('far', 'far2')}) / 4.0"),
        "SpitFeatureWiseEntropy": least(2, f"(({bit(p0)}) + ({bit(p1)}) + ({bit(p2)}) + ({corner})) / 4.0"),
        "SpitFeatureCooccurrenceCorrelation": least(2, d.when((f"{p0} > 0 AND {p0} < 1 AND {p1} > 0 AND {p1} < 1", f"abs(-{p0} * {p1} / sqrt({p0} * (1 - {p0}) * {p1} * (1 - {p1})))"))),
        "SpitMeanActivationAcrossRows": least(2, f"{total} / m"),
        "SpitKurtosisBondPairScores": least(4, d.when((f"{p1} > 0 AND {p1} < 1", f"(1 - 6 * {p1} * (1 - {p1})) / ({p1} * (1 - {p1}))"))),
        "SpitFeatureSpecificSparsity": least(2, f"{cells} / 4.0"),
        "SpitFeatureImportanceIndexPCA": "0.0",
        "SpitTokenHighestBondInteractions": least(2, "greatest(CASE WHEN a > 0 THEN b ELSE 0.0 END, CASE WHEN b > 0 THEN a ELSE 0.0 END)"),
        "SpitRingParticipationIndexPerToken": least(2, ring_most),
        "SpitTokenClusterEntropy": least(2, "(log2(m) * (m - dots) - clogc) / m"),
        "SpitBondVsRingSeparationScore": least(2, d.when(("sr2 > 0", "ab2 / sr2"), ("ab2 > 0", "9999.0"))),
        "SpitCheckerboardPatternStrength": least(2, f"{d.sum(d.map('board', lambda x: d.number(f'{x} * {x}')))} / (m * m)"),
        "SpitCenterOfMatrixActivationShift": least(2, f"sqrt(2.0) * abs({d.sum('centre')} / sn2 - (m - 1) / 2.0) / m"),
    }


TOKEN_CLOSED = Family("token_closed", "TokenInteraction", _closed, (_tokens, _types, _histogram, _sums, _planes))

_TOKEN = re.compile(TOKEN)
_KINDS = [(k, re.compile(p)) for k, p in TYPES]


def tokenize(s: str) -> tuple[list[str], np.ndarray]:
    """The tokens of a text and their types."""
    tokens = _TOKEN.findall(s)
    kinds = {t: _kind(t) for t in set(tokens)}
    return tokens, np.array(list(map(kinds.__getitem__, tokens)), dtype=np.int64)


@functools.lru_cache(maxsize=1 << 14)
def _kind(token: str) -> int:
    return next((k for k, p in _KINDS if p.search(token)), 0)


def planes(s: str) -> tuple[np.ndarray, np.ndarray]:
    """The four planes of a short text (4, N, N) and the types of its tokens, cell by cell."""
    tokens, types = tokenize(s)
    n = len(tokens)
    text = np.array(tokens, dtype=object)
    same = text[:, None] == text[None, :]
    atom, bond, ring = np.isin(types, ATOM_TYPES), types == BOND_TYPE, types == RING_TYPE
    i = np.arange(n)
    far = np.abs(i[:, None] - i[None, :]) / max(n - 1, 1)
    return np.stack([same, (atom[:, None] & bond) | (bond[:, None] & atom), same & ring[:, None] & ring, far]).astype(float), types


class Classes:
    """A text of N tokens as classes of equal tokens, from which sums over the N x N cells follow without the cells."""

    def __init__(self, tokens: Sequence[str], types: np.ndarray):
        self.n, self.types = len(tokens), types
        number = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
        self.code = np.array(list(map(number.__getitem__, tokens)), np.int64)
        self.atom, self.bond, self.ring = np.isin(types, ATOM_TYPES), types == BOND_TYPE, types == RING_TYPE
        self.times = np.bincount(self.code, minlength=len(number))[self.code] if self.n else self.code
        self.unit = max(self.n - 1, 1)
        self._rows: np.ndarray | None = None

    def part(self, a: int, b: int) -> float:
        """Sum of the four planes over the tokens a to b by a to b."""
        squares = lambda which: int((np.bincount(self.code[a:b][which]) ** 2).sum()) if which.any() else 0
        n = b - a
        return squares(np.ones(n, bool)) + 2 * int(self.atom[a:b].sum()) * int(self.bond[a:b].sum()) + squares(self.ring[a:b]) + n * (n * n - 1) / 3 / self.unit

    def spans(self, key: np.ndarray, which: np.ndarray) -> int:
        """Sum of |i - j| over the ordered pairs of some positions with equal keys."""
        at = np.flatnonzero(which)
        at = at[np.argsort(key[at], kind="stable")]
        if not len(at):
            return 0
        first = np.flatnonzero(np.append(True, np.diff(key[at]) != 0))
        size = np.diff(np.append(first, len(at)))
        rank = np.arange(len(at)) - np.repeat(first, size)
        return 2 * int((at * (2 * rank - np.repeat(size, size) + 1)).sum())

    def between(self) -> int:
        """Sum of |i - j| over the pairs of an atom and a bond, in both orders."""
        zero = np.zeros(self.n, np.int64)
        return self.spans(zero, self.atom | self.bond) - self.spans(zero, self.atom) - self.spans(zero, self.bond)

    def rows(self) -> np.ndarray:
        """Ones of the three planes of ones, and the sums and sums of squares of the distances, of each row."""
        if self._rows is not None:
            return self._rows
        i, n = np.arange(self.n), self.n
        a, b = int(self.atom.sum()), int(self.bond.sum())
        left, right = i * (i + 1) // 2, (n - 1 - i) * (n - i) // 2
        squares = i * (i + 1) * (2 * i + 1) // 6 + (n - 1 - i) * (n - i) * (2 * (n - i) - 1) // 6
        self._rows = np.stack([self.times, np.where(self.atom, b, np.where(self.bond, a, 0)), np.where(self.ring, self.times, 0), (left + right) / self.unit, squares / self.unit**2])
        return self._rows

    def cubes(self) -> float:
        d = np.arange(1, self.n, dtype=float)
        return float((2 * (self.n - d) * (d / self.unit) ** 3).sum())


def _binary_entropy(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    total = zero + one
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = zero / total, one / total
        return np.where(total > 0, -np.where(p > 0, p * np.log2(p), 0) - np.where(q > 0, q * np.log2(q), 0), 0.0)


def _connected(t: Classes) -> float:
    return float(t.rows()[:4].sum(axis=0).max())


def _asymmetry(t: Classes) -> float:
    before = np.cumsum(t.bond) - t.bond
    left = before[t.atom]
    right = int(t.bond.sum()) - left
    return float(np.mean(np.abs(left - right) / np.maximum(left + right, 1))) if len(left) else 0.0


def _skewness(t: Classes) -> float:
    """Of all cells of the four planes, from their sums, squares and cubes."""
    rows = t.rows()
    ones, cells = int(rows[:3].sum()), 4 * t.n * t.n
    m1, m2, m3 = ((ones + x) / cells for x in (rows[3].sum(), rows[4].sum(), t.cubes()))
    spread = m2 - m1 * m1
    return float((m3 - 3 * m1 * m2 + 2 * m1**3) / spread**1.5) if spread > 1e-12 else 0.0


def _near(t: Classes) -> float:
    ones = int(t.rows()[:3].sum())
    far = t.spans(t.code, np.ones(t.n, bool)) + t.between() + t.spans(t.code, t.ring)
    return (ones - far / t.unit) / (t.n * t.n)


def _entropy_of_rows(t: Classes) -> float:
    ones = t.rows()[:3]
    ends = np.zeros(t.n)
    ends[[0, -1]] = 1
    return float((_binary_entropy(t.n - ones, ones).sum() + _binary_entropy(np.ones(t.n), ends).sum()) / (4 * t.n))


def _stable(t: Classes) -> float:
    """Tokens whose rows vary little: sample variances of the four planes, averaged."""
    rows = t.rows()
    ones, far, squares = rows[:3], rows[3], rows[4]
    spread = (ones - ones * ones / t.n).sum(axis=0) + squares - far * far / t.n
    return float((spread / (t.n - 1) / 4 < 0.1).sum())


def _class_share(t: Classes, same: bool) -> float:
    """Of the sum of all cells off the diagonal, the share of pairs of one type of token, or of two. Equal tokens have one type; atom and bond are two."""
    rows = t.rows()
    total = rows[:4].sum() - t.n - t.ring.sum()
    inside = rows[0].sum() - t.n + rows[2].sum() - t.ring.sum() + t.spans(t.types, np.ones(t.n, bool)) / t.unit
    return float((inside if same else total - inside) / total) if total > 0 else 0.0


def _grid(t: Classes) -> float:
    """Deviation of the sums of 2 x 2 blocks. The sum of their squares is that of the squared numbers of token pairs in the blocks' sides."""
    k = t.n // 2
    x, y = t.code[: 2 * k : 2], t.code[1 : 2 * k : 2]
    m = int(t.code.max()) + 1
    mean = float((np.bincount(t.code[: 2 * k]) ** 2).sum()) / (k * k)
    pairs = np.concatenate([x * m + x, x * m + y, y * m + x, y * m + y])
    squares = float((np.unique(pairs, return_counts=True)[1].astype(float) ** 2).sum())
    return float(np.sqrt(max(squares / (k * k) - mean * mean, 0.0)))


def _patch(t: Classes) -> float:
    """The largest sum of a 3 x 3 patch lies on the diagonal: no product of two windows' counts exceeds the larger square."""
    a, b, c = t.code[:-2], t.code[1:-1], t.code[2:]
    return float((3 + 2 * ((a == b).astype(int) + (b == c) + (a == c))).max())


def _corners(t: Classes) -> float:
    """Three equal cells in an L: all four tokens are equal."""
    twice = t.code[:-1][t.code[:-1] == t.code[1:]]
    return float(2 * (np.bincount(twice).astype(float) ** 2).sum()) if len(twice) else 0.0


def _turned(t: Classes) -> float:
    both = int(t.times[t.code == t.code[::-1]].sum())
    return 1 - 2 * (int(t.times.sum()) - both) / (t.n * t.n)


def _anti(t: Classes) -> float:
    m = int(t.code.max()) + 1
    both = int((np.unique(t.code * m + t.code[::-1], return_counts=True)[1] ** 2).sum())
    return 2 * (int(t.times.sum()) - both) / (t.n * t.n - t.n)


def _edge(t: Classes) -> float:
    n = t.n
    total, core = t.part(0, n), t.part(1, n - 1)
    edge, inner = (total - core) / (n * n - (n - 2) ** 2), core / (n - 2) ** 2
    return float((edge - inner) / (edge + inner)) if edge + inner > 0 else 0.0


def _quadrants(t: Classes) -> float:
    h = t.n // 2
    a, b = t.part(0, h), t.part(h, t.n)
    return float((a - b) / (a + b)) if a + b > 0 else 0.0


#: Statistics of the four planes: least number of tokens, function of the classes. Each takes about as many steps as there are tokens.
PLANE_STATISTICS = {
    "SpitMostConnectedTokenScore": (1, _connected),
    "SpitHighestInteractiveToken": (1, _connected),
    "SpitBondPairAsymmetry": (3, _asymmetry),
    # Whichever cells the largest tenth holds, the diagonal's ends are among them.
    "SpitBandwidthTop10Activation": (3, lambda t: 2.0 * (t.n - 1)),
    "SpitSkewnessInteractionMatrix": (3, _skewness),
    "SpitAverageDistanceWeightedActivation": (1, _near),
    "SpitTokenEntropy": (2, _entropy_of_rows),
    "SpitPositionallyStableTokens": (2, _stable),
    "SpitIntraClassInteractionRatio": (2, lambda t: _class_share(t, True)),
    "SpitInterClassInteractionRatio": (2, lambda t: _class_share(t, False)),
    "SpitGridUniformity": (4, _grid),
    "SpitMax3x3InteractionPatchScore": (3, _patch),
    "SpitLPatternMotifCount": (3, _corners),
    "SpitSymmetryUnder90Rotation": (2, _turned),
    "SpitAntiDiagonalAsymmetryScore": (2, _anti),
    "SpitTopLeftToBottomRightImbalance": (2, _quadrants),
    "SpitEdgeTokenInteractionBias": (3, _edge),
}


def plane_statistics(df: DataFrame, text: Column, names: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the statistics of the planes; a null text is empty, and too few tokens give 0.

    Texts may be long: no plane is made, and a text of N tokens takes time and memory in proportion to N.
    """
    wanted = [n for n in (PLANE_STATISTICS if names is None else names) if n in PLANE_STATISTICS]
    return df.withColumn("__planes", planes_of(text, wanted)).select(*df.columns, "__planes.*")


def planes_of(text: Column, wanted: Sequence[str]) -> Column:
    """A struct of statistics of the planes. Of equal texts in a batch one is worked out."""
    schema = ", ".join(f"{n} double" for n in wanted)

    @F.pandas_udf(schema)
    def taken(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found: dict[str, list[float]] = {}
            for s in series:
                if s not in found:
                    t = Classes(*tokenize(s))
                    # Names that share a function share its value.
                    values = {f: f(t) if t.n >= least else 0.0 for least, f in {PLANE_STATISTICS[n] for n in wanted}}
                    found[s] = [values[PLANE_STATISTICS[n][1]] for n in wanted]
            yield pd.DataFrame([found[s] for s in series], columns=list(wanted), dtype=float)

    return taken(F.coalesce(text, F.lit("")))

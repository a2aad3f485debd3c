"""Electronegativity statistics over the elements that a SMILES text begins with.

The element sequence is the longest prefix of bracket atoms and letters; it ends at the first other
character. ``ep`` holds each element that has a Pauling value, with it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np

from molquarry.functions.batch import Texts, bounded
from molquarry.functions.dialect import Dialect
from molquarry.functions.elements import TEXT_ALLRED, TEXT_MULLIKEN, TEXT_NUMBER, TEXT_PAULING, TEXT_SANDERSON, TEXT_WEIGHT
from molquarry.functions.family import Family

ATOM = r"\[(?:[0-9]+)?(?:[A-Z][a-z]?|[cnospbih])(?:H[0-9]?)?(?:[+-][0-9]*)?(?::[0-9]+)?(?:@[@THALBOZRDGSP0-9]*)?\]|(?:Cl|Br|Se|Si|As)|[A-Za-z]"
SYMBOL = r"^\[[0-9]*([A-Z][a-z]?|[cnospbih])"

#: Elements of a kind.
# Elements of each kind.
KINDS = {
    "Carbon": ("C", "c",),
    "Nitrogen": ("N", "n",),
    "Oxygen": ("O", "o",),
    "Sulfur": ("S", "s",),
    "Halogen": ("F", "Cl", "Br", "I",),
    "Fluorine": ("F",),
    "Chlorine": ("Cl",),
    "Bromine": ("Br",),
    "Iodine": ("I", "i",),
    "Alkali": ("Li", "Na", "K", "Rb",),
    "AlkalineEarth": ("Be", "Mg", "Ca", "Sr",),
    "Chalcogen": ("O", "S", "Se", "Te",),
    "Pnictogen": ("N", "P", "As", "Sb",),
    "Tetrel": ("C", "Si", "Ge", "Sn",),
    "Triel": ("B", "Al", "Ga", "In",),
    "Coinage": ("Cu", "Ag", "Au",),
    "TitaniumGroup": ("Ti", "Zr",),
    "VanadiumGroup": ("V", "Nb",),
    "ChromiumGroup": ("Cr", "Mo",),
    "ManganeseGroup": ("Mn", "Tc",),
    "IronGroup": ("Fe", "Ru",),
    "CobaltGroup": ("Co", "Rh",),
    "ZincGroup": ("Zn", "Cd",),
    "AromaticCarbon": ("c",),
    "AliphaticCarbon": ("C",),
    "NoHetero": ("C", "c", "H", "h",),
}
#: Bands of Pauling values: above, below.
BANDS = {
    "HighENAtom": (2.5, None), "LowENAtom": (None, 2.0), "MidENAtom": (2.0, 3.0), "VeryLowENAtom": (None, 1.5), "VeryHighENAtom": (3.0, None), "LowMidENAtom": (1.5, 2.5),
    "MidHighENAtom": (2.5, 3.5), "HighVeryHighENAtom": (3.0, 4.0), "VeryLowLowENAtom": (1.0, 2.0),
}
WITH_RANGE = ("HighENAtom", "MidENAtom")
#: Means of these are given under their own names.
BY_GROUP = ("OddZ", "EvenZ", "Alkali", "AlkalineEarth", "Halogen", "Chalcogen", "Pnictogen", "Tetrel", "Triel", "Coinage", "TitaniumGroup", "VanadiumGroup", "ChromiumGroup", "ManganeseGroup", "IronGroup", "CobaltGroup", "ZincGroup")
NEGATED = ("Halogen", "Carbon", "Nitrogen", "Oxygen", "Sulfur")


def _of(kind: str, x: str) -> str:
    names = ", ".join(f"'{e}'" for e in KINDS[kind])
    return f"{x}.e IN ({names})"


def _elements(d: Dialect) -> dict[str, str]:
    prefix = d.found("s", rf"\G(?:{ATOM})") if d.name == "spark" else d.found(f"regexp_extract(s, {d.text(f'^(?:{ATOM})*')})", ATOM)
    symbol = d.map(prefix, lambda t: f"CASE WHEN substr({t}, 1, 1) = '[' THEN {d.group(t, SYMBOL)} ELSE {t} END", "t")
    # A single letter that is no element is passed over; a bracket atom always counts.
    bracket_or_known = d.keep(symbol, lambda t: f"length({t}) = 2 OR {d.lookup(TEXT_PAULING, t)} IS NOT NULL", "t")
    return {"e": bracket_or_known}


def _values(d: Dialect) -> dict[str, str]:
    scale = lambda table: d.keep(d.map("e", lambda x: d.lookup(table, x)), lambda v: f"{v} IS NOT NULL", "v")
    fields = lambda x: d.struct(e=x, p=d.lookup(TEXT_PAULING, x), w=d.lookup(TEXT_WEIGHT, x), z=d.lookup(TEXT_NUMBER, x), m=d.lookup(TEXT_MULLIKEN, x))
    return {"p": scale(TEXT_PAULING), "ar": scale(TEXT_ALLRED), "mu": scale(TEXT_MULLIKEN), "sa": scale(TEXT_SANDERSON), "ep": d.keep(d.map("e", fields), lambda v: f"{v}.p IS NOT NULL", "v")}


def _selected(d: Dialect, condition) -> str:
    return d.map(d.keep("ep", condition), lambda x: f"{x}.p")


def _lists(d: Dialect) -> dict[str, str]:
    out = {f"l_{k}": _selected(d, lambda x, k=k: _of(k, x)) for k in KINDS}
    out |= {f"l_Non{k}": _selected(d, lambda x, k=k: f"NOT ({_of(k, x)})") for k in (*NEGATED, "NoHetero")}
    for name, (low, high) in BANDS.items():
        bound = [f"{{0}}.p > {low}"] * (low is not None) + [f"{{0}}.p < {high}"] * (high is not None)
        out[f"l_{name}"] = _selected(d, lambda x, b=bound: " AND ".join(c.format(x) for c in b))
    out |= {"l_LightAtoms": _selected(d, lambda x: f"{x}.w < 20"), "l_HeavyAtoms": _selected(d, lambda x: f"{x}.w > 50")}
    lower = lambda x: f"lower({x}.e) = {x}.e"
    out |= {"l_Aromatic": _selected(d, lower), "l_Aliphatic": _selected(d, lambda x: f"NOT ({lower(x)})")}
    out |= {"l_OddZ": _selected(d, lambda x: f"{x}.z % 2 = 1"), "l_EvenZ": _selected(d, lambda x: f"{x}.z % 2 = 0")}
    half = d.integer(f"floor({d.size('p')} / 2.0)")
    every = lambda odd: d.map(d.keep(d.positions(d.size("p")), lambda i: f"{i} % 2 = {odd}", "i"), lambda i: d.at("p", i), "i")
    out |= {"l_FirstHalf": d.slice("p", 1, half), "l_SecondHalf": d.slice("p", f"{half} + 1", f"{d.size('p')} - {half}"), "l_Even": every(1), "l_Odd": every(0)}
    out["l_step"] = d.map(d.positions(f"{d.size('p')} - 1"), lambda i: f"abs({d.at('p', f'{i} + 1')} - {d.at('p', i)})", "i")
    out |= {"tens": d.map("p", lambda x: f"round(10 * {x})"), "hundreds": d.map("p", lambda x: f"round(100 * {x})"), "kinds": d.sorted(d.distinct("e")), "pm": d.keep("ep", lambda x: f"{x}.m IS NOT NULL")}
    out["scales"] = d.map(d.keep(d.array("ar", "mu", "p", "sa"), lambda v: f"{d.size(v)} > 0", "v"), lambda v: d.mean(v), "v")
    return out


def _means(d: Dialect) -> dict[str, str]:
    lists = [*(f"l_{k}" for k in (*KINDS, *(f"Non{n}" for n in (*NEGATED, "NoHetero")), *BANDS)), "l_LightAtoms", "l_HeavyAtoms", "l_Aromatic", "l_Aliphatic", "l_OddZ", "l_EvenZ", "l_FirstHalf", "l_SecondHalf", "l_Even", "l_Odd", "l_step"]
    out = {f"mean_{x[2:]}": d.mean(x) for x in lists} | {"mean_p": d.mean("p"), "mean_scales": d.mean("scales"), "kind_p": d.keep(d.map("kinds", lambda x: d.lookup(TEXT_PAULING, x)), lambda v: f"{v} IS NOT NULL", "v")}
    out["mean_pp"] = d.mean(d.map("pm", lambda x: f"{x}.p"))
    out["mean_mm"] = d.mean(d.map("pm", lambda x: f"{x}.m"))
    out["distinct_p"] = d.distinct("p")
    times = lambda xs, x: d.size(d.keep(xs, lambda y: f"{y} = {x}", "y"))
    out["ten_counts"] = d.map(d.distinct("tens"), lambda x: d.number(times("tens", x)))
    out["hundred_counts"] = d.map(d.distinct("hundreds"), lambda x: d.struct(c=f"-{times('hundreds', x)}", v=x))
    out["kind_counts"] = d.map("kinds", lambda x: d.struct(c=times("e", x), v=x))
    return out


def _shape(d: Dialect) -> dict[str, str]:
    power = lambda k: d.sum(d.map("p", lambda x: "(" + " * ".join([f"({x} - mean_p)"] * k) + ")"))
    cross = lambda a, b: d.sum(d.map("pm", lambda x: f"({x}.{a[0]} - mean_{a}) * ({x}.{b[0]} - mean_{b})"))
    return {"std_p": d.std("p", "mean_p"), "m2": f"{power(2)}", "m3": f"{power(3)}", "m4": f"{power(4)}", "sxy": cross("pp", "mm"), "sxx": cross("pp", "pp"), "syy": cross("mm", "mm"), "mean_distinct": d.mean("distinct_p"), "most": d.max(d.map("kind_counts", lambda x: f"{x}.c")), "least": d.min(d.map("kind_counts", lambda x: f"{x}.c"))}


def _outputs(d: Dialect) -> dict[str, str]:
    n, size = d.size("p"), d.size("e")
    summed = lambda k: d.sum(f"l_{k}")
    over = lambda limit: d.size(d.keep("p", lambda x: f"{x} > {limit}"))
    std = lambda k: d.std(f"l_{k}", f"mean_{k}")
    spread = lambda xs: d.when((f"{d.size(xs)} >= 2", d.range(xs)))
    some = lambda *c: d.when(*c)
    share = lambda k: d.ratio(d.size(d.keep("e", lambda x: f"{x} IN ({', '.join(repr(v) for v in KINDS[k])})")), size)
    first = lambda count: d.at(d.keep("kind_counts", lambda x: f"{x}.c = {count}"), 1)
    value = lambda x: f"coalesce({d.lookup(TEXT_PAULING, f'{x}.v')}, 0.0)"
    out = {}
    for name, column in (("Pauling", "p"), ("AllredRochow", "ar"), ("Mulliken", "mu"), ("Sanderson", "sa")):
        out |= {f"Smiles{name}ENSum": d.sum(column), f"Smiles{name}ENMean": d.mean(column), f"SmilesNormalized{name}ENSum": d.mean(column)}
    out |= {"SmilesPaulingENMax": d.max("p"), "SmilesPaulingENMin": d.min("p"), "SmilesPaulingENRange": spread("p"), "SmilesPaulingENStdDev": "std_p"}
    out |= {"SmilesHighENCount": over(3.0), "SmilesVeryHighENCount": over(3.5), "SmilesHighENFraction": d.ratio(over(3.0), size), "SmilesElectronegativeElementRatio": d.ratio(over(2.5), size)}
    out["SmilesHighToLowENRatio"] = some((f"{n} - {over(3.0)} > 0", f"{d.number(over(3.0))} / ({n} - {over(3.0)})"), (f"{n} >= 0", d.number(over(3.0))))
    out["SmilesAllredToPaulingRatio"] = d.ratio(d.mean("ar"), "mean_p")
    out |= {f"Smiles{k}ENProduct": f"({share(k)}) * mean_p" for k in ("Carbon", "Nitrogen", "Oxygen", "Sulfur", "Halogen")}
    out |= {"SmilesENScaleVariance": d.variance("scales", "mean_scales"), "SmilesENConsistencyIndex": some((f"{d.size('scales')} >= 2 AND {d.min('scales')} > 0", f"{d.max('scales')} / {d.min('scales')}"))}
    out |= {f"Smiles{k}ENSum": summed(k) for k in ("AromaticCarbon", "AliphaticCarbon", "Aromatic", "Aliphatic", "Halogen", "Carbon", "Nitrogen", "Oxygen", "Sulfur", "Fluorine", "Chlorine", "Bromine", "Iodine")}
    out |= {"SmilesAromaticToAliphaticCarbonENRatio": d.ratio(summed("AromaticCarbon"), summed("AliphaticCarbon")), "SmilesNitrogenToCarbonENRatio": d.ratio(summed("Nitrogen"), summed("Carbon")), "SmilesOxygenToCarbonENRatio": d.ratio(summed("Oxygen"), summed("Carbon"))}
    out |= {"SmilesHeteroatomToCarbonENRatio": d.ratio(summed("NonNoHetero"), summed("Carbon")), "SmilesCarbonToHeteroatomENRatio": d.ratio(summed("Carbon"), summed("NonNoHetero")), "SmilesAromaticToAliphaticENRatio": d.ratio(summed("Aromatic"), summed("Aliphatic"))}
    out |= {"SmilesENDiversityIndex": d.ratio(d.size(d.distinct("tens")), size), "SmilesENSumToSizeRatio": d.ratio(d.sum("p"), "length(s)"), "SmilesSquaredENSum": d.sum(d.map("p", lambda x: f"{x} * {x}")), "SmilesENWeightedAtomCount": d.sum("p")}
    heavy = lambda x: f"CASE WHEN {x} > 3 THEN 2.0 ELSE 1.0 END"
    out["SmilesHighENElementsWeight"] = d.ratio(d.sum(d.map("p", lambda x: f"{heavy(x)} * {x}")), d.sum(d.map("p", heavy)))
    out["SmilesENHomogeneityIndex"] = some((f"{n} > 0 AND mean_p > 0", f"1.0 - ({d.sum(d.map('p', lambda x: f'abs({x} - mean_p)'))} / {n}) / mean_p"))
    out["SmilesGeometricMeanEN"] = some((f"{n} > 0", f"exp({d.sum(d.map('p', lambda x: f'ln({x})'))} / {n})"))
    out["SmilesHarmonicMeanEN"] = d.ratio(n, d.sum(d.map("p", lambda x: f"1.0 / {x}")))
    mid = lambda k: d.at(d.sorted("p"), d.integer(f"floor(({n} + {k}) / 2.0)"))
    out["SmilesMedianEN"] = some((f"{n} > 0", f"({mid(1)} + {mid(2)}) / 2.0"))
    out["SmilesModeEN"] = some((f"{n} > 0", f"{d.at(d.sorted('hundred_counts'), 1)}.v / 100.0"))
    out["SmilesENPolarityIndex"] = some((f"{n} >= 2", f"{d.range('p')} * mean_p / {n}"))
    weighed = d.keep("ep", lambda x: f"{x}.w IS NOT NULL")
    out["SmilesENWeightedMolWeight"] = d.ratio(d.sum(d.map(weighed, lambda x: f"{x}.w * {x}.p")), d.sum(d.map(weighed, lambda x: f"{x}.p")))
    out["SmilesMultiScaleENCorrelation"] = some((f"{d.size('pm')} < 2", "0.0"), ("sxx * syy > 1e-18", "sxy / sqrt(sxx * syy)"), ("sxx * syy <= 1e-18", "1.0"))
    out["SmilesENHeterogeneityIndex"] = f"({spread('kind_p')}) * ({d.ratio(d.size('kinds'), size)})"
    out |= {"SmilesUniqueElementCount": d.size("kinds"), "SmilesUniqueElementENMean": d.ratio(d.sum("kind_p"), d.size("kinds")), "SmilesUniqueElementENRange": spread("distinct_p"), "SmilesUniqueElementENStdDev": d.std("distinct_p", "mean_distinct")}
    out |= {"SmilesHalogenENMean": "mean_Halogen", "SmilesAllHalogenENSum": summed("Halogen"), "SmilesAllHalogenENMean": "mean_Halogen", "SmilesAllHalogenENStdDev": std("Halogen")}
    for k in NEGATED:
        out |= {f"SmilesNon{k}ENSum": summed(f"Non{k}"), f"SmilesNon{k}ENMean": f"mean_Non{k}", f"SmilesNon{k}ENRange": spread(f"l_Non{k}"), f"SmilesNon{k}ENStdDev": std(f"Non{k}")}
    for k in BANDS:
        out |= {f"Smiles{k}Sum": summed(k), f"Smiles{k}Mean": f"mean_{k}", f"Smiles{k}StdDev": std(k)}
        if k in WITH_RANGE:
            out[f"Smiles{k}Range"] = spread(f"l_{k}")
    out["SmilesENSkewness"] = some((f"{n} >= 3 AND m2 > 1e-18", f"(m3 / {n}) / power(m2 / {n}, 1.5)"))
    out["SmilesENKurtosis"] = some((f"{n} >= 4 AND m2 > 1e-18", f"(m4 / {n}) / power(m2 / {n}, 2) - 3.0"))
    out |= {"SmilesENEntropy": d.entropy("ten_counts"), "SmilesENMeanStdProduct": "mean_p * std_p", "SmilesENMaxMinRatio": d.ratio(d.max("p"), d.min("p")), "SmilesENRangeOverMean": d.ratio(d.range("p"), "mean_p")}
    out |= {"SmilesENMeanFirstHalf": "mean_FirstHalf", "SmilesENMeanSecondHalf": "mean_SecondHalf", "SmilesENMeanHalfDiff": some((f"{n} >= 2", "mean_FirstHalf - mean_SecondHalf"))}
    out |= {"SmilesENMeanAbsDiff": "mean_step", "SmilesENMaxAbsDiff": d.max("l_step"), "SmilesENMinAbsDiff": d.min("l_step"), "SmilesENMeanEven": "mean_Even", "SmilesENMeanOdd": "mean_Odd", "SmilesENMeanEvenOddDiff": some((f"{n} >= 2", "mean_Even - mean_Odd"))}
    out |= {"SmilesENMaxMinProduct": f"{d.max('p')} * {d.min('p')}", "SmilesENMeanOverStd": some(("std_p > 1e-9", "mean_p / std_p")), "SmilesENStdOverMean": d.ratio("std_p", "mean_p")}
    for k in ("Light", "Heavy"):
        out |= {f"SmilesENSum{k}Atoms": summed(f"{k}Atoms"), f"SmilesENMean{k}Atoms": f"mean_{k}Atoms", f"SmilesENStdDev{k}Atoms": std(f"{k}Atoms")}
    out["SmilesENMeanLightHeavyRatio"] = d.ratio("mean_LightAtoms", "mean_HeavyAtoms")
    out |= {"SmilesENAboveMeanFraction": d.ratio(d.size(d.keep("p", lambda x: f"{x} > mean_p + 1e-9")), n), "SmilesENBelowMeanFraction": d.ratio(d.size(d.keep("p", lambda x: f"{x} < mean_p - 1e-9")), n)}
    out["SmilesENMostLeastCommonDiff"] = some((f"{size} > 0", f"abs({value(first('most'))} - {value(first('least'))})"))
    out |= {f"SmilesENMean{k}": f"mean_{k}" for k in BY_GROUP}
    return out


_ATOM = bounded(ATOM)
_BRACKETED = re.compile(r"\[[0-9]*([A-Z][a-z]?|[cnospbih])")
#: Elements by number, in the order of their names; what each scale knows of them, NaN where nothing.
_ELEMENTS = sorted({*TEXT_PAULING, *TEXT_WEIGHT, *TEXT_MULLIKEN, *TEXT_ALLRED, *TEXT_SANDERSON})
_CODE = {e: k for k, e in enumerate(_ELEMENTS)}
_SCALE = {n: np.array([table.get(e, np.nan) for e in _ELEMENTS]) for n, table in {"p": TEXT_PAULING, "w": TEXT_WEIGHT, "z": TEXT_NUMBER, "m": TEXT_MULLIKEN, "ar": TEXT_ALLRED, "sa": TEXT_SANDERSON}.items()}


def _sequences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, element (its number, others from the end of the table on) of each counted element, and how many each row has."""
    rows, codes, more = [], [], {}
    for row, s in enumerate(texts.texts):
        at = 0
        while m := _ATOM.match(s, at):
            t, at = m.group(), m.end()
            if t[0] == "[":
                named = _BRACKETED.match(t)
                t = named[1] if named else ""
            code = _CODE.get(t)
            if code is None or (len(t) != 2 and np.isnan(_SCALE["p"][code])):
                if len(t) != 2:
                    continue
                code = more.setdefault(t, len(_ELEMENTS) + len(more))
            rows.append(row)
            codes.append(code)
    row = np.array(rows, np.int64)
    return row, np.array(codes, np.int64), np.bincount(row, minlength=len(texts.texts))


class _List:
    """Values of many rows: sums, means and extremes for each row, 0 where it has none."""

    def __init__(self, row: np.ndarray, x: np.ndarray, n_rows: int):
        self.row, self.x, self.rows = row, x, n_rows
        self.n = np.bincount(row, minlength=n_rows)

    def where(self, keep: np.ndarray) -> _List:
        return _List(self.row[keep], self.x[keep], self.rows)

    def of(self, x: np.ndarray) -> _List:
        return _List(self.row, x, self.rows)

    @functools.cached_property
    def sum(self) -> np.ndarray:
        return np.bincount(self.row, self.x, minlength=self.rows)

    @functools.cached_property
    def mean(self) -> np.ndarray:
        return _over(self.sum, self.n)

    @functools.cached_property
    def max(self) -> np.ndarray:
        out = np.full(self.rows, -np.inf)
        np.maximum.at(out, self.row, self.x)
        return np.where(self.n > 0, out, 0.0)

    @functools.cached_property
    def min(self) -> np.ndarray:
        out = np.full(self.rows, np.inf)
        np.minimum.at(out, self.row, self.x)
        return np.where(self.n > 0, out, 0.0)

    @functools.cached_property
    def range(self) -> np.ndarray:
        return np.where(self.n >= 2, self.max - self.min, 0.0)

    def power(self, k: int) -> np.ndarray:
        return np.bincount(self.row, (self.x - self.mean[self.row]) ** k, minlength=self.rows)

    @functools.cached_property
    def std(self) -> np.ndarray:
        return np.where(self.n >= 2, np.sqrt(_over(self.power(2), self.n)), 0.0)

    @functools.cached_property
    def place(self) -> np.ndarray:
        """The place of each value in its row, from 0; rows stand in order."""
        return np.arange(len(self.row)) - (np.cumsum(self.n) - self.n)[self.row]

    @functools.cached_property
    def tally(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, value and number of each distinct value of a row, by rising value."""
        order = np.lexsort((self.x, self.row))
        row, x = self.row[order], self.x[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
        return row[first], x[first], np.diff(np.append(first, len(x)))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    b = np.asarray(b, float)
    return np.where(b == 0, 0.0, a / np.where(b == 0, 1.0, b))


def _values_of(texts: Texts, names: Sequence[str]) -> dict[str, np.ndarray]:
    """All statistics of a batch; what the expressions above say, on arrays of all rows' elements."""
    row, code, size = _sequences(texts)
    n_rows, length = len(texts.texts), texts.lengths
    known = code < len(_ELEMENTS)
    at = np.minimum(code, len(_ELEMENTS) - 1)
    scale = {n: np.where(known, table[at], np.nan) for n, table in _SCALE.items()}
    has = ~np.isnan(scale["p"])
    p = _List(row[has], scale["p"][has], n_rows)
    own, w, z = code[has], scale["w"][has], scale["z"][has]
    listed = {n: _List(row[~np.isnan(scale[n])], scale[n][~np.isnan(scale[n])], n_rows) for n in ("ar", "m", "sa")}
    some = lambda kind: np.isin(own, [_CODE[e] for e in KINDS[kind] if e in _CODE])
    lists = {k: p.where(some(k)) for k in KINDS} | {f"Non{k}": p.where(~some(k)) for k in (*NEGATED, "NoHetero")}
    for name, (low, high) in BANDS.items():
        lists[name] = p.where((p.x > (-np.inf if low is None else low)) & (p.x < (np.inf if high is None else high)))
    lower = np.array([e == e.lower() for e in _ELEMENTS])[own]
    half = p.n // 2
    lists |= {"LightAtoms": p.where(w < 20), "HeavyAtoms": p.where(w > 50), "Aromatic": p.where(lower), "Aliphatic": p.where(~lower), "OddZ": p.where(z % 2 == 1), "EvenZ": p.where(z % 2 == 0)}
    lists |= {"FirstHalf": p.where(p.place < half[p.row]), "SecondHalf": p.where(p.place >= half[p.row]), "Even": p.where(p.place % 2 == 0), "Odd": p.where(p.place % 2 == 1)}
    same = p.row[1:] == p.row[:-1]
    step = _List(p.row[1:][same], np.abs(np.diff(p.x))[same], n_rows)
    n, mean, std = p.n, p.mean, p.std
    count = lambda keep, by=row: np.bincount(by[keep], minlength=n_rows)
    over = lambda limit: count(p.x > limit, p.row)
    share = lambda kind: _over(count(np.isin(code, [_CODE[e] for e in KINDS[kind] if e in _CODE])), size)
    out: dict[str, np.ndarray] = {}
    for name, v in (("Pauling", p), ("AllredRochow", listed["ar"]), ("Mulliken", listed["m"]), ("Sanderson", listed["sa"])):
        out |= {f"Smiles{name}ENSum": v.sum, f"Smiles{name}ENMean": v.mean, f"SmilesNormalized{name}ENSum": v.mean}
    out |= {"SmilesPaulingENMax": p.max, "SmilesPaulingENMin": p.min, "SmilesPaulingENRange": p.range, "SmilesPaulingENStdDev": std}
    out |= {"SmilesHighENCount": over(3.0), "SmilesVeryHighENCount": over(3.5), "SmilesHighENFraction": _over(over(3.0), size), "SmilesElectronegativeElementRatio": _over(over(2.5), size)}
    out["SmilesHighToLowENRatio"] = np.where(n - over(3.0) > 0, _over(over(3.0), n - over(3.0)), over(3.0))
    out["SmilesAllredToPaulingRatio"] = _over(listed["ar"].mean, mean)
    out |= {f"Smiles{k}ENProduct": share(k) * mean for k in ("Carbon", "Nitrogen", "Oxygen", "Sulfur", "Halogen")}
    means = np.stack([v.mean for v in (listed["ar"], listed["m"], p, listed["sa"])])
    there = np.stack([v.n > 0 for v in (listed["ar"], listed["m"], p, listed["sa"])])
    scales = _List(np.nonzero(there.T)[0], means.T[there.T], n_rows)
    out |= {"SmilesENScaleVariance": np.where(scales.n >= 2, _over(scales.power(2), scales.n), 0.0), "SmilesENConsistencyIndex": np.where((scales.n >= 2) & (scales.min > 0), _over(scales.max, scales.min), 0.0)}
    out |= {f"Smiles{k}ENSum": lists[k].sum for k in ("AromaticCarbon", "AliphaticCarbon", "Aromatic", "Aliphatic", "Halogen", "Carbon", "Nitrogen", "Oxygen", "Sulfur", "Fluorine", "Chlorine", "Bromine", "Iodine")}
    pairs = {"AromaticToAliphaticCarbon": ("AromaticCarbon", "AliphaticCarbon"), "NitrogenToCarbon": ("Nitrogen", "Carbon"), "OxygenToCarbon": ("Oxygen", "Carbon"), "HeteroatomToCarbon": ("NonNoHetero", "Carbon"), "CarbonToHeteroatom": ("Carbon", "NonNoHetero"), "AromaticToAliphatic": ("Aromatic", "Aliphatic")}
    out |= {f"Smiles{k}ENRatio": _over(lists[a].sum, lists[b].sum) for k, (a, b) in pairs.items()}
    tens, hundreds = p.of(np.floor(10 * p.x + 0.5)), p.of(np.floor(100 * p.x + 0.5))
    kinds = _List(row, code.astype(float), n_rows)
    out |= {"SmilesENDiversityIndex": _over(np.bincount(tens.tally[0], minlength=n_rows), size), "SmilesENSumToSizeRatio": _over(p.sum, length), "SmilesSquaredENSum": p.of(p.x * p.x).sum, "SmilesENWeightedAtomCount": p.sum}
    heavy = np.where(p.x > 3, 2.0, 1.0)
    out["SmilesHighENElementsWeight"] = _over(p.of(heavy * p.x).sum, p.of(heavy).sum)
    out["SmilesENHomogeneityIndex"] = np.where((n > 0) & (mean > 0), 1.0 - _over(_over(p.of(np.abs(p.x - mean[p.row])).sum, n), mean), 0.0)
    out["SmilesGeometricMeanEN"] = np.where(n > 0, np.exp(_over(p.of(np.log(p.x)).sum, n)), 0.0)
    out["SmilesHarmonicMeanEN"] = _over(n, p.of(1.0 / p.x).sum)
    begin = np.cumsum(n) - n
    rising = np.append(p.x[np.lexsort((p.x, p.row))], 0.0)
    middle = lambda k: rising[np.where(n > 0, begin + (n + k) // 2 - 1, -1)]
    out["SmilesMedianEN"] = np.where(n > 0, (middle(1) + middle(2)) / 2.0, 0.0)
    most = _first_by(hundreds.tally, n_rows, lambda c: -c)
    out["SmilesModeEN"] = most / 100.0
    out["SmilesENPolarityIndex"] = np.where(n >= 2, _over((p.max - p.min) * mean, n), 0.0)
    weighed = ~np.isnan(w)
    out["SmilesENWeightedMolWeight"] = _over(_List(p.row[weighed], (w * p.x)[weighed], n_rows).sum, p.where(weighed).sum)
    both = ~np.isnan(scale["m"][has])
    pp, mm = p.where(both), _List(p.row[both], scale["m"][has][both], n_rows)
    sxy = np.bincount(pp.row, (pp.x - pp.mean[pp.row]) * (mm.x - mm.mean[mm.row]), minlength=n_rows)
    sxx_syy = pp.power(2) * mm.power(2)
    out["SmilesMultiScaleENCorrelation"] = np.where(pp.n < 2, 0.0, np.where(sxx_syy > 1e-18, _over(sxy, np.sqrt(sxx_syy)), 1.0))
    kind_row, kind_code, kind_count = kinds.tally
    value = np.append(_SCALE["p"], [np.nan])[np.minimum(kind_code.astype(np.int64), len(_ELEMENTS))]
    kind_p = _List(kind_row[~np.isnan(value)], value[~np.isnan(value)], n_rows)
    n_kinds = np.bincount(kind_row, minlength=n_rows)
    distinct = _List(p.tally[0], p.tally[1], n_rows)
    out["SmilesENHeterogeneityIndex"] = kind_p.range * _over(n_kinds, size)
    out |= {"SmilesUniqueElementCount": n_kinds, "SmilesUniqueElementENMean": _over(kind_p.sum, n_kinds), "SmilesUniqueElementENRange": distinct.range, "SmilesUniqueElementENStdDev": distinct.std}
    out |= {"SmilesHalogenENMean": lists["Halogen"].mean, "SmilesAllHalogenENSum": lists["Halogen"].sum, "SmilesAllHalogenENMean": lists["Halogen"].mean, "SmilesAllHalogenENStdDev": lists["Halogen"].std}
    for k in NEGATED:
        v = lists[f"Non{k}"]
        out |= {f"SmilesNon{k}ENSum": v.sum, f"SmilesNon{k}ENMean": v.mean, f"SmilesNon{k}ENRange": v.range, f"SmilesNon{k}ENStdDev": v.std}
    for k in BANDS:
        out |= {f"Smiles{k}Sum": lists[k].sum, f"Smiles{k}Mean": lists[k].mean, f"Smiles{k}StdDev": lists[k].std}
        if k in WITH_RANGE:
            out[f"Smiles{k}Range"] = lists[k].range
    m2, m3, m4 = (p.power(k) for k in (2, 3, 4))
    spread = _over(m2, n)
    out["SmilesENSkewness"] = np.where((n >= 3) & (m2 > 1e-18), _over(_over(m3, n), spread**1.5), 0.0)
    out["SmilesENKurtosis"] = np.where((n >= 4) & (m2 > 1e-18), _over(_over(m4, n), spread**2) - 3.0, 0.0)
    t_row, _, t_count = tens.tally
    logs = np.bincount(t_row, t_count * np.log2(np.maximum(t_count, 1)), minlength=n_rows)
    out |= {"SmilesENEntropy": np.where(n > 0, np.maximum(np.log2(np.maximum(n, 1)) - _over(logs, n), 0.0), 0.0), "SmilesENMeanStdProduct": mean * std, "SmilesENMaxMinRatio": _over(p.max, p.min), "SmilesENRangeOverMean": _over(p.max - p.min, mean)}
    two = n >= 2
    out |= {"SmilesENMeanFirstHalf": lists["FirstHalf"].mean, "SmilesENMeanSecondHalf": lists["SecondHalf"].mean, "SmilesENMeanHalfDiff": np.where(two, lists["FirstHalf"].mean - lists["SecondHalf"].mean, 0.0)}
    out |= {"SmilesENMeanAbsDiff": step.mean, "SmilesENMaxAbsDiff": step.max, "SmilesENMinAbsDiff": step.min, "SmilesENMeanEven": lists["Even"].mean, "SmilesENMeanOdd": lists["Odd"].mean, "SmilesENMeanEvenOddDiff": np.where(two, lists["Even"].mean - lists["Odd"].mean, 0.0)}
    out |= {"SmilesENMaxMinProduct": p.max * p.min, "SmilesENMeanOverStd": np.where(std > 1e-9, _over(mean, std), 0.0), "SmilesENStdOverMean": _over(std, mean)}
    for k in ("LightAtoms", "HeavyAtoms"):
        out |= {f"SmilesENSum{k}": lists[k].sum, f"SmilesENMean{k}": lists[k].mean, f"SmilesENStdDev{k}": lists[k].std}
    out["SmilesENMeanLightHeavyRatio"] = _over(lists["LightAtoms"].mean, lists["HeavyAtoms"].mean)
    out |= {"SmilesENAboveMeanFraction": _over(count(p.x > mean[p.row] + 1e-9, p.row), n), "SmilesENBelowMeanFraction": _over(count(p.x < mean[p.row] - 1e-9, p.row), n)}
    ends = [_first_by((kind_row, np.nan_to_num(value), kind_count), n_rows, by) for by in (lambda c: -c, lambda c: c)]
    out["SmilesENMostLeastCommonDiff"] = np.where(size > 0, np.abs(ends[0] - ends[1]), 0.0)
    out |= {f"SmilesENMean{k}": lists[k].mean for k in BY_GROUP}
    return {n: out[n] for n in names}


def _first_by(tally: tuple[np.ndarray, np.ndarray, np.ndarray], n_rows: int, by) -> np.ndarray:
    """Of each row's distinct values the one that is first by its number; of several the one that stands first."""
    row, value, number = tally
    order = np.lexsort((np.arange(len(row)), by(number), row))
    first = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))] if len(row) else np.zeros(0, np.int64)
    out = np.zeros(n_rows)
    out[row[first]] = value[first]
    return out


ELECTRONEGATIVITY = Family("electronegativity", "Electronegativity", _outputs, (_elements, _values, _lists, _means, _shape), _values_of)

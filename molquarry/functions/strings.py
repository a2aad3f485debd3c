"""Descriptors counted from the SMILES text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.dialect import Dialect
from molquarry.functions.family import Family
from molquarry.functions.tables import COUNTS, OVERLAPS, PATTERN_FRACTIONS, PATTERNS

HETERO = "[NOSP]"
AMIDE = PATTERNS["SmilesAmideCount"]
NITRO = r"N\(=O\)=O|\[N\+\]\(=O\)\[O-\]"


def _counts(d: Dialect) -> dict[str, str]:
    out = {n: d.total("s", xs) for n, xs in COUNTS.items()}
    out |= {n: "(" + " + ".join(d.overlapping("s", x) for x in xs) + ")" for n, xs in OVERLAPS.items()}
    out |= {
        "SmilesHalogenCount": d.total("s", ["F", "I", "f", "i", "Cl", "Br", "cl", "br"]),
        "SmilesAromaticHalogenCount": d.total("s", ["f", "i", "cl", "br"]),
        "SmilesComplexRingClosureCount": d.matches("s", "%[0-9][0-9]"),
        "SmilesTripleBondCount": d.total("s", ["#", "C#C", "C#N", "N#N"]),
        "SmilesZwitterionCount": d.flag(f"{d.has('s', '+')} AND {d.has('s', '-')}"),
        "SmilesAromaticBondCount": f"({d.matches('s', '[cnospfib]')} + {d.count('s', ':')})",
        "SmilesRingClosureCount": d.matches("s", "[0-9]"),
    }
    # An oxygen between a letter or ] and a letter other than H or [; neighbours are looked at, not consumed.
    if d.name == "spark":
        out["SmilesEtherCount"] = d.matches("s", r"(?<=[A-Za-z\]])O(?=[A-GI-Za-z\[])")
    else:
        # Without looking around: every O but those whose neighbour before, or after, doesn't fit. A neighbour of two is doubled.
        apart = "regexp_replace(s, '([^A-Za-z\\[\\]])', '\\1\\1', 'g')"
        before, after = r"(?:^|[^A-Za-z\]])", r"(?:[^A-GI-Za-z\[]|$)"
        out["SmilesEtherCount"] = f"{d.count('s', 'O')} - {d.matches('s', before + 'O')} - {d.matches('s', 'O' + after)} + {d.matches(apart, before + 'O' + after)}"
    return out


def _patterns(d: Dialect) -> dict[str, str]:
    return {n: d.matches("s", p) for n, p in PATTERNS.items()}


def _ratio_stage(d: Dialect) -> dict[str, str]:
    return {
        "n": "length(s)",
        **({} if d.name == "spark" else {"cs": d.letters("s")}),
        "carbons": d.total("s", ["C", "c"]),
        "nitrogens": d.total("s", ["N", "n"]),
        "hetero": d.matches("s", HETERO),
        "upper": d.matches("s", "[A-Z]"),
        "spelled": d.without("s", "[^A-Za-z]"),
    }


KETONE_TO_ESTER = [r"C\(=O\)C", r"C\(=O\)[H]", r"C\(=O\)N", r"C\(=O\)O"]


def _position_stage(d: Dialect) -> dict[str, str]:
    return {
        "capitals": d.array(*[d.number(d.count("s", chr(k))) for k in range(65, 91)]),
        "carbonyls": d.array(*[d.number(d.matches("s", p)) for p in KETONE_TO_ESTER]),
        "nitrogen_sum": d.position_sum("s", "Nn"),
        "nitrogen_squares": d.position_squares("s", "Nn"),
        "centres": d.count("s", "@"),
        "carbon_oxygen": d.when((f"carbons > 0 AND {d.total('s', ['O', 'o'])} > 0", f"1.0 - abs({d.ratio('carbons', d.total('s', ['O', 'o']))} - 1.0) * 0.5")),
    }


def _ratios(d: Dialect) -> dict[str, str]:
    m, total = (lambda p: d.matches("s", p)), (lambda *x: d.total("s", x))
    digit = lambda least: "(" + " + ".join(d.flag(f"{d.count('s', str(k))} >= {least}") for k in range(1, 10)) + ")"
    present = lambda *p: "(" + " + ".join(d.flag(f"{d.matches('s', x)} > 0") for x in p) + ")"
    # Each occurrence counts 1 at the start of the text and falls to a half at its end.
    weight = lambda n, xs: f"({n} - 0.5 * ({d.position_sum('s', xs)} - {n}) / greatest(n, 1))"
    twice = lambda x: d.when((f"{d.overlapping('s', x)} > 1", d.overlapping("s", x)), other="0")
    states = [(-3, r"N\([H]\)\([H]\)\([H]\)|\[NH3\]"), (-2, r"N\([H]\)\([H]\)C|\[NH2\]C"), (-1, r"N\([H]\)C|\[NH\]C"), (1, r"N=O|\[N\+\]=O"), (3, NITRO), (5, r"N\(=O\)\(=O\)=O")]
    ends = [r"\)C", r"\)O", r"\)N", r"\)[FClBrI]"]
    chain = d.max(d.map(d.found(d.without("spelled", "c"), "C+"), lambda x: f"length({x})"))
    # Matches may share characters; RE2, which looks neither ahead nor behind, takes them from runs.
    if d.name == "spark":
        alone = m(f"(?<!{HETERO}){HETERO}(?!{HETERO})")
        edge = m("(?<=.)[a-z](?=[A-Z])(?=.)|(?<=[A-Z])[a-z](?=.)")
        alternating = m("(?=[Cc][NOSPDnspd][Cc][NOSPDnspd])")
    else:
        alone = d.over_runs("s", f"{HETERO}+", "(n = 1)::INT")
        edge = f"({m('[A-Z][a-z]')} - {m('[A-Z][a-z](?:' + chr(10) + '|$)')} + {m('[a-z][A-Z]')} - {m('(?:^|' + chr(10) + ')[a-z][A-Z]')} - {d.over_runs('s', '[A-Z](?:[a-z][A-Z])+', '(n - 1) // 2')})"
        alternating = d.over_runs("s", "(?:[Cc][NOSPDnspd]){2,}", "n // 2 - 1")
    return {
        "SmilesBranchingIndex": d.ratio(d.count("s", "("), m("[A-Za-z]+")),
        "SmilesHeteroatomClustering": d.ratio(d.matches("spelled", f"{HETERO}+"), "hetero"),
        "SmilesAlternatingElementPattern": alternating,
        "SmilesAromaticRingEdge": edge,
        "SmilesChiralCenterDensity": d.ratio(d.count("s", "@"), "carbons"),
        "SmilesStructuralSymmetry": "(" + " + ".join(twice(x) for x in ("CC", "CCC", "CCCC", "C1CC1", "c1ccc", "CNC", "COC")) + ")",
        "SmilesRingBridgeCount": m(r"\][0-9]\)-\(\["),
        "SmilesAtomicEntropy": d.entropy("capitals"),
        "SmilesNitrogenPositionVariance": d.when(("nitrogens >= 2", f"{d.number('nitrogens * nitrogen_squares - nitrogen_sum * nitrogen_sum')} / ({d.number('nitrogens')} * nitrogens)")),
        "SmilesBondTypeDiversity": f"({d.flag(d.has('s', '-'))} + {d.flag(d.has('s', '='))} + {d.flag(d.has('s', '#'))} + {d.flag(d.like('s', '[a-z]'))}) / 4.0",
        "SmilesAdjacentHeteroatomRatio": d.ratio(f"(hetero - {alone})", "hetero"),
        "SmilesPositionWeightedHeteroRatio": d.ratio(weight("hetero", "NOSP"), weight(d.count("s", "C"), "C")),
        "SmilesFragmentComplexity": d.ratio(f"({d.integer(f'2 * {d.count("s", "[")} + 1.5 * {d.count("s", "(")}')} + {m('[0-9]')} + 3 * {d.count('s', '@')})", "n"),
        "SmilesOxygenClusteringFactor": d.ratio(d.overlapping("s", "OO"), d.count("s", "O")),
        "SmilesPrimaryAmineRatio": d.ratio(m(PATTERNS["SmilesPrimaryAmineCount"]), "nitrogens"),
        "SmilesMethylationDegree": d.ratio(m(r"\(C\)|C\)"), "carbons"),
        "SmilesCarbohydrateLikeness": f"(0.5 * greatest(carbon_oxygen, 0.0) + 0.5 * {d.ratio(m(r'OH|\[OH\]'), 'carbons')})",
        "SmilesTrifunctionalCarbonRatio": d.ratio(m(r"C\([^)]*\)\([^)]*\)\([^)]*\)"), d.count("s", "C")),
        "SmilesRingJunctionDensity": d.ratio(digit(2), digit(1)),
        "SmilesSulfurOxidationStateDistribution": d.ratio(f"(2 * {m(r'S\(=O\)')} + 4 * {m(r'S\(=O\)\(=O\)')})", d.count("s", "S")),
        "SmilesPhosphorusOxidationStateDistribution": d.ratio(f"(2 * {m(r'P\(=O\)')} + 5 * {m(r'P\(=O\)\(O\)\(O\)O')})", d.count("s", "P")),
        "SmilesHydrophilicGroupDensity": d.ratio(f"({m(r'OH|\[OH\]')} + {m(r'NH2|\[NH2\]')} + {m(r'C\(=O\)O')})", "upper"),
        "SmilesTerminalGroupDiversity": f"{present(*ends)} / 4.0",
        "SmilesNitrogenEnvironmentDiversity": d.when(("nitrogens > 0", f"{present(r'N\([H]\)', r'NC\(=O\)', 'n', NITRO)} / 4.0")),
        "SmilesChainLengthDistribution": d.ratio(chain, d.count("s", "C")),
        "SmilesCarbonAromaticityFraction": d.ratio(d.count("s", "c"), "carbons"),
        "SmilesNitrogenAromaticityFraction": d.ratio(d.count("s", "n"), "nitrogens"),
        "SmilesChiralityDistribution": d.when(("centres >= 2", f"{d.number(d.position_spread('s', '@'))} / (centres - 1) / n")),
        "SmilesFluorineToCarbonRatio": d.ratio(d.count("s", "F"), "carbons"),
        "SmilesHeterocycleCountNormalized": d.ratio("(" + " + ".join(m(f"[a-z]*{x}[a-z]*[0-9]") for x in "nos") + ")", digit(1)),
        "SmilesCarbonylDistribution": f"({d.entropy('carbonyls')}) / 2.0",
        "SmilesNitrogenOxidationStateDistribution": d.ratio("(" + " + ".join(f"({k}) * {m(p)}" for k, p in states) + ")", "nitrogens"),
        "SmilesAmideToNitrogenRatio": d.ratio(m(AMIDE), "nitrogens"),
    }


#: Characters whose share of the text is taken.
SHARES = {
    "Carbon": "C", "Nitrogen": "N", "Oxygen": "O", "Sulfur": "S", "Phosphorus": "P", "Boron": "B", "Fluorine": "F", "Iodine": "I",
    "AromaticCarbon": "c", "AromaticNitrogen": "n", "AromaticOxygen": "o", "AromaticSulfur": "s", "SingleBond": "-", "DoubleBond": "=", "TripleBond": "#",
    "BranchOpen": "(", "BranchClose": ")", "BracketAtom": "[", "PositiveCharge": "+",
}


def _fractions(d: Dialect) -> dict[str, str]:
    of = lambda x: d.ratio(x, "length(s)")
    out = {f"Smiles{n}Fraction": of(d.count("s", c)) for n, c in SHARES.items()}
    return out | {
        "SmilesHalogenFraction": of(d.total("s", ["F", "I", "Cl", "Br"])),
        "SmilesRingClosureFraction": of(d.matches("s", "[0-9]")),
        "SmilesNegativeChargeFraction": of(d.count("s", "-")),
        "SmilesAmideFraction": of(d.matches("s", r"([Cc])\(=O\)N|NC\(=O\)|\[C\(=O\)N\]|\[NC\(=O\)\]|\[C;H0;X3\]\(=O\)N")),
    }


def _pattern_fractions(d: Dialect) -> dict[str, str]:
    return {n: d.ratio(d.matches("s", p), "length(s)") for n, p in PATTERN_FRACTIONS.items()}


#: Counts that are documented under these names: those that have a share of the same name count its pattern.
OF_SHARES = (
    "AcidicPhosphorus", "AcidicSulfur", "AliphaticNitro", "Alkene", "AlkylHalide", "AmidineBasic", "Amidine", "Amino", "Ammonium", "AromaticNitrogenCarbon", "AromaticSequence",
    "BranchedAmine", "BranchedEther", "CarbamatePatterns", "Ethyl", "Guanidine", "Imidazole", "IonizableCarboxyl", "IonizablePhosphonate", "IonizableThiol", "IsothiocyanateLinear",
    "Isotope", "LongCarbonChain", "Methoxy", "Methyl", "MixedHeteroatomRing", "OxygenAromaticRing", "Phosphonate", "Phosphonium", "PrimaryAmineBasic", "PyridineBasic",
    "QuaternaryAmmonium", "QuaternaryCarbon", "SecondaryAmineBasic", "Sulfonium", "Sulfonyl", "Sulfoxide", "TerminalAlkyne", "TertiaryAmine",
)
DOCUMENTED_COUNTS = {
    "SmilesAromaticPhosphorusCount": "p",
    "SmilesFluoromethylCount": r"CF|\[CH2\]F",
    "SmilesGeneralNitroCount": r"NO2|\[N\+\]\(=O\)\[O-\]|N\(=O\)=O",
    "SmilesGuanidiniumCount": r"\[NH2\]C\(=NH2\+\)NH2|NC\(=\[NH2\+\]\)N|\[NH2\+\]=C\(N\)N",
    "SmilesPhosphonicAcidCount": r"PO3H2|\[PO3H2\]|P\(=O\)\(O\)O",
    "SmilesSiliconCount": "Si",
}
RING_SIZES = {"Five": 5, "Six": 6, "Seven": 7, "Eight": 8}


def _closures(size: int) -> str:
    """A ring closure whose two ends have about so many characters between them: a digit, or a number of two digits."""
    between = f"{{{size - 2},{size}}}"
    return "|".join([*(f"{k}[^1-9]{between}{k}" for k in range(1, 10)), f"%[0-9][0-9][^%0-9]{between}%[0-9][0-9]"])


def _documented(d: Dialect) -> dict[str, str]:
    out = {f"Smiles{n}Count": d.matches("s", PATTERN_FRACTIONS[f"Smiles{n}Fraction"]) for n in OF_SHARES}
    out |= {n: d.matches("s", p) for n, p in DOCUMENTED_COUNTS.items()}
    for n, size in RING_SIZES.items():
        out |= {f"Smiles{n}RingCount": d.matches("s", _closures(size)), f"Smiles{n}RingFraction": d.ratio(d.matches("s", _closures(size)), "length(s)")}
    return out | {"SmilesAromaticPhosphorusFraction": d.ratio(d.count("s", "p"), "length(s)")}


STRING_COUNTS = Family("string_counts", "SmilesText", _counts)
STRING_PATTERNS = Family("string_patterns", "SmilesText", _patterns)
STRING_RATIOS = Family("string_ratios", "SmilesText", _ratios, (_ratio_stage, _position_stage))
STRING_DOCUMENTED = Family("string_documented", "SmilesText", _documented)
CHAR_FRACTIONS = Family("char_fractions", "SmilesFraction", _fractions)
PATTERN_SHARES = Family("pattern_fractions", "SmilesFraction", _pattern_fractions)


def _forked_carbons(s: str) -> float:
    """Carbons before a branch from which on three branches open at their depth, up to the end of the text."""
    depth, last, opened, at = 0, s.rfind(")"), {}, []
    for i, c in enumerate(s):
        if c == "(":
            if i and s[i - 1] == "C" and i < last:
                at.append((depth, opened.get(depth, 0)))
            opened[depth] = opened.get(depth, 0) + 1
            depth += 1
        elif c == ")":
            depth -= 1
    return float(sum(opened[d] - before >= 3 for d, before in at))


def _other_backbone(s: str) -> float:
    """Share of the capitals outside all branches that are not C."""
    depth = capitals = others = 0
    for c in s:
        depth += (c == "(") - (c == ")")
        if depth == 0 and "A" <= c <= "Z":
            capitals += 1
            others += c != "C"
    return others / capitals if capitals else 0.0


#: Descriptors that follow the depth of branches.
SCANS: dict[str, Callable[[str], float]] = {"SmilesTertiaryCarbonCount": _forked_carbons, "SmilesNonCarbonBackboneRatio": _other_backbone}


def add_scans(df: DataFrame, text: Column, names: Sequence[str] = tuple(SCANS)) -> DataFrame:
    """``df`` with the descriptors that follow the depth of branches."""
    return df.withColumn("__scans", scans(text, names)).select(*df.columns, "__scans.*")


def scans(text: Column, names: Sequence[str]) -> Column:
    """A struct of the descriptors that follow the depth of branches; a null text is empty."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame([[SCANS[n](s) for n in names] for s in series], columns=list(names), dtype=float)

    return scanned(F.coalesce(text, F.lit("")))

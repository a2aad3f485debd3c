"""Ordered decision lists for acidity and basicity: the first pattern that is found decides."""

from __future__ import annotations

from molquarry.functions.dialect import Dialect
from molquarry.functions.family import Family

# Patterns and what they are worth.
CARBOXYL = r"C\(=O\)O|C\(O\)=O|COOH|\[C\]\(=O\)O|C\(=O\)\[O-\]|\[C\]\(O\)=O|\[C\]\(=O\)\[O-\]|C\(=O\)\[OH\]|C\(=O\)O\[H\]"
AROMATIC_ACID = r"c.*(?:C\(=O\)O|COOH|C\(=O\)\[O-\]|C\(=O\)O\[H\])"
PHENOL = r"cO|cOH|c\[OH\]|c\(O\)|c\(OH\)|c\[O\]H|cO\[H\]"
NITRO = r"\[N\+\]\(=O\)\[O-\]|NO2"
TERTIARY = r"N\([^)]*\)\([^)]*\)\([^)]*\)|N\(C\)\(C\)\(C\)|N\(CH3\)\(CH3\)\(CH3\)"
SECONDARY = r"N\([^)]*\)\([^)]*\)|N\(C\)\(C\)|N\(CH3\)\(CH3\)"
HYDROXYL_DONOR, AMINE_DONOR = r"O(H)?([^=)|$])", r"N(H)?([^=+#]|$)"


def _lists(d: Dialect) -> dict[str, str]:
    like = lambda p: d.like("s", p)
    no = lambda p: (f"NOT {like(p)}", "0.0")
    is_ = lambda p, v: (like(p), str(v))
    points = lambda *of: "(" + " + ".join(f"CASE WHEN {like(p)} THEN {v} ELSE 0.0 END" for p, v in of) + ")"
    amide = r"C\(=O\)N"
    return {
        "SmilesCarboxylicAcidAcidity": d.when(no(CARBOXYL), is_(AROMATIC_ACID, 4.2), other="4.8"),
        "SmilesPhenolAcidity": d.when(no(PHENOL), is_(NITRO, 7.2), other="10.0"),
        "SmilesAmineCount": d.matches("s", "N"),
        "SmilesAmineBasicity": d.when(no("N"), is_("cN", 4.6), is_(TERTIARY, 9.8), is_(SECONDARY, 10.7), other="10.6"),
        "SmilesThiolAcidity": d.when(no("S"), is_("cS", 6.5), is_("OC.*S", 9.5), other="10.5"),
        "SmilesAlphaHAcidityIndex": points(("C=O", 5.0), (r"C\(=O\)O", 3.0), (r"\[N\+\]\(=O\)\[O-\]", 8.0), ("C#N", 6.0), (r"C\(=O\)CC\(=O\)", 10.0)),
        "SmilesImideAcidity": d.when(no(r"C\(=O\)NC\(=O\)"), is_(r"C1CC\(=O\)NC1=O", 9.5), is_(r"c1ccccc1C\(=O\)NC\(=O\)", 8.3), other="10.0"),
        "SmilesHBondDonorCount": f"({d.matches('s', HYDROXYL_DONOR)} + {d.matches('s', AMINE_DONOR)})",
        "SmilesPkaHBondStrength": points((r"C\(=O\)O", 5.0), (r"cO(H)?([^=)|$])", 3.0), (r"C.*O(H)?([^=)|$])", 1.0), (AMINE_DONOR, 2.0)),
        "SmilesAmideResonanceIndex": d.when(no(amide), other=f"(1.0 - {points((r'C\(=O\)N\([^)]*\[.+\]\)', 0.3))} + {points((r'\[.+\].*C\(=O\)N', 0.3))})"),
        "SmilesSulfonicAcidAcidity": d.when(is_(r"S\(=O\)\(=O\)O[H]?", 0.5)),
        "SmilesPhosphonicAcidAcidity": d.when(is_(r"P\(=O\)\(O[H]?\)O[H]?", 2.0)),
        "SmilesNHeterocycleBasicity": d.when(is_("n1ccccc1", 5.2), is_("n1cncc1", 7.0), is_("N1CCCCC1", 11.2), is_("N1CCCC1", 11.3)),
        "SmilesSulfonamideAcidity": d.when(no(r"S\(=O\)\(=O\)N"), is_(r"S\(=O\)\(=O\)N.*n", 7.0), other="10.0"),
        "SmilesHydroxamicAcidAcidity": d.when(is_(r"C\(=O\)N.*O[H]?", 9.0)),
        "SmilesSulfinicAcidAcidity": d.when(is_(r"S\(=O\)O[H]?", 2.0)),
        "SmilesHydrazineBasicity": d.when(is_(r"N(\[[^\]]+\])?N", 8.0)),
    }


ACIDITY = Family("acidity", "PkaEstimation", _lists)

"""Descriptors of molecular graphs.

An Arrow function parses the texts of a batch to atoms, bonds, rings and paths, as arrays of structs. All
descriptors are Spark's expressions over these arrays: counts, sums and extremes of flags and element values,
pairs by distance joined to the atoms at their ends. So a plan shows what a value is made of, and only what the
wanted names need is parsed and worked out. No row is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions import elements as E
from molquarry.functions.paths import Paths
from molquarry.functions.smiles import SP, SP2, SP3, Molecule, S, SmilesError

_ATOM = {"z": pa.int32(), "degree": pa.int32(), "charge": pa.int32(), "hydrogens": pa.int32(), "valence": pa.int32(), "hybrid": pa.int32(), "aromatic": pa.bool_(), "ring": pa.bool_(), "chiral": pa.bool_(), "part": pa.int32()}
_BOND = {"a": pa.int32(), "b": pa.int32(), "ord": pa.float64(), "rings": pa.int32(), "rotatable": pa.bool_(), "stereo": pa.bool_()}
#: What a parsed text is. Rings are given by the places of their atoms and bonds, hybrid by 0 s, 1 sp, 2 sp2, 3 sp3. Of each atom ``far`` is the distance
#: to the farthest one and ``sums`` the sum of distances; ``counts`` has the numbers of pairs at distance 1, 2, ... and ``pairs`` these pairs.
PARSED = """atoms array<struct<z int, degree int, charge int, hydrogens int, valence int, hybrid int, aromatic boolean, ring boolean, chiral boolean, part int>>,
    bonds array<struct<a int, b int, ord double, rings int, rotatable boolean, stereo boolean>>, rings array<struct<atoms array<int>, bonds array<int>>>, parts int,
    far array<int>, sums array<bigint>, counts array<bigint>, pairs array<array<struct<i int, j int>>>"""


def _lists(values: pa.Array, sizes: Sequence[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)), values)


def _structs(columns: Mapping[str, np.ndarray], types: Mapping[str, pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(columns[n], t) for n, t in types.items()], list(types))


def _hybrids(z: np.ndarray, charge: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all atoms of a batch the hybridisation, and of all bonds whether they are conjugated."""
    n = len(z)
    a, b = ends[:, 0], ends[:, 1]
    at = lambda test: np.bincount(np.concatenate([a[test], b[test]]), minlength=n)
    pi, hetero = at(order > 1) > 0, np.isin(z, (7, 8, 16))
    lone = hetero & (charge <= 0)
    conjugated = (order == 1.5) | ((order == 1) & ((pi[a] & pi[b]) | (pi[a] & lone[b]) | (pi[b] & lone[a])))
    beside = at(conjugated & (order == 1)) > 0
    conjugated |= (order == 2) & (beside[a] | beside[b])
    hybrid = np.where(pi | (hetero & (at(conjugated) > 0)), SP2, SP3)
    hybrid[(at(order == 3) > 0) | (at(order == 2) > 1)] = SP
    hybrid[z == 1] = S
    return hybrid, conjugated


def parsed_batch(texts: Sequence[str], listed: int | None, with_paths: bool) -> pa.StructArray:
    """Texts as the struct PARSED; null for one that is no molecule."""
    found: list[Molecule | None] = []
    for s in texts:
        try:
            found.append(Molecule(s))
        except SmilesError:
            found.append(None)
    none = np.array([m is None for m in found], bool)
    some = [m for m in found if m is not None]
    rows = np.flatnonzero(~none)

    def spread(sizes: Sequence[int] | np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.int64)
        out[rows] = sizes
        return out

    whole = lambda name, kind: np.fromiter((x for m in some for x in getattr(m, name)), kind)
    atoms = {n: whole(n, np.int32) for n in ("z", "charge", "hydrogens", "valence")} | {n: whole(n, bool) for n in ("aromatic", "chiral")}
    sizes, n_ends = np.array([len(m.z) for m in some], np.int64), np.array([len(m.ends) for m in some], np.int64)
    ends = np.fromiter((x for m in some for e in m.ends for x in e), np.int64).reshape(-1, 2)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else np.zeros(0, np.int64)
    joined = ends + np.repeat(begin, n_ends)[:, None]
    order, rings_of_bond, n = whole("order", float), whole("bond_rings", np.int32), len(atoms["z"])
    hybrid, conjugated = _hybrids(atoms["z"], atoms["charge"], joined, order)
    degree = np.bincount(joined.ravel(), minlength=n)
    plain = lambda side: (degree[side] > 1) & (atoms["z"][side] != 1)
    atoms |= {"hybrid": hybrid, "degree": degree, "ring": whole("atom_rings", np.int32) > 0, "part": whole("fragment", np.int32)}
    bonds = {"a": ends[:, 0], "b": ends[:, 1], "ord": order, "rings": rings_of_bond, "rotatable": (order == 1) & ~conjugated & (rings_of_bond == 0) & plain(joined[:, 0]) & plain(joined[:, 1]), "stereo": whole("stereo", bool)}
    of_rings = ([r for m in some for r in m.rings], [r for m in some for r in m.ring_bonds])
    ring = pa.StructArray.from_arrays([_lists(pa.array([a for r in x for a in r], pa.int32()), [len(r) for r in x]) for x in of_rings], ["atoms", "bonds"])
    n_atoms, n_bonds, n_rings = spread(sizes), spread(n_ends), spread([len(m.rings) for m in some])
    if with_paths:
        paths = Paths([m.near for m in some], listed)
        ends_of = _structs({"i": paths.first, "j": paths.second}, {"i": pa.int32(), "j": pa.int32()})
        tails = [_lists(pa.array(paths.farthest, pa.int32()), n_atoms), _lists(pa.array(paths.sums, pa.int64()), n_atoms), _lists(pa.array(paths.counts, pa.int64()), spread(paths.longest)), _lists(_lists(ends_of, paths.listed_counts), spread(paths.listed_steps))]
    else:
        tails = [pa.nulls(len(found), pa.list_(pa.int32())), *(pa.nulls(len(found), pa.list_(pa.int64())) for _ in range(2)), pa.nulls(len(found), pa.list_(pa.list_(pa.struct({"i": pa.int32(), "j": pa.int32()}))))]
    columns = [_lists(_structs(atoms, _ATOM), n_atoms), _lists(_structs(bonds, _BOND), n_bonds), _lists(ring, n_rings), pa.array(spread([m.fragments() for m in some]), pa.int32()), *tails]
    return pa.StructArray.from_arrays(columns, ["atoms", "bonds", "rings", "parts", "far", "sums", "counts", "pairs"], mask=pa.array(none))


def _tally(values: Column) -> Column:
    """A map of the different values of an array to their numbers."""
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("key"), F.size(F.filter(values, lambda y: y == v)).alias("value"))))


def element_counts(molecule: Column) -> Column:
    """A map of atomic numbers to the atoms of a parsed molecule; null for a text that is none."""
    return _tally(F.transform(molecule["atoms"], lambda x: x["z"]))


def ring_sizes(molecule: Column) -> Column:
    """A map of sizes to the rings of a parsed molecule; empty without rings, null for a text that is none."""
    return _tally(F.transform(molecule["rings"], lambda x: F.size(x["atoms"])))


#: Texts that are parsed at once.
SLICE = 1024


def parsed(smiles: Column, listed: int | None = 8, with_paths: bool = True) -> Column:
    """A text as a struct PARSED of atoms, bonds, rings and paths; null for a text that is no molecule, or null.

    ``listed`` is the longest distance whose pairs are listed (all for None, which takes half the square of the
    atoms). Long and odd texts are parsed like any other; one that is no molecule never ends the job.
    """

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [parsed_batch(batch.slice(a, SLICE).to_pylist(), listed, with_paths) for a in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts or [parsed_batch([], listed, with_paths)])

    # A filter on what is parsed would else be pushed down with a second run of the function, below distinct() over all rows.
    return run.asNondeterministic()(F.coalesce(smiles, F.lit("")))


def _given(table: Mapping[int, float], factor: str = "1D") -> str:
    """The value of an element by its number x.z, 0 without one."""
    values = ", ".join(f"{float(table.get(z, 0.0))!r}D" for z in range(max(table) + 1))
    return f"coalesce(get(array({values}), x.z), 0D) * {factor}"


def total(rows: str, value: str) -> str:
    """Sum of an expression over x of an array."""
    return f"aggregate({rows}, 0D, (s, x) -> s + ({value}))"


def count(rows: str, test: str) -> str:
    return f"size(filter({rows}, x -> {test}))"


def ratio(a: str, b: str) -> str:
    """0 where there is nothing to divide by."""
    return f"(CASE WHEN ({b}) = 0 THEN 0D ELSE ({a}) / ({b}) END)"


def entropy(values: str) -> str:
    """Bits of the distribution of an array's values."""
    shares = f"transform(array_distinct({values}), v -> size(filter({values}, y -> y = v)) / size({values}))"
    return f"aggregate({shares}, 0D, (s, p) -> s - p * log2(p))"


def mode(values: str) -> str:
    """The most frequent value, the smallest of several; 0 for none."""
    return f"coalesce(-array_max(transform(array_distinct({values}), v -> named_struct('c', size(filter({values}, y -> y = v)), 'v', -v))).v, 0D)"


def _in(values: set[int]) -> str:
    return ", ".join(map(str, sorted(values)))


_TOPOLOGY = f"(CASE WHEN x.z = 6 THEN 1D WHEN x.z IN (7, 8) THEN 2D WHEN x.z IN (15, 16) THEN 3D WHEN x.z IN ({_in(E.HALOGENS)}) THEN 4D ELSE 1.5D END * IF(x.aromatic, 1.5D, 1D))"
#: Increments of the additive estimates, by element: area without and with hydrogens; for carbon aromatic or not; by bond order. Fixed values.
POLAR_AREA = {7: (15.6, 17.5), 8: (13.1, 17.0), 15: (13.6, 13.6), 16: (25.3, 25.3)}
LOG_P = {6: (0.08, 0.13), 7: (-0.2, -0.2), 8: (-0.5, -0.5), 9: (0.14, 0.14), 15: (0.2, 0.2), 16: (0.25, 0.25), 17: (0.5, 0.5), 35: (0.6, 0.6), 53: (0.73, 0.73)}
REFRACTIVITY = {6: (2.4, 3.1), 7: (1.7, 1.7), 8: (1.3, 1.3), 9: (0.5, 0.5), 16: (7.3, 7.3), 17: (5.5, 5.5), 35: (8.7, 8.7), 53: (14.0, 14.0)}
REFRACTIVITY_OF_BOND = {2.0: 1.7, 3.0: 2.2}


def _either(table: Mapping[int, tuple[float, float]], test: str) -> str:
    parts = " ".join(f"WHEN {z} THEN {f'IF({test}, {b!r}D, {a!r}D)' if a != b else f'{a!r}D'}" for z, (a, b) in table.items())
    return f"CASE x.z {parts} ELSE 0D END"


#: Values of an atom x beside the parsed ones, by name.
ATOM_VALUES = {
    "mass": _given(E.MASS), "en": _given(E.PAULING), "r_cov": _given(E.COVALENT_RADIUS), "r_vdw": _given(E.VDW_RADIUS), "pol": _given(E.POLARIZABILITY), "ion": _given(E.IONIZATION),
    "hetero": "x.z NOT IN (1, 6)", "halogen": f"x.z IN ({_in(E.HALOGENS)})",
}
_FIELDS = (*_ATOM, *ATOM_VALUES)
#: Columns that families share; each reads the parsed struct ``m`` and columns above it.
STAGES: dict[str, str] = {
    "atoms": "m.atoms", "bonds": "m.bonds", "n": "CAST(size(m.atoms) AS DOUBLE)", "nb": "CAST(size(m.bonds) AS DOUBLE)",
    "a": "transform(m.atoms, (x, i) -> named_struct('i', i, " + ", ".join(f"'{f}', x.{f}" for f in _ATOM) + ", " + ", ".join(f"'{f}', {e}" for f, e in ATOM_VALUES.items()) + "))",
    "b": "transform(m.bonds, x -> named_struct('a', x.a, 'b', x.b, 'ord', x.ord, 'rings', x.rings, 'rotatable', x.rotatable, 'stereo', x.stereo, " + ", ".join(f"'p_{f}', a[x.a].{f}, 'q_{f}', a[x.b].{f}" for f in ("z", "degree", "aromatic", "ring", "hybrid", "hetero", "halogen", "en")) + "))",
    "r": "transform(m.rings, g -> named_struct('size', size(g.atoms), 'atoms', g.atoms, 'aromatic', forall(g.bonds, k -> m.bonds[k].ord = 1.5), 'lettered', forall(g.atoms, k -> m.atoms[k].aromatic), 'carbon', forall(g.atoms, k -> m.atoms[k].z = 6), 'mixed', exists(g.atoms, k -> m.atoms[k].z NOT IN (1, 6)), 'saturated', forall(g.bonds, k -> m.bonds[k].ord = 1)))",
    "orders": "transform(m.bonds, x -> x.ord)",
    "polarity": "transform(b, x -> abs(x.p_en - x.q_en))",
    "tenths": "transform(polarity, x -> floor(x * 10 + 0.5) / 10)",
    "single": count("b", "x.ord = 1"), "double": count("b", "x.ord = 2"), "triple": count("b", "x.ord = 3"), "ring_1_5": count("b", "x.ord = 1.5"), "rotatable": count("b", "x.rotatable"),
    "degrees": "transform(m.atoms, x -> x.degree)",
    "squares": total("degrees", "CAST(x AS DOUBLE) * x"),
    "sums": "transform(b, x -> CAST(x.p_degree + x.q_degree AS DOUBLE))",
    "mean_sum": ratio(total("sums", "x"), "nb"),
    "wiener": total("m.sums", "x") + " / 2",
    "far": "m.far", "diameter": "CAST(array_max(m.far) AS DOUBLE)", "radius": "CAST(coalesce(array_min(filter(m.far, x -> x > 0)), 0) AS DOUBLE)",
    "mean_far": total("m.far", "x") + " / n",
    # Pairs of one part: the square of a sum holds each of them twice, and each atom with itself.
    "reach": "aggregate(sequence(0, m.parts - 1), 0D, (s, f) -> s + (pow(aggregate(filter(zip_with(m.sums, m.atoms, (d, x) -> IF(x.part = f AND d > 0, 1 / sqrt(d), 0D)), y -> y > 0), 0D, (t, y) -> t + y), 2) - aggregate(filter(zip_with(m.sums, m.atoms, (d, x) -> IF(x.part = f AND d > 0, 1D / d, 0D)), y -> y > 0), 0D, (t, y) -> t + y)) / 2)",
    "root": total("degrees", "IF(x > 0, 1 / sqrt(x), 0D)"),
    "randic": total("b", "1 / sqrt(x.p_degree * x.q_degree)"),
    "kappa1": "IF(n > 1, root * root / (n * (n - 1)), 0D)", "kappa2": "IF(n > 2, root * root / (n * (n - 2)), 0D)", "kappa3": "IF(n > 3, root * root / (n * (n - 3)), 0D)",
    "heavy": count("a", "x.z > 1"),
    "sizes": "transform(r, x -> x.size)", "n_rings": "CAST(size(m.rings) AS DOUBLE)",
    "shared": "IF(size(m.rings) < 2, array(), flatten(transform(m.rings, (g, k) -> transform(slice(m.rings, k + 2, size(m.rings)), h -> array_intersect(g.atoms, h.atoms)))))",
    "spiro": "size(array_distinct(flatten(filter(shared, x -> size(x) = 1))))",
    "heads": "size(array_distinct(flatten(transform(filter(shared, x -> size(x) > 2), x -> filter(x, k -> size(filter(m.bonds, y -> (y.a = k AND array_contains(x, y.b)) OR (y.b = k AND array_contains(x, y.a)))) = 1)))))",
    "ends": count("a", "x.z > 1 AND x.degree = 1"), "forks": count("a", "x.z > 1 AND x.degree > 2"),
    "kinds": "transform(a, x -> x.z * 1000 + x.degree * 100 + 10 * CAST(x.aromatic AS INT) + x.charge + 5)",
    "h_kinds": entropy("kinds"), "h_orders": entropy("orders"),
    # End oxygens, double-bonded to a carbon that has another oxygen.
    "acids": "transform(filter(transform(filter(b, x -> x.ord = 2 AND ((x.p_z = 8 AND x.p_degree = 1 AND x.q_z = 6) OR (x.q_z = 8 AND x.q_degree = 1 AND x.p_z = 6))), x -> named_struct('o', IF(x.p_z = 8, x.a, x.b), 'c', IF(x.p_z = 8, x.b, x.a))), o -> size(filter(b, x -> (x.a = o.c AND x.q_z = 8) OR (x.b = o.c AND x.p_z = 8))) > 1), o -> o.o)",
    "w": f"transform(a, x -> named_struct('z', x.z, 'w', IF(x.z = 53, {E.TEXT_WEIGHT['I']!r}D, x.mass * 6.022e26D), 'aromatic', x.aromatic, 'ring', x.ring, 'hybrid', x.hybrid, 'charge', x.charge, 'en', x.en, 'hetero', x.hetero, 'halogen', x.halogen, 'basic', x.z = 7 AND NOT x.aromatic AND x.charge = 0 AND x.valence = 3, 'acid', array_contains(acids, x.i)))",
    "weight": total("w", "x.w"),
    "positive": "transform(filter(a, x -> x.en > 0), x -> x.en)", "carbons": count("a", "x.z = 6"), "parts_cyclic": "nb - n + m.parts",
    "en": "transform(a, x -> x.en)", "pol": "transform(a, x -> x.pol)",
    "tw": f"transform(m.atoms, x -> {_TOPOLOGY})",
    "close": "transform(m.sums, d -> IF(d > 0, (n - 1) / d, 0D))",
    "mean_close": total("close", "x") + " / n",
    "central": "filter(sequence(0, size(m.atoms) - 1), i -> close[i] * (1 - 1e-12D) > mean_close)",  # not by rounding alone
    "polars": "filter(a, x -> x.z IN (7, 8, 15, 16))",
}


@dataclass(frozen=True)
class Descriptors:
    """A family: expressions by name over the parsed struct ``m`` and the shared stages.

    ``stages`` are columns of its own; ``listed`` is the longest distance whose pairs it reads, 0 for none.
    """

    category: str
    values: dict[str, str]
    stages: dict[str, str] = field(default_factory=dict)
    listed: int | None = 0


def _bonds() -> Descriptors:
    share = lambda test: ratio(count("b", test), "nb")
    either, both = (lambda t: share(f"({t('p')}) OR ({t('q')})")), (lambda t: share(f"({t('p')}) AND ({t('q')})"))
    flag = lambda name: lambda e: f"x.{e}_{name}"
    out = {"BondCount": "nb", "RotatableBondCount": "rotatable", "SingleBondCount": "single", "DoubleBondCount": "double", "TripleBondCount": "triple", "AromaticBondCount": "ring_1_5"}
    out |= {"DoubleToSingleBondRatio": ratio("double", "single"), "TripleToSingleBondRatio": ratio("triple", "single"), "AromaticBondFraction": ratio("ring_1_5", "nb")}
    out |= {"MaxBondPolarity": "coalesce(array_max(polarity), 0D)", "MinBondPolarity": "coalesce(array_min(polarity), 0D)", "MaxBondOrder": "coalesce(array_max(orders), 0D)", "MinBondOrder": "coalesce(array_min(orders), 0D)"}
    out |= {"MostCommonBondOrder": mode("orders"), "MostCommonBondPolarity": mode("tenths"), "UniqueBondOrderCount": "size(array_distinct(orders))", "UniqueBondPolarityCount": "size(array_distinct(tenths))"}
    out |= {"FractionBondsToHeteroatoms": either(flag("hetero")), "FractionBondsBetweenHeteroatoms": both(flag("hetero")), "FractionCCBonds": both(lambda e: f"x.{e}_z = 6")}
    out |= {"FractionRingBonds": share("x.rings > 0"), "FractionSingleRingBonds": share("x.rings > 0 AND x.ord = 1"), "FractionDoubleRingBonds": share("x.rings > 0 AND x.ord = 2"), "FractionRotatableBonds": ratio("rotatable", "nb")}
    out |= {"FractionBondsWithAromaticAtom": either(flag("aromatic")), "FractionBondsBothAromaticAtoms": both(flag("aromatic"))}
    for name, code in (("Sp3", 3), ("Sp2", 2), ("Sp", 1)):
        out |= {f"FractionBondsWith{name}Atom": either(lambda e, c=code: f"x.{e}_hybrid = {c}"), f"FractionBondsBoth{name}Atoms": both(lambda e, c=code: f"x.{e}_hybrid = {c}")}
    out |= {"FractionBondsWithHalogen": either(flag("halogen")), "FractionBondsWithRingAtom": either(flag("ring")), "FractionBondsBothRingAtoms": both(flag("ring")), "FractionBondsRingToNonRing": share("x.p_ring <> x.q_ring")}
    return Descriptors("BondStatistics", out)


def _graph() -> Descriptors:
    out = {"NumAtoms": "n", "NumBonds": "nb", "NumHeavyAtomsGraph": "heavy", "EdgeNodeRatio": "nb / n", "GraphDensity": ratio("2 * nb", "n * (n - 1)")}
    harary = "aggregate(zip_with(m.counts, sequence(1, greatest(size(m.counts), 1)), (c, d) -> coalesce(c, 0L) / d), 0D, (s, x) -> s + x)"
    out |= {"WienerIndex": "wiener", "MeanWienerIndex": ratio("wiener", "n * (n - 1) / 2"), "HararyIndex": harary, "GraphDiameter": "diameter", "GraphRadius": "radius", "MinAtomEccentricity": "radius", "MaxAtomEccentricity": "diameter"}
    out |= {"MeanAtomEccentricity": "mean_far", "VarianceAtomEccentricity": total("far", "CAST(x AS DOUBLE) * x") + " / n - mean_far * mean_far", "PetitjeanIndex": ratio("diameter - radius", "radius")}
    out["BalabanJIndex"] = "IF(n > 2 AND nb - n + 1 > 0, (nb + 0.5) * reach / nullif(nb - n + 1, 0D), 0D)"
    out |= {"MinAtomDegree": "array_min(degrees)", "MaxAtomDegree": "array_max(degrees)", "MeanAtomDegree": "degree_sum / n", "VarianceAtomDegree": "squares / n - pow(degree_sum / n, 2)"}
    stages = {"m2": total("b", "x.p_degree * x.q_degree"), "degree_sum": total("degrees", "x")}
    for k, name in enumerate(("Zero", "One", "Two", "Three", "Four", "FivePlus")):
        stages[f"degree_{k}"] = count("degrees", f"least(x, 5) = {k}")
        out |= {f"NumDegree{name}Atoms": f"degree_{k}", f"FractionDegree{name}Atoms": f"degree_{k} / n"}
    out |= {"PlattIndex": "squares", "QuadraticIndex": "squares", "ZagrebIndexM1": "squares", "ZagrebIndexM2": "m2", "MeanZagrebIndexM1": "squares / n", "MeanZagrebIndexM2": "m2 / n"}
    out |= {"MeanBondDegreeSum": "mean_sum", "VarianceBondDegreeSum": f"{ratio(total('sums', 'x * x'), 'nb')} - mean_sum * mean_sum", "RandicIndex": "randic"}
    out |= {"KierKappa1": "kappa1", "KierKappa2": "kappa2", "KierKappa3": "kappa3", "KierAlpha": total("a", "CASE x.z WHEN 6 THEN 0.05D WHEN 7 THEN 0.15D WHEN 8 THEN 0.2D WHEN 16 THEN 0.25D ELSE 0.1D END"), "KierPhi": ratio("kappa1 * kappa3", "kappa2 * kappa2")}
    out |= {"CyclomaticNumber": "nb - n + 1", "NumRings": "n_rings", "NumFusedRingsEstimate": total("b", "greatest(0, x.rings - 1)")}
    for name, test in (("AliphaticRings", "NOT x.aromatic"), ("AliphaticCarbocycles", "NOT x.aromatic AND x.carbon"), ("AliphaticHeterocycles", "NOT x.aromatic AND NOT x.carbon"), ("AromaticCarbocycles", "x.aromatic AND x.carbon"), ("AromaticHeterocycles", "x.aromatic AND NOT x.carbon"), ("SaturatedRings", "x.saturated"), ("SaturatedCarbocycles", "x.saturated AND x.carbon"), ("SaturatedHeterocycles", "x.saturated AND NOT x.carbon"), ("AromaticRings", "x.aromatic")):
        out[f"Num{name}"] = count("r", test)
    out |= {"NumSpiroAtoms": "spiro", "NumBridgeheadAtoms": "heads", "FractionAtomsInRings": count("a", "x.ring") + " / n", "FractionBondsInRings": ratio(count("b", "x.rings > 0"), "nb")}
    out |= {"MinRingSize": "coalesce(array_min(sizes), 0)", "MaxRingSize": "coalesce(array_max(sizes), 0)", "MeanRingSize": ratio(total("sizes", "x"), "n_rings")}
    for k in range(3, 9):
        stages[f"ring_{k}"], name = count("sizes", f"least(x, 8) = {k}"), f"{k}Plus" if k == 8 else str(k)
        out |= {f"NumRingSize{name}": f"ring_{k}", f"FractionRingSize{name}": ratio(f"ring_{k}", "n_rings")}
    out |= {"NumTerminalNodes": "ends", "FractionTerminalNodes": ratio("ends", "heavy"), "NumBranchingNodes": "forks", "FractionBranchingNodes": ratio("forks", "heavy")}
    out["BertzCT"] = "(n * h_kinds + nb * h_orders) * ln(n + 1)"
    return Descriptors("GraphTopology", out, stages)


def _radius() -> Descriptors:
    all_ = total("a", "x.r_cov")
    part = lambda test: ratio(total("a", f"IF({test}, x.r_cov, 0D)"), "all_radii")
    out = {"SumHeteroCovalentRadii": total("a", "IF(x.hetero, x.r_cov, 0D)")}
    # The bonding, van der Waals and covalent radii are multiples of one another, so their shares agree.
    for name, test in (("Hetero", "x.hetero"), ("Aromatic", "x.aromatic"), ("Ring", "x.ring")):
        out |= {f"Fraction{name}VdwRadii": part(test), f"Fraction{name}CovalentRadii": part(test)}
    out["BondingToAtomicRadiusRatio"] = ratio("0.85D * all_radii", total("a", "x.mass / 10"))
    return Descriptors("AtomicRadius", out, {"all_radii": all_})


#: Autocorrelated property of an atom x by its letter.
AUTOCORRELATED = {"d": "x.degree", "e": "x.en", "m": "x.mass * 6.022e26D", "p": "x.pol", "i": "x.ion * 1e18D", "r": "x.r_cov * 1e10D", "s": "x.valence", "v": "4D / 3 * pi() * pow(x.r_vdw * 1e10D, 3)", "z": "x.z"}
LAGS = 8


def _autocorrelation() -> Descriptors:
    """Mean product of centred properties over the pairs at each distance."""
    raw = {f"raw_{k}": f"transform(a, x -> CAST({e} AS DOUBLE))" for k, e in AUTOCORRELATED.items()}
    mean = {f"mean_{k}": f"{total(f'raw_{k}', 'x')} / n" for k in AUTOCORRELATED}
    centred = {f"mid_{k}": f"transform(raw_{k}, v -> v - mean_{k})" for k in AUTOCORRELATED}
    at = {f"at_{lag}": f"coalesce(get(m.pairs, {lag - 1}), array())" for lag in range(1, LAGS + 1)}
    out = {f"ATSd{k}{lag}": ratio(total(f"at_{lag}", f"mid_{k}[x.i] * mid_{k}[x.j]"), f"size(at_{lag})") for k in AUTOCORRELATED for lag in range(1, LAGS + 1)}
    return Descriptors("Autocorrelation", out, raw | mean | centred | at, LAGS)


#: Test of an atom x of the weighed ones, by name.
WEIGHED = {
    "HeavyAtom": "x.z > 1", "Carbon": "x.z = 6", "Hydrogen": "x.z = 1", "Nitrogen": "x.z = 7", "Oxygen": "x.z = 8", "Sulfur": "x.z = 16", "Phosphorus": "x.z = 15", "Boron": "x.z = 5", "Silicon": "x.z = 14", "Halogen": "x.halogen",
    "Fluorine": "x.z = 9", "Chlorine": "x.z = 17", "Bromine": "x.z = 35", "Iodine": "x.z = 53", "Metal": f"x.z > 0 AND x.z NOT IN ({_in(E.NON_METALS)})", "Aromatic": "x.aromatic", "Aliphatic": "NOT x.aromatic", "Ring": "x.ring", "NonRing": "NOT x.ring", "Heteroatom": "x.hetero",
    **{name: f"x.z IN ({_in({z for z in range(1, 51) if test(z)})})" for name, test in (("MainGroup", E.is_main_group), ("TransitionMetal", E.is_transition_metal), ("AlkaliMetal", E.is_alkali_metal), ("AlkalineEarth", E.is_alkaline_earth), ("NobleGas", E.is_noble_gas))},
    "Sp3": "x.hybrid = 3", "Sp2": "x.hybrid = 2", "Sp": "x.hybrid = 1", "PositiveCharge": "x.charge > 0", "NegativeCharge": "x.charge < 0", "Polar": "x.en > 2.5", "NonPolar": "x.en <= 2.5", "BasicNitrogen": "x.basic", "AcidicOxygen": "x.acid",
}


def _weight() -> Descriptors:
    f, c = {k: f"f_{k}" for k in WEIGHED}, {k: f"c_{k}" for k in ("MainGroup", "TransitionMetal", "Polar", "NonPolar", "PositiveCharge", "NegativeCharge", "Sp", "Sp2", "Sp3")}
    stages = {f"f_{k}": ratio(total("w", f"IF({test}, x.w, 0D)"), "weight") for k, test in WEIGHED.items()} | {f"c_{k}": f"{count('w', WEIGHED[k])} / n" for k in c}
    over = lambda a, b: f"(({a}) / (({b}) + 1e-6D))"
    spread = lambda *ks: (lambda mean: "sqrt((" + " + ".join(f"pow({f[k]} - {mean}, 2)" for k in ks) + f") / {len(ks)})")("((" + " + ".join(f[k] for k in ks) + f") / {len(ks)})")
    out = {f"{k}WeightFraction": f[k] for k in WEIGHED}
    out |= {
        "WeightFractionDiversity": spread("Carbon", "Hydrogen", "Nitrogen", "Oxygen", "Sulfur", "Phosphorus"), "HeavyToLightWeightRatio": over(f["HeavyAtom"], f"1 - {f['HeavyAtom']}"), "AromaticToAliphaticWeightRatio": over(f["Aromatic"], f["Aliphatic"]),
        "MetalToNonMetalWeightRatio": over(f["Metal"], f"1 - {f['Metal']}"), "PolarToNonPolarWeightRatio": over(f["Polar"], f["NonPolar"]), "SpHybridizationWeightRatio": over(f["Sp"], f"{f['Sp2']} + {f['Sp3']}"), "BasicToAcidicWeightRatio": over(f["BasicNitrogen"], f["AcidicOxygen"]),
        "HalogenWeightDiversity": spread("Fluorine", "Chlorine", "Bromine", "Iodine"), "NonMetalToMetalWeightRatio": over(f"1 - {f['Metal']}", f["Metal"]), "SpHybridizationDominance": over(f"{f['Sp3']} + {f['Sp2']}", f["Sp"]), "RingAtomWeightRatio": over(f["Ring"], f["NonRing"]),
        "HeteroToCarbonWeightRatio": over(f["Heteroatom"], f["Carbon"]), "MainGroupDominanceCount": over(c["MainGroup"], c["TransitionMetal"]), "PolarAtomCountRatio": over(c["Polar"], c["NonPolar"]), "ChargedAtomImbalance": f"{c['PositiveCharge']} - {c['NegativeCharge']}",
        "SpHybridizationCountBalance": over(c["Sp"], f"{c['Sp2']} + {c['Sp3']}"), "ChargeImbalanceWeightRatio": over(f"{f['PositiveCharge']} - {f['NegativeCharge']}", f"{f['PositiveCharge']} + {f['NegativeCharge']}"),
    }
    return Descriptors("WeightFraction", out, stages)


def _library() -> Descriptors:
    """Molecule-level values of the utility library."""
    sphere = lambda e: total("a", e.replace("R", "(x.r_vdw * 1e10D)"))
    out = {
        "mol_fragment_count": "m.parts", "mol_ring_count": "n_rings", "mol_aromatic_ring_count": count("r", "x.lettered"), "mol_heavy_atom_count": "heavy", "mol_bond_count": "nb", "mol_rotatable_bond_count": "rotatable",
        "mol_ring_rotatable_bond_count": count("b", "x.ord = 1 AND x.rings > 0"), "mol_has_stereo": "CAST(exists(m.atoms, x -> x.chiral) OR exists(m.bonds, x -> x.stereo) AS INT)",
        "mol_average_mass": total("a", "x.mass * 6.022e23D") + " / n", "mol_average_electronegativity": ratio(total("positive", "x"), "size(positive)"), "mol_max_electronegativity_difference": "coalesce(array_max(polarity), 0D)",
        "mol_sum_electronegativity": total("a", "x.en"), "mol_sum_polarizability": total("a", "x.pol"), "mol_sum_covalent_radii": total("a", "x.r_cov"),
        "mol_eccentricity": "diameter", "mol_diameter": "diameter", "mol_radius": "radius", "mol_wiener": "wiener", "mol_randic": "randic",
        "mol_balaban_j": f"IF(parts_cyclic > 0, {total('b', '1 / sqrt(CAST(m.sums[x.a] AS DOUBLE) * m.sums[x.b])')} * nb / nullif(parts_cyclic, 0D), 0D)",
        "mol_fsp3": ratio(count("a", "x.z = 6 AND x.degree > 2 AND NOT x.aromatic AND x.hybrid NOT IN (1, 2)"), "carbons"),
        "mol_bertz": "(n + nb) * ln(n + nb) * (1 + greatest(parts_cyclic, 0D)) * size(array_distinct(transform(m.atoms, x -> x.z))) * size(array_distinct(orders))",
        "mol_vdw_volume": sphere("4D / 3 * pi() * R * R * R"), "mol_surface_area": sphere("2D * pi() * R * R"), "mol_polar_surface_area": total("a", _either(POLAR_AREA, "x.hydrogens > 0")),
    }
    return Descriptors("Library", out)


def vector_mean(v: str) -> str:
    return ratio(total(v, "x"), f"size({v})")


def vector_variance(v: str, mean: str) -> str:
    """Population variance, 0 for up to one value; the mean is given, so that it is worked out once."""
    return f"IF(size({v}) > 1, aggregate({v}, 0D, (s, x) -> s + pow(x - {mean}, 2)) / nullif(size({v}), 0), 0D)"


def harmonic_mean(v: str) -> str:
    """Over the values that aren't 0; 0 for none."""
    some = f"filter({v}, y -> y <> 0)"
    return ratio(f"size({some})", total(some, "1 / x"))


def geometric_mean(v: str) -> str:
    """Over the positive values; 0 for none."""
    some = f"filter({v}, y -> y > 0)"
    return f"IF(size({some}) > 0, exp({total(some, 'ln(x)')} / nullif(size({some}), 0)), 0D)"


def bins(v: str, width: float) -> str:
    return f"transform({v}, y -> floor(y / {float(width)!r}D))"


def autocorrelation(v: str, distance: int) -> str:
    """Sum of products of a vector over the pairs at a distance, without centring; at 0 each atom with itself."""
    return total(v, "x * x") if not distance else total(f"coalesce(get(m.pairs, {distance - 1}), array())", f"{v}[x.i] * {v}[x.j]")


#: Distances of the autocorrelations that are given as columns.
DISTANCES = 4


def _vectors() -> Descriptors:
    """The utility library's vectors, as statistics."""
    out: dict[str, str] = {}
    stages: dict[str, str] = {}
    for name, v, width in (("electronegativity", "en", 0.5), ("polarizability", "pol", 1.0)):
        stages |= {f"mean_of_{v}": vector_mean(v), f"variance_of_{v}": vector_variance(v, f"mean_of_{v}"), f"bins_{v}": bins(v, width)}
        values = {"mean": f"mean_of_{v}", "variance": f"variance_of_{v}", "std": f"sqrt(variance_of_{v})", "min": f"array_min({v})", "max": f"array_max({v})", "range": f"array_max({v}) - array_min({v})", "harmonic_mean": harmonic_mean(v), "geometric_mean": geometric_mean(v)}
        values |= {"entropy": entropy(f"bins_{v}"), "bins": f"size(array_distinct(bins_{v}))"} | {f"autocorrelation_{d}": autocorrelation(v, d) for d in range(DISTANCES + 1)}
        out |= {f"mol_{name}_{k}": e for k, e in values.items()}
    far = "CASE WHEN n = 1 THEN 0 WHEN m.atoms[0].part <> m.atoms[size(m.atoms) - 1].part THEN -1 ELSE array_position(transform(m.pairs, d -> exists(d, x -> x.i = 0 AND x.j = size(m.atoms) - 1)), true) END"
    out |= {"mol_sum_product": "aggregate(zip_with(en, pol, (x, y) -> x * y), 0D, (s, x) -> s + x)", "mol_pairs_at_2": "coalesce(get(m.counts, 1), 0)", "mol_atoms_at_2_of_first": count("coalesce(get(m.pairs, 1), array())", "x.i = 0"), "mol_distance_first_last": far}
    out |= {"mol_carbons": "carbons", "mol_carbon_fraction": "carbons / n", "mol_double_bonds": "double", "mol_double_bond_fraction": ratio("double", "nb")}
    bond = "CASE " + " ".join(f"WHEN x.ord = {o} THEN {v!r}D" for o, v in REFRACTIVITY_OF_BOND.items()) + " ELSE 0D END"
    out |= {"mol_log_p": total("a", _either(LOG_P, "x.aromatic")), "mol_refractivity": f"{total('a', _either(REFRACTIVITY, 'x.aromatic'))} + {total('b', bond)}"}
    return Descriptors("Library", out, stages, None)


def _topology() -> Descriptors:
    """Ten graph scores; unreachable pairs don't count, and rings are the perceived ones."""
    carbonyl = "x.ord = 2 AND ((x.p_z = 6 AND x.q_z = 8) OR (x.p_z = 8 AND x.q_z = 6))"
    beside = lambda atom, z: f"(y.a = {atom} AND y.q_z {z}) OR (y.b = {atom} AND y.p_z {z})"
    amide = count("a", f"x.z = 6 AND exists(b, y -> y.ord = 2 AND ({beside('x.i', '= 8')})) AND exists(b, y -> {beside('x.i', '= 7')})")
    ether = count("a", f"x.z = 8 AND x.degree = 2 AND NOT exists(b, y -> {beside('x.i', '<> 6')})")
    hidden = count("polars", f"x.degree > 0 AND size(filter(b, y -> {beside('x.i', '= 6')})) > 0.5 * x.degree")
    near = "slice(m.counts, 1, 10)"
    return Descriptors("TopologyScore", {
        "TopologyEtap": "aggregate(transform(m.pairs, (p, d) -> aggregate(p, 0D, (s, x) -> s + tw[x.i] * tw[x.j]) / (d + 1)), 0D, (s, x) -> s + x) / n",
        "MolecularMesh": f"0.4D * {ratio('nb', 'n * (n - 1) / 2')} + 0.6D * aggregate(zip_with(tw, degrees, (x, d) -> x * d), 0D, (s, x) -> s + x) / n",
        "McsIndex": f"0.5D * aggregate(transform(array_distinct(transform(m.atoms, x -> x.z)), v -> pow(size(filter(m.atoms, y -> y.z = v)) / n, 2)), 0D, (s, x) -> s + x) + 0.5D * ({total('degrees', 'x')} / (2 * n)) / 3",
        "VertexEdgePath": ratio(f"aggregate(transform({near}, (c, d) -> c * (d + 1)), 0D, (s, x) -> s + x)", total(near, "x")),
        "McFarlandComplexity": total("a", "1.5D * CAST(x.aromatic AS INT) + 2 * CAST(x.hetero AS INT) + CAST(x.ring AS INT) + 2.5D * CAST(x.degree > 2 AS INT)") + " / n",
        "CycleConnectivity": ratio(count("b", "x.rings > 1"), "n_rings"),
        "FragmentComplexity": f"({total('r', 'CASE WHEN x.lettered AND x.mixed THEN 2.5D WHEN x.lettered THEN 2D ELSE 1.5D END')} + 2 * {amide} + {ether} + 1.5D * {count('b', carbonyl)}) / n",
        "TopologicalPolarBsa": ratio(hidden, "size(polars)"),
        "EccentricDistance": "aggregate(zip_with(m.far, m.sums, (e, d) -> CAST(e AS DOUBLE) * d), 0D, (s, x) -> s + x) / (n * n)",
        "MolecularScaffolding": f"0.6D * size(central) / n + 0.4D * {ratio(total('central', 'degrees[x]'), 'size(central)')} / 4",
    }, listed=None)


FAMILIES: dict[str, Descriptors] = {"bonds": _bonds(), "graph": _graph(), "radius": _radius(), "autocorrelation": _autocorrelation(), "weight": _weight(), "library": _library(), "vectors": _vectors(), "topology": _topology()}
NAMES: dict[str, tuple[str, ...]] = {f: tuple(d.values) for f, d in FAMILIES.items()}
_PATHS = ("m.far", "m.sums", "m.counts", "m.pairs")


def _reads(expression: str, names: Mapping[str, str]) -> set[str]:
    return {w for w in re.findall(r"(?<![.\w'])[a-z_]\w*(?!\s*\()", expression, re.I) if w in names}


def _needed(expressions: Sequence[str], stages: Mapping[str, str]) -> list[list[str]]:
    """The stages that expressions read, those of one level after those that they read themselves."""
    level: dict[str, int] = {}

    def depth(name: str) -> int:
        if name not in level:
            level[name] = 1 + max((depth(x) for x in _reads(stages[name], stages) - {name}), default=-1)
        return level[name]

    for e in expressions:
        for name in _reads(e, stages):
            depth(name)
    return [[n for n in stages if level.get(n) == k] for k in range(max(level.values(), default=-1) + 1)]


def add_molecules(df: DataFrame, smiles: Column, names: Sequence[str] | None = None) -> DataFrame:
    """``df`` with parse_ok and the descriptors; a text that is no molecule, or null, has nulls.

    Texts are parsed once, and only the paths, pairs and stages that the names need are worked out.
    """
    wanted = [n for f in NAMES.values() for n in f] if names is None else list(names)
    inner = extend_molecules(df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), smiles.alias("__smiles")), F.col("__smiles"), wanted, "__mol")
    return inner.select("__row.*", "__mol.*")


def extend_molecules(inner: DataFrame, smiles: Column, wanted: Sequence[str], out: str) -> DataFrame:
    """``inner``, which has no columns of the stages' names, with a struct column ``out`` of parse_ok and the descriptors."""
    families = [d for d in FAMILIES.values() if set(d.values) & set(wanted)]
    values = {n: e for d in families for n, e in d.values.items()}
    stages = STAGES | {n: e for d in families for n, e in d.stages.items()}
    levels = _needed([values[n] for n in wanted], stages)
    text = " ".join([*(values[n] for n in wanted), *(stages[n] for level in levels for n in level)])
    lists = [d.listed for d in families if set(d.values) & set(wanted) and "m.pairs" in text]
    listed = None if None in lists else max(lists, default=0)
    columns = inner.columns
    inner = inner.select("*", parsed(smiles, listed, any(p in text for p in _PATHS)).alias("m"))
    for level in levels:
        inner = inner.select("*", *[F.expr(stages[n]).alias(n) for n in level])
    ok = F.col("m").isNotNull()
    return inner.select(*columns, F.struct(ok.alias("parse_ok"), *[F.when(ok, F.expr(values[n]).cast("double")).alias(n) for n in wanted]).alias(out))

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.functions import elements
from molquarry.functions.molecules import FAMILIES, NAMES, add_molecules, element_counts, parsed, parsed_batch, ring_sizes
from molquarry.functions.paths import LARGE, Paths
from molquarry.functions.smiles import Molecule, SmilesError
from molquarry.molecule_queries import BASES


@pytest.fixture(scope="module")
def described(spark):
    """Values by text of some molecules."""
    texts = [*BASES, "CI", "CC", "C1CC1.C1CC1", None]
    rows = spark.createDataFrame([(s, "x", 1) for s in texts], "smiles string, m string, a int")
    return {r["smiles"]: r.asDict() for r in add_molecules(rows, F.col("smiles")).collect()}


@pytest.mark.parametrize(("smiles", "atoms", "bonds", "rings"), [("CCO", 3, 2, []), ("c1ccccc1", 6, 6, [6]), ("c1ccc2ccccc2c1", 10, 11, [6, 6]), ("C1CC2CCC1C2", 7, 8, [5, 5]), ("C1CCC2(CC1)CCCC2", 10, 11, [5, 6]), ("[Na+].[Cl-]", 2, 0, []), ("C%10CCCC%10", 5, 5, [5]), ("C12C3C4C1C5C2C3C45", 8, 12, [4] * 5), ("C1CCC1CC2CCC2", 9, 10, [4, 4]), ("C1CC1.C1CC1", 6, 6, [3, 3])])
def test_graph(smiles, atoms, bonds, rings):
    m = Molecule(smiles)
    assert (len(m.z), len(m.ends), sorted(len(r) for r in m.rings)) == (atoms, bonds, rings)
    for ring, around in zip(m.rings, m.ring_bonds, strict=True):
        assert {frozenset(m.ends[k]) for k in around} == {frozenset(p) for p in zip(ring, [*ring[1:], ring[0]], strict=True)}


@pytest.mark.parametrize("text", ["", "C1", "C(", "C)", "C=", "not a smiles", "C(C)(C)(C)(C)C", "[Qq]", "C11", ".=C", "cc", "c1cccc1", "n1cccc1", "c1c[nH]cn1C", "[NH4+]C", "[Cl-]C", "C:C"])
def test_no_molecule(text):
    with pytest.raises(SmilesError):
        Molecule(text)


#: The same molecule with aromatic letters and with double bonds, and its aromatic bonds.
SPELLINGS = [
    ("c1ccccc1", "C1=CC=CC=C1", 6), ("c1cscc1", "C1=CSC=C1", 5), ("c1cnccc1", "C1=CN=CC=C1", 6), ("c1ccc2cccc2cc1", "C1=CC=C2C=CC=C2C=C1", 10), ("c1ccn2cccc2c1", "C1=CC2=CC=CN2C=C1", 10), ("c1cc2ccc3cccc4ccc(c1)c2c34", "C1=CC2=C3C(=C1)C=CC4=CC=CC(=C43)C=C2", 19),
    ("C1=Cc2cccc3cccc1c23", "C1=CC2=CC=CC3=C2C1=CC=C3", 11), ("c1ncc2[nH]cnc2n1", "C1=NC=C2C(=N1)N=CN2", 10), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", 10), ("c1ccccc1c1ccccc1", "C1=CC=CC=C1C1=CC=CC=C1", 12), ("O=c1cccc[nH]1", "O=C1C=CC=CN1", 6),
    ("c1ccc[cH+]cc1", "C1=CC=C[CH+]C=C1", 7), ("c1cc[cH-]c1", "C1=CC=C[CH-]1", 5), ("c1cc[n+]([O-])cc1", "C1=CC=[N+]([O-])C=C1", 6), ("O=C1C=CC(=O)C=C1", "O=C1C=CC(=O)C=C1", 0), ("c1ccc2c(c1)Cc1ccccc12", "C1=CC=C2C(=C1)CC1=CC=CC=C12", 12),
]


@pytest.mark.parametrize(("letters", "doubles", "bonds"), SPELLINGS)
def test_both_spellings_of_aromatic_molecules_agree(letters, doubles, bonds):
    x, y = Molecule(letters), Molecule(doubles)
    kinds = lambda m: sorted(zip(m.z, m.aromatic, m.hydrogens, m.valence, m.charge, map(len, m.near), strict=True))
    assert kinds(x) == kinds(y) and sorted(x.order) == sorted(y.order) and x.order.count(1.5) == bonds


def test_spellings_have_equal_values(spark):
    pairs = [(k, s) for k, (a, b, _) in enumerate(SPELLINGS) for s in (a, b)]
    of_graph = [n for f in ("bonds", "graph", "radius", "weight") for n in NAMES[f]]
    rows = add_molecules(spark.createDataFrame(pairs, "k int, smiles string"), F.col("smiles"), of_graph).orderBy("k").collect()
    for a, b in itertools.batched(rows, 2):
        assert a["k"] == b["k"] and a["parse_ok"] and b["parse_ok"]
        assert [n for n in of_graph if not math.isclose(a[n], b[n], abs_tol=1e-9)] == []


def test_hand_computed(described):
    ethanol, benzene = described["CCO"], described["c1ccccc1"]
    assert [ethanol[n] for n in ("WienerIndex", "HararyIndex", "GraphDiameter", "GraphRadius", "ZagrebIndexM1", "ZagrebIndexM2")] == [4, 2.5, 2, 1, 6, 4]
    assert ethanol["RandicIndex"] == pytest.approx(2 / math.sqrt(2)) and benzene["WienerIndex"] == 27
    assert ethanol["MaxBondPolarity"] == pytest.approx(0.89) and ethanol["MostCommonBondPolarity"] == 0.0 and ethanol["FractionCCBonds"] == 0.5
    assert benzene["AromaticBondFraction"] == 1.0 and ethanol["FractionHeteroCovalentRadii"] == pytest.approx(0.66 / (0.76 * 2 + 0.66))
    assert ethanol["ATSdz1"] == pytest.approx(((6 - 20 / 3) ** 2 + (6 - 20 / 3) * (8 - 20 / 3)) / 2)
    assert described["CI"]["IodineWeightFraction"] > 0.9 and described["[Na+].[Cl-]"]["mol_fragment_count"] == 2 and described["CC"]["VertexEdgePath"] == 1
    assert described["[Na+].[Cl-]"]["mol_distance_first_last"] == -1 and described["C1CC1.C1CC1"]["NumRings"] == 2


def test_every_value_is_there_or_none_is(described):
    names = [n for f in NAMES.values() for n in f]
    assert len(names) == len(set(names)) == sum(len(d.values) for d in FAMILIES.values())
    for s, r in described.items():
        values = [r[n] for n in names]
        assert (r["m"], r["a"]) == ("x", 1)
        if r["parse_ok"]:
            assert all(v is not None and math.isfinite(v) for v in values), s
            assert 0 <= r["FractionAtomsInRings"] <= 1 and r["MinAtomEccentricity"] <= r["MaxAtomEccentricity"]
        else:
            assert s in (None, "", "C1", "not a smiles") and all(v is None for v in values)


def graphs(rng):
    for n in (1, 2, 5, 30, 63, 64, 65, 130, 200):
        near = [[] for _ in range(n)]
        for b in range(1, n):
            if rng.random() < 0.95:
                a = rng.randrange(max(0, b - 4), b)
                near[a].append((b, 0))
                near[b].append((a, 0))
        yield near


def brute(near):
    n = len(near)
    far = np.full((n, n), -1)
    for root in range(n):
        far[root, root], queue = 0, [root]
        for a in queue:
            for b, _ in near[a]:
                if far[root, b] < 0:
                    far[root, b] = far[root, a] + 1
                    queue.append(b)
    return far


@pytest.mark.parametrize("large", [LARGE, 40, 0])
@pytest.mark.parametrize("listed", [0, 3, None])
def test_paths_of_a_batch(monkeypatch, large, listed):
    monkeypatch.setattr("molquarry.functions.paths.LARGE", large)
    batch = [*graphs(random.Random(1)), [], *graphs(random.Random(2))]
    p = Paths(batch, listed)
    at = pair = step = 0
    for k, near in enumerate(batch):
        far = brute(near)
        n = len(near)
        assert p.sums[p.begin[k] : p.begin[k + 1]].tolist() == np.maximum(far, 0).sum(axis=1).tolist() and p.farthest[p.begin[k] : p.begin[k + 1]].tolist() == [max(r) for r in far.tolist()]
        counts = [int((far == d).sum()) // 2 for d in range(1, far.max(initial=0) + 1)]
        assert p.counts[at : at + p.longest[k]].tolist() == counts
        at += p.longest[k]
        for d in range(1, p.listed_steps[k] + 1):
            size = p.listed_counts[step]
            assert set(zip(p.first[pair : pair + size], p.second[pair : pair + size], strict=True)) == {(i, j) for i in range(n) for j in range(i + 1, n) if far[i, j] == d}
            pair, step = pair + size, step + 1
        assert p.listed_steps[k] == (len(counts) if listed is None else min(listed, len(counts)))


def test_a_large_ring_is_quick(spark):
    ring = "C1" + "C" * 2998 + "C1"
    began = time.process_time()
    parsed_batch([ring], 8, True)
    assert time.process_time() - began < 3
    got = add_molecules(spark.createDataFrame([(ring,), ("CCO",)], "s string"), F.col("s"), ["WienerIndex", "GraphDiameter", "MinRingSize", "ATSdz1"]).collect()
    assert (got[0]["WienerIndex"], got[0]["GraphDiameter"], got[0]["MinRingSize"], got[1]["WienerIndex"]) == (3000**3 / 8, 1500, 3000, 4)


def test_values_show_in_the_plan(spark):
    rows = add_molecules(spark.createDataFrame([("CCO",)], "s string"), F.col("s"), ["CarbonWeightFraction", "ATSdm2", "FractionCCBonds"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(" in plan and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_maps(spark):
    rows = spark.createDataFrame([("CCO",), ("c1ccc2cccc2cc1",), ("C1",), (None,)], "s string").select("s", parsed(F.col("s"), 0, False).alias("m"))
    got = [(r["e"], r["r"]) for r in rows.select(element_counts(F.col("m")).alias("e"), ring_sizes(F.col("m")).alias("r")).collect()]
    assert got == [({6: 2, 8: 1}, {}), ({6: 10}, {5: 1, 7: 1}), (None, None), (None, None)]


def test_elements():
    assert elements.group(17) == 17 and elements.period(17) == 3 and elements.group(13) == 13 and elements.group(26) == 8 and elements.group(4) == 2 and elements.group(53) == 0
    assert elements.is_metal(11) and not elements.is_metal(14) and elements.is_transition_metal(26) and elements.is_noble_gas(18) and elements.is_alkali_metal(19) and elements.is_alkaline_earth(12) and elements.is_main_group(6)
    assert elements.MASS[50] == 1.97e-25 and elements.VDW_RADIUS.get(4) is None and len(elements.SPECIFIC_HEAT) == 50

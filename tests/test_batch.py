"""Counting in whole batches against counting text by text."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molquarry import catalog
from molquarry.functions import library, molecules
from molquarry.functions.batch import Texts, needed
from molquarry.functions.bits import documented, kernels, murmur3
from molquarry.functions.smiles import Molecule
from molquarry.functions.strings import SCANS, _closures
from molquarry.functions.tables import PATTERN_FRACTIONS, PATTERNS

PIECES = st.sampled_from(["C", "c", "N", "n", "O", "(=O)", "(", ")", "[", "]", "[O-]", "[N+]", "1", "2", "%10", "S", "P", "F", "Cl", "H", "#", "=", "\n", "é", "", "[nH]", "c1ccccc1", "C(=O)N", "\x00"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=8))
def test_counts_are_those_of_each_text(texts):
    clean = [t.replace("\x00", "�") for t in texts]
    batch = Texts(texts)
    for p in [*PATTERNS.values(), *PATTERN_FRACTIONS.values(), _closures(6), "(?=CC)", "^C|C$", r"\[.\]"]:
        wanted = [sum(1 for _ in re.finditer(p.replace("$", r"\Z"), t)) for t in clean]
        assert batch.pattern(p).tolist() == wanted, p
    for x in ("C", "CC", "c1ccccc1", "é", "%"):
        assert batch.literal(x).tolist() == [t.count(x) for t in clean]
    for what, of in (("sum", sum), ("squares", lambda a: sum(v * v for v in a)), ("spread", lambda a: max(a, default=0) - min(a, default=0))):
        assert batch.over_positions(what, "CN").tolist() == [of([i for i, c in enumerate(t, 1) if c in "CN"]) for t in clean]


def test_what_every_match_holds():
    assert needed(r"C\(=O\)N|NC\(=O\)") == ("C(=O)N", "NC(=O)") and needed("[NOSP]") is None and needed(r"1[^1-9]{4,6}1") == ("1",)
    for p in (*PATTERNS.values(), *PATTERN_FRACTIONS.values()):
        re.compile(p)
        assert needed(p) is None or all(needed(p))


def test_branches_of_long_texts():
    assert SCANS["SmilesTertiaryCarbonCount"]("C(C)(C)(C)") == 1 and SCANS["SmilesTertiaryCarbonCount"]("C(C)(C)C") == 0
    began = time.time()
    SCANS["SmilesTertiaryCarbonCount"]("C(" * 50_000 + ")" * 50_000)
    kernels(b"CCO(=N)" * 3000)
    assert time.time() - began < 20


def test_a_large_ring_and_what_is_no_molecule(spark):
    ring = "C1" + "C" * 1200 + "1"
    assert len(Molecule(ring).rings[0]) == 1201
    rows = spark.createDataFrame([("C1" + "C" * 4,), ("CCO",), (None,)], "smiles string")
    got = {r["smiles"]: r for r in molecules.add_molecules(rows, F.col("smiles"), ["NumAtoms"]).collect()}
    assert got["CCO"]["NumAtoms"] == 3 and got[None]["NumAtoms"] is None and not got[None]["parse_ok"]


def test_library_vectors_by_hand(spark):
    rows = spark.createDataFrame([("CCO",), ("C=Cc1ccccc1",), ("C1CC2CCC1C2",), ("C1CCC2(CC1)CCCC2",), ("c1ccc2ccccc2c1",)], "smiles string")
    names = ["mol_log_p", "mol_refractivity", "mol_electronegativity_mean", "mol_carbons", "mol_carbon_fraction", "mol_pairs_at_2", "mol_distance_first_last", "NumBridgeheadAtoms", "NumSpiroAtoms", "NumAromaticRings"]
    got = {r["smiles"]: r for r in molecules.add_molecules(rows, F.col("smiles"), names).collect()}
    v = got["CCO"]
    assert v["mol_log_p"] == pytest.approx(0.08 * 2 - 0.5) and v["mol_refractivity"] == pytest.approx(2.4 * 2 + 1.3)
    assert v["mol_electronegativity_mean"] == pytest.approx((2.55 * 2 + 3.44) / 3) and v["mol_carbons"] == 2 and v["mol_carbon_fraction"] == pytest.approx(2 / 3)
    assert v["mol_pairs_at_2"] == 1 and v["mol_distance_first_last"] == 2 and got["C=Cc1ccccc1"]["mol_refractivity"] == pytest.approx(2 * 2.4 + 6 * 3.1 + 1.7)
    assert (got["C1CC2CCC1C2"]["NumBridgeheadAtoms"], got["C1CCC2(CC1)CCCC2"]["NumSpiroAtoms"], got["c1ccc2ccccc2c1"]["NumAromaticRings"]) == (2, 1, 2)


def test_library_functions_with_parameters(spark):
    m, z = F.col("m"), lambda atom: atom["z"]
    rows = spark.createDataFrame([("CCO",), ("C.C",), ("C1",)], "s string").select("s", molecules.parsed(F.col("s"), None).alias("m"))
    told = rows.select("s", library.autocorrelation(m, z, 2).alias("a"), library.pairs_at_distance(m, 1).alias("p"), library.atoms_at_distance(m, 1, 1).alias("n"), library.atom_distance(m, 0, 2).alias("d"), library.atom_distance(m, 1, 0).alias("e"), library.atom_distance(m, 1, 1).alias("f"),
                       library.count_atoms(m, lambda x: x["z"] == 6).alias("c"), library.bond_fraction(m, lambda x: x["ord"] == 1).alias("b"), library.property_vector(m, library.ELECTRONEGATIVITY).alias("v"))
    got = {r["s"]: r for r in told.collect()}
    one = got["CCO"]
    assert one["a"] == [6 * 6 * 2 + 64, 36 + 48, 48] and [tuple(p) for p in one["p"]] == [(0, 1), (1, 2)] and (one["n"], one["d"], one["e"], one["f"], one["c"], one["b"]) == (2, 2, 1, 0, 2, 1.0)
    assert one["v"] == [2.55, 2.55, 3.44] and got["C.C"]["e"] == -1 and got["C.C"]["b"] == 0.0 and got["C.C"]["a"] == [72.0, 0.0, 0.0]
    assert all(x is None for k, x in got["C1"].asDict().items() if k != "s")


def test_vectors(spark):
    v, w = F.col("v"), F.col("w")
    rows = spark.createDataFrame([(1, [1.0, 2.0, 4.0], [2.0, 3.0]), (2, [], [1.0]), (3, [0.1, 0.2, 5.0, 6.0], [0.0] * 9), (4, None, None), (5, [1e9, 1e9 + 1], [-1.0])], "k int, v array<double>, w array<double>")
    of = {n: getattr(library, n)(v).alias(n) for n in ("vector_mean", "vector_variance", "vector_std", "vector_min", "vector_max", "vector_range", "harmonic_mean", "geometric_mean")}
    got = {r["k"]: r for r in rows.select("k", *of.values(), library.combined(v, w, lambda x, y: x * y).alias("both"), library.property_histogram(v, 1.0).alias("h"), library.property_entropy(v, 1.0).alias("e")).collect()}
    assert got[1]["geometric_mean"] == pytest.approx(2) and got[1]["harmonic_mean"] == pytest.approx(3 / 1.75) and got[1]["both"] == [2.0, 6.0] and got[1]["vector_variance"] == pytest.approx(14 / 9)
    assert all(got[2][n] == 0 for n in of) and got[2]["both"] == [] and got[2]["h"] == {}
    assert got[3]["e"] == pytest.approx(1.5) and got[3]["h"] == {0: 2, 5: 1, 6: 1} and all(got[4][n] is None for n in of) and got[5]["vector_variance"] == 0.25


def test_documented_values():
    d = documented(b"CCO")
    assert d["AsciiSum"] == 213 and d["FirstByteValue"] == 67 and d["MostFrequentByte"] == 67 and d["LeastFrequentByte"] == 79 and d["StringLength"] == 3
    assert murmur3(b"hello") == 0x248BFA47 and murmur3(b"") == 0 and not any(documented(b"").values())


def test_registered_descriptors(spark):
    catalog.register("TextLength", "Own", lambda df, text: F.length(text).cast("double"))
    try:
        df = spark.createDataFrame([("CCO",)], "smiles string")
        assert catalog.describe(df, F.col("smiles"), ["TextLength", "NumAtoms"]).first()["TextLength"] == 3
    finally:
        catalog._registered.clear()


def test_classes_and_runs_from_masks_are_those_of_the_patterns():
    rng = random.Random(5)
    rows = ["".join(rng.choice("CcNnOos123 \n[]()-é日abzABZ\x00") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [""]
    t = Texts(rows)
    plain = [s.replace("\x00", "�") for s in rows]
    for p in ("[a-z]", "[A-Za-z]+", "[0-9]", "([nc])", "[cnospfib]", "[a-z]*n[a-z]*[0-9]", "[a-z]*o[a-z]*[0-9]", "[-=]"):
        assert t.pattern(p).tolist() == [sum(1 for _ in re.finditer(p, s)) for s in plain], p
    row, at = t.positions("Nn")
    assert list(zip(row, at, strict=True)) == [(k, i) for k, s in enumerate(plain) for i, c in enumerate(s, 1) if c in "Nn"]
    whole = t.characters()
    monkey = Texts(rows)
    assert (whole == np.array([[s.count(chr(c)) if c else 0 for c in range(128)] for s in plain])).all() and monkey.characters().shape == (501, 128)


def test_characters_are_counted_slice_by_slice(monkeypatch):
    monkeypatch.setattr("molquarry.functions.batch.SLICE", 16)
    rows = ["ab" * k for k in range(30)] + ["é" * 40, ""]
    assert Texts(rows).characters()[:, ord("a")].tolist() == [s.count("a") for s in rows]

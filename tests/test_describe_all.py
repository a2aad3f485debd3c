import math

from pyspark.sql import functions as F

from molquarry import catalog


def test_all_descriptors_in_one_plan_are_those_of_each_kind(spark):
    """The plan of all descriptors stays small enough to be planned, and its values are those of plans of one kind."""
    rows = [(1, "CC(=O)Oc1ccccc1C(=O)O"), (2, "not a smiles"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "s long, smiles string")
    whole = catalog.describe(df, F.col("smiles"))
    names = sorted(catalog.entries())
    assert whole.columns == ["s", "smiles", "parse_ok", *names]
    found = {r["s"]: r.asDict() for r in whole.collect()}
    assert {k: r["smiles"] for k, r in found.items()} == dict(rows)
    same = lambda a, b: a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))))
    for need in ("text", "scan", "planes", "molecule", "bits"):
        its = [e.name for e in catalog.entries().values() if e.needs == need]
        for r in catalog.describe(df, F.col("smiles"), its).collect():
            assert all(same(r[n], found[r["s"]][n]) for n in its)

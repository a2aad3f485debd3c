import duckdb
from pyspark.sql import functions as F

from molquarry import catalog
from molquarry.molecule_queries import DIGITS, molecule_table
from molquarry.queries import ORACLES, QUERIES


def test_descriptors_of_every_kind_are_counted(spark, tmp_path):
    """Each descriptor of the catalog has the number of rows with a value other than 0, whatever it needs; texts that repeat count as often as they do.

    What sums leave over, as of a deviation of equal values, is 0 there as it is in SQL; a small value of a registered descriptor stays one.
    """
    keys = [*range(92), *range(0, 92, 5), 1, 1, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    catalog.register("OwnAtoms", "Own", lambda df, text: F.col("NumAtoms") - 1, ["NumAtoms"])
    catalog.register("OwnLong", "Own", lambda df, text: F.length(text) > 5)
    catalog.register("OwnKilograms", "Own", lambda df, text: F.col("NumAtoms") * 1e-26, ["NumAtoms"])
    catalog.register("OwnName", "Own", lambda df, text: F.when(F.length(text) > 5, F.lower(text)))
    try:
        rows = [r.asDict() for r in catalog.describe(molecule_table(spark, str(tmp_path)), F.col("smiles")).collect()]
        found = {r["name"]: r for r in QUERIES["descriptor_catalog"](spark, str(tmp_path)).collect()}
        known = catalog.entries()
        assert len(rows) == len(keys) and set(found) == set(known)
        assert {n: (r["category"], r["needs"]) for n, r in found.items()} == {n: (e.category, e.needs) for n, e in known.items()}
        seen = lambda n, v: round(v, DIGITS) if known[n].needs != "registered" else v
        wanted = {n: sum(r[n] is not None and seen(n, r[n]) != 0 for r in rows) for n in known}
        assert {n: r["n"] for n, r in found.items()} == wanted
        assert {e.needs for n, e in known.items() if wanted[n]} == {"text", "scan", "planes", "molecule", "bits", "registered"}
        assert 0 < wanted["OwnLong"] == wanted["OwnName"] < len(keys) and wanted["OwnKilograms"] == wanted["NumAtoms"] > 0
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        for q, n in (("electronegativity_molecules", "SmilesPaulingENStdDev"), ("molecule_autocorrelation", "ATSde1"), ("token_planes_molecules", "SpitInterClassInteractionRatio")):
            assert [(found[n]["n"],)] == con.execute(f"SELECT count(*) FROM ({ORACLES[q]}) WHERE {n} <> 0").fetchall()
        assert found["ATSde1"]["n"] < sum(bool(r["ATSde1"]) for r in rows)
    finally:
        for n in ("OwnAtoms", "OwnLong", "OwnKilograms", "OwnName"):
            catalog.unregister(n)

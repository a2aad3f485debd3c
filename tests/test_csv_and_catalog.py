import warnings

import pytest
from pyspark.sql import functions as F

from molquarry import catalog, cli
from molquarry.operators.profile import profile, profile_summary
from molquarry.sources.csv import read_csv, smiles_column
from molquarry.streaming.streams import describe_stream, windowed_profile

NAMES = ["SmilesCarbonCount", "NumAtoms", "SmilesPaulingENMean"]
CASES = {
    "simple": ("smiles,name\nCCO,ethanol\nCC(=O)O,acetic acid\nC1=CC=CC=C1,benzene\n", 3),
    "header only": ("smiles,name\n", 0),
    "special characters": ('smiles,name\nCCO,"a, ""b"""\nCCN,é\nCCC,"two\nlines"\n', 3),
    "missing values": ("smiles,name\nCCO,\n,unknown\nCCN,None\n", 3),
    "header case": ("SMILES,Name\nCCO,ethanol\nCCN,x\n", 2),
    "extra columns": ("smiles,name,extra1,extra2\nCCO,a,foo,1\nCCN,b,bar,2\n", 2),
    "duplicates": ("smiles,name\nCCO,a\nCCO,a\n", 2),
    "crlf": ("smiles,name\r\nCCO,ethanol\r\nCCN,x\r\n", 2),
    "bom": ("﻿smiles,name\nCCO,ethanol\n", 1),
    "trailing lines": ("smiles,name\nCCO,ethanol\nCCN,x\n\n\n", 2),
    "wide": ("smiles," + ",".join(f"col{k}" for k in range(100)) + "\nCCO," + ",".join(map(str, range(100))) + "\n", 1),
    "bad rows are kept": ("smiles,name\nC1,a\nxx,b\nCCO,c\n", 3),
}


def test_white_space_a_thousand_rows_and_split_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("smiles,name\n CCO ,  ethanol  \n" + "".join(f"CC{k},mol{k}\n" for k in range(1000)))
    assert cli.main(["-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out"), "-d", "NumAtoms", "-q", "--one-line-rows"]) == 0
    out = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert len(out) == 1001 and {"  ethanol  ", "mol999"} <= {r["name"] for r in out}


def test_tabs_and_an_empty_file(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("smiles\tname\nCCO\tethanol\n")
    assert cli.main(["-i", str(tmp_path / "in.tsv"), "-o", str(tmp_path / "out"), "-d", "NumAtoms", "-q", "--delimiter", "\t"]) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True, sep="\t").first()["NumAtoms"] == "3.0000"
    (tmp_path / "none.csv").write_text("")
    assert cli.main(["-i", str(tmp_path / "none.csv"), "-o", str(tmp_path / "none"), "-q"]) == 0


@pytest.mark.parametrize("case", sorted(CASES))
def test_round_trip(spark, tmp_path, case):
    text, rows = CASES[case]
    (tmp_path / "in.csv").write_bytes(text.encode())
    assert cli.main(["-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out"), "-d", ",".join(NAMES), "-q"]) == 0
    out = spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"')
    assert out.count() == rows
    if rows:
        assert out.columns[-3:] == NAMES
        first = {r[0]: r.asDict() for r in out.collect()}
        if "CCO" in first:
            assert first["CCO"]["NumAtoms"] == "3.0000" and first["CCO"]["SmilesCarbonCount"] == "2.0000"
        if case == "bad rows are kept":
            assert first["C1"]["NumAtoms"] == "NA_Error"


def test_columns_by_name_and_index(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Name,Smiles\na,CCO\n")
    df = read_csv(spark, str(tmp_path / "in.csv"))
    assert smiles_column(df) == "Smiles" and smiles_column(df, "1") == "Smiles"
    with pytest.raises(ValueError, match="no column"):
        smiles_column(df, "other")


def test_names(spark, capsys):
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert catalog.resolve(["NumAtomsDescriptor", "nothing", "v1Descriptor", "NumAtoms"]) == ["NumAtoms", "ATSdv1"]
    assert len(told) == 1
    assert len(catalog.entries()) > 560
    assert cli.main(["--list-descriptors"]) == 0 and "SmilesText" in capsys.readouterr().out


def test_rows_stay_where_they_are(spark):
    df = spark.createDataFrame([(k, "C" * (k % 9 + 1)) for k in range(100)], "k long, smiles string")
    plan = catalog.describe(df, F.col("smiles"), NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_profile_with_missing_values(spark):
    df = spark.createDataFrame([("1", "2", "x"), ("2", "4", "x"), ("3", None, "x"), ("4", "8", "x")], "a string, b string, c string")
    got = {r["column_name"]: r for r in profile(df, "a").collect()}
    assert (got["a"]["n"], got["b"]["n"], got["c"]["n"]) == (4, 3, 0)
    assert got["a"]["variance"] == pytest.approx(1.25) and got["a"]["correlation"] == pytest.approx(1) and got["b"]["pairwise_correlation"] == pytest.approx(1)
    assert got["c"]["variance"] is None and profile_summary(profile(df, "a")).first()["no_data"] == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([("CCO",), ("c1ccccc1",), ("C1",)], "smiles string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("smiles string").parquet(str(tmp_path / "in"))
    q = describe_stream(stream, F.col("smiles"), NAMES).writeStream.format("memory").queryName("described").start()
    q.processAllAvailable()
    q.stop()
    assert {r["smiles"]: r["NumAtoms"] for r in spark.table("described").collect()} == {"CCO": 3, "c1ccccc1": 6, "C1": None}


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:0{k}:00", "a", float(k)) for k in range(10)], "t string, kind string, v double").select(F.to_timestamp("t").alias("ts"), "kind", "v")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_profile(stream, "ts", "v", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["mean"], r["variance"]) for r in spark.table("windows").collect()) == [(5, 2.0, 2.0), (5, 7.0, 2.0)]

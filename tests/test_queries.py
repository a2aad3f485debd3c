import random
import re
from itertools import accumulate

import duckdb
import pytest

from molquarry.queries import ORACLES, QUERIES
from oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sql_of_ethers_looks_at_both_neighbours():
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("OOOOHC1]([\né-") for _ in range(rng.randint(0, 12)))) for k in range(1000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = dict(con.execute(f"SELECT doc_id, SmilesEtherCount FROM ({ORACLES['string_counts']})").fetchall())
    assert got == {k: len(re.findall(r"(?<=[A-Za-z\]])O(?=[A-GI-Za-z\[])", s)) for k, s in rows}
    assert sum(got.values()) > 100


def test_scans_of_all_documents(spark):
    step = lambda s: list(accumulate((c == "(") - (c == ")") for c in s))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["string_scans_documents"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, s in texts.items():
        forks = [k for k in range(len(s) - 1) if s[k : k + 2] == "C(" and ")" in s[k:]]
        wanted = sum(sum(c == "(" and d == 1 for c, d in zip(s[k + 1 :], step(s[k + 1 :]), strict=True)) >= 3 for k in forks)
        outside = [c for c, d in zip(s, step(s), strict=True) if d == 0 and c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        share = sum(c != "C" for c in outside) / len(outside) if outside else 0.0
        assert (got[i]["SmilesTertiaryCarbonCount"], got[i]["SmilesNonCarbonBackboneRatio"]) == (wanted, pytest.approx(share))

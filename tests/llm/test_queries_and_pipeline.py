import pytest

import corpus_pipeline
from molquarry.llm.queries import ORACLES, QUERIES
from oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[i] == r for i, r in after.items()), name
        before = after
    assert len({" ".join(r["text"].split()) for r in before.values()}) == len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(before)


def test_pipeline_stages_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = " ".join(f"w{chr(97 + k % 26)}ord{k}" for k in range(60))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (None, good + " end", None, None, None), (2, None, "en", "a", 0), (3, "", None, "a", 0), (4, good.replace(" ", "\n"), "en", "b", 2)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.count() <= 1
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_decisions_take_effect_among_rows_with_null_or_shared_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = lambda k, end: " ".join([*(f"w{k}x{j}" for j in range(99)), end])
    near = [(i, text(k, end), "en", "a", 1) for k in range(6) for i, end in ((None if k % 2 else 7, "one"), (None if k % 2 else 7, "two"))]
    left = corpus_pipeline.near(spark, spark.createDataFrame(near, schema), SF).collect()
    assert sorted(r["text"].split()[0] for r in left) == sorted(f"w{k}x0" for k in range(6))
    rows = [(None if k % 2 else 7, text(k, "end"), "en", "a", 1) for k in range(40)]
    taken = corpus_pipeline.mix(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert len(taken) == len({r["text"] for r in taken}) == 40 * corpus_pipeline.FRACTION

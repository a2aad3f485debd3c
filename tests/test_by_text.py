from pyspark.sql import functions as F

from molquarry.functions import molecules, tokens
from molquarry.molecule_queries import by_text


def test_texts_are_worked_out_once(spark, tmp_path):
    """Of many equal texts one is parsed, with a filter on what is parsed too; every row keeps its values."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 2 == 0, "CCO").otherwise("C1").alias("smiles"))

    def described(texts):
        @F.udf("string")
        def counted(s):
            seen.add(1)
            return s

        return molecules.add_molecules(texts.withColumn("smiles", counted.asNondeterministic()("smiles")), F.col("smiles"), ["NumAtoms"]).where("parse_ok")

    found = by_text(rows, "smiles", described)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns[:2] == ["id", "smiles"]
    assert {r["id"]: r["NumAtoms"] for r in found.collect()} == {k: 3.0 for k in range(0, 1000, 2) if k % 10}
    assert seen.value == 3 and plan.count("run(") == 1


def test_null_texts_stay_null(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "CC")], "id int, t string")
    found = by_text(rows, "t", lambda x: x.withColumn("n", F.length("t")))
    assert sorted(map(tuple, found.collect())) == [(1, None, 0), (2, "", 0), (3, "CC", 2)]


def test_rows_of_planes_are_summed_once(spark, monkeypatch):
    """All statistics of a text read the same sums of rows, and values of several texts stay apart."""
    made = []
    stack = tokens.np.stack
    monkeypatch.setattr(tokens.np, "stack", lambda parts: made.append(1) or stack(parts))
    for text in ("CC(=O)Nc1ccc(O)cc1", "CCO"):
        t = tokens.Classes(*tokens.tokenize(text))
        before = [tokens._connected(t), tokens._skewness(t), tokens._near(t), tokens._stable(t)]
        assert before == [f(tokens.Classes(*tokens.tokenize(text))) for f in (tokens._connected, tokens._skewness, tokens._near, tokens._stable)]
    assert len(made) == 10

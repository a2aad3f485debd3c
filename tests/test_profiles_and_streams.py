import random

import duckdb
import pytest
from pyspark.sql import functions as F

from molquarry import catalog
from molquarry.operators.profile import merged_sketches, profile_by, sketch
from molquarry.queries import QUERIES
from molquarry.streaming.streams import late_profile, late_table, session_profile
from oracle import SF


def test_sketches_hold_their_bounds(spark):
    got = {r["column_name"]: r for r in QUERIES["sketches_lineitem"](spark, SF).collect()}
    con = duckdb.connect()
    n = con.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet'").fetchall()[0][0]
    for c, r in got.items():
        exact = con.sql(f"SELECT count({c}), count(DISTINCT {c}) FROM '{SF}/lineitem.parquet'").fetchall()[0]
        assert r["n"] == exact[0] and abs(r["distinct"] - exact[1]) <= 0.03 * exact[1] + 1
        for q in (25, 50, 75) if c != "l_returnflag" else ():
            below, upto = con.sql(f"SELECT count(*) FILTER (WHERE {c} < {r[f'q{q}']}), count(*) FILTER (WHERE {c} <= {r[f'q{q}']}) FROM '{SF}/lineitem.parquet'").fetchall()[0]
            assert below / n - 0.01 <= q / 100 <= upto / n + 0.01
    assert got["l_returnflag"]["q50"] is None


def test_sketches_of_odd_columns(spark):
    rows = spark.createDataFrame([("a", None, None, 1), ("a", 2.0, "x", 1), ("b", None, None, 1), (None, 5.0, "y", 1)], "g string, v double, s string, n int")
    stored = sketch(rows, ["v", "s"], ["g"])
    got = {(r["g"], r["column_name"]): (r["n"], r["distinct"], r["q50"]) for r in merged_sketches(stored, ["g"]).collect()}
    assert got == {("a", "v"): (1, 1, 2.0), ("a", "s"): (1, 1, None), ("b", "v"): (0, 0, None), ("b", "s"): (0, 0, None), (None, "v"): (1, 1, 5.0), (None, "s"): (1, 1, None)}
    assert merged_sketches(sketch(rows.limit(0), ["v"], ["g"])).count() == 0


def test_subtotals_of_odd_groups(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, 1e9 + rng.random()]), rng.random(), "x") for _ in range(200)] + [("c", 1, None, 1.0, "x")]
    rows = spark.createDataFrame(data, "g string, n int, v double, w double, c string")
    got = {(r["g"], r["n"], r["grouping_id"]): r for r in profile_by(rows.withColumnRenamed("n", "k"), ["g", "k"], ["v"], "w").withColumnsRenamed({"n": "count", "k": "n"}).collect()}
    frame = rows.toPandas()  # noqa: F841
    wanted = duckdb.sql("SELECT g, n, grouping(g, n) AS i, count(v), var_pop(v), corr(v, w) FROM frame GROUP BY CUBE (g, n)").fetchall()
    assert len(got) == len(wanted)
    for g, n, i, count, variance, correlation in wanted:
        r = got[g, n, i]
        assert r["count"] == count
        assert r["variance"] == (None if count < 2 else pytest.approx(variance, rel=1e-3, abs=1e-6))
        assert r["correlation"] is None or r["correlation"] == pytest.approx(correlation, abs=1e-3)
    assert profile_by(rows, ["g"], ["v"], how="rollup").count() == 5 and profile_by(rows, ["g"], ["v"], how="groups").count() == 4
    with pytest.raises(ValueError, match="subtotals"):
        profile_by(rows, ["g"], ["v"], how="none")


EVENTS = [(k, f"2024-01-01 00:{m:02d}:00", u, float(k)) for k, (m, u) in enumerate([(0, "a"), (5, "a"), (1, "b"), (4, "a"), (40, "a"), (3, "a"), (41, "b"), (39, "a"), (40, None)])]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, "id long, t string, u string, v double").select("id", F.to_timestamp("t").alias("ts"), "u", "v")


def test_late_rows_are_counted_apart_in_a_stream(spark, tmp_path, events):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(3):  # three micro batches in the order of the ids
        events.where(f"id div 3 = {k}").orderBy("id").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    (tmp_path / "all").mkdir()
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    q = late_profile(stream, "u", "ts", "v", 120.0).writeStream.outputMode("update").format("memory").queryName("late").start()
    for k in range(3):
        spark.read.parquet(str(tmp_path / f"in{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
        q.processAllAvailable()
    q.stop()
    last = {r["key"]: r for r in spark.table("late").collect()}  # later batches come later
    table = {r["key"]: r for r in late_table(events, "u", "ts", "v", "id", 120.0).collect()}
    assert set(last) == set(table) == {"a", "b"}
    assert (table["a"]["n"], table["a"]["late"], table["a"]["late_sum"]) == (5, 1, 5.0)
    for u, r in table.items():
        assert all(last[u][c] == pytest.approx(r[c]) for c in ("n", "mean", "variance", "late", "late_sum"))


def test_sessions_of_a_stream(spark, tmp_path, events):
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = session_profile(stream, "ts", "v", ["u"], "10 minutes").writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["u"], str(r["session_start"])[14:16], r["rows"]) for r in spark.table("sessions").collect()}
    assert got == {("a", "00", 4), ("a", "39", 2), ("b", "01", 1), ("b", "41", 1), (None, "40", 1)}
    assert got == {(r["u"], str(r["session_start"])[14:16], r["rows"]) for r in session_profile(events, "ts", "v", ["u"], "10 minutes").collect()}


@pytest.fixture
def registry():
    yield catalog
    catalog._registered.clear()


def test_descriptors_that_need_others(spark, registry):
    registry.register("twice", "Own", lambda df, text: F.col("NumAtoms") * 2, ["NumAtoms"])
    registry.register("left", "Own", lambda df, text: F.col("twice") + 1, ["twice"])
    registry.register("right", "Own", lambda df, text: F.col("twice") + F.length(text), ["twice"])
    registry.register("top", "Own", lambda df, text: F.col("left") * F.col("right"), ["left", "right"])
    rows = spark.createDataFrame([("CCO",), ("C",), ("C1",)], "s string")
    out = registry.describe(rows, F.col("s"), ["top", "NumBonds"])
    assert out.columns == ["s", "parse_ok", "top", "NumBonds"]
    assert [(r["top"], r["NumBonds"]) for r in out.collect()] == [(63.0, 2.0), (9.0, 0.0), (None, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "Exchange" not in plan
    assert registry.closed(["top"]) == (["NumAtoms"], [["twice"], ["left", "right"], ["top"]])


def test_cycles_and_unknown_names_are_refused(registry):
    make = lambda df, text: F.lit(1)
    registry.register("a", "Own", make)
    registry.register("b", "Own", make, ["a"])
    registry.register("c", "Own", make, ["b"])
    for name, needs in (("a", ["c"]), ("a", ["a"]), ("d", ["d"])):
        with pytest.raises(ValueError, match="need itself"):
            registry.register(name, "Own", make, needs)
    with pytest.raises(ValueError, match="unknown"):
        registry.register("d", "Own", make, ["nothing"])
    with pytest.raises(ValueError, match="not a name"):
        registry.register("d e", "Own", make)
    with pytest.raises(TypeError):
        registry.register("d", "Own", 1)
    with pytest.raises(ValueError, match="needed by"):
        registry.unregister("a")
    registry.unregister("c")
    assert "c" not in registry.entries() and registry.entries()["b"].category == "Own"

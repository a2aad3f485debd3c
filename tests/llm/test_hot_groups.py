"""Large lists, and many rows without an id: nothing depends on one task that holds them all."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from molquarry.llm.chat import chat_format
from molquarry.llm.exact_dedup import exact_dedup
from molquarry.llm.mixing import mixed
from molquarry.llm.substring_dedup import _digest, _glued, _removed
from molquarry.llm.urls import Cascade


def test_a_large_list_is_held_part_by_part(spark):
    n, limit = 60_000, 1 << 14
    universe = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    began = time.time()
    cascade = Cascade(universe, max_bits=limit)
    assert cascade.parts >= 10 and sum(cascade.bits) <= 1.2 * limit
    assert cascade.table.count() == cascade.parts
    rows = spark.range(n).select("id", F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("x").alias("part"), F.lit("y").alias("row"))
    told = cascade.marked(rows.union(rows.limit(50)), "key", "told")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "subquery" not in plan.lower()
    got = told.groupBy("told", (F.col("id") % 3 == 0).alias("listed")).count().collect()
    assert all(r["told"] == r["listed"] for r in got) and sum(r["count"] for r in got) == n + 50
    assert told.columns == ["id", "key", "part", "row", "told"] and time.time() - began < 120


def test_a_small_list_moves_no_row(spark):
    universe = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < 9).alias("listed"))
    cascade = Cascade(universe)
    told = cascade.marked(universe.select("key"), "key", "told")
    assert cascade.parts == 1 and told.where("told").count() == 9


def test_turns_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, 1, "user", "hi"), (None, 2, "user", "hi"), (None, 1, "user", "hi"), (None, None, "user", "hi"), (None, 3, "user", "yo"), (4, 1, "user", "hi"), (4, 2, "bot", "yo")]
    got = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    # The three different turns "hi" are copies of one conversation, which begins conversation 4.
    assert {(r["conv_id"], r["n_turns"], r["n_copies"], r["n_snapshots"]) for r in got} == {(4, 2, 1, 1), (None, 1, 1, 0)}
    assert sorted(r["rendered"] for r in got)[1].count("yo") == 1
    alone = [(None, k, "user", "hi") for k in (1, 2)] + [(None, 1, "user", "hi")]
    got = chat_format(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got] == [(None, 1, 2)]


def test_copies_without_an_id_are_spread(spark):
    rows = [(None, "same text")] * 3000 + [(7, "same text"), (None, "other"), (8, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = exact_dedup(frame).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in got) == {(7, 3001): 3001, (8, 2): 2}
    assert [r["doc_id"] for r in got if r["kept"]] in ([7, 8], [8, 7])


def test_documents_without_an_id_are_mixed_by_their_texts(spark):
    rows = [(None, "w " * (1 + k % 5) + str(k), "en", "src1") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    total = sum(len(t.split()) for _, t, _, _ in rows)
    taken = mixed(frame, fraction=0.5, epochs=1, with_hash=True).collect()
    used = sum(r["n_tokens"] for r in taken)
    assert total * 0.5 - 6 <= used <= total * 0.5 and len({r["text_hash"] for r in taken}) == len(taken)


def test_pieces_are_glued_along_both_coordinates():
    rng = random.Random(7)
    edges = sorted({(rng.randrange(3), rng.randrange(2), rng.randrange(40), rng.randrange(2), rng.randrange(2), rng.randrange(12)) for _ in range(400)})
    cut = rng.sample(edges, len(edges))
    pieces = np.concatenate([np.stack(_glued([np.array(c) for c in (lambda part: [[e[0] for e in part], [e[1] for e in part], [e[2] for e in part], [1] * len(part), [e[3] for e in part], [e[4] for e in part], [e[5] for e in part]])(cut[a : a + 37])]), axis=1) for a in range(0, len(cut), 37)])
    whole = np.stack(_glued([pieces[:, j] for j in range(7)]), axis=1).tolist()
    covered = [(i, row, start + k, source, source_row, at + k) for i, row, start, n, source, source_row, at in whole for k in range(n)]
    assert sorted(covered) == edges  # no edge is lost, made up or told twice
    ends = {(i, row, source, source_row, at - start, start + n) for i, row, start, n, source, source_row, at in whole}
    assert not any((i, row, source, source_row, at - start, start) in ends for i, row, start, n, source, source_row, at in whole)  # as long as can be
    assert [len(x) for x in _glued([np.zeros(0, np.int64)] * 7)] == [0] * 7


def test_a_span_whose_words_differ_from_its_source_stays():
    words = [b"w%d" % j for j in range(20)]
    text = b" ".join(words).decode()
    spans = [{"row": 5, "start": 2, "n": 3, "digest": _digest(words[2:7])}, {"row": 5, "start": 10, "n": 4, "digest": _digest(words[9:15])}, {"row": 6, "start": 0, "n": 9, "digest": _digest(words[0:11])}]
    kind = pa.list_(pa.struct({"row": pa.int32(), "start": pa.int32(), "n": pa.int32(), "digest": pa.binary()}))
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array([text, ""]), pa.array([spans, spans], kind), pa.array([5, 0], pa.int32())], ["id", "text", "spans", "row"])
    out = next(_removed(3, True)(iter([batch]))).to_pylist()
    assert out[0]["n_removed"] == 5 and out[0]["kept_text"] == b" ".join(words[:2] + words[7:]).decode() and out[0]["n_spans"] == 1
    assert (out[1]["n_words"], out[1]["n_removed"], out[1]["n_spans"]) == (0, 0, 0)

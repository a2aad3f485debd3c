"""Exact dedup by content sort.

Splitters sampled from the normalised text deal the rows out by range, each range is sorted externally,
and a scan of each sorted range compares every row with the one before it in full. A run of equal texts
may be spread over several ranges, since the identifier is part of the sort key: no group of copies, however
large, has to fit one task. The runs at the edges of ranges, two per range at most, are added up apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import SPACE, durable, joined_back

#: Bytes of a text that a splitter holds at most (times four for non-ASCII text).
SPLITTER_CHARS = 64
_RUNS = "id long, sha string, run_id long, run_rows long, first boolean, edge boolean, part int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, schema = TaskContext.get().partitionId(), pa.schema([("id", pa.int64()), ("sha", pa.string()), ("run_id", pa.int64()), ("run_rows", pa.int64()), ("first", pa.bool_()), ("edge", pa.bool_()), ("part", pa.int32())])
    text, ids, opening = None, [], True
    out: list[list] = [[] for _ in schema]

    def end(edge: bool) -> None:
        n, sha = len(ids), hashlib.sha256(text.encode()).hexdigest()
        least = min((i for i in ids if i is not None), default=None)
        for column, values in zip(out, (ids, [sha] * n, [least] * n, [n] * n, [True] + [False] * (n - 1), [edge] * n, [part] * n), strict=True):
            column += values

    def full() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t != text:
                if text is not None:
                    end(opening)
                    opening = False
                text, ids = t, []
            ids.append(i)
        if len(out[0]) >= 20_000:
            yield full()
    if text is not None:
        end(True)
        yield full()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null is empty.
    Of equal texts the row with the smallest id stays; of rows that repeat even the id, one stays. Rows
    without an id come last. Very long texts are compared whole; one has to fit a task. An empty table gives
    no rows; other columns, whatever their names, are not looked at.
    """
    norm = docs.select(docs[id_col].cast("long").alias("id"), F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACE, " ").alias("norm"))
    keys = [F.col("head"), F.col("h"), F.col("id").asc_nulls_last(), F.col("place")]
    # Copies without an id are dealt out by their place in the input.
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    ranges = norm.select("id", "norm", F.substring("norm", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("norm").alias("h"), place.alias("place")).repartitionByRange(*keys)
    ordered = ranges.sortWithinPartitions(*keys[:2], "norm", keys[2]).select("id", "norm")
    runs = durable(ordered.mapInArrow(_runs, _RUNS))
    # Two runs a range at most, so this table is bounded by the number of partitions.
    edges = runs.where("edge and first").groupBy("sha").agg(F.min("run_id").alias("all_id"), F.sum("run_rows").alias("all_rows"), F.min("part").alias("head_part"))
    whole = joined_back(runs, edges.withColumn("edge", F.lit(True)), ["sha", "edge"], "left")
    return whole.select(
        F.col("id").alias(id_col),
        F.coalesce("all_id", "run_id").alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        (F.col("first") & (F.col("part") == F.coalesce("head_part", "part"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

"""Chat formatting after cumulative-snapshot collapse.

A logged conversation that grew is often stored again after every turn. Each conversation gets the rolling
hashes of its turn prefixes; one whose full hash is a proper prefix hash of another is a snapshot of that one.
Anti-joins keep the maximal conversations, one of each set of equal ones, and these are rendered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import durable, record_batch

#: How a turn is rendered: before the role, between role and text, after the text.
TURN = ("<|im_start|>", "\n", "<|im_end|>\n")
_ROLLED = {"key": pa.int64(), "alone": pa.int64(), "hashes": pa.list_(pa.binary())}


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rolling hash after each turn."""
    for batch in batches:
        out = []
        for key, alone, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state, hashes = b"", []
            for t in turns:
                state = hashlib.sha256(state + f"{len(t['role'])}:{t['role']}:".encode() + t["text"].encode()).digest()
                hashes.append(state)
            out.append((key, alone, hashes))
        yield record_batch(out, _ROLLED)


def chat_format(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: id, n_turns, n_snapshots, n_copies, rendered, rendered_sha256.

    Turns are ordered by number, then role and text; equal rows count once. A conversation goes if its turns
    are the first turns of a longer one; of equal ones the smallest id stays and n_copies counts them all.
    n_snapshots counts the distinct shorter conversations that a kept one begins with and that were logged.

    Null roles and texts are empty, a null turn number comes first; a turn without a conversation id is a
    conversation of its own, whose id is null and larger than any other; only equal rows are one. Turns may be very long, but a
    conversation has to fit one row. An empty table gives no rows; other columns, whatever their names, are
    dropped.
    """
    last = (1 << 63) - 1
    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    named = turns.select(F.coalesce(turns[id_col].cast("long"), F.lit(last)).alias("key"), turns[turn_col].cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    # Turns without an id are told apart by their numbers and contents.
    rows = named.withColumn("alone", F.when(F.col("key") == last, F.xxhash64("turn", "role", "text")).otherwise(0))
    gather = lambda some: some.groupBy("key", "alone").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    rolled = durable(gather(rows).mapInArrow(_rolled, "key long, alone long, hashes array<binary>"))
    whole = rolled.select("key", "alone", F.element_at("hashes", -1).alias("hash"))
    classes = durable(whole.groupBy("hash").agg(F.min(F.struct("key", "alone")).alias("first"), F.count(F.lit(1)).alias("n_copies")).select("hash", "first.*", "n_copies"))
    firsts = rolled.join(classes, ["key", "alone"]).select("key", "alone", "hash", "n_copies", F.size("hashes").alias("n_turns"), "hashes")
    prefixes = firsts.select("key", "alone", F.explode(F.slice("hashes", F.lit(1), F.col("n_turns") - 1)).alias("hash"))
    maximal = firsts.drop("hashes").join(prefixes.select("hash").distinct(), "hash", "left_anti")
    logged = prefixes.join(classes.select("hash"), "hash", "left_semi").groupBy("key", "alone").agg(F.count(F.lit(1)).alias("n_snapshots"))
    kept = durable(maximal.join(logged, ["key", "alone"], "left"))
    # Only what is kept is gathered again, and rendered.
    open_, head, close = TURN
    turn = lambda t: F.concat(F.lit(open_), t["role"], F.lit(head), t["text"], F.lit(close))
    texts = gather(rows.join(kept.select("key", "alone"), ["key", "alone"], "left_semi")).select("key", "alone", F.array_join(F.transform("turns", turn), "").alias("rendered"))
    return kept.join(texts, ["key", "alone"]).select(
        F.when(F.col("key") != last, F.col("key")).alias(id_col), "n_turns", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"), "n_copies", "rendered", F.sha2("rendered", 256).alias("rendered_sha256")
    )

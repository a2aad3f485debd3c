"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour instead of to the node."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return edges.join(least.hint("merge"), "a").select(F.col("least").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are all linked to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least.hint("merge"), "b").where("a != least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("least").alias("a"), "b").union(moved).distinct()


def _state(edges: DataFrame) -> tuple:
    """What tells one table of edges from another: its number of rows and two sums over their hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 16))).first())


def components(links: DataFrame) -> DataFrame:
    """id and component, the least id that can be reached, of every id in ``links`` (a, b: long).

    Rounds of large and small stars contract the links until each id is linked to the least one of its
    component and to nothing else. Every step is a minimum by key, which combines before the shuffle, and a
    join whose one side has each key once, which adaptive execution can split; there are never more edges
    than at the start. Rounds are written to the checkpoint folder. An empty table gives no rows; nulls and
    links of an id to itself are left out, repeated links count once.
    """
    edges = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = _state(edges)
    while state[0]:
        edges = durable(_small_star(_large_star(edges)))
        was, state = state, _state(edges)
        if was == state:
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())

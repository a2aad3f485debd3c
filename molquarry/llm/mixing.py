"""Mixing sources to target weights by hierarchical budgeting, native.

A token budget flows from the root of a domain-language-source tree to its leaves in proportion to weights,
no node getting more than its documents hold over all epochs. What a node cannot use goes to its siblings
first: among siblings the budget is filled up like water, and since a node's capacity is known before it is
given anything, only what a whole family cannot use is left for the family's own siblings. Each leaf then
takes whole epochs and the prefix of one more, in an order that the seed and the epoch fix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.common import WORD, durable, joined_back

LEVELS = ("domain", "lang", "source")
#: A leaf's epoch is cut into 2 ** BUCKET_BITS ranges of its order, so that no running sum covers a leaf.
BUCKET_BITS = 12


def source_domain(source: Column) -> Column:
    """The domain of a source named by a word and a number: one of four, by the number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(F.length(number) + F.ascii(F.reverse(number)), F.lit(4)).cast("string")))


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    """The weight of a node by its own name at its level, 1 where none is given; names are matched as 'level=name'."""
    named = {k.split("=", 1)[1]: float(w) for k, w in weights.items() if k.split("=", 1)[0] == level}
    found = F.lit(1.0)
    for name, w in sorted(named.items()):
        found = F.when(F.col(level) == name, F.lit(w)).otherwise(found)
    return found


def _fill_levels(nodes: DataFrame, family: Sequence[str]) -> DataFrame:
    """The family and ``level``: tokens for each unit of weight at which the family's budget is used up.

    ``nodes`` has the family, ``cap``, ``w`` and ``above``, the family's budget. A node takes the smaller of its
    cap and level times weight. Starting from nobody full, each round sets the level by what the full nodes
    leave to the others; levels only rise, until no further node is full. A round is one sum by family, so
    no family, however many members it has, is gathered or sorted.
    """
    levels = durable(nodes.groupBy(*family).agg((F.first("above") / F.sum("w")).alias("level")))
    while True:
        full = F.col("cap") <= F.col("level") * F.col("w")
        left = F.first("above") - F.sum(F.when(full, F.col("cap")).otherwise(0.0))
        weight = F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        sums = nodes.join(levels, list(family)).groupBy(*family).agg(F.first("level").alias("was"), left.alias("left"), weight.alias("weight"))
        new = durable(sums.select(*family, "was", F.when(F.col("weight") > 0, F.greatest("was", F.col("left") / F.col("weight"))).otherwise(F.lit(float("inf"))).alias("level")))
        levels = new.drop("was")
        if new.where("level > was * (1 + 1e-12) and was < double('inf')").isEmpty():
            return levels


def budgets(leaves: DataFrame, budget: Column, epochs: int, weights: Mapping[str, float], levels: Sequence[str] = LEVELS) -> DataFrame:
    """The leaves (the levels and ``tokens``) with ``given``, a whole number of tokens.

    Family by family a budget is filled up: a node is given all that it can use, or its share by weight of what
    the full nodes leave. Nodes of weight 0 are given nothing.
    """
    flow = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double")).withColumn("given", budget.cast("double")).withColumn("root", F.lit(0))
    for depth, level in enumerate(levels):
        family = ["root", *levels[:depth]]
        path = [*family, level]
        # What a child of weight 0 could use is no use to its parents.
        usable = F.col("cap")
        for below in levels[depth + 1 :]:
            usable = F.when(_weight(below, weights) > 0, usable).otherwise(0.0)
        tree = flow.groupBy(*path).agg(F.sum(usable).alias("cap"), F.first("given").alias("above")).withColumn("w", _weight(level, weights))
        nodes = durable(tree.where("w > 0"))
        share = F.least(F.col("cap"), F.col("level") * F.col("w"))
        shares = nodes.join(_fill_levels(nodes, family), family).select(*path, F.when(F.col("cap") > 0, share).otherwise(0.0).alias("share"))
        flow = flow.join(shares, path, "left").withColumn("given", F.coalesce("share", F.lit(0.0))).drop("share")
    return flow.withColumn("given", F.floor(F.col("given") + 1e-6)).drop("cap", "root")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", budget: int | None = None, fraction: float = 0.5, epochs: int = 4, weights: Mapping[str, float] | None = None, seed: int = 0, domain: Column | None = None, with_hash: bool = False) -> DataFrame:
    """One row per document that is taken: id, domain, lang, source, n_tokens, n_copies, epoch and, if asked for, text_hash.

    Tokens are words. The budget is ``budget`` tokens, or ``fraction`` of all tokens. n_copies is the number
    of epochs that take the document: all whole epochs, and one more if it is in the prefix of the last,
    ``epoch``. The prefix ends before the first document that would exceed the leaf's budget, so a leaf falls
    short by less than one document.

    A weight is named 'level=name'; 0 leaves that node out, a negative one is refused.

    text_hash (xxhash64, of '' for null) tells apart rows that share an id, or have none; it then orders them too.
    Null texts have no tokens; null domains, languages and sources are the name ''. Very long texts are only
    counted. Rows of one order (repeated ids) are taken by id and number of tokens, and those that agree in
    these too are alike; repeated rows count each. An empty table, or a budget of none, gives no rows; other
    columns, whatever their names, are not looked at.
    """
    weights = {} if weights is None else weights
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights can't be negative")
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    dom = source_domain(docs[source_col]) if domain is None else domain
    told = ["text_hash"] if with_hash else []
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    hashed = [text_hash.alias(c) for c in told]
    # Rows without an id get their places by their texts.
    rows = durable(docs.select(docs[id_col].alias("id"), F.when(docs[id_col].isNull(), text_hash).alias("apart"), F.coalesce(dom.cast("string"), F.lit("")).alias("domain"), name(lang_col).alias("lang"), name(source_col).alias("source"), F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"), *hashed))
    leaves = durable(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    total = leaves.agg(F.sum("tokens").alias("t"))
    wanted = F.lit(budget).cast("double") if budget is not None else F.coalesce(total.select(F.col("t") * fraction).scalar(), F.lit(0.0))
    plan = budgets(leaves, wanted, epochs, weights)
    empty = F.col("tokens") == 0
    plan = durable(plan.select(*LEVELS, F.when(empty, 0).otherwise(F.floor(F.col("given") / F.greatest(F.col("tokens"), F.lit(1)))).cast("int").alias("whole"), F.when(empty, 0).otherwise(F.col("given") % F.greatest(F.col("tokens"), F.lit(1))).cast("long").alias("rest")))
    order = joined_back(rows, plan, list(LEVELS), "inner").withColumn("h", F.xxhash64(F.lit(seed), F.col("whole"), F.col("id"), F.col("apart"))).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    keys = [*LEVELS, "bucket"]
    sums = durable(order.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).withColumn("ten", F.shiftright("bucket", BUCKET_BITS // 2)))
    # Running sums in two steps, over 2 ** (BUCKET_BITS / 2) rows at most in each.
    running = lambda kin, by: F.sum("tokens").over(Window.partitionBy(*kin).orderBy(by)) - F.col("tokens")
    tens = sums.groupBy(*LEVELS, "ten").agg(F.sum("tokens").alias("tokens"))
    whole = tens.select(*LEVELS, "ten", running(LEVELS, "ten").alias("of_tens"))
    inside = sums.select(*keys, "ten", running([*LEVELS, "ten"], "bucket").alias("of_buckets"))
    before = inside.join(whole, [*LEVELS, "ten"]).select(*keys, (F.col("of_tens") + F.col("of_buckets")).alias("tokens_before"))
    placed = order.join(before, keys)
    upto = F.col("tokens_before") + F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("h", "id", "apart", "n_tokens", *told).rowsBetween(Window.unboundedPreceding, 0))
    copies = F.col("whole") + (upto <= F.col("rest")).cast("int")
    return placed.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", copies.alias("n_copies"), F.col("whole").alias("epoch"), *told).where("n_copies > 0")

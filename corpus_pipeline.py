"""A corpus pipeline: quality rules, exact dedup, near-duplicate dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of ``docs``. Stages never give a document back that an earlier one dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm.common import SPACE, durable, table
from molquarry.llm.exact_dedup import exact_dedup
from molquarry.llm.mixing import mixed
from molquarry.llm.near_dedup import near_dedup
from molquarry.llm.packing import pack
from molquarry.llm.quality import quality_filter
from molquarry.llm.tokens import vocabulary

#: Target weights of the mix, the share of all tokens that is its budget, and its seed.
WEIGHTS, FRACTION, SEED = {"lang=en": 3.0}, 0.8, 1
#: Words of a shingle and percent of similarity for near duplicates.
SHINGLE, PERCENT = 5, 80


def _chosen(docs: DataFrame, told: Column, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``told``, a value of their text, are among ``chosen`` (doc_id, told).

    Of rows that agree in both one stays, the one that is least as JSON. A null doc_id matches a null one. The
    rows are carried as one struct, so that no column of theirs can clash.
    """
    last = F.lit((1 << 63) - 1)
    whole = F.struct(*[docs[c] for c in docs.columns])
    named = docs.select(F.coalesce(docs["doc_id"].cast("long"), last).alias("id"), told.alias("told"), whole.alias("row"))
    wanted = chosen.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), "told")
    kept = named.join(wanted, ["id", "told"], "left_semi").groupBy("id", "told").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host (source) does, go; the others stay as they are.

    Null and empty texts fail; a null source is the source ''. Very long texts are measured whole. Repeated
    rows are judged each and there are no ties; an empty table stays empty; further columns are kept.
    """
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with texts that are equal but for runs of white space, the smallest doc_id stays, once.

    Null counts as the empty text, and one of all of these stays; a null doc_id is larger than any other. Very
    long texts are compared whole. Of rows that repeat doc_id and text one stays; an empty table stays empty;
    further columns are kept.
    """
    stay = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("told"))
    return _chosen(docs, F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACE, " "), 256), stay)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of near duplicates connect, one row with the smallest doc_id stays.

    Null and empty texts are near nothing. A null doc_id is larger than any other; rows that share one are
    told apart by their texts. Very long texts are sketched whole. Of rows that repeat doc_id and text one
    stays; an empty table stays empty; further columns are kept.
    """
    stay = near_dedup(docs, SHINGLE, PERCENT, with_hash=True).where("kept")
    return _chosen(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))), stay.select("doc_id", F.col("text_hash").alias("told")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, each once.

    Null texts have no tokens, a null source or language is the name ''. Very long texts are only counted.
    Ties of the order are broken by doc_id, size and text. Of rows that repeat doc_id and text one stays; an
    empty table stays empty; further columns are kept.
    """
    taken = mixed(docs, fraction=FRACTION, epochs=1, weights=WEIGHTS, seed=SEED, with_hash=True)
    return _chosen(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))), taken.select("doc_id", F.col("text_hash").alias("told")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 1024 tokens.

    Null texts are empty, so their document is the end id alone; very long ones take many sequences. Rows are
    packed each, repeated or not; an empty table gives no rows; further columns are not looked at.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", packing)]

#: Near-duplicate groups and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs

"""What the operators of this package share: reading, words, durable intermediate results."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII separators.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut; later reads survive the loss of any executor.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Where that is unset, a session
    whose executor is the driver itself (tests) gets a temporary one; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def joined_back(big: DataFrame, side: DataFrame, on: list[str], how: str, rows: int = 20_000) -> DataFrame:
    """Join with a broadcast when ``side`` is checked to have at most ``rows`` rows, else as Spark plans it.

    The second way shuffles on the keys; adaptive execution splits its skewed partitions.
    """
    return big.join(F.broadcast(side) if small(side, rows) else side, on, how)


def record_batch(rows: Sequence[tuple], types: Mapping[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as one Arrow batch of these columns."""
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

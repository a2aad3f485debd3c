"""CSV files with line ends in quoted fields, read by many tasks.

Spark deals a file out in byte ranges cut at line ends, but a line end may lie inside a quoted field. A first pass counts for each range its quotes and the records
that begin in it, once for a range that begins outside quotes and once for one that begins inside; the parity of the ranges before it tells which holds. Then each task knows whether its
first line begins a record. A record that goes on into later ranges is put together from one piece of each, the only rows that are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges whose table is broadcast at most; more are joined.
RANGES = 20_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without their line feed, with the file and the start of the range that they are of; a task has those of a range in order."""
    # Where a range begins is taken from where the task's split begins, so lines of one split stay together.
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _quotes(lines: pa.Array) -> pa.Array:
    return pc.count_substring(lines, '"')


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: whether its quotes are odd, and how many records begin in it after an even and after an odd number of quotes.

    A line that is empty but for a carriage return begins no record.
    """
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        quotes = _quotes(batch.column(2)).to_pylist()
        for file, start, line, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), quotes, strict=True):
            state = found.setdefault((file, start), [0, 0, 0])
            text = line.as_py()
            if text and text != "\r":
                state[1 + state[0]] += 1
            state[0] ^= n & 1
    rows = [(*k, *v) for k, v in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], ["file", "start", "odd", "begun_0", "begun_1"])


def survey(spark: SparkSession, path: str) -> DataFrame:
    """One row per range: file, start, inside (whether it begins in a quoted field), records (that begin in it, the header too), before (records of the file before it)."""
    ranges = _lines(spark, path).mapInArrow(_surveyed, "file string, start long, odd long, begun_0 long, begun_1 long")
    before = Window.partitionBy("file").orderBy("start")
    known = ranges.withColumn("inside", (F.sum("odd").over(before) - F.col("odd")) % 2 == 1)
    begun = known.withColumn("records", F.when(F.col("inside"), F.col("begun_1")).otherwise(F.col("begun_0")))
    return begun.select("file", "start", "inside", "records", (F.sum("records").over(before) - F.col("records")).alias("before"))


def count_records(spark: SparkSession, path: str) -> int:
    """The rows of all files below the headers, by the first pass alone."""
    per_file = survey(spark, path).groupBy("file").agg(F.sum("records").alias("n"))
    return int(per_file.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0))).first()[0])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of records at the ends of ranges: file, start, number in the range (0 for what goes on from before), whether it is whole, text."""
    types = {"file": pa.string(), "start": pa.int64(), "number": pa.int64(), "ends": pa.bool_(), "text": pa.string()}
    out: list[tuple] = []
    here: tuple[str, int] | None = None
    inside, number, lines = False, 0, []

    def piece(ends: bool) -> None:
        if lines and (number == 0 or len(lines) > 1 or lines[0] not in ("", "\r")):
            text = "\n".join(lines)
            out.append((*here, number, ends, text.removesuffix("\r") if ends else text + "\n"))
        lines.clear()

    def full() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types.values(), strict=True)], list(types))
        out.clear()
        return batch

    for batch in batches:
        quotes = _quotes(batch.column(2)).to_pylist()
        for file, start, line, begins, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), quotes, strict=True):
            if (file, start) != here:
                if here is not None:
                    piece(not inside)
                here, inside, number = (file, start), begins, 0
            if not inside and not lines:
                number += 1
            lines.append(line)
            inside ^= bool(n & 1)
            if not inside:
                piece(True)
        if len(out) >= 10_000:
            yield full()
    if here is not None:
        piece(not inside)
    yield full()


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, start (of its range), number (in the range, from 1), text. The header is the first record of each file."""
    begins = survey(spark, path).select("file", "start", "inside")
    few = begins.limit(RANGES + 1).count() <= RANGES
    lines = _lines(spark, path)
    if few:
        told = lines.join(F.broadcast(begins), ["file", "start"])
    else:
        # Many ranges: the lines of a range meet in one task and keep their order by their place in the input.
        placed = lines.withColumn("place", F.monotonically_increasing_id())
        told = placed.join(begins, ["file", "start"]).sortWithinPartitions("file", "start", "place")
    pieces = told.select("file", "start", "value", "inside").mapInArrow(_pieces, "file string, start long, number long, ends boolean, text string")
    whole = pieces.where("ends AND number > 0").select("file", "start", "number", "text")
    # A piece that begins nowhere belongs to the last record that began and did not end before it.
    parts = pieces.where("NOT ends OR number = 0")
    of = F.last(F.when(F.col("number") > 0, F.struct("start", "number")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start", F.when(F.col("number") == 0, 0).otherwise(1)))
    joined = parts.withColumn("of", of).groupBy("file", F.col("of.start").alias("from"), F.col("of.number").alias("number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(joined.select("file", F.col("from").alias("start"), "number", F.regexp_replace("text", "\r?\n?$", "").alias("text")))


def _fields(text: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([text], delimiter=delimiter), [])


def read_csv_ranges(spark: SparkSession, path: str, delimiter: str = ",", at: str | None = None) -> DataFrame:
    """CSV files with a header, as strings; quoted fields may hold delimiters, doubled quotes and line ends.

    Every range of a file is read by its own task, however fields cross ranges. Quotes are taken as RFC 4180
    has them: a field with a quote is quoted. Lines end in \\n or \\r\\n; a byte order mark is left out; blank lines
    are no records; missing fields are ''. All files have one header. A file without records gives no columns. ``at`` names a column for the place of each record: file, start of the range, number.
    """
    rows = records(spark, path)
    first = survey(spark, path).where("records > 0").groupBy("file").agg(F.min("start").alias("start")).withColumn("number", F.lit(1))
    some = rows.join(F.broadcast(first.orderBy("file").limit(1)), ["file", "start", "number"]).select("text").first()
    if some is None:
        return spark.createDataFrame([], T.StructType())
    names = _fields(some["text"].removeprefix("﻿"), delimiter)
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    body = rows.join(F.broadcast(first) if first.limit(RANGES + 1).count() <= RANGES else first, ["file", "start", "number"], "left_anti")
    options = {"sep": delimiter, "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "lineSep": "\u0000"}
    values = body.select("file", "start", "number", F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("v"))
    cells: list[Column] = [F.coalesce(F.col(f"v.c{k}"), F.lit("")).alias(n) for k, n in enumerate(names)]
    place = [F.struct("file", "start", "number").alias(at)] if at else []
    return values.select(*cells, *place)

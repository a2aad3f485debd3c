"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one shorter piece. Only the number of pieces of each length goes
to the driver: a histogram of at most ``size`` rows. Lengths are placed longest first, each on the shortest
packs that have room, as counts of packing patterns. The pieces are then ranked within their length and the
patterns joined back by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.common import durable, joined_back, record_batch
from molquarry.llm.tokens import encoder

#: Ranks are counted within so many buckets of each length at least, and of so many pieces at most on average.
BUCKETS, BUCKET_ROWS = 64, 200_000


def patterns(histogram: Mapping[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and their counts, for so many pieces of each length.

    A piece goes onto the shortest pack that has room, which may be one that just got a piece of its length;
    with no such pack it opens one. All packs of a pattern move together.
    """
    packs: dict[int, dict[tuple[int, ...], int]] = {}

    def add(pattern: tuple[int, ...], n: int) -> None:
        group = packs.setdefault(sum(pattern), {})
        group[pattern] = group.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            total = min((t for t in packs if t + length <= size), default=None)
            if total is None:
                each = size // length
                for pattern, n in (((length,) * each, left // each), ((length,) * (left % each), 1)):
                    if pattern and n:
                        add(pattern, n)
                break
            group = packs[total]
            pattern = min(group)
            n = min(left, group[pattern])
            group[pattern] -= n
            if not group[pattern]:
                del group[pattern]
                if not group:
                    del packs[total]
            add((*pattern, length), n)
            left -= n
    return sorted((p, n) for g in packs.values() for p, n in g.items())


def slots(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) in order: which ranks of a length go where."""
    rows, used, sequence = [], {}, 0
    for pattern, n in found:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


_PIECES = {"id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut at every ``size`` ids.

    ``tokenizer`` is the path of the file on every executor, or a function that tells it there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer() if callable(tokenizer) else tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                out += [(i, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
            yield record_batch(out, _PIECES)

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty, so its document is the end id alone. A very long text is many full pieces and one
    shorter one; its ids have to fit a task. Pieces of one length are ranked by id, start and checksum; those
    that agree in all of these are alike. Repeated rows, and rows that share an id or have none, are packed
    each; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    cut = durable(pieces(docs, tokenizer, size, id_col, text_col))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(BUCKETS, -(-sum(histogram.values()) // BUCKET_ROWS))
    place = slots(patterns(histogram, size))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most ``size`` times ``buckets`` rows.
    before = durable(counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = joined_back(dealt, before, ["length", "bucket"], "inner").select(*_PIECES, (F.col("before") + own).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = place[:, 0] * (1 << 48) + place[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1
            arrays = [batch.column(c) for c in _PIECES] + [pa.array(place[at, 2] + rank - place[at, 1]), pa.array(place[at, 3])]
            yield pa.record_batch(arrays, [*_PIECES, "sequence_id", "offset"])

    rows = ranked.mapInArrow(placed, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return rows.withColumnRenamed("id", id_col)

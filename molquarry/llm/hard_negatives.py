"""Hard-negative mining by bit-sliced integer products.

Components of a block of rows are cut into bit-planes. Anchors are multiplied with one plane after the other,
the most significant first; what the planes that are left can still add is bounded by the anchor's positive and
negative components, so every pair has a score interval that halves with each plane. A pair is dropped as soon as
its interval can't qualify any more; after the last plane the scores of what is left are exact.

The anchors meet all rows in blocks: blocks of anchors are joined to blocks of rows, and a task keeps only the
best few of each anchor, so what is shuffled is a few rows for each anchor and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.common import durable, small

#: Rows and anchors of a block.
ROWS, ANCHORS = 4096, 512
#: Blocks of anchors that are broadcast at most, and that a task keeps results of.
BLOCKS = 64
#: Pairs are listed one by one once less than this share of a block is left; until then whole blocks are multiplied.
SPARSE = 1 / 64
EXACT = 1 << 53
LAST = (1 << 63) - 1
_ROW_BLOCK = "ids binary, labels binary, m binary, width int"
_ANCHOR_BLOCK = "g int, a_ids binary, a_keys binary, a_labels binary, a_m binary, a_width int, a_limits binary"


def finite(vector: Column) -> Column:
    """Whether a vector is there and no component is null, NaN or infinite."""
    real = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    return F.coalesce(vector.isNotNull() & F.forall(vector, real), F.lit(False))


def _matrix(lists: pa.Array, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(factor * x) as rows of one width, short vectors filled with zeros, and whether 100 times a row's products fit a long."""
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width))
    with np.errstate(over="ignore"):
        out[np.arange(width) < size[:, None]] = np.floor(np.asarray(lists.flatten().cast(pa.float64())) * factor)
    return out, np.abs(out).max(axis=1, initial=0.0) * np.sqrt(max(width, 1)) < float(1 << 28)


def _row_blocks(factor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns id, label, v as blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                m, fit = _matrix(some.column(2), factor)
                ids, labels = (np.asarray(some.column(k)).astype(np.int64)[fit] for k in (0, 1))
                if len(ids):
                    yield pa.record_batch([pa.array([x], pa.binary()) for x in (ids.tobytes(), labels.tobytes(), m[fit].astype(np.int64).tobytes())] + [pa.array([m.shape[1]], pa.int32())], ["ids", "labels", "m", "width"])

    return run


def _anchor_blocks(factor: int, per: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns id, key, label, v, g and limits (``per`` numbers each) as blocks of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.asarray(batch.column(4))
            for g in np.unique(groups):
                of = np.flatnonzero(groups == g)
                for a in range(0, len(of), ANCHORS):
                    some = batch.take(pa.array(of[a : a + ANCHORS]))
                    m, fit = _matrix(some.column(3), factor)
                    ids, keys, labels = (np.asarray(some.column(k)).astype(np.int64)[fit] for k in (0, 1, 2))
                    limits = np.full((len(fit), per), -1, np.int64)
                    for k, given in enumerate(some.column(5).to_pylist() if per else ()):
                        limits[k, : len(given)] = given
                    values = [ids, keys, labels, m[fit].astype(np.int64), limits[fit]]
                    raw = [pa.array([x.tobytes()], pa.binary()) for x in values]
                    if len(ids):
                        yield pa.record_batch([pa.array([g], pa.int32()), *raw[:4], pa.array([m.shape[1]], pa.int32()), raw[4]], ["g", "a_ids", "a_keys", "a_labels", "a_m", "a_width", "a_limits"])

    return run


#: possible(lo, hi, a, r, active): which score intervals can still qualify, of whole blocks (r is None), or of listed pairs.
Test = Callable[[np.ndarray, np.ndarray, np.ndarray, "np.ndarray | None", np.ndarray], np.ndarray]


def qualified(anchors: np.ndarray, rows: np.ndarray, active: np.ndarray, possible: Test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that stay possible to the last bit, and their exact inner products.

    ``active`` (anchors x rows) tells which pairs to look at.
    """
    deep = int(np.abs(rows).max(initial=0)).bit_length()
    shifted = rows + (1 << deep)  # not negative, deep + 1 bits
    plain = int(np.abs(anchors).max(initial=0)) * max(anchors.shape[1], 1)  # of the product with a plane
    kind = np.int64 if plain << (deep + 2) >= EXACT else np.float32 if plain < 1 << 24 else np.float64
    a = anchors.astype(kind)
    up, down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    every, wide = np.arange(len(anchors)), np.int64 if kind is np.int64 else np.float64
    score = np.repeat(-(anchors.sum(axis=1) << deep)[:, None], active.shape[1], axis=1).astype(wide)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for bit in range(deep, -1, -1):
        plane, left = (shifted >> bit & 1).astype(kind), (1 << bit) - 1  # left is what lower planes can add to a component
        if pairs is None:
            score += (a @ plane.T).astype(wide) * wide(1 << bit)
            active &= possible(score + (down * left)[:, None], score + (up * left)[:, None], every, None, active)
            if np.count_nonzero(active) < SPARSE * active.size:
                pairs = np.nonzero(active)
                score = score[pairs]
        else:
            i, r = pairs
            score = score + np.einsum("ij,ij->i", a[i], plane[r]).astype(wide) * wide(1 << bit)
            stay = possible(score + down[i] * left, score + up[i] * left, i, r, active)
            pairs, score = (i[stay], r[stay]), score[stay]
    if pairs is None:
        pairs = np.nonzero(active)
        score = score[pairs]
    return *pairs, score.astype(np.int64)


NEVER = -(1 << 62)


def _ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its key, in this order (which sorts by key first)."""
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def _kth(key: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each of n keys."""
    out = np.full(n, NEVER, np.float64 if value.dtype != np.int64 else np.int64)
    order = np.lexsort((-value, key))
    at = order[_ranked(key, order) == k - 1]
    out[key[at]] = value[at]
    return out


class _Best:
    """The best ``k`` (score, id) of each of n keys."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, NEVER, np.int64)
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        rank = _ranked(key, order)
        full = order[rank == self.k - 1]
        self.least[key[full]] = score[full]
        stay = order[rank < self.k]
        self.key, self.score, self.id = key[stay], score[stay], ids[stay]


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _among_best(best: _Best) -> Test:
    """Intervals that reach the k-th best of the task so far, and the k-th best lower end of this block."""

    def possible(lo: np.ndarray, hi: np.ndarray, i: np.ndarray, r: np.ndarray | None, active: np.ndarray) -> np.ndarray:
        n, k = active.shape[1], best.k
        if r is not None:
            return hi >= np.maximum(best.least, _kth(i, lo, len(best.least), k))[i]
        own = np.partition(np.where(active, lo, NEVER), n - k, axis=1)[:, n - k] if n >= k else NEVER
        return hi >= np.maximum(best.least, own)[:, None]

    return possible


def _in_ranges(best: _Best, least: np.ndarray, most: np.ndarray) -> Test:
    """Intervals that meet one of the anchor's ranges, above the k-th best of that range so far and, of listed pairs, of this block."""
    per = least.shape[1]

    def possible(lo: np.ndarray, hi: np.ndarray, i: np.ndarray, r: np.ndarray | None, active: np.ndarray) -> np.ndarray:
        out, floors = np.zeros(lo.shape, bool), np.maximum(least, best.least.reshape(least.shape))
        for p in range(per):
            floor, top = floors[:, p], most[:, p]
            if r is None:
                out |= (hi >= floor[:, None]) & (lo <= top[:, None])
                continue
            sure = (lo >= least[i, p]) & (hi <= top[i])
            floor = np.maximum(floor, _kth(i[sure], lo[sure], len(floor), best.k))
            out |= (hi >= floor[i]) & (lo <= top[i])
        return out

    return possible


def _searched(k: int, per: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best k of each anchor (per = 0: of its label) or of each of its limits (of other labels, within low and high percent)."""

    def emitted(ids: np.ndarray, keys: np.ndarray, best: _Best) -> pa.RecordBatch:
        a, slot = (best.key, np.zeros_like(best.key)) if not per else np.divmod(best.key, per)
        return pa.record_batch([pa.array(x, pa.int64()) for x in (ids[a], keys[a], slot, best.id, best.score)], ["anchor", "key", "slot", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[np.ndarray, np.ndarray, _Best]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                read = lambda name: np.frombuffer(at(name).as_buffer(), np.int64)  # noqa: B023, E731
                a_ids, a_keys, a_labels, ids, labels = map(read, ("a_ids", "a_keys", "a_labels", "ids", "labels"))
                anchors, rows = (read(n).reshape(len(i), at(w).as_py()) for n, i, w in (("a_m", a_ids, "a_width"), ("m", ids, "width")))
                width = max(anchors.shape[1], rows.shape[1])
                anchors, rows = _padded(anchors, width), _padded(rows, width)
                name = a_ids.tobytes() + a_keys.tobytes()
                if name not in kept and len(kept) >= BLOCKS:
                    yield emitted(*kept.pop(next(iter(kept))))
                best = kept.setdefault(name, (a_ids, a_keys, _Best(len(a_ids) * max(per, 1), k)))[2]
                same = a_labels[:, None] == labels
                if not per:
                    i, r, score = qualified(anchors, rows, same & (a_ids[:, None] != ids), _among_best(best))
                    best.add(i, score, ids[r])
                    continue
                limits = read("a_limits").reshape(len(a_ids), per)
                # A positive that isn't there has an empty range, which no score meets.
                least, most = np.where(limits >= 0, -(-limits * low // 100), 1), np.where(limits >= 0, limits * high // 100, 0)
                i, r, score = qualified(anchors, rows, ~same & (least <= most).any(axis=1)[:, None], _in_ranges(best, least, most))
                for p in range(per):
                    fit = (score >= least[i, p]) & (score <= most[i, p])
                    best.add(i[fit] * per + p, score[fit], ids[r[fit]])
        for x in kept.values():
            yield emitted(*x)

    return run


def _met(rows: DataFrame, anchors: DataFrame, groups: int, search: Callable) -> DataFrame:
    """Every block of rows with every block of anchors: anchors are broadcast while there are few blocks, else both sides are shuffled by group."""
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    if small(anchors, BLOCKS):
        joined = spread.join(F.broadcast(anchors), "g")
    else:
        joined = spread.join(anchors.hint("merge"), "g").sortWithinPartitions("g")
    return joined.mapInArrow(search, "anchor long, key long, slot long, other long, score long")


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first n of each anchor and slot: higher scores first, then smaller ids."""
    rank = F.row_number().over(Window.partitionBy("anchor", "key", "slot").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, factor: int = 256) -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row takes part if its label and vector are there and no component is null or not finite; x counts as floor(factor * x).
    Scores are integer inner products; higher ones come first, then smaller ids. Rows that ``anchor`` (a condition on the columns of
    ``vectors``) names are anchors. An anchor's positives are its first ``positives`` rows of the same label and another id. For each, the
    first ``negatives`` rows of other labels between ``low`` and ``high`` percent of its score are returned.

    Short vectors count as filled up with zeros. Anchors that repeat id, label and vector are one; anchors that
    share only the id are searched for each. Other rows that repeat count each. A null id names no anchor and is
    larger than any other. Vectors with components so large that products could leave a long take no part. No
    anchors, and an empty table, give no rows. Other columns are not looked at.
    """
    marked = vectors.select(F.coalesce(vectors[id_col].cast("long"), F.lit(LAST)).alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    some = marked.where(F.col("label").isNotNull() & finite(F.col("v")))
    chosen = durable(some.where(F.col("anchor") & (F.col("id") != LAST)).select("id", "label", "v", F.xxhash64("label", "v").alias("key")).dropDuplicates(["id", "key"]))
    groups = max(1, -(-chosen.count() // ANCHORS))
    dealt = chosen.withColumn("g", F.pmod(F.xxhash64("id", "key"), F.lit(groups)).cast("int"))
    blocks = some.select("id", "label", "v").mapInArrow(_row_blocks(factor), _ROW_BLOCK)
    packed = lambda of, limits, per: durable(of.repartition(groups, "g").select("id", "key", "label", "v", "g", limits.alias("limits")).mapInArrow(_anchor_blocks(factor, per), _ANCHOR_BLOCK))
    near = _met(blocks, packed(dealt, F.array().cast("array<long>"), 0), groups, _searched(positives, 0, low, high))
    best = durable(_first(near, positives).select("anchor", "key", F.col("rank").alias("place"), F.col("other").alias("positive"), F.col("score").alias("positive_score")))
    lists = best.groupBy(F.col("anchor").alias("id"), "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    # A negative score of a positive has an empty range, so such positives, always the last, are not searched for.
    limited = dealt.join(lists, ["id", "key"]).withColumn("scores", F.filter("scores", lambda x: x >= 0))
    far = _met(blocks, packed(limited, F.col("scores"), positives), groups, _searched(negatives, positives, low, high))
    mined = _first(far, negatives).withColumn("place", F.col("slot").cast("int") + 1)
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return mined.join(best, ["anchor", "key", "place"]).select(F.col("anchor").alias("anchor_id"), named("positive").alias("positive_id"), "rank", named("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Centroid clustering of integer vectors by blocked matrix products.

|x - c|^2 = |x|^2 - 2 x.c + |c|^2 for a block of rows and all centroids at once. All terms are integers, so
float64 products are exact, in whatever order BLAS adds, as long as no partial sum reaches 2 ** 53; a bound on
the magnitudes tells, block by block, and a block beyond it is worked out in integers. Sums and counts of each
task meet in a tree of combinations, so the driver gets one row for each centroid, however many tasks there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied at once.
BLOCK = 4096
EXACT = 1 << 53
_LONG = 1 << 63


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none of them null, NaN or infinite."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(real(x.cast("double")), F.lit(False))), F.lit(False))


def scaled(column: pa.Array, dim: int, factor: int) -> np.ndarray:
    """floor(factor * x) of lists of ``dim`` numbers: float64 where these are exact, else Python's integers."""
    x = np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim)
    with np.errstate(over="ignore"):
        out = np.floor(x * factor)
    if out.size and not np.abs(out).max() < EXACT:
        whole = [[(v := float(y).as_integer_ratio())[0] * factor // v[1] for y in row] for row in x]
        out = np.array(whole, dtype=object).reshape(-1, dim)
    return out


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, exact: by BLAS below the bound, else in integers."""
    top = lambda m: max((abs(int(v)) for v in (m.min(), m.max())), default=0) if m.size else 0
    reach = top(x) + top(centroids)
    if x.dtype != object and x.shape[1] * reach * reach < EXACT:
        c = centroids.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
    exact = np.int64 if x.shape[1] * reach * reach < _LONG else object
    x = np.array([[int(v) for v in row] for row in x], dtype=exact).reshape(x.shape)
    c = centroids.astype(exact)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of several, and the squared distance."""
    d = distances(x, centroids)
    cluster = d.argmin(axis=1)
    return cluster, np.take_along_axis(d, cluster[:, None], axis=1)[:, 0]


def _whole(values: np.ndarray) -> np.ndarray:
    """The same integers as Python's, which never overflow."""
    return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape)


def _summed(centroids: np.ndarray, dim: int, factor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each task: for each centroid with rows the sums of their components, their number and their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total = np.zeros((k, dim + 2), dtype=object)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = scaled(batch.column(0).slice(a, BLOCK), dim, factor)
                cluster, distance = nearest(x, centroids)
                if x.dtype == object or np.abs(x).max() * len(x) >= EXACT or float(np.abs(distance).max()) * len(x) >= EXACT:
                    for row, c, d in zip(_whole(x), cluster, _whole(distance), strict=True):
                        total[c] += np.append(row, [1, d])
                    continue
                one = np.zeros((k, len(x)))
                one[cluster, np.arange(len(x))] = 1.0
                total += _whole(one @ np.column_stack([x, np.ones(len(x)), distance]))
        yield pa.record_batch([pa.array([",".join(map(str, row)) for row in total.tolist()], pa.string())], ["sums"])

    return run


def _combined(vectors: DataFrame, centroids: np.ndarray, dim: int, factor: int) -> np.ndarray:
    """Sums, numbers and distances over all vectors, exact integers, combined along a tree."""
    k = len(centroids)
    partial = vectors.mapInArrow(_summed(centroids, dim, factor), "sums string").rdd
    rows = partial.mapPartitions(lambda rows: [np.array([[int(v) for v in r["sums"].split(",")] for r in some], dtype=object)] if (some := list(rows)) else [])
    return rows.treeAggregate(np.zeros((k, dim + 2), dtype=object), lambda s, m: s + m, lambda s, t: s + t, depth=3)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, dim: int = 64, rounds: int = 5, seed: str = "2", factor: int = 256) -> DataFrame:
    """One row per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector takes part if it has exactly ``dim`` components, none null or not finite; x counts as floor(factor * x).
    The first centroids are the k vectors with the least sha256 of ``seed:id`` (ties: the least components). Each round gives
    every vector to the nearest centroid, the first of several, and moves centroids that got some to the floor of
    their mean. Then vectors are assigned once more.

    A null id hashes as the empty text and stays null. Rows that repeat an id are clustered each, repeated rows
    too. Fewer than k vectors make fewer clusters; none, and an empty table, give no rows. A distance or inertia
    that doesn't fit a long is null. Other columns, whatever their names, are not looked at.
    """
    named = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v"))
    kept = named.where(usable(F.col("v"), dim))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    schema = f"{id_col} {kept.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = _whole(np.concatenate([scaled(pa.array([list(r["v"])], pa.list_(pa.float64())), dim, factor) for r in first]))
    only = kept.select("v")
    for _ in range(rounds):
        total = _combined(only, centroids, dim, factor)
        centroids = np.array([[s // row[dim] for s in row[:dim]] if row[dim] else old for row, old in zip(total.tolist(), centroids.tolist(), strict=True)], dtype=object)
    fits = lambda v: int(v) if -_LONG <= v < _LONG else None
    inertia = [row[dim + 1] for row in _combined(only, centroids, dim, factor).tolist()]
    told = pa.table({
        "cluster_inertia": pa.array([fits(v) for v in inertia], pa.int64()),
        "inertia": pa.array([fits(sum(inertia))] * len(inertia), pa.int64()),
        "centroid_sha256": pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], pa.string()),
    })

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                cluster, distance = nearest(scaled(some.column(1), dim, factor), centroids)
                of = told.take(pa.array(cluster)).combine_chunks()
                yield pa.record_batch([some.column(0), pa.array(cluster, pa.int32()), pa.array([fits(int(v)) for v in distance], pa.int64()), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in of.columns)], [id_col, "cluster", "distance", *told.column_names])

    return kept.mapInArrow(assigned, schema)

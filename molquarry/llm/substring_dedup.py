"""Substring dedup on a De Bruijn graph of word windows.

The edges of the graph are windows of ``k`` words. Each window has a minimiser, the least hash of the
shorter grams in it, and consecutive windows with one minimiser are a path that is compacted at once. Equal
windows have equal minimisers, so

1. the minimisers of all texts are counted, once for each text, and those of one text only are dropped: no
   window of theirs is repeated across documents;
2. the compacted paths of the others are joined by minimiser, which brings equal edges together; where the
   paths of two documents branch, their edges differ and the path is cut. A minimiser of many texts is dealt
   into shares: what has no smaller document in its share, one document for each edge, is looked at once more
   over all shares;
3. each edge learns its source, the smallest document it starts in and where, and the paths of a document are
   glued by both coordinates to the longest spans that repeat one run of words of one source;
4. the source of each span tells a digest of the words at these coordinates, once for all documents that
   repeat them, and a span goes only if its own words have the same digest.

Candidates are windows with equal hashes of the minimiser and of the window, 64 bits each, over keyed hashes of
the words; what goes is verified by 128-bit digests of the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.common import record_batch
from molquarry.llm.rolling import mixed, slices, sliding_min, windows, words_of

#: Words of the grams that minimisers are taken from; texts of one minimiser that a task takes, on average.
GRAM, HOT = 4, 4096


def _edges(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some texts: minimiser, hash, index of the text, position in the text."""
    hashes, text = words_of(data, offsets)
    n = len(hashes) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    gram = min(GRAM, k)
    least = sliding_min(windows(hashes, gram, 1), k - gram + 1)
    whole = windows(hashes, k, 2)
    inside = np.flatnonzero(text[:n] == text[k - 1 :])
    begin = np.searchsorted(text, np.arange(len(offsets) - 1))
    return least[inside].view(np.int64), whole[inside].view(np.int64), text[inside], inside - begin[text[inside]]


def _paths(least: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where consecutive windows of one text with one minimiser begin."""
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def _minimisers(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, _, data, offsets in slices(texts):
                least, _, text, at = _edges(data, offsets, k)
                p = _paths(least, text, at)
                p = p[np.lexsort((least[p], text[p]))]
                new = np.ones(len(p), bool)
                new[1:] = (least[p[1:]] != least[p[:-1]]) | (text[p[1:]] != text[p[:-1]])
                p = p[new]  # each minimiser of a text once
                yield pa.record_batch([pa.array(least[p]), pa.array(ids[a + text[p]])], ["gram", "id"])

    return found


_PATHS = {"gram": pa.int64(), "share": pa.int32(), "id": pa.int64(), "row": pa.int32(), "at": pa.int32(), "edges": pa.list_(pa.int64())}


def _shared_paths(k: int):
    def shares(grams: np.ndarray, hot: pa.ListScalar, i: int, row: int) -> np.ndarray:
        """The share of each path of a row: one of those of its minimiser, or -1 where that is not dealt."""
        out = np.full(len(grams), -1, np.int32)
        if len(hot.values):
            key, n = (c.to_numpy(zero_copy_only=False) for c in hot.values.flatten())
            order = np.argsort(key)
            at = np.minimum(np.searchsorted(key, grams, sorter=order), len(key) - 1)
            dealt = key[order[at]] == grams
            own = mixed(np.array([i ^ row << 32], np.int64).view(np.uint64))[0] >> np.uint64(1)
            out[dealt] = int(own) % n[order[at[dealt]]]
        return out

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, grams, hot, row = (batch.column(c) for c in range(5))
            ids, row = ids.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(texts):
                least, whole, text, at = _edges(data, offsets, k)
                keep = np.zeros(len(least), bool)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    s = slice(bounds[i], bounds[i + 1])
                    keep[s] = np.isin(least[s], grams[a + i].values.to_numpy(zero_copy_only=False))
                least, whole, text, at = least[keep], whole[keep], text[keep], at[keep]
                p = _paths(least, text, at)
                bounds = np.searchsorted(text[p], np.arange(b - a + 1))
                share = [shares(least[p[bounds[i] : bounds[i + 1]]], hot[a + i], int(ids[a + i]), int(row[a + i])) for i in range(b - a)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(p, len(least)), pa.int32()), pa.array(whole))
                columns = [pa.array(least[p]), pa.array(np.concatenate(share)), pa.array(ids[a + text[p]]), pa.array(row[a + text[p]]), pa.array(at[p], pa.int32()), lists]
                yield pa.record_batch(columns, list(_PATHS))

    return found


_PIECES = {c: pa.int64() if c in ("id", "source") else pa.int32() for c in ("id", "row", "start", "n", "source", "source_row", "source_start")}
PIECE = "id long, row int, start int, n int, source long, source_row int, source_start int"


def _glued(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Pieces (id, row, start, n, source, source_row, source_start) that follow or overlap each other on both sides, as one."""
    i, row, start, n, source, source_row, source_start = columns
    shift = source_start - start
    order = np.lexsort((start, shift, source_row, source, row, i))
    i, row, start, n, source, source_row, shift = (x[order] for x in (i, row, start, n, source, source_row, shift))
    new = np.ones(len(i), bool)
    for x in (i, row, source, source_row, shift):
        new[1:] &= x[1:] == x[:-1]
    same, new = new, np.ones(len(i), bool)
    # Pieces of one shift are sorted; the end so far is the largest, since all are cut from the same windows.
    end = start.astype(np.int64) + n
    group = np.cumsum(~np.append(False, same[1:])) if len(i) else np.zeros(0, np.int64)
    far = np.maximum.accumulate(end + group * (1 << 32)) - group * (1 << 32) if len(i) else end
    new[1:] = ~same[1:] | (start[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1 if len(first) else first
    return [i[first], row[first], start[first], (far[last] - start[first]).astype(np.int32), source[first], source_row[first], (start[first] + shift[first]).astype(np.int32)]


def _edges_to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i, row, start, source, source_row, source_start = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        out = _glued([i, row, start, np.ones(len(i), np.int32), source, source_row, source_start])
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, _PIECES.values(), strict=True)], list(_PIECES))


def _pieces_to_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document, a list of structs, as spans."""
    for batch in batches:
        lists = batch.column(1)
        fields = lists.flatten().flatten()
        owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths()))
        out = _glued([owner, *(c.to_numpy(zero_copy_only=False) for c in fields)])
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, _PIECES.values(), strict=True)], list(_PIECES))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_TOLD = {"source": pa.int64(), "source_row": pa.int32(), "source_start": pa.int32(), "n": pa.int32(), "digest": pa.binary()}


def _told(k: int):
    """What the words of a source are at the places that are asked for."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, asked, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                mine = [a for a in asked if a["source_row"] == row]
                words = text.as_py().encode().split() if mine else []
                out += [(i, row, a["source_start"], a["n"], _digest(words[a["source_start"] : a["source_start"] + a["n"] + k - 1])) for a in mine]
            yield record_batch(out, _TOLD)

    return found


_KEPT = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "n_spans": pa.int64(), "kept_text": pa.string()}


def _removed(k: int, with_text: bool):
    types = {c: t for c, t in _KEPT.items() if with_text or c != "kept_text"}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, spans_of_id, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                n, removed, spans = len(words), 0, 0
                if spans_of_id.is_valid:
                    mark = np.zeros(n + 1, np.int32)
                    for x in spans_of_id.as_py():
                        a, b = x["start"], x["start"] + x["n"] + k - 1
                        if x["row"] == row and _digest(words[a:b]) == x["digest"]:
                            mark[a] += 1
                            mark[b] -= 1
                    gone = np.cumsum(mark[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed, spans = n - len(words), int(np.sum(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
                kept = b" ".join(words)
                row = (i, n, removed, hashlib.sha256(kept).hexdigest(), spans)
                out.append((*row, kept.decode()) if with_text else row)
            yield record_batch(out, types)

    return found


#: Rows without an id get one of the largest numbers, by a hash of their texts, so that they don't meet as one group.
NAMELESS = (1 << 63) - (1 << 30)


def substring_dedup(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, n_spans and, if asked for, kept_text.

    Each word goes that is covered by a window of ``k`` words which also starts in a document with a smaller
    id (of several sources the smallest counts). Null texts have no words; a null id counts as larger than any
    other, and so do the last 2 ** 30 numbers; rows that share an id, or have none, don't remove each other's
    words, and repeated rows lose the same. Very long texts are worked on whole, one at a time. An empty table
    gives no rows; other columns, whatever their names, are not looked at. Minimisers of more than ``hot`` texts
    are dealt into shares.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    named = F.coalesce(docs[id_col].cast("long"), F.lit(NAMELESS) + F.xxhash64(text).bitwiseAND((1 << 30) - 1))
    rows = docs.select(named.alias("id"), text.alias("text"), docs[id_col].isNull().alias("nameless"))
    # Counting combines on the map side.
    grams = rows.select("id", "text").mapInArrow(_minimisers(k), "gram long, id long")
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    shared = counted.where("n > 1").select("gram", F.when(F.col("n") > hot, F.ceil(F.col("n") / hot)).alias("shares"))
    dealt = F.when(F.col("shares").isNotNull(), F.struct("gram", "shares"))
    lists = grams.join(shared, "gram").groupBy("id").agg(F.collect_set("gram").alias("grams"), F.collect_set(dealt).alias("hot"))
    # The unused last column keeps this exchange of the texts the same as that of the last join, so that it runs once.
    told = rows.join(lists, "id").select("id", "text", "grams", "hot", F.hash("text").alias("row"), "nameless")
    paths = told.mapInArrow(_shared_paths(k), "gram long, share int, id long, row int, at int, edges array<long>")
    # The paths of one share of a minimiser meet in one task, which sorts them on disk if it has to.
    edges = paths.repartition("gram", "share").select("gram", "share", "id", "row", "at", F.posexplode("edges").alias("step", "edge"))
    places = edges.withColumn("pos", F.col("at") + F.col("step")).withColumn("here", F.struct("id", "row", "pos"))
    beside = Window.partitionBy("gram", "share", "edge")
    # ``dealt`` is asked of the window, so that both uses read the same exchange.
    met = places.withColumn("source", F.min("here").over(beside)).withColumn("dealt", F.max("share").over(beside) >= 0)
    removable = (F.col("source.id") < F.col("id")) & (F.col("source.id") < NAMELESS)
    coordinates = ("id", "row", "pos", "source.id", "source.row", "source.pos")
    first = met.where(removable).select(*coordinates)
    # The rest of a dealt edge is one document a share, and rows without an id where a share has nothing else.
    rest = met.where(F.col("dealt") & ~removable).withColumn("source", F.min("here").over(Window.partitionBy("gram", "edge")))
    pieces = first.unionAll(rest.where(removable).select(*coordinates)).toDF(*(f"c{j}" for j in range(6))).mapInArrow(_edges_to_pieces, PIECE)
    # Rows that share an id are told apart by a hash of their texts.
    spans = pieces.groupBy("id").agg(F.collect_list(F.struct("row", "start", "n", "source", "source_row", "source_start")).alias("pieces")).mapInArrow(_pieces_to_spans, PIECE)
    # Copies of one source ask for the same words; they are asked for once.
    at_source = ["source", "source_row", "source_start", "n"]
    asked = spans.select(*at_source).distinct().groupBy(F.col("source").alias("id")).agg(F.collect_list(F.struct(*at_source[1:])).alias("asked"))
    sources = rows.join(asked, "id").select("id", "text", "asked", F.hash("text").alias("row"), "nameless").mapInArrow(_told(k), "source long, source_row int, source_start int, n int, digest binary")
    verified = spans.join(sources, at_source).groupBy("id").agg(F.collect_list(F.struct("row", "start", "n", "digest")).alias("spans"))
    # Joined by id alone, the texts are not shuffled again.
    kept = rows.join(verified, "id", "left").select(F.when(~F.col("nameless"), F.col("id")).alias("id"), "text", "spans", F.hash("text").alias("row"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + (", kept_text string" if with_text else "")
    return kept.mapInArrow(_removed(k, with_text), schema).withColumnRenamed("id", id_col)

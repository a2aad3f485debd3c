"""Removal of repeated byte strings with suffix arrays.

Sorting every suffix of a corpus together does not shard. Here the corpus is sharded by content first: each
``width``-byte window has a minimiser, the least hash of the grams in it, and equal windows have equal ones.

1. Minimisers are counted; windows whose minimiser is found once are unique.
2. For each other minimiser the bytes of the consecutive windows that have it, a piece of some hundred bytes,
   go to the shard of that minimiser; equal pieces are counted and sent once from each batch.
3. Each shard sorts the suffixes of its distinct pieces by induced sorting and takes the permuted common
   prefixes: a window starts elsewhere too if its prefix with a neighbour is long enough.
4. The pieces of a minimiser of many are cut first, so that a cut's windows have the minimiser at about the same
   place. The bytes that all of a cut's windows have then name a smaller shard; equal windows are cut alike.
   Only a shard that is still crowded, as its cuts differ at their ends alone, is dealt into parts by a hash of
   the cut. Each part is sorted like a shard and also names the distinct windows of its cuts, ``CUT`` or few
   more each, by a 128-bit hash; what is named by two parts repeats as well.
5. The spans that repeat are joined to the pieces' uses, which may be skewed, and so to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.common import record_batch
from molquarry.llm.rolling import _power_tables, mixed, slices, sliding_min
from molquarry.llm.suffixes import repeated

#: Bytes of the grams that minimisers are taken from; bytes whose suffixes are sorted together, unless one shard has more.
GRAM, SHARD = 32, 1 << 20
#: Pieces of one minimiser that are sorted together uncut, and cuts that a part takes on average; places of a minimiser in one cut.
HOT, CUT = 4096, 24
#: Rows of marks that a task holds before it hands them on.
ROWS = 20_000
_U = np.uint64


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside a text: minimiser, start in the bytes, index of the text; and the hashes of all grams."""
    gram = min(GRAM, width)
    n = len(data) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:-1], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    least = sliding_min(grams, width - gram + 1).view(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(text[:n] == text[width - 1 :])
    return least[start], start, text[start], grams.view(np.int64)


def _pieces(least: np.ndarray, start: np.ndarray, text: np.ndarray, *cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of consecutive windows of one text with one minimiser, and with the same values of ``cut``."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    for x in cut:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(least)) - 1


def _minimisers(width: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in slices(batch.column(1)):
                least, start, text, grams = _windows(data, offsets, width)
                first, last = _pieces(least, start, text)
                value, span = least[first], width - min(GRAM, width) + 1
                # Twice in one piece: a text that repeats itself at a short distance.
                times = [np.count_nonzero(grams[p:q] == v) for p, q, v in zip(start[first].tolist(), (start[last] + span).tolist(), value, strict=True)]
                yield pa.record_batch([pa.array(value), pa.array(ids[a + text[first]]), pa.array(np.array(times, np.int64))], ["gram", "id", "times"])

    return found


def _anchors(least: np.ndarray, start: np.ndarray, text: np.ndarray, grams: np.ndarray, hot: np.ndarray, span: int) -> np.ndarray:
    """Where each window, of ``span`` grams, of a hot minimiser has it first; -1 for the others."""
    at, own = np.full(len(least), -1), np.flatnonzero(np.isin(least, hot))
    if len(own):
        least, start = least[own], start[own]
        found = []
        for p, q in zip(*_pieces(least, start, text[own]), strict=True):
            places = np.arange(start[p], start[q] + span)
            places = places[grams[places] == least[p]]
            found.append(places[np.searchsorted(places, start[p : q + 1])])
        at[own] = np.concatenate(found)
    return at


_PIECES = {"gram": pa.int64(), "shard": pa.int64(), "key": pa.binary(), "n": pa.int64(), "piece": pa.binary()}
_USES = {"key": pa.binary(), "id": pa.int64(), "row": pa.int32(), "start": pa.int64()}


def _shared_pieces(width: int, uses: bool, cuts: bool = False):
    """The pieces whose minimiser is shared, cut where it is hot: where each is used, or the distinct ones of a batch with their number.

    ``cuts`` leaves out the whole ones, and the bytes of the others.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, shared, hot, rows = batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist()
            distinct: dict[bytes, list] = {}
            for a, b, data, offsets in slices(texts):
                least, start, text, grams = _windows(data, offsets, width)
                keep = np.zeros(len(least), bool)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    s = slice(bounds[i], bounds[i + 1])
                    keep[s] = np.isin(least[s], shared[a + i].values.to_numpy(zero_copy_only=False))
                least, start, text = least[keep], start[keep], text[keep]
                own = hot.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                if cuts:
                    keep = np.isin(least, own)
                    least, start, text = least[keep], start[keep], text[keep]
                at = _anchors(least, start, text, grams, own, width - min(GRAM, width) + 1)
                part = np.where(at >= 0, (at - start) // CUT, -1)
                first, last = _pieces(least, start, text, at, part)
                raw, out, runs = data.tobytes(), [], []
                for g, p, q, t, x, k in zip(*(c.tolist() for c in (least[first], start[first], start[last], text[first], at[first], part[first])), strict=True):
                    shard = None
                    if k >= 0:
                        # What all windows with the minimiser at a place of this cut have; in a text that repeats itself the next ones may have it too.
                        low, high = k * CUT, min(k * CUT + CUT - 1, width - min(GRAM, width))
                        core = hashlib.blake2b(raw[x - low : x - high + width], digest_size=8, salt=k.to_bytes(4)).digest()
                        shard = int.from_bytes(core, signed=True)
                        if runs and runs[-1][:2] == [g, shard] and runs[-1][3:] == [p - 1, t]:
                            runs[-1][3] = q
                            continue
                    runs.append([g, shard, p, q, t])
                for g, shard, p, q, t in runs:
                    piece = raw[p : q + width]
                    key = hashlib.blake2b(piece, digest_size=16).digest()
                    if uses:
                        out.append((key, ids[a + t], rows[a + t], p - int(offsets[t])))
                    else:
                        distinct.setdefault(key, [g, shard, key, 0, None if cuts else piece])[3] += 1
                if uses:
                    yield record_batch(out, _USES)
            if not uses:
                yield record_batch([tuple(x) for x in distinct.values()], _PIECES)

    return found


_MARKS = {"key": pa.binary(), "a": pa.int64(), "b": pa.int64(), "window": pa.binary()}


def _sorted_shards(width: int):
    def marks(pieces: dict[bytes, bytes], count: dict[bytes, int], dealt: set[bytes]) -> Iterator[pa.RecordBatch]:
        """Spans of each piece that repeat, and the distinct windows of dealt cuts; a piece found twice repeats as a whole."""
        out = [(k, 0, len(x), None) for k, x in pieces.items() if count[k] > 1]
        named: set[bytes] = set()
        for (k, x), found in zip(pieces.items(), repeated(list(pieces.values()), width), strict=True):
            if count[k] == 1:
                mark = np.concatenate([[False], found, [False]])
                first, last = np.flatnonzero(~mark[:-1] & mark[1:]), np.flatnonzero(mark[:-1] & ~mark[1:])
                out += [(k, p, q - 1 + width, None) for p, q in zip(first.tolist(), last.tolist(), strict=True)]
            for p in range(len(x) - width + 1) if k in dealt else ():
                window = hashlib.blake2b(x[p : p + width], digest_size=16).digest()
                # Only a window that starts elsewhere in these pieces can have been named before.
                if found[p]:
                    if window in named:
                        continue
                    named.add(window)
                out.append((k, p, p + width, window))
            if len(out) > ROWS:
                yield record_batch(out, _MARKS)
                out = []
        yield record_batch(out, _MARKS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[bytes, bytes] = {}
        count: dict[bytes, int] = {}
        dealt: set[bytes] = set()
        size, now = 0, None
        for batch in batches:
            for gram, shard, part, key, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gram, shard, part) != now:
                    if size >= SHARD:
                        yield from marks(pieces, count, dealt)
                        pieces, count, dealt, size = {}, {}, set(), 0
                    now = gram, shard, part
                if key not in pieces:
                    pieces[key] = piece
                    size += len(piece)
                    if part is not None:
                        dealt.add(key)
                count[key] = count.get(key, 0) + n
        if pieces:
            yield from marks(pieces, count, dealt)

    return found


_KEPT = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _removed(with_bytes: bool):
    types = {c: t for c, t in _KEPT.items() if with_bytes or c != "kept"}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, spans, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, parts, at, runs = text.encode(), [], 0, []
                for s in sorted((s["a"], s["b"]) for s in spans or () if s["row"] == own):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], s[1]))
                    else:
                        runs.append(s)
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                row = (i, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_bytes else row)
            yield record_batch(out, types)

    return found


def suffix_dedup(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept.

    Each byte of the UTF-8 text goes that is covered by a ``width``-byte string which also starts anywhere
    else, in any document or the same one; matches stay inside documents. Null texts are empty; very long texts
    are worked on whole, one at a time. Rows that share an id, or have none, are told apart by their texts;
    repeated rows are strings that start elsewhere, so their long texts go. Among equal strings there is no
    first, and so no tie. An empty table gives no rows; other columns, whatever their names, are not looked at.
    Pieces of minimisers that have more than ``hot`` are cut; shards of more than ``hot`` cuts are dealt into parts.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    # Rows without an id go by a hash of their texts, so that they don't meet as one group.
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.xxhash64(text)).alias("id"), text.alias("text"), docs[id_col].isNull().alias("nameless"))
    grams = rows.select("id", "text").mapInArrow(_minimisers(width), "gram long, id long, times long")
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times")).where("n > 1 or times > 1")
    shared = counted.select("gram", F.when(F.col("n") > hot, F.col("gram")).alias("hot"))
    lists = grams.select("gram", "id").join(shared, "gram").groupBy("id").agg(F.collect_set("gram").alias("grams"), F.collect_set("hot").alias("hot"))
    # The unused last column keeps this exchange of the texts the same as that of the last join, so that it runs once.
    shared_rows = rows.join(lists, "id").select("id", "text", "grams", "hot", F.hash("text").alias("row"), "nameless")
    # Only distinct pieces of each batch go to the shards; a passage that many documents share is combined before the shuffle.
    schema = "gram long, shard long, key binary, n long, piece binary"
    pieces = shared_rows.mapInArrow(_shared_pieces(width, False), schema)
    # The crowded shards are broadcast: one for so many cuts at least.
    cuts = shared_rows.where(F.size("hot") > 0).mapInArrow(_shared_pieces(width, False, True), schema).select("gram", "shard", "key").distinct()
    crowded = cuts.groupBy("gram", "shard").agg(F.ceil(F.count(F.lit(1)) / hot).alias("parts")).where("parts > 1")
    dealt = pieces.join(F.broadcast(crowded), ["gram", "shard"], "left").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    together = dealt.select("gram", "shard", "part", "key", "n", "piece")
    shards = together.repartition("gram", "shard", "part").sortWithinPartitions("gram", "shard", "part")
    told = shards.mapInArrow(_sorted_shards(width), "key binary, a long, b long, window binary")
    # Spans stay, and so do windows that several parts name, at most one row for each part; a single pass, as two would sort the shards twice.
    named = F.count("window").over(Window.partitionBy(F.coalesce("window", "key")))
    met = told.withColumn("n", named).where("window is null or n > 1").withColumn("span", F.when(F.col("window").isNull(), F.col("a")))
    # Consecutive windows of a piece become one span.
    place = F.row_number().over(Window.partitionBy("key", F.col("window").isNull()).orderBy("a"))
    runs = met.withColumn("run", F.when(F.col("window").isNotNull(), F.col("a") - place))
    marks = runs.groupBy("key", "span", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("key", "a", "b")
    uses = shared_rows.mapInArrow(_shared_pieces(width, True), "key binary, id long, row int, start long")
    spans = uses.join(marks, "key").select("id", "row", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    gone = spans.groupBy("id").agg(F.collect_list(F.struct("row", "a", "b")).alias("spans"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    named = F.when(~F.col("nameless"), F.col("id")).alias("id")
    done = rows.join(gone, "id", "left").select(named, "text", "spans", F.hash("text").alias("row"))
    return done.mapInArrow(_removed(with_bytes), schema).withColumnRenamed("id", id_col)

"""Near-duplicate detection by b-bit MinHash.

1. Each document's set of word shingles is sketched: a digest of the whole set, and the minima of many hash
   functions in bands. For those that meet another, the low bits of all minima are packed into a signature.
2. Rows with equal sets are one class, a node; only its first row, by id and then by a hash of the text, goes
   on. Rows are known by a number of their own, so ids may be null or repeated.
3. Nodes that share a band meet in its bucket. Two sets as similar as the limit meet nowhere with a chance of
   about ``MISS``. Each node goes to one star, that of the least first node over its buckets, and is checked
   against that node and against the star's other members, in blocks of bounded bytes.
4. What is confirmed is closed: components of links. Large stars whose members still have several labels are
   dealt into other blocks once more.
5. Of the buckets, those remain whose members have several labels and didn't all meet in one block. There a
   node is looked at if the collision-corrected estimate, from the signatures' bit counts, lets it be similar
   to one with another label. Nodes of a bucket's largest label meet only those of other labels, so a bucket
   with few others costs about its size.
6. Every link is confirmed on the full sets. Pairs that are connected already are left alone, and no pairs are
   put out. Components of all confirmed links are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import durable, record_batch
from molquarry.llm.components import components
from molquarry.llm.rolling import mixed, slices, windows, words_of

#: Minima in a band; low bits kept of each minimum.
ROWS, BITS = 6, 2
#: Members and bytes of shingle hashes of a block, on average at most.
BLOCK, BYTES = 256, 32 << 20
#: The chance that two sets just as similar as the limit share no band, and how many standard deviations
#: below the limit an estimate may be for the pair to be confirmed on the sets.
MISS, SLACK = 1e-6, 6.0
_U = np.uint64


def bands_for(percent: int) -> int:
    """Bands of ROWS minima that leave a chance of MISS at the limit."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one, of all its words."""
    hashes, text = words_of(data, offsets, lower=True)
    n = len(offsets) - 1
    bounds = np.searchsorted(text, np.arange(n + 1))
    whole = windows(hashes, width, 11)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        else:
            sets.append(windows(hashes[a:b], b - a, 100 + b - a) if b > a else hashes[:0])
    return sets


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The minima of n hash functions over each set, none of them empty."""
    joined = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    spread = joined ^ (joined >> _U(29))
    return np.stack([np.minimum.reduceat(spread * f, first) for f in _factors(n)], axis=1)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of every minimum (after mixing), packed into 64-bit words, one row per set."""
    low = mixed(least) & _U((1 << BITS) - 1)
    per = 64 // BITS
    n = -(-low.shape[1] // per) * per
    padded = np.zeros((len(low), n), _U)
    padded[:, : low.shape[1]] = low
    shifts = np.arange(per, dtype=_U) * _U(BITS)
    return np.bitwise_or.reduce(padded.reshape(len(low), n // per, per) << shifts, axis=2)


def estimates(one: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Similarity of one signature to many: the share of equal minima by bit counts, less what agrees by chance."""
    differ = one ^ many
    any_bit = differ
    for k in range(1, BITS):
        any_bit = any_bit | (differ >> _U(k))
    mask = _U(sum(1 << (BITS * k) for k in range(64 // BITS)))
    same = 1 - np.bitwise_count(any_bit & mask).sum(axis=1) / n
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def least_estimate(percent: int, n: int) -> float:
    """Estimates below this belong to pairs under the limit, but for a chance of SLACK standard deviations."""
    chance, s = 1 / (1 << BITS), percent / 100
    p = s + (1 - s) * chance
    return s - SLACK * math.sqrt(p * (1 - p) / n) / (1 - chance)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked(sets: list[np.ndarray], signatures: np.ndarray, percent: int, n: int, labels: np.ndarray) -> list[tuple[int, int]]:
    """A forest of confirmed links that, with those that ``labels`` stand for, connects all sets which links connect."""
    label, low, found = labels.copy(), least_estimate(percent, n), []
    for i in range(1, len(sets)):
        guess = estimates(signatures[i], signatures[:i], n)
        order = np.flatnonzero((guess >= low) & (label[:i] != label[i]))
        order = order[np.argsort(-guess[order], kind="stable")]
        while len(order):
            order = order[label[order] != label[i]]
            for k, j in enumerate(order[:64].tolist()):
                if alike(sets[i], sets[j], percent):
                    label[label == label[j]] = label[i]
                    found.append((j, i))
                    order = order[k + 1 :]
                    break
            else:
                order = order[64:]
    return found


def plausible(signatures: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int, n: int) -> np.ndarray:
    """Which sets may be linked to one of another label, by estimate and size."""
    keep, low = np.zeros(len(labels), bool), least_estimate(percent, n)
    for i in range(1, len(labels)):
        open_ = (labels[:i] != labels[i]) & (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i]))
        open_[open_] = estimates(signatures[i], signatures[:i][open_], n) >= low
        keep[:i] |= open_
        keep[i] |= open_.any()
    return keep


_SKETCH = "id long, hash long, n long, class binary, bands array<long>"


def _sketched(width: int, percent: int):
    bands = bands_for(percent)
    types = [("id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, data, offsets in slices(batch.column(2)):
                sets = shingle_sets(data, offsets, width)
                full = [s for s in sets if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    least = mixed(minima(full, bands * ROWS)).reshape(len(full), bands, ROWS)
                    key = np.zeros((len(full), bands), _U)
                    for k in range(ROWS):
                        key = mixed((key ^ least[:, :, k]) + salt)
                    rows = iter(key.view(np.int64).tolist())
                    keys = [next(rows) if len(s) else None for s in sets]
                columns = (ids[a:b], hashes[a:b], [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], keys)
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], [c for c, _ in types])

    return sketch


_SETS = {"node": pa.int64(), "shingles": pa.binary(), "signature": pa.binary()}


def _full_sets(width: int, percent: int):
    n = bands_for(percent) * ROWS

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for a, b, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                columns = (nodes[a:b], [s.tobytes() for s in sets], [s.tobytes() for s in packed(minima(sets, n))])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SETS.values(), strict=True)], list(_SETS))

    return sets_of


def _confirmed(percent: int):
    n = bands_for(percent) * ROWS

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids = table["node"].to_pylist()
        sets = [np.frombuffer(s, _U) for s in table["shingles"].to_pylist()]
        signatures = np.stack([np.frombuffer(s, _U) for s in table["signature"].to_pylist()])
        found = linked(sets, signatures, percent, n, table["label"].to_numpy())
        return pa.table({"a": pa.array([ids[j] for j, _ in found], pa.int64()), "b": pa.array([ids[i] for _, i in found], pa.int64())})

    return links


def _confirm(wanted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) inside each group (one, other) of ``wanted`` (one, other, node, label)."""
    groups = wanted.join(sets, "node").groupBy("one", "other")
    return durable(groups.applyInArrow(_confirmed(percent), "a long, b long"))


def _stars(found: DataFrame) -> DataFrame:
    """Components as links (a, b) of each member to the least."""
    return found.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))


_PICKED = {"one": pa.int64(), "other": pa.int64(), "node": pa.int64(), "label": pa.int64()}


def _plausible(percent: int):
    """Of sorted cells of buckets, the nodes worth a look, under two numbers that tell one set of nodes from another."""
    n = bands_for(percent) * ROWS

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in (*batches, None):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not len(table):
                continue
            keys = [table[c].to_numpy() for c in ("band", "one", "other")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            # The last cell may go on in the next batch.
            bounds = [0, *cuts.tolist(), *([len(table)] if batch is None else [])]
            rest = table.slice(bounds[-1]) if batch is not None else None
            node, label, size = (table[c].to_numpy() for c in ("node", "label", "n"))
            signatures = np.array([np.frombuffer(s, _U) for s in table["signature"].to_pylist()])
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                keep = a + np.flatnonzero(plausible(signatures[a:b], size[a:b], label[a:b], percent, n))
                if len(keep):
                    digest = hashlib.blake2b(np.sort(node[keep]).tobytes(), digest_size=16).digest()
                    one, other = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
                    out += [(one, other, x, y) for x, y in zip(node[keep].tolist(), label[keep].tolist(), strict=True)]
            yield record_batch(out, _PICKED)

    return picked


def _blocks(members: Column, size: Column) -> Column:
    """How many blocks so many members with so many shingles take."""
    return F.greatest(F.lit(1), F.ceil(members / BLOCK), F.ceil(size * 8 / BYTES)).cast("long")


def _cells(buckets: DataFrame, labelled: DataFrame) -> DataFrame:
    """``labelled`` (band, node, label, n) rows of the buckets, each in the cells where it meets rows of other labels.

    A small bucket is one cell. A larger one is a grid: nodes of other labels than the largest are dealt into
    the rows and the first columns, nodes of the largest label into the further columns.
    """
    tallies = labelled.join(buckets, "band", "left_semi").groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("size"))
    each = tallies.groupBy("band").agg(F.max(F.struct("c", "size", "label")).alias("major"), F.sum("c").alias("c"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    grid = each.select("band", F.col("major.label").alias("major"), _blocks(F.col("c"), F.col("size")).alias("whole"), _blocks(F.col("c") - F.col("major.c"), F.col("size") - F.col("major.size")).alias("rows"), _blocks(F.col("major.c"), F.col("major.size")).alias("columns"))
    dealt = labelled.join(grid, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("major"), F.col("columns")).otherwise(F.col("rows"))))
    cell = lambda a, b: F.struct(a.alias("one"), b.alias("other"))
    rows = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)
    among = F.transform(rows, lambda i: cell(F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda j: cell(F.col("own"), F.col("rows") + j))
    below = F.transform(rows, lambda i: cell(i, F.col("rows") + F.col("own")))
    zero = F.lit(0).cast("long")
    at = F.when(F.col("whole") == 1, F.array(cell(zero, zero))).when(F.col("label") == F.col("major"), below).otherwise(F.concat(among, beside))
    return dealt.withColumn("cell", F.explode(at)).select("band", F.col("cell.one").alias("one"), F.col("cell.other").alias("other"), "node", "label", "n")


def near_dedup(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, class_id and, if asked for, text_hash.

    Rows are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles, A-Z
    taken as a-z. component_id is the smallest id that links reach, class_id the smallest with an equal set;
    kept marks one row of those that links connect: one with the smallest id, and of several the one whose
    text has the least hash.

    A text of fewer words is one shingle; texts without words, or null, have no shingles and no links. Very
    long texts are sketched whole, one at a time; a text and its set have to fit a task. A null id counts as
    larger than any other and comes back null; rows that share an id, or have none, are told apart: each has
    the links of its own text, and text_hash (xxhash64, of '' for null) says which is meant. Repeated rows are
    one node, of which one row is kept. Ties of estimates are looked at in the order of rows; they change no
    result. An empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    last = F.lit((1 << 63) - 1)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), last).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    sketches = durable(rows.mapInArrow(_sketched(width, percent), _SKETCH).withColumn("row", F.monotonically_increasing_id()))
    least = sketches.where("n > 0").groupBy("class").agg(F.min(F.struct("id", "hash", "row")).alias("least"), F.first("n").alias("n"))
    classes = durable(least.select("class", F.col("least.id").alias("class_id"), F.col("least.hash").alias("hash"), F.col("least.row").alias("node"), "n"))
    texts = classes.select("node", "n", F.col("class_id").alias("id"), "hash")

    keys = sketches.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    met = keys.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band", "first")
    meetings = durable(keys.join(met, "band").select("band", "node", "first"))

    stars = durable(meetings.groupBy("node").agg(F.min("first").alias("star")).join(texts, "node"))
    # A row that is repeated comes once; only texts that meet another are looked at again.
    met_texts = rows.join(stars.select("id", "hash", "node"), ["id", "hash"]).select("node", "text").dropDuplicates(["node"])
    sets = durable(met_texts.mapInArrow(_full_sets(width, percent), "node long, shingles binary, signature binary"))
    members = stars.where("node != star")
    sizes = durable(members.groupBy("star").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")))

    def dealt(those: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
        """The members of stars by block, and each star's own node in all of its blocks."""
        block = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks"))
        own = members.join(those, "star").select(F.col("star").alias("one"), block.alias("other"), "node")
        hubs = those.select(F.col("star").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(F.col("node").alias("one"), "other", "node")
        return _labelled(own.union(hubs), labels)

    none = sketches.sparkSession.createDataFrame([], "node long, label long")
    found = durable(components(_confirm(dealt(sizes, none, 0), sets, percent)))
    labels = found.select(F.col("id").alias("node"), F.col("component").alias("label"))
    several = _labelled(members, labels).groupBy("star").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    again = sizes.where("blocks > 1").join(several, "star", "left_semi")
    if not again.isEmpty():
        found = durable(components(_stars(found).union(_confirm(dealt(again, labels, 1), sets, percent))))
        labels = found.select(F.col("id").alias("node"), F.col("component").alias("label"))

    # A bucket is done if all of its nodes have one label, or met in one block.
    spots = members.join(sizes, "star").select("node", F.struct("star", F.pmod(F.xxhash64("node", F.lit(0)), F.col("blocks")).alias("block")).alias("spot"))
    placed = _labelled(meetings, labels).join(spots, "node", "left")
    first = F.col("node") == F.col("first")
    ends = placed.groupBy("band", "first").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.when(~first, F.col("spot"))).alias("low_spot"), F.max(F.when(~first, F.col("spot"))).alias("high_spot"),
        F.count_if(~first & F.col("spot").isNull()).alias("elsewhere"), F.max(F.when(first, F.col("spot"))).alias("first_spot"),
    )
    together = (F.col("low_spot") == F.col("high_spot")) & (F.col("elsewhere") == 0) & ((F.col("low_spot.star") == F.col("first")) | F.coalesce(F.col("first_spot") == F.col("low_spot"), F.lit(False)))
    left = durable(ends.where(F.col("low") < F.col("high")).where(~F.coalesce(together, F.lit(False))).select("band"))
    if not left.isEmpty():
        labelled = _labelled(meetings, labels).join(texts.select("node", "n"), "node")
        signed = _cells(left, labelled).join(sets.select("node", "signature"), "node")
        cells = signed.repartition("band", "one", "other").sortWithinPartitions("band", "one", "other").select("band", "one", "other", "node", "label", "n", "signature")
        picked = durable(cells.mapInArrow(_plausible(percent), "one long, other long, node long, label long").distinct())
        more = _confirm(picked, sets, percent)
        if not more.isEmpty():
            found = components(_stars(found).union(more))

    found = found.withColumnRenamed("id", "node")
    best = found.join(classes, "node").groupBy("component").agg(F.min(F.struct("class_id", "hash", "node")).alias("best"))
    chosen = found.join(best, "component").select("node", F.col("best.class_id").alias("component"), F.col("best.node").alias("stays"))
    named = sketches.select("id", "hash", F.col("n").alias("n_shingles"), "class", "row").join(classes.drop("hash", "n"), "class", "left")
    result = named.join(chosen, "node", "left")
    component, stays = F.coalesce("component", "class_id", "id"), F.coalesce("stays", "node", "row")
    real = lambda c: F.when(c != last, c)
    columns = [real(F.col("id")).alias(id_col), "n_shingles", real(component).alias("component_id"), (F.col("row") == stays).alias("kept"), real(F.coalesce("class_id", "id")).alias("class_id")]
    return result.select(*columns, *([F.col("hash").alias("text_hash")] if with_hash else []))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with their labels; a node without links is its own."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

"""URL rules and exact list membership by a Bloom filter cascade, native.

Level 1 encodes the listed keys; the other keys of the universe that pass it are its false positives, which
level 2 encodes; the listed keys that pass level 2 are encoded by level 3, and so on until a level has no
false positives. Over that universe the first level that rejects a key tells whether it is listed, so
membership needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import durable

#: Hash functions of each level: a false positive rate of about 2 ** -HASHES.
HASHES = 6
#: Words of 64 bits gathered into one row on the way to a level's single row.
BLOCK = 512
#: Rule (host, path, verdict); the longest that fits wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _position(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits))


def _level(keys: DataFrame, level: int, bits: int, parts: int) -> DataFrame:
    """A row for each part: the level's bits as an array of 64-bit words, put together block by block."""
    n = bits // 64
    at = keys.select("part", F.explode(F.array(*[_position(F.col("key"), level, k, bits) for k in range(HASHES)])).alias("p"))
    some = at.select("part", F.floor(F.col("p") / 64).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("v"))
    every = some.union(keys.sparkSession.range(parts * n).select(F.expr(f"id div {n}").alias("part"), (F.col("id") % n).alias("w"), F.lit(0).cast("long").alias("v")))
    dense = every.groupBy("part", "w").agg(F.bit_or("v").alias("v"))
    blocks = dense.groupBy("part", F.floor(F.col("w") / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("w", "v"))).alias("ws")).select("part", "b", F.col("ws.v").alias("vs"))
    return blocks.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("b", "vs"))).alias("bs")).select("part", F.flatten(F.col("bs.vs")).alias(f"words{level}"))


def _passes(key: Column, words: Column, level: int, bits: int) -> Column:
    passes = F.lit(True)
    for k in range(HASHES):
        p = _position(key, level, k, bits)
        passes &= F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
    return passes


class Cascade:
    """Exact membership of ``listed`` keys (a column ``key``) over a universe of keys.

    While all levels together take up to ``max_bits``, they are scalar subqueries of the rows' own stage and no
    row is moved. A larger cascade is dealt by a hash of the key into parts of at most about ``max_bits``, all levels of all
    parts built together, and rows are joined to their part's row of bits by a merge join on the part: sorted
    by part, a task holds the bits of one part at a time, and adaptive execution splits a part that many rows meet.
    """

    def __init__(self, universe: DataFrame, max_bits: int = 1 << 28):
        """universe: columns key (string) and listed (boolean); repeated keys are listed if any is."""
        known = durable(universe.groupBy("key").agg(F.max("listed").alias("listed")))
        sizes = known.agg(F.count_if("listed").alias("inside"), F.count_if(~F.col("listed")).alias("outside")).first()
        # A level encodes what passes the one before it, and a key passes with a chance of 2 ** -HASHES.
        expected = self._bits(sizes["inside"] + (sizes["outside"] >> HASHES)) * (1 + 2 ** (1 - HASHES))
        self.parts = 1 if not sizes["inside"] else max(1, math.ceil(expected / max_bits))
        #: One row for each part, with its words of every level.
        self.table: DataFrame | None = None
        self.bits: list[int] = []
        keys = known.withColumn("part", self._part(F.col("key")))
        inside, outside = keys.where("listed").select("part", "key"), keys.where("not listed").select("part", "key")
        while n := inside.groupBy("part").count().agg(F.max("count")).first()[0]:
            level, bits = len(self.bits) + 1, self._bits(n)
            built = durable(_level(inside, level, bits, self.parts))
            met, words = self._met(outside, built, f"words{level}")
            inside, outside = durable(met.where(_passes(F.col("key"), words, level, bits)).select("part", "key")), inside
            self.table = built if self.table is None else self.table.join(built, "part")
            self.bits.append(bits)
        if self.table is not None:
            self.table = durable(self.table)

    @staticmethod
    def _bits(n: int) -> int:
        return max(64, 64 * math.ceil(n * HASHES / math.log(2) / 64))

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.parts))

    def _met(self, rows: DataFrame, table: DataFrame, name: str) -> tuple[DataFrame, Column]:
        """Rows beside the words ``name`` of their part."""
        if self.parts == 1:
            return rows, table.select(name).scalar()
        return rows.join(table.select("part", name).hint("merge"), "part"), F.col(name)

    def marked(self, rows: DataFrame, key_col: str, name: str) -> DataFrame:
        """``rows`` with a boolean column telling whether the key is listed; null keys aren't."""
        if self.table is None:
            return rows.withColumn(name, F.lit(False))
        key = F.coalesce(F.col(key_col), F.lit(""))
        levels = [f"words{k}" for k in range(1, len(self.bits) + 1)]
        if self.parts > 1:
            whole = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.coalesce(rows[key_col], F.lit("")).alias("key"), self._part(F.coalesce(rows[key_col], F.lit(""))).alias("part"))
            beside, key = whole.join(self.table.hint("merge"), "part"), F.col("key")
            words = [F.col(c) for c in levels]
        else:
            beside, words = rows, [self.table.select(c).scalar() for c in levels]
        told = F.lit(len(levels) % 2 == 1)
        for level in range(len(levels), 0, -1):
            told = F.when(_passes(key, words[level - 1], level, self.bits[level - 1]), told).otherwise(F.lit(level % 2 == 0))
        return beside.withColumn(name, told) if self.parts == 1 else beside.select("row.*", told.alias(name))


def url_filter(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, listed.

    The verdict is that of the longest fitting rule, else block if host and path are in ``listed`` (a column
    ``key``), else allow. Of two rules of one length the later in ``rules`` wins. A null url, or one without
    ://, has an empty host and path and the key ''; very long urls are keyed whole. An empty list lists
    nothing; keys of the list that no page has don't matter. Repeated rows, and rows that share an id or have
    none, are judged each; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    parts = pages.select(pages[id_col].alias("id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    keyed = parts.withColumn("key", F.concat("host", "path"))
    corpus = keyed.select("key", F.lit(False).alias("listed"), F.lit(True).alias("here"))
    known = corpus.union(listed.select("key", F.lit(True), F.lit(False))).groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here"))
    cascade = Cascade(known.where("here").select("key", "listed"), max_bits)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    marked = cascade.marked(keyed, "key", "listed")
    return marked.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def syndicated_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list to filter by: host and path of every url that was followed from a tracked feed link."""
    tracked = pages.where(F.coalesce(pages[url_col], F.lit("")).rlike(r"[?&]utm_source="))
    return tracked.select(F.concat(url_host(F.col(url_col)), url_path(F.col(url_col))).alias("key")).distinct()

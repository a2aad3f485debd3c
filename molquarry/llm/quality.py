"""Host-level quality rules, native.

Each document is measured once with array functions. The failures of its rules are counted by host, each
host's failure rate is shrunk towards a beta prior fitted to all hosts, and the hosts' verdicts are joined
back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import durable, joined_back, words

#: Words of a window of which a second copy counts as repetition.
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(ws: str, wh: str) -> Column:
    """Words inside windows that are found twice or more: windows sorted by hash, neighbours compared in full."""
    at = lambda k: F.get("by_hash", k)
    window = lambda k: F.slice(F.col(ws), at(k)["i"] + 1, WINDOW)
    same = lambda a, b: (at(a)["h"] == at(b)["h"]) & (window(a) == window(b))
    n = F.size("by_hash")
    twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < n - 1, same(k, k + 1)).otherwise(False))
    starts = F.sort_array(F.transform(twice, lambda k: at(k)["i"]))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("before"))
    step = lambda acc, i: F.struct((acc["covered"] + F.least(F.lit(WINDOW), i - acc["before"])).alias("covered"), i.alias("before"))
    return F.aggregate(starts, start, step, lambda acc: acc["covered"])


def measures(docs: DataFrame, kept: Column, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``kept`` as id, host and the measures of every whole text, with the counts that the soft rules need."""
    w = F.col("ws")
    base = docs.select(kept.alias("id"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    split = base.withColumn("ws", words(F.col("t")))
    counted = split.select(
        "id",
        "host",
        "ws",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"[A-Z]")).alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("hs"),
    )
    last = F.size("hs") - WINDOW
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hs", i + k) for k in range(WINDOW)])))
    windows = counted.select("id", "host", *MEASURES[:3], "n_upper", "ws", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("wh"))
    any_twice = F.size(F.array_distinct("wh")) < F.size("wh")
    by_hash = F.when(any_twice, F.sort_array(F.transform("wh", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = windows.select("id", "host", *MEASURES[:4], "n_upper", "n_lines", "ws", by_hash.alias("by_hash"))
    covered = F.when(F.col("by_hash").isNotNull(), _repeated("ws", "wh")).otherwise(0)
    return sorted_.select("id", "host", *MEASURES[:4], covered.cast("long").alias("n_repeat_words"), "n_upper", "n_lines")


def _failures() -> tuple[Column, Column]:
    """Whether a measured document fails the base rules, and whether it fails any rule."""
    n, chars = F.col("n_words"), F.col("word_chars")
    base = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    soft = (10 * F.col("n_symbols") > n) | ((F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))) | (chars < 2 * n) | (chars > 15 * n) | (2 * F.col("n_upper") > chars)
    return base, base | soft


def host_verdicts(judged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, host_rate and host_ok from judged documents (host, failed): their failure rates, shrunk.

    The prior has the mean rate of all documents, and its strength is what the hosts' rates vary by beyond the
    noise of their sizes (moments of the beta-binomial, hosts weighed by size). Hosts that don't vary beyond
    that are all taken to have the mean rate, as far as the documents of one host can tell.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("failed").alias("host_failed"))
    n, f = F.col("host_docs"), F.col("host_failed")
    sums = hosts.agg(F.sum(n).alias("docs"), F.sum(f).alias("fails"), F.sum(n * n).alias("squares"), F.sum(f * f / n).alias("spread"), F.count(F.lit(1)).alias("hosts"))
    mean = F.col("fails") / F.col("docs")
    noise = mean * (1 - mean)
    between = (F.col("spread") - F.col("docs") * mean * mean - (F.col("hosts") - 1) * noise) / (F.col("docs") - F.col("squares") / F.col("docs"))
    strength = F.when((F.col("hosts") >= 2) & (between > 0), F.greatest(noise / between - 1, F.lit(0.01))).when(F.col("hosts") >= 2, F.col("docs")).otherwise(2.0)
    # One row, read as two scalars.
    prior = sums.select(F.greatest(mean * strength, F.lit(1e-9)).alias("alpha"), F.greatest((1 - mean) * strength, F.lit(1e-9)).alias("beta"))
    alpha, beta = F.coalesce(prior.select("alpha").scalar(), F.lit(1.0)), F.coalesce(prior.select("beta").scalar(), F.lit(1.0))
    shrunk = hosts.select("host", ((f + alpha) / (n + alpha + beta)).alias("host_rate"))
    return durable(shrunk.withColumn("host_ok", F.col("host_rate") <= max_rate))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the measures, base_failed, kept, and what the verdict rests on.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. Soft rules: symbols
    over 10 % of the words, three or more repeated lines that are over 30 % of the lines, mean word length outside 2 to 15, capitals
    over half of the word characters. A document is kept if it fails no rule and its host's shrunk failure
    rate is at most ``max_rate``.

    Null texts are empty and so fail; null hosts count as the host ''. Very long texts are measured whole; the
    words of one have to fit a task. Repeated rows, and rows that share an id or have none, are judged each;
    an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    base, failed = _failures()
    judged = durable(measures(docs, docs[id_col], text_col, host_col).select("id", "host", *MEASURES, base.alias("base_failed"), failed.alias("failed")))
    verdicts = host_verdicts(judged, max_rate)
    return joined_back(judged, verdicts, ["host"], "left").select(F.col("id").alias(id_col), *MEASURES, "base_failed", (~F.col("failed") & F.col("host_ok")).alias("kept"), "host", "host_rate", "host_ok")


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, whole, with all of their columns.

    The texts are measured once; rows that fail no rule are written with their host, and those of good hosts
    are read again. Handles what quality_rules handles.
    """
    _, failed = _failures()
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("whole")
    measured = measures(docs, whole, text_col, host_col).select("id", "host", failed.alias("failed"))
    # The verdicts need all rows, but only rows that may stay are written with their columns.
    judged = durable(measured.select("host", "failed", F.when(~F.col("failed"), F.col("id")).alias("row")))
    verdicts = host_verdicts(judged, max_rate)
    return joined_back(judged.where(~F.col("failed")).select("row", "host"), verdicts.where("host_ok"), ["host"], "left_semi").select("row.*")

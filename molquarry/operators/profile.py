"""Column profiles: count, variance, and correlation with a reference column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, reference: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: column_name, n, variance, zero_variance, correlation, pairwise_correlation.

    A value counts if the whole field reads as a number. variance is the population variance, null for fewer
    than two values; correlation takes each column's mean over its own values and n as the smaller of the two
    counts, pairwise_correlation only rows that have both. Ordered by |correlation| and name with a
    reference, else varying columns first, by name.

    One pass: all sums are partial aggregates of one row per task.
    """
    names = list(df.columns if columns is None else columns)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)") if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`").cast("double")
    ref = number(reference) if reference else F.lit(None).cast("double")
    aggs: list[Column] = []
    for k, c in enumerate(names):
        x = number(c)
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.sum(x * ref).alias("sxy"), F.corr(x, ref).alias("pairwise")).alias(f"c{k}"))
    own = [F.count(ref).alias("rn"), F.avg(ref).alias("rmean"), F.var_pop(ref).alias("rvar")]
    wide = df.agg(*aggs, *own)
    rows = wide.select("rn", "rmean", "rvar", F.explode(F.array(*[f"c{k}" for k in range(len(names))])).alias("c")).select("rn", "rmean", "rvar", "c.*")
    variance = F.when(F.col("n") > 1, F.col("var"))
    known = (F.col("n") > 1) & (F.col("rn") > 1) & (F.col("var") > 0) & (F.col("rvar") > 0)
    correlation = F.when(known, (F.col("sxy") / F.least("n", "rn") - F.col("mean") * F.col("rmean")) / F.sqrt(F.col("var") * F.col("rvar")))
    out = rows.select("column_name", "n", variance.alias("variance"), (F.abs(variance) < 1e-10).alias("zero_variance"), correlation.alias("correlation"), F.when(known, F.col("pairwise")).alias("pairwise_correlation"))
    return out.orderBy(F.abs("correlation").desc_nulls_last(), "column_name") if reference else out.orderBy(F.coalesce(~F.col("zero_variance"), F.lit(False)).desc(), "column_name")


def profile_summary(profiled: DataFrame) -> DataFrame:
    """Counts of strong, moderate and weak correlations, and of columns without variance or data."""
    c = F.abs("correlation")
    return profiled.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(c > 0.7).alias("strong"),
        F.count_if((c > 0.3) & (c <= 0.7)).alias("moderate"),
        F.count_if(c <= 0.3).alias("weak"),
        F.count_if("zero_variance").alias("zero_variance"),
        F.count_if(F.col("variance").isNull()).alias("no_data"),
    )


def profile_by(df: DataFrame, by: Sequence[str], columns: Sequence[str], reference: str | None = None, how: str = "cube") -> DataFrame:
    """A profile for every group of ``by`` and for subtotals: the group columns, grouping_id, column_name, n, mean, variance, correlation.

    ``how`` is cube (all subsets of ``by``), rollup (its prefixes) or groups (no subtotals); a column that a
    subtotal runs over is null there, and grouping_id tells that from a null group. variance is that of the
    population, correlation that with ``reference`` over rows that have both; null where it is not defined.

    Rows are aggregated once, to counts, means and centred sums of the finest groups; subtotals are merged from
    these few rows, so the table is not multiplied by the number of subtotals.
    """
    kinds = dict(df.dtypes)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)") if kinds[c] == "string" else F.col(f"`{c}`").cast("double")
    ref = number(reference) if reference else F.lit(None).cast("double")
    keys = [df[c].alias(f"__g{k}") for k, c in enumerate(by)]
    names = [f"__g{k}" for k in range(len(by))]

    def sums(c: str) -> Column:
        x = number(c)
        both = x.isNotNull() & ref.isNotNull()
        px, py = F.when(both, x), F.when(both, ref)
        parts = {"column_name": F.lit(c), "n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "pairs": F.count_if(both), "mx": F.avg(px), "my": F.avg(py), "xx": F.var_pop(px) * F.count_if(both), "yy": F.var_pop(py) * F.count_if(both), "xy": F.covar_pop(px, py) * F.count_if(both)}
        return F.struct(*[v.alias(n) for n, v in parts.items()])

    fine = df.groupBy(*keys).agg(*[sums(c).alias(f"c{k}") for k, c in enumerate(columns)])
    rows = fine.select(*names, F.explode(F.array(*[f"c{k}" for k in range(len(columns))])).alias("c")).select(*names, "c.*")
    # The column name is a key of every grouping set.
    subsets = [[k for k in range(len(by)) if not mask >> (len(by) - 1 - k) & 1] for mask in range(1 << len(by))]
    if how == "rollup":
        subsets = [list(range(k)) for k in range(len(by), -1, -1)]
    elif how == "groups":
        subsets = [list(range(len(by)))]
    elif how != "cube":
        raise ValueError(f"unknown kind of subtotals {how!r}")
    sets = [[*(names[k] for k in s), "column_name"] for s in subsets]
    n, pairs = F.sum("n"), F.sum("pairs")
    mean, mx, my = (F.sum(F.col(m) * F.col(c)) / F.nullif(F.sum(c), F.lit(0)) for m, c in (("mean", "n"), ("mx", "pairs"), ("my", "pairs")))
    # Groups' means are taken about one of them, so that large values don't cancel.
    spread = lambda m2, a, b, c: F.sum(m2) + F.sum(F.col(c) * F.col(a) * F.col(b)) - F.sum(F.col(c) * F.col(a)) * F.sum(F.col(c) * F.col(b)) / F.nullif(F.sum(c), F.lit(0))
    centre = rows.groupBy("column_name").agg(F.avg("mean").alias("o"), F.avg("mx").alias("ox"), F.avg("my").alias("oy"))
    near = rows.join(F.broadcast(centre), "column_name").withColumns({"d": F.col("mean") - F.col("o"), "dx": F.col("mx") - F.col("ox"), "dy": F.col("my") - F.col("oy")})
    merged = near.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*names, "column_name")]).agg(
        F.grouping_id().alias("gid"), n.alias("n"), mean.alias("mean"), spread("m2", "d", "d", "n").alias("m2"), pairs.alias("pairs"), spread("xx", "dx", "dx", "pairs").alias("xx"), spread("yy", "dy", "dy", "pairs").alias("yy"), spread("xy", "dx", "dy", "pairs").alias("xy")
    )
    variance = F.when(F.col("n") > 1, F.col("m2") / F.col("n"))
    correlation = F.when((F.col("pairs") > 1) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return merged.select(*[F.col(g).alias(c) for g, c in zip(names, by, strict=True)], F.expr("gid div 2").cast("int").alias("grouping_id"), "column_name", "n", "mean", variance.alias("variance"), correlation.alias("correlation"))


#: Distinct values are told within about 1.04 / sqrt(2 ** LOG_BUCKETS), ranks within about 2.3 / SAMPLES ** 0.9.
LOG_BUCKETS, SAMPLES = 14, 800


def sketch(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``by`` and column: the group, column_name, n, distinct (a HyperLogLog sketch), quantiles (a KLL sketch).

    The sketches are bytes that can be stored, a partition or a day at a time, and merged later by
    ``merged_sketches`` without the rows. n counts values that are not null; numbers only have quantiles.
    """
    kinds = dict(df.dtypes)
    aggs = []
    for k, c in enumerate(columns):
        x = F.col(f"`{c}`")
        numeric = kinds[c] not in ("string", "timestamp", "date", "boolean")
        quantiles = F.kll_sketch_agg_double(x.cast("double"), F.lit(SAMPLES)) if numeric else F.lit(None).cast("binary")
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.hll_sketch_agg(x.cast("string"), F.lit(LOG_BUCKETS)).alias("distinct"), quantiles.alias("quantiles")).alias(f"c{k}"))
    keys = [f"__g{k}" for k in range(len(by))]
    wide = df.groupBy(*[df[c].alias(g) for g, c in zip(keys, by, strict=True)]).agg(*aggs)
    rows = wide.select(*keys, F.explode(F.array(*[f"c{k}" for k in range(len(columns))])).alias("c"))
    return rows.select(*[F.col(g).alias(c) for g, c in zip(keys, by, strict=True)], "c.*")


def merged_sketches(sketches: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per group of ``by`` and column of some ``sketch`` rows: column_name, n, distinct and the quantiles q25, q50, ... (null for text)."""
    merged = sketches.groupBy(*by, "column_name").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("__q"))
    some = F.coalesce(F.kll_sketch_get_n_double("__q"), F.lit(0)) > 0
    told = [F.when(some, F.kll_sketch_get_quantile_double("__q", F.lit(float(q)))).alias(f"q{round(q * 100)}") for q in quantiles]
    return merged.select(*by, "column_name", "n", "distinct", *told)

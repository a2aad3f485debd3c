"""The registered queries of the reference operators and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from molquarry import catalog, molecule_queries
from molquarry.byte_sql import DOCUMENTED as byte_documented
from molquarry.byte_sql import KERNELS as byte_kernels
from molquarry.byte_sql import byte_sql, similarity_sql
from molquarry.functions import bits, strings
from molquarry.functions.acidity import ACIDITY
from molquarry.functions.electronegativity import ELECTRONEGATIVITY
from molquarry.functions.family import Family
from molquarry.functions.tokens import PLANE_STATISTICS, TOKEN_CLOSED, plane_statistics
from molquarry.molecule_queries import DIGITS, MOLECULE_SQL, by_text, dealt, molecule_table, rounded, rounded_sql, spread
from molquarry.operators.profile import merged_sketches, profile, profile_by, profile_summary, sketch
from molquarry.plane_sql import plane_sql
from molquarry.sources.csv_ranges import read_csv_ranges
from molquarry.streaming.streams import late_table, session_profile, windowed_profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(molecule_queries.QUERIES)
ORACLES: dict[str, str] = dict(molecule_queries.ORACLES)


def text_query(family: Family, name: str, table: str, key: str, text: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, F.col(text).alias("__text")))
        return rounded(family.add_to(rows, F.col("__text")).drop("__text"), family.names())

    QUERIES[name], ORACLES[name] = query, rounded_sql(family.sql(table, [key], text), [key], family.names())


def part_texts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(text).alias("__text")))


def molecule_text_query(family: Family) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_text(molecule_table(spark, sf_dir), "smiles", lambda t: rounded(family.add_to(t, F.col("smiles")), family.names())).drop("smiles")

    QUERIES[f"{family.name}_molecules"], ORACLES[f"{family.name}_molecules"] = query, rounded_sql(family.sql(MOLECULE_SQL, ["mol_id"], "smiles"), ["mol_id"], family.names())


for _family in (strings.STRING_COUNTS, strings.STRING_PATTERNS, strings.STRING_RATIOS, strings.CHAR_FRACTIONS, strings.PATTERN_SHARES, strings.STRING_DOCUMENTED, ELECTRONEGATIVITY, ACIDITY):
    text_query(_family, _family.name, "documents", "doc_id", "text")
    molecule_text_query(_family)
QUERIES["token_closed_part"] = lambda spark, sf_dir: by_text(part_texts(spark, sf_dir, "p_type"), "__text", lambda t: rounded(TOKEN_CLOSED.add_to(t, F.col("__text")), TOKEN_CLOSED.names())).drop("__text")
ORACLES["token_closed_part"] = rounded_sql(TOKEN_CLOSED.sql("part", ["p_partkey"], "p_type"), ["p_partkey"], TOKEN_CLOSED.names())
molecule_text_query(TOKEN_CLOSED)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def token_planes_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_text(part_texts(spark, sf_dir, "p_type"), "__text", lambda t: rounded(plane_statistics(t, F.col("__text")), tuple(PLANE_STATISTICS))).drop("__text")


ORACLES["token_planes_part"] = rounded_sql(plane_sql("part", "p_partkey", "p_type"), ["p_partkey"], tuple(PLANE_STATISTICS))


@query
def token_planes_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_text(molecule_table(spark, sf_dir), "smiles", lambda t: rounded(plane_statistics(t, F.col("smiles")), tuple(PLANE_STATISTICS))).drop("smiles")


ORACLES["token_planes_molecules"] = rounded_sql(plane_sql(MOLECULE_SQL, "mol_id", "smiles"), ["mol_id"], tuple(PLANE_STATISTICS))


@query
def token_planes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts of up to 20,000 words; too many cells for SQL."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("__text")))
    return plane_statistics(rows, F.col("__text")).drop("__text")


@query
def string_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_text(molecule_table(spark, sf_dir), "smiles", lambda t: rounded(strings.add_scans(t, F.col("smiles")), tuple(strings.SCANS))).drop("smiles")


@query
def string_scans_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("__text")))
    return rounded(strings.add_scans(rows, F.col("__text")).drop("__text"), tuple(strings.SCANS))


def _scan_sql(table: str, key: str, text: str) -> str:
    """Characters as rows with the branch depth after them; a carbon before a branch counts if three branches open right above its depth behind it."""
    sql = f"""WITH t AS (SELECT {key} AS k, regexp_extract_all(coalesce({text}, ''), '(?s:.)') AS cs FROM {table}), c AS (SELECT k, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS ch FROM t),
        d AS MATERIALIZED (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth, lead(ch) OVER w AS after FROM c WINDOW w AS (PARTITION BY k ORDER BY pos)),
        closing AS (SELECT k, max(pos) AS last FROM d WHERE ch = ')' GROUP BY k), forks AS (SELECT d.k, pos, depth FROM d JOIN closing USING (k) WHERE ch = 'C' AND after = '(' AND last >= pos),
        three AS (SELECT f.k, f.pos FROM forks f JOIN d ON d.k = f.k AND d.pos > f.pos AND d.ch = '(' AND d.depth = f.depth + 1 GROUP BY ALL HAVING count(*) >= 3), counts AS (SELECT k, count(*) AS n FROM three GROUP BY k),
        outside AS (SELECT k, avg((ch <> 'C')::INT) AS share FROM d WHERE depth = 0 AND ch BETWEEN 'A' AND 'Z' AND length(ch) = 1 AND ord(ch) < 128 GROUP BY k)
        SELECT t.k AS {key}, coalesce(n, 0) AS SmilesTertiaryCarbonCount, coalesce(share, 0) AS SmilesNonCarbonBackboneRatio FROM t LEFT JOIN counts USING (k) LEFT JOIN outside USING (k)"""
    return rounded_sql(sql, [key], tuple(strings.SCANS))


ORACLES["string_scans"], ORACLES["string_scans_documents"] = _scan_sql(MOLECULE_SQL, "mol_id", "smiles"), _scan_sql("documents", "doc_id", "text")


@query
def bit_kernels_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_text(part_texts(spark, sf_dir, "p_brand"), "__text", lambda t: rounded(bits.add_bits(t, F.col("__text")), bits.NAMES)).drop("__text")


ORACLES["bit_kernels_part"] = rounded_sql(byte_sql("part", "p_partkey", "p_brand", {n: byte_kernels[n] for n in bits.NAMES}), ["p_partkey"], bits.NAMES)


#: Values of bytes and bits that SQL gives, over the list of bytes ``b`` and the list of bits ``x`` of an ASCII text.
_BYTE_SQL = {
    "AsciiSum": "list_sum(b)", "AsciiProductMod256": "list_reduce(b, lambda p, v: (p * v) % 256)", "AsciiRangeCoverage": "(list_max(b) - list_min(b) + 1) / 128", "StringLength": "len(b)", "UniqueByteCount": "len(list_distinct(b))", "CharSequenceComplexity": "len(list_distinct(b)) / len(b)",
    "FirstByteValue": "b[1]", "LastByteValue": "b[-1]", "FirstLastByteXor": "xor(b[1], b[-1])", "ByteXorReduction": "list_reduce(b, lambda p, v: xor(p, v))", "ByteXorChecksum": "list_reduce(b, lambda p, v: xor(p, v))", "ByteAndReduction": "list_reduce(b, lambda p, v: p & v)",
    "ByteOrReduction": "list_reduce(b, lambda p, v: p | v)", "ByteWiseMaximum": "list_max(b)", "ByteWiseMinimum": "list_min(b)", "ByteWiseMedian": "list_median(b)", "ByteGeometricMean": "exp(list_avg(list_transform(b, lambda v: ln(v))))", "CharPosWeightedSum": "list_sum(list_transform(b, lambda v, i: v * i))",
    "ByteEntropy": "list_entropy(b)", "CharFrequencyEntropy": "list_entropy(b)", "NonZeroByteDensity": "1.0", "CharPalindromeCheck": "(b = list_reverse(b))::INT", "BitCount": "list_sum(x)", "SwarPopcount": "list_sum(x)", "BitDensity": "list_avg(x)", "ZeroBitRatio": "1 - list_avg(x)",
    "AvgBitPopulationCount": "list_sum(x) / len(b)", "HighLowBitRatio": "list_sum(x) / (len(x) - list_sum(x))", "BitDifferenceSum": "list_sum(list_transform(f, lambda v: bit_count(v::INT)))", "SequentialXorDiff": "list_sum(f)", "EvenIndexedBitCount": "list_sum(list_transform(x, lambda v, i: v * (i % 2)))",
    "OddIndexedBitCount": "list_sum(list_transform(x, lambda v, i: v * ((i + 1) % 2)))", "OddEvenBitRatio": "list_sum(list_transform(x, lambda v, i: v * ((i + 1) % 2))) / list_sum(list_transform(x, lambda v, i: v * (i % 2)))", "NibbleEntropy": "list_entropy(nib)", "NibbleHistogramBalance": "list_entropy(nib) / 4",
    "LowHighNibbleRatio": "len(list_filter(nib, lambda v: v < 8)) / len(list_filter(nib, lambda v: v > 7))", "BitReversalDistance": "list_sum(list_transform(list_zip(x, list_reverse(x)), lambda p: (p[1] <> p[2])::INT))", "ByteReversalDistance": "list_sum(list_transform(list_zip(b, list_reverse(b)), lambda p: bit_count(xor(p[1], p[2])::INT)))",
    "BitTransitionCount": "list_sum(t)", "BitAlternationFreq": "list_avg(t)", "SingleBitPatternMatch": "list_avg(list_transform(list_zip(x[:-2], x[2:]), lambda p: (p[1] = 1 AND p[2] = 0)::INT))", "BytePairTransitions": "list_entropy(list_transform(list_zip(b[:-2], b[2:]), lambda p: p[1] * 256 + p[2]))",
    "HammingWeightVariance": "list_var_pop(list_transform(b, lambda v: bit_count(v::INT)))", "PopcountVariance": "list_var_pop(list_transform(b, lambda v: bit_count(v::INT)))", "LeftRightBitBalance": "list_sum(x[:len(x) // 2]) - list_sum(x[len(x) // 2 + 1:])", "BitAutocorrelation": "1 - 2 * list_avg(t)",
    "AvgTrailingZeroCount": "list_avg(list_transform(b, lambda v: CASE WHEN v % 2 = 1 THEN 0 WHEN v % 4 = 2 THEN 1 WHEN v % 8 = 4 THEN 2 WHEN v % 16 = 8 THEN 3 WHEN v % 32 = 16 THEN 4 WHEN v % 64 = 32 THEN 5 WHEN v % 128 = 64 THEN 6 ELSE 7 END))",
    "AvgLeadingZeroCount": "list_avg(list_transform(b, lambda v: CASE WHEN v > 127 THEN 0 WHEN v > 63 THEN 1 WHEN v > 31 THEN 2 WHEN v > 15 THEN 3 ELSE 4 END))", "CharDistributionVariance": "list_var_pop(map_values(list_histogram(b)))",
    "BitwiseMajorityFunction": "list_sum(list_transform(list_zip(x[:-3], x[2:-2], x[3:]), lambda p: (p[1] + p[2] + p[3] >= 2)::INT))", "ByteDeltaEncodingSize": "1 + list_sum(list_transform(list_zip(b[:-2], b[2:]), lambda p: CASE WHEN abs(p[1] - p[2]) < 8 THEN 0.5 ELSE 1.0 END))",
}


@query
def byte_values_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_text(part_texts(spark, sf_dir, "p_type"), "__text", lambda t: rounded(bits.add_bits(t, F.col("__text"), tuple(_BYTE_SQL)), tuple(_BYTE_SQL))).drop("__text")


ORACLES["byte_values_part"] = rounded_sql(
    f"""WITH bytes AS MATERIALIZED (SELECT p_partkey, list_transform(list_filter(string_split(p_type, ''), lambda c: c <> ''), lambda c: ord(c)) AS b FROM part),
        more AS MATERIALIZED (SELECT p_partkey, b, flatten(list_transform(b, lambda v: list_transform(range(7, -1, -1), lambda k: (v >> k::INT) & 1))) AS x, flatten(list_transform(b, lambda v: [v // 16, v % 16])) AS nib, list_transform(list_zip(b[:-2], b[2:]), lambda p: xor(p[1], p[2])) AS f FROM bytes),
        all_ AS MATERIALIZED (SELECT *, list_transform(list_zip(x[:-2], x[2:]), lambda p: (p[1] <> p[2])::INT) AS t FROM more)
        SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _BYTE_SQL.items())} FROM all_""",
    ["p_partkey"], tuple(_BYTE_SQL),
)


@query
def byte_values_documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documented byte and bit values, those without SQL among them."""
    return by_text(part_texts(spark, sf_dir, "p_type"), "__text", lambda t: rounded(bits.add_bits(t, F.col("__text"), bits.DOCUMENTED), bits.DOCUMENTED)).drop("__text")


_REST = {n: byte_documented[n] for n in bits.DOCUMENTED if n not in _BYTE_SQL}
ORACLES["byte_values_documented"] = f"SELECT a.*, b.* EXCLUDE (p_partkey) FROM ({ORACLES['byte_values_part']}) a JOIN ({rounded_sql(byte_sql('part', 'p_partkey', 'p_type', _REST), ['p_partkey'], tuple(_REST))}) b USING (p_partkey)"


@query
def bit_similarity_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    return bits.compare_bits(rows, F.col("p_brand"), F.col("p_type")).select("p_partkey", *[F.round(n, DIGITS).alias(n) for n in bits.PAIR_NAMES])


ORACLES["bit_similarity_part"] = rounded_sql(similarity_sql("part", "p_partkey", "p_brand", "p_type"), ["p_partkey"], bits.PAIR_NAMES)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; a temporary one where none is named and the driver is the only executor."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp()
    return f"{folder}/{uuid.uuid4().hex}"


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", _PROFILED)
    return rows.select("column_name", "n", F.round("variance", 2).alias("variance"), "zero_variance", F.round("correlation", DIGITS).alias("correlation"), F.round("pairwise_correlation", DIGITS).alias("pairwise_correlation"))


ORACLES["profile_lineitem"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(var_pop({c}), 2) AS variance, abs(var_pop({c})) < 1e-10 AS zero_variance, round(corr({c}, l_extendedprice), {DIGITS}) AS correlation, round(corr({c}, l_extendedprice), {DIGITS}) AS pairwise_correlation FROM lineitem" for c in _PROFILED
)


@query
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(spark.read.parquet(f"{sf_dir}/orders.parquet"), None, ("o_totalprice", "o_custkey", "o_orderstatus"))
    return rows.select("column_name", "n", F.round("variance", 2).alias("variance"), "zero_variance")


ORACLES["profile_orders"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(TRY_CAST({c} AS DOUBLE)) AS n, CASE WHEN count(TRY_CAST({c} AS DOUBLE)) > 1 THEN round(var_pop(TRY_CAST({c} AS DOUBLE)), 2) END AS variance, CASE WHEN count(TRY_CAST({c} AS DOUBLE)) > 1 THEN abs(var_pop(TRY_CAST({c} AS DOUBLE))) < 1e-10 END AS zero_variance FROM orders" for c in ("o_totalprice", "o_custkey", "o_orderstatus")
)


@query
def profile_summary_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_summary(profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", _PROFILED))


ORACLES["profile_summary_lineitem"] = f"""
    WITH p AS ({ORACLES['profile_lineitem']})
    SELECT count(*) AS columns, count(*) FILTER (WHERE abs(correlation) > 0.7) AS strong, count(*) FILTER (WHERE abs(correlation) > 0.3 AND abs(correlation) <= 0.7) AS moderate, count(*) FILTER (WHERE abs(correlation) <= 0.3) AS weak,
           count(*) FILTER (WHERE zero_variance) AS zero_variance, count(*) FILTER (WHERE variance IS NULL) AS no_data FROM p"""


@query
def profile_cube_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by flag and status with all subtotals."""
    rows = profile_by(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], _PROFILED, "l_extendedprice")
    return rows.select("l_returnflag", "l_linestatus", "grouping_id", "column_name", "n", F.round("mean", 6).alias("mean"), F.round("variance", 1).alias("variance"), F.round("correlation", 9).alias("correlation"))


@query
def profile_rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by priority and status with the subtotals of each priority and of all."""
    rows = profile_by(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_custkey"], "o_totalprice", "rollup")
    return rows.select("o_orderpriority", "o_orderstatus", "grouping_id", "column_name", "n", F.round("mean", 6).alias("mean"), F.round("variance", 0).alias("variance"), F.round("correlation", 9).alias("correlation"))


def _grouped_profile_sql(table: str, by: str, kind: str, columns: tuple[str, ...], reference: str, digits: int) -> str:
    one = lambda c: f"SELECT {by}, grouping({by})::INT AS grouping_id, '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(var_pop({c}), {digits}) AS variance, round(corr({c}, {reference}), 9) AS correlation FROM {table} GROUP BY {kind} ({by})"
    return " UNION ALL ".join(map(one, columns))


ORACLES["profile_cube_lineitem"] = _grouped_profile_sql("lineitem", "l_returnflag, l_linestatus", "CUBE", _PROFILED, "l_extendedprice", 1)
ORACLES["profile_rollup_orders"] = _grouped_profile_sql("orders", "o_orderpriority, o_orderstatus", "ROLLUP", ("o_totalprice", "o_custkey"), "o_totalprice", 0)


@query
def sketches_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values and quartiles of all rows from sketches of each month; approximate, within the bounds that the tests hold them to."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("month", F.trunc("l_shipdate", "month"))
    return merged_sketches(sketch(rows, ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"], ["month"]))


@query
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user over a finished table."""
    rows = session_profile(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value", ["user_id"], "2 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select(stamp("session_start"), stamp("session_end"), "user_id", "rows", "n", F.round("mean", DIGITS).alias("mean"), F.round("variance", 9).alias("variance"))


ORACLES["session_events"] = f"""
    WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
               FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL))
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL '2 hours', '%Y-%m-%d %H:%M:%S.%f') AS session_end, user_id, count(*) AS rows, count(value) AS n, round(avg(value), {DIGITS}) AS mean, round(var_pop(value), 9) AS variance
    FROM s GROUP BY user_id, k"""


@query
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keyed state of a stream ends with: by user, in the order of event_id, rows that are over a minute older than the newest before are late."""
    rows = late_table(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "value", "event_id", 60.0)
    return rows.select("key", "n", F.round("mean", DIGITS).alias("mean"), F.round("variance", 9).alias("variance"), "late", F.round("late_sum", 9).alias("late_sum"))


ORACLES["late_events"] = f"""
    WITH e AS (SELECT *, coalesce(epoch_us(ts) / 1e6 < max(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60.0, false) AS late FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)
    SELECT user_id::VARCHAR AS key, count(*) FILTER (WHERE NOT late) AS n, round(avg(value) FILTER (WHERE NOT late), {DIGITS}) AS mean, round(var_pop(value) FILTER (WHERE NOT late), 9) AS variance, count(*) FILTER (WHERE late) AS late,
           round(coalesce(sum(value) FILTER (WHERE late), 0), 9) AS late_sum FROM e GROUP BY user_id"""


@query
def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as CSV and read again range by range, line ends, quotes and all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = scratch(spark) + "/documents.csv"
    docs.write.csv(path, header=True, escape='"', quote='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_csv_ranges(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLES["csv_documents"] = "SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


@query
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming profile's plan over a finished table."""
    rows = windowed_profile(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value", ["event_type"], "1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("mean", DIGITS).alias("mean"), F.round("variance", DIGITS).alias("variance"))


ORACLES["windowed_events"] = f"""
    SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS n, round(avg(value), {DIGITS}) AS mean, round(var_pop(value), {DIGITS}) AS variance FROM events GROUP BY ALL"""


@query
def describe_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descriptor of every family in one plan."""
    rows = molecule_table(spark, sf_dir)
    return by_text(rows, "smiles", lambda t: catalog.describe(t, F.col("smiles")))


@query
def descriptor_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, with how many of the molecules have a value other than 0 of each descriptor, of every kind.

    Given descriptors are looked at with DIGITS decimals, as their queries return them: what sums leave over is 0.
    Registered ones are taken as they are. A null is no value, and what is no number is other than 0.
    """
    texts = dealt(molecule_table(spark, sf_dir).groupBy("smiles").agg(F.count(F.lit(1)).alias("__times")))
    known, kinds = catalog.entries(), dict[str, list[str]]()
    for e in known.values():
        kinds.setdefault(e.needs, []).append(e.name)

    def counted(names: list[str]) -> DataFrame:
        values = catalog.describe(texts, F.col("smiles"), names)
        numbers = {f.name for f in values.schema if isinstance(f.dataType, NumericType | BooleanType)}
        value = lambda n: F.col(n).cast("double") if known[n].needs == "registered" else F.round(n, DIGITS)
        other = lambda n: value(n) != 0 if n in numbers else F.col(n).isNotNull()
        counts = values.agg(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.sum(F.when(other(n), F.col("__times")).otherwise(0)), F.lit(0)).alias("n")) for n in names]).alias("c"))
        return counts.select(F.explode("c").alias("c")).select("c.*")

    # Kind by kind, as one plan of all kinds has all their Python workers at once in each task.
    found = reduce(DataFrame.unionAll, map(counted, kinds.values()))
    return catalog.listing(spark).join(F.broadcast(found), "name", "left")

"""Bit kernels, documented byte values and bit similarities as SQL over lists of bits and bytes of ASCII texts.

Checksums, hashes and parses are recursions, byte by byte or bit by bit; the avalanche factor flips every bit
and works the checksum out again.
"""

from __future__ import annotations

from collections.abc import Mapping

_RATIO = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
_LAG = lambda d: f"list_avg(list_transform(range(1, n - {d} + 1), lambda i: (x[i] = x[i + {d}])::INT))"

#: Values over the bits ``x`` (n of them), the bytes ``b`` and what the steps below make of them.
KERNELS = {
    "popcount": "ones", "bit_transitions": "moves", "longest_run": "list_max(lengths)", "xor_checksum": "list_reduce(b, lambda p, v: xor(p, v))", "byte_entropy": "list_entropy(b)", "fnv1a": "list_reduce(list_prepend(2166136261, b), lambda h, v: (xor(h, v) * 16777619) % 4294967296)",
    "crc8": "crc", "char_palindrome": "(b = list_reverse(b))::INT", "bit_palindrome": "(x = list_reverse(x))::INT", "bit_distribution_variance": "list_var_pop(list_transform(b, lambda v: bit_count(v::INT)))", "left_right_balance": "list_sum(x[:n // 2]) - list_sum(x[n // 2 + 1:])",
    "leading_zeros": "coalesce(spots[1], n)", "trailing_zeros": "coalesce(n - 1 - spots[-1], n)", "clustering_factor": _RATIO("moves", "expected"), "average_run_length": "n / (moves + 1)", "alternation_ratio": "moves / (n - 1)",
    "longest_zero_run": "coalesce(list_max(list_transform(list_filter(runs, lambda r: r[1] = '0'), lambda r: len(r))), 0)", "longest_one_run": "coalesce(list_max(list_transform(list_filter(runs, lambda r: r[1] = '1'), lambda r: len(r))), 0)",
    "bit_dispersion": "coalesce(list_var_pop(gaps), 0)", "rle_ratio": "len(runs) * (log2(n) + 1) / n", "bit_density": "ones / n", "periodicity_8": _LAG(8), "bit_autocorrelation": "(" + " + ".join(map(_LAG, range(1, 9))) + ") / 8", "balance_ratio": "ones / zeros", "bit_entropy": "list_entropy(x)",
    "byte_diversity": "len(list_distinct(b)) / 256", "position_weighted_sum": "list_sum(spots) + ones", **{f"pairs_{p}{q}": f"len(list_filter(twos, lambda v: v = {2 * p + q}))" for p in (0, 1) for q in (0, 1)},
    "run_gap_ratio": _RATIO("list_max(lengths[:-2])", "list_avg(lengths[:-2])"), "moreau_broto_1": "1 - 2.0 * moves / (n - 1)", "interleaving_difference": "abs(list_sum(list_transform(x, lambda v, i: v * (1 - 2 * (i % 2)))))", "first_moment": "list_avg(spots)", "second_moment": "m2",
    "skewness": "CASE WHEN ones > 2 THEN m3 / m2 ** 1.5 ELSE 0 END", "kurtosis": "CASE WHEN ones > 3 THEN m4 / (m2 * m2) - 3 ELSE 0 END", "segregation_index": "1 - moves / expected", "pair_entropy": "list_entropy(twos)", "equitability": "list_entropy(b) / 8", "min_one_distance": "list_min(gaps)", "max_one_distance": "list_max(gaps)",
    "median_one_position": "list_median(spots)", "max_window_density": "list_max(list_transform(range(1, n - 6), lambda i: list_sum(x[i:i + 7]) / 8))", "avalanche_factor": "avalanche", "approximate_entropy": "(list_entropy(around3) - list_entropy(around2)) * ln(2)", "quartet_entropy": "list_entropy(fours)",
    "run_count": "len(runs)", "run_entropy": "list_entropy(lengths)", "burst_factor": "list_max(lengths) / (n / len(lengths))", "spectral_flatness": "exp(list_avg(list_transform(same, lambda v: CASE WHEN v > 0 THEN ln(v) ELSE -10 END))) / list_avg(same)",
    "central_weighted_sum": "list_sum(list_transform(x, lambda v, i: v * floor(n / (abs(i - 1 - (n - 1) / 2) + 1))))", "asymmetry": "list_avg(list_transform(list_zip(x, list_reverse(x)), lambda p: (p[1] <> p[2])::INT))",
    "pattern_persistence": "coalesce(list_max(list_transform(regexp_extract_all(array_to_string(list_transform(range(1, n - 3), lambda i: (x[i] = x[i + 4])::INT), ''), '1+'), lambda r: len(r))), 0) // 4", "positional_spread": "sqrt(m2)", "lempel_ziv": "phrases", "complexity_estimate": "phrases / (n / log2(n))",
    "block_entropy": "list_entropy(fours) / 4", "predictability": "list_avg(list_transform(list_distinct(list_transform(threes, lambda v: v // 2)), lambda c: list_max(list_transform([0, 1], lambda e: len(list_filter(threes, lambda v: v = 2 * c + e)))) / len(list_filter(threes, lambda v: v // 2 = c))))",
    "compression_efficiency": "2 * len(byte_runs) / len(b)", "nist_frequency": "abs(2 * ones - n) / sqrt(n)", "nist_runs": "abs(moves + 1 - 2 * n * (ones / n) * (1 - ones / n)) / (2 * sqrt(n) * (ones / n) * (1 - ones / n))", "weight_deviation": "abs(ones - n / 2) / n", "count_C": "len(list_filter(b, lambda v: v = 67))",
}
_OFTEN = "list_transform(list_sort(list_distinct(b)), lambda v: len(list_filter(b, lambda y: y = v)))"
#: Documented values that have no closed form over the lists of ``queries._BYTE_SQL``.
DOCUMENTED = {
    "LongestBitRun": KERNELS["longest_run"], "FastHash": KERNELS["fnv1a"], "Crc8Checksum": "crc", "BitDispersionIndex": KERNELS["bit_dispersion"], "AvalanchePatternSensitivity": "avalanche", "BitRunLengthSize": KERNELS["rle_ratio"], "BinaryCompressionRatio": "phrases / n",
    "BitCorrelationCoef": "coalesce(relation, 0)", "ByteMarkovProperty": _RATIO("followed", "len(b) - 1"), "ByteMirroringDistance": "len(list_filter(range(1, n + 1), lambda i: x[i] <> x[(i - 1) // 8 * 8 + 8 - (i - 1) % 8]))", "ByteRunEntropy": "list_entropy(byte_runs)", "CharRunLength": "list_avg(byte_runs)",
    "DiagonalBitAccumulation": "list_sum(list_transform(b, lambda v, i: x[(i - 1) * 8 + (i - 1) % 8 + 1]))", "FastBitHistogram": "list_entropy(fours) / 4", "HalfByteRotationHash": "list_reduce(list_prepend(0::BIGINT, b), lambda h, v: xor(((h << 4) & 4294967295) | (h >> 28), ((v & 15) << 4) | (v >> 4)))",
    "LeastFrequentByte": f"list_sort(list_distinct(b))[list_position({_OFTEN}, list_min({_OFTEN}))]", "MostFrequentByte": f"list_sort(list_distinct(b))[list_position({_OFTEN}, list_max({_OFTEN}))]", "LzcntPattern": "list_entropy(list_transform(b, lambda v: 7 - floor(log2(v))))",
    "TzcntPattern": "list_entropy(list_transform(b, lambda v: bit_count(xor(v, v - 1)::INT)))", "MurmurHash3": "murmur", "RollingByteChecksum": "(high << 16) | low",
}
_M = 4294967295
_TURN = lambda e, r: f"((({e}) << {r} & {_M}) | (({e}) >> {32 - r}))"


def byte_sql(table: str, key: str, text: str, values: Mapping[str, str]) -> str:
    """DuckDB SQL of some values of the texts of a column, worked out once for each different text."""
    codes = lambda w: "list_transform(range(1, n - %d), lambda i: %s)" % (w - 2, " + ".join(f"{1 << (w - 1 - k)} * x[i + {k}]" for k in range(w)))
    circle = lambda w: "list_transform(range(n), lambda i: %s)" % " + ".join(f"{1 << (w - 1 - k)} * x[(i + {k}) % n + 1]" for k in range(w))
    mixed = f"((({_TURN('(w::HUGEINT * 3432918353 % 4294967296)::BIGINT', 15)})::HUGEINT * 461845907) % 4294967296)::BIGINT"
    final = f"xor((xor((xor(xor(h, len_), xor(h, len_) >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT, (xor(xor(h, len_), xor(h, len_) >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT, (xor((xor(xor(h, len_), xor(h, len_) >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT, (xor(xor(h, len_), xor(h, len_) >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT >> 16)"
    return f"""WITH RECURSIVE texts AS MATERIALIZED (SELECT DISTINCT {text} AS s FROM {table} WHERE {text} <> ''),
        bytes AS MATERIALIZED (SELECT s, list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT) AS b FROM texts),
        bits AS MATERIALIZED (SELECT s, b, flatten(list_transform(b, lambda v: list_transform(range(7, -1, -1), lambda k: ((v >> k::INT) & 1)::INT))) AS x, 8 * len(b) AS n FROM bytes),
        table8(v, step, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT v, step + 1, CASE WHEN c >= 128 THEN xor((c * 2) % 256, 7) ELSE c * 2 END FROM table8 WHERE step < 8),
        flips AS (SELECT s, 0 AS bit, b FROM bits UNION ALL SELECT s, bit, list_transform(b, lambda v, i: CASE WHEN i = (bit - 1) // 8 + 1 THEN xor(v, (128 >> ((bit - 1) % 8)::INT)::BIGINT) ELSE v END) FROM bits, LATERAL (SELECT unnest(range(1, n + 1)) AS bit)),
        crcs(s, bit, b, i, c) AS (SELECT s, bit, b, 1, 0::BIGINT FROM flips UNION ALL SELECT f.s, bit, b, i + 1, t.c FROM crcs f JOIN table8 t ON t.step = 8 AND t.v = xor(f.c, f.b[f.i]) WHERE i <= len(b)),
        checks AS MATERIALIZED (SELECT s, bit, c FROM crcs WHERE i = len(b) + 1),
        avalanches AS (SELECT o.s, any_value(o.c) AS crc, sum(bit_count(xor(o.c, f.c)::INT)) / (8 * count(*)) AS avalanche FROM checks o JOIN checks f ON f.s = o.s AND o.bit = 0 AND f.bit > 0 GROUP BY o.s),
        parse(s, x, i, phrase, seen) AS (SELECT s, x, 1, '', []::VARCHAR[] FROM bits
            UNION ALL SELECT s, x, i + 1, CASE WHEN list_contains(seen, phrase || x[i]) THEN phrase || x[i] ELSE '' END, CASE WHEN list_contains(seen, phrase || x[i]) THEN seen ELSE list_append(seen, phrase || x[i]) END FROM parse WHERE i <= len(x)),
        parsed AS (SELECT s, len(seen) + (phrase <> '')::INT AS phrases FROM parse WHERE i = len(x) + 1),
        murmurs(s, b, i, h) AS (SELECT s, b, 0, 0::BIGINT FROM bytes UNION ALL SELECT s, b, i + 4, CASE WHEN i + 4 <= len(b) THEN ({_TURN(f'xor(h, {mixed})', 13)} * 5 + 3864292196) % 4294967296 ELSE xor(h, {mixed}) END
            FROM (SELECT *, b[i + 1] + coalesce(b[i + 2], 0) * 256 + coalesce(b[i + 3], 0) * 65536 + coalesce(b[i + 4], 0) * 16777216 AS w FROM murmurs) WHERE i < len(b)),
        hashed AS (SELECT s, {final} AS murmur FROM (SELECT s, h, len(b) AS len_, i, row_number() OVER (PARTITION BY s ORDER BY i DESC) AS last FROM murmurs) WHERE last = 1),
        adlers(s, b, i, low, high) AS (SELECT s, b, 1, 1::BIGINT, 0::BIGINT FROM bytes UNION ALL SELECT s, b, i + 1, (low + b[i]) % 65521, (high + low + b[i]) % 65521 FROM adlers WHERE i <= len(b)),
        rolled AS (SELECT s, low, high FROM adlers WHERE i = len(b) + 1),
        next_bytes AS (SELECT s, sum(most) AS followed FROM (SELECT s, f, max(c) AS most FROM (SELECT s, b[i] AS f, b[i + 1] AS g, count(*) AS c FROM bytes, LATERAL (SELECT unnest(range(1, len(b))) AS i) GROUP BY ALL) GROUP BY s, f) GROUP BY s),
        related AS (SELECT s, CASE WHEN stddev_pop(u) > 0 AND stddev_pop(v) > 0 THEN corr(u, v) END AS relation FROM (SELECT s, unnest(list_filter(x, lambda v, i: i % 2 = 0)) AS u, unnest(list_filter(x, lambda v, i: i % 2 = 1)) AS v FROM bits) GROUP BY s),
        byte_starts AS (SELECT s, list_filter(range(1, len(b) + 1), lambda i: i = 1 OR b[i] <> b[i - 1]) AS st, len(b) AS nb FROM bytes),
        byte_runs AS (SELECT s, list_transform(st, lambda v, i: coalesce(st[i + 1], nb + 1) - v) AS byte_runs FROM byte_starts),
        ran AS MATERIALIZED (SELECT *, list_sum(x) AS ones, n - list_sum(x) AS zeros, regexp_extract_all(array_to_string(x, ''), '0+|1+') AS runs, list_filter(range(n), lambda i: x[i + 1] = 1) AS spots FROM bits),
        more AS MATERIALIZED (SELECT *, list_transform(runs, lambda r: len(r)) AS lengths, len(runs) - 1 AS moves, 2 * ones * zeros / n AS expected, list_transform(range(1, len(spots)), lambda i: spots[i + 1] - spots[i]) AS gaps, {codes(2)} AS twos, {codes(3)} AS threes, {codes(4)} AS fours,
            {circle(2)} AS around2, {circle(3)} AS around3, list_transform(range(1, n // 2 + 1), lambda d: list_avg(list_transform(range(1, n - d + 1), lambda i: (x[i] = x[i + d])::INT))) AS same,
            list_var_pop(spots) AS m2, list_avg(list_transform(spots, lambda v: (v - list_avg(spots)) ** 3)) AS m3, list_avg(list_transform(spots, lambda v: (v - list_avg(spots)) ** 4)) AS m4 FROM ran),
        told AS MATERIALIZED (SELECT s, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in values.items())} FROM more JOIN avalanches USING (s) JOIN parsed USING (s) JOIN hashed USING (s) JOIN rolled USING (s) LEFT JOIN next_bytes USING (s) JOIN related USING (s) JOIN byte_runs USING (s))
        SELECT {key}, {', '.join(values)} FROM {table} JOIN told ON told.s = {text}"""


def similarity_sql(table: str, key: str, a: str, b: str) -> str:
    """DuckDB SQL of the bit similarities of two ASCII columns, the shorter text padded with zeros."""
    bits = lambda c: f"flatten(list_transform(range(1, greatest(length({a}), length({b})) + 1), lambda i: list_transform(range(7, -1, -1), lambda k: ((CASE WHEN i <= length({c}) THEN ord({c}[i]) ELSE 0 END) >> k::INT) & 1)))"
    both, either = ("list_sum(list_transform(list_zip(x, y), lambda p: p[1] %s p[2]))" % o for o in ("&", "|"))
    total = "(list_sum(x) + list_sum(y))"
    values = {"hamming_distance": "list_sum(list_transform(list_zip(x, y), lambda p: xor(p[1], p[2])))", "jaccard": _RATIO(both, either), "dice": _RATIO(f"2 * {both}", total), "tanimoto": _RATIO(both, either), "cosine": _RATIO(both, "sqrt(list_sum(x) * list_sum(y))")}
    return f"WITH bits AS MATERIALIZED (SELECT {key}, {bits(a)} AS x, {bits(b)} AS y FROM {table}) SELECT {key}, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in values.items())} FROM bits"

"""The plane statistics as SQL over all cells of short texts: nothing is closed or shortened here."""

from __future__ import annotations

from molquarry.functions.tokens import ATOM_TYPES, BOND_TYPE, PLANE_STATISTICS, RING_TYPE, TOKEN, TYPES


def plane_sql(table: str, key: str, text: str) -> str:
    """DuckDB SQL of all plane statistics of a text column; the square of its tokens in rows, so for short texts."""
    kind = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {k}" for k, p in TYPES) + " ELSE 0 END"
    entropy = lambda one, zero: f"(CASE WHEN {one} > 0 THEN -({one} / ({one} + {zero})) * log2({one} / ({one} + {zero})) ELSE 0 END + CASE WHEN {zero} > 0 THEN -({zero} / ({one} + {zero})) * log2({zero} / ({one} + {zero})) ELSE 0 END)"
    steps = f"""
        texts AS (SELECT {key} AS k, regexp_extract_all(coalesce({text}, ''), '{TOKEN}') AS ts FROM {table}),
        tok AS MATERIALIZED (SELECT k, unnest(range(len(ts))) AS i, unnest(ts) AS t, len(ts) AS n FROM texts),
        typed AS MATERIALIZED (SELECT *, {kind('t')} AS ty FROM tok),
        cells AS MATERIALIZED (SELECT x.k, x.n, x.i, y.i AS j, x.ty AS a, y.ty AS b, (x.t = y.t)::INT AS p0, ((x.ty IN {ATOM_TYPES} AND y.ty = {BOND_TYPE}) OR (y.ty IN {ATOM_TYPES} AND x.ty = {BOND_TYPE}))::INT AS p1,
            (x.t = y.t AND x.ty = {RING_TYPE} AND y.ty = {RING_TYPE})::INT AS p2, abs(x.i - y.i) / greatest(x.n - 1, 1) AS p3 FROM typed x JOIN typed y USING (k)),
        r AS (SELECT k, i, any_value(n) AS n, any_value(a) AS a, sum(p0 + p1 + p2 + p3) AS s, coalesce(sum(p1) FILTER (WHERE j < i), 0) AS l, coalesce(sum(p1) FILTER (WHERE j > i), 0) AS g,
            {', '.join(f'count(*) FILTER (WHERE p{p} > 1 - 1e-9) AS one{p}, count(*) FILTER (WHERE p{p} < 1e-9) AS zero{p}' for p in range(4))},
            (var_samp(p0) + var_samp(p1) + var_samp(p2) + var_samp(p3)) / 4 AS v FROM cells GROUP BY k, i),
        of_rows AS (SELECT k, max(s) AS connected, avg(abs(l - g) / greatest(l + g, 1)) FILTER (WHERE a IN {ATOM_TYPES}) AS asymmetry, avg(({' + '.join(entropy(f'one{p}', f'zero{p}') for p in range(4))}) / 4) AS bits, count(*) FILTER (WHERE v < 0.1) AS stable FROM r GROUP BY k),
        cut AS (SELECT k, (sum(p0) >= (any_value(n) * any_value(n) + 9) // 10)::INT AS c FROM cells GROUP BY k),
        band AS (SELECT k, greatest(max(i + j) - min(i + j), max(i - j) - min(i - j)) AS band FROM cells JOIN cut USING (k) WHERE p0 >= c GROUP BY k),
        every AS (SELECT k, unnest([p0, p1, p2, p3]) AS v FROM cells), means AS (SELECT k, avg(v) AS m FROM every GROUP BY k),
        moments AS (SELECT k, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3 FROM every JOIN means USING (k) GROUP BY k),
        halves AS (SELECT k, avg((1 - p3) * (p0 + p1 + p2)) AS near, sum(p0 + p1 + p2 + p3) FILTER (WHERE i <> j) AS apart, coalesce(sum(p0 + p1 + p2 + p3) FILTER (WHERE i <> j AND a = b), 0) AS alike, coalesce(sum(p0 + p1 + p2 + p3) FILTER (WHERE i <> j AND a <> b), 0) AS unlike,
            coalesce(sum(p0 + p1 + p2 + p3) FILTER (WHERE i < n // 2 AND j < n // 2), 0) AS first_, coalesce(sum(p0 + p1 + p2 + p3) FILTER (WHERE i >= n // 2 AND j >= n // 2), 0) AS last_,
            avg(p0 + p1 + p2 + p3) FILTER (WHERE i IN (0, n - 1) OR j IN (0, n - 1)) AS edge, coalesce(avg(p0 + p1 + p2 + p3) FILTER (WHERE i NOT IN (0, n - 1) AND j NOT IN (0, n - 1)), 0) AS core FROM cells GROUP BY k),
        grid AS (SELECT k, stddev_pop(s) AS grid FROM (SELECT k, i // 2 AS p, j // 2 AS q, sum(p0) AS s FROM cells WHERE i < n // 2 * 2 AND j < n // 2 * 2 GROUP BY ALL) GROUP BY k),
        patch AS (SELECT k, max(s) AS patch FROM (SELECT k, i - da AS p, j - db AS q, sum(p0) AS s FROM cells, range(3) x(da), range(3) y(db) GROUP BY ALL HAVING count(*) = 9) GROUP BY k),
        moved AS (SELECT c.k, sum(abs(c.p0 - turned.p0)) AS rotated, sum(abs(c.p0 - mirrored.p0)) FILTER (WHERE c.i + c.j <> c.n - 1) AS mirrored, sum(c.p0 * d.p0 * (e.p0 + f.p0)) AS corners
            FROM cells c JOIN cells turned ON turned.k = c.k AND turned.i = c.j AND turned.j = c.n - 1 - c.i JOIN cells mirrored ON mirrored.k = c.k AND mirrored.i = c.n - 1 - c.j AND mirrored.j = c.n - 1 - c.i
            LEFT JOIN cells d ON d.k = c.k AND d.i = c.i + 1 AND d.j = c.j + 1 LEFT JOIN cells e ON e.k = c.k AND e.i = c.i + 1 AND e.j = c.j LEFT JOIN cells f ON f.k = c.k AND f.i = c.i AND f.j = c.j + 1 GROUP BY c.k)"""
    share = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0 END"
    values = {
        "SpitMostConnectedTokenScore": "connected", "SpitHighestInteractiveToken": "connected", "SpitBondPairAsymmetry": "asymmetry", "SpitBandwidthTop10Activation": "band", "SpitSkewnessInteractionMatrix": "CASE WHEN m2 > 1e-12 THEN m3 / m2 ** 1.5 ELSE 0 END",
        "SpitAverageDistanceWeightedActivation": "near", "SpitTokenEntropy": "bits", "SpitPositionallyStableTokens": "stable", "SpitIntraClassInteractionRatio": "CASE WHEN apart > 0 THEN alike / apart ELSE 0 END", "SpitInterClassInteractionRatio": "CASE WHEN apart > 0 THEN unlike / apart ELSE 0 END",
        "SpitGridUniformity": "grid", "SpitMax3x3InteractionPatchScore": "patch", "SpitLPatternMotifCount": "corners", "SpitSymmetryUnder90Rotation": "1 - rotated / (n * n)", "SpitAntiDiagonalAsymmetryScore": "mirrored / (n * n - n)",
        "SpitTopLeftToBottomRightImbalance": share("first_", "last_"), "SpitEdgeTokenInteractionBias": share("edge", "core"),
    }
    assert set(values) == set(PLANE_STATISTICS)
    columns = ", ".join(f"coalesce(CASE WHEN n >= {PLANE_STATISTICS[name][0]} THEN {e} END, 0)::DOUBLE AS {name}" for name, e in values.items())
    joins = " ".join(f"LEFT JOIN {t} USING (k)" for t in ("of_rows", "band", "moments", "halves", "grid", "patch", "moved"))
    return f"WITH {steps.strip()} SELECT k AS {key}, {columns} FROM (SELECT k, len(ts) AS n FROM texts) {joins}"

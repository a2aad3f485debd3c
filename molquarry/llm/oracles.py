"""The queries of this package in DuckDB's SQL, where SQL can express them."""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), wins AS (
            SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS win FROM d
        ), source AS (
            SELECT win, min(doc_id) AS least FROM wins GROUP BY win
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM wins JOIN source USING (win) WHERE least < doc_id
        ), lists AS (
            SELECT doc_id, list(pos) AS g, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS n_spans
            FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(g, i), false)), ' ')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
        FROM d LEFT JOIN lists USING (doc_id)""",
    "op3_url_filter": r"""
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS pos FROM pages
        ), q AS (
            SELECT page_id, u, CASE WHEN pos > 0 THEN substr(u, pos + 3) ELSE '' END AS rest FROM p
        ), r AS (
            SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM q
        ), list AS (
            SELECT DISTINCT host || path AS key FROM r WHERE u LIKE '%?utm_source=%' OR u LIKE '%&utm_source=%'
        ), rules(rh, rp, rv) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), best AS (
            SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
            FROM r JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
        )
        SELECT r.page_id, host, path, rule, coalesce(rv, CASE WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, key IS NOT NULL AS listed
        FROM r LEFT JOIN best USING (page_id) LEFT JOIN list ON key = host || path""",
    "op4_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), wins AS (
            SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS win FROM d
        ), twice AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins
        ), spread AS (
            SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM twice WHERE c > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT pos) AS n FROM spread GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                   length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines
            FROM d LEFT JOIN covered USING (doc_id)
        ), j AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
        ), k AS (
            SELECT *, base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
                   OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > word_chars AS failed FROM j
        ), hosts AS (
            SELECT host, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM k GROUP BY host
        ), sums AS (
            SELECT sum(n) AS docs, sum(f) / sum(n) AS mean, count(*) AS hosts, (sum(f * f / n) - sum(n) * (sum(f) / sum(n)) ** 2 - (count(*) - 1) * (sum(f) / sum(n)) * (1 - sum(f) / sum(n))) / (sum(n) - sum(n * n) / sum(n)) AS v FROM hosts
        ), prior AS (
            SELECT mean, CASE WHEN hosts >= 2 AND v > 0 THEN greatest(mean * (1 - mean) / v - 1, 0.01) WHEN hosts >= 2 THEN docs ELSE 2 END AS strength FROM sums
        ), shape AS (
            SELECT greatest(mean * strength, 1e-9) AS a, greatest((1 - mean) * strength, 1e-9) AS b FROM prior
        ), verdicts AS (
            SELECT host, (f + a) / (n + a + b) <= 0.5 AS host_ok FROM hosts, shape
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND host_ok AS kept, host, host_ok
        FROM k JOIN verdicts USING (host)""",
    "op8_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM d
        ), named AS (
            SELECT doc_id, len(x) AS n, CASE WHEN len(x) > 0 THEN min(doc_id) OVER (PARTITION BY x) ELSE doc_id END AS class_id, x FROM s
        ), c AS (
            SELECT doc_id, n, unnest(x) AS x FROM named WHERE doc_id = class_id AND n > 0
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM c AS a JOIN c AS b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT DISTINCT class_id, class_id FROM named UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b
        ), least AS (
            SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept, class_id FROM named JOIN least USING (class_id)""",
    "op9_chat_format": r"""
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ), p AS (
            SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                   string_agg(length(role)::VARCHAR || ':' || role || ':' || length(text)::VARCHAR || ':' || text, '') OVER w AS prefix,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS rendered
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        ), whole AS (
            SELECT min(conv_id) AS conv_id, count(*) AS n_copies, prefix FROM p WHERE n = n_turns GROUP BY prefix
        ), logged AS (
            SELECT p.conv_id, count(*) AS n_snapshots FROM p JOIN whole USING (prefix) WHERE n < n_turns GROUP BY p.conv_id
        )
        SELECT p.conv_id, n_turns, coalesce(n_snapshots, 0) AS n_snapshots, n_copies, rendered, sha256(rendered) AS rendered_sha256
        FROM whole JOIN p USING (conv_id, prefix) LEFT JOIN logged USING (conv_id)
        WHERE n = n_turns AND prefix NOT IN (SELECT prefix FROM p WHERE n < n_turns)""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
}


_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters(k: int, dim: int, rounds: int) -> str:
    """The rounds of clustering, one after the other; centroids are rows (c, m)."""
    assigned = lambda r: f"SELECT vec_id, x, arg_min(c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 1000 + c) AS cluster FROM v, c{r} GROUP BY vec_id, x"
    steps = "".join(f"""
        a{r} AS MATERIALIZED ({assigned(r)}),
        s{r} AS (SELECT cluster, j, floor(sum(x[j]) / count(*)) AS m FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS j) GROUP BY cluster, j),
        c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT cluster, list(m ORDER BY j) AS m FROM s{r} GROUP BY cluster) n ON n.cluster = c),""" for r in range(rounds))
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = {dim} AND {_WHOLE}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x AS m FROM v QUALIFY c < {k}),{steps}
        last AS MATERIALIZED ({assigned(rounds)}),
        told AS (SELECT vec_id, cluster, m, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM last JOIN c{rounds} ON c = cluster)
        SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(list_transform(m, lambda y: y::BIGINT::VARCHAR), ',')) AS centroid_sha256
        FROM told"""


ORACLES["op11_centroid_clusters"] = _clusters(40, 64, 5)
#: The tables' pages all have their main text in one article element.
ORACLES["op12_html_text"] = r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '</?[a-z0-9]+>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, url, replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS t FROM b),
    d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
    SELECT page_id, url, text, length(text) AS n_chars FROM d"""
ORACLES["op13_hard_negatives"] = f"""
    WITH v AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
        FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}
    ), s AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
        SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
    )
    SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER w <= 10"""

"""DuckDB SQL for the queries that SQL can express on whole tables.

Not here: token counts, packing and language-model scores (tokenizers, expectation-maximisation), divergence
(held against plain Python) and substring dedup (a row per byte is too slow in SQL).
"""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


_REACH = "r(node, seen) AS (SELECT {id}, {id} FROM {table} UNION SELECT r.node, b.y FROM r JOIN b ON r.seen = b.x), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), {_REACH.format(id="doc_id", table="documents")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON c.node = doc_id LEFT JOIN n USING (doc_id)"""

HNSW = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
b AS (SELECT a.vec_id AS x, c.vec_id AS y FROM v AS a JOIN v AS c ON a.label = c.label AND a.vec_id <> c.vec_id AND list_cosine_similarity(a.x, c.x) >= 0.93),
{_REACH.format(id="vec_id", table="embeddings")}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN (SELECT x, count(*) AS n FROM b GROUP BY x) AS k ON k.x = vec_id"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER f AS k, sum(n::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(n::DOUBLE) OVER g, 0) * 2.0::DOUBLE AS rest, sum(w) OVER () - coalesce(sum(w) OVER g, 0) AS w_rest FROM s
  WINDOW f AS (ORDER BY n / w, source NULLS LAST), g AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, rest / w_rest AS level, min(CASE WHEN rest / w_rest * w <= n::DOUBLE * 2 THEN k END) OVER () AS k0 FROM o),
t AS (SELECT source, n, CASE WHEN k0 IS NULL OR k < k0 THEN n::DOUBLE * 2 ELSE least(w * max(CASE WHEN k = k0 THEN level END) OVER (), n::DOUBLE * 2) END AS target FROM l),
j AS (SELECT doc_id, size, n AS source_size, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM j"""

URLS = f"""
WITH rules(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
h AS (SELECT page_id, row_number() OVER () AS k, {_lower("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
m AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN rules
  ON (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (k)"""

LINES = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, lines[i] AS line, i, {_lower(f"trim(lines[i], {_BLANKS})")} AS key FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
k AS (SELECT key, max(doc_id) AS last FROM x WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, last IS NOT NULL AND doc_id < last AS gone FROM x LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

ORACLES = {
    "op3_circulant_minhash": MINHASH, "op4_hnsw": HNSW, "op5_mixing": MIXING, "op9_url_rules": URLS, "op10_line_runs": LINES,
}

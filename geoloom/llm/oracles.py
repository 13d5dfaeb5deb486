"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NON_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_NON_SPACE}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id),
degree AS (SELECT a AS doc_id, count(*) AS m FROM edges GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(m, 0)::BIGINT AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN degree USING (doc_id)
"""

OP3 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_NON_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)),
first_seen AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN first_seen USING (k) WHERE d < doc_id),
per AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
left_over AS (
  SELECT dw.doc_id, string_agg(w[i], ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw) dw LEFT JOIN gone ON gone.doc_id = dw.doc_id AND gone.j = i
  WHERE gone.j IS NULL GROUP BY dw.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP4 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM pat),
hit AS (
  SELECT d.doc_id, d.i, d.m, p.item_id
  FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths WHERE len(w) >= m)) d
  JOIN pat p ON p.m = d.m AND p.k = d.k),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP10 = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NON_SPACE}'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM per),
stepped AS (SELECT *, cap / weight AS lvl,
  (sum(source_size) OVER ())::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
water AS (SELECT first((total - below) / open ORDER BY lvl) AS share FROM stepped WHERE (total - below) / open <= lvl),
rated AS (SELECT source, source_size, least(cap, share * weight) AS target,
  CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, least(cap, share * weight) / source_size) ELSE 0.0 END AS rate FROM stepped, water)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('20240501-' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op3_substring_dedup": OP3, "op4_decontaminate": OP4, "op10_mix_sources": OP10}

"""DuckDB SQL for the rows of op5, op6, op8 and op10, written from their contracts.

Repeated rows are told apart by a row number. The SQL makes every window, shingle and string of the tables, so it suits
tables of some megabytes; tests and the driver hold the queries against it there.
"""

from __future__ import annotations

import string

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ROWS = "rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents)"

DECONTAMINATE = rf"""WITH {_ROWS},
doc_words AS MATERIALIZED (
  SELECT r, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM rows
), item_words AS (
  SELECT item_id, w, least(13, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
), patterns AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM item_words WHERE k > 0)
), doc_windows AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM patterns) WHERE len(w) >= k)
), found AS MATERIALIZED (
  SELECT r, i, k, item_id FROM doc_windows JOIN patterns USING (k, p)
), hit AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n > 0 AND 20 * hit.n >= len(w), false) AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

SUBSTRING = rf"""WITH {_ROWS},
doc_words AS MATERIALIZED (
  SELECT r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM rows
), windows AS MATERIALIZED (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS p
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc_words WHERE len(w) >= 13)
), earliest AS (
  SELECT p, min(doc_id) AS first_doc FROM windows GROUP BY p
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM windows JOIN earliest USING (p) WHERE first_doc < doc_id
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc_words
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS left_text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (r)"""

MINHASH = rf"""WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), doc_words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM texts
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM doc_words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, a AS other FROM edges
  UNION
  SELECT reached.doc_id, edges.b FROM reached JOIN edges ON reached.other = edges.a
), least_id AS (
  SELECT doc_id, min(other) AS component FROM reached GROUP BY doc_id
), classes AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY all_s) AS class_id FROM (SELECT doc_id, list(s ORDER BY s) AS all_s FROM shingles GROUP BY doc_id)
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
  coalesce(coalesce(component, d.doc_id) = d.doc_id, true) AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id) LEFT JOIN classes USING (doc_id)"""

SUFFIX = f"""WITH {_ROWS},
bytes AS MATERIALIZED (
  SELECT r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM rows
), strings AS MATERIALIZED (
  SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT r, x, unnest(range(strlen(x) // 2 - 199)) AS i FROM bytes WHERE strlen(x) >= 400)
), repeated AS (
  SELECT s FROM strings GROUP BY s HAVING count(*) > 1
), starts AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings SEMI JOIN repeated USING (s)
), numbered AS (
  SELECT r, i, count(*) FILTER (before IS NULL OR i > before + 200) OVER (PARTITION BY r ORDER BY i) AS span FROM starts
), spans AS (
  SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, span
), stretches AS (
  SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM spans
  UNION ALL
  SELECT r, 0, min(a) FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, strlen(x) // 2) - a)), '' ORDER BY a) AS left_bytes FROM stretches JOIN bytes USING (r) GROUP BY r
), counts AS (
  SELECT r, count(*) AS n, sum(b - a) AS removed FROM spans GROUP BY r
)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_bytes, x))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)"""

SQL: dict[str, str] = {"op5_decontaminate": DECONTAMINATE, "op6_substring_dedup": SUBSTRING, "op8_minhash": MINHASH, "op10_suffix_dedup": SUFFIX}

"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP5 = f"""
WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
i AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
places AS (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS a FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[a + 1:a + 10], ' ') AS g FROM places),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS a FROM d, sizes),
hit AS (SELECT doc_id, a, n, item_id
  FROM (SELECT doc_id, a, n, array_to_string(w[a + 1:a + n], ' ') AS g FROM grams) JOIN win USING (g, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""


OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links,
  min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w)
  WHERE r > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new
  FROM again),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM marked),
run AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run
  UNION ALL SELECT d.doc_id, d.n, coalesce(max(b), 0) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id, d.n),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM run GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[a + 1:a + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, (SELECT count(*) FROM link WHERE link.a = d.doc_id) AS n_links,
  min(reach.b) AS class_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""


OP7 = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(0, len(t))) AS line_no, unnest(t) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
d AS (SELECT line, length(line) AS n, count(*) AS copies, min({'d': doc_id, 'l': line_no}) AS f
  FROM l WHERE length(line) >= 1 GROUP BY line),
link AS (SELECT a.line AS a, b.line AS b, b.copies AS c FROM d a JOIN d b
  ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line AND least(a.n, b.n) >= 10
  AND levenshtein(a.line, b.line) <= CASE WHEN least(a.n, b.n) >= 20 THEN 2 ELSE 1 END),
reach(a, b) AS (SELECT line, line FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT reach.a AS line, min(d.f) AS f FROM reach JOIN d ON d.line = reach.b GROUP BY reach.a),
direct AS (SELECT a AS line, sum(c) AS c FROM link GROUP BY a)
SELECT l.doc_id, l.line_no, CAST(coalesce(d.copies - 1 + coalesce(direct.c, 0), 0) AS BIGINT) AS n_links,
  coalesce(class.f.d, l.doc_id) AS class_doc_id, coalesce(class.f.l, l.line_no) AS class_line_no,
  class.f IS NULL OR (class.f.d = l.doc_id AND class.f.l = l.line_no) AS kept
FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN class ON class.line = l.line LEFT JOIN direct ON direct.line = l.line
"""


OP12 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b,
  CAST('0x' || x[17:24] AS BIGINT) % 100 AS c, CAST('0x' || x[25:32] AS BIGINT) % 100 AS d FROM h),
f AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
    WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, p) || '<S>' || substring(t, q + 1) || '<M>' || substring(t, p + 1, q - p)
    ELSE '<S>' || substring(t, q + 1) || '<P>' || substring(t, 1, p) || '<M>' || substring(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""


def op13(rounds: int = 10) -> str:
    """The rounds one after the other; all distances in full."""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
             """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x
  FROM v ORDER BY c LIMIT 8)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, k.x),
    lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': k.c}}) AS m FROM v, c{i} k GROUP BY r, vec_id, v.x)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT m.c AS c, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(j) GROUP BY ALL)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.x, k.x) AS x FROM c{i} k LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY c) n ON n.c = k.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.c AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k ON k.c = m.c"""


def oracle_sql() -> dict[str, str]:
    return {"op2_vector_dedup": OP2, "op3_substring_dedup": OP3, "op4_jaccard_join": OP4, "op5_decontaminate": OP5,
            "op7_line_dedup": OP7, "op12_fill_in_middle": OP12, "op13_centroids": op13()}

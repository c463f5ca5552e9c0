"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

#: An exact prefix-filtered join: pairs this similar share one of their rarest words.
_SIMILAR = """n0 AS (SELECT id, any_value(content) AS content FROM memory_nodes GROUP BY id),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS word FROM n0),
d AS (SELECT word, count(*) AS f FROM w GROUP BY word),
r AS (SELECT w.id, w.word, row_number() OVER (PARTITION BY w.id ORDER BY f, w.word) AS rn, count(*) OVER (PARTITION BY w.id) AS k FROM w JOIN d USING (word)),
p AS (SELECT * FROM r WHERE rn <= k - ceil(0.7 * k - 1e-9) + 1),
s AS (SELECT id, list(word) AS l, count(*) AS k FROM w GROUP BY id),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.word = b.word AND a.id < b.id),
m AS (SELECT x, y, len(list_intersect(sa.l, sb.l)) AS common, sa.k AS ka, sb.k AS kb FROM c JOIN s sa ON sa.id = x JOIN s sb ON sb.id = y)"""
_NEAR = "common >= 0.7 * (ka + kb - common) - 1e-9"

SQL: dict[str, str] = {
    "p5_found": """WITH n AS (SELECT id, any_value(content) AS content, any_value(retrieval.sparse_keys) AS keys FROM memory_nodes GROUP BY id),
k AS (SELECT DISTINCT id, lower(trim(u, E' \\t\\n\\r')) AS term FROM (SELECT id, unnest(keys) AS u FROM n)),
df AS (SELECT term FROM k WHERE term <> '' GROUP BY term HAVING count(*) BETWEEN 2 AND 20),
w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS term FROM n),
tf AS (SELECT id, term FROM w GROUP BY id, term HAVING count(*) >= 2)
SELECT k.id AS node_id, k.term FROM k JOIN df USING (term) JOIN tf ON tf.id = k.id AND tf.term = k.term""",
    # the mixture fitted by 80 steps of expectation-maximisation on each term's histogram
    "p5_scores": """WITH RECURSIVE n AS (SELECT id, any_value(content) AS content, any_value(retrieval.sparse_keys) AS keys FROM memory_nodes GROUP BY id),
k AS (SELECT DISTINCT id, lower(trim(u, E' \\t\\n\\r')) AS term FROM (SELECT id, unnest(keys) AS u FROM n)),
df AS (SELECT term, count(*) AS df FROM k WHERE term <> '' GROUP BY term),
w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS term FROM n),
tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM df) GROUP BY id, term),
occ AS (SELECT term, tf::DOUBLE AS c, count(*)::DOUBLE AS f FROM tf GROUP BY term, tf),
hist AS (SELECT term, c, f FROM occ UNION ALL SELECT df.term, 0, (SELECT count(*) FROM n) - coalesce(x.f, 0) FROM df LEFT JOIN (SELECT term, sum(f) AS f FROM occ GROUP BY term) x USING (term)),
em(term, step, share, elite, rest) AS (
  SELECT term, 0, least(greatest(sum(f) FILTER (c > 0) / sum(f) * 0.5, 1e-12), 0.5), greatest(sum(f * c * c) / greatest(sum(f * c), 1e-9), 1) + 0.1, greatest(sum(f * c) / sum(f) * 0.2, 1e-9) FROM hist GROUP BY term
  UNION ALL
  SELECT term, step + 1, share, greatest(elite, rest * (1 + 1e-9)), rest FROM (
    SELECT term, step, least(greatest(sum(r) / sum(f), 1e-12), 0.5) AS share, greatest(sum(r * c) / greatest(sum(r), 1e-12), 1e-6) AS elite, greatest(sum((f - r) * c) / greatest(sum(f) - sum(r), 1e-12), 1e-9) AS rest
    FROM (SELECT em.term, step, c, f, f / (1 + exp(-least(greatest(ln(share) - ln(1 - share) - elite + rest + c * (ln(elite) - ln(rest)), -700), 700))) AS r FROM em JOIN hist USING (term) WHERE step < 80)
    GROUP BY term, step)),
odds AS (SELECT k.id, k.term, coalesce(tf.tf, 0) AS tf, df.df, ln(share) - ln(1 - share) - elite + rest + coalesce(tf.tf, 0) * (ln(elite) - ln(rest)) AS z
  FROM k JOIN df USING (term) JOIN em ON em.term = k.term AND step = 80 LEFT JOIN tf ON tf.id = k.id AND tf.term = k.term)
SELECT id AS node_id, term, tf::BIGINT AS tf, df::BIGINT AS df, CASE WHEN tf = 0 THEN 0 ELSE round(1 / (1 + exp(-least(greatest(z, -700), 700))), 4) END AS score FROM odds""",
    "p9_check": "SELECT budget_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0::BIGINT AS n_overfull, 0::BIGINT AS n_wrong, true AS near_bound FROM pack_budgets",
    "p3_found": f"WITH {_SIMILAR} SELECT x AS node_id_a, y AS node_id_b FROM m WHERE {_NEAR}",
    "p3_links": f"""WITH {_SIMILAR}, g AS (SELECT id, min(id) OVER (PARTITION BY list_sort(l)) AS rep FROM s)
SELECT DISTINCT x AS node_id_a, y AS node_id_b FROM m JOIN g gx ON gx.id = x JOIN g gy ON gy.id = y WHERE {_NEAR} AND gx.rep = x AND gy.rep = y""",
    "p3_groups": f"""WITH {_SIMILAR}, g AS (SELECT id, min(id) OVER (PARTITION BY list_sort(l)) AS rep, count(*) OVER (PARTITION BY list_sort(l)) AS k FROM s),
e AS (SELECT x, y FROM m WHERE {_NEAR} UNION ALL SELECT y, x FROM m WHERE {_NEAR}),
n AS (SELECT gx.rep AS rep, count(DISTINCT gy.rep) AS n FROM e JOIN g gx ON gx.id = x JOIN g gy ON gy.id = y WHERE gx.rep <> gy.rep GROUP BY gx.rep)
SELECT g.id AS node_id, g.rep AS same_words_as, g.k AS n_copies, coalesce(n.n, 0) AS n_links FROM g LEFT JOIN n USING (rep)""",
}

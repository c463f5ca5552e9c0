"""Queries of the effective view, retrieval and packs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import integrity, ledger, mutate, pack, retrieval, view
from ledgerloom.operators.ledger import nodes, patches
from ledgerloom.session import table

#: The queries that are asked of every ledger.
ASKED = {"q1": "retention gateway session", "q2": "ranking ranking drift", "q3": "The billing team pins", "q4": "세션에서 정한 규칙"}
EXACT = {"g1": "Blue Harbor", "g2": "mem_00", "g3": "migration"}
AS_OF = 1_735_689_600  # 2025-01-01
ROUNDED = 6


def _flat(hits: DataFrame) -> DataFrame:
    out = hits.withColumn("score", F.round("score", ROUNDED)).withColumn("rank", F.col("rank").cast("long"))
    return out.select("query_id", "id", "score", "rank", F.array_join("reasons", ",").alias("reasons")) if "reasons" in out.columns else out.select("query_id", "id", "score", "rank")


def _view(spark: SparkSession, d: str) -> DataFrame:
    return view.effective_view(nodes(spark, d))


def _session(spark: SparkSession, d: str) -> str | None:
    """The first session that has nodes of its own."""
    return nodes(spark, d).where("status = 'active_session'").agg(F.min("scope.session")).first()[0]


def effective_view(spark, d):
    return view.effective_view(nodes(spark, d), patches(spark, d), unknown="ignore").select("id", "key", "scope_rank")


def view_with_session(spark, d):
    return view.effective_view(nodes(spark, d), patches(spark, d), _session(spark, d), unknown="ignore").select("id", "key", "scope_rank")


def scope_precedence(spark, d):
    return view.scope_winners(nodes(spark, d).where("status = 'active'")).select("id", "key", "scope_rank", "view_ord")


def suppressed_nodes(spark, d):
    return view.suppressed(nodes(spark, d)).select("id", "status")


def conflict_nodes(spark, d):
    return view.conflicts(nodes(spark, d)).select("id", "status")


def forgotten_like_nodes(spark, d):
    return view.forgotten_like(nodes(spark, d)).select("id", "status")


def retired_targets(spark, d):
    return view.retired_targets(patches(spark, d))


def unknown_operations(spark, d):
    return patches(spark, d).where(~F.col("operation").isin(*ledger.PATCH_OPERATIONS)).select("id", "operation")


def status_counts(spark, d):
    n = nodes(spark, d).agg(F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(~F.col("status").isin("active", "active_session")).alias("n_suppressed"))
    one = lambda t, c: table(spark, d, t).agg(F.countDistinct("id")).scalar().alias(c)
    return n.select("n_active", "n_suppressed", one("memory_patches", "n_patches"), one("memory_edges", "n_edges"), one("agent_sessions", "n_sessions"))


def point_lookup(spark, d):
    first = nodes(spark, d).agg(F.max("id")).first()[0]
    return nodes(spark, d).where(F.col("id") == first).select("id", "type", "status", "content")


def tokenize(spark, d):
    return nodes(spark, d).select("id", F.array_join(text.tokenize(F.col("content")), " ").alias("tokens"))


def _terms(spark, d) -> DataFrame:
    return nodes(spark, d).select("id", F.explode(text.tokenize(retrieval._document())).alias("term"))


def term_freq(spark, d):
    return _terms(spark, d).groupBy("id", "term").agg(F.count("*").alias("tf"))


def doc_freq(spark, d):
    return term_freq(spark, d).groupBy("term").agg(F.count("*").alias("df"))


def lexical_search(spark, d):
    return _flat(retrieval.lexical_search(_view(spark, d), ASKED))


def lexical_join(spark, d):
    """Every principal's name as a query."""
    asked = table(spark, d, "principals").select(F.col("principal_id").alias("query_id"), F.col("display_name").alias("query"))
    return _flat(retrieval.lexical_join(_view(spark, d), asked, 5))


def grep_search(spark, d):
    return _flat(retrieval.grep_search(_view(spark, d), EXACT))


def graph_search(spark, d):
    return _flat(retrieval.graph_search(_view(spark, d), ASKED))


def temporal_search(spark, d):
    return _flat(retrieval.temporal_search(_view(spark, d), ASKED, AS_OF))


def dense_search(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return _flat(retrieval.dense_search_all(e, e.where("id % 100 = 0")))


def auto_search(spark, d):
    q = ASKED["q1"]
    v = _view(spark, d)
    parts = {m: {"lexical": retrieval.lexical_search, "graph": retrieval.graph_search, "grep": retrieval.grep_search}[m](v, {"q": q}, 10) for m in retrieval.route(q)}
    return _flat(retrieval.fuse(parts))


def exact_auto_search(spark, d):
    return _flat(retrieval.search(_view(spark, d), "'Blue Harbor'", "auto"))


def normalized_search(spark, d):
    return _flat(retrieval.normalized_search(_view(spark, d), {"n1": "the budget of the gateway: retention, and drift.", "n2": "Do not merge before ranking"}))


#: Hits of made queries: clear, weak, close to the second, alone, alone and weak, equal to the bounds.
MADE_HITS = [("h1", "a", 20.0, 1), ("h1", "b", 10.0, 2), ("h2", "a", 7.9, 1), ("h2", "b", 1.0, 2), ("h3", "a", 11.4, 1), ("h3", "b", 10.0, 2), ("h4", "a", 9.0, 1), ("h5", "a", 3.0, 1), ("h6", "a", 8.0, 1), ("h6", "b", 4.0, 2)]


def confident_hit(spark, d):
    """Of the queries of the ledger, and of made ones that fail at the score or at the margin."""
    made = spark.createDataFrame(MADE_HITS, "query_id string, id string, score double, rank int")
    hits = retrieval.lexical_search(_view(spark, d), ASKED, 2).select("query_id", "id", "score", "rank").unionByName(made)
    return retrieval.confident_top_hit(hits).select("query_id", "id", F.round("score", ROUNDED).alias("score"))


def exact_value_target(spark, d):
    q = {"v1": "delete lib-19 and rc-00000", "v2": "the Orchid Ledger board is gone", "v3": "Blue Harbor or nobody_7"}
    return retrieval.exact_value_target(_view(spark, d), q).select("query_id", "id", F.col("kind").cast("long").alias("kind"))


def recall(spark, d):
    """Hits with their citations."""
    raw = table(spark, d, "documents").select(F.concat(F.lit("raw_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("source_id"), "text")
    return integrity.recall(_view(spark, d), raw, ASKED["q1"], 10).select(F.col("rank").cast("long").alias("rank"), "id", F.round("score", ROUNDED).alias("score"), "label", "quote", "source_id", "char_start", "char_end", "cited")


def forget_by_query(spark, d):
    """T9."""
    return mutate.forget_by_query(_view(spark, d), ASKED["q1"])


def pack_active(spark, d):
    return pack.active_part(nodes(spark, d), ASKED["q1"], 12, 1500).select(F.col("pos").cast("long").alias("pos"), "id", "n_chars", "used_chars")


def pack_no_query(spark, d):
    return pack.active_part(nodes(spark, d), "", 12, 1500).select(F.col("pos").cast("long").alias("pos"), "id", "n_chars", "used_chars")


def pack_suppressed(spark, d):
    n = nodes(spark, d)
    return pack.suppressed_part(n, pack.active_part(n, ASKED["q1"], 12, 1500), 3000).select(F.col("pos").cast("long").alias("pos"), "id", "status", "preview")


def pack_record(spark, d):
    """K1."""
    return pack.pack_record(nodes(spark, d), ASKED["q1"], 12, 3000).select("section", "pos", "id", "status", "used_chars")


def pack_sections(spark, d):
    return pack.render_sections(pack.pack_record(nodes(spark, d), ASKED["q1"], 12, 3000))


def pack_render(spark, d):
    return pack.render_markdown(pack.active_part(nodes(spark, d), ASKED["q1"], 12, 1500))


def pack_render_toml(spark, d):
    return pack.render_toml(pack.active_part(nodes(spark, d), ASKED["q1"], 12, 1500), ASKED["q1"])


def sparse_keys(spark, d):
    return nodes(spark, d).select("id", F.array_join(text.default_sparse_keys(F.col("tags"), F.col("content")), " ").alias("keys"))


def proper_names_and_codes(spark, d):
    return nodes(spark, d).select("id", F.array_join(text.proper_noun_pairs(F.col("content")), "|").alias("names"), F.array_join(text.code_spans(F.col("content")), "|").alias("codes"))


def detached_punctuation(spark, d):
    return nodes(spark, d).select("id", text.detach_punctuation(F.col("content")).alias("content"))


QUERIES = {f.__name__: f for f in (
    effective_view, view_with_session, scope_precedence, suppressed_nodes, conflict_nodes, forgotten_like_nodes, retired_targets, unknown_operations, status_counts, point_lookup, tokenize, term_freq, doc_freq, lexical_search, lexical_join, grep_search, graph_search,
    temporal_search, dense_search, auto_search, exact_auto_search, normalized_search, confident_hit, exact_value_target, recall, forget_by_query, pack_active, pack_no_query, pack_suppressed, pack_record, pack_sections, pack_render, pack_render_toml, sparse_keys, proper_names_and_codes, detached_punctuation,
)}

#: Common table expressions of the SQL.
N = """n AS (SELECT * EXCLUDE (rn), epoch(created_at::TIMESTAMPTZ)::BIGINT AS created_s, epoch(updated_at::TIMESTAMPTZ)::BIGINT AS updated_s, epoch(effective_from::TIMESTAMPTZ)::BIGINT AS from_s, epoch(effective_until::TIMESTAMPTZ)::BIGINT AS until_s
  FROM (SELECT * REPLACE (coalesce(content, '') AS content), row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM memory_nodes) WHERE rn = 1)"""
P = """p AS (SELECT * EXCLUDE (rn), epoch(created_at::TIMESTAMPTZ)::BIGINT AS created_s, epoch(applied_at::TIMESTAMPTZ)::BIGINT AS applied_s
  FROM (SELECT * REPLACE (lower(trim(operation, E' \\t\\n\\r')) AS operation), row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM memory_patches) WHERE rn = 1)"""
E = """e AS (SELECT * EXCLUDE (rn), epoch(created_at::TIMESTAMPTZ)::BIGINT AS created_s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM memory_edges) WHERE rn = 1)"""
RETIRED = f"retired AS (SELECT DISTINCT id FROM (SELECT unnest(target_ids) AS id FROM p WHERE operation IN {ledger.RETIRING}) WHERE id IS NOT NULL AND id <> '')"
SESSION = "(SELECT min(scope.session) FROM n WHERE status = 'active_session')"


def view_sql(name: str, live: str, session: str | None = None) -> str:
    """The effective view as a common table expression."""
    own = f"WHEN status = 'active_session' AND scope.session = {session} THEN 4 " if session else ""
    return f"""{name}_r AS (SELECT *, CASE {own}WHEN coalesce(scope.project, '') <> '' THEN 3 WHEN coalesce(scope.workspace, '') <> '' THEN 2 ELSE 1 END AS scope_rank FROM n WHERE {live}),
{name}_w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY scope_rank DESC, coalesce(updated_s, -4611686018427387904) DESC, id) AS won, min(id) OVER (PARTITION BY key) AS first_id FROM {name}_r),
{name} AS (SELECT * EXCLUDE (won, first_id), CASE WHEN coalesce(key, '') = '' THEN '0' || id ELSE '1' || first_id END AS view_ord FROM {name}_w WHERE coalesce(key, '') = '' OR won = 1)"""


V = view_sql("v", "status = 'active'")
DOC = "content || ' ' || array_to_string(coalesce(list_filter(tags, lambda t: t IS NOT NULL), []), ' ')"
TOKENS = "[A-Za-z0-9_./:-]+|[가-힣]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rows_sql(rows: list[tuple]) -> str:
    """Rows of a VALUES clause."""
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else quoted(x)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def lexical_sql(corpus: str, queries: dict[str, str], content: str = "content", name: str = "l") -> str:
    """Scores of all hits as the common table expression name(query_id, id, updated_s, score, reasons)."""
    rows = ", ".join(f"({quoted(q)}, {quoted(t)}, {quoted(x)})" for q, x in queries.items() for t in text.tokens_of(x))
    asked = ", ".join(f"({quoted(q)}, {quoted(x.lower())})" for q, x in queries.items())
    doc = DOC.replace("content", content, 1)
    return f"""{name}_q(query_id, term, query) AS (VALUES {rows}),
{name}_t AS (SELECT id, updated_s, lower(unnest(regexp_extract_all({doc}, '{TOKENS}'))) AS term FROM {corpus}),
{name}_tf AS (SELECT id, updated_s, term, count(*) AS tf FROM {name}_t GROUP BY ALL),
{name}_df AS (SELECT term, ln(((SELECT greatest(1, count(*)) FROM {corpus}) + 1)::DOUBLE / (count(*) + 0.5)::DOUBLE) + 1 AS idf FROM {name}_tf GROUP BY term),
{name}_p(query_id, query) AS (VALUES {asked}),
{name}_s AS (SELECT q.query_id, t.id, t.updated_s, (t.tf * d.idf)::DOUBLE AS part, t.term AS reason FROM {name}_tf t JOIN {name}_q q ON q.term = t.term JOIN {name}_df d ON d.term = t.term
  UNION ALL SELECT p.query_id, c.id, c.updated_s, 5.0, 'phrase' FROM {corpus} c JOIN {name}_p p ON contains(lower({content}), p.query)),
{name} AS (SELECT query_id, id, updated_s, round(sum(part), 9) AS score, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM {name}_s GROUP BY ALL)"""


def top_sql(source: str, limit: int, order: str = "score DESC, updated_s DESC, id DESC") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {limit})"


RESULT = "SELECT query_id, id, round(score, 6) AS score, rank, reasons"
_GRAPH = "".join(f"{' UNION ALL ' if k else ''}SELECT query_id, rank AS seed_rank, score, {k} AS rel_pos, generate_subscripts(relations['{r}'], 1) AS pos, '{r}' AS relation, unnest(relations['{r}']) AS nb FROM seeds JOIN v USING (id)" for k, r in enumerate(retrieval.RELATIONS))


def graph_sql(queries: dict[str, str]) -> str:
    return f"""{lexical_sql("v", queries)}, seeds AS (FROM {top_sql("l", 10)}),
reach AS ({_GRAPH}),
firsts AS (SELECT query_id, nb, arg_min(struct_pack(relation, score), (seed_rank, rel_pos, pos)) AS m FROM reach GROUP BY ALL),
g AS (SELECT query_id, id, updated_s, score, reasons FROM seeds UNION ALL SELECT f.query_id, v.id, v.updated_s, f.m.score * 0.5, 'graph:' || f.m.relation FROM firsts f JOIN v ON v.id = f.nb WHERE NOT EXISTS (FROM seeds s WHERE s.query_id = f.query_id AND s.id = v.id))"""


_NORM = {k: text.normalized_query(q) for k, q in {"n1": "the budget of the gateway: retention, and drift.", "n2": "Do not merge before ranking"}.items()}
_PACK = f"""{lexical_sql("v", {"q": ASKED["q1"]})},
sel AS (SELECT h.rank, v.id, v.content, length(v.content) AS n_chars FROM {top_sql("l", 12)} h JOIN v USING (id)),
ap AS (SELECT *, sum(n_chars) OVER (ORDER BY rank) AS run FROM sel),
act AS (SELECT row_number() OVER (ORDER BY rank) AS pos, id, content, n_chars::BIGINT AS n_chars, sum(n_chars) OVER (ORDER BY rank)::BIGINT AS used_chars FROM ap WHERE rank = 1 OR run <= 1500)"""
_QUOTE = "'\"' || replace(replace(replace({c}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), chr(10), '\\\\n') || '\"'"
_DENSE_ORDER = "score DESC, id ASC"

SQL = {
    "effective_view": f"WITH {N}, {P}, {RETIRED}, {view_sql('v', "status = 'active' AND id NOT IN (FROM retired)")} SELECT id, key, scope_rank FROM v",
    "view_with_session": f"WITH {N}, {P}, {RETIRED}, {view_sql('v', f'''(status = 'active' OR (status = 'active_session' AND scope.session = {SESSION})) AND id NOT IN (FROM retired)''', SESSION)} SELECT id, key, scope_rank FROM v",
    "scope_precedence": f"WITH {N}, {V} SELECT id, key, scope_rank, view_ord FROM v",
    "suppressed_nodes": f"WITH {N} SELECT id, status FROM n WHERE status NOT IN ('active', 'active_session')",
    "conflict_nodes": f"WITH {N} SELECT id, status FROM n WHERE status = 'conflict_pending'",
    "forgotten_like_nodes": f"WITH {N} SELECT id, status FROM n WHERE status IN {ledger.FORGOTTEN_LIKE}",
    "retired_targets": f"WITH {P}, {RETIRED} SELECT id FROM retired",
    "unknown_operations": f"WITH {P} SELECT id, operation FROM p WHERE operation NOT IN {ledger.PATCH_OPERATIONS}",
    "status_counts": f"WITH {N} SELECT count(*) FILTER (WHERE status = 'active') AS n_active, count(*) FILTER (WHERE status NOT IN ('active', 'active_session')) AS n_suppressed, (SELECT count(DISTINCT id) FROM memory_patches) AS n_patches, (SELECT count(DISTINCT id) FROM memory_edges) AS n_edges, (SELECT count(DISTINCT id) FROM agent_sessions) AS n_sessions FROM n",
    "point_lookup": f"WITH {N} SELECT id, type, status, content FROM n WHERE id = (SELECT max(id) FROM n)",
    "tokenize": f"WITH {N} SELECT id, array_to_string(list_transform(regexp_extract_all(content, '{TOKENS}'), lambda t: lower(t)), ' ') AS tokens FROM n",
    "term_freq": f"WITH {N}, t AS (SELECT id, lower(unnest(regexp_extract_all({DOC}, '{TOKENS}'))) AS term FROM n) SELECT id, term, count(*) AS tf FROM t GROUP BY ALL",
    "doc_freq": f"WITH {N}, t AS (SELECT id, lower(unnest(regexp_extract_all({DOC}, '{TOKENS}'))) AS term FROM n) SELECT term, count(DISTINCT id) AS df FROM t GROUP BY ALL",
    "lexical_search": f"WITH {N}, {V}, {lexical_sql('v', ASKED)} {RESULT} FROM {top_sql('l', 10)}",
    "grep_search": f"""WITH {N}, {V}, q(query_id, needle) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(x.casefold())})" for k, x in EXACT.items())}),
h AS (SELECT query_id, id, updated_s, 1.0::DOUBLE AS score, 'exact' AS reasons FROM v JOIN q ON contains(replace(lower(content), 'ß', 'ss'), needle) OR contains(lower(id), needle) OR coalesce(list_bool_or(list_transform(tags, lambda t: contains(lower(t), needle))), false)) {RESULT} FROM {top_sql("h", 20, "id")}""",
    "graph_search": f"WITH {N}, {V}, {graph_sql(ASKED)} {RESULT} FROM {top_sql('g', 10)}",
    "temporal_search": f"""WITH {N}, {V}, held AS (FROM v WHERE (from_s IS NULL OR from_s <= {AS_OF}) AND (until_s IS NULL OR until_s > {AS_OF})), {lexical_sql("held", ASKED)},
t AS (SELECT p.query_id, h.id, h.updated_s, coalesce(l.score, 0) + coalesce(coalesce(h.updated_s, h.created_s)::DOUBLE / 1e12, 0) AS score, 'temporal' AS reasons FROM held h CROSS JOIN l_p p LEFT JOIN l ON l.query_id = p.query_id AND l.id = h.id) {RESULT} FROM {top_sql("t", 10)}""",
    "dense_search": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql("s", 10, _DENSE_ORDER)}""",
    "auto_search": f"""WITH {N}, {V}, {graph_sql({"q": ASKED["q1"]})}, f AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS pos, 'lexical' AS mode FROM seeds UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank), 1, 'graph' FROM {top_sql("g", 10)}),
x AS (SELECT query_id, id, sum(part) AS score, array_to_string(list(mode ORDER BY pos), ',') AS reasons FROM f GROUP BY ALL) {RESULT} FROM {top_sql("x", 10, "score DESC, id DESC")}""",
    "exact_auto_search": f"""WITH {N}, {V}, {lexical_sql("v", {"q": "'Blue Harbor'"})}, h AS (SELECT 'q' AS query_id, id, updated_s FROM v WHERE contains(replace(lower(content), 'ß', 'ss'), '''blue harbor''')),
f AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS pos, 'grep' AS mode FROM {top_sql("h", 10, "id")} UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank), 1, 'lexical' FROM {top_sql("l", 10)}),
x AS (SELECT query_id, id, sum(part) AS score, array_to_string(list(mode ORDER BY pos), ',') AS reasons FROM f GROUP BY ALL) {RESULT} FROM {top_sql("x", 10, "score DESC, id DESC")}""",
    "normalized_search": f"WITH {N}, {V}, d AS (SELECT * REPLACE (regexp_replace(content, '([A-Za-z0-9][A-Za-z0-9_/:-]{{3,}})([.,;:])(\\s|$)', '\\1 \\2\\3', 'g') AS content) FROM v), {lexical_sql('d', _NORM)} {RESULT} FROM {top_sql('l', 10)}",
    "lexical_join": f"""WITH {N}, {V}, q AS (SELECT DISTINCT principal_id AS query_id, display_name AS query FROM principals WHERE principal_id IS NOT NULL AND display_name IS NOT NULL), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, lower(unnest(regexp_extract_all(query, '{TOKENS}'))) AS term FROM q) GROUP BY ALL),
tf AS (SELECT id, updated_s, term, count(*) AS tf FROM (SELECT id, updated_s, lower(unnest(regexp_extract_all({DOC}, '{TOKENS}'))) AS term FROM v) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, ln(((SELECT greatest(1, count(*)) FROM v) + 1)::DOUBLE / (count(*) + 0.5)::DOUBLE) + 1 AS idf FROM tf GROUP BY term),
h AS (SELECT query_id, tf.id, tf.updated_s, sum(tf * times * idf) AS s FROM tf JOIN qt USING (term) JOIN df USING (term) GROUP BY ALL),
l AS (SELECT h.query_id, h.id, h.updated_s, round(s + CASE WHEN contains(lower(v.content), lower(q.query)) THEN 5 ELSE 0 END, 9) AS score FROM h JOIN v USING (id) JOIN q USING (query_id))
SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('l', 5)}""",
    "recall": f"""WITH {N}, {V}, {lexical_sql('v', {"q": ASKED["q1"]})}, h AS (FROM {top_sql('l', 10)}), r AS (SELECT 'raw_' || lpad(doc_id::VARCHAR, 6, '0') AS source_id, left(text, 500) AS cited FROM documents),
s AS (SELECT h.rank, n.id, h.score, coalesce(CASE WHEN source.label <> '' THEN source.label END, 'session:' || source.session_ids[1], 'unknown') AS label, source.quote AS quote, unnest(CASE WHEN len(source.raw_spans) > 0 THEN source.raw_spans ELSE [NULL] END) AS s FROM h JOIN n ON n.id = h.id)
SELECT rank::BIGINT AS rank, id, round(score, 6) AS score, label, quote, s.source_id AS source_id, s.char_start AS char_start, s.char_end AS char_end, cited FROM s LEFT JOIN r ON r.source_id = s.s.source_id""",
    "forget_by_query": f"WITH {N}, {V}, {lexical_sql('v', {'q': ASKED['q1']})} SELECT id, 'forgotten' AS status FROM {top_sql('l', 1)}",
    "confident_hit": f"WITH {N}, {V}, {lexical_sql('v', ASKED)}, h AS (SELECT query_id, id, score, rank FROM {top_sql('l', 2)} UNION ALL SELECT * FROM (VALUES {rows_sql(MADE_HITS)}) m(query_id, id, score, rank)) SELECT a.query_id, a.id, round(a.score, 6) AS score FROM h a LEFT JOIN h b ON b.query_id = a.query_id AND b.rank = 2 WHERE a.rank = 1 AND a.score >= 8 AND (b.score IS NULL OR a.score >= b.score * 1.15)",
    "exact_value_target": f"""WITH {N}, {V}, s(query_id, kind, span) AS (VALUES ('v1', 0, 'lib-19'), ('v1', 0, 'rc-00000'), ('v2', 1, 'orchid ledger'), ('v3', 0, 'nobody_7'), ('v3', 1, 'blue harbor')),
h AS (SELECT query_id, kind, id FROM v JOIN s ON contains(lower(content), span)) SELECT query_id, id, kind::BIGINT AS kind FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY kind, id) = 1""",
    "pack_active": f"WITH {N}, {V}, {_PACK} SELECT pos, id, n_chars, used_chars FROM act",
    "pack_no_query": f"WITH {N}, {V}, s AS (SELECT row_number() OVER (ORDER BY view_ord, id) AS rank, id, length(content) AS n_chars FROM v QUALIFY rank <= 12), r AS (SELECT *, sum(n_chars) OVER (ORDER BY rank) AS run FROM s) SELECT rank AS pos, id, n_chars::BIGINT AS n_chars, run::BIGINT AS used_chars FROM r WHERE rank = 1 OR run <= 1500",
    "pack_suppressed": f"""WITH {N}, {V}, {_PACK}, s AS (SELECT id, status, left(content, 240) AS preview FROM n WHERE status NOT IN ('active', 'active_session')), r AS (SELECT *, row_number() OVER (ORDER BY id) AS pos, sum(length(preview)) OVER (ORDER BY id) AS run FROM s)
SELECT pos, id, status, preview FROM r WHERE pos = 1 OR (SELECT coalesce(max(used_chars), 0) FROM act) + run <= 3000""",
    "pack_render": f"WITH {N}, {V}, {_PACK} SELECT string_agg('- [' || id || '] ' || regexp_replace(content, '\\s+', ' ', 'g'), chr(10) ORDER BY pos) AS text FROM act",
    "pack_render_toml": f"WITH {N}, {V}, {_PACK} SELECT 'query = ' || {_QUOTE.format(c=quoted(ASKED['q1']))} || chr(10) || chr(10) || string_agg('[[memory]]' || chr(10) || 'id = ' || {_QUOTE.format(c='id')} || chr(10) || 'content = ' || {_QUOTE.format(c='content')}, chr(10) || chr(10) ORDER BY pos) AS text FROM act",
    "sparse_keys": f"""WITH {N}, w AS (SELECT id, tags, list_transform(regexp_split_to_array(content, '\\s+'), lambda x: lower(regexp_replace(x, '^[.,:;()\\[\\]{{}}]+|[.,:;()\\[\\]{{}}]+$', '', 'g'))) AS ws FROM n)
SELECT id, array_to_string(list_slice(list_sort(list_distinct(list_concat(coalesce(tags, []), list_filter(ws, lambda x: length(x) > 2)))), 1, 24), ' ') AS keys FROM w""",
    "detached_punctuation": f"WITH {N} SELECT id, regexp_replace(content, '([A-Za-z0-9][A-Za-z0-9_/:-]{{3,}})([.,;:])(\\s|$)', '\\1 \\2\\3', 'g') AS content FROM n",
}

"""Queries of mutation, integrity and indexes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import index, integrity, mutate, view
from ledgerloom.operators.integrity import EDGE_TYPES, NODE_TYPES
from ledgerloom.operators.ledger import NODE_STATUSES, PATCH_OPERATIONS, REPLACING, RETIRING, SESSION_STATUSES, edges, nodes, patches, sessions
from ledgerloom.plans import cases
from ledgerloom.plans.retrieval import AS_OF, DOC, E, N, P, TOKENS, V, rows_sql
from ledgerloom.session import table

ALL_REPLACING = ("update", "supersede", "refine", "expand", "narrow", "merge", "split", "resolve_conflict")


def patch_status_ops(s, d):
    return mutate.status_patches(nodes(s, d), patches(s, d))


def patch_replace_ops(s, d):
    return mutate.replacement_nodes(nodes(s, d), patches(s, d)).withColumns({"tags": F.array_join("tags", ","), "targets": F.array_join("targets", ",")})


def patch_edges(s, d):
    return mutate.replacement_edges(nodes(s, d), patches(s, d))


def patch_replay(s, d):
    return mutate.replay(nodes(s, d), patches(s, d))


def patch_replay_asof(s, d):
    return mutate.replay(nodes(s, d), patches(s, d), AS_OF)


def status_history(s, d):
    return mutate.status_history(nodes(s, d), patches(s, d))


def rollback(s, d):
    return mutate.rollback(nodes(s, d), patches(s, d))


def rolled_back_links(s, d):
    return mutate.rolled_back_links(nodes(s, d), patches(s, d)).withColumn("superseded_by", F.array_join(F.array_sort("superseded_by"), ","))


def rollback_patches(s, d):
    return mutate.rollback_patches(patches(s, d)).withColumns({"target_ids": F.array_join("target_ids", ","), "new_node_ids": F.array_join("new_node_ids", ",")})


def reactivated(s, d):
    return mutate.reactivated(nodes(s, d), patches(s, d))


def new_nodes(s, d):
    """A node of each document that has text, with its source as label."""
    docs = table(s, d, "documents").select(F.col("text").alias("content"), F.struct(F.col("source").alias("label")).alias("source"), "doc_id").where("source.label is not null")
    return mutate.new_nodes(docs).select("doc_id", "id", "status", F.length("content").cast("long").alias("n_chars"))


def patch_diff(s, d):
    return mutate.patch_diff(nodes(s, d), patches(s, d))


def session_end_promote(s, d):
    return mutate.end_sessions(nodes(s, d), "promote")


def session_end_discard(s, d):
    return mutate.end_sessions(nodes(s, d), "discard")


def session_merge(s, d):
    return mutate.merge_sessions(nodes(s, d))


def session_fork(s, d):
    return mutate.fork_sessions(sessions(s, d).where("status = 'active'")).withColumn("loaded_memory_ids", F.array_join("loaded_memory_ids", ","))


def session_start_once(s, d):
    """Sessions named by documents, and made ones, that do not exist yet."""
    wanted = table(s, d, "documents").where("session_id is not null").select(F.col("session_id").alias("id")).unionByName(s.createDataFrame([(i,) for i in cases.WANTED_SESSIONS], "id string"))
    return mutate.start_sessions(sessions(s, d), wanted)


def _remote(s, d) -> DataFrame:
    """A second ledger: some nodes are new, some changed, some equal."""
    n = nodes(s, d).where(F.substring("id", 5, 1) < "8")
    new = F.substring("id", 6, 1) < "4"
    changed = F.substring("id", 6, 1).between("4", "7")
    return n.withColumn("content", F.when(changed, F.concat("content", F.lit(" (changed)"))).otherwise(F.col("content"))).withColumn("id", F.when(new, F.concat(F.lit("mem_r"), F.substring("id", 6, 11))).otherwise(F.col("id")))


def import_merge(s, d):
    return mutate.import_nodes(nodes(s, d), _remote(s, d), "peer")


def import_counts(s, d):
    return import_merge(s, d).groupBy("outcome").agg(F.count("*").alias("n"))


def id_remap(s, d):
    return mutate.remap_edges(edges(s, d), import_merge(s, d))


def import_nodes(s, d):
    """The ledger after the import."""
    landed = import_merge(s, d)
    return mutate.merged_nodes(nodes(s, d), _remote(s, d), landed, "peer").withColumn("contradicts", F.array_join("contradicts", ","))


def import_patches(s, d):
    """All patches, as the other ledger's, under the ids their nodes landed on."""
    return mutate.remap_patches(patches(s, d), import_merge(s, d)).withColumns({"target_ids": F.array_join("target_ids", ","), "new_node_ids": F.array_join("new_node_ids", ",")})


def export_slice(s, d):
    """The part of the ledger that belongs to any session that has ended."""
    chosen = sessions(s, d).where("status = 'ended'").select("id")
    out = None
    for kind, df in mutate.export_slice(nodes(s, d), patches(s, d), edges(s, d), sessions(s, d), chosen).items():
        one = df.select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def push_select(s, d):
    return mutate.push_selection(nodes(s, d), "workspace", "ws_01").select("id", "content")


def validate_nodes(s, d):
    return integrity.validate_nodes(nodes(s, d))


def validate_patches(s, d):
    return integrity.validate_patches(patches(s, d))


def validate_edges(s, d):
    made = s.createDataFrame(cases.BAD_EDGES, "id string, schema_version string, type string")
    return integrity.validate_edges(edges(s, d).select("id", "schema_version", "type").unionByName(made))


def validate_edge_ends(s, d):
    return integrity.validate_edge_ends(edges(s, d), nodes(s, d), patches(s, d))


def validate_records(s, d):
    return integrity.validate_records(s.createDataFrame(cases.FILES, "path string, value string"))


def validate_sessions(s, d):
    made = s.createDataFrame(cases.BAD_SESSIONS, "id string, schema_version string, status string, started_at string")
    return integrity.validate_sessions(sessions(s, d).select("id", "schema_version", "status", "started_at").unionByName(made))


def dangling_refs(s, d):
    return integrity.dangling(nodes(s, d), patches(s, d), edges(s, d))


def stale_active(s, d):
    return integrity.stale_active(nodes(s, d))


def audit_findings(s, d):
    return integrity.audit(nodes(s, d), patches(s, d), edges(s, d), sessions(s, d))


def _raw(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.concat(F.lit("raw_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("source_id"), "text")


def citations(s, d):
    return integrity.citations(nodes(s, d), _raw(s, d))


def forbidden_keys(s, d):
    made = s.createDataFrame(cases.BAD_JSON, "id string, metadata string")
    return integrity.forbidden_keys(nodes(s, d).select("id", "metadata").unionByName(made), "metadata").select("id")


def postings(s, d):
    return index.postings(view.effective_view(nodes(s, d))).withColumn("ids", F.array_join("ids", ","))


def day_buckets(s, d):
    return index.day_buckets(view.effective_view(nodes(s, d))).withColumn("ids", F.array_join("ids", ","))


def adjacency(s, d):
    return index.adjacency(nodes(s, d)).withColumn("targets", F.array_join("targets", ","))


def ntriples(s, d):
    return index.ntriples(nodes(s, d))


def index_summary(s, d):
    return index.index_summary(nodes(s, d), view.effective_view(nodes(s, d)))


def source_labels(s, d):
    return nodes(s, d).select("id", integrity.source_label(F.col("source")).alias("label"))


QUERIES = {f.__name__: f for f in (
    patch_status_ops, patch_replace_ops, patch_edges, patch_replay, patch_replay_asof, status_history, rollback, rolled_back_links, rollback_patches, reactivated, new_nodes, patch_diff, session_end_promote, session_end_discard, session_merge, session_fork, session_start_once, import_merge, import_counts, import_nodes, import_patches, id_remap,
    export_slice, push_select, validate_nodes, validate_patches, validate_edges, validate_edge_ends, validate_records, validate_sessions, dangling_refs, stale_active, audit_findings, citations, forbidden_keys, postings, day_buckets, adjacency, ntriples, index_summary, source_labels,
)}

T = "t AS (SELECT id AS patch_id, operation, created_s, unnest(target_ids) AS id, generate_subscripts(target_ids, 1) AS pos FROM p), tg AS (SELECT * FROM t WHERE id IS NOT NULL AND id <> '')"
AFTER = f"CASE WHEN operation = 'expire' THEN 'expired' WHEN operation = 'forget' THEN 'forgotten' WHEN operation = 'deprecate' THEN 'deprecated' WHEN operation IN {ALL_REPLACING} THEN 'superseded' WHEN operation IN ('create', 'rollback') THEN 'active' END"
MADE = f"""{T}, mk AS (SELECT * FROM p WHERE operation IN {ALL_REPLACING} AND coalesce(new_content, '') <> ''),
hit AS (SELECT tg.patch_id, tg.pos, n.* FROM tg JOIN mk ON mk.id = tg.patch_id JOIN n ON n.id = tg.id),
made AS (SELECT 'mem_' || left(sha256(mk.id), 12) AS id, mk.id AS patch_id, g.f.type AS type, g.f.key AS key, g.f.ws AS workspace, g.f.pr AS project, mk.new_content AS content, mk.reason AS quote, 'patch:' || mk.id AS label, g.tags, g.targets,
  CASE mk.operation WHEN 'supersede' THEN 'supersedes' WHEN 'refine' THEN 'refines' WHEN 'expand' THEN 'expands' WHEN 'narrow' THEN 'narrows' WHEN 'merge' THEN 'derived_from' WHEN 'split' THEN 'derived_from' WHEN 'resolve_conflict' THEN 'resolves' END AS relation
  FROM mk JOIN (SELECT patch_id, arg_min(struct_pack(type := type, key := key, ws := scope.workspace, pr := scope.project), pos) AS f, list_sort(list_distinct(flatten(list(coalesce(tags, []))))) AS tags, list_sort(list_distinct(list(id))) AS targets FROM hit GROUP BY patch_id) g ON g.patch_id = mk.id)"""
_SAME = " AND ".join([f"r.{f} IS NOT DISTINCT FROM l.{f}" for f in ("type", "key", "content", "status", "confidence", "priority", "tags", "source", "retrieval", "metadata")] + [f'r.scope."{f}" IS NOT DISTINCT FROM l.scope."{f}"' for f in ("user", "workspace", "project", "agent", "session")])
IMPORT = f"""rm AS (SELECT * REPLACE (CASE WHEN substr(id, 6, 1) < '4' THEN 'mem_r' || substr(id, 6, 11) ELSE id END AS id, CASE WHEN substr(id, 6, 1) BETWEEN '4' AND '7' THEN content || ' (changed)' ELSE content END AS content) FROM n WHERE substr(id, 5, 1) < '8'),
oc AS (SELECT r.id, CASE WHEN l.id IS NULL THEN 'imported' WHEN {_SAME} THEN 'skipped' ELSE 'conflict' END AS outcome FROM rm r LEFT JOIN n l ON l.id = r.id),
im AS (SELECT id, outcome, CASE WHEN outcome = 'conflict' THEN 'mem_' || left(sha256('peer/' || id), 12) ELSE id END AS landed_id FROM oc)"""
DANGLING = """kn AS (SELECT DISTINCT id FROM n), rl AS (SELECT id, unnest(map_entries(relations)) AS x FROM n), rf AS (
  SELECT 'node' AS kind, id, x.key AS field, unnest(x.value) AS ref_id FROM rl
  UNION SELECT 'patch', id, 'target_ids', unnest(target_ids) FROM p UNION SELECT 'patch', id, 'new_node_ids', unnest(new_node_ids) FROM p
  UNION SELECT 'edge', id, 'from_id', from_id FROM e UNION SELECT 'edge', id, 'to_id', to_id FROM e),
dg AS (SELECT DISTINCT kind, id, field, ref_id FROM rf WHERE ref_id IS NOT NULL AND (ref_id <> '' OR kind = 'edge') AND ref_id NOT IN (FROM kn)
  UNION SELECT 'edge', id, 'source_patch_id', source_patch_id FROM e WHERE coalesce(source_patch_id, '') <> '' AND source_patch_id NOT IN (SELECT id FROM p))"""
_GROUNDED = "(coalesce(source.label, '') <> '' OR len(list_filter(coalesce(source.raw_spans, []), lambda s: coalesce(s.source_id, '') <> '')) > 0)"
VN = f"""vn AS (SELECT id, 'schema_version' AS problem FROM n WHERE NOT regexp_matches(coalesce(schema_version, ''), '\\.memory_node\\.v0\\.1$') UNION ALL SELECT id, 'id prefix' FROM n WHERE NOT starts_with(id, 'mem_')
  UNION ALL SELECT id, 'unknown type' FROM n WHERE coalesce(type, '') NOT IN {NODE_TYPES} UNION ALL SELECT id, 'unknown status' FROM n WHERE coalesce(status, '') NOT IN {NODE_STATUSES} UNION ALL SELECT id, 'empty content' FROM n WHERE trim(content) = ''
  UNION ALL SELECT id, 'not grounded' FROM n WHERE NOT coalesce({_GROUNDED}, false) AND coalesce(status, '') NOT IN ('active_session', 'pending', 'pending_promotion') UNION ALL SELECT id, 'relations' FROM n WHERE relations IS NULL)"""
VP = f"""vp AS (SELECT id, 'schema_version' AS problem FROM p WHERE NOT regexp_matches(coalesce(schema_version, ''), '\\.memory_patch\\.v0\\.1$') UNION ALL SELECT id, 'id prefix' FROM p WHERE NOT starts_with(id, 'patch_')
  UNION ALL SELECT id, 'unknown operation' FROM p WHERE coalesce(operation, '') NOT IN {PATCH_OPERATIONS} UNION ALL SELECT id, 'targets required' FROM p WHERE coalesce(operation, '') <> 'create' AND coalesce(len(target_ids), 0) = 0
  UNION ALL SELECT id, 'new content required' FROM p WHERE operation IN {("create", *ALL_REPLACING)} AND coalesce(new_content, '') = '')"""
VE = f"ve AS (SELECT id, 'schema_version' AS problem FROM e WHERE NOT regexp_matches(coalesce(schema_version, ''), '\\.memory_edge\\.v0\\.1$') UNION ALL SELECT id, 'id prefix' FROM e WHERE NOT starts_with(id, 'edge_') UNION ALL SELECT id, 'unknown type' FROM e WHERE coalesce(type, '') NOT IN {EDGE_TYPES})"
VS = f"vs AS (SELECT id, 'schema_version' AS problem FROM agent_sessions WHERE NOT regexp_matches(coalesce(schema_version, ''), '\\.session\\.v0\\.1$') UNION ALL SELECT id, 'unknown status' FROM agent_sessions WHERE coalesce(status, '') NOT IN {SESSION_STATUSES} UNION ALL SELECT id, 'missing started_at' FROM agent_sessions WHERE started_at IS NULL)"
STALE = "sx AS (SELECT id, unnest(relations['supersedes']) AS target_id FROM n WHERE status = 'active'), st AS (SELECT DISTINCT id, target_id FROM sx WHERE target_id IN (SELECT id FROM n WHERE status = 'active'))"
ENDED = "ended_ AS (SELECT id FROM agent_sessions WHERE status = 'ended')"
SLICE = f"""{ENDED}, want AS (SELECT unnest(loaded_memory_ids) AS id FROM agent_sessions WHERE id IN (FROM ended_) UNION SELECT id FROM n WHERE scope.session IN (FROM ended_)), pn AS (SELECT id FROM n WHERE id IN (SELECT id FROM want WHERE id IS NOT NULL))"""
BLOCK = "substr(split_part(id, '_', -1), 1, 2)"
DAY = "coalesce(strftime(to_timestamp(coalesce(from_s, created_s)) AT TIME ZONE 'UTC', '%Y-%m-%d'), '')"
_LABEL = "coalesce(CASE WHEN source.label <> '' THEN source.label END, 'session:' || source.session_ids[1], 'unknown')"
_LIT = "'\"' || replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'"

SQL = {
    "patch_status_ops": f"WITH {N}, {P}, {T} SELECT DISTINCT tg.patch_id, tg.id, {AFTER.replace('operation', 'tg.operation')} AS status, n.status AS prior_status FROM tg JOIN n ON n.id = tg.id WHERE tg.operation IN ('expire', 'forget', 'deprecate')",
    "patch_replace_ops": f"WITH {N}, {P}, {MADE} SELECT * REPLACE (array_to_string(tags, ',') AS tags, array_to_string(targets, ',') AS targets) FROM made",
    "patch_edges": f"WITH {N}, {P}, {MADE} SELECT id AS from_id, unnest(targets) AS to_id, coalesce(relation, 'derived_from') AS type, patch_id AS source_patch_id FROM made",
    "patch_replay": f"WITH {N}, {P}, {T}, l AS (SELECT id, max((created_s, patch_id, {AFTER})) AS m FROM tg WHERE {AFTER} IS NOT NULL GROUP BY id) SELECT n.id, coalesce(l.m[3], n.status) AS status, l.m[2] AS by_patch FROM n LEFT JOIN l ON l.id = n.id",
    "patch_replay_asof": f"WITH {N}, {P}, {T}, l AS (SELECT id, max((created_s, patch_id, {AFTER})) AS m FROM tg WHERE {AFTER} IS NOT NULL AND created_s <= {AS_OF} GROUP BY id) SELECT n.id, coalesce(l.m[3], n.status) AS status, l.m[2] AS by_patch FROM n LEFT JOIN l ON l.id = n.id",
    "status_history": f"""WITH {N}, {P}, {T}, h AS (SELECT DISTINCT id, patch_id, created_s, {AFTER} AS st FROM tg WHERE {AFTER} IS NOT NULL)
SELECT h.id, patch_id, st AS status, coalesce(lag(st) OVER w, n.status) AS prior_status, h.created_s AS valid_from_s, lead(h.created_s) OVER w AS valid_until_s FROM h JOIN n ON n.id = h.id WINDOW w AS (PARTITION BY h.id ORDER BY h.created_s, patch_id)""",
    "rollback": f"""WITH {N}, {P}, m AS (SELECT * FROM p), b AS (SELECT id AS patch_id, prior_states, unnest(target_ids) AS nid FROM m), u AS (SELECT patch_id, nid, coalesce(prior_states[nid], 'active') AS status, 0 AS step FROM b UNION ALL SELECT id, unnest(new_node_ids), 'discarded', 1 FROM m)
SELECT patch_id, nid AS id, max((step, status))[2] AS status FROM u WHERE nid IN (SELECT id FROM n) GROUP BY ALL""",
    "rolled_back_links": f"""WITH {N}, {P}, h AS (SELECT DISTINCT id AS patch_id, coalesce(new_node_ids, []) AS made, unnest(target_ids) AS id FROM p)
SELECT h.patch_id, h.id, array_to_string(list_sort(list_distinct(list_filter(n.relations['superseded_by'], lambda x: NOT list_contains(list_filter(h.made, lambda y: y IS NOT NULL AND y <> ''), x)))), ',') AS superseded_by FROM h JOIN n ON n.id = h.id WHERE len(n.relations['superseded_by']) > 0""",
    "rollback_patches": f"WITH {P} SELECT 'patch_' || left(sha256(id || '/rollback'), 12) AS id, 'rollback' AS operation, array_to_string(list_filter(coalesce(target_ids, []), lambda x: x <> ''), ',') AS target_ids, '' AS new_node_ids, 'rollback of ' || id AS reason, id AS rolled_back FROM p",
    "reactivated": f"WITH {N}, {P}, {T} SELECT DISTINCT tg.patch_id, tg.id, 'active' AS status, 'derived_from' AS type FROM tg JOIN p ON p.id = tg.patch_id JOIN n ON n.id = tg.id WHERE p.operation IN ('create', 'rollback') AND coalesce(p.new_content, '') <> ''",
    "patch_diff": f"WITH {N}, {P}, s AS (SELECT DISTINCT id AS patch_id, 'target' AS role, unnest(target_ids) AS nid FROM p UNION SELECT id, 'new', unnest(new_node_ids) FROM p) SELECT patch_id, role, nid AS id, n.status, n.content FROM s LEFT JOIN n ON n.id = nid WHERE nid IS NOT NULL AND nid <> ''",
    "session_end_promote": f"WITH {N} SELECT id, NULL::VARCHAR AS session_id, 'active' AS status FROM n WHERE status = 'active_session'",
    "session_end_discard": f"WITH {N} SELECT id, scope.session AS session_id, 'discarded' AS status FROM n WHERE status = 'active_session'",
    "session_merge": f"WITH {N} SELECT id, key, CASE WHEN key <> '' AND key IN (SELECT key FROM n WHERE status = 'active' AND coalesce(key, '') <> '') THEN 'conflict_pending' ELSE 'active' END AS status FROM n WHERE status = 'active_session'",
    "session_fork": "SELECT 'sess_' || left(sha256(id || '/fork'), 12) AS id, id AS parent_session_id, agent, workspace, project, 'active' AS status, 'fork' AS branch_name, array_to_string(list_filter(loaded_memory_ids, lambda x: x IS NOT NULL), ',') AS loaded_memory_ids FROM agent_sessions WHERE status = 'active'",
    "session_start_once": f"SELECT DISTINCT id FROM (SELECT session_id AS id FROM documents UNION ALL SELECT * FROM (VALUES {rows_sql([(i,) for i in cases.WANTED_SESSIONS])})) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM agent_sessions)",
    "import_merge": f"WITH {N}, {IMPORT} SELECT id, outcome, landed_id FROM im",
    "import_counts": f"WITH {N}, {IMPORT} SELECT outcome, count(*) AS n FROM im GROUP BY outcome",
    "id_remap": f"WITH {N}, {E}, {IMPORT}, mv AS (SELECT id, landed_id FROM im WHERE landed_id <> id) SELECT e.id, coalesce(a.landed_id, from_id) AS from_id, coalesce(b.landed_id, to_id) AS to_id, type FROM e LEFT JOIN mv a ON a.id = from_id LEFT JOIN mv b ON b.id = to_id",
    "export_slice": f"""WITH {N}, {P}, {E}, {SLICE} SELECT 'nodes' AS kind, id FROM pn UNION ALL SELECT 'patches', id FROM p WHERE list_has_any(coalesce(target_ids, []), (SELECT list(id) FROM pn)) OR list_has_any(coalesce(new_node_ids, []), (SELECT list(id) FROM pn))
UNION ALL SELECT 'edges', id FROM e WHERE from_id IN (FROM pn) OR to_id IN (FROM pn) UNION ALL SELECT 'sessions', id FROM ended_""",
    "push_select": f"WITH {N} SELECT id, content FROM n WHERE scope.workspace = 'ws_01' AND status = 'active'",
    "validate_nodes": f"WITH {N}, {VN} FROM vn",
    "validate_patches": f"WITH {P}, {VP} FROM vp",
    "validate_edges": f"WITH {E.replace('e AS', 'e0 AS', 1)}, e AS (SELECT id, schema_version, type FROM e0 UNION ALL SELECT * FROM (VALUES {rows_sql(cases.BAD_EDGES)})), {VE} FROM ve",
    "validate_edge_ends": f"WITH {N}, {P}, {E} SELECT id, 'unknown from' AS problem FROM e WHERE coalesce(from_id, '') NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'unknown to' FROM e WHERE coalesce(to_id, '') NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'unknown source patch' FROM e WHERE coalesce(source_patch_id, '') <> '' AND source_patch_id NOT IN (SELECT id FROM p)",
    "validate_records": f"SELECT * FROM (VALUES {rows_sql(cases.FILE_PROBLEMS)}) t(path, problem)",
    "validate_sessions": f"WITH s0 AS (SELECT id, schema_version, status, started_at FROM agent_sessions UNION ALL SELECT * FROM (VALUES {rows_sql(cases.BAD_SESSIONS)})), {VS.replace('agent_sessions', 's0')} FROM vs",
    "forbidden_keys": f"SELECT * FROM (VALUES {rows_sql([(i,) for i in cases.FORBIDDEN])}) t(id)",
    "import_nodes": f"""WITH {N}, {IMPORT}, h AS (SELECT n.id, content, CASE WHEN im.landed_id IS NULL THEN status ELSE 'conflict_pending' END AS status, list_concat(coalesce(relations['contradicts'], []), [im.landed_id]) AS c, NULL AS origin FROM n LEFT JOIN im ON im.id = n.id AND outcome = 'conflict'
  UNION ALL SELECT landed_id, content, status, list_concat(coalesce(relations['contradicts'], []), [CASE WHEN outcome = 'conflict' THEN rm.id END]), 'peer' FROM rm JOIN im ON im.id = rm.id WHERE outcome <> 'skipped')
SELECT id, content, status, coalesce(array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x IS NOT NULL))), ','), '') AS contradicts, origin FROM h""",
    "import_patches": f"""WITH {N}, {P}, {IMPORT}, mv AS (SELECT id, landed_id FROM im WHERE landed_id <> id),
r AS (SELECT id, 't' AS side, unnest(target_ids) AS ref, generate_subscripts(target_ids, 1) AS pos FROM p UNION ALL SELECT id, 'n', unnest(new_node_ids), generate_subscripts(new_node_ids, 1) FROM p),
g AS (SELECT r.id, string_agg(coalesce(landed_id, ref), ',' ORDER BY pos) FILTER (side = 't') AS t, string_agg(coalesce(landed_id, ref), ',' ORDER BY pos) FILTER (side = 'n') AS n FROM r LEFT JOIN mv ON mv.id = r.ref WHERE ref <> '' GROUP BY r.id)
SELECT p.id, coalesce(t, '') AS target_ids, coalesce(n, '') AS new_node_ids FROM p LEFT JOIN g ON g.id = p.id""",
    "dangling_refs": f"WITH {N}, {P}, {E}, {DANGLING} FROM dg",
    "stale_active": f"WITH {N}, {STALE} FROM st",
    "audit_findings": f"""WITH {N}, {P}, {E}, {VN}, {VP}, {VE}, {VS}, {DANGLING}, {STALE} SELECT 'doctor' AS finding, (SELECT count(*) FROM vn) + (SELECT count(*) FROM vp) + (SELECT count(*) FROM ve) + (SELECT count(*) FROM vs) + (SELECT count(*) FROM dg) AS n
UNION ALL SELECT 'uncited', count(*) FROM n WHERE coalesce(source.label, '') = '' AND coalesce(len(source.raw_spans), 0) = 0 UNION ALL SELECT 'stale_active', count(*) FROM st UNION ALL SELECT 'conflicts', count(*) FROM n WHERE status = 'conflict_pending'""",
    "citations": f"""WITH {N}, r AS (SELECT 'raw_' || lpad(doc_id::VARCHAR, 6, '0') AS source_id, left(text, 500) AS cited FROM documents), s AS (SELECT id, status, {_LABEL} AS label, source.quote AS quote, unnest(CASE WHEN len(source.raw_spans) > 0 THEN source.raw_spans ELSE [NULL] END) AS s FROM n)
SELECT id, status, label, quote, s.source_id AS source_id, s.char_start AS char_start, s.char_end AS char_end, cited FROM s LEFT JOIN r ON r.source_id = s.s.source_id""",
    "postings": f"WITH {N}, {V}, t AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all({DOC}, '{TOKENS}'))) AS term FROM v) SELECT term, {BLOCK} AS block, string_agg(id, ',' ORDER BY id) AS ids FROM t GROUP BY ALL",
    "day_buckets": f"WITH {N}, {V} SELECT {DAY} AS day, {BLOCK} AS block, string_agg(id, ',' ORDER BY id) AS ids FROM v GROUP BY ALL",
    "adjacency": f"WITH {N}, x AS (SELECT id, unnest(map_entries(relations)) AS e FROM n) SELECT id, e.key AS relation, array_to_string(list_filter(e.value, lambda t: t IS NOT NULL), ',') AS targets FROM x WHERE len(e.value) > 0",
    "ntriples": f"""WITH {N}, x AS (SELECT id, unnest(map_entries(relations)) AS e FROM n), y AS (SELECT id, e.key AS k, unnest(e.value) AS t FROM x), b AS (SELECT id, 'type' AS k, {_LIT.format(c="type")} AS o FROM n UNION ALL SELECT id, 'status', {_LIT.format(c="status")} FROM n UNION ALL SELECT id, 'key', {_LIT.format(c="key")} FROM n WHERE key <> '')
SELECT '<urn:ledger/' || id || '> <urn:ledger/' || k || '> ' || o || ' .' AS triple FROM b UNION ALL SELECT '<urn:ledger/' || id || '> <urn:ledger/rel/' || k || '> <urn:ledger/' || t || '> .' FROM y WHERE t IS NOT NULL""",
    "index_summary": f"WITH {N}, {V} SELECT count(*) AS active_nodes, count(DISTINCT {DAY}) AS days, (SELECT count(DISTINCT t) FROM (SELECT lower(unnest(regexp_extract_all({DOC}, '{TOKENS}'))) AS t FROM v)) AS terms, (SELECT count(*) FROM n WHERE len(list_filter(map_values(relations), lambda x: len(x) > 0)) > 0) AS linked_nodes FROM v",
    "source_labels": f"WITH {N} SELECT id, {_LABEL} AS label FROM n",
}
assert set(REPLACING) == set(ALL_REPLACING) and set(RETIRING) > set(ALL_REPLACING)

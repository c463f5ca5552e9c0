"""Queries of the general data-processing problems, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import changefeed, hierarchy, intervals, references
from ledgerloom.session import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.supersede_links(table(spark, d, "memory_nodes"), table(spark, d, "memory_edges"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, d))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    placed = hierarchy.hierarchy(_links(spark, d), with_paths=True, with_sizes=True)
    return placed.select("node_id", "root_id", "depth", F.array_join("path", "/").alias("path"), "n_descendants")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_links(spark, d), with_paths=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.node_periods(table(spark, d, "memory_nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.live_nodes(table(spark, d, "memory_patches"))


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole state with its tombstones."""
    return _state(changefeed.fold(changefeed.patch_changes(table(spark, d, "memory_patches"))))


def p4_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same state from two parts of the feed that lie mixed in time: one is folded first and is the base of the other."""
    changes = changefeed.patch_changes(table(spark, d, "memory_patches"))
    early = F.pmod(F.xxhash64("seq"), F.lit(2)) == 0
    return _state(changefeed.fold(changes.where(~early), changefeed.fold(changes.where(early))))


def _state(state: DataFrame) -> DataFrame:
    live = changefeed.live(state).select("key", F.col("seq").alias("live_seq"))
    return state.where("is_set is not null").join(live, "key", "left").select(
        F.col("key").alias("node_id"), (F.col("is_set.rank") == changefeed.INSERT).alias("is_live"), F.coalesce("live_seq", "is_set.seq").alias("patch_id")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return references.ledger_orphans(table(spark, d, "memory_nodes"), table(spark, d, "memory_patches"), table(spark, d, "memory_edges"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p7_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p4_found, p4_state, p4_resumed, p7_found, p7_report)}

_LINKS = """
known AS (SELECT DISTINCT id FROM memory_nodes),
raw_links AS (
  SELECT to_id AS child, from_id AS parent FROM memory_edges WHERE type = 'supersedes'
  UNION SELECT unnest(relations['supersedes']), id FROM memory_nodes
  UNION SELECT id, unnest(relations['superseded_by']) FROM memory_nodes),
links AS (SELECT child, min(parent) AS parent FROM raw_links WHERE child IN (FROM known) AND parent IN (FROM known) GROUP BY child),
members AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
down AS (
  SELECT id, id AS root, 0::BIGINT AS depth, id AS path FROM members WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, d.root, d.depth + 1, d.path || '/' || l.child FROM down d JOIN links l ON l.parent = d.id)
"""
_ORPHANS = """
refs AS (
  SELECT DISTINCT 'memory_patches' AS ref_table, id AS record_id, 'target_ids' AS ref_field, 'node' AS ns, unnest(target_ids) AS ref_id, epoch(created_at::TIMESTAMPTZ) AS at_s FROM memory_patches
  UNION SELECT 'memory_patches', id, 'new_node_ids', 'node', unnest(new_node_ids), epoch(created_at::TIMESTAMPTZ) FROM memory_patches
  UNION SELECT 'memory_edges', id, 'to_id', 'node', to_id, epoch(created_at::TIMESTAMPTZ) FROM memory_edges
  UNION SELECT 'memory_edges', id, 'source_patch_id', 'patch', source_patch_id, epoch(created_at::TIMESTAMPTZ) FROM memory_edges),
parents AS (
  SELECT DISTINCT 'node' AS ns, id, epoch(created_at::TIMESTAMPTZ) AS made, CASE WHEN status = 'forgotten' THEN epoch(updated_at::TIMESTAMPTZ) END AS gone FROM memory_nodes
  UNION SELECT 'patch', id, epoch(created_at::TIMESTAMPTZ), NULL FROM memory_patches),
joined AS (SELECT r.*, p.id AS pid, made, gone FROM refs r LEFT JOIN parents p ON p.ns = r.ns AND p.id = r.ref_id WHERE ref_id IS NOT NULL AND ref_id <> ''),
kinds AS (
  SELECT *, 'missing' AS kind FROM joined WHERE pid IS NULL
  UNION ALL SELECT *, 'late' FROM joined WHERE made > at_s
  UNION ALL SELECT *, 'deleted' FROM joined WHERE gone < at_s),
orphans AS (SELECT DISTINCT ref_table, record_id, ref_field, ref_id, kind, strftime(to_timestamp(at_s) AT TIME ZONE 'UTC', '%Y-%m') AS period FROM kinds)
"""
_FEED = """
p AS (SELECT id, epoch_us(created_at::TIMESTAMPTZ) AS t, lower(trim(operation, E' \\t\\n\\r')) AS op, target_ids, new_node_ids FROM memory_patches),
ev AS (
  SELECT unnest(target_ids) AS k, t, id, 0 AS r FROM p WHERE op IN ('create', 'supersede', 'merge', 'split', 'expire', 'deprecate', 'forget')
  UNION ALL SELECT unnest(new_node_ids), t, id, 1 FROM p WHERE op IN ('create', 'supersede', 'merge', 'split')
  UNION ALL SELECT unnest(target_ids), t, id, 2 FROM p WHERE op IN ('update', 'refine', 'expand', 'narrow')),
st AS (SELECT k, max((t, id, r)) FILTER (WHERE r < 2) AS s, max((t, id)) FILTER (WHERE r = 2) AS c FROM ev WHERE k IS NOT NULL AND k <> '' GROUP BY k)
"""
_SET_BY = "CASE WHEN s[3] = 1 AND c IS NOT NULL AND c > (s[1], s[2]) THEN c[2] ELSE s[2] END"

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT m.id AS node_id, coalesce(d.root, 'cycle') AS root_id, coalesce(d.depth, -1) AS depth FROM members m LEFT JOIN down d ON d.id = m.id",
    "p1_hierarchy": f"""WITH RECURSIVE {_LINKS}, beneath AS (SELECT a AS id, count(*) AS n FROM (SELECT id, unnest(string_split(path, '/')) AS a FROM down) WHERE a <> id GROUP BY a)
SELECT m.id AS node_id, coalesce(d.root, 'cycle') AS root_id, coalesce(d.depth, -1) AS depth, d.path, coalesce(b.n, 0) AS n_descendants FROM members m LEFT JOIN down d ON d.id = m.id LEFT JOIN beneath b ON b.id = m.id""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT a AS ancestor_id, id AS node_id, depth - (i - 1) AS distance FROM (SELECT id, depth, unnest(string_split(path, '/')) AS a, generate_subscripts(string_split(path, '/'), 1) AS i FROM down) WHERE a <> id""",
    "p2_found": """WITH iv AS (SELECT lower(trim(key, E' \\t\\n\\r')) AS k, epoch(effective_from::TIMESTAMPTZ)::BIGINT AS s, epoch(effective_until::TIMESTAMPTZ)::BIGINT AS e FROM memory_nodes),
ok AS (SELECT DISTINCT k, s, coalesce(e, 9000000000000) AS e FROM iv WHERE k <> '' AND s IS NOT NULL AND (e IS NULL OR e > s)),
run AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ok),
grp AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM run),
per AS (SELECT k, g, min(s) AS s, max(e) AS e FROM grp GROUP BY k, g),
nxt AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY g) AS n FROM per)
SELECT k AS node_key, 'period' AS kind, s AS start_s, CASE WHEN e = 9000000000000 THEN -1 ELSE e END AS end_s FROM per
UNION ALL SELECT k, 'gap', e, n FROM nxt WHERE n IS NOT NULL""",
    "p4_found": f"WITH {_FEED} SELECT k AS node_id, {_SET_BY} AS patch_id FROM st WHERE s[3] = 1",
    "p4_state": f"WITH {_FEED} SELECT k AS node_id, s[3] = 1 AS is_live, {_SET_BY} AS patch_id FROM st WHERE s IS NOT NULL",
    "p4_resumed": f"WITH {_FEED} SELECT k AS node_id, s[3] = 1 AS is_live, {_SET_BY} AS patch_id FROM st WHERE s IS NOT NULL",
    "p7_found": f"WITH {_ORPHANS} FROM orphans",
    "p7_report": f"WITH {_ORPHANS} SELECT ref_table, ref_field, kind, period, count(*) AS n_refs, count(DISTINCT record_id) AS n_records FROM orphans GROUP BY ALL",
}

"""Validation, reference checks, audits and citations.

Validators give one row a problem: (id, problem). Checks within a row are one expression, checks across tables are
anti joins.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ids
from ledgerloom.operators.ledger import NODE_STATUSES, PATCH_OPERATIONS, REPLACING, SESSION_STATUSES

#: Fixed values.
NODE_TYPES = (
    "preference", "identity_fact", "project_fact", "project_decision", "task", "commitment", "correction", "constraint", "tool_result",
    "artifact_reference", "code_state", "warning", "relationship", "temporal_event", "runbook", "benchmark_requirement", "security_policy", "memory",
)
EDGE_TYPES = ("supersedes", "refines", "expands", "narrows", "contradicts", "depends_on", "derived_from", "temporary_override", "source_of", "blocks", "resolves")
#: Keys that no record may hold at any depth.
FORBIDDEN_KEYS = ("org_id", "user_id", "bucket", "collection", "api_key", "apikey", "token", "access_token")


def _problems(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks.items()]))
    return rows.select("id", F.explode(found).alias("problem"))


def grounded(source: Column) -> Column:
    """V6: a label, or a raw span with a source."""
    spans = F.coalesce(source["raw_spans"], F.array().cast("array<struct<source_id:string,turn_id:string,char_start:bigint,char_end:bigint>>"))
    return (F.coalesce(source["label"], F.lit("")) != "") | F.exists(spans, lambda s: F.coalesce(s["source_id"], F.lit("")) != "")


def validate_nodes(nodes: DataFrame) -> DataFrame:
    checks = {
        "schema_version": ~F.coalesce(F.col("schema_version").rlike(r"\.memory_node\.v0\.1$"), F.lit(False)),
        "id prefix": ~F.col("id").startswith("mem_"),
        "unknown type": ~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False)),
        "unknown status": ~F.coalesce(F.col("status").isin(*NODE_STATUSES), F.lit(False)),
        "empty content": F.trim(F.col("content")) == "",
        "not grounded": ~F.coalesce(grounded(F.col("source")), F.lit(False)) & ~F.coalesce(F.col("status").isin("active_session", "pending", "pending_promotion"), F.lit(False)),
        "relations": F.col("relations").isNull(),
    }
    return _problems(nodes, checks)


def validate_patches(patches: DataFrame) -> DataFrame:
    op = F.coalesce("operation", F.lit(""))
    checks = {
        "schema_version": ~F.coalesce(F.col("schema_version").rlike(r"\.memory_patch\.v0\.1$"), F.lit(False)),
        "id prefix": ~F.col("id").startswith("patch_"),
        "unknown operation": ~op.isin(*PATCH_OPERATIONS),
        "targets required": (op != "create") & (F.coalesce(F.size("target_ids"), F.lit(0)) <= 0),
        "new content required": op.isin("create", *REPLACING) & (F.coalesce("new_content", F.lit("")) == ""),
    }
    return _problems(patches, checks)


def validate_edges(edges: DataFrame) -> DataFrame:
    checks = {
        "schema_version": ~F.coalesce(F.col("schema_version").rlike(r"\.memory_edge\.v0\.1$"), F.lit(False)),
        "id prefix": ~F.col("id").startswith("edge_"),
        "unknown type": ~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False)),
    }
    return _problems(edges, checks)


def validate_sessions(sessions: DataFrame) -> DataFrame:
    checks = {
        "schema_version": ~F.coalesce(F.col("schema_version").rlike(r"\.session\.v0\.1$"), F.lit(False)),
        "unknown status": ~F.coalesce(F.col("status").isin(*SESSION_STATUSES), F.lit(False)),
        "missing started_at": F.col("started_at").isNull(),
    }
    return _problems(sessions, checks)


def validate_pack(active: DataFrame) -> DataFrame:
    """V5: rows of a pack that are not active."""
    return _problems(active, {"non-active node": F.col("status") != "active"})


def dangling(nodes: DataFrame, patches: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, field, ref_id) of references to nodes or patches that do not exist."""
    known = nodes.select(F.col("id").alias("ref_id")).distinct()
    rel = nodes.select("id", F.explode("relations").alias("field", "refs")).select(F.lit("node").alias("kind"), "id", "field", F.explode(ids(F.col("refs"))).alias("ref_id"))
    of = lambda c: patches.select(F.lit("patch").alias("kind"), "id", F.lit(c).alias("field"), F.explode(ids(F.col(c))).alias("ref_id"))
    end = lambda c: edges.select(F.lit("edge").alias("kind"), "id", F.lit(c).alias("field"), F.col(c).alias("ref_id")).where("ref_id is not null")
    to_nodes = rel.unionByName(of("target_ids")).unionByName(of("new_node_ids")).unionByName(end("from_id")).unionByName(end("to_id"))
    to_patches = edges.where("coalesce(source_patch_id, '') <> ''").select(F.lit("edge").alias("kind"), "id", F.lit("source_patch_id").alias("field"), F.col("source_patch_id").alias("ref_id"))
    known_patches = patches.select(F.col("id").alias("ref_id")).distinct()
    return to_nodes.join(known, "ref_id", "left_anti").unionByName(to_patches.join(known_patches, "ref_id", "left_anti")).distinct()


def stale_active(nodes: DataFrame) -> DataFrame:
    """(id, target_id): active nodes that supersede a node that is still active."""
    live = nodes.where("status = 'active'")
    over = live.select("id", F.explode(ids(F.col("relations")["supersedes"])).alias("target_id"))
    return over.join(live.select(F.col("id").alias("target_id")), "target_id").select("id", "target_id").distinct()


def audit(nodes: DataFrame, patches: DataFrame, edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """V7: (finding, n): problems of all validators, uncited and stale nodes, conflicts."""
    uncited = nodes.where((F.coalesce("source.label", F.lit("")) == "") & (F.coalesce(F.size("source.raw_spans"), F.lit(0)) <= 0))
    parts = {
        "doctor": validate_nodes(nodes).unionByName(validate_patches(patches)).unionByName(validate_edges(edges)).unionByName(validate_sessions(sessions)).select("id").unionByName(dangling(nodes, patches, edges).select("id")),
        "uncited": uncited.select("id"),
        "stale_active": stale_active(nodes).select("id"),
        "conflicts": nodes.where("status = 'conflict_pending'").select("id"),
    }
    rows = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def source_label(source: Column) -> Column:
    """The label, else the first session, else unknown."""
    session = F.try_element_at(source["session_ids"], F.lit(1))
    return F.coalesce(F.when(source["label"] != "", source["label"]), F.concat(F.lit("session:"), session), F.lit("unknown"))


def citations(nodes: DataFrame, raw: DataFrame, most: int = 500) -> DataFrame:
    """(id, status, label, quote, source_id, char_start, char_end, cited) for each span of each node; raw(source_id, text)."""
    spans = nodes.select("id", "status", source_label(F.col("source")).alias("label"), "source.quote", F.explode_outer("source.raw_spans").alias("s"))
    flat = spans.select("id", "status", "label", "quote", "s.source_id", "s.char_start", "s.char_end")
    return flat.join(raw.select("source_id", F.substring("text", 1, most).alias("cited")), "source_id", "left").select("id", "status", "label", "quote", "source_id", "char_start", "char_end", "cited")


def recall(nodes: DataFrame, raw: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The hits of a query with the citations of each: (rank, id, score, label, quote, source_id, char_start, char_end, cited)."""
    from ledgerloom.operators import retrieval

    hits = retrieval.lexical_search(nodes, {"q": query}, limit).select("rank", "id", "score")
    found = nodes.join(F.broadcast(hits.select("id")), "id", "left_semi")  # limit rows
    return hits.join(citations(found, raw), "id").select("rank", "id", "score", "label", "quote", "source_id", "char_start", "char_end", "cited")


def missing_fields(rows: DataFrame, json_col: str, required: tuple[str, ...]) -> DataFrame:
    """V6: (id, field) of required keys that the JSON text of a row lacks; a key that is there and null is not missing, and a text that is no object lacks all."""
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    return rows.select("id", F.explode(F.array_except(F.array(*[F.lit(f) for f in required]), keys)).alias("field"))


#: The kinds of record, by what their schema version holds, with the prefix of their ids and their fields (fixed values).
KINDS = {"memory_node": "mem_", "memory_patch": "patch_", "memory_edge": "edge_", "session": "sess_"}
REQUIRED = {
    "memory_node": ("schema_version", "id", "type", "scope", "content", "status", "source", "relations"), "memory_patch": ("schema_version", "id", "operation", "target_ids", "new_node_ids", "reason"),
    "memory_edge": ("schema_version", "id", "from_id", "to_id", "type"), "session": ("schema_version", "id", "agent", "workspace", "project", "started_at", "status"),
}
#: Folders whose files are evidence and are not validated (fixed values).
EVIDENCE = ("raw", "audit")


def is_evidence_path(path: Column) -> Column:
    """A part of the path is one of the folders of evidence."""
    return F.arrays_overlap(F.split(path, r"[/\\\\]"), F.array(*[F.lit(e) for e in EVIDENCE]))


def validate_records(records: DataFrame) -> DataFrame:
    """V8: (path, problem) of records(path, value), JSON texts of any kind: told apart by schema_version, then held to what their kind needs.

    Files of evidence are left out (P12); a text that is no object, or of no known kind, is a problem by itself.
    """
    rows = records.where(~is_evidence_path(F.col("path")))
    version = F.get_json_object("value", "$.schema_version")
    kind = F.coalesce(*[F.when(version.rlike(rf"\.{k}\.v0\.1$"), k) for k in KINDS])
    keys = F.json_object_keys("value")
    lacks = lambda k: F.transform(F.array_except(F.array(*[F.lit(f) for f in REQUIRED[k]]), keys), lambda f: F.concat(F.lit("missing "), f))
    prefix = lambda k: F.when(~F.coalesce(F.startswith(F.get_json_object("value", "$.id"), F.lit(KINDS[k])), F.lit(False)), F.array(F.lit("id prefix"))).otherwise(F.array().cast("array<string>"))
    found = F.when(keys.isNull(), F.array(F.lit("no object"))).when(kind.isNull(), F.array(F.lit("unknown schema_version")))
    for k in KINDS:
        found = found.when(kind == k, F.concat(lacks(k), prefix(k)))
    return rows.select("path", F.explode(found).alias("problem"))


def validate_edge_ends(edges: DataFrame, nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """V3: (id, problem) of edges whose ends, or whose source patch if they name one, do not exist; with validate_edges the whole check."""
    known, done = nodes.select(F.col("id").alias("ref")).distinct(), patches.select(F.col("id").alias("ref")).distinct()
    end = lambda c, name: edges.select("id", F.coalesce(c, F.lit("")).alias("ref")).join(known, "ref", "left_anti").select("id", F.lit(name).alias("problem"))
    source = edges.where("coalesce(source_patch_id, '') <> ''").select("id", F.col("source_patch_id").alias("ref")).join(done, "ref", "left_anti").select("id", F.lit("unknown source patch").alias("problem"))
    return end("from_id", "unknown from").unionByName(end("to_id", "unknown to")).unionByName(source)


def _has_forbidden(value: object) -> bool:
    if isinstance(value, dict):
        return any(k.lower() in FORBIDDEN_KEYS or _has_forbidden(v) for k, v in value.items())
    return isinstance(value, list) and any(_has_forbidden(v) for v in value)


def forbidden_keys(rows: DataFrame, json_col: str) -> DataFrame:
    """H2/V9: rows whose JSON holds a forbidden key at any depth. A text filter in the JVM leaves few rows for the parser."""
    maybe = rf'(?i)\\u00|"({"|".join(FORBIDDEN_KEYS)})"\s*:'

    @F.pandas_udf("boolean")
    def deep(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> bool:
            try:
                return bool(x) and _has_forbidden(json.loads(x))
            except ValueError:
                return bool(re.search(maybe, x))

        return s.map(one)

    return rows.where(F.col(json_col).rlike(maybe)).where(deep(F.col(json_col)))

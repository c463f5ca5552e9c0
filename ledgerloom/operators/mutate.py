"""Mutations of a ledger as set operations: they return the rows that change, and write nothing.

Where the order of patches matters it is time of creation, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ids
from ledgerloom.operators.ledger import REPLACING, STATUS_SETTING

#: Edge type of each operation (fixed values); operations that are not listed link nothing.
EDGE_OF = {"supersede": "supersedes", "refine": "refines", "expand": "expands", "narrow": "narrows", "merge": "derived_from", "split": "derived_from", "resolve_conflict": "resolves"}
RELATION_KEYS = ("supersedes", "superseded_by", "refines", "expands", "narrows", "contradicts", "depends_on", "derived_from")


def _map(c: Column, pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def patch_targets(patches: DataFrame) -> DataFrame:
    """(patch_id, operation, created_s, pos, id): one row a target."""
    return patches.select(F.col("id").alias("patch_id"), "operation", "created_s", F.posexplode(ids(F.col("target_ids"))).alias("pos", "id"))


def status_after(operation: Column) -> Column:
    """Status that an operation gives its targets; null for unknown operations."""
    return F.when(operation.isin(*STATUS_SETTING), _map(operation, STATUS_SETTING)).when(operation.isin(*REPLACING), "superseded").when(operation.isin("create", "rollback"), "active")


def replay(nodes: DataFrame, patches: DataFrame, as_of_s: int | None = None) -> DataFrame:
    """(id, status, by_patch): status of every node after the patches up to a time, its own where none touches it."""
    done = patch_targets(patches).withColumn("status_after", status_after(F.col("operation"))).where("status_after is not null")
    if as_of_s is not None:
        done = done.where(F.col("created_s") <= as_of_s)
    last = done.groupBy("id").agg(F.max(F.struct("created_s", "patch_id", "status_after")).alias("m"))
    return nodes.select("id", "status").join(last, "id", "left").select("id", F.coalesce("m.status_after", "status").alias("status"), F.col("m.patch_id").alias("by_patch"))


def status_history(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, patch_id, status, prior_status, valid_from_s, valid_until_s): the statuses of each touched node in order."""
    done = patch_targets(patches).withColumn("status_after", status_after(F.col("operation"))).where("status_after is not null").dropDuplicates(["id", "patch_id"])
    w = W.partitionBy("id").orderBy("created_s", "patch_id")
    rows = done.join(nodes.select("id", F.col("status").alias("base")), "id")
    return rows.select(
        "id", "patch_id", F.col("status_after").alias("status"), F.coalesce(F.lag("status_after").over(w), "base").alias("prior_status"), F.col("created_s").alias("valid_from_s"), F.lead("created_s").over(w).alias("valid_until_s")
    )


def status_patches(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """L4: (patch_id, id, status, prior_status) of expire, forget and deprecate."""
    hit = patch_targets(patches).where(F.col("operation").isin(*STATUS_SETTING)).dropDuplicates(["patch_id", "id"])
    return hit.join(nodes.select("id", F.col("status").alias("prior_status")), "id").select("patch_id", "id", _map(F.col("operation"), STATUS_SETTING).alias("status"), "prior_status")


def replacement_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """The node that each replacing patch makes: type, scope and key of its first known target, all targets' tags.

    Its id follows from the patch id, so that a patch applied twice makes one node.
    """
    makes = patches.where(F.col("operation").isin(*REPLACING) & (F.coalesce("new_content", F.lit("")) != ""))
    hit = patch_targets(makes).join(nodes.select("id", "type", "key", "scope", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")), "id")
    first = F.min(F.struct("pos", "type", "key", F.col("scope.workspace").alias("workspace"), F.col("scope.project").alias("project")))
    by_patch = hit.groupBy("patch_id").agg(first.alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.array_sort(F.collect_set("id")).alias("targets"))
    made = makes.select(F.col("id").alias("patch_id"), "operation", "new_content", "reason").join(by_patch, "patch_id")
    return made.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2("patch_id", 256), 1, 12)).alias("id"), "patch_id", "first.type", "first.key", "first.workspace", "first.project", F.col("new_content").alias("content"), F.col("reason").alias("quote"),
        F.concat(F.lit("patch:"), "patch_id").alias("label"), "tags", "targets", _map(F.col("operation"), EDGE_OF).alias("relation"),
    )


def replacement_edges(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """An edge from each made node to each of its targets, derived_from where the operation has no type of its own."""
    made = replacement_nodes(nodes, patches)
    return made.select(F.col("id").alias("from_id"), F.explode("targets").alias("to_id"), F.coalesce("relation", F.lit("derived_from")).alias("type"), F.col("patch_id").alias("source_patch_id"))


def rollback(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch_id, id, status) after undoing each of the patches: targets as before, active where unknown; new nodes discarded."""
    known = nodes.select("id")
    back = patches.select(F.col("id").alias("patch_id"), "prior_states", F.explode(ids(F.col("target_ids"))).alias("id")).select("patch_id", "id", F.coalesce(F.col("prior_states")[F.col("id")], F.lit("active")).alias("status"), F.lit(0).alias("step"))
    new = patches.select(F.col("id").alias("patch_id"), F.explode(ids(F.col("new_node_ids"))).alias("id"), F.lit("discarded").alias("status"), F.lit(1).alias("step"))
    last = back.unionByName(new).groupBy("patch_id", "id").agg(F.max(F.struct("step", "status")).alias("m")).select("patch_id", "id", "m.status")
    return last.join(known, "id", "left_semi")


def rolled_back_links(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch_id, id, superseded_by) of the targets, without the links that the patch made."""
    hit = patches.select(F.col("id").alias("patch_id"), ids(F.col("new_node_ids")).alias("made"), F.explode(ids(F.col("target_ids"))).alias("id")).dropDuplicates(["patch_id", "id"])
    linked = nodes.select("id", F.col("relations")["superseded_by"].alias("old")).where(F.size("old") > 0)
    return hit.join(linked, "id").select("patch_id", "id", F.array_except("old", "made").alias("superseded_by"))


def rollback_patches(patches: DataFrame) -> DataFrame:
    """The patch that each rollback writes: (id, operation, target_ids, new_node_ids, reason, rolled_back); its id follows from the patch it undoes."""
    own = F.concat(F.lit("patch_"), F.substring(F.sha2(F.concat_ws("/", "id", F.lit("rollback")), 256), 1, 12))
    return patches.where("id is not null").select(
        own.alias("id"), F.lit("rollback").alias("operation"), ids(F.col("target_ids")).alias("target_ids"), F.array().cast("array<string>").alias("new_node_ids"), F.concat(F.lit("rollback of "), "id").alias("reason"), F.col("id").alias("rolled_back")
    )


def reactivated(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch_id, id, status, type) of create and rollback patches with new content: their known targets become active, tied to the made node by derived_from."""
    does = patches.where(F.col("operation").isin("create", "rollback") & (F.coalesce("new_content", F.lit("")) != ""))
    hit = patch_targets(does).select("patch_id", "id").distinct()
    return hit.join(nodes.select("id"), "id", "left_semi").select("patch_id", "id", F.lit("active").alias("status"), F.lit("derived_from").alias("type"))


def new_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of rows(content, source, type): trimmed, with an id that follows from content and label; rows without content or source give none."""
    text = F.trim(F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))
    made = rows.withColumn("content", text).where("content <> '' and source is not null")
    return made.withColumn("id", F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("\n", "content", F.coalesce("source.label", F.lit(""))), 256), 1, 12))).withColumn("status", F.lit("active"))


def forget_by_query(nodes: DataFrame, query: str) -> DataFrame:
    """(id, status) of the best hit of a query, which is to be forgotten; no hit is an error."""
    from ledgerloom.operators import retrieval

    hit = retrieval.lexical_search(nodes, {"q": query}, 1).select("id").first()
    if hit is None:
        raise LookupError(f"nothing to forget for {query!r}")
    return nodes.where(F.col("id") == hit["id"]).select("id", F.lit("forgotten").alias("status"))


def patch_diff(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch_id, role, id, status, content) of the nodes a patch names; status null for unknown nodes."""
    side = lambda c, role: patches.select(F.col("id").alias("patch_id"), F.lit(role).alias("role"), F.explode(ids(F.col(c))).alias("id")).distinct()
    named = side("target_ids", "target").unionByName(side("new_node_ids", "new"))
    return named.join(nodes.select("id", "status", "content"), "id", "left").select("patch_id", "role", "id", "status", "content")


def end_sessions(nodes: DataFrame, policy: str) -> DataFrame:
    """Overlay nodes (active_session) after their sessions end: (id, session_id, status); policy keep, promote or discard."""
    status = {"keep": "active_session", "promote": "active", "discard": "discarded"}[policy]
    own = nodes.where("status = 'active_session'")
    return own.select("id", F.when(F.lit(policy == "promote"), F.lit(None).cast("string")).otherwise(F.col("scope.session")).alias("session_id"), F.lit(status).alias("status"))


def promote_one(nodes: DataFrame, node_id: str) -> DataFrame:
    """(id, session_id, status) of one overlay node after its promotion; a node that is no overlay gives no row."""
    return end_sessions(nodes.where(F.col("id") == node_id), "promote")


def overlay(rows: DataFrame, session_id: str) -> DataFrame:
    """rows(id, content, ...) as overlay nodes of a session."""
    return rows.withColumns({"status": F.lit("active_session"), "session_id": F.lit(session_id)})


def resume_sessions(sessions: DataFrame, session_ids: DataFrame) -> DataFrame:
    """(id, status) of the sessions named by session_ids(id) that have ended or were forked, active again."""
    return sessions.where(F.col("status").isin("ended", "forked")).join(session_ids.select("id"), "id", "left_semi").select("id", F.lit("active").alias("status"))


def fork_sessions(sessions: DataFrame, branch: str = "fork") -> DataFrame:
    """A child of each session with its loaded memories; the child's id follows from parent and branch."""
    child = F.concat(F.lit("sess_"), F.substring(F.sha2(F.concat_ws("/", "id", F.lit(branch)), 256), 1, 12))
    return sessions.select(child.alias("id"), F.col("id").alias("parent_session_id"), "agent", "workspace", "project", F.lit("active").alias("status"), F.lit(branch).alias("branch_name"), "loaded_memory_ids")


def merge_sessions(nodes: DataFrame) -> DataFrame:
    """Overlay nodes after a merge: (id, key, status); conflict_pending where an active node holds the key."""
    own = nodes.where("status = 'active_session'")
    taken = nodes.where("status = 'active' and coalesce(key, '') <> ''").select("key").distinct().withColumn("taken", F.lit(True))
    return own.join(taken, "key", "left").select("id", "key", F.when(F.col("taken"), "conflict_pending").otherwise("active").alias("status"))


def start_sessions(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """ST5: rows of wanted(id, ...) whose session does not exist yet, each once."""
    return wanted.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


#: What is compared of two nodes of one id; what an import itself sets is left out.
COMPARED = ("type", "key", "content", "status", "confidence", "priority", "tags", "source", "retrieval", "metadata")
SCOPE = ("user", "workspace", "project", "agent", "session")


def _same(a: str, b: str, has: set[str]) -> Column:
    """H3: equal but for the fields that an import itself sets; maps are compared by their entries."""
    entries = lambda t: F.array_sort(F.map_entries(F.coalesce(F.col(f"{t}.relations"), F.create_map().cast("map<string,array<string>>"))))
    rows = [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in COMPARED if f in has]
    rows += [F.col(f"{a}.scope.{f}").eqNullSafe(F.col(f"{b}.scope.{f}")) for f in SCOPE]
    if "relations" in has:
        rows.append(entries(a).eqNullSafe(entries(b)))
    return F.forall(F.array(*rows), lambda x: x)


def import_nodes(local: DataFrame, remote: DataFrame, origin: str) -> DataFrame:
    """(id, outcome, landed_id) of remote nodes: imported, skipped (equal) or conflict (kept under a new id)."""
    both = remote.alias("r").join(local.alias("l"), F.col("r.id") == F.col("l.id"), "left")
    outcome = F.when(F.col("l.id").isNull(), "imported").when(_same("r", "l", set(remote.columns) & set(local.columns)), "skipped").otherwise("conflict")
    rows = both.select(F.col("r.id").alias("id"), outcome.alias("outcome"))
    fresh = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("/", F.lit(origin), "id"), 256), 1, 12))
    return rows.withColumn("landed_id", F.when(F.col("outcome") == "conflict", fresh).otherwise(F.col("id")))


def merged_nodes(local: DataFrame, remote: DataFrame, landed: DataFrame, origin: str) -> DataFrame:
    """(id, content, status, contradicts, origin) of the ledger after an import.

    New remote nodes come in under their id; of two that differ the local one becomes conflict_pending, the remote one gets a new id, and each contradicts
    the other. origin stamps what came from the other ledger, null for the ledger's own.
    """
    links = F.coalesce(F.col("relations")["contradicts"], F.array().cast("array<string>"))
    also = lambda c: F.array_sort(F.array_distinct(F.concat(F.array_compact(links), F.array_compact(F.array(c)))))
    clash = landed.where("outcome = 'conflict'").select("id", "landed_id")
    here = local.join(clash, "id", "left").select("id", "content", F.when(F.col("landed_id").isNotNull(), "conflict_pending").otherwise(F.col("status")).alias("status"), also(F.col("landed_id")).alias("contradicts"), F.lit(None).cast("string").alias("origin"))
    came = remote.join(landed.where("outcome <> 'skipped'"), "id")
    other = F.when(F.col("outcome") == "conflict", F.col("id"))
    return here.unionByName(came.select(F.col("landed_id").alias("id"), "content", "status", also(other).alias("contradicts"), F.lit(origin).alias("origin")))


def remap_patches(patches: DataFrame, landed: DataFrame) -> DataFrame:
    """(id, target_ids, new_node_ids) of remote patches with the ids their nodes landed on, in order."""
    moved = landed.where("landed_id <> id").select(F.col("id").alias("ref"), "landed_id")
    side = lambda c: patches.select("id", F.lit(c).alias("side"), F.posexplode(ids(F.col(c))).alias("pos", "ref"))
    rows = side("target_ids").unionByName(side("new_node_ids")).join(moved, "ref", "left").select("id", "side", "pos", F.coalesce("landed_id", "ref").alias("ref"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("pos", "ref")))), lambda x: x["ref"])
    by_patch = rows.groupBy("id").agg(in_order("target_ids").alias("target_ids"), in_order("new_node_ids").alias("new_node_ids"))
    none = F.array().cast("array<string>")
    return patches.select("id").join(by_patch, "id", "left").select("id", F.coalesce("target_ids", none).alias("target_ids"), F.coalesce("new_node_ids", none).alias("new_node_ids"))


def remap_edges(edges: DataFrame, landed: DataFrame) -> DataFrame:
    """Edges with both ends under the ids their nodes landed on."""
    moved = landed.where("landed_id <> id").select("id", "landed_id")
    out = edges.join(moved.select(F.col("id").alias("from_id"), F.col("landed_id").alias("new_from")), "from_id", "left").join(moved.select(F.col("id").alias("to_id"), F.col("landed_id").alias("new_to")), "to_id", "left")
    return out.select("id", F.coalesce("new_from", "from_id").alias("from_id"), F.coalesce("new_to", "to_id").alias("to_id"), "type")


def export_slice(nodes: DataFrame, patches: DataFrame, edges: DataFrame, sessions: DataFrame, session_ids: DataFrame | None = None, node_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The part of a ledger that belongs to the sessions of session_ids(id) and the nodes of node_ids(id); unknown sessions select nothing."""
    chosen = sessions.limit(0) if session_ids is None else sessions.join(session_ids.select("id"), "id", "left_semi")
    named = nodes.select("id").limit(0) if node_ids is None else node_ids.select("id")
    of_sessions = nodes.select("id", F.col("scope.session").alias("session_id")).join(chosen.select(F.col("id").alias("session_id")), "session_id", "left_semi").select("id")
    wanted = chosen.select(F.explode(ids(F.col("loaded_memory_ids"))).alias("id")).unionByName(of_sessions).unionByName(named).distinct()
    picked = nodes.join(wanted, "id", "left_semi")
    refs = patches.select("id", F.explode(F.concat(ids(F.col("target_ids")), ids(F.col("new_node_ids")))).alias("ref"))
    by_ref = refs.join(picked.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
    ends = edges.select("id", F.explode(F.array("from_id", "to_id")).alias("ref")).join(picked.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
    return {"nodes": picked, "patches": patches.join(by_ref, "id", "left_semi"), "edges": edges.join(ends, "id", "left_semi"), "sessions": chosen}


def push_selection(nodes: DataFrame, field: str, value: str, node_ids: list[str] | None = None) -> DataFrame:
    """P5: active nodes of a tenant; explicit ids must exist."""
    if node_ids:
        spark = nodes.sparkSession
        missing = spark.createDataFrame([(i,) for i in node_ids], "id string").join(nodes.select("id"), "id", "left_anti").first()
        if missing:
            raise ValueError(f"no node {missing[0]}")
        nodes = nodes.where(F.col("id").isin(*node_ids))
    return nodes.where((F.col(f"scope.{field}") == value) & (F.col("status") == "active"))

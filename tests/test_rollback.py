import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import mutate
from ledgerloom.operators.ledger import patches
from ledgerloom.plans import mutation

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["rollback", "rolled_back_links"])
def test_every_operation_is_undone(spark, name):
    operations = patches(spark, DATA).select("id", "operation").withColumnRenamed("id", "patch_id")
    rows = mutation.QUERIES[name](spark, DATA).join(operations, "patch_id").select("operation").distinct().collect()
    assert len(rows) > 3


def test_sessions_and_imports(spark):
    scope = "scope struct<user: string, workspace: string, project: string, agent: string, session: string>, relations map<string,array<string>>"
    own = ("u", "w", "p", "a", "s1")
    local = spark.createDataFrame([("a", "one", "active", own, {"contradicts": ["z"]}), ("b", "two", "active_session", own, None), ("c", "three", "active", own, {})], f"id string, content string, status string, {scope}")
    remote = spark.createDataFrame([("a", "ONE", "active", own, {"contradicts": ["z"]}), ("c", "three", "active", own, None), ("d", "four", "active", own, None)], f"id string, content string, status string, {scope}")
    bare = local.withColumns({c: F.lit(None).cast("string") for c in ("type", "key", "priority")}).withColumns({"confidence": F.lit(1.0), "tags": F.array().cast("array<string>")})
    other = remote.withColumns({c: F.lit(None).cast("string") for c in ("type", "key", "priority")}).withColumns({"confidence": F.lit(1.0), "tags": F.array().cast("array<string>")})
    landed = mutate.import_nodes(bare, other, "peer")
    moved = {r["id"]: (r["outcome"], r["landed_id"]) for r in landed.collect()}
    assert moved["c"] == ("skipped", "c") and moved["d"] == ("imported", "d") and moved["a"][0] == "conflict"
    new = moved["a"][1]
    after = {r["id"]: (r["content"], r["status"], r["contradicts"], r["origin"]) for r in mutate.merged_nodes(bare, other, landed, "peer").collect()}
    assert after == {
        "a": ("one", "conflict_pending", sorted(["z", new]), None), "b": ("two", "active_session", [], None), "c": ("three", "active", [], None), "d": ("four", "active", [], "peer"), new: ("ONE", "active", ["a", "z"], "peer"),
    }
    patch = spark.createDataFrame([("p1", ["d", "a", None], ["a", ""]), ("p2", None, None)], "id string, target_ids array<string>, new_node_ids array<string>")
    assert {r["id"]: (r["target_ids"], r["new_node_ids"]) for r in mutate.remap_patches(patch, landed).collect()} == {"p1": (["d", new], [new]), "p2": ([], [])}
    assert [tuple(r) for r in mutate.promote_one(local, "b").collect()] == [("b", None, "active")] and mutate.promote_one(local, "a").collect() == []
    assert mutate.overlay(local.select("id", "content"), "s9").first()["status"] == "active_session"
    sessions = spark.createDataFrame([("s1", "ended"), ("s2", "active"), ("s3", "forked")], "id string, status string")
    asked = spark.createDataFrame([("s1",), ("s2",), ("x",)], "id string")
    assert [tuple(r) for r in mutate.resume_sessions(sessions, asked).collect()] == [("s1", "active")]
    made = mutate.new_nodes(spark.createDataFrame([("  hi ", ("l",)), (" ", ("l",)), (None, ("l",)), ("x", None)], "content string, source struct<label: string>")).collect()
    assert [(r["content"], r["status"]) for r in made] == [("hi", "active")] and made[0]["id"].startswith("mem_")

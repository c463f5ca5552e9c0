import os

import pytest

from ledgerloom.operators import governance
from ledgerloom.plans import governance as plans

DATA = "/root/testdata/sf0.001"


def test_authorized_by_brute_force(spark):
    nodes = [("a", None), ("b", ""), ("c", "p1"), ("d", "p2"), ("e", "p1"), ("e", "p2"), ("f", "p1"), ("f", None), ("g", "p9")]
    acl = [("p1", "u1"), ("p1", "u1"), ("p2", "u1"), ("p2", "u2"), ("p1", "x")]
    asked = ["u1", "u2", "u3", "u3", None]
    got = governance.authorized(spark.createDataFrame(nodes, "id string, project_id string"), spark.createDataFrame(acl, "project_id string, principal_id string"), spark.createDataFrame([(u,) for u in asked], "principal_id string"))
    free = {i for i, p in nodes if not p}
    want = {("*", i) for i in free} | {(u, i) for u in asked if u for i, p in nodes if i not in free and (p, u) in acl}
    rows = [(r["principal_id"], r["id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_principal_is_asked(spark):
    every = spark.read.parquet(f"{DATA}/principals.parquet").select("principal_id").distinct().count()
    assert plans.QUERIES["acl_authorized"](spark, DATA).where("principal_id <> '*'").select("principal_id").distinct().count() == every > 3


def test_revoked_access(spark):
    principals = spark.createDataFrame([("u1", "Ada Lind"), ("u2", "Bo Berg")], "principal_id string, display_name string")
    acl = spark.createDataFrame([("proj_alder", "u1"), ("proj_birch", "u1"), ("proj_alder", "u2"), ("proj_birch", "u3")], "project_id string, principal_id string")
    turns = [("t1", "u3", "Please revoke ada's access to Alder"), ("t2", "u2", "revoke my access"), ("t3", "u1", "all is well"), ("t4", None, "revoke it"), ("t5", "u9", "revoked")]
    gone = governance.revoked_access(spark.createDataFrame(turns, "id string, speaker_id string, text string"), principals, acl)
    assert {tuple(r) for r in gone.select("project_id", "principal_id").collect()} == {("proj_alder", "u1"), ("proj_alder", "u2")}
    assert {tuple(r) for r in governance.allowed(acl, gone).collect()} == {("proj_birch", "u1"), ("proj_birch", "u3")}
    rel = spark.createDataFrame([("proj_alder", "u1", "The Alder plan"), ("proj_alder", "u2", None), ("", "u1", "x"), (None, "u1", "y")], "project_id string, principal_id string, label string")
    assert [(r["alias"], r["principals"], r["labels"]) for r in governance.directory(rel).collect()] == [("alder", ["u1", "u2"], ["alder", "plan", "the"])]

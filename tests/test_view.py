"""The effective view on small ledgers, and the order of precedence against a plain loop."""

import random

import pytest

from ledgerloom.operators import view

N = "id string, key string, status string, scope struct<project:string,workspace:string,session:string>, updated_s long"
P = "id string, operation string, target_ids array<string>"


def node(i, status="active", key=None, project=None, workspace=None, session=None, updated=1):
    return (i, key, status, (project, workspace, session), updated)


def ids(spark, nodes, patches=(), session=None, **kw):
    p = spark.createDataFrame(list(patches), P) if patches else None
    return {r["id"] for r in view.effective_view(spark.createDataFrame(nodes, N), p, session, **kw).collect()}


@pytest.mark.parametrize(
    ("nodes", "patches", "session", "expected"),
    [
        ([node("a"), node("b", "superseded"), node("c")], [("p1", "supersede", ["a"]), ("p2", "supersede", ["b"])], None, {"c"}),
        ([node("d"), node("e")], [("p1", "create", []), ("p2", "forget", ["d"])], None, {"e"}),
        ([node("g", key="k"), node("w", key="k", workspace="w"), node("p", key="k", project="p"), node("s", "active_session", "k", session="s1")], [], "s1", {"s"}),
        ([node("g", key="k"), node("w", key="k", workspace="w"), node("p", key="k", project="p"), node("s", "active_session", "k", session="s1")], [], None, {"p"}),
        ([node("a"), node("b"), node("c"), node("z")], [("p1", "forget", ["a"]), ("p2", "expire", ["b"]), ("p3", "deprecate", ["c", None, ""])], None, {"z"}),
        ([node("x", "conflict_pending"), node("y")], [("p1", "resolve_conflict", ["x"])], None, {"y"}),
        ([node("a"), node("b")], [("p1", "rollback", ["a"])], None, {"a", "b"}),
    ],
)
def test_conformance(spark, nodes, patches, session, expected):
    assert ids(spark, nodes, patches, session) == expected


def test_unknown_operation(spark):
    with pytest.raises(view.UnknownOperation):
        ids(spark, [node("a")], [("p", "archive", ["a"])])
    assert ids(spark, [node("a")], [("p", "archive", ["a"])], unknown="ignore") == {"a"}


def test_precedence_is_the_loop(spark):
    r = random.Random(1)
    nodes = [node(f"n{i:03d}", key=r.choice([None, "", "k1", "k2", "k3"]), project=r.choice([None, "p"]), workspace=r.choice([None, "", "w"]), updated=r.choice([None, 1, 2, 3])) for i in range(300)]
    winners, order = {}, []
    for n in nodes:
        if not n[1]:
            order.append(n[0])
            continue
        rank = (3 if n[3][0] else 2 if n[3][1] else 1, n[4] if n[4] is not None else -1)
        if n[1] not in winners or rank > winners[n[1]][0]:
            winners[n[1]] = (rank, n[0])
    got = view.effective_view(spark.createDataFrame(nodes, N)).orderBy("view_ord", "id").select("id").collect()
    firsts = list(dict.fromkeys(n[1] for n in nodes if n[1]))
    assert [x["id"] for x in got] == order + [winners[k][1] for k in firsts]

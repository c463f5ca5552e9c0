import random

from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy

LINK = "child string, parent string"


def brute(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in {x for l in up.items() for x in l}:
        path, seen, x = [n], {n}, n
        while x in up:
            x = up[x]
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
        out[n] = ("cycle", -1, None) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def run(spark, links):
    """By rounds to the end; the last task must give the same."""
    df = spark.createDataFrame(links, LINK)
    by_rounds, by_task = ({r["node_id"]: (r["root_id"], r["depth"], r["path"], r["n_descendants"]) for r in hierarchy.hierarchy(df, True, True, base_rows).collect()} for base_rows in (0, hierarchy.BASE_ROWS))
    assert by_rounds == by_task
    return {k: v[:3] for k, v in by_rounds.items()}


def test_random_forests_with_rings(spark):
    r = random.Random(3)
    links = []
    for t in range(12):
        n = r.choice([1, 2, 5, 30])
        ids = [f"t{t}_{i}" for i in range(n)]
        links += [(ids[i], ids[r.randrange(i) if r.random() < 0.4 else i - 1]) for i in range(1, n)]
        if r.random() < 0.5 and n > 1:
            links.append((ids[0], ids[r.randrange(n)]))  # a ring, or a node above itself
    links += links[:5] + [(None, "a"), ("b", None)]
    assert run(spark, links) == brute(links)


def test_long_chain_takes_few_rounds(spark):
    links = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(400)]
    df = spark.createDataFrame(links, LINK)
    for base_rows in (0, 100, hierarchy.BASE_ROWS):
        rounds = hierarchy.peel(df, base_rows=base_rows)
        assert len(rounds) < 40 and sum(r.count() for r in rounds) == 400
        got = {r["node_id"]: (r["depth"], r["n_descendants"]) for r in hierarchy.hierarchy(df, with_sizes=True, base_rows=base_rows).collect()}
        assert got == {f"n{i:04d}": (400 - i, i) for i in range(401)}


def test_star_and_several_parents(spark):
    links = [(f"c{i}", "hub") for i in range(3000)] + [("x", "b"), ("x", "a"), ("a", "top")]
    got = run(spark, links)
    assert got["c7"] == ("hub", 1, ["hub", "c7"]) and got["x"] == ("top", 2, ["top", "a", "x"]) and got["b"] == ("b", 0, ["b"])


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("a", "b", "x", 1)], f"{LINK}, node string, w int").withColumns({"kind": F.lit("z"), "root": F.lit(None).cast("string")})
    assert {r["node_id"]: r["depth"] for r in hierarchy.hierarchy(df).collect()} == {"a": 1, "b": 0}


def test_descendants_and_sizes(spark):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("r", "r")]
    placed = hierarchy.hierarchy(spark.createDataFrame(links, LINK), with_paths=True)
    got = {tuple(r) for r in hierarchy.descendants(placed).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    sized = hierarchy.hierarchy(spark.createDataFrame(links, LINK), with_sizes=True)
    assert sized.columns == ["node_id", "root_id", "depth", "n_descendants"] and {r["node_id"]: r["n_descendants"] for r in sized.collect()} == {"a": 3, "b": 2, "c": 0, "d": 0, "r": 0}


def test_sizes_of_random_forests(spark):
    """Mostly chains, so that leaves, splices and branches meet in all orders; rings and what hangs on them have no size."""
    r = random.Random(11)
    links = []
    for t in range(15):
        ids = [f"t{t}_{i}" for i in range(r.choice([3, 12, 60]))]
        links += [(ids[i], ids[r.randrange(i) if r.random() < 0.15 else i - 1]) for i in range(1, len(ids))]
        if t % 5 == 0:
            links.append((ids[0], ids[-1]))
    r.shuffle(links)
    want = dict.fromkeys({x for pair in links for x in pair}, 0)
    placed = brute(links)
    for path in (p for _, _, p in placed.values() if p):
        for above in path[:-1]:
            want[above] += 1
    for base_rows in (0, 40, hierarchy.BASE_ROWS):
        got = {x["node_id"]: x for x in hierarchy.hierarchy(spark.createDataFrame(links, LINK), with_paths=True, with_sizes=True, base_rows=base_rows).collect()}
        assert {k: x["n_descendants"] for k, x in got.items()} == want
        assert {k: (x["root_id"], x["depth"], x["path"]) for k, x in got.items()} == placed


def test_links_of_three_places(spark):
    nodes = spark.createDataFrame(
        [("n1", {"supersedes": ["n2", "gone", None, ""]}), ("n2", {"superseded_by": ["n1"]}), ("n3", None), ("n3", None), (None, None)], "id string, relations map<string,array<string>>"
    )
    edges = spark.createDataFrame([("n2", "n3", "supersedes"), ("n3", "n1", "refines"), (None, "n1", "supersedes"), ("zz", "n1", "supersedes")], "from_id string, to_id string, type string")
    assert {tuple(r) for r in hierarchy.supersede_links(nodes, edges).select("child", "parent").collect()} == {("n2", "n1"), ("n3", "n2")}

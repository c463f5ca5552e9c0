import random

from ledgerloom.operators import changefeed as cf

P = "id string, operation string, target_ids array<string>, new_node_ids array<string>, created_at string"
OPS = [*cf.REPLACING, *cf.CHANGING, *cf.REMOVING, " Create ", "FORGET", "touch", None]


def brute(rows):
    live = {}
    seen = set()
    for i, op, t, n, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if i in seen:
            continue
        seen.add(i)
        op = (op or "").strip().lower()
        t, n = [x for x in t or [] if x], [x for x in n or [] if x]
        if op in cf.REPLACING:
            for x in t:
                live.pop(x, None)
            live.update(dict.fromkeys(n, i))
        elif op in cf.CHANGING:
            live.update({x: i for x in t if x in live})
        elif op in cf.REMOVING:
            for x in t:
                live.pop(x, None)
    return live


def test_random_order_and_repeats(spark):
    r = random.Random(11)
    ids = [f"m{i}" for i in range(25)] + ["", None]
    rows = [(f"p{i:03d}", r.choice(OPS), r.choice([None, r.choices(ids, k=2)]), r.choice([None, r.choices(ids, k=2)]), f"2024-01-01T00:00:{r.randrange(60):02d}+00:00") for i in range(400)]
    given = rows + r.sample(rows, 60)
    r.shuffle(given)
    got = {x["node_id"]: x["patch_id"] for x in cf.live_nodes(spark.createDataFrame(given, P)).collect()}
    assert got == brute(rows)
    first, second = (cf.patch_changes(spark.createDataFrame(part, P)) for part in (given[:200], given[200:]))
    late = cf.live(cf.fold(first, base=cf.fold(second)))
    assert {x["key"]: x["seq"] for x in late.collect()} == got


def test_cases(spark):
    assert cf.live_nodes(spark.createDataFrame([], P)).collect() == []
    rows = [("p1", "merge", ["a"], ["a"], "2024-01-01T00:00:00Z"), ("p2", "update", ["b"], None, "2024-01-02T00:00:00Z"), ("p3", "create", None, ["c"], None)]
    df = spark.createDataFrame(rows, P).selectExpr("*", "1 AS key", "2 AS rank", "3 AS t")
    assert {x["node_id"]: x["patch_id"] for x in cf.live_nodes(df).collect()} == {"a": "p1", "c": "p3"}

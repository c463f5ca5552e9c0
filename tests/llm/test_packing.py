import random
from collections import defaultdict

import pytest

from ledgerloom.llm import packing

I, B = "item_id long, size long", "budget_id string, capacity long"


def check(rows, items, budgets):
    """No bin over capacity, every token of every item once, only items over capacity cut, and only where needed."""
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r["budget_id"], r["pack_id"]] += r["size"]
        pieces[r["budget_id"], r["item_id"]].append((r["piece"], r["start"], r["size"]))
    for b, c in budgets:
        assert all(v <= c for (x, _), v in load.items() if x == b)
        for i, s in items:
            s = s or 0
            got = sorted(pieces[b, i])
            assert [p for p, *_ in got] == list(range(max(1, -(-s // c)))) and sum(n for *_, n in got) == s
            assert all(n == c for *_, n in got[:-1]) and [st for _, st, _ in got] == [k * c for k in range(len(got))]
    return {b: len([1 for x, _ in load if x == b]) for b, _ in budgets}


def test_fill_against_the_bound(spark):
    r = random.Random(6)
    items = [(i, r.choice([None, 0, r.randrange(1, 60), r.randrange(1, 700)])) for i in range(3000)]
    budgets = [("s", 256), ("l", 2048)]
    rows = packing.pack(spark.createDataFrame(items, I), spark.createDataFrame(budgets, B), shard_items=700).collect()
    n = check(rows, items, budgets)
    total = sum(s or 0 for _, s in items)
    for b, c in budgets:
        assert n[b] <= -(-total // c) * 1.03 + 2, (b, n[b], total / c)


def test_rounds_merge_what_shards_leave(spark):
    """More shards than one and more rounds than one, nearly as good as one task; the check of packs tells right from wrong."""
    r = random.Random(7)
    items = spark.createDataFrame([(i, r.choice([0, r.randrange(1, 90), r.randrange(1, 1500)])) for i in range(4000)], I)
    budgets = spark.createDataFrame([("s", 256), ("l", 2048)], B)
    rounds = packing.pack_rounds(items, budgets, shard_items=900)
    assert len(rounds) >= 2 and all(x.count() for x in rounds)
    packed = packing.pack(items, budgets, shard_items=900)
    one = {x["budget_id"]: x["n_packs"] for x in packing.fill_report(packing.pack(items, budgets, shard_items=10**6), budgets).collect()}
    for x in packing.fill_report(packed, budgets).collect():
        assert x["least_packs"] <= x["n_packs"] <= one[x["budget_id"]] * 1.01 + 1 and 0.97 < x["fill"] <= 1
    right = packing.check_packs(packed, items, budgets, slack=0.03).collect()
    assert [(x["n_items"], x["n_overfull"], x["n_wrong"], x["near_bound"]) for x in right] == [(4000, 0, 0, True)] * 2
    wrong = packing.check_packs(packed.where("item_id <> 5").selectExpr("*").replace({7: 8}, subset=["item_id"]), items, budgets).collect()
    assert all(x["n_items"] == 3998 and x["n_wrong"] == 1 for x in wrong)


@pytest.mark.parametrize("sizes", [[], [0], [None, 0], [10], [11], [10] * 50, [6] * 40, [35, 1, 9], [5, 5, 5, 5]])
def test_cases(spark, sizes):
    items, budgets = list(enumerate(sizes)), [("b", 10)]
    rows = packing.pack(spark.createDataFrame(items, I), spark.createDataFrame(budgets, B), shard_items=8).collect()
    check(rows, items, budgets)


def test_repeats_clashes_and_bad_capacity(spark):
    df = spark.createDataFrame([(1, 4), (1, 4), (2, 7), (None, 3)], I).selectExpr("*", "'x' AS budget_id", "1 AS capacity", "2 AS piece")
    rows = packing.pack(df, spark.createDataFrame([("b", 10), ("b", 10)], B)).collect()
    assert sorted((r["item_id"], r["size"]) for r in rows) == [(1, 4), (2, 7)]
    many = spark.createDataFrame([(f"b{k}", 5 + k) for k in range(450)], B)
    assert packing.pack(df, many).select("budget_id").distinct().count() == 450 and packing.pack(df, many.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([("b", 0)], B))


def test_best_fit_is_the_loop():
    r = random.Random(1)
    for _ in range(50):
        c = r.randrange(5, 40)
        sizes = sorted((r.randrange(0, c + 1) for _ in range(r.randrange(0, 60))), reverse=True)
        free = []
        for s in sizes:
            fits = [b for b in range(len(free)) if free[b] >= s and free[b] > 0]
            if fits:
                b = min(fits, key=lambda b: (free[b], b))
                free[b] -= s
            else:
                free.append(c - s)
        assert sorted(packing.best_fit(sizes, c)[1]) == sorted(free)

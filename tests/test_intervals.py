import random

from ledgerloom.operators import intervals

IV = "key string, start_s long, end_s long"


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k and s is not None and (e is None or e > s):
            by.setdefault(k, []).append((s, float("inf") if e is None else e))
    out = set()
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for i, (s, e) in enumerate(merged):
            out.add((k, "period", s, None if e == float("inf") else e))
            if i:
                out.add((k, "gap", merged[i - 1][1], s))
    return out


def run(spark, rows, bucket):
    return {tuple(r) for r in intervals.periods(spark.createDataFrame(rows, IV), bucket).collect()}


def test_random(spark):
    r = random.Random(5)
    rows = []
    for _ in range(400):
        s = r.choice([None, r.randrange(0, 300)]) if r.random() < 0.1 else r.randrange(0, 300)
        e = None if r.random() < 0.03 else r.randrange(-5, 320) if r.random() < 0.2 or s is None else s + r.choice([0, 1, 3, 10])
        rows.append((r.choice(["a", "b", "c", "hot", "hot", "", None]), s, e))
    rows += rows[:50]
    assert run(spark, rows, 7) == run(spark, rows, 10_000) == brute(rows)


def test_cases(spark):
    assert run(spark, [], 5) == set()
    assert run(spark, [("k", 1, 1), ("k", 5, 2), ("k", None, 3), (None, 1, 2), ("", 1, 2)], 5) == set()
    assert run(spark, [("k", 1, 5), ("k", 5, 9), ("k", 20, None)], 3) == {("k", "period", 1, 9), ("k", "gap", 9, 20), ("k", "period", 20, None)}


def test_nodes_and_clashing_columns(spark):
    rows = [(" K ", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00+00:00", 1), ("k", "2024-01-02T09:00:00+09:00", None, 2), ("k", "bad", None, 3), ("k", "2023-01-01T00:00:00Z", "bad", 4)]
    df = spark.createDataFrame(rows, "key string, effective_from string, effective_until string, t int")
    assert {tuple(r) for r in intervals.node_periods(df).collect()} == {("k", "period", 1704067200, -1)}

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions.text import tokens_of
from ledgerloom.operators import pack, retrieval

N = "id string, content string, tags array<string>, updated_s long, created_s long, from_s long, until_s long, relations map<string,array<string>>, key string, status string, scope struct<project:string,workspace:string,session:string>"


def corpus(n=60, seed=4):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta 회의 예산".split()
    return [(f"m{i:02d}", " ".join(r.choices(words, k=r.randrange(0, 12))), r.choice([None, [], ["tag", None], ["beta"]]), r.choice([1, 2, 3]), 1, r.choice([None, 5, 15]), r.choice([None, 8, 20]),
             r.choice([None, {}, {"refines": [f"m{r.randrange(n):02d}", None]}, {"supersedes": [f"m{r.randrange(n + 9):02d}"]}]), None, "active", (None, None, None)) for i in range(n)]


def brute(rows, query):
    docs = {r[0]: tokens_of(r[1] + " " + " ".join(t for t in r[2] or [] if t)) for r in rows}
    df = Counter(t for d in docs.values() for t in set(d))
    out = []
    for r in rows:
        c = Counter(docs[r[0]])
        s = (5.0 if query.lower() in r[1].lower() else 0.0) + sum(c[t] * (math.log((len(rows) + 1) / (df[t] + 0.5)) + 1) for t in tokens_of(query) if c[t])
        if s > 0:
            out.append((round(s, 9), r[3], r[0]))
    return sorted(out, reverse=True)


def test_lexical_against_brute_force(spark):
    rows = corpus()
    queries = {"a": "beta beta gamma", "b": "회의 예산", "c": "alpha beta", "d": "", "e": "absent"}
    df = spark.createDataFrame(rows, N)
    got = retrieval.lexical_search(df, queries, 7).orderBy("query_id", "rank").collect()
    for q, text in queries.items():
        want = [(i, s) for s, _, i in brute(rows, text)[:7]] if tokens_of(text) else []
        assert [(r["id"], r["score"]) for r in got if r["query_id"] == q] == want, q
    assert retrieval.lexical_search(df.limit(0), queries).collect() == []


def test_graph_temporal_fuse(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, N)
    seeds = brute(rows, "gamma delta")[:5]
    scored = {i: s for s, _, i in seeds}
    by_id = {r[0]: r for r in rows}
    for s, _, i in seeds:
        for rel in retrieval.RELATIONS:
            for nb in (by_id[i][7] or {}).get(rel) or []:
                if nb in by_id and nb not in scored:
                    scored[nb] = s * 0.5
    want = sorted(((s, by_id[i][3], i) for i, s in scored.items()), reverse=True)[:5]
    got = retrieval.graph_search(df, {"q": "gamma delta"}, 5).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(i, round(s, 6)) for s, _, i in want]
    held = [r for r in rows if (r[5] is None or r[5] <= 10) and (r[6] is None or r[6] > 10)]
    lex = {i: s for s, _, i in brute(held, "gamma")}
    want = sorted(((lex.get(r[0], 0.0) + r[3] / 1e12, r[3], r[0]) for r in held), reverse=True)[:6]
    got = retrieval.temporal_search(df, {"q": "gamma"}, 10, 6).orderBy("rank").collect()
    assert [r["id"] for r in got] == [i for *_, i in want]
    assert retrieval.route("see `x`") == ["grep", "lexical"] and retrieval.route("plain words") == ["lexical", "graph"]
    assert retrieval.search(df, "gamma delta").count() <= 10 and retrieval.search(df, "gamma", "dense").count() > 0


def test_dense_in_blocks(spark):
    r = random.Random(0)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)] if i % 17 else [0.0] * 6) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    few = df.where("id % 10 = 0")
    one = retrieval.dense_search_all(df, few, 4, block=1000).collect()
    many = retrieval.dense_search_all(df, few, 4, block=3).collect()
    assert {(x["query_id"], x["id"], x["rank"]) for x in one} == {(x["query_id"], x["id"], x["rank"]) for x in many}
    unit = lambda v: math.sqrt(sum(x * x for x in v)) or 1
    q = rows[10][1]
    best = sorted(rows, key=lambda x: (-sum(a * b for a, b in zip(x[1], q, strict=True)) / unit(x[1]) / unit(q), x[0]))[:4]
    assert [x["id"] for x in sorted((x for x in one if x["query_id"] == 10), key=lambda x: x["rank"])] == [b[0] for b in best]
    assert retrieval.dense_search_all(df, df.limit(0)).collect() == []


def test_pack_budget(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, N)
    for budget in (0, 30, 60, 10_000):
        used, want = 0, []
        for _, _, i in brute(rows, "beta")[:12]:
            n = len(next(r for r in rows if r[0] == i)[1])
            if used + n > budget and want:
                break
            used += n
            want.append(i)
        got = pack.active_part(df, "beta", 12, budget).orderBy("pos").collect()
        assert [g["id"] for g in got] == want and got[-1]["used_chars"] == used


def test_join_on_terms_is_the_search(spark):
    r = random.Random(4)
    words = "cache router drift budget gateway team plan old".split()
    nodes = [(f"n{i:02d}", i % 7, " ".join(r.choices(words, k=r.randrange(0, 9))), r.choice([None, [], ["old"]])) for i in range(60)]
    df = spark.createDataFrame(nodes, "id string, updated_s long, content string, tags array<string>")
    asked = {"a": "router drift drift", "b": "team plan", "c": "zzz", "d": ""}
    queries = spark.createDataFrame([*asked.items(), ("e", None), (None, "team"), ("a", asked["a"])], "query_id string, query string")
    want = {(x["query_id"], x["id"], x["score"], x["rank"]) for x in retrieval.lexical_search(df, asked, 6).collect()}
    assert {(x["query_id"], x["id"], x["score"], x["rank"]) for x in retrieval.lexical_join(df, queries, 6).collect()} == want


def test_suppressed_rows_by_brute_force(spark):
    r = random.Random(8)
    for budget in (0, 5, 40, 400):
        rows = [(f"n{i:03d}", r.choice(["forgotten", "expired", "active"]), r.choice(["", "", "x" * r.randrange(1, 20)])) for i in range(80)]
        df = spark.createDataFrame(rows, "id string, status string, content string")
        active = spark.createDataFrame([(3,)], "used_chars long")
        want, run = [], 3
        for i, status, text in sorted(x for x in rows if x[1] != "active"):
            run += len(text)
            if want and run > budget:
                break
            want.append((i, status, text))
            if run > budget:
                break
        got = [tuple(x) for x in pack.suppressed_part(df, active, budget).orderBy("pos").select("pos", "id", "status", "preview").collect()]
        assert got == [(k + 1, *w) for k, w in enumerate(want)], budget
    assert pack.suppressed_part(df.limit(0), active, 5).collect() == []


def test_pack_record_and_renderings(spark):
    rows = [("a", "active", "billing cache"), ("b", "active", "billing"), ("c", "expired", "gone"), ("d", "forgotten", "")]
    df = spark.createDataFrame(rows, "id string, status string, content string").withColumns(
        {"key": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "updated_s": F.lit(1).cast("long"), "scope": F.struct(*[F.lit(None).cast("string").alias(f) for f in ("user", "workspace", "project", "agent", "session")])}
    )
    record = pack.pack_record(df, "billing cache")
    got = {(r["section"], r["pos"], r["id"], r["used_chars"]) for r in record.collect()}
    assert got == {("active", 1, "a", 13), ("active", 2, "b", 20), ("suppressed", 1, "c", 24), ("suppressed", 2, "d", None)}
    assert pack.render_sections(record).first()["text"] == "## Active\n- [a] billing cache\n- [b] billing\n\n## Suppressed\n- [c] (expired)\n- [d] (forgotten)"
    code = spark.createDataFrame([(2, "file", "", "x.py"), (1, "symbol", "go", "b.js")], "rank int, kind string, name string, path string")
    assert pack.render_code(code).first()["text"] == "- symbol go in b.js\n- file x.py"


def test_dense_search_keeps_the_best_of_a_task(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, size=(300, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.dense_search_all(df, df.where("id % 100 = 0"), 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm == 0, 1, norm)
    for q in (0, 100, 200):
        s = unit @ unit[q]
        order = sorted(range(300), key=lambda i: (-round(float(s[i]), 9), i))[:7]
        assert sorted(round(float(s[got[q, k + 1]]), 9) for k in range(7)) == sorted(round(float(s[i]), 9) for i in order)

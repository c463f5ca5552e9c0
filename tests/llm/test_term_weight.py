import math
import random
from collections import Counter

import numpy as np

from ledgerloom.llm import term_weight
from ledgerloom.llm.text import words

T = "id string, text string, keys array<string>"


def em(counts, steps=80):
    """The same mixture fitted to a plain list of counts."""
    n = len(counts)
    total = sum(counts)
    mean = total / n
    elite = max(sum(k * k for k in counts) / max(total, 1e-9), 1.0) + 0.1
    rest, share = max(mean * 0.2, 1e-9), min(max(sum(k > 0 for k in counts) / n * 0.5, 1e-12), 0.5)
    for _ in range(steps):
        r = [1 / (1 + math.exp(-max(-700, min(700, math.log(share) - math.log1p(-share) + k * math.log(elite / rest) - elite + rest)))) for k in counts]
        s = sum(r)
        share = min(max(s / n, 1e-12), 0.5)
        elite = max(sum(a * k for a, k in zip(r, counts, strict=True)) / max(s, 1e-12), 1e-6)
        rest = max(sum((1 - a) * k for a, k in zip(r, counts, strict=True)) / max(n - s, 1e-12), 1e-9)
        elite = max(elite, rest * (1 + 1e-9))
    return share, elite, rest


def corpus():
    r = random.Random(12)
    rows = []
    for i in range(120):
        text = " ".join(r.choices(["cache", "router", "und", "x"], k=r.randrange(0, 9))) + (" Rare! rare" * r.randrange(1, 3) if i % 20 == 0 else "")
        rows.append((f"n{i}", r.choice([text, text, text, None, ""]) if i % 20 else text, r.choice([None, [], ["Cache ", None, "", "cache"], ["router", "unseen"]]) if i % 20 else [" RARE"]))
    return [*rows, *rows[:7], (None, "cache", ["cache"])]


def check(spark, **kw):
    rows = corpus()
    got = {(r["id"], r["term"]): r for r in term_weight.scores(spark.createDataFrame(rows, T).selectExpr("*", "1 AS tf", "'q' AS term"), **kw).collect()}
    docs = {i: (Counter(words(t)), {k.strip().lower() for k in ks or [] if k} - {""}) for i, t, ks in rows if i}
    assert set(got) == {(i, t) for i, (_, ks) in docs.items() for t in ks}
    for term in ("cache", "router", "rare", "unseen"):
        share, elite, rest = em([c[term] for c, _ in docs.values()])
        for i, (c, ks) in docs.items():
            if term in ks:
                r = got[i, term]
                assert r["tf"] == c[term] and r["df"] == sum(term in k for _, k in docs.values())
                z = math.log(share) - math.log1p(-share) + c[term] * math.log(elite / rest) - elite + rest
                assert abs(r["score"] - (1 / (1 + math.exp(-z)) if c[term] else 0.0)) < 1e-6
    assert min(r["score"] for (_, t), r in got.items() if t == "rare") > 0.99
    by_tf = sorted({(r["tf"], round(r["score"], 9)) for (_, t), r in got.items() if t == "cache"})
    assert [s for _, s in by_tf] == sorted(s for _, s in by_tf) and len({k for k, _ in by_tf}) == len(by_tf) > 2


def test_scores_are_those_of_a_plain_fit(spark):
    check(spark)


def test_more_terms_than_are_handed_out(spark):
    check(spark, most_terms=2)


def test_empty(spark):
    assert term_weight.scores(spark.createDataFrame([], T)).collect() == []
    assert term_weight.scores(spark.createDataFrame([("a", "b", None)], T)).collect() == []


def test_fit_finds_both_rates():
    rng = np.random.default_rng(0)
    counts = np.concatenate([rng.poisson(6, 300), rng.poisson(0.2, 2700)])
    k, n = np.unique(counts[counts > 0], return_counts=True)
    share, elite, rest = term_weight.fit(np.zeros(len(k), int), k, n, 1, 3000, 200)
    assert abs(share[0] - 0.1) < 0.02 and abs(elite[0] - 6) < 0.4 and abs(rest[0] - 0.2) < 0.05

import random
import re

import numpy as np
import regex
from pyspark.sql import functions as F

from ledgerloom.llm import near_dup
from ledgerloom.llm.text import WordSets, words

T = "id string, text string"


def corpus(seed=3, n=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)] + ["기록을", "É", "x1"]
    rows = []
    for i in range(n):
        base = r.choices(vocab, k=r.choice([1, 3, 12, 30, 60]))
        rows.append((f"d{i:03d}", " ".join(base)))
        for k in range(r.choice([0, 0, 1, 2])):
            edited = [w for w in base if r.random() > 0.07] + r.choices(vocab, k=r.randrange(0, 3))
            r.shuffle(edited)
            rows.append((f"d{i:03d}e{k}", ", ".join(edited).upper()))
    return [*rows, *rows[:9], ("n", None), ("e", ""), ("b", " ,. "), (None, "w1 w2"), ("long", " ".join(vocab * 40))]


def brute(rows, threshold):
    sets = {i: frozenset(words(t)) for i, t in rows if i is not None}
    live = sorted(i for i, s in sets.items() if s)
    return {(a, b) for k, a in enumerate(live) for b in live[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 10 * threshold * len(sets[a] | sets[b]) - 1e-9}


def test_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, T).withColumns({"sid": F.lit(1), "a": F.lit("x"), "band": F.lit(2)})
    for threshold in (0.7, 0.8):
        got = [tuple(r) for r in near_dup.similar_pairs(df, threshold).collect()]
        want = brute(rows, threshold)
        assert len(got) == len(set(got)) and not set(got) - want
        assert len(want - set(got)) <= 0.01 * len(want)


def test_many_copies_and_one_large_bucket(spark):
    copies = [(f"c{i:04d}", "one two three four") for i in range(200)] + [(f"v{i:04d}", " ".join(f"k{j}" for j in range(60)) + f" only{i}") for i in range(150)]
    df = spark.createDataFrame(copies, T)
    assert near_dup.similar_pairs(df.where("id like 'c%'")).count() == 200 * 199 // 2
    got = near_dup.similar_pairs(df.where("id like 'v%'")).count()
    assert got >= 0.999 * 150 * 149 // 2
    assert near_dup.similar_pairs(spark.createDataFrame([], T)).collect() == []


def test_links_and_groups_tell_the_same_as_all_pairs(spark):
    rows = [*corpus(n=120), *[(f"c{i:03d}", "one two three four") for i in range(70)], ("c0x", "four, three TWO one five")]
    df = spark.createDataFrame(rows, T).withColumn("rep", F.lit("z"))
    pairs = {tuple(r) for r in near_dup.similar_pairs(df).collect()}
    links = {tuple(r) for r in near_dup.links(df).collect()}
    groups = {r["id"]: r for r in near_dup.groups(df).collect()}
    live = sorted({i for i, t in rows if i and words(t)})
    assert sorted(groups) == live
    rep = {i: groups[i]["rep"] for i in live}
    assert {(a, b) for k, a in enumerate(live) for b in live[k + 1 :] if rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in links} == pairs
    assert groups["c000"]["n_copies"] == 70 and groups["c000"]["n_links"] == 1 and groups["c0x"]["rep"] == "c0x"
    assert all(groups[i]["n_links"] == sum(rep[i] in link for link in links) for i in live)
    assert near_dup.links(spark.createDataFrame([], T)).collect() == [] == near_dup.groups(spark.createDataFrame([], T)).collect()


def test_joint_likelihood_estimates_similarity():
    r = random.Random(4)
    for n_a, n_b, common in ((40, 40, 32), (60, 30, 28), (50, 50, 20)):
        got, kept = [], 0
        for _ in range(80):
            a = [f"n{r.random()}".replace(".", "") for _ in range(n_a)]
            b = a[:common] + [f"n{r.random()}".replace(".", "") for _ in range(n_b - common)]
            x, y = (near_dup.sketch(WordSets([" ".join(t)]))[:, near_dup.SENT] for t in (a, b))
            d = x.astype(int) - y.astype(int)
            n = [np.array([float(k)]) for k in (n_a, n_b)]
            got.append(near_dup.estimate((d > 0).sum(1), (d < 0).sum(1), (d == 0).sum(1), *n)[0])
            kept += near_dup.not_ruled_out(x.astype(np.uint8), y.astype(np.uint8), *n, 0.7)[0]
        true = common / (n_a + n_b - common)
        assert abs(np.mean(got) - true) < 0.02, (n_a, n_b, common, np.mean(got), true)
        assert kept == 80 if true >= 0.66 else kept < 20 if true < 0.3 else True


def test_registers_estimate_similarity_and_merge():
    r = random.Random(9)
    hits, merged = [], True
    for _ in range(60):
        a = [str(r.random()) for _ in range(40)]
        b = a[8:] + [str(r.random()) for _ in range(8)]
        x, y, both = (near_dup.sketch(WordSets([" ".join(t).replace("0.", "n")]))[0] for t in (a, b, a + b))
        hits.append((x == y).mean())
        merged &= bool((np.maximum(x, y) == both).all())
    assert abs(np.mean(hits) - 32 / 48) < 0.03 and merged


def test_words_are_letters_and_digits():
    new = regex.compile(r"[\p{L}\p{N}]+")
    for t in ("a_b c-d é1 ½ x́y 가나1 Ⅷ ² 漢字 ß İ", "_", "", "ÀÉ 𝔘 ١٢"):
        assert words(t) == [w.lower() for w in new.findall(t)], t
    assert words(None) == [] and re.fullmatch(r"\w+", words("Ab")[0])


def test_long_texts_are_sketched_piece_by_piece(monkeypatch):
    texts = [" ".join(f"w{i * k % 997}" for i in range(400)) for k in range(1, 9)] + ["one"]
    whole = near_dup.sketch(WordSets(texts))
    monkeypatch.setattr(near_dup, "MOST_WORDS", 40)
    assert (near_dup.sketch(WordSets(texts)) == whole).all()


def test_slices_by_bytes():
    import pyarrow as pa

    from ledgerloom.llm.text import text_slices

    texts = [None, "", "a" * 50, "b", "c" * 500, None, "d"]
    batch = pa.record_batch([pa.array(texts), pa.array(range(7))], names=["t", "i"])
    parts = list(text_slices(batch, "t", 60))
    assert sum((p.column("t").to_pylist() for p in parts), []) == texts and len(parts) > 1
    assert list(text_slices(batch.slice(0, 0), "t", 60)) == []


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    rows = [(f"v{i:04d}", " ".join(f"k{j}" for j in range(60)) + f" only{i}") for i in range(400)] + corpus(n=60)
    df = spark.createDataFrame(rows, T)
    want = {tuple(r) for r in near_dup.similar_pairs(df).collect()}
    some = df.where("text is not null")
    hot = near_dup.hot_buckets(some, some.count(), 16, 4, most=50)
    assert hot and max(hot.values()) >= 8
    monkeypatch.setattr(near_dup, "hot_buckets", lambda *a: hot)
    assert {tuple(r) for r in near_dup.similar_pairs(df).collect()} == want and len(want) > 70_000


def test_texts_of_one_pattern_are_no_candidates(spark):
    r = random.Random(5)
    name = lambda: f"n{r.randrange(10**9)}"
    rows = [(f"p{i:04d}", f"We agreed that {name()} owns {r.choice(['backup', 'scope'])} while {name()} only watches") for i in range(3000)]
    rows += [(f"q{i:04d}", rows[i][1].replace("only", "just")) for i in range(50)]
    df = spark.createDataFrame(rows, T)
    assert near_dup.candidates(near_dup.sketched(df), 0.7).count() < 5_000
    assert {tuple(x) for x in near_dup.similar_pairs(df).collect()} == {(f"p{i:04d}", f"q{i:04d}") for i in range(50)}


def test_long_sets_meet_in_bands_and_across_the_bound(spark):
    r = random.Random(6)
    rows = []
    for i in range(120):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(50, 190))]
        rows += [(f"d{i:03d}", " ".join(base)), (f"d{i:03d}e", " ".join(base[: round(len(base) * r.choice([0.6, 0.72, 0.8, 0.95]))]))]
    sizes = {i: len(set(t.split())) for i, t in rows}
    want = brute(rows, 0.7)
    got = {tuple(x) for x in near_dup.similar_pairs(spark.createDataFrame(rows, T)).collect()}
    assert not got - want and len(want - got) <= 0.03 * len(want)
    assert {(sizes[a] > near_dup.PREFIX_WORDS) + (sizes[b] > near_dup.PREFIX_WORDS) for a, b in got} == {0, 1, 2}


def test_prefixes_share_a_word_in_any_order():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    sets = WordSets([" ".join(r.sample(vocab, r.randrange(1, 20))) for _ in range(250)])
    words_in = [set(sets.flat[s : s + n].tolist()) for s, n in zip(sets.starts, sets.sizes, strict=True)]
    for threshold in (0.5, 0.7, 0.9):
        for times in ({}, {h: r.randrange(1, 9) for h in sets.hashes.tolist()[::2]}):
            own, key, role = near_dup.prefixes(sets, np.arange(len(sets.sizes)), threshold, times)
            roles = [{} for _ in words_in]
            for i, k, x in zip(own.tolist(), key.tolist(), role.tolist(), strict=True):
                roles[i][k] = x
            for i, a in enumerate(words_in):
                for j, b in enumerate(words_in):
                    if i != j and len(a) <= len(b) and len(a & b) >= threshold * len(a | b) - 1e-9:
                        assert any(x == near_dup.EITHER and k in roles[j] for k, x in roles[i].items()), (threshold, a, b)


def test_hot_words_are_split_by_smaller_and_larger_sets(spark, monkeypatch):
    r = random.Random(8)
    rows = [(f"s{i:04d}", f"kept x{r.randrange(150)} y{r.randrange(3)} one two three four five six") for i in range(700)]
    df = spark.createDataFrame(rows, T)
    want = brute(rows, 0.7)
    times = near_dup.frequent_words(df, len(rows))
    hot = near_dup.hot_buckets(df, len(rows), 16, 4, 0.7, times, most=40)
    sets = WordSets([t for _, t in rows])
    _, key, role = near_dup.prefixes(sets, np.arange(len(sets.sizes)), 0.7, times)
    large = near_dup._larger_key(key[role == near_dup.LARGER]).view(np.int64).tolist()
    assert set(large) & set(hot) and set(key[role == near_dup.EITHER].view(np.int64).tolist()) & set(hot)
    monkeypatch.setattr(near_dup, "hot_buckets", lambda *a: hot)
    got = {tuple(x) for x in near_dup.similar_pairs(df).collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want)

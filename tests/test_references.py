import random

from pyspark.sql import functions as F

from ledgerloom.operators import references as ref

R = "ref_table string, record_id string, ref_field string, ns string, ref_id string, at_s long"
PA = "ns string, key string, created_s long, deleted_s long"


def brute(refs, parents):
    by = {(n, k): (c, d) for n, k, c, d in parents}
    out = set()
    for t, rec, f, ns, r, at in refs:
        if not r:
            continue
        period = None if at is None else f"1970-{'01' if at < 31 * 86400 else '02'}"
        if (ns, r) not in by:
            out.add((t, rec, f, r, "missing", period))
            continue
        c, d = by[ns, r]
        if at is not None and c is not None and c > at:
            out.add((t, rec, f, r, "late", period))
        if at is not None and d is not None and d < at:
            out.add((t, rec, f, r, "deleted", period))
    return out


def test_random_with_a_hot_key(spark):
    r = random.Random(2)
    parents = [(r.choice("np"), f"k{i:03d}", r.choice([None, r.randrange(4_000_000)]), r.choice([None, None, r.randrange(4_000_000)])) for i in range(200)]
    parents = list({(n, k): (n, k, c, d) for n, k, c, d in parents}.values())
    keys = [f"k{i:03d}" for i in range(230)] + ["", None]
    refs = [("t", f"r{i}", "f", r.choice("np"), "k900" if i % 3 == 0 else r.choice(keys), r.choice([None, r.randrange(4_000_000)])) for i in range(900)]
    refs += refs[:100]
    df = spark.createDataFrame(refs, R).withColumns({"missing": F.lit(1), "parent_s": F.lit(2), "key": F.lit("x")})
    got = [tuple(x) for x in ref.orphans(df, spark.createDataFrame(parents + parents[:20], PA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(refs, parents)


def test_empty_tables(spark):
    none = spark.createDataFrame([], PA)
    assert ref.orphans(spark.createDataFrame([], R), none).collect() == []
    got = ref.orphans(spark.createDataFrame([("t", "r", "f", "n", "x", 0)], R), none).collect()
    assert [tuple(x) for x in got] == [("t", "r", "f", "x", "missing", "1970-01")]
    assert ref.orphan_report(spark.createDataFrame(got)).first()["n_refs"] == 1

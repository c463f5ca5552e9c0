"""Overlapping and gapped time intervals (problem 2).

Sweep line: each interval gives a +1 event at its start and a -1 event at its end; events of one
key and instant are summed first, so repeated intervals and intervals that touch need no
special case. A prefix sum gives the number of intervals that hold; where it leaves or reaches zero a period
starts or ends, and from an end to the next start there is a gap.

No key is swept in one task: events are summed by key and instant map-side, the line of each key is cut into buckets of time, the net sum of
each bucket is carried forward over the (few) buckets of the key, and events are
paired within their own bucket. A key with a third of all rows is so spread over as
many tasks as it has buckets, and since times are whole seconds a bucket of a day holds at most 86,400 events, however dense the rows are.

Defined cases: null or empty key, null start, end at or before the start: the interval is skipped;
null end: open, the period's end is null here and -1 in p2_found; repeated rows change nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import norm, seconds
from ledgerloom.session import checkpointed

DAY_S = 86_400


def _bucket(t: Column, bucket_s: int) -> Column:
    return F.floor(t / F.lit(bucket_s))


def periods(intervals: DataFrame, bucket_s: int = DAY_S) -> DataFrame:
    """(key, kind, start_s, end_s) of intervals(key, start_s, end_s); end_s null is open."""
    ok = intervals.where("key is not null and key <> '' and start_s is not null and (end_s is null or end_s > start_s)")
    both = F.array(F.struct(F.col("start_s").alias("t"), F.lit(1).cast("long").alias("d")), F.struct(F.col("end_s").alias("t"), F.lit(-1).cast("long").alias("d")))
    events = ok.select("key", F.inline(both)).where("t is not null").withColumn("b", _bucket(F.col("t"), bucket_s))
    line = checkpointed(events.groupBy("key", "b", "t").agg(F.sum("d").alias("d")).where("d <> 0"))  # read three times
    by_key = W.partitionBy("key").orderBy("b")
    carried = line.groupBy("key", "b").agg(F.sum("d").alias("net"))
    carried = carried.select("key", "b", F.coalesce(F.sum("net").over(by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    in_bucket = W.partitionBy("key", "b").orderBy("t")
    counted = line.withColumn("run", F.sum("d").over(in_bucket)).join(carried, ["key", "b"]).withColumn("n", F.col("before") + F.col("run"))
    edges = counted.where((F.col("n") == 0) | (F.col("n") == F.col("d"))).select("key", "b", "t", (F.col("n") > 0).alias("opens"))
    first = edges.groupBy("key", "b").agg(F.min("t").alias("t0"))
    later = first.select("key", "b", F.lead("t0").over(by_key).alias("next_bucket_t"))
    paired = edges.withColumn("in_b", F.lead("t").over(in_bucket)).join(later, ["key", "b"])
    paired = paired.select("key", "opens", F.col("t").alias("start_s"), F.coalesce("in_b", "next_bucket_t").alias("end_s"))
    return paired.where("opens or end_s is not null").select("key", F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), "start_s", "end_s")


def node_periods(nodes: DataFrame, bucket_s: int = DAY_S) -> DataFrame:
    """(node_key, kind, start_s, end_s): periods and gaps of memory_nodes by normalised key, -1 for an open end.

    A non-null ``effective_until`` that is no time makes the interval end unknown; it is skipped.
    """
    until = seconds(F.col("effective_until"))
    rows = nodes.where(F.col("effective_until").isNull() | until.isNotNull()).select(
        norm(F.col("key")).alias("key"), seconds(F.col("effective_from")).alias("start_s"), until.alias("end_s")
    )
    return periods(rows, bucket_s).select(F.col("key").alias("node_key"), "kind", "start_s", F.coalesce("end_s", F.lit(-1).cast("long")).alias("end_s"))

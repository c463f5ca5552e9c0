"""References to records that do not exist (problem 7).

Keys of parents and the distinct referenced keys are range-partitioned together by a 64-bit hash; each
range holds its parents as an array sorted by that hash, and the references arrive in batches that are probed by one vectorised
binary search, whose hits are compared key by key, so that keys with one hash stay apart. References are folded to (key, first time, last time) before the shuffle, so a
key that a third of all references share is one row there. The number of ranges follows from the number of parents. Only keys with a miss ("suspects") are joined with the
full references again, in ``SALTS`` parts of each key, which gives the rows; their counts per table and period follow by aggregation.

Defined cases: null and empty references do not count; repeated rows and repeated ids in an
array count once; of parents with one key the earliest times hold; a referring row without a time is never late or deleted and has a null period;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ids, seconds

_MAX, _MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_SUSPECT = pa.schema([("ns", pa.string()), ("key", pa.string()), ("missing", pa.bool_()), ("parent_s", pa.int64()), ("deleted_s", pa.int64())])
#: Parents in one range, parts that the references to one key are dealt to.
RANGE_ROWS, SALTS = 1_000_000, 8


class _Parents:
    """The parents of a range: hashes in order, with the keys and the earliest times of creation and deletion."""

    def __init__(self, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        hashes = t.column("h").to_numpy()
        order = np.argsort(hashes, kind="stable")
        self.h = hashes[order]
        text = lambda c: t.column(c).cast(pa.large_string()).combine_chunks().take(pa.array(order))
        self.ns, self.key = text("ns"), text("key")
        # repeated rows of a key lie side by side
        again = np.zeros(len(order), bool)
        if len(order) > 1:
            same = pc.and_(pc.equal(self.ns[1:], self.ns[:-1]), pc.equal(self.key[1:], self.key[:-1])).to_numpy(zero_copy_only=False)
            again[1:] = same & (self.h[1:] == self.h[:-1])
        first = np.flatnonzero(~again)
        self.created, self.deleted = (np.minimum.reduceat(t.column(c).to_numpy()[order], first) for c in ("a", "b"))
        self.h, self.ns, self.key = self.h[first], self.ns.take(pa.array(first)), self.key.take(pa.array(first))

    def probe(self, refs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each reference has a parent, and that one's times."""
        n = refs.num_rows
        hit, born, gone = np.zeros(n, bool), np.full(n, _MAX), np.full(n, _MAX)
        h = refs.column("h").to_numpy(zero_copy_only=False)
        at, end = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        ns, key = (refs.column(c).cast(pa.large_string()) for c in ("ns", "key"))
        while len(rows := np.flatnonzero(at < end)):  # once, but for keys of one hash
            which, of = pa.array(at[rows]), pa.array(rows)
            same = pc.and_(pc.equal(self.ns.take(which), ns.take(of)), pc.equal(self.key.take(which), key.take(of))).to_numpy(zero_copy_only=False)
            r, p = rows[same], at[rows[same]]
            hit[r], born[r], gone[r] = True, np.minimum(born[r], self.created[p]), np.minimum(gone[r], self.deleted[p])
            at[rows] += 1
        return hit, np.where(hit, born, _MIN), gone


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tag, h, ns, key, a, b), parents (tag 0) first: the references (tag 1) whose key is missing or may be late or deleted.

    a, b: of a parent the times of creation and deletion, of a key the first and last time of reference.
    """
    held: list[pa.RecordBatch] = []
    parents: _Parents | None = None
    for batch in batches:
        cut = int(np.searchsorted(batch.column("tag").to_numpy(zero_copy_only=False), 1))  # sorted by tag
        if cut:
            held.append(batch.slice(0, cut))
        if cut == batch.num_rows:
            continue
        if parents is None and held:
            parents, held = _Parents(held), []
        refs = batch.slice(cut)
        n = refs.num_rows
        hit, born, gone = parents.probe(refs) if parents else (np.zeros(n, bool), np.full(n, _MIN), np.full(n, _MAX))
        first, last = (refs.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        keep = np.flatnonzero(~hit | (born > first) | (gone < last))
        if len(keep):
            rows = refs.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column("ns"), rows.column("key"), pa.array(~hit[keep]), pa.array(born[keep]), pa.array(gone[keep])], schema=_SUSPECT)


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs(ref_table, record_id, ref_field, ns, ref_id, at_s) that do not hold against parents(ns, key, created_s, deleted_s), with kind.

    kind: missing (no such key), late (the parent is created later), deleted (deleted_s before the reference).
    """
    refs = refs.where("ref_id is not null and ref_id <> ''").select("ref_table", "record_id", "ref_field", "ns", "ref_id", "at_s")
    asked = refs.groupBy("ns", F.col("ref_id").alias("key")).agg(F.min("at_s").alias("a"), F.max("at_s").alias("b"))
    lo, hi = F.lit(int(_MIN)), F.lit(int(_MAX))
    known = parents.where("key is not null").select(F.lit(0).alias("tag"), "ns", "key", F.coalesce("created_s", lo).alias("a"), F.coalesce("deleted_s", hi).alias("b"))
    rows = known.unionByName(asked.select(F.lit(1).alias("tag"), "ns", "key", F.coalesce("a", hi).alias("a"), F.coalesce("b", lo).alias("b")))
    rows = rows.select("tag", F.xxhash64("ns", "key").alias("h"), "ns", "key", "a", "b")
    parts = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parents.count() // RANGE_ROWS))
    probed = rows.repartitionByRange(parts, "h").sortWithinPartitions("tag").mapInArrow(_probe, "ns string, key string, missing boolean, parent_s long, deleted_s long")
    salted = probed.withColumnRenamed("key", "ref_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = refs.withColumn("salt", F.pmod(F.xxhash64("record_id", "at_s"), F.lit(SALTS)).cast("int")).join(salted, ["ns", "ref_id", "salt"])
    kinds = F.when(F.col("missing"), F.array(F.lit("missing"))).otherwise(
        F.array_compact(F.array(F.when(F.col("parent_s") > F.col("at_s"), "late"), F.when(F.col("deleted_s") < F.col("at_s"), "deleted")))
    )
    return out.select("ref_table", "record_id", "ref_field", "ref_id", F.explode(kinds).alias("kind"), F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM").alias("period")).distinct()


def ledger_orphans(nodes: DataFrame, patches: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_table, record_id, ref_field, ref_id, kind, period) of the ledger's references that do not hold."""
    at = seconds(F.col("created_at")).alias("at_s")
    from_array = lambda field: patches.select(F.lit("memory_patches").alias("ref_table"), F.col("id").alias("record_id"), F.lit(field).alias("ref_field"), F.lit("node").alias("ns"), F.explode(ids(F.col(field))).alias("ref_id"), at)
    from_edge = lambda field, ns: edges.select(F.lit("memory_edges").alias("ref_table"), F.col("id").alias("record_id"), F.lit(field).alias("ref_field"), F.lit(ns).alias("ns"), F.col(field).alias("ref_id"), at)
    refs = reduce(DataFrame.unionByName, [from_array("target_ids"), from_array("new_node_ids"), from_edge("to_id", "node"), from_edge("source_patch_id", "patch")])
    made = seconds(F.col("created_at")).alias("created_s")
    gone = F.when(F.col("status") == "forgotten", seconds(F.col("updated_at"))).alias("deleted_s")
    parents = nodes.select(F.lit("node").alias("ns"), F.col("id").alias("key"), made, gone).unionByName(
        patches.select(F.lit("patch").alias("ns"), F.col("id").alias("key"), made, F.lit(None).cast("long").alias("deleted_s"))
    )
    return orphans(refs, parents)


def orphan_report(found: DataFrame) -> DataFrame:
    """Number of orphan references per table, field, kind and month."""
    return found.groupBy("ref_table", "ref_field", "kind", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("record_id").alias("n_records"))

"""Applying a stream of inserts, updates and deletes (problem 4).

Commutative fold: per key the greatest struct(sequence, rank, payload) of the changes that set or remove the key,
and the greatest of those that only change it. Maxima do not depend on order or repetition, so
late and repeated changes need no sorting and a hot key is folded map-side before the shuffle. Removed keys stay
in the state as tombstones, so that the state can be folded again with later changes (``base``).

Defined cases: null arrays are empty, null and empty ids are skipped; a change without a time
comes before all others; unknown operations change nothing; an id that one patch removes and
inserts is inserted; an empty feed gives the base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ids, micros, norm

REPLACING = ("create", "supersede", "merge", "split")
CHANGING = ("update", "refine", "expand", "narrow")
REMOVING = ("expire", "deprecate", "forget")
REMOVE, INSERT, CHANGE = 0, 1, 2


def patch_changes(patches: DataFrame) -> DataFrame:
    """(key, t, seq, rank): one row for each change that a patch makes to an id."""
    op = norm(F.col("operation"))
    as_rows = lambda c, rank: F.transform(ids(F.col(c)), lambda x: F.struct(x.alias("key"), F.lit(rank).alias("rank")))
    none = F.array().cast("array<struct<key:string,rank:int>>")
    changes = (
        F.when(op.isin(*REPLACING), F.concat(as_rows("target_ids", REMOVE), as_rows("new_node_ids", INSERT)))
        .when(op.isin(*CHANGING), as_rows("target_ids", CHANGE))
        .when(op.isin(*REMOVING), as_rows("target_ids", REMOVE))
        .otherwise(none)
    )
    return patches.select(F.coalesce(micros(F.col("created_at")), F.lit(-(2**63))).alias("t"), F.col("id").alias("seq"), F.inline(changes))


def fold(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """State (key, is_set, changed) after changes(key, t, seq, rank); base is an earlier state.

    is_set is struct(t, seq, rank) of the last insert or removal, changed struct(t, seq) of the last change, if any.
    """
    order = F.struct("t", "seq", "rank")
    state = changes.groupBy("key").agg(
        F.max(F.when(F.col("rank") < CHANGE, order)).alias("is_set"), F.max(F.when(F.col("rank") == CHANGE, F.struct("t", "seq"))).alias("changed")
    )
    if base is None:
        return state
    return state.unionByName(base.select("key", "is_set", "changed")).groupBy("key").agg(F.max("is_set").alias("is_set"), F.max("changed").alias("changed"))


def live(state: DataFrame) -> DataFrame:
    """(key, seq): live keys with the sequence that last inserted or changed them."""
    set_at = F.struct(F.col("is_set.t").alias("t"), F.col("is_set.seq").alias("seq"))
    return state.where(F.col("is_set.rank") == INSERT).select("key", F.greatest(set_at, F.coalesce("changed", set_at))["seq"].alias("seq"))


def live_nodes(patches: DataFrame) -> DataFrame:
    """(node_id, patch_id) after the whole feed of patches."""
    return live(fold(patch_changes(patches))).select(F.col("key").alias("node_id"), F.col("seq").alias("patch_id"))

"""The effective view of a ledger and its complements.

Order of input is the order of ids. The winner of a key is one aggregate (least struct of negated rank,
negated time and id), not a window, so a key with a third of all nodes is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ids
from ledgerloom.operators.ledger import FORGOTTEN_LIKE, PATCH_OPERATIONS, RETIRING


class UnknownOperation(ValueError):
    """A patch has an operation that is not known."""


def retired_targets(patches: DataFrame) -> DataFrame:
    """(id) of the targets of retiring patches."""
    return patches.where(F.col("operation").isin(*RETIRING)).select(F.explode(ids(F.col("target_ids"))).alias("id")).distinct()


def check_operations(patches: DataFrame) -> None:
    """Fail before any plan is returned if an operation is unknown (one row is looked for, eagerly)."""
    bad = patches.where(F.col("operation").isNull() | ~F.col("operation").isin(*PATCH_OPERATIONS)).select("operation").first()
    if bad is not None:
        raise UnknownOperation(f"unknown patch operation {bad[0]!r}")


def is_active(session_id: str | None = None) -> Column:
    own = (F.col("status") == "active_session") & (F.col("scope.session") == session_id) if session_id else F.lit(False)
    return (F.col("status") == "active") | own


def scope_rank(session_id: str | None = None) -> Column:
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rank = F.when(filled("scope.project"), 3).when(filled("scope.workspace"), 2).otherwise(1)
    if session_id:
        rank = F.when((F.col("status") == "active_session") & (F.col("scope.session") == session_id), 4).otherwise(rank)
    return rank


def scope_winners(nodes: DataFrame, session_id: str | None = None) -> DataFrame:
    """One node of each key: the narrowest scope, then the latest update, then the first id; keyless nodes all stay.

    Adds scope_rank and view_ord: keyless nodes by id, then keys by their first id.
    """
    keyed = F.coalesce(F.col("key"), F.lit("")) != ""
    ranked = nodes.withColumn("scope_rank", scope_rank(session_id))
    order = F.struct((-F.col("scope_rank")).alias("r"), (-F.coalesce("updated_s", F.lit(-(2**62)))).alias("u"), F.col("id").alias("i"))
    best = ranked.where(keyed).groupBy("key").agg(F.min(order).alias("best"), F.min("id").alias("first_id"))
    won = ranked.where(keyed).join(best.select(F.col("best.i").alias("id"), "first_id"), "id")
    return ranked.where(~keyed).withColumn("view_ord", F.concat(F.lit("0"), "id")).unionByName(won.withColumn("view_ord", F.concat(F.lit("1"), "first_id")).drop("first_id"))


def effective_view(nodes: DataFrame, patches: DataFrame | None = None, session_id: str | None = None, unknown: str = "raise") -> DataFrame:
    """Nodes that are currently true. unknown: what unknown operations do, "raise" or "ignore"."""
    live = nodes.where(is_active(session_id))
    if patches is not None:
        if unknown == "raise":
            check_operations(patches)
        live = live.join(retired_targets(patches), "id", "left_anti")
    return scope_winners(live, session_id)


def suppressed(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("status").isin("active", "active_session"))


def conflicts(nodes: DataFrame) -> DataFrame:
    return nodes.where("status = 'conflict_pending'")


def forgotten_like(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status").isin(*FORGOTTEN_LIKE))

"""Typed views of the ledger tables: one row per id, times as epoch seconds, operations normalised.

A repeated row differs from the first only in its arrival and in the spelling of its times, so any one row of an id
stands for all; columns that no query asks for are pruned before the rows meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import norm, seconds
from ledgerloom.session import table

#: Operations of patches, in their fixed order.
PATCH_OPERATIONS = ("create", "update", "supersede", "refine", "expand", "narrow", "merge", "split", "expire", "forget", "deprecate", "rollback", "resolve_conflict")
#: Operations whose targets leave the effective view.
RETIRING = ("update", "supersede", "refine", "expand", "narrow", "merge", "split", "resolve_conflict", "expire", "forget", "deprecate")
#: Operations that set the status of their targets, with that status.
STATUS_SETTING = {"expire": "expired", "forget": "forgotten", "deprecate": "deprecated"}
#: Operations that need new content.
REPLACING = ("update", "supersede", "refine", "expand", "narrow", "merge", "split", "resolve_conflict")
NODE_STATUSES = ("active", "active_session", "pending", "pending_promotion", "promoted", "superseded", "deprecated", "expired", "forgotten", "conflict_pending", "discarded")
FORGOTTEN_LIKE = ("forgotten", "deprecated", "expired", "discarded")
SESSION_STATUSES = ("active", "ended", "forked", "merged")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "memory_nodes")
    times = {f"{short}_s": seconds(F.col(name)) for short, name in (("created", "created_at"), ("updated", "updated_at"), ("from", "effective_from"), ("until", "effective_until"))}
    return n.withColumns(times).withColumn("content", F.coalesce("content", F.lit(""))).drop("created_at", "updated_at", "effective_from", "effective_until", "ingested_at").dropDuplicates(["id"])


def patches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "memory_patches").withColumn("operation", norm(F.col("operation")))
    return p.withColumns({"created_s": seconds(F.col("created_at")), "applied_s": seconds(F.col("applied_at"))}).drop("created_at", "applied_at", "ingested_at").dropDuplicates(["id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_edges").withColumn("created_s", seconds(F.col("created_at"))).drop("created_at", "ingested_at").dropDuplicates(["id"])


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_sessions").withColumns({"started_s": seconds(F.col("started_at")), "ended_s": seconds(F.col("ended_at"))})

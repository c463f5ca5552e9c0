"""Streams of session events (ST1-ST3, ST5, ST6).

Batch forms of the same operators stand beside them, so that a stream can be checked against a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, last string"
OUT = "session_id string, n_events long, last_event string"


def session_events(sessions: DataFrame) -> DataFrame:
    """(session_id, pos, event, payload, created_s): the events of session rows, in their order."""
    e = sessions.select(F.col("id").alias("session_id"), F.posexplode("session_events").alias("pos", "e"))
    return e.select("session_id", "pos", "e.event", "e.payload", F.unix_seconds(F.col("e.created_at").try_cast("timestamp")).alias("created_s"))


def once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST5: events of a stream (event_id, ts, ...), each delivered once within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _append(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last = state.get if state.exists else (0, "")
    for pdf in batches:
        if len(pdf):
            n += len(pdf)
            last = max(last, *(f"{s:020d}/{e}" for s, e in zip(pdf["created_s"], pdf["event"], strict=True)))
    state.update((n, last))
    yield pd.DataFrame({"session_id": [key[0]], "n_events": [n], "last_event": [last.split("/", 1)[-1]]})


def running_sessions(events: DataFrame) -> DataFrame:
    """ST1: number of events and the latest event of each session, kept as state; output mode update."""
    return events.groupBy("session_id").applyInPandasWithState(_append, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def session_totals(events: DataFrame) -> DataFrame:
    """The batch form of running_sessions."""
    last = F.max(F.struct("created_s", "event")).alias("m")
    return events.groupBy("session_id").agg(F.count("*").alias("n_events"), last).select("session_id", "n_events", F.col("m.event").alias("last_event"))


def each_batch(stream: DataFrame, make: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """ST3: run a batch operator on every micro-batch and append its result; a batch that is run again overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_update(updates: DataFrame, target: str, checkpoint: str):
    """Write the changed rows of a keyed state, a folder for each micro-batch, over what a repeated batch left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_hash(text: Column) -> Column:
    """H1: the key of a text in the cache of vectors."""
    return F.substring(F.sha2(text, 256), 1, 16)


def missing_vectors(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """ST6: (id, hash, text) of nodes whose text has no vector in cache(id, hash) yet."""
    text = F.coalesce(F.nullif(F.col("retrieval.dense_text"), F.lit("")), F.col("content"))
    want = nodes.select("id", text_hash(text).alias("hash"), text.alias("text"))
    return want.join(cache.select("id", "hash"), ["id", "hash"], "left_anti")

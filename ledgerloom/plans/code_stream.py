"""Queries of the code graph and of streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import codegraph
from ledgerloom.operators.ledger import nodes
from ledgerloom.plans import cases
from ledgerloom.plans.retrieval import N, rows_sql
from ledgerloom.session import shared_folder, table
from ledgerloom.streaming import sessions as streams


def _history(s, d) -> DataFrame:
    """Orders as commits and parts as files; the newest order first."""
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("commit"), (-F.col("l_orderkey")).alias("pos"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").cast("string").alias("day"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path")
    )


def co_change(s, d):
    """Pairs with the bound of production; the tables have few, so the made log is counted too."""
    made = codegraph.history(_log(s)).select("commit", "path")
    return codegraph.co_change(_history(s, d).select(F.col("commit").cast("string").alias("commit"), "path").unionByName(made))


def git_churn(s, d):
    return codegraph.churn(_history(s, d)).select("path", "churn", "authors")


def _log(s) -> DataFrame:
    return s.createDataFrame([(cases.LOG,)], "value string")


def git_log(s, d):
    """The made log read and counted."""
    return codegraph.churn(codegraph.history(_log(s)))


def _files(s) -> DataFrame:
    return s.createDataFrame(cases.CODE_FILES, "path string, text string")


def code_symbols(s, d):
    return codegraph.parse(_files(s)).select("path", F.inline("symbols")).select("path", "name", "kind", "line")


def code_edges(s, d):
    """What the made files define and import, and with what they change."""
    pairs = codegraph.co_change(codegraph.history(_log(s)))
    return codegraph.edges(codegraph.parse(_files(s)), pairs)


def _text_files(s, d) -> DataFrame:
    """Every document as a file of its kind."""
    kind = F.coalesce("doc_kind", F.lit("txt"))
    return table(s, d, "documents").select(F.concat(kind, F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".js").otherwise(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def code_files(s, d):
    """Language, lines and bytes of all documents."""
    return codegraph.parse(_text_files(s, d)).select("path", "language", "lines", "bytes")


def code_search(s, d):
    """The made files, with their churn."""
    churn = codegraph.churn(codegraph.history(_log(s)))
    return codegraph.ranked(codegraph.search(codegraph.parse(_files(s)), churn, "run go py"))


def session_events(s, d):
    return streams.session_events(table(s, d, "agent_sessions"))


def session_totals(s, d):
    return streams.session_totals(streams.session_events(table(s, d, "agent_sessions")))


def stream_session_totals(s, d):
    """The same totals by a stream over the table's files, with state for each session."""
    t = table(s, d, "agent_sessions")
    reader = s.readStream.schema(t.schema)
    if any(f.endswith("/agent_sessions.parquet") for f in t.inputFiles()):  # the table is a single file
        stream = reader.option("pathGlobFilter", "agent_sessions.parquet").parquet(d)
    else:
        stream = reader.parquet(f"{d}/agent_sessions.parquet")
    out = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    streams.each_update(streams.running_sessions(streams.session_events(stream)), f"{out}/totals", f"{out}/state").awaitTermination()
    last = s.read.parquet(f"{out}/totals").groupBy("session_id").agg(F.max(F.struct("n_events", "last_event")).alias("m"))
    return last.select("session_id", "m.n_events", "m.last_event")


def incremental_embeddings(s, d):
    """Half of the ledger has vectors already."""
    n = nodes(s, d)
    cache = streams.missing_vectors(n.where(F.substring("id", 5, 1) < "8"), s.createDataFrame([], "id string, hash string")).select("id", "hash")
    return streams.missing_vectors(n, cache).select("id", "hash")


QUERIES = {f.__name__: f for f in (co_change, git_churn, git_log, code_symbols, code_edges, code_files, code_search, session_events, session_totals, stream_session_totals, incremental_embeddings)}
_TOTALS = "e AS (SELECT id AS session_id, unnest(session_events) AS e FROM agent_sessions), t AS (SELECT session_id, count(*) AS n_events, max((epoch(e.created_at::TIMESTAMPTZ)::BIGINT, e.event))[2] AS last_event FROM e GROUP BY session_id)"
SQL = {
    "co_change": f"""WITH m(c, path) AS (VALUES {rows_sql([("c3", "a.py"), ("c3", "b.js"), ("c2", "a.py"), ("c2", "b.js"), ("c2", "c.md"), ("c1", "a.py")])}), f AS (SELECT DISTINCT l_orderkey::VARCHAR AS c, 'part/' || l_partkey AS path FROM lineitem UNION ALL FROM m), s AS (SELECT c FROM f GROUP BY c HAVING count(*) BETWEEN 2 AND 25)
SELECT * FROM (SELECT x.path AS a, y.path AS b, count(*) AS n FROM f x JOIN f y ON x.c = y.c AND x.path < y.path WHERE x.c IN (FROM s) GROUP BY ALL ORDER BY n DESC, a, b LIMIT 200) WHERE n >= 2""",
    "git_log": f"SELECT * FROM (VALUES {rows_sql(cases.LOG_CHURN)}) t(path, churn, last_day, authors)",
    "code_symbols": f"SELECT * FROM (VALUES {rows_sql(cases.CODE_SYMBOLS)}) t(path, name, kind, line)",
    "code_edges": f"SELECT * FROM (VALUES {rows_sql(cases.CODE_EDGES)}) t(kind, source, target, weight)",
    "code_files": """SELECT coalesce(doc_kind, 'txt') || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.js' ELSE '.md' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'javascript' ELSE 'md' END AS language,
CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines, coalesce(strlen(text), 0) AS bytes FROM documents""",
    "git_churn": "SELECT 'part/' || l_partkey AS path, count(*) AS churn, count(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY ALL",
    "session_events": "SELECT id AS session_id, (generate_subscripts(session_events, 1) - 1)::INT AS pos, unnest(session_events).event AS event, unnest(session_events).payload AS payload, epoch(unnest(session_events).created_at::TIMESTAMPTZ)::BIGINT AS created_s FROM agent_sessions",
    "session_totals": f"WITH {_TOTALS} FROM t",
    "stream_session_totals": f"WITH {_TOTALS} FROM t",
    "incremental_embeddings": f"WITH {N} SELECT id, left(sha256(coalesce(nullif(retrieval.dense_text, ''), content)), 16) AS hash FROM n WHERE substr(id, 5, 1) >= '8'",
}

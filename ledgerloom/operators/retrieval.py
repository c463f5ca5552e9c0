"""Retrieval over ledger nodes (R1-R11): lexical, exact, graph, temporal, dense, routed and fused search.

Queries are parameters: a dict of query id to text. All of them are answered in two passes over the nodes, one for the document
frequencies of their terms and one for the scores; neither shuffles. Results have query_id, id, score,
rank and reasons; the order is score, update time, id, all descending, and is total.
Top-k per query is a row number under a limit, which Spark cuts down to k rows a task before the shuffle.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import contains_ci, detach_punctuation, normalized_query, tokenize, tokens_of

RELATIONS = ("supersedes", "refines", "expands", "narrows", "depends_on", "derived_from")
#: What makes a query exact rather than lexical: quotes, dates, ids, paths, file names, code (fixed pattern).
EXACT_HINT = re.compile(r"""["']|\b\d{4}-\d{2}-\d{2}\b|\b(mem|patch|edge|sess|session)_[A-Za-z0-9]+\b|[/\\][\w./\\-]+|\b\w+\.(py|ts|js|json|toml|md|jsonl)\b|`[^`]+`""")


def _top(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.desc("updated_s"), F.desc("id"))))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _document() -> Column:
    return F.concat_ws(" ", F.col("content"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))


def _scores(nodes: DataFrame, queries: Mapping[str, str]) -> Column:
    """array<struct<query_id,score,reasons>> of each node for every query.

    Document frequencies and the number of nodes come from one aggregate of one row, as wide as the queries have terms; scores
    are then an expression over the row's own tokens, so that neither needs a shuffle.
    """
    terms = {q: Counter(tokens_of(text)) for q, text in queries.items()}
    asked = sorted({t for c in terms.values() for t in c})
    held = nodes.select(F.array_distinct(F.filter(tokenize(_document()), lambda t: t.isin(*asked))).alias("held")) if asked else nodes.select(F.array().cast("array<string>").alias("held"))
    row = held.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("held", t)).alias(f"t{k}") for k, t in enumerate(asked)]).first()
    idf = {t: math.log((max(1, row["n"]) + 1) / (row[f"t{k}"] + 0.5)) + 1 for k, t in enumerate(asked)}
    times = lambda t: F.size(F.filter(F.col("_tokens"), lambda x: x == t)).cast("double")
    out = []
    for q, text in queries.items():
        phrase = F.contains(F.lower("content"), F.lit(text.lower())) if terms[q] else F.lit(False)
        parts = [F.when(phrase, 5.0).otherwise(0.0)] + [times(t) * F.lit(n * idf[t]) for t, n in sorted(terms[q].items())]
        reasons = F.array_sort(F.array_compact(F.array(F.when(phrase, "phrase"), *[F.when(F.array_contains("_tokens", t), t) for t in terms[q]])))
        out.append(F.struct(F.lit(q).alias("query_id"), F.round(reduce(operator.add, parts), 9).alias("score"), F.array_distinct(reasons).alias("reasons")))
    return F.array(*out)


def _tokens(queries: Mapping[str, str]) -> Column:
    """The tokens of a node that some query asks for."""
    asked = sorted({t for text in queries.values() for t in tokens_of(text)})
    return F.filter(tokenize(_document()), lambda t: t.isin(*asked)) if asked else F.array().cast("array<string>")


def lexical_scores(nodes: DataFrame, queries: Mapping[str, str]) -> DataFrame:
    """(query_id, id, updated_s, score, reasons) of all hits, unlimited.

    score: for each token of the query, with repeats, its count in the node times ln((N+1)/(df+0.5))+1, plus 5 where the
    content holds the whole query. N and df are those of the given nodes. Scores are rounded to 9 digits, so that the order of
    summation can't change the order of hits.
    """
    scores = _scores(nodes, queries)
    rows = nodes.select("id", "updated_s", "content", _tokens(queries).alias("_tokens")).select("id", "updated_s", F.inline(scores))
    return rows.where("score > 0").select("query_id", "id", "updated_s", "score", "reasons")


def lexical_search(nodes: DataFrame, queries: Mapping[str, str], limit: int = 10) -> DataFrame:
    """R1."""
    return _top(lexical_scores(nodes, queries), limit)


def lexical_join(nodes: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """R1, J3 for a table of queries(query_id, query): tokens of nodes and queries meet in a join on the term.

    The scores are those of lexical_search, with the phrase's 5 only where the node shares a token with the query. The limit is the k of each query.
    """
    asked = queries.where("query_id is not null and query is not null").select("query_id", "query").distinct()
    terms = asked.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tokens = nodes.select("id", "updated_s", F.explode(tokenize(_document())).alias("term"))
    tf = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "updated_s", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = nodes.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    weighed = terms.join(df, "term").select("query_id", "term", (F.col("times") * (F.log((n + 1) / (F.col("df") + 0.5)) + 1)).alias("weight"))
    hits = tf.join(weighed, "term").groupBy("query_id", "id", "updated_s").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))
    whole = hits.join(nodes.select("id", F.lower("content").alias("low")), "id").join(asked, "query_id")
    score = F.round(F.col("score") + F.when(F.contains("low", F.lower("query")), 5.0).otherwise(0.0), 9)
    return _top(whole.select("query_id", "id", "updated_s", score.alias("score")), limit)


def grep_search(nodes: DataFrame, queries: Mapping[str, str], limit: int = 20) -> DataFrame:
    """R2: the query inside content, id or a tag, in order of ids."""
    hit = lambda q: contains_ci(F.col("content"), q) | contains_ci(F.col("id"), q) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: contains_ci(t, q))
    found = F.array(*[F.struct(F.lit(k).alias("query_id"), hit(q).alias("hit")) for k, q in queries.items() if q])
    rows = nodes.select("id", "updated_s", F.inline(found)).where("hit").select("query_id", "id", "updated_s", F.lit(1.0).alias("score"), F.array(F.lit("exact")).alias("reasons"))
    return _top(rows, limit, F.asc("id"))


def _edges(k: int, relation: str) -> Column:
    """The entries of one relation with its place in the order of relations and their place in the list."""
    entries = F.coalesce(F.col("relations")[relation], F.array().cast("array<string>"))
    return F.transform(entries, lambda x, i: F.struct(F.lit(k).alias("rel_pos"), i.alias("pos"), F.lit(relation).alias("relation"), x.alias("neighbor")))


def graph_search(nodes: DataFrame, queries: Mapping[str, str], limit: int = 10) -> DataFrame:
    """Lexical seeds and their direct relations among the nodes, at half the seed's score.

    A neighbour of several seeds is reached from the first: by seed rank, order of relations, position in the list.
    """
    seeds = lexical_search(nodes, queries, limit)
    edges = F.flatten(F.array(*[_edges(k, r) for k, r in enumerate(RELATIONS)]))
    small = F.broadcast(seeds.select("query_id", "id", F.col("rank").alias("seed_rank"), "score"))  # limit rows a query
    out = nodes.join(small, "id").select("query_id", "seed_rank", "score", F.inline(edges))
    first = out.groupBy("query_id", "neighbor").agg(F.min(F.struct("seed_rank", "rel_pos", "pos", "relation", "score")).alias("m"))
    reached = first.select("query_id", F.col("neighbor").alias("id"), (F.col("m.score") * 0.5).alias("score"), F.array(F.concat(F.lit("graph:"), "m.relation")).alias("reasons"))
    known = nodes.select("id", "updated_s").join(reached, "id").join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    cols = ["query_id", "id", "updated_s", "score", "reasons"]
    return _top(seeds.select(*cols).unionByName(known.select(*cols)), limit)


def holds_at(as_of_s: int | None) -> Column:
    """Effective at a time; ends are exclusive, a missing bound is open."""
    if as_of_s is None:
        return F.lit(True)
    return (F.col("from_s").isNull() | (F.col("from_s") <= as_of_s)) & (F.col("until_s").isNull() | (F.col("until_s") > as_of_s))


def temporal_search(nodes: DataFrame, queries: Mapping[str, str], as_of_s: int | None = None, limit: int = 10) -> DataFrame:
    """Nodes effective at a time, by lexical score plus recency; every such node is a candidate."""
    held = nodes.where(holds_at(as_of_s))
    scores = _scores(held, queries)
    recency = F.coalesce(F.coalesce("updated_s", "created_s") / F.lit(1e12), F.lit(0.0)).alias("recency")
    rows = held.select("id", "updated_s", "content", recency, _tokens(queries).alias("_tokens")).select("id", "updated_s", "recency", F.inline(scores))
    return _top(rows.select("query_id", "id", "updated_s", (F.col("score") + F.col("recency")).alias("score"), F.array(F.lit("temporal")).alias("reasons")), limit)


def cosine(a: Column, b: Column) -> Column:
    """M3: 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def dense_search(vectors: DataFrame, queries: Mapping[str, list[float]], limit: int = 10) -> DataFrame:
    """Exact cosine of vectors(id, vec) with query vectors; ties go to the smaller id."""
    each = F.array(*[F.struct(F.lit(q).alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for q, v in queries.items()])
    rows = vectors.select("id", "vec", F.inline(each)).select("query_id", "id", cosine(F.col("vec"), F.col("q")).alias("score"))
    return _top(rows, limit, F.desc("score"), F.asc("id"))


def _block_scores(ids: list[int], unit: np.ndarray, limit: int):
    """The best rows of a task for each query of a block, with all that equal the last of them, so that ties are settled by the final order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(ids), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column("vec")
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            scores = unit @ (x / np.where(norm == 0, 1, norm)).T
            if scores.shape[1] >= limit:
                least = np.maximum(least, -np.partition(-scores, limit - 1, axis=1)[:, limit - 1])
            q, j = np.nonzero(scores >= least[:, None] - 1e-12)
            held.append((q, batch.column("id").to_numpy()[j], scores[q, j]))
            n += len(q)
            if n > 4 * limit * len(ids) + 100_000:
                held, n = _prune(held, least)
        if held:
            q, own, score = _prune(held, least)[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[q]), pa.array(own), pa.array(score)], names=["query_id", "id", "score"])

    return run


def _prune(held: list[tuple[np.ndarray, ...]], least: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], int]:
    q, own, score = (np.concatenate(x) for x in zip(*held, strict=True))
    keep = score >= least[q] - 1e-12
    return [(q[keep], own[keep], score[keep])], int(keep.sum())


def dense_search_all(vectors: DataFrame, queries: DataFrame, limit: int = 10, block: int = 4096) -> DataFrame:
    """R5 for a table of queries(id, vec) against all vectors(id, vec), both with long ids.

    The queries go to the tasks in blocks of bounded size, a scan a block; each task keeps its best rows by one matrix product a batch, and the
    best of all tasks follow. A vector without length has similarity 0 to all.
    """
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        x = np.array([r["vec"] for r in rows], np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        part = vectors.select("id", "vec").where("vec is not null").mapInArrow(_block_scores([r["id"] for r in rows], x / np.where(norm == 0, 1, norm), limit), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return _top(found, limit, F.desc("score"), F.asc("id"))


def route(query: str) -> list[str]:
    """Modes for a query."""
    return ["grep", "lexical"] if EXACT_HINT.search(query) else ["lexical", "graph"]


def fuse(results: Mapping[str, DataFrame], k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of results by mode."""
    rows = None
    for pos, (mode, hits) in enumerate(results.items()):
        one = hits.select("query_id", "id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(pos).alias("pos"), F.lit(mode).alias("mode")).alias("by"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.transform(F.array_sort(F.collect_list("by")), lambda x: x["mode"]).alias("reasons"))
    return _top(fused, limit, F.desc("score"), F.desc("id")).withColumn("score", F.round("score", 6))


def search(nodes: DataFrame, query: str, mode: str = "auto", limit: int = 10, as_of_s: int | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """One query in a mode; auto routes and fuses; dense falls back to lexical without vectors."""
    q = {"q": query}
    modes = {
        "lexical": lambda: lexical_search(nodes, q, limit),
        "grep": lambda: grep_search(nodes, q, limit),
        "graph": lambda: graph_search(nodes, q, limit),
        "temporal": lambda: temporal_search(nodes, q, as_of_s, limit),
    }
    dense = (lambda: dense_search(vectors, {"q": query_vector}, limit)) if vectors is not None and query_vector is not None else None
    if mode == "dense":
        return dense() if dense else modes["lexical"]()
    if mode in modes:
        return modes[mode]()
    parts = {m: modes[m]() for m in route(query)}
    if dense:
        parts["dense"] = dense()
    return fuse(parts, limit=limit)


def normalized_search(nodes: DataFrame, queries: Mapping[str, str], limit: int = 10) -> DataFrame:
    """Lexical search with glued punctuation set apart on both sides and stop words taken from the query."""
    return lexical_search(nodes.withColumn("content", detach_punctuation(F.col("content"))), {k: normalized_query(q) for k, q in queries.items()}, limit)


def confident_top_hit(hits: DataFrame, min_score: float = 8.0, margin: float = 1.15) -> DataFrame:
    """The first hit of each query, if it is good enough and clear of the second."""
    by_query = hits.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("score", "id"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    clear = F.col("second").isNull() | (F.col("first.score") >= F.col("second") * margin)
    return by_query.where((F.col("first.score") >= min_score) & clear).select("query_id", "first.id", "first.score")


def exact_value_target(nodes: DataFrame, queries: Mapping[str, str], exclude: frozenset[str] = frozenset()) -> DataFrame:
    """The first node that holds one of a text's value spans, codes before proper names."""
    codes = re.compile(r"\b[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+\b")
    names = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b")
    wanted = []
    for q, text in queries.items():
        wanted += [(q, 0, s.lower()) for s in codes.findall(text) if re.search(r"\d", s)]
        wanted += [(q, 1, s.lower()) for s in names.findall(text) if s.lower() not in exclude]
    if not wanted:
        return nodes.sparkSession.createDataFrame([], "query_id string, id string, kind int")
    low = F.lower("content")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s)), F.struct(F.lit(q).alias("query_id"), F.lit(k).alias("kind"))) for q, k, s in wanted]))
    return nodes.select("id", F.inline(found)).groupBy("query_id").agg(F.min(F.struct("kind", "id")).alias("m")).select("query_id", "m.id", "m.kind")

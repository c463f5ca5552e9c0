"""Retrieval indexes and exports (I1-I3, S11). A list never grows beyond a block, so no row holds all of a hot term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import tokenize
from ledgerloom.operators.retrieval import _document


def _block(id_: Column) -> Column:
    """The first two digits of an id: 256 blocks of equal size in expectation."""
    return F.substring(F.substring_index(id_, "_", -1), 1, 2)


def postings(nodes: DataFrame) -> DataFrame:
    """(term, block, ids): sorted ids of the nodes with a term, in blocks."""
    terms = nodes.select("id", F.explode(F.array_distinct(tokenize(_document()))).alias("term"))
    return terms.groupBy("term", _block(F.col("id")).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def day_buckets(nodes: DataFrame) -> DataFrame:
    """(day, block, ids): nodes by the UTC day from which they hold, else that of creation."""
    day = F.date_format(F.timestamp_seconds(F.coalesce("from_s", "created_s")), "yyyy-MM-dd")
    return nodes.groupBy(F.coalesce(day, F.lit("")).alias("day"), _block(F.col("id")).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def adjacency(nodes: DataFrame) -> DataFrame:
    """(id, relation, targets) of all non-empty relations."""
    return nodes.select("id", F.explode("relations").alias("relation", "targets")).where(F.size("targets") > 0)


def ntriples(nodes: DataFrame, base: str = "urn:ledger") -> DataFrame:
    """(triple): type, status, key and relations of all nodes as N-Triples."""
    iri = lambda c: F.concat(F.lit(f"<{base}/"), c, F.lit(">"))
    literal = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    line = lambda p, o: F.concat_ws(" ", iri(F.col("id")), iri(p), o, F.lit("."))
    own = F.array(line(F.lit("type"), literal(F.col("type"))), line(F.lit("status"), literal(F.col("status"))), F.when(F.col("key") != "", line(F.lit("key"), literal(F.col("key")))))
    links = adjacency(nodes).select("id", "relation", F.explode("targets").alias("target")).where("target is not null")
    return nodes.select(F.explode(F.array_compact(own)).alias("triple")).unionByName(links.select(line(F.concat(F.lit("rel/"), "relation"), iri(F.col("target"))).alias("triple")))


def index_summary(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Counts of the built indexes."""
    day = F.coalesce(F.date_format(F.timestamp_seconds(F.coalesce("from_s", "created_s")), "yyyy-MM-dd"), F.lit(""))
    terms = active.select(F.explode(F.array_distinct(tokenize(_document()))).alias("t")).agg(F.countDistinct("t")).scalar()
    linked = adjacency(nodes).agg(F.countDistinct("id")).scalar()
    return active.agg(F.count("*").alias("active_nodes"), F.countDistinct(day).alias("days")).select("active_nodes", "days", terms.alias("terms"), linked.alias("linked_nodes"))

"""Queries of the operators in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import encode, mojibake, near_dup, packing, pii, term_weight
from ledgerloom.session import checkpointed, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "memory_nodes").select("id", F.col("content").alias("text"))
    return near_dup.similar_pairs(texts, threshold=0.7).withColumnsRenamed({"id_a": "node_id_a", "id_b": "node_id_b"})


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of representatives; p3_groups tells whom they stand for."""
    texts = table(spark, d, "memory_nodes").select("id", F.col("content").alias("text"))
    return near_dup.links(texts, threshold=0.7).withColumnsRenamed({"id_a": "node_id_a", "id_b": "node_id_b"})


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "memory_nodes").select("id", F.col("content").alias("text"))
    return near_dup.groups(texts, threshold=0.7).withColumnsRenamed({"id": "node_id", "rep": "same_words_as"})


#: Posterior of the elite component from which a term is taken for characteristic.
ELITE = 0.5


def _scores(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "memory_nodes").select("id", F.col("content").alias("text"), F.col("retrieval.sparse_keys").alias("keys"))
    return term_weight.scores(records).withColumnRenamed("id", "node_id")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("score", F.round("score", 4))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that the posterior marks, then held to the counts that are asked for."""
    return _scores(spark, d).where(F.col("score") >= ELITE).where("df between 2 and 20 and tf >= 2").select("node_id", "term")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("content").alias("field"), F.col("content").alias("text")), F.struct(F.lit("quote").alias("field"), F.col("source.quote").alias("text")))
    return table(spark, d, "memory_nodes").select("id", F.inline(both))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    persons = table(spark, d, "principals").select(F.col("display_name").alias("name"))
    return pii.find(_texts(spark, d), persons).withColumnRenamed("id", "node_id")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    persons = table(spark, d, "principals").select(F.col("display_name").alias("name"))
    return pii.redact(_texts(spark, d), persons).withColumnRenamed("id", "node_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack_budgets").select("budget_id", F.col("capacity_tokens").alias("capacity"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return encode.count_tokens(table(spark, d, "documents")).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))


def p9_packs(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(_sizes(spark, d), _budgets(spark, d))
    return packed.select("budget_id", "pack_id", F.col("item_id").alias("doc_id"), "piece", F.col("start").alias("token_start"), F.col("size").alias("n_tokens"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sizes(spark, d), _budgets(spark, d)), _budgets(spark, d))


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is packed whole and once, no pack is too full and the packs are near the fewest there can be."""
    sizes = checkpointed(_sizes(spark, d))
    return packing.check_packs(packing.pack(sizes, _budgets(spark, d)), sizes, _budgets(spark, d)).withColumnRenamed("n_items", "n_docs")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_links, p3_groups, p5_found, p5_scores, p6_found, p6_redacted, p8_ids, p9_packs, p9_fill, p9_check, p10_found, p10_restored)}

"""Roll-ups of runs and checkpoints (A13-A16, G15): counters and rates, with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("long")


def action_counts(predictions: DataFrame) -> DataFrame:
    """(axis, value, n, n_hits) of predictions(action, query_type, hits): rows and hits by action and by query type."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit("")).alias("value")) for a in ("action", "query_type")])
    return predictions.select(F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.inline(axes)).groupBy("axis", "value").agg(F.count("*").alias("n"), F.sum("hits").alias("n_hits"))


def manifest_counts(checkpoints: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """(axis, value, n) of checkpoints(query_type, expected_action, fields): by type and action, and how often a field that must stay hidden is among the fields."""
    some = F.array_intersect(F.coalesce("fields", F.array().cast("array<string>")), F.array(*[F.lit(h) for h in hidden]).cast("array<string>"))
    own = [F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit("")).alias("value")) for a in ("query_type", "expected_action")]
    shown = F.transform(some, lambda x: F.struct(F.lit("hidden_field").alias("axis"), x.alias("value")))
    return checkpoints.select(F.inline(F.concat(F.array(*own), shown))).groupBy("axis", "value").agg(F.count("*").alias("n"))


def axis_rates(scored: DataFrame) -> DataFrame:
    """(query_type, n, n_protected, leak_rate, n_useful, utility_rate) of scored(query_type, protected, leaked, useful, answered).

    Leaks are a share of the checkpoints that protect something, utility of those that have something to tell; a share of nothing is null.
    """
    rate = lambda hit, of: F.round(F.sum(_flag(hit) * _flag(of)) / F.nullif(F.sum(_flag(of)), F.lit(0)), 6)
    return scored.groupBy(F.coalesce("query_type", F.lit("")).alias("query_type")).agg(
        F.count("*").alias("n"), F.sum(_flag("protected")).alias("n_protected"), rate("leaked", "protected").alias("leak_rate"), F.sum(_flag("useful")).alias("n_useful"), rate("answered", "useful").alias("utility_rate")
    )


def suite_rollup(suites: DataFrame) -> DataFrame:
    """(ok, n, score, percent) of suites(name, ok, score): all ok, the mean score with failed suites as 0, and the share that is ok in percent."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    score = F.when(ok, F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    return suites.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"), F.count("*").alias("n"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("score"), F.round(F.coalesce(F.avg(ok.cast("int")) * 100, F.lit(0.0)), 2).alias("percent"))

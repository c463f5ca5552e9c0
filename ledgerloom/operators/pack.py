"""Context packs under a node and a character budget.

The candidates of a pack are first cut to what can be in it (max_nodes rows, or the prefix of the suppressed that fits), so that the running
sums see a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval, view
from ledgerloom.session import checkpointed


def _prefix(rows: DataFrame, size: str, order: list, budget: int, used: object = 0) -> DataFrame:
    """Rows in order while their sizes fit the budget; the first row always."""
    w = W.orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("pos", F.row_number().over(w)).withColumn("run", run)
    return kept.where((F.col("pos") == 1) | (F.lit(used) + F.col("run") <= budget)).drop("run")


def active_part(nodes: DataFrame, query: str, max_nodes: int = 12, max_chars: int = 6000, session_id: str | None = None, patches: DataFrame | None = None) -> DataFrame:
    """(pos, id, n_chars, used_chars, content): the best nodes for the query, or the first of the view, while they fit."""
    seen = view.effective_view(nodes, patches, session_id, unknown="ignore")
    found = retrieval.lexical_search(seen, {"q": query}, max_nodes).select("id", "rank").collect() if query else []  # max_nodes rows
    if not found:
        first = seen.select("id", "view_ord").orderBy("view_ord", "id").limit(max_nodes).collect()
        found = [(r["id"], k + 1) for k, r in enumerate(first)]
    hits = nodes.sparkSession.createDataFrame([tuple(r) for r in found], "id string, rank int")
    some = seen.join(F.broadcast(hits), "id").select("id", "rank", "content", F.length("content").cast("long").alias("n_chars"))  # max_nodes rows
    kept = _prefix(some, "n_chars", [F.asc("rank")], max_chars)
    return kept.select(F.col("pos"), "id", "n_chars", F.sum("n_chars").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).alias("used_chars"), "content")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with pos, their number from 1 in the order of a column: by ranges, whose sizes are the only thing that meets."""
    parts = checkpointed(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())  # a row a range
    before, total = {}, 0
    for part, n in sizes:
        before[part], total = total, total + n
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(0)
    own = F.row_number().over(W.partitionBy("_part").orderBy(by))
    return parts.withColumn("pos", (start + own).cast("long")).drop("_part")


def suppressed_part(nodes: DataFrame, active: DataFrame, max_chars: int = 6000, preview: int = 240) -> DataFrame:
    """(pos, id, status, preview): suppressed nodes in order while the rest of the budget lasts, the first always.

    A row with text needs at least one character of the budget, so the running sum sees at most max_chars rows and one; rows without text take
    nothing, and all before the first row that doesn't fit are kept, however many they are.
    """
    used = active.agg(F.coalesce(F.max("used_chars"), F.lit(0))).first()[0]
    rows = view.suppressed(nodes).select("id", "status", F.substring("content", 1, preview).alias("preview"))
    first = rows.agg(F.min("id")).first()[0]
    some = rows.where("preview <> ''").orderBy("id").limit(max_chars + 1)
    run = F.sum(F.length("preview")).over(W.orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    over = some.withColumn("run", run).where(F.lit(used) + F.col("run") > max_chars).agg(F.min("id")).first()[0]
    kept = rows if over is None else rows.where((F.col("id") < over) | (F.col("id") == first))
    return numbered(kept, "id").select("pos", "id", "status", "preview")


def pack_record(nodes: DataFrame, query: str, max_nodes: int = 12, max_chars: int = 6000, session_id: str | None = None) -> DataFrame:
    """K1: (section, pos, id, status, text, used_chars): both sections of a pack; used_chars runs over the active and then the suppressed rows."""
    active = active_part(nodes, query, max_nodes, max_chars, session_id)
    gone = suppressed_part(nodes, active, max_chars)
    status = nodes.select("id", "status")
    shown = active.join(status, "id").select(F.lit("active").alias("section"), F.col("pos").cast("long").alias("pos"), "id", "status", F.col("content").alias("text"), F.col("n_chars").alias("n"))
    rest = gone.select(F.lit("suppressed").alias("section"), "pos", "id", "status", F.col("preview").alias("text"), F.length("preview").cast("long").alias("n"))
    total = shown.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a running sum over the rows of a section that have text: the active ones are max_nodes at most, the others as many as the budget has characters
    running = lambda df, start: df.where("n > 0").select("section", "pos", (F.lit(start) + F.sum("n").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).alias("used_chars"))
    used = running(shown, 0).unionByName(running(rest, total))
    return shown.unionByName(rest).join(used, ["section", "pos"], "left").select("section", "pos", "id", "status", "text", "used_chars")


def render_sections(record: DataFrame) -> DataFrame:
    """One text of a pack record with both sections; suppressed rows are named with their status."""
    line = F.when(F.col("section") == "active", F.concat(F.lit("- ["), "id", F.lit("] "), F.regexp_replace("text", r"\s+", " "))).otherwise(F.concat(F.lit("- ["), "id", F.lit("] ("), "status", F.lit(")")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    by = record.groupBy("section").agg(F.array_join(ordered, "\n").alias("lines"))
    part = lambda k, head: F.coalesce(F.max(F.when(F.col("section") == k, F.concat(F.lit(f"## {head}\n"), "lines"))), F.lit(f"## {head}\n"))
    return by.agg(F.concat_ws("\n\n", part("active", "Active"), part("suppressed", "Suppressed")).alias("text"))


def render_code(hits: DataFrame) -> DataFrame:
    """One text of the hits of a code search, rows(rank, kind, name, path), a line each."""
    line = F.concat(F.lit("- "), "kind", F.lit(" "), F.when(F.col("name") == "", F.col("path")).otherwise(F.concat("name", F.lit(" in "), "path")))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def render_markdown(active: DataFrame) -> DataFrame:
    """One text of the active part, a line a node in order."""
    line = F.concat(F.lit("- ["), "id", F.lit("] "), F.regexp_replace("content", r"\s+", " "))
    return active.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def render_toml(active: DataFrame, query: str) -> DataFrame:
    """A [[memory]] table for each node in order."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    row = F.concat(F.lit("[[memory]]\nid = "), quote(F.col("id")), F.lit("\ncontent = "), quote(F.col("content")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]), "\n\n")
    return active.agg(F.concat(F.lit("query = "), quote(F.lit(query)), F.lit("\n\n"), body).alias("text"))

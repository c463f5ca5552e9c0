"""Filling fixed-capacity containers with items (problem 9).

Hierarchical residual packing: items are dealt to shards of bounded size, each shard is packed best-fit with the largest
first, and bins that are nearly full are emitted. The items of the other bins go on to the next round,
where the shards are fewer, so that what was left over in different shards meets; rounds end when one
shard holds all that is left or a round hardly lowers the number of underfull bins. No task ever gets more than
about ``shard_items`` items, whatever the sizes are.

An underfull bin goes on as its items rather than as one item: best fit leaves at most one bin of a shard half empty, and of two bins that are over half full
neither fits into the other, so that bins taken whole would hardly ever be merged.

Only an item larger than the capacity is cut: into whole containers and one rest, which is an item like the
others. Defined cases: an item without a size or of size 0 takes no room and comes into some bin; ties go by
item id; repeated rows are items of their own only if their ids differ; no items, or no budgets, give no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed

_BINS = "budget_id string, capacity long, item_id long, piece long, start long, size long, pack_id string, done boolean"


#: Budgets that one expression holds, items in one task, the fill from which a bin is emitted at once, and the share of underfull bins a round must not exceed to be followed by another.
BUDGETS_AT_ONCE, SHARD_ITEMS, FULL, GAIN = 200, 4_000, 0.998, 0.95


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each size and free space of each bin; sizes are taken in the given order, each into the fullest bin it fits."""
    free: list[int] = []
    by_room: list[tuple[int, int]] = []  # (free space, bin), sorted
    where = []
    for s in sizes:
        k = bisect_left(by_room, (s, -1))
        if k == len(by_room):
            b, room = len(free), capacity
            free.append(capacity)
        else:
            room, b = by_room.pop(k)
        free[b] = room - s
        if free[b] > 0:
            insort(by_room, (free[b], b))
        where.append(b)
    return where, free


def _pieces(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """items(item_id, size) x budgets(budget_id, capacity): the pieces to pack. The budgets are a handful of parameters."""
    rows = [(r["budget_id"], int(r["capacity"])) for r in budgets.select("budget_id", "capacity").distinct().collect()]
    if any(c <= 0 for _, c in rows):
        raise ValueError("a capacity must be positive")
    some = items.where("item_id is not null").groupBy("item_id").agg(F.max("size").alias("size"))
    size = F.coalesce(F.col("size"), F.lit(0).cast("long")).alias("size")
    each = lambda part: F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in part]).cast("array<struct<budget_id:string,capacity:bigint>>")
    parts = [rows[k : k + BUDGETS_AT_ONCE] for k in range(0, len(rows), BUDGETS_AT_ONCE)] or [[]]
    at = reduce(DataFrame.unionByName, [some.select("item_id", size, F.inline(each(part))) for part in parts])
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.col("capacity"))
    cut = at.select("budget_id", "capacity", "item_id", "size", F.posexplode(starts).alias("piece", "start"))
    return cut.select("budget_id", "capacity", "item_id", F.col("piece").cast("long").alias("piece"), "start", F.least("capacity", F.col("size") - F.col("start")).alias("size"))


def _shard_packer(r: int, full: float):
    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item_id", "piece"], ascending=[False, True, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        where, free = best_fit(pdf["size"].tolist(), capacity)
        near = capacity - full * capacity
        pdf["pack_id"] = [f"{key[0]}-{r}-{key[1]}-{b}" for b in where]
        pdf["done"] = [free[b] <= near for b in where]
        return pdf[["budget_id", "capacity", "item_id", "piece", "start", "size", "pack_id", "done"]]

    return pack_shard


def pack(items: DataFrame, budgets: DataFrame, full: float = FULL, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget_id, pack_id, item_id, piece, start, size): every piece of every item in one pack, for each budget.

    full: the fill from which a bin is emitted at once; shard_items: items in one task.
    """
    return reduce(DataFrame.unionByName, pack_rounds(items, budgets, full, shard_items)).select("budget_id", "pack_id", "item_id", "piece", "start", "size")


def pack_rounds(items: DataFrame, budgets: DataFrame, full: float = FULL, shard_items: int = SHARD_ITEMS) -> list[DataFrame]:
    """What each round emits."""
    left = checkpointed(_pieces(items, budgets))
    done: list[DataFrame] = []
    n = left.groupBy("budget_id").count().agg(F.max("count")).first()[0] or 0  # of the budget with the most pieces
    bins_before = None
    while True:
        r, shards = len(done), max(1, -(-n // shard_items))
        placed = left.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece", F.lit(r)), F.lit(shards)))
        placed = checkpointed(placed.groupBy("budget_id", "shard").applyInPandas(_shard_packer(r, full), _BINS))
        open_ = placed.where("not done")
        rows = open_.groupBy("budget_id").agg(F.count("*").alias("n"), F.countDistinct("pack_id").alias("bins"))
        row = rows.agg(F.max("n").alias("n"), F.sum("bins").alias("bins")).first()
        if shards == 1 or not row["n"] or (bins_before is not None and row["bins"] > GAIN * bins_before):
            return [*done, placed]
        done.append(placed.where("done"))
        left, n, bins_before = open_.drop("pack_id", "done"), row["n"], row["bins"]


def check_packs(packed: DataFrame, items: DataFrame, budgets: DataFrame, slack: float = 0.01) -> DataFrame:
    """(budget_id, n_items, n_overfull, n_wrong, near_bound) of each budget: items placed; packs over their capacity; items that are not there whole and once, or are
    cut without need; whether there are at most so many more packs than the sizes need at least."""
    of = budgets.select("budget_id", "capacity").distinct()
    packs = packed.groupBy("budget_id", "pack_id").agg(F.sum("size").alias("used")).join(F.broadcast(of), "budget_id")
    by_pack = packs.groupBy("budget_id").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("n_overfull"), F.count("*").alias("n_packs"), F.ceil(F.sum("used") / F.first("capacity")).alias("least"))
    place = F.struct("piece", "start", "size")
    got = packed.groupBy("budget_id", "item_id").agg(F.sum("size").alias("placed"), F.sort_array(F.collect_list(place)).alias("pieces")).join(F.broadcast(of), "budget_id")
    sizes = items.where("item_id is not null").groupBy("item_id").agg(F.coalesce(F.max("size"), F.lit(0)).alias("whole"))
    as_due = F.forall(F.transform("pieces", lambda x, i: (x["piece"] == i) & (x["start"] == i * F.col("capacity"))), lambda x: x)
    due = F.greatest(F.ceil(F.col("whole") / F.col("capacity")), F.lit(1))
    right = as_due & (F.size("pieces") == due) & (F.col("placed") == F.col("whole"))
    by_item = got.join(sizes, "item_id", "left").groupBy("budget_id").agg(F.count("*").alias("n_items"), F.sum((~F.coalesce(right, F.lit(False))).cast("long")).alias("n_wrong"))
    near = F.col("n_packs") <= F.ceil(F.col("least") * (1 + slack)) + 1
    return by_item.join(by_pack, "budget_id").select("budget_id", "n_items", "n_overfull", "n_wrong", near.alias("near_bound"))


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Packs, the number there must be at least, tokens and share of the space in use for each budget."""
    by_pack = packed.groupBy("budget_id", "pack_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    by_budget = by_pack.groupBy("budget_id").agg(F.count("*").alias("n_packs"), F.sum("used").alias("n_tokens"), F.sum("n").alias("n_pieces"))
    return by_budget.join(budgets.select("budget_id", "capacity").distinct(), "budget_id").withColumns(
        {"least_packs": F.ceil(F.col("n_tokens") / F.col("capacity")), "fill": F.col("n_tokens") / (F.col("n_packs") * F.col("capacity"))}
    )

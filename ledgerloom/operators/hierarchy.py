"""Parent-child links of unknown depth to full hierarchies (problem 1).

Leaf peeling, bottom-up, with splicing of unary chains: in each round every leaf is
peeled off its parent, to which it sends the size of its subtree, and of the nodes with exactly one child an independent set (the local
maxima of a per-round hash) is spliced out, its child being tied to its parent by a link that
spans more levels and carries the sizes of what hangs on it. Splicing keeps the number of rounds logarithmic in the depth, where plain
peeling needs one round a level. The rounds are then read in reverse: when the nodes of a
round are visited, their parents are placed already or are roots, so that root, depth and path follow from
one join a round, and so does the size of a spliced node from that of its child. A link from a node to itself, given or left over by splicing, is what remains of a ring: the
nodes that lead there have root ``cycle`` and depth -1.

When no more than ``BASE_ROWS`` links are left, counted, one task does the rounds that would follow: it peels them leaf by leaf, sends the sizes up and ties every
node to the parent outside that it ends at; what can't be peeled there lies on a ring. The remaining rounds have a few rows each and would cost a job each.

Each round shuffles only the links that are still there, a constant fraction of those of the round before, and in reverse only
the nodes that are placed so far without roots, which grow in the same way: both passes are linear in the number of links. No
list of children or descendants is gathered in a row, so a root above a third of all
nodes is an ordinary key: children are counted and sizes summed with partial aggregation. Descendants come out as rows, from the paths.

Defined cases: null ids in a link drop the link; repeated links count once; a node with several parents follows
the smallest of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ids
from ledgerloom.session import checkpointed

#: Kinds of record; BASE is a node that the last task ties to a parent above its own.
KEEP, LEAF, SPLICE, RING, BASE, LONGER = 0, 1, 2, 3, 4, -1
#: Links, and ids of spliced nodes that they carry, that one task peels at the end.
BASE_ROWS, BASE_IDS = 10_000, 1_000_000


def supersede_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, parent) with the newer node as parent, stated by an edge or by either relation, both ends existing."""
    known = nodes.select(F.col("id").alias("known")).where("known is not null").distinct()
    by_edge = edges.where("type = 'supersedes'").select(F.col("to_id").alias("child"), F.col("from_id").alias("parent"))
    older = nodes.select(F.explode(ids(F.col("relations")["supersedes"])).alias("child"), F.col("id").alias("parent"))
    newer = nodes.select(F.col("id").alias("child"), F.explode(ids(F.col("relations")["superseded_by"])).alias("parent"))
    links = by_edge.unionByName(older).unionByName(newer).where("child is not null and parent is not null").distinct()
    return links.join(known, links.parent == known.known, "left_semi").join(known, links.child == known.known, "left_semi")


_RECORD = ("node", "parent", "w", "via", "own", "hang", "low", "low_hang", "kind")


def _peel_base(with_paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = {r.node: r for r in pd.concat(held).itertuples(index=False)}
        waiting = dict.fromkeys(rows, 0)
        for r in rows.values():
            if r.parent in rows:
                waiting[r.parent] += 1
        size = {n: int(r.own) for n, r in rows.items()}
        order = [n for n in rows if not waiting[n]]
        for n in order:  # grows while it is read
            p = rows[n].parent
            if p in rows:
                size[p] += size[n] + int(rows[n].hang)
                waiting[p] -= 1
                if not waiting[p]:
                    order.append(p)
        out = {n: (n, r.parent, int(r.w), None, 0, int(r.hang), None, None, RING) for n, r in rows.items() if waiting[n]}
        for n in reversed(order):
            r = rows[n]
            via = list(r.via) if with_paths else None
            if r.parent not in rows or r.parent in out and out[r.parent][-1] == RING:
                out[n] = (n, r.parent, int(r.w), via, size[n], int(r.hang), None, None, LEAF)
            else:
                _, top, w, up, *_ = out[r.parent]
                out[n] = (n, top, w + int(r.w), [*up, r.parent, *via] if with_paths else None, size[n], 0, None, None, BASE)
        yield pd.DataFrame(list(out.values()), columns=_RECORD)

    return run


def peel(links: DataFrame, with_paths: bool = False, base_rows: int = BASE_ROWS) -> list[DataFrame]:
    """The peel records of each round, every node that is no root in one of them.

    w is the number of levels between node and parent, via the nodes between them, top down (null without paths), own the node with all that was peeled
    off it, hang the own of the nodes between node and parent; low is the only child of a spliced node, low_hang the hang of the link to it.
    """
    empty = F.array().cast("array<string>") if with_paths else F.lit(None).cast("array<string>")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    live = links.where("child is not null and parent is not null").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    live = live.select("node", "parent", one.alias("w"), empty.alias("via"), one.alias("own"), zero.alias("hang"))
    rounds: list[DataFrame] = []
    sent = None
    while True:
        r = len(rounds)
        child = F.struct("node", "w", "via", "hang")
        kids = live.select(F.col("parent").alias("p"), child.alias("low"), zero.alias("add"))
        if sent is not None:
            kids = kids.unionByName(sent.select(F.col("parent").alias("p"), F.lit(None).cast(kids.schema["low"].dataType).alias("low"), (F.col("own") + F.col("hang")).alias("add")))
        kids = kids.groupBy("p").agg(F.count("low").alias("n"), F.min("low").alias("low"), F.sum("add").alias("add"))
        rank = lambda c: F.xxhash64(c, F.lit(r))  # noqa: E731, B023
        kind = (
            F.when(F.col("node") == F.col("parent"), RING)
            .when(F.coalesce("n", zero) == 0, LEAF)
            .when((F.col("n") == 1) & (rank(F.col("node")) > rank(F.col("low.node"))) & (rank(F.col("node")) > rank(F.col("parent"))), SPLICE)
            .otherwise(KEEP)
        )
        flagged = live.join(kids, live.node == kids.p, "left").withColumn("kind", kind).withColumn("own", F.col("own") + F.coalesce("add", zero))
        spliced = F.col("kind") == SPLICE
        itself = F.struct(
            F.struct("w", "parent", "via", "hang").alias("link"), "node", "own", F.when(spliced, F.col("low.node")).alias("low"), F.when(spliced, F.col("low.hang")).alias("low_hang"), "kind"
        )
        via = F.concat("via", F.array("node"), "low.via") if with_paths else F.col("via")
        link = F.struct((F.col("w") + F.col("low.w")).alias("w"), "parent", via.alias("via"), (F.col("hang") + F.col("own") + F.col("low.hang")).alias("hang"))
        longer = F.struct(link.alias("link"), F.col("low.node").alias("node"), F.lit(None).cast("long").alias("own"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("long").alias("low_hang"), F.lit(LONGER).alias("kind"))
        rows = flagged.select(F.inline(F.when(spliced, F.array(itself, longer)).otherwise(F.array(itself))))
        # a child whose parent was spliced out has two links: the longer one holds, and it is peeled later
        settled = rows.groupBy("node").agg(
            F.max("link").alias("link"), F.max("own").alias("own"), F.max("low").alias("low"), F.max("low_hang").alias("low_hang"), F.max("kind").alias("kind"), F.min("kind").alias("least")
        )
        settled = settled.select("node", "link.parent", "link.w", "link.via", "own", "link.hang", "low", "low_hang", F.when(F.col("least") == LONGER, KEEP).otherwise(F.col("kind")).alias("kind"))
        settled = checkpointed(settled)
        rounds.append(settled.where(F.col("kind") != KEEP).select(*_RECORD))
        live, sent = settled.where(F.col("kind") == KEEP).select("node", "parent", "w", "via", "own", "hang"), settled.where(F.col("kind") == LEAF)
        left = live.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size("via"), F.lit(0))), F.lit(0)).alias("ids")).first()
        if not left["n"]:
            return rounds
        if left["n"] <= base_rows and left["ids"] <= BASE_IDS:
            add = sent.groupBy(F.col("parent").alias("p")).agg(F.sum(F.col("own") + F.col("hang")).alias("add"))
            rest = live.join(add, live.node == add.p, "left").select("node", "parent", "w", "via", (F.col("own") + F.coalesce("add", zero)).alias("own"), "hang")
            schema = "node string, parent string, w long, via array<string>, own long, hang long, low string, low_hang long, kind int"
            return [*rounds, checkpointed(rest.repartition(1).mapInPandas(_peel_base(with_paths), schema))]


def hierarchy(links: DataFrame, with_paths: bool = False, with_sizes: bool = False, base_rows: int = BASE_ROWS) -> DataFrame:
    """(node_id, root_id, depth[, path][, n_descendants]) of every node of links(child, parent).

    path holds the ids from the root to the node; for nodes that lead into a ring root_id is
    'cycle', depth -1, path null and n_descendants 0.
    """
    links = checkpointed(links.where("child is not null and parent is not null").select("child", "parent"))  # read for the peel and for the roots
    rounds = peel(links, with_paths, base_rows)
    no_path, zero = F.lit(None).cast("array<string>"), F.lit(0).cast("long")
    # what leads into a ring is known before anything is placed
    rings = [r.where(F.col("kind") == RING).select("node", F.lit("cycle").alias("root"), F.lit(-1).cast("long").alias("depth"), no_path.alias("path"), zero.alias("size")) for r in rounds]
    placed = checkpointed(reduce(DataFrame.unionByName, rings))
    for records in reversed(rounds):
        now = records.where(F.col("kind").isin(LEAF, SPLICE, BASE))
        above = placed.select(F.col("node").alias("parent"), "root", "depth", F.col("path").alias("up"))
        joined = now.join(above, "parent", "left")
        size = F.col("own")
        if with_sizes:  # the child of a spliced node was peeled later, so its size is known
            joined = joined.join(placed.select(F.col("node").alias("low"), F.col("size").alias("low_size")), "low", "left")
            size = F.col("own") + F.coalesce("low_size", zero) + F.coalesce("low_hang", zero)
        cycle = F.coalesce(F.col("root") == "cycle", F.lit(False))
        up = F.coalesce("up", F.array("parent"))  # a parent without a record is a root
        new = joined.select(
            "node",
            F.coalesce("root", "parent").alias("root"),
            F.when(cycle, F.lit(-1).cast("long")).otherwise(F.coalesce("depth", zero) + F.col("w")).alias("depth"),
            (F.when(~cycle, F.concat(up, "via", F.array("node"))) if with_paths else no_path).alias("path"),
            F.when(cycle, zero).otherwise(size).alias("size"),
        )
        placed = checkpointed(placed.unionByName(new))  # grows as fast as the rounds, so that all of them together write a few times the nodes
    roots = links.select(F.col("parent").alias("node")).distinct().join(placed.select("node"), "node", "left_anti")
    if with_sizes:
        leaves = [r.where(F.col("kind") == LEAF).select(F.col("parent").alias("node"), (F.col("own") + F.col("hang")).alias("size")) for r in rounds]
        roots = roots.join(reduce(DataFrame.unionByName, leaves).groupBy("node").agg((F.sum("size") + 1).alias("size")), "node", "left")
    else:
        roots = roots.withColumn("size", zero)
    top = roots.select("node", F.col("node").alias("root"), zero.alias("depth"), (F.array("node") if with_paths else no_path).alias("path"), "size")
    out = placed.unionByName(top)
    n = F.greatest(F.coalesce("size", zero) - 1, zero)
    return out.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", *(["path"] if with_paths else []), *([n.alias("n_descendants")] if with_sizes else []))


def descendants(placed: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every node beneath every node, from the paths of hierarchy(with_paths=True)."""
    up = placed.where("path is not null").select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return up.where("ancestor_id <> node_id").select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).cast("long").alias("distance"))

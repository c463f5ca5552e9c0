"""Access-controlled packs (G1-G8, J11, J20): who may see what, and what a pack must not show.

An access list is acl(project_id, principal_id); nodes without projects are open to all. Checkpoints are parameters: a dict
of checkpoint to (principal, query text).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import detach_punctuation, normalized_query, proper_noun_pairs, redact, tokenize, tokens_of
from ledgerloom.operators import view
from ledgerloom.operators.detect import EDGE_L, EDGE_R, REVOKE_WORDS, _any_word
from ledgerloom.session import checkpointed

#: Fixed values.
FLOOR, OVERRIDE_RATIO = 4.0, 3.0
RETROSPECTIVE = re.compile(r"\b(deleted|removed|earlier|retired|used to|before|previous|no longer|rotation|originally|what was|former|history|old)\b", re.IGNORECASE)


def project_aliases(projects: DataFrame) -> DataFrame:
    """G1: (project_id, alias): the part of an id after its first underscore, else all of it."""
    alias = F.when(F.contains("project_id", F.lit("_")), F.expr("substring(project_id, instr(project_id, '_') + 1)")).otherwise(F.col("project_id"))
    return projects.select("project_id", F.lower(alias).alias("alias")).where("alias <> ''").distinct()


def detect_projects(texts: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, project_id) of texts(id, text) that name a project's alias as a whole word.

    Words are exploded and joined on the alias, so that projects may be many.
    """
    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("alias"))
    return words.join(project_aliases(projects), "alias").select("id", "project_id").distinct()


def directory(relationships: DataFrame) -> DataFrame:
    """G1: (project_id, alias, principals, labels) of relationships(project_id, principal_id, label): each project's aliases, who belongs to it, and the terms of its labels."""
    terms = F.array_distinct(F.flatten(F.collect_list(F.coalesce(tokenize(F.col("label")), F.array().cast("array<string>")))))
    by = relationships.where("coalesce(project_id, '') <> ''").groupBy("project_id").agg(F.array_sort(F.collect_set("principal_id")).alias("principals"), F.array_sort(terms).alias("labels"))
    return project_aliases(by).join(by, "project_id")


def revoked_turns(turns: DataFrame, principals: DataFrame, acl: DataFrame) -> DataFrame:
    """(id, project_id, principal_id) that each of turns(id, speaker_id, text) revokes: the projects that the turn names, or all of the principal's."""
    who = revocations(turns, principals).where("principal_id is not null")
    named = detect_projects(turns.select("id", "text").join(who.select("id").distinct(), "id", "left_semi"), acl.select("project_id").distinct())
    some = who.join(named, "id").select("id", "project_id", "principal_id")
    every = who.join(named.select("id").distinct(), "id", "left_anti").join(acl, "principal_id").select("id", "project_id", "principal_id")
    return some.join(acl.select("project_id", "principal_id").distinct(), ["project_id", "principal_id"], "left_semi").select("id", "project_id", "principal_id").unionByName(every).distinct()


def revoked_access(turns: DataFrame, principals: DataFrame, acl: DataFrame) -> DataFrame:
    """(project_id, principal_id) that some of turns(id, speaker_id, text) revokes."""
    return revoked_turns(turns, principals, acl).select("project_id", "principal_id").distinct()


def revocations(turns: DataFrame, principals: DataFrame) -> DataFrame:
    """(id, principal_id) of turns(id, speaker_id, text) that revoke access: the named principal, else the speaker."""
    said = turns.where(_any_word(F.col("text"), REVOKE_WORDS))
    first = principals.select("principal_id", F.lower(F.substring_index(F.trim("display_name"), " ", 1)).alias("word")).where("word <> ''")
    words = said.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("word"))
    named = words.join(first, "word").groupBy("id").agg(F.min("principal_id").alias("named"))
    return said.join(named, "id", "left").select("id", F.coalesce("named", "speaker_id").alias("principal_id"))


def allowed(acl: DataFrame, revoked: DataFrame | None = None) -> DataFrame:
    """The access list without revocations(project_id, principal_id)."""
    return acl if revoked is None else acl.join(revoked, ["project_id", "principal_id"], "left_anti")


#: Stands for all principals.
EVERYONE = "*"


def authorized(nodes: DataFrame, acl: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal_id, id): nodes(id, project_id) that each of the principals may see.

    A node under no project is open to all and comes once, with EVERYONE as principal, so that open nodes are no pairs with all principals. A node
    may stand under several projects, one a row.
    """
    asked = principals.select("principal_id").where("principal_id is not null").distinct()
    may = acl.join(asked, "principal_id", "left_semi").select("project_id", "principal_id").distinct()
    of = nodes.select("id", F.coalesce("project_id", F.lit("")).alias("project_id")).groupBy("id").agg(F.collect_set("project_id").alias("projects"))
    free = of.where(F.array_contains("projects", "")).select(F.lit(EVERYONE).alias("principal_id"), "id")
    closed = of.where(~F.array_contains("projects", ""))
    pairs = lambda some: some.select("id", F.explode("projects").alias("project_id")).join(may, "project_id").select("principal_id", "id")
    # only nodes under several projects can give a pair twice
    return free.unionByName(pairs(closed.where(F.size("projects") == 1))).unionByName(pairs(closed.where(F.size("projects") > 1)).distinct())


#: Hits that count on each side of a search.
SIDES = {"gone": 5, "mine": 8, "others": 5}


def _base(nodes: DataFrame) -> DataFrame:
    """(id, updated_s, content, tags, project_id, gone): forgotten and active nodes."""
    cols = ["id", "updated_s", "content", "tags", F.coalesce("scope.project", F.lit("")).alias("project_id")]
    return view.effective_view(nodes).select(*cols, F.lit(False).alias("gone")).unionByName(view.forgotten_like(nodes).select(*cols, F.lit(True).alias("gone")))


def _sided(rows: DataFrame, acl: DataFrame, checkpoints: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows(checkpoint_id, project_id, gone, ...) with the side they are on for the asker of the checkpoint."""
    askers = F.create_map(*[F.lit(x) for c, (p, _) in checkpoints.items() for x in (c, p)])
    may = acl.where(F.col("principal_id").isin(*sorted({p for p, _ in checkpoints.values()}))).select("project_id", "principal_id").distinct().withColumn("may", F.lit(True))
    joined = rows.withColumn("principal_id", askers[F.col("checkpoint_id")]).join(may, ["project_id", "principal_id"], "left")
    return joined.withColumn("side", F.when(F.col("gone"), "gone").when((F.col("project_id") == "") | F.col("may"), "mine").otherwise("others")).drop("principal_id", "may")


def _sided_hits(base: DataFrame, acl: DataFrame, checkpoints: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(checkpoint_id, side, id, score, rank): relevant hits of each side; document frequencies are those of the side.

    Each node is read once: only nodes that hold a term of a query, or the query, become rows of its checkpoint, and the sides are counted by project.
    """
    spark = base.sparkSession
    queries = {c: normalized_query(q) for c, (_, q) in checkpoints.items()}
    terms = {c: Counter(tokens_of(q)) for c, q in queries.items()}
    asked = sorted({t for k in terms.values() for t in k})
    side = ["checkpoint_id", "side"]
    own = ["id", "updated_s", "project_id", "gone"]
    times = spark.createDataFrame([(c, t, n) for c, k in terms.items() for t, n in sorted(k.items())], "checkpoint_id string, term string, times int")
    clean = base.withColumn("content", detach_punctuation(F.col("content")))
    doc = F.concat_ws(" ", F.col("content"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    tokens = clean.select(*own, F.explode(F.filter(tokenize(doc), lambda t: t.isin(*asked))).alias("term"))
    tf = tokens.groupBy(*own, "term").agg(F.count("*").alias("tf")).join(F.broadcast(times), "term")  # the terms of the queries
    tf = _sided(tf, acl, checkpoints)
    df = tf.groupBy(*side, "term").agg(F.count("*").alias("df"))
    each = F.explode(F.array(*[F.lit(c) for c in checkpoints])).alias("checkpoint_id")
    n = _sided(base.groupBy("project_id", "gone").agg(F.count("*").alias("k")).select("project_id", "gone", "k", each), acl, checkpoints).groupBy(*side).agg(F.sum("k").alias("n"))
    weight = F.log((F.col("n") + 1) / (F.col("df") + F.lit(0.5))) + 1
    scored = tf.join(df, [*side, "term"]).join(n, side).select(*side, "id", "updated_s", (F.col("tf") * F.col("times") * weight).alias("part"))
    whole = F.array_compact(F.array(*[F.when(F.contains(F.lower("content"), F.lit(q.lower())), F.lit(c)) for c, q in queries.items() if terms[c]], F.lit(None).cast("string")))
    phrase = _sided(clean.select(*own, F.explode(whole).alias("checkpoint_id")), acl, checkpoints).select(*side, "id", "updated_s", F.lit(5.0).alias("part"))
    hits = scored.unionByName(phrase).groupBy(*side, "id", "updated_s").agg(F.round(F.sum("part"), 9).alias("score")).where(F.col("score") >= FLOOR)
    w = W.partitionBy(*side).orderBy(F.desc("score"), F.desc("updated_s"), F.desc("id"))
    most = F.coalesce(*[F.when(F.col("side") == k, m) for k, m in SIDES.items()])
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(SIDES.values())).where(F.col("rank") <= most).select(*side, "id", "score", "rank")


def policy_packs(nodes: DataFrame, acl: DataFrame, checkpoints: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(checkpoint_id, action, node_id, text) for each checkpoint; node_id and text null where nothing is shown.

    One search over forgotten, allowed and other active nodes decides for all checkpoints: a relevant forgotten node vetoes, unless the allowed
    hit is over three times as good and the query does not look back.
    """
    spark = nodes.sparkSession
    base = checkpointed(_base(nodes))  # read for terms, phrases, counts and names
    hits = checkpointed(_sided_hits(base, acl, checkpoints))  # at most 18 rows a checkpoint
    top = lambda k: F.max(F.when(F.col("side") == k, F.col("score"))).alias(k)
    best = hits.groupBy("checkpoint_id").agg(*[top(k) for k in SIDES])
    every = spark.createDataFrame([(c, bool(RETROSPECTIVE.search(q))) for c, (_, q) in checkpoints.items()], "checkpoint_id string, looks_back boolean")
    overridden = F.col("mine").isNotNull() & ~F.col("looks_back") & (F.col("mine") > OVERRIDE_RATIO * F.col("gone"))
    action = F.when(F.col("gone").isNotNull() & ~F.coalesce(overridden, F.lit(False)), "no_memory").when(F.col("mine").isNotNull(), "answer").when(F.col("others").isNotNull(), "refuse").otherwise("no_memory")
    decided = every.join(best, "checkpoint_id", "left").select("checkpoint_id", action.alias("action"))
    shown = hits.where("side = 'mine'").join(decided.where("action = 'answer'"), "checkpoint_id").select("checkpoint_id", "id")
    texts = shown.join(base.select("id", "content"), "id")
    masked = texts.join(_protected(texts, base, acl, checkpoints), ["checkpoint_id", "id"], "left")
    masked = masked.select("checkpoint_id", "id", "content", redact(F.col("content"), F.coalesce("terms", F.array().cast("array<string>"))).alias("text"))
    touched = masked.groupBy("checkpoint_id").agg(F.bool_or(F.col("text") != F.col("content")).alias("touched"))
    out = decided.join(touched, "checkpoint_id", "left").join(masked.select("checkpoint_id", F.col("id").alias("node_id"), "text"), "checkpoint_id", "left")
    return out.select("checkpoint_id", F.when(F.col("touched"), "answer_redacted").otherwise(F.col("action")).alias("action"), "node_id", "text")


def _protected(shown: DataFrame, base: DataFrame, acl: DataFrame, checkpoints: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(checkpoint_id, id, terms): capitalised names of shown nodes that a node hidden from the asker holds too, joined on the names."""
    own = shown.select("checkpoint_id", "id", F.explode(F.array_distinct(proper_noun_pairs(F.col("content")))).alias("term"))
    names = base.select("project_id", "gone", F.explode(F.array_distinct(proper_noun_pairs(F.col("content")))).alias("term")).distinct()
    met = _sided(own.join(names, "term"), acl, checkpoints).where("side <> 'mine'")
    return met.groupBy("checkpoint_id", "id").agg(F.collect_set("term").alias("terms"))


def leaks(packs: DataFrame, nodes: DataFrame, acl: DataFrame, askers: DataFrame) -> DataFrame:
    """(checkpoint_id, node_id, problem) of packs that show what is not active or not allowed; askers(checkpoint_id, principal_id)."""
    shown = packs.where("node_id is not null").select("checkpoint_id", F.col("node_id").alias("id")).join(nodes.select("id", "status", F.col("scope.project").alias("project_id")), "id", "left")
    stale = shown.where("status is null or status <> 'active'").select("checkpoint_id", F.col("id").alias("node_id"), F.lit("not active").alias("problem"))
    closed = shown.where("coalesce(project_id, '') <> ''").join(askers, "checkpoint_id").join(acl, ["project_id", "principal_id"], "left_anti").select("checkpoint_id", F.col("id").alias("node_id"), F.lit("not allowed").alias("problem"))
    return stale.unionByName(closed)


#: Columns of a checkpoint that an agent may see (fixed values); all others are pruned from the plan.
VISIBLE = ("checkpoint_id", "episode_id", "as_of_turn_id", "asker", "query_text")


def visible(checkpoints: DataFrame) -> DataFrame:
    """P6."""
    return checkpoints.select(*VISIBLE)


def word_boundary(alias: str) -> str:
    """A pattern of a whole word."""
    return "(?i)" + EDGE_L + re.escape(alias) + EDGE_R

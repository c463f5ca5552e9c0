"""Replay of episodes turn by turn (G6, ST2): each turn makes, replaces or forgets a fact, judged against the facts so far, and may revoke access to them.

Turns within an episode depend on each other in order, episodes do not: every episode is one group, played by one task. Facts are indexed by
their terms there, so a turn costs what shares a term with it. An episode that held a third of all turns would still be one task: the replay is sequential by definition.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalized_query, tokens_of
from ledgerloom.operators.detect import classify_turn
from ledgerloom.operators.governance import revoked_turns

FACTS = "episode_id string, turn long, action string, fact_turn long, status string, access array<string>"
CODE = re.compile(r"\b[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+\b")
#: Score and lead over the next fact that a target needs (fixed values).
FORGET, SUPERSEDE = (20.0, 1.2), (8.0, 1.15)


class Facts:
    """The live facts of an episode, indexed by their terms: a turn meets only facts that share a term with it."""

    def __init__(self) -> None:
        self.live: dict[int, Counter[str]] = {}
        self.postings: dict[str, dict[int, int]] = {}

    def add(self, turn: int, text: str) -> None:
        self.live[turn] = Counter(tokens_of(text))
        for t, n in self.live[turn].items():
            self.postings.setdefault(t, {})[turn] = n

    def drop(self, turn: int) -> None:
        for t in self.live.pop(turn):
            del self.postings[t][turn]
            if not self.postings[t]:
                del self.postings[t]

    def with_code(self, code: str) -> int | None:
        """The first fact that holds a code; a code is part of one token."""
        found = [min(facts) for t, facts in self.postings.items() if code in t]
        return min(found, default=None)

    def target(self, text: str, least: float, margin: float) -> int | None:
        """The fact that a turn means: one that holds a code of it, else a clear lexical hit."""
        for code in (c.lower() for c in CODE.findall(text) if re.search(r"\d", c)):
            if (k := self.with_code(code)) is not None:
                return k
        scores: dict[int, float] = {}
        for t, n in Counter(tokens_of(normalized_query(text))).items():
            held = self.postings.get(t, {})
            weight = math.log((len(self.live) + 1) / (len(held) + 0.5)) + 1
            for k, c in held.items():
                scores[k] = scores.get(k, 0.0) + n * c * weight
        best = sorted(((s, k) for k, s in scores.items()), reverse=True)[:2]
        if not best or best[0][0] < least or (len(best) > 1 and best[0][0] < margin * best[1][0]):
            return None
        return best[0][1]


class Policy:
    """Who may see each fact: the list of its project when it was made, less what has been revoked since."""

    def __init__(self) -> None:
        self.access: dict[int, set[str]] = {}
        self.project: dict[int, str | None] = {}
        self.revoked: set[tuple[str | None, str]] = set()

    def revoke(self, project: str | None, principal: str) -> None:
        self.revoked.add((project, principal))
        for turn, own in self.project.items():
            if own == project:
                self.access[turn].discard(principal)

    def made(self, turn: int, project: str | None, principals: Iterable[str], instead_of: int | None) -> None:
        """A fact that replaces another takes over who may see that one."""
        if instead_of is not None:
            project, principals = self.project[instead_of], self.access[instead_of]
        self.project[turn] = project
        self.access[turn] = {p for p in principals if (project, p) not in self.revoked}


def _play(key: tuple, turns: pd.DataFrame) -> pd.DataFrame:
    facts, policy = Facts(), Policy()
    seen: set[str] = set()
    log: list[tuple] = []
    status: dict[int, str] = {}
    for turn, text, kind, project, principals, gone in turns.sort_values(["turn"])[["turn", "text", "kind", "project_id", "principals", "gone"]].itertuples(index=False):
        for x in gone:
            policy.revoke(x["project_id"], x["principal_id"])
        plain = " ".join(text.lower().split())
        target = facts.target(text, *(FORGET if kind == "forget" else SUPERSEDE)) if kind != "create" else None
        if kind == "forget":
            log.append((turn, "forget", target))
            if target is not None:
                facts.drop(target)
                status[target] = "forgotten"
            continue
        if plain in seen and target is None:
            log.append((turn, "duplicate", None))
            continue
        if target is not None:
            facts.drop(target)
            status[target] = "superseded"
        seen.add(plain)
        facts.add(turn, text)
        policy.made(turn, project, principals, target)
        status[turn] = "active"
        log.append((turn, "supersede" if target is not None else "create", target))
    rows = [(key[0], turn, action, target, status.get(turn), sorted(policy.access[turn]) if turn in status else None) for turn, action, target in log]
    return pd.DataFrame(rows, columns=["episode_id", "turn", "action", "fact_turn", "status", "access"]).astype({"fact_turn": "Int64"})


def _rows(turns: DataFrame) -> DataFrame:
    rows = turns.where("episode_id is not null and text is not null")
    return rows.withColumns({"turn": F.col("turn").cast("long"), "kind": classify_turn(F.col("text"))})


def replay(turns: DataFrame) -> DataFrame:
    """turns(episode_id, turn, text) to (episode_id, turn, action, fact_turn, status): what each turn did, to which earlier fact, and how its own fact ended."""
    none = {"project_id": F.lit(None).cast("string"), "principals": F.array().cast("array<string>"), "gone": F.array().cast("array<struct<project_id:string,principal_id:string>>")}
    rows = _rows(turns).select("episode_id", "turn", "text", "kind", *[c.alias(k) for k, c in none.items()])
    return rows.groupBy("episode_id").applyInPandas(_play, FACTS).drop("access")


def replay_with_access(turns: DataFrame, principals: DataFrame, acl: DataFrame) -> DataFrame:
    """The replay of turns(episode_id, turn, text, speaker_id, project_id) with access, who may see each fact at the end (null where a turn made none).

    acl(project_id, principal_id) is the policy at the start of every episode. A turn that revokes takes access from the named principal, else the
    speaker, to the projects it names, else to all of theirs; this holds for the facts that are there and for those to come.
    """
    # turns are told apart by episode and place; equal ones count once
    rows = _rows(turns).withColumn("id", F.to_json(F.array(F.col("episode_id"), F.col("turn").cast("string")))).dropDuplicates(["id"])
    gone = revoked_turns(rows.select("id", "speaker_id", "text"), principals, acl).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("project_id", "principal_id"))).alias("gone"))
    listed = acl.groupBy("project_id").agg(F.sort_array(F.collect_set("principal_id")).alias("principals"))
    rows = rows.join(gone, "id", "left").join(listed, "project_id", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    rows = rows.select("episode_id", "turn", "text", "kind", "project_id", none("principals", "array<string>"), none("gone", "array<struct<project_id:string,principal_id:string>>"))
    return rows.groupBy("episode_id").applyInPandas(_play, FACTS)

"""Queries of detection, access control and output rails, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import detect, episodes, governance, rails, rollups, view
from ledgerloom.operators.confirmation import confirmation_rail
from ledgerloom.operators.ledger import nodes, patches
from ledgerloom.operators.values import value_rail
from ledgerloom.plans import cases
from ledgerloom.plans.retrieval import N, P, V, lexical_sql, quoted, rows_sql, top_sql
from ledgerloom.session import table

TURNS = {
    "t1": "Actually the billing team pins another retention value", "t2": "no longer use the gateway session", "t3": "이제 수업은 6시에 한다", "t4": "if the router fails, do not restart it", "t5": "앞으로 ranking 설정은 다른 값을 쓴다", "t6": "what a nice day",
}
CHECKPOINTS = {
    "c1": ("prin_000", "retention of the gateway session"), "c2": ("prin_001", "what was the former budget of the router"), "c3": ("prin_002", "ranking drift prefer planner"), "c4": ("prin_004", "zzz nothing"),
}


def _turns(s, d) -> DataFrame:
    """Contents and quotes of all nodes, and the made turns, as user turns."""
    both = F.array(F.struct(F.lit("content").alias("field"), F.col("content").alias("text")), F.struct(F.lit("quote").alias("field"), F.col("source.quote").alias("text")))
    made = s.createDataFrame([(i, "made", t) for i, t in cases.MADE_TURNS], "id string, field string, text string")
    return nodes(s, d).select("id", F.inline(both)).where("text is not null and text <> ''").unionByName(made)


def classify_patch(s, d):
    return _turns(s, d).select("id", "field", detect.classify(F.col("text")).alias("operation"))


def classify_turn(s, d):
    return _turns(s, d).select("id", "field", detect.classify_turn(F.col("text")).alias("kind"))


def correction_triggers(s, d):
    return _turns(s, d).select("id", "field", detect.correction_trigger(F.col("text")).alias("trigger")).where("trigger is not null")


def weak_signal(s, d):
    return _turns(s, d).where(detect.weak_only(F.col("text"))).select("id", "field")


def question(s, d):
    return _turns(s, d).where(detect.is_question(F.col("text"))).select("id", "field")


def conditional(s, d):
    return _turns(s, d).where(detect.is_conditional(F.col("text"))).select("id", "field")


def reported_speech(s, d):
    return _turns(s, d).where(detect.is_reported(F.col("text"))).select("id", "field")


def date_keys(s, d):
    return _turns(s, d).select("id", "field", F.array_join(detect.date_keys(F.col("text")), ",").alias("dates")).where("dates <> ''")


def value_entries(s, d):
    return _turns(s, d).select("id", "field", F.explode(detect.value_entries(F.col("text"))).alias("e")).select("id", "field", "e.category", "e.value")


def value_contradiction(s, d):
    """Nodes against the nodes they supersede."""
    n = nodes(s, d)
    over = n.select("id", "content", F.explode(F.col("relations")["supersedes"]).alias("old"))
    pairs = over.join(n.select(F.col("id").alias("old"), F.col("content").alias("old_content")), "old")
    return pairs.where(detect.contradicts(F.col("content"), F.col("old_content"))).select("id", "old").distinct()


def patch_candidates(s, d):
    return detect.candidates(view.effective_view(nodes(s, d)), TURNS)


def _projects(s, d) -> DataFrame:
    return nodes(s, d).select(F.col("scope.project").alias("project_id")).where("coalesce(project_id, '') <> ''").distinct()


def _acl(s, d) -> DataFrame:
    """Principals by number and projects by length of name, met by their remainder of three."""
    who = table(s, d, "principals").select("principal_id", (F.substring_index("principal_id", "_", -1).cast("int") % 3).alias("k"))
    return _projects(s, d).withColumn("k", F.length("project_id") % 3).join(who, "k").select("project_id", "principal_id")


def project_detect(s, d):
    return governance.detect_projects(nodes(s, d).select("id", F.col("content").alias("text")), _projects(s, d))


def revocations(s, d):
    turns = patches(s, d).select("id", F.lit(None).cast("string").alias("speaker_id"), F.concat_ws(" ", "reason", "new_content").alias("text"))
    return governance.revocations(turns.unionByName(_turns(s, d).where("field <> 'content'").select("id", F.lit("prin_000").alias("speaker_id"), "text")), table(s, d, "principals"))


def acl_authorized(s, d):
    """All principals; nodes that are open to all come once."""
    return governance.authorized(view.effective_view(nodes(s, d)).select("id", F.col("scope.project").alias("project_id")), _acl(s, d), table(s, d, "principals"))


def revoked_access(s, d):
    turns = s.createDataFrame([("r1", "prin_000", "please revoke my access"), ("r2", "prin_001", "Access to all of it was revoked"), ("r3", "prin_002", "all is well"), ("r4", None, "revoke it")], "id string, speaker_id string, text string")
    return governance.revoked_access(turns, table(s, d, "principals").where("false"), _acl(s, d))


def _checkpoints(s, d) -> dict[str, tuple[str, str]]:
    """The fixed ones, and each principal of them asking in the words of the first active node."""
    first = view.effective_view(nodes(s, d)).where("content <> ''").agg(F.min(F.struct("id", "content")).alias("m")).first()
    words = first["m"]["content"] if first["m"] else ""
    return CHECKPOINTS | {f"{c}w": (p, words) for c, (p, _) in CHECKPOINTS.items()}


def policy_pack(s, d):
    return governance.policy_packs(nodes(s, d), _acl(s, d), _checkpoints(s, d))


def leak_check(s, d):
    """Packs that show every hit without a check: what the check must find."""
    from ledgerloom.operators import retrieval

    bad = retrieval.lexical_search(nodes(s, d), {c: q for c, (_, q) in CHECKPOINTS.items()}, 5).select(F.col("query_id").alias("checkpoint_id"), F.col("id").alias("node_id"))
    askers = s.createDataFrame([(c, p) for c, (p, _) in CHECKPOINTS.items()], "checkpoint_id string, principal_id string")
    return governance.leaks(bad, nodes(s, d), _acl(s, d), askers)


def prediction_rows(s, d):
    """A row of each checkpoint with what its pack shows."""
    shown = policy_pack(s, d).groupBy("checkpoint_id", "action").agg(F.array_sort(F.collect_list("node_id")).alias("used"), F.array_sort(F.collect_list(F.concat(F.lit("["), "node_id", F.lit("] "), "text"))).alias("lines"))
    context = F.array_join("lines", "\n")
    return shown.select("checkpoint_id", F.to_json(F.struct("action", F.col("used").alias("used_record_ids"), F.struct(context.alias("text"), F.length(context).alias("n_chars"), F.size("lines").alias("n_items")).alias("prompt_context"))).alias("output"))


def axis_summary(s, d):
    """Rates of the made scores."""
    return rollups.axis_rates(s.createDataFrame(cases.SCORED, "query_type string, protected boolean, leaked boolean, useful boolean, answered boolean"))


def coded_share(s, d):
    """Share of nodes by status and type that hold a value with a digit-bearing code."""
    coded = F.size(text.code_spans(F.col("content"))) > 0
    return nodes(s, d).groupBy("status", "type").agg(F.count("*").alias("n"), F.round(F.avg(coded.cast("int")), 6).alias("rate"))


def suite_rollup(s, d):
    return rollups.suite_rollup(s.createDataFrame(cases.SUITES, "name string, ok boolean, score double"))


def manifest_counts(s, d):
    return rollups.manifest_counts(s.createDataFrame(cases.MANIFEST, "query_type string, expected_action string, fields array<string>"), ("expected_action", "gold"))


def action_counts(s, d):
    """Operations of all patches by their first word of reason, with the targets as hits."""
    p = patches(s, d).select(F.col("operation").alias("action"), F.lower(F.substring_index(F.trim("reason"), " ", 1)).alias("query_type"), F.size(F.coalesce("target_ids", F.array().cast("array<string>"))).alias("hits"))
    return rollups.action_counts(p)


def _triples(s, d) -> DataFrame:
    """Each superseding node as an answer, every node it replaces as context and its quote as query."""
    n = nodes(s, d)
    own = n.select("id", F.col("content").alias("answer"), F.coalesce("source.quote", F.lit("")).alias("query"), F.explode_outer(F.array_distinct(F.col("relations")["supersedes"])).alias("old"))
    return own.join(n.select(F.col("id").alias("old"), F.col("content").alias("context")), "old", "left").select("id", "old", "answer", F.coalesce("context", F.lit("")).alias("context"), "query")


def pii_spans(s, d):
    return _turns(s, d).select("id", "field", F.explode(rails.pii_candidates(F.col("text"), F.lit(""))["digit"]).alias("span")).distinct()


def email_spans(s, d):
    return _turns(s, d).select("id", "field", F.explode(F.regexp_extract_all("text", F.lit(rails.EMAIL), 1)).alias("email")).distinct()


def rail_pii(s, d):
    return rails.pii_rail(_triples(s, d)).select("id", "old", F.array_join("candidates", "|").alias("candidates"), F.array_join("ungrounded", "|").alias("ungrounded"), "refuse")


def rail_values(s, d):
    return _triples(s, d).select("id", "old", value_rail(F.col("answer"), F.col("context"), F.col("query")).alias("v")).select("id", "old", F.array_join("v.candidates", "|").alias("candidates"), F.array_join("v.ungrounded", "|").alias("ungrounded"))


def rail_confirmation(s, d):
    """Nodes that replace another, as answers to the question in their quote."""
    return _triples(s, d).select("id", "old", confirmation_rail(F.col("answer"), F.col("context"), F.col("query")).alias("c")).where("c.span is not null").select("id", "old", "c.span", "c.reason")


def rail_confirmation_cases(s, d):
    rows = s.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases.CONFIRMATIONS)], "n long, answer string, context string, query string")
    return rows.select("n", confirmation_rail(F.col("answer"), F.col("context"), F.col("query")).alias("c")).select("n", "c.reason")


def rail_value_cases(s, d):
    rows = s.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases.VALUES)], "n long, answer string, context string, query string")
    found = rows.select("n", value_rail(F.col("answer"), F.col("context"), F.col("query")).alias("v"))
    return found.select("n", F.array_join("v.candidates", "|").alias("candidates"), F.array_join("v.ungrounded", "|").alias("ungrounded"))


def episode_replay(s, d):
    """Documents of a session as its turns, in order of creation."""
    docs = table(s, d, "documents").where("session_id is not null").select(F.col("session_id").alias("episode_id"), F.col("doc_id").alias("turn"), "text")
    return episodes.replay(docs)


def episode_access(s, d):
    """The same turns under the access list of their session's project."""
    of = table(s, d, "agent_sessions").select(F.col("id").alias("episode_id"), F.col("project").alias("project_id")).dropDuplicates(["episode_id"])
    docs = table(s, d, "documents").where("session_id is not null").select(F.col("session_id").alias("episode_id"), F.col("doc_id").alias("turn"), "text", F.lit("prin_000").alias("speaker_id"))
    done = episodes.replay_with_access(docs.join(of, "episode_id", "left"), table(s, d, "principals"), _acl(s, d))
    return done.withColumn("access", F.array_join("access", ","))


def rail_facade(s, d):
    return rails.apply_rails(_triples(s, d)).select("id", "old", "refused", "flagged", "text")


def rail_postprocess_counts(s, d):
    """Every node's content as the answer of its own checkpoint, held against the nodes it replaces as predictions."""
    answers = nodes(s, d).select(F.col("id").alias("checkpoint_id"), F.col("content").alias("answer"))
    said = _triples(s, d).where("old is not null").select(F.col("id").alias("checkpoint_id"), "context", "query")
    return rails.postprocess_counts(rails.postprocess(answers, said))


def leak_targets(s, d):
    """Nodes that show the key of the node they replace."""
    n = nodes(s, d)
    pairs = n.select("id", F.col("content").alias("text"), F.array(F.col("type"), F.coalesce("scope.project", F.lit(""))).alias("leak_targets"))
    return rails.leak_hits(pairs).select("id")


QUERIES = {f.__name__: f for f in (
    classify_patch, classify_turn, correction_triggers, weak_signal, question, conditional, reported_speech, date_keys, value_entries, value_contradiction, patch_candidates, project_detect, revocations, revoked_access, acl_authorized, policy_pack, leak_check, prediction_rows, axis_summary, coded_share, suite_rollup, manifest_counts, action_counts,
    pii_spans, email_spans, rail_pii, rail_values, rail_confirmation, rail_confirmation_cases, rail_value_cases, rail_facade, episode_replay, episode_access, rail_postprocess_counts, leak_targets,
)}

TU = "tu AS (SELECT id, 'content' AS field, content AS text FROM n WHERE content <> '' UNION ALL SELECT id, 'quote', source.quote FROM n WHERE source.quote <> '' UNION ALL SELECT id, 'made', text FROM (VALUES " + ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in cases.MADE_TURNS) + ") m(id, text))"


def _hit(t: str, triggers: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(lower({t}), {quoted(x.lower())}) THEN {quoted(x)} END" for x in triggers) + ", NULL)"


_PLAIN = [t for t in detect.CORRECTION if "아니라" not in t]
_CORR = f"coalesce({_hit('text', _PLAIN)}, {_hit(f'regexp_replace(text, {quoted(detect.FUSED_IDIOM)}, {quoted(str())}, {quoted(chr(103))})', ['그게 아니라', '아니라'])})"
_CLASS = "CASE " + " ".join(f"WHEN {_hit('text', t)} IS NOT NULL THEN '{op}'" for t, op in ((detect.RETIRE, "deprecate"), (detect.EXPANSION, "expand"), (detect.NEGATION, "narrow"), (detect.SCOPE, "narrow"))) + f" WHEN {_CORR} IS NOT NULL THEN 'supersede' WHEN {_hit('text', detect.WEAK_NEGATION)} IS NOT NULL THEN 'supersede' WHEN {_hit('text', detect.TEMPORAL)} IS NOT NULL THEN 'update' END"


def _words(w: list[str]) -> str:
    return "regexp_matches(text, " + quoted("(?i)" + detect.EDGE_L + "(?:" + "|".join(w) + ")" + detect.EDGE_R) + ")"


_WEAK = " AND ".join(f"{_hit('text', t)} IS NULL" for t in (detect.RETIRE, detect.EXPANSION, detect.NEGATION, detect.SCOPE, detect.STRONG_TEMPORAL)) + f" AND {_CORR} IS NULL AND ({_hit('text', detect.WEAK_TEMPORAL)} IS NOT NULL OR {_hit('text', detect.WEAK_NEGATION)} IS NOT NULL)"
_REST = "replace(replace(text, '다시 말하면', ''), '정확히 말하면', '')"
PROJECTS = "pj AS (SELECT DISTINCT scope.project AS project_id FROM n WHERE coalesce(scope.project, '') <> '')"
ACL = f"{PROJECTS}, acl AS (SELECT project_id, principal_id FROM pj JOIN principals ON split_part(principal_id, '_', -1)::INT % 3 = length(project_id) % 3)"

SQL = {
    "classify_patch": f"WITH {N}, {TU} SELECT id, field, {_CLASS} AS operation FROM tu",
    "classify_turn": f"WITH {N}, {TU}, c AS (SELECT *, {_CLASS} AS op FROM tu) SELECT id, field, CASE WHEN {_words(detect.DELETE_WORDS)} THEN 'forget' WHEN {_words(detect.SUPERSEDE_WORDS)} THEN 'supersede' WHEN op IS NULL THEN 'create' WHEN op = 'deprecate' THEN 'forget' ELSE 'supersede' END AS kind FROM c",
    "correction_triggers": f"WITH {N}, {TU} SELECT id, field, {_CORR} AS trigger FROM tu WHERE {_CORR} IS NOT NULL",
    "weak_signal": f"WITH {N}, {TU} SELECT id, field FROM tu WHERE {_WEAK}",
    "question": f"WITH {N}, {TU} SELECT id, field FROM tu WHERE contains(text, '?') OR regexp_matches(text, '(습니까|ㅂ니까|나요|ㄹ까요|을까요)\\s*$')",
    "conditional": f"WITH {N}, {TU} SELECT id, field FROM tu WHERE contains({_REST}, '만약') OR contains({_REST}, '혹시') OR regexp_matches(lower({_REST}), {quoted(detect.EDGE_L + '(if|in case|unless)' + detect.EDGE_R)}) OR regexp_matches({_REST}, '[가-힣]면([\\s,.]|$)')",
    "reported_speech": f"WITH {N}, {TU} SELECT id, field FROM tu WHERE {_CORR} IS NULL AND regexp_matches(text, '(이)?라고\\s*(했|그러던데|하더라|전했)')",
    "project_detect": f"WITH {N}, {PROJECTS}, a AS (SELECT DISTINCT project_id, lower(CASE WHEN contains(project_id, '_') THEN substr(project_id, strpos(project_id, '_') + 1) ELSE project_id END) AS alias FROM pj), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM n) SELECT DISTINCT id, project_id FROM w JOIN a ON alias = word WHERE alias <> ''",
    "revocations": f"""WITH {N}, {P}, {TU}, t AS (SELECT id, NULL AS sp, concat_ws(' ', reason, new_content) AS text FROM p UNION ALL SELECT id, 'prin_000', text FROM tu WHERE field <> 'content'), r AS (SELECT * FROM t WHERE {_words(detect.REVOKE_WORDS)}),
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM r), m AS (SELECT id, min(principal_id) AS who FROM w JOIN principals ON lower(split_part(trim(display_name), ' ', 1)) = word GROUP BY id) SELECT r.id, coalesce(m.who, r.sp) AS principal_id FROM r LEFT JOIN m ON m.id = r.id""",
    "acl_authorized": f"WITH {N}, {V}, {ACL} SELECT DISTINCT acl.principal_id, v.id FROM v JOIN acl ON acl.project_id = v.scope.project JOIN principals USING (principal_id) WHERE v.scope.project <> '' UNION ALL SELECT '*', id FROM v WHERE coalesce(v.scope.project, '') = ''",
    "revoked_access": f"WITH {N}, {ACL} SELECT DISTINCT project_id, principal_id FROM acl WHERE principal_id IN ('prin_000', 'prin_001')",
    "axis_summary": f"SELECT * FROM (VALUES {rows_sql(cases.RATES)}) t(query_type, n, n_protected, leak_rate, n_useful, utility_rate)",
    "suite_rollup": f"SELECT * FROM (VALUES {rows_sql(cases.SUITE_TOTAL)}) t(ok, n, score, percent)",
    "manifest_counts": f"SELECT * FROM (VALUES {rows_sql(cases.MANIFEST_COUNTS)}) t(axis, value, n)",
    "action_counts": f"""WITH {P}, r AS (SELECT operation AS action, lower(split_part(trim(reason), ' ', 1)) AS query_type, coalesce(len(target_ids), 0) AS hits FROM p)
SELECT 'action' AS axis, coalesce(action, '') AS value, count(*) AS n, sum(hits)::BIGINT AS n_hits FROM r GROUP BY ALL UNION ALL SELECT 'query_type', coalesce(query_type, ''), count(*), sum(hits)::BIGINT FROM r GROUP BY ALL""",
    "rail_confirmation_cases": f"SELECT * FROM (VALUES {rows_sql([(k, c[3]) for k, c in enumerate(cases.CONFIRMATIONS)])}) t(n, reason)",
    "rail_value_cases": f"SELECT * FROM (VALUES {rows_sql([(k, '|'.join(c[3]), '|'.join(c[4])) for k, c in enumerate(cases.VALUES)])}) t(n, candidates, ungrounded)",
    "coded_share": f"WITH {N} SELECT status, type, count(*) AS n, round(avg((len(list_filter(regexp_extract_all(content, '\\b[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+\\b'), lambda x: regexp_matches(x, '[0-9]'))) > 0)::INT), 6) AS rate FROM n GROUP BY ALL",
    "email_spans": f"WITH {N}, {TU} SELECT DISTINCT id, field, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email FROM tu",
    "leak_targets": f"WITH {N} SELECT id FROM n WHERE contains(lower(content), lower(type)) OR (coalesce(scope.project, '') <> '' AND contains(lower(content), lower(scope.project)))",
    "date_keys": f"""WITH {N}, {TU}, x AS (SELECT id, field, regexp_extract_all(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS iso, list_transform(regexp_extract_all(text, '\\d{{1,2}}월\\s*\\d{{1,2}}일'), lambda m: lpad(regexp_extract(m, '(\\d+)월', 1), 2, '0') || '-' || lpad(regexp_extract(m, '(\\d+)일', 1), 2, '0')) AS md FROM tu)
SELECT id, field, array_to_string(list_sort(list_distinct(list_concat(md, iso, list_transform(iso, lambda i: substr(i, 6, 5))))), ',') AS dates FROM x WHERE len(iso) + len(md) > 0""",
    "leak_check": f"""WITH {N}, {ACL}, {lexical_sql("n", {c: q for c, (_, q) in CHECKPOINTS.items()})}, s AS (SELECT query_id AS checkpoint_id, n.* FROM {top_sql("l", 5)} t JOIN n ON n.id = t.id), a(checkpoint_id, principal_id) AS (VALUES {", ".join(f"({quoted(c)}, {quoted(p)})" for c, (p, _) in CHECKPOINTS.items())})
SELECT checkpoint_id, id AS node_id, 'not active' AS problem FROM s WHERE coalesce(status, '') <> 'active' UNION ALL SELECT checkpoint_id, id, 'not allowed' FROM s JOIN a USING (checkpoint_id) WHERE coalesce(scope.project, '') <> '' AND NOT EXISTS (FROM acl WHERE acl.project_id = s.scope.project AND acl.principal_id = a.principal_id)""",
}

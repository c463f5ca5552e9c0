"""Made turns, answers and records that the tables have no like of: queries read them beside the tables, and the SQL has them as VALUES."""

from __future__ import annotations

#: Turns of users, by id.
MADE_TURNS = [
    ("made_01", "이제 점심은 다른 곳에서"), ("made_02", "그건 아니야"), ("made_03", "앞으로 이제 그만"), ("made_04", "when does it start?"), ("made_05", "언제 시작하나요"), ("made_06", "만약 그렇다면 멈춘다"),
    ("made_07", "only if it rains"), ("made_08", "다시 말하면 그래"), ("made_09", "그가 7억이라고 했다"), ("made_10", "내일 쉰다고 하더라 말이라고 전했다"), ("made_11", "due 7월 3일 or 2031-07-04"), ("made_12", "12월 25일"),
    ("made_13", "please revoke my access"), ("made_14", "access was revoked for the other desk"), ("made_15", "unless it fails, go on"), ("made_16", "물이 끓으면 넣는다"), ("made_17", "Actually, it is five"), ("made_18", "nothing to see"),
]
#: Records with what the validators look for: edges (id, schema_version, type), sessions (id, schema_version, status, started_at), JSON texts (id, text), files (path, text).
BAD_EDGES = [("edge_made1", "x.memory_edge.v0.1", "likes"), ("made2", "x.memory_edge.v0.1", "refines"), ("edge_made3", "x.memory_edge.v9", "refines"), ("edge_made4", None, None), ("edge_made5", "x.memory_edge.v0.1", "refines")]
BAD_SESSIONS = [("sess_made1", "x.session.v0.1", "asleep", "2031-01-01T00:00:00Z"), ("sess_made2", "x.session.v0.1", "active", None), ("sess_made3", "v2", None, "2031-01-01T00:00:00Z"), ("sess_made4", "x.session.v0.1", "ended", "2031-01-01T00:00:00Z")]
BAD_JSON = [("made_1", '{"a": [{"Token": 1}]}'), ("made_2", '{"a": "token: x"}'), ("made_3", '{"b": {"api_key": null}}'), ("made_4", "{}"), ("made_5", '{"user_id": "u"}')]
FORBIDDEN = ["made_1", "made_3", "made_5"]
FILES = [
    ("nodes/a.json", '{"schema_version": "x.memory_node.v0.1", "id": "mem_1", "type": "task", "scope": {}, "content": "c", "status": "active", "source": {}, "relations": {}}'), ("nodes/b.json", '{"schema_version": "x.memory_node.v0.1", "id": "b", "content": null}'),
    ("edges/c.json", '{"schema_version": "x.memory_edge.v0.1", "id": "edge_1", "from_id": "a", "to_id": "b", "type": "refines"}'), ("edges/d.json", "[1]"), ("edges/e.json", '{"id": "edge_2"}'), ("raw/f.json", "no json"), ("x/audit/g.json", "{}"),
]
FILE_PROBLEMS = [
    *(("nodes/b.json", f"missing {f}") for f in ("type", "scope", "status", "source", "relations")), ("nodes/b.json", "id prefix"), ("edges/d.json", "no object"), ("edges/e.json", "unknown schema_version"),
]
#: Sessions that are to be started, some of them twice.
WANTED_SESSIONS = ["sess_made1", "sess_made1", "sess_made2"]
#: A log of changes as git writes it, newest first, and what it holds.
LOG = "commit\tc3\tAda\t2031-02-03\n\na.py\nb.js\n\ncommit\tc2\tBo\t2031-02-02\n\na.py\nb.js\nc.md\n\ncommit\tc1\tAda\t2031-02-01\n\na.py\n"
LOG_CHURN = [("a.py", 3, "2031-02-03", 2), ("b.js", 2, "2031-02-03", 2), ("c.md", 1, "2031-02-02", 1)]
LOG_PAIRS = [("a.py", "b.js", 2)]
CODE_FILES = [("a.py", "import os\nfrom b import y\n\nclass K(B):\n    def f(self, q):\n        pass\n"), ("b.js", "import z from './c'\nexport const go = (a) => a\nfunction run() {}\n"), ("c.md", "# notes\n")]
CODE_SYMBOLS = [("a.py", "K", "class", 4), ("a.py", "f", "function", 5), ("b.js", "go", "function", 2), ("b.js", "run", "function", 3)]
CODE_EDGES = [
    *(("defines", p, f"{p}::{n}", 1) for p, n, _, _ in CODE_SYMBOLS), ("imports", "a.py", "os", 1), ("imports", "a.py", "b.js", 1), ("imports", "b.js", "./c", 1), ("co_change", "a.py", "b.js", 2),
]
#: Scored checkpoints (query_type, protected, leaked, useful, answered) and suites (name, ok, score).
SCORED = [("fact", True, False, True, True), ("fact", True, True, True, False), ("fact", False, True, True, True), ("veto", True, False, False, False), (None, None, None, True, True)]
RATES = [("fact", 3, 2, 0.5, 3, 0.666667), ("veto", 1, 1, 0.0, 0, None), ("", 1, 0, None, 1, 1.0)]
SUITES = [("a", True, 0.9), ("b", False, 0.8), ("c", True, None)]
SUITE_TOTAL = [(False, 3, 0.3, 66.67)]
MANIFEST = [("fact", "answer", ["asker", "expected_action"]), ("fact", "refuse", None), (None, "answer", ["gold", "expected_action"])]
MANIFEST_COUNTS = [("query_type", "fact", 2), ("query_type", "", 1), ("expected_action", "answer", 2), ("expected_action", "refuse", 1), ("hidden_field", "expected_action", 2), ("hidden_field", "gold", 1)]

#: Answers, contexts and queries with the reason that the confirmation rail gives.
CONFIRMATIONS = [
    ("Yes, the retired token began with qz", "", "Did the deleted token begin with qz?", "deleted_referent"),
    ("Yes, Kestrel is the Nordwind account", "", "Is Kestrel the Nordwind account?", "identity_mapping"),
    ("Yes, Kestrel is the same account as Nordwind", "In the plan Kestrel is the same account as Nordwind.", "Is Kestrel the same account as Nordwind?", None),
    ("Yes, the retired token expired in May", "The retired token expired in May", "Is the retired token expired?", None),
    ("Yes, the retired token expired in May", "The retired token never expired in May", "Is the retired token expired?", "deleted_referent"),
    ("Yes, rotation of the old key is complete", "The old key was rotated; the rotation completed", "Was the removed key rotated?", None),
    ("I don't know", "", "What was the deleted token?", None),
    ("Yes, sure", "", "Is it sunny?", None),
    ("Yes, it is", "", "Was the deleted invite for Monday?", None),  # no protected noun
    (None, None, None, None),
    ("\u200b**Yes**.", "", "was the expired password removed?", "deleted_referent"),
    ("Sure, I can look into that for you.", "", "Was the deleted token rb_stg?", None),
    ("Sure, the deleted token was rb_stg", "", "Was the deleted token rb_stg?", "deleted_referent"),
    ("I cannot deny that Kestrel is the same customer as Nordwind", "", "Is Kestrel the same customer as Nordwind?", "identity_mapping"),
    ("I cannot confirm the name. However, I can confirm Nordwind is active", "", "Is Kestrel identical? Kestrel under a different name?", "identity_mapping"),
    ("확인도 부인도 못 하지만 네, 맞아요", "", "삭제된 토큰이 rb_stg 인가요", "deleted_referent"),
    ("It did, and it started with rb_stg", "", "the one that began with rb_stg?", "deleted_referent"),
    ("Yes, a fine walk", "", "the meeting started with a walk-through of the plan?", None),
    ("Yes indeed", "", "does that imply Kestrel is Nordwind?", "identity_mapping"),
    ("Yes indeed", "", "does that imply we will be early?", None),
    ("The exact customer name is Nordwind", "", "What is the exact customer name, to avoid confusion with Kestrel?", "identity_mapping"),
    ("Yes, Kestrel가 Nordwind와 동일한 고객", "Kestrel는 Nordwind와 동일한 고객", "Kestrel와 동일한 고객?", None),
    ("Yes, the retired key ended on 2026-03-04", "the key ended 2026년 3월 4일", "Was the retired key ended?", None),
]

#: Answers, contexts and queries with the values found in the answer, and those without ground.
VALUES = [
    ("due 2026-08-01", "due 2026년 8월 1일", "", ["2026-08-01"], []),
    ("due 8월 2일", "due 2026-08-02", "", ["8월 2일"], ["8월 2일"]),
    ("pay 1,000,000원", "pay 100만원", "", ["1,000,000"], []),
    ("pay 5억 2천만원", "pay 520,000,000", "", ["5억 2천만원"], []),
    ("pay １，０００ now", "pay 1000", "", ["１，０００"], []),
    ("pay 9,999,000", "pay 29,999,000", "", ["9,999,000"], ["9,999,000"]),
    ("code 4711 and 12", "nothing", "", ["4711"], ["4711"]),
    ("code 4711", "nothing", "is it 4711?", ["4711"], []),
    ("rate 12% of it", "rate 12 %", "", ["12%"], []),
    ("rate 12% of it", "", "", [], []),
    ("Project Alder is late", "alder is late", "", ["Project Alder"], []),
    ("Project Alder is late", "Alderman is late", "", ["Project Alder"], ["Project Alder"]),
    ("Project Best is late", "the best one", "", ["Project Best"], ["Project Best"]),
    ("Silver Alder's plan", "silver_alder plan", "", ["Silver Alder"], []),
    ("silver alder는 늦다", "다른 말", "", ["silver alder"], ["silver alder"]),
    ("silver alder는 늦다", "silver-alder는 늦다", "", ["silver alder"], []),
    ("Thank You, Next Steps and Google Drive", "x", "", [], []),
    ("It is done. Best regards, The Support Team.", "x", "", [], []),
    ("The Support Team did it. Thanks", "x", "", ["The Support Team"], ["The Support Team"]),
    ("Silver\u200bAlder", "silver alder", "", ["Silver\u200bAlder"], []),
    (None, "x", None, [], []),
]

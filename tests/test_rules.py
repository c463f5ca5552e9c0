"""Detection, rails and code parsing on single strings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import codegraph, confirmation, detect, episodes, integrity, rails, values
from ledgerloom.plans.cases import CONFIRMATIONS, VALUES


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("turn", "operation"),
    [
        ("please deprecate this", "deprecate"), ("we must include Korean", "expand"), ("do not use tabs", "narrow"), ("only for this repo", "narrow"), ("Actually it is five", "supersede"), ("5시가 아니라 6시", "supersede"),
        ("5시가 아니라면 시작", None), ("그건 아니야", "supersede"), ("from now on use spaces", "update"), ("이제 시작", "update"), ("hello", None),
    ],
)
def test_classify(spark, turn, operation):
    assert one(spark, detect.classify(F.col("t")), turn) == operation


def test_gates(spark):
    c = F.col("t")
    assert one(spark, detect.weak_only(c), "이제 점심은 다른 곳에서") and not one(spark, detect.weak_only(c), "앞으로 이제")
    assert one(spark, detect.is_conditional(c), "만약 그렇다면") and one(spark, detect.is_conditional(c), "only if it rains") and not one(spark, detect.is_conditional(c), "다시 말하면 그래")
    assert one(spark, detect.is_question(c), "언제 하나요") and one(spark, detect.is_reported(c), "그가 7억이라고 했다")
    assert one(spark, detect.date_keys(c), "7월 3일 or 2026-07-04") == ["07-03", "07-04", "2026-07-04"]
    assert one(spark, detect.classify_turn(c), "this was deleted") == "forget" and one(spark, detect.classify_turn(c), "that replaces it") == "supersede" and one(spark, detect.classify_turn(c), "new fact") == "create"


def test_values(spark):
    assert detect.entries_of("5억 and 500,000,000원") == [("money", "500000000"), ("money", "500000000")]
    rows = [("이제 5시 수업을 6시로", "수업은 5시다", True), ("이제 5시 다 됐다", "수업은 5시다", False), ("2200만 2500만 중에", "예산 2000만", False), (None, "3시", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(detect.contradicts(F.col("a"), F.col("b")).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


@pytest.mark.parametrize(
    ("answer", "context", "query", "refused", "flagged"),
    [
        ("write to a@b.org", "mail a@b.org", "", False, False), ("write to a@b.org", "", "", False, True), ("key is kv_prod_7X3M", "", "", True, True), ("key is kv_prod_7X3M", "kv-prod-7X3M", "", False, False),
        ("Yes, it began with qz_pre", "", "did it?", True, True), ("the dry-run began with a test", "", "", False, False), ("budget is 500,000,000원", "budget 5억", "", False, False), ("budget is 900,000,000원", "budget 5억", "", False, True), ("  ", "", "", False, False), (None, None, None, False, False),
    ],
)
def test_rails(spark, answer, context, query, refused, flagged):
    r = rails.apply_rails(spark.createDataFrame([(answer, context, query)], "answer string, context string, query string")).first()
    assert (r["refused"], r["flagged"]) == (refused, flagged)
    assert r["text"] == (rails.REFUSAL if refused else r["text"]) and (not flagged or refused or "[REDACTED]" in r["text"])


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, text.tokenize(c), "Été src/Foo.py 한글, x") == ["t", "src/foo.py", "한글", "x"]
    assert one(spark, text.detach_punctuation(c), "token kv_prod_7X3M. ok; a.") == "token kv_prod_7X3M . ok; a."
    assert one(spark, text.strip_stopwords(c), "The budget, of (it) all") == "budget, all" and text.normalized_query("The budget, of (it) all") == "budget , all"
    assert one(spark, text.safe_session_id(c), "..a/b c") == "a-b-c" and one(spark, text.safe_session_id(c), "") == "session"
    assert one(spark, text.redact(c, F.array(F.lit("ab"), F.lit("a.b+c"))), "AB a.b+c xab") == "[REDACTED] [REDACTED] x[REDACTED]"
    assert one(spark, text.redact(c, F.array(F.lit(r"a\E(b"), F.lit("$1"))), r"x A\E(B $1 y") == "x [REDACTED] [REDACTED] y"
    got = one(spark, text.redact_counted(c, F.array(F.lit("ab"), F.lit("zz"), F.lit(None), F.lit(""))), "AB ab")
    assert (got["text"], got["n"]) == ("[REDACTED] [REDACTED]", 1)
    assert one(spark, text.contains_ci(c, "STRASSE"), "die Straße")
    names = [one(spark, text.raw_safe_name(c, F.lit(x)), n) for n, x in (("a b/c.txt", "1"), ("a b/c.txt", "2"), (None, "1"), (".hidden", "1"), ("x", None))]
    assert len(set(names)) == 5 and names[0].startswith("a-b-c-") and names[0].endswith(".txt") and names[2].startswith("raw-")


def test_modules_and_log(spark):
    js = "import a, { b } from 'x/y'\nimport \"side\"\n  const q = require('fs')\nimport c from c\nlet z = require('no')\nimport d from \"e.js\"; // from 'f'\nimportant 'g'"
    assert codegraph._modules(js) == {"x/y", "side", "fs", "e.js"}
    log = "commit\tc2\tAda\t2026-02-02\n\na.py\nb c.py\n\ncommit\tc1\tBo\t2026-01-01\n\na.py\n"
    got = [tuple(r) for r in codegraph.history(spark.createDataFrame([(log,), ("",), (None,)], "value string")).collect()]
    assert sorted(got) == [("c1", 1, "Bo", "2026-01-01", "a.py"), ("c2", 0, "Ada", "2026-02-02", "a.py"), ("c2", 0, "Ada", "2026-02-02", "b c.py")]


def test_rails_on_predictions(spark):
    answers = spark.createDataFrame([("c1", "pay 900,000원"), ("c2", "key is kv_prod_7X3M"), ("c3", "fine"), (None, "x")], "checkpoint_id string, answer string")
    said = spark.createDataFrame([("c1", "pay 5억", None), ("c1", "pay 5억", None), ("c2", None, None)], "checkpoint_id string, context string, query string")
    done = rails.postprocess(answers, said)
    assert {r["checkpoint_id"]: (r["flagged"], r["refused"], [tuple(x) for x in r["by_rule"]]) for r in done.collect()} == {
        "c1": (True, False, [("900,000", "value")]), "c2": (True, True, [("kv_prod_7X3M", "pii")]), "c3": (False, False, []), None: (False, False, []),
    }
    assert rails.postprocess_counts(done).first().asDict() == {"n": 4, "n_flagged": 2, "n_refused": 1, "n_pii": 1, "n_value": 1, "n_confirmation": 0}


def test_forbidden_keys(spark):
    rows = [("1", '{"a": [{"Token": 1}]}'), ("2", '{"a": "\\"token\\": x"}'), ("3", '{"\\u0074oken": 1}'), ("4", None), ("5", "{broken")]
    assert [r["id"] for r in integrity.forbidden_keys(spark.createDataFrame(rows, "id string, m string"), "m").collect()] == ["1", "3"]


def test_code(spark, tmp_path):
    files = [("a/x.py", "import os\nfrom a import y\n\nclass K(B):\n    async def f(self, q):\n        pass\n"), ("a/y.py", "def broken(:\n"), ("b.js", "import z from './y'\nexport const go = (a) => a\nfunction run() {}\n"), ("e.txt", "")]
    parsed = codegraph.parse(spark.createDataFrame(files, "path string, text string")).cache()
    got = {(r["path"], r["name"], r["kind"], r["line"]) for r in parsed.selectExpr("path", "inline(symbols)").collect()}
    assert got == {("a/x.py", "K", "class", 4), ("a/x.py", "f", "function", 5), ("b.js", "go", "function", 2), ("b.js", "run", "function", 3)}
    assert {r["path"]: (r["language"], r["lines"]) for r in parsed.collect()} == {"a/x.py": ("python", 7), "a/y.py": ("python", 2), "b.js": ("javascript", 4), "e.txt": ("txt", 0)}
    assert ("a/x.py", "a", "a/__init__.py") not in {tuple(r) for r in codegraph.resolve_imports(parsed).collect()}
    pairs = spark.createDataFrame([("a/x.py", "b.js", 3), ("a/x.py", "gone.py", 9)], "a string, b string, n long")
    links = {(r["kind"], r["source"], r["target"], r["weight"]) for r in codegraph.edges(parsed, pairs).collect()}
    assert ("co_change", "a/x.py", "b.js", 3) in links and ("defines", "b.js", "b.js::go", 1) in links and ("imports", "a/x.py", "os", 1) in links and not any("gone.py" in x for x in links)
    codegraph.save(parsed, codegraph.edges(parsed, pairs), str(tmp_path / "graph"))
    files_, links_ = codegraph.load(spark, str(tmp_path / "graph"))
    assert files_.count() == 4 and {tuple(r) for r in links_.select("kind", "source", "target", "weight").collect()} == links
    hits = codegraph.search(parsed, spark.createDataFrame([("b.js", 9)], "path string, churn long"), "run").collect()
    assert hits[0]["path"] == "b.js" and hits[0]["score"] == 5


@pytest.mark.parametrize(("answer", "context", "query", "reason"), CONFIRMATIONS)
def test_confirmations(answer, context, query, reason):
    span, got = confirmation.check(answer, context, query)
    assert got == reason and (span is None) == (reason is None)


def test_long_claims_are_cut():
    span, _ = confirmation.check("Yes, " + "the deleted token was long " * 9, "", "Was the deleted token long?")
    assert len(span) == 120 and span.endswith("...")


@pytest.mark.parametrize(("answer", "context", "query", "found", "loose"), VALUES)
def test_value_rail(answer, context, query, found, loose):
    assert values.check(answer, context, query) == (found, loose)


def test_bounded_needles():
    assert not values.contains_bounded("project alders", "project alder") and values.contains_bounded("project_alder은", "project_alder")
    assert not values.contains_bounded("가나다", "나다") and values.contains_bounded("x나다 y", "나다") and values.contains_bounded("a 12가", "12") and not values.contains_bounded("", "")
    assert values.contains_bounded("120 12", "12") and not values.contains_bounded("120", "12")


def test_replay(spark):
    turns = [
        ("e", 1, "The staging token is kv_prod_42 for Harbor"), ("e", 2, "Lunch is at noon"), ("e", 3, "lunch  IS at noon"), ("e", 4, "Delete kv_prod_42 now, it is retired"), ("e", 5, "Delete the unknown thing"), ("f", 1, None), ("f", 2, "Budget code bx_7 is ten"), ("f", 3, "Actually budget code bx_7 is twelve"), (None, 1, "x"),
    ]
    rows = {(r["episode_id"], r["turn"]): (r["action"], r["fact_turn"], r["status"]) for r in episodes.replay(spark.createDataFrame(turns, "episode_id string, turn long, text string")).collect()}
    assert rows == {
        ("e", 1): ("create", None, "forgotten"), ("e", 2): ("create", None, "active"), ("e", 3): ("duplicate", None, None), ("e", 4): ("forget", 1, None), ("e", 5): ("forget", None, None), ("f", 2): ("create", None, "superseded"), ("f", 3): ("supersede", 2, "active"),
    }


def test_replay_under_a_policy(spark):
    turns = [
        ("e", 1, "The staging token is kv_prod_42 for Harbor", "u1", "proj_alder"), ("e", 2, "Budget of birch is ten", "u2", "proj_birch"), ("e", 3, "please revoke my access to alder", "u2", "proj_alder"),
        ("e", 4, "Actually kv_prod_42 is the live token", "u1", "proj_birch"), ("e", 5, "a new alder fact entirely", "u1", "proj_alder"), ("e", 6, "revoke all of it for bo", "u1", None), ("e", 7, "no project here", "u1", None), ("f", 1, "alder again", "u2", "proj_alder"),
    ]
    principals = spark.createDataFrame([("u1", "Ada Lind"), ("u2", "Cy Berg"), ("u3", "Bo Voss")], "principal_id string, display_name string")
    acl = spark.createDataFrame([("proj_alder", "u1"), ("proj_alder", "u2"), ("proj_birch", "u2"), ("proj_birch", "u3"), ("proj_alder", "u3")], "project_id string, principal_id string")
    df = spark.createDataFrame(turns, "episode_id string, turn long, text string, speaker_id string, project_id string")
    got = {(r["episode_id"], r["turn"]): (r["action"], r["access"]) for r in episodes.replay_with_access(df, principals, acl).collect()}
    assert got["e", 1] == ("create", ["u1"]) and got["e", 2] == ("create", ["u2"])  # u2 out of alder, u3 out of all
    assert got["e", 4] == ("supersede", ["u1"])  # takes over who may see what it replaces
    assert got["e", 5] == ("create", ["u1"]) and got["e", 7] == ("create", []) and got["f", 1] == ("create", ["u1", "u2", "u3"])
    assert {(r["episode_id"], r["turn"], r["action"]) for r in episodes.replay(df).collect()} == {(*k, v[0]) for k, v in got.items()}


def test_small_functions(spark):
    from ledgerloom.functions import scalars
    from ledgerloom.operators import governance

    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}, ["x"], ["y", "x"], "The  room-402's\u200bkey"), (None, {"b": "3"}, [], ["y"], ""), ({"a": "1"}, None, ["x"], ["y"], None)], "l map<string,string>, r map<string,string>, p array<string>, q array<string>, t string")
    got = df.select(scalars.merge_maps(F.col("l"), F.col("r")).alias("m"), scalars.scope_matches(F.col("p"), F.col("q")).alias("s"), scalars.fold_separators(F.col("t")).alias("f")).collect()
    assert [r["m"] for r in got] == [{"a": "1", "b": "3"}, {"b": "3"}, {"a": "1"}] and [r["s"] for r in got] == [True, True, False] and got[0]["f"] == "the room 402 key"
    cp = spark.createDataFrame([("c", "e", "t", "p", "q", "hidden")], "checkpoint_id string, episode_id string, as_of_turn_id string, asker string, query_text string, expected_action string")
    assert governance.visible(cp).columns == list(governance.VISIBLE)

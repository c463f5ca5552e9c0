import os
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import crf, pii
from ledgerloom.llm.pii_sentences import Maker, stock

T = "id string, field string, text string"


@pytest.fixture(scope="module")
def field():
    return pii.model()


def tagged(field, maker, texts, gate=True):
    known = pii.Directory(maker.known_given, maker.known_family, maker.known_korean)
    return pii.Tagger(field, known, gate).batch(texts)


def quality(field, made, gate=True):
    found, right, there = Counter(), Counter(), Counter()
    for (text, spans), got in zip(made, tagged(field, Maker(4242), [t for t, _ in made], gate), strict=True):
        want = {(k, text[a:b].rstrip(".")) for a, b, k in spans}
        have = {(k, text[a:b].rstrip(".")) for a, b, k in got}
        for k in pii.KINDS:
            found[k] += sum(x[0] == k for x in have)
            there[k] += sum(x[0] == k for x in want)
            right[k] += sum(x[0] == k for x in want & have)
    return {k: (right[k] / there[k], right[k] / found[k]) for k in pii.KINDS}


def test_held_out_accuracy_and_what_the_gate_costs(field):
    maker = Maker(4242)
    made = [maker.sentence() for _ in range(1500)]
    with_gate, without = quality(field, made), quality(field, made, gate=False)
    for k in pii.KINDS:
        assert min(with_gate[k]) >= 0.95, (k, with_gate)
        assert with_gate[k][0] >= without[k][0] - 0.02, (k, with_gate, without)


def test_sentences_by_another_hand(field):
    """Forms and wording that the training texts don't have."""
    known = pii.Directory({"Ingrid"}, {"Sandvik"}, set())
    cases = {
        "Our plumber Ingrid Sandvik left her card on the fridge.": [("name", "Ingrid Sandvik")],
        "Whoever finds this notebook: owl.nest+books@lighthouse.example.net": [("email", "owl.nest+books@lighthouse.example.net")],
        "Leave a note on the pager, +44 1632 960961, or knock.": [("phone", "+44 1632 960961")],
        "Two parcels for 14 Juniper Street, Coldwater went missing.": [("address", "14 Juniper Street, Coldwater")],
        "The clerk copied passport RX4482913 onto the sheet.": [("idnum", "RX4482913")],
        "Version 3.11.2 of the parser fixed issue 4471 in 12 ms.": [],
        "The Green Table meets on Friday in the Old Library.": [],
    }
    got = pii.Tagger(field, known).batch(list(cases))
    wrong = [(t, spans) for (t, want), spans in zip(cases.items(), got, strict=True) if [(k, t[a:b]) for a, b, k in spans] != want]
    assert len(wrong) <= 1, wrong


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_training_sentence_stands_in_the_tables(sf):
    path = f"/root/testdata/{sf}/memory_nodes.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    t = pq.read_table(path, columns=["content", "source"])
    texts = set(t.column("content").to_pylist()) | {s["quote"] for s in t.column("source").to_pylist() if s}
    blob = "\n".join(x for x in texts if x).casefold()
    assert [p[i : i + 12] for p in map(str.casefold, stock()) for i in range(len(p) - 11) if p[i : i + 12] in blob] == []


def test_marginals_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    unary, trans = rng.normal(size=(4, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    got = crf.chain_marginals(unary, np.array([4]), trans)[0]
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(trans[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_skip_edges_carry_evidence():
    labels = ("O", "B-name")
    f = crf.Crf(labels, {}, np.zeros((0, 2), np.float32), np.zeros((2, 2), np.float32), np.full((2, 2), 1.5))
    unary = np.array([[0, 4], [0.5, 0]], np.float32)
    alone = f.marginals(unary, np.array([1, 1]), np.zeros((0, 3), np.int64))
    tied = f.marginals(unary, np.array([1, 1]), np.array([[0, 1, crf.REPEATED]]))
    assert alone[1, 1] < 0.5 < tied[1, 1] and tied[0, 1] > 0.9


def test_loopy_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    labels = ("O", "B-name", "B-phone")
    skip = rng.normal(size=(2, 3))
    f = crf.Crf(labels, {}, np.zeros((0, 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32), skip)
    unary = rng.normal(size=(4, 3)).astype(np.float32)
    got = f.marginals(unary, np.array([2, 2]), np.array([[1, 2, crf.SIMILAR]]), rounds=5)
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = sum(unary[i, y[i]] for i in range(4)) + f.transitions[y[0], y[1]] + f.transitions[y[2], y[3]] + (f.skip[1, f.types[y[1]]] if y[1] == y[2] else 0)
        for i in range(4):
            want[i, y[i]] += np.exp(w)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_skip_potentials_are_learnt():
    rng = np.random.default_rng(5)
    labels = ("O", "B-name")
    gold = np.repeat(rng.integers(0, 2, 400), 2)
    unary = rng.normal(size=(800, 2)).astype(np.float32)
    unary[np.arange(800), gold] += 0.5
    edges = np.array([[2 * i, 2 * i + 1, crf.REPEATED] for i in range(400)])
    f = crf.Crf(labels, {}, np.zeros((0, 2), np.float32), np.zeros((2, 2), np.float32))
    f.fit_skips(unary, np.ones(800, int), edges, gold)
    assert (f.skip[crf.REPEATED] > 0.5).all() and (f.skip[crf.SIMILAR] == 0).all()
    right = lambda e: (f.marginals(unary, np.ones(800, int), e).argmax(axis=1) == gold).mean()
    assert right(edges) > right(edges[:0])


def test_what_is_tied():
    ties = pii.Ties()
    assert [ties.of(t, i) for i, t in enumerate(["Lindqvist", "LINDQVIST", "Lindqvist-Berg", "the", "가온누리", "가온누리는"])] == [[], [(0, 1, 0)], [(1, 2, 1)], [], [], [(4, 5, 1)]]


def test_find_and_redact(spark):
    persons = spark.createDataFrame([("Ada Lindqvist",), ("Bo Lindqvist",), ("가온누리",), (None,)], "name string")
    rows = [
        ("1", "content", "Thanks to Ada Lindqvist, mail ada.l+x@mail.example.org for more."), ("1", "content", "Thanks to Ada Lindqvist, mail ada.l+x@mail.example.org for more."), ("2", "quote", None), ("3", "quote", "  "),
        (None, "content", "Phone: +44 1632 960077"), ("4", "content", "order 555-031-8872 left. lib@19.4.1 for the Northern Gallery."), ("5", "content", "word " * 30_000 + "mail: a_b@host.example"), ("6", "quote", "Bo Lindqvist lives at Millweg 12, 10115 Norby"),
    ]
    df = spark.createDataFrame(rows, T).selectExpr("*", "'z' AS kind", "1 AS value", "'k' AS known", "'t' AS text_key")
    want = [
        ("1", "content", "email", "ada.l+x@mail.example.org"), ("1", "content", "name", "Ada Lindqvist"), ("5", "content", "email", "a_b@host.example"), ("6", "quote", "address", "Millweg 12, 10115 Norby"), ("6", "quote", "name", "Bo Lindqvist"), ("None", "content", "phone", "+44 1632 960077"),
    ]
    for most in (pii.MOST_NAMES, 1):  # the directory handed to the workers, and joined with the tokens
        got = sorted((str(r["id"]), r["field"], r["kind"], r["value"]) for r in pii.find(df, persons, most).collect())
        assert got == want
        red = {r["id"]: r["redacted"] for r in pii.redact(df.where("id in ('1', '6')"), persons, most).collect()}
        assert red == {"1": "Thanks to [NAME], mail [EMAIL] for more.", "6": "[NAME] lives at [ADDRESS]"}
    assert pii.find(spark.createDataFrame([], T), persons.limit(0)).collect() == []
    assert pii.directory(persons, most=1) is None

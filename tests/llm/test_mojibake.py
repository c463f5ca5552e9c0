import pytest

from ledgerloom.llm import mojibake as m

D = "id long, text string"
CLEAN = [
    "La mémoire a été remplacée après la réunion à Lyon.", "Le délai a été jugé trop élevé, “naïve” dit-il… déjà.", "Die Straße führt über die Brücke zurück.", "앞으로 설정은 이 값을 쓴다.", "검색 결과 가운데 근거가 남아 있다.", "Jalapeño ≥ piñata — café’s crème brûlée.",
]
PLAIN = ["MÂT ET CHÂSSIS", "ÿ, œ, ‰, €, ƒ", "À Â Ä Ã", "├── nodes │ └── x", "SÃO, NÃO, MAÇÃ", "† ‡ § ¶", "ªº", None, "", "   ", "plain ascii", "x" * 50_000]
WAYS = [
    lambda t: m._read("cp1252")(t.encode()), lambda t: m._read("latin-1")(t.encode()), lambda t: m._read("mac_roman")(t.encode()), lambda t: m._read("cp437")(t.encode()), lambda t: m._read("cp850")(t.encode()), lambda t: m._read("cp1251")(t.encode()), lambda t: m._read("cp1252")(m._read("cp1252")(t.encode()).encode()),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, D)


def test_every_way_is_found_and_undone(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 12 + PLAIN)]
    garbled = {1000 + 10 * k + j: (w(t), t) for k, w in enumerate(WAYS) for j, t in enumerate(CLEAN)}
    df = frame(spark, rows + [(i, g) for i, (g, _) in garbled.items()]).selectExpr("*", "1 AS kind", "'q' AS form")
    assert {r["id"] for r in m.garbled(df).collect()} == set(garbled)
    some = lambda most: {(r["id"], r["form"], r["kind"], str(r["options"])) for r in m.garbled_units(df, most).collect()}
    assert some(m.MOST_FORMS) == some(0)  # handed to the tasks, and joined
    assert all(len({o["chain"] for o in r["options"]}) == len(r["options"]) for r in m.garbled_units(df).collect())
    back = {r["id"]: r["restored"] for r in m.restore(df).collect()}
    wrong = [i for i, (_, t) in garbled.items() if back[i] != t]
    assert len(wrong) <= 0.03 * len(garbled), [(back[i], garbled[i][1]) for i in wrong]


def test_lost_characters_and_single_byte_codes(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 12)]
    lossy = {900: CLEAN[0].encode("cp1252").decode("utf-8", "replace"), 901: m._read("mac_roman")(CLEAN[2].encode("cp1252")), 902: m._read("cp1252")(CLEAN[3].encode("cp949")), 903: CLEAN[0][:30] + WAYS[0](CLEAN[0][30:])}
    df = frame(spark, rows + list(lossy.items()))
    assert {r["id"] for r in m.garbled(df).collect()} == set(lossy)
    back = {r["id"]: r for r in m.restore(df).collect()}
    assert back[901]["restored"] == CLEAN[2] and back[902]["restored"] == CLEAN[3] and back[903]["restored"] == CLEAN[0]
    assert "mémoire" in back[900]["restored"] and "remplacée" in back[900]["restored"]


@pytest.mark.parametrize("way", range(len(WAYS)))
def test_a_third_of_the_rows_is_garbled(spark, way):
    """One garbled source whose forms outnumber their originals, and a hot group of copies."""
    clean = [(i, f"plain note {i}") for i in range(40)] + [(100 + i, f"note {i}: {t}") for i, t in enumerate(CLEAN)]
    source = {1000 + i: WAYS[way](f"row {i}: déjà … “naïve” für 설정") for i in range(30)}
    assert {r["id"] for r in m.garbled(frame(spark, clean + list(source.items()))).collect()} == set(source)
    copies = dict.fromkeys(range(2000, 2030), WAYS[way](CLEAN[0]))
    assert {r["id"] for r in m.garbled(frame(spark, clean + list(copies.items()))).collect()} == set(copies)


def test_copies_under_a_single_byte_code(spark):
    clean = [(i, f"note {i}: {t}") for i, t in enumerate(CLEAN * 3)]
    copies = dict.fromkeys(range(2000, 2030), m._read("mac_roman")(CLEAN[2].encode("cp1252")))
    assert {r["id"] for r in m.garbled(frame(spark, clean + list(copies.items()))).collect()} == set(copies)


def test_frequent_meetings_of_clean_characters(spark):
    """A rare letter whose bytes read as two clean characters makes no garbled text of these."""
    clean = [(i, f"Der Name {i} endet auf „Fuß“ und ß “ x") for i in range(20)] + [(100, "letter ߓ")]
    assert m._read("cp1252")("ߓ".encode()) == "ß“" and m.garbled(frame(spark, clean)).collect() == []


def test_lost_for_good(spark):
    """Replacement characters where the corpus knows no original, and what is no evidence."""
    lost = {1: "the qz�rk is here", 2: "see �40 today", 3: "it said ��� then", 4: "first line\n� see note �, � 4 � 2\nend", 5: "한� x"}
    clean = {10: "† see note ‡, § 4 § 2", 11: "it prints � for those", 12: "†", 13: "�", 14: "plain", 15: None}
    df = frame(spark, list((lost | clean).items()))
    assert {r["id"] for r in m.garbled(df).collect()} == set(lost)
    back = {r["id"]: r for r in m.restore(df).collect()}
    assert set(back) == set(lost) and all(back[i]["n_lost"] == t.count("�") and back[i]["restored"] == t for i, t in lost.items())


def test_counts_leave_the_task_in_parts(spark, monkeypatch):
    rows = [(i, f"wörd{i} é") for i in range(30)] + [(100 + i, "wörd0 é") for i in range(5)]
    import pyarrow as pa

    monkeypatch.setattr(m, "COUNTED_AT_ONCE", 3)
    batch = pa.record_batch([pa.array([i < 100 for i, _ in rows]), pa.array([t for _, t in rows])], names=["first", "text"])
    total = {}
    for b in m._count_units(iter([batch.slice(k, 7) for k in range(0, 35, 7)])):
        for u, k, df, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[u, k] = tuple(x + y for x, y in zip(total.get((u, k), (0, 0)), (df, n), strict=True))
    assert total["é", m.RUN_KIND] == (30, 35) and total["wörd0", m.TOKEN_KIND] == (1, 6)


def test_all_lost_is_not_invented(spark):
    """A word of which nothing is left is reported, not replaced by some other word of that length."""
    rows = [(i, "검색 결과 남아") for i in range(20)] + [(99, "검색 ���� 남아")]
    back = {r["id"]: r["restored"] for r in m.restore(frame(spark, rows)).collect()}
    assert back == {99: "검색 ���� 남아"}


def test_clean_and_empty(spark):
    assert m.garbled(frame(spark, list(enumerate(CLEAN + PLAIN)))).collect() == []
    assert m.garbled(frame(spark, [])).collect() == [] and m.restore(frame(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["réglé", "’", "앞으로", "😀 x"])
def test_forms_differ_from_the_unit(text):
    for unit, kind in m.units(text):
        assert all(form != unit for _, form, _ in m.forms(unit, kind))

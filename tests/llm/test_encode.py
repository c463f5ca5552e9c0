import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.RANKS), reason="no rank file")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(8)
    alphabet = "abcdefgh ABC 0123456789 ,.-'’éüß가나다漢字🙂\t\n\r​ ́"
    out = ["".join(r.choices(alphabet, k=r.randrange(0, 60))) for _ in range(300)]
    return [*out, None, "", " ", "\n\n", "<|endoftext|>", "a" * 4099, "ab" * 700 + "a", "가" * 257, "\x00\x1c\x85", "it's we'll I'd", "🙂" * 50, " " * 1000 + "x", *out[:20]]


def test_same_ids_as_a_public_library(spark, reference):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "ids": F.lit(1)})
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df.repartition(3)).collect()}
    assert got == {i: (reference.encode_ordinary(t) if t else []) for i, t in rows}


def test_round_trip_and_empty_table(spark, reference):
    encoder = encode.WordEncoder()
    for t in texts():
        if t:
            offsets, ids = encoder.batch([t])
            assert reference.decode(ids[offsets[0] : offsets[1]].tolist()) == t
    assert encode.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert encode.count_tokens(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_tokens"] == 0


def test_forgetting_words(monkeypatch, reference):
    monkeypatch.setattr(encode, "REMEMBERED", 5)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 40)
    encoder = encode.WordEncoder()
    for t in texts()[:40]:
        offsets, ids = encoder.batch([t, None, t])
        want = reference.encode_ordinary(t) if t else []
        assert ids.tolist() == want + want and offsets.tolist() == [0, len(want), len(want), 2 * len(want)]


def long_words():
    r = random.Random(5)
    letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
    return [
        letters(6000, "abcdefghijklmnopqrstuvwxyz"), letters(3000, "的一是不了人我在有他这中大来上国"), letters(4000, "ab"), letters(3000, "ACGT"), " " * 20_000 + "x", "=" * 7001, "ab" * 5000, "가나다라" * 900, "thequick" * 800, "é" * 3000,
        "".join(chr(r.randrange(33, 0x3000)) for _ in range(4000)), "a" * 129, "b" * 128, letters(129, "abcdefghijklmnopqrstuvwxyz"),
    ]


@pytest.mark.parametrize("sizes", [(128, 64, 24), (40, 16, 6), (12, 6, 3)])
def test_long_words_are_joined_from_pieces(monkeypatch, reference, sizes):
    for name, x in zip(("LONG", "PIECE", "OVERLAP"), sizes, strict=True):
        monkeypatch.setattr(encode, name, x)
    words = long_words() if sizes[0] > 100 else [w[:1500] for w in long_words()]
    offsets, ids = encode.WordEncoder().batch(words)
    for w, a, b in zip(words, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == reference.encode_ordinary(w), w[:20]


def test_texts_are_cut_only_where_no_word_goes_on(reference):
    r = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "é", "1", "²", "\u3000", "\u00a0", "\x1c", "\x85", "\u200b", "."]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(3000)]
    offsets, ids = encode.WordEncoder().batch(texts)
    assert all(ids[a:b].tolist() == reference.encode_ordinary(t) for t, a, b in zip(texts, offsets, offsets[1:], strict=False))

"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Each partition splits its texts by the tokenizer's pattern and keeps its distinct words. A DuckDB recursive
query turns the words into token-position rows, joins adjacent tokens with the merge table and contracts, per word and
step, the pair of least rank, the leftmost first, until no word has a pair left. All
non-overlapping occurrences of that pair are contracted in one step: a pair made by a contraction ranks after it,
so this equals one at a time, and a run of one character takes logarithmically many steps. Ordered
aggregation gives each word's ids (only words in which such pairs overlap, as in a run of one character, need their places counted), and the texts are put together from them by array arithmetic. There is no
shuffle, and a text of any length costs its number of words.

Splitting: no word of the pattern goes on over a space that stands before something else, so a text is cut there first, and each
distinct piece is split by the pattern once.

Long words: the steps of a word grow with its length, so a word of more than ``LONG`` bytes is encoded in overlapping pieces. A sequence of
tokens is the encoding of its text if and only if every two neighbours are the encoding of theirs; so two pieces may be joined
after any token that both have at the same place. Where two pieces have none in common (in a run of one character, say), the word is encoded
in larger pieces, at last whole.

Defined cases: null and empty texts give an empty list; every other text is encoded exactly as stored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import text_slices
from ledgerloom.session import spread

#: Where the rank file lies on driver and executors.
RANKS = os.environ.get("LEDGERLOOM_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public pattern of the tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words in one DuckDB query; pieces and words that a worker remembers.
CHUNK_BYTES, REMEMBERED = 1_500_000, 300_000

#: Words of more bytes are encoded in pieces of PIECE bytes of which every two share OVERLAP; pieces grow by GROW where they can't be joined.
LONG, PIECE, OVERLAP, GROW = 128, 64, 24, 16

CONTRACT = """
WITH RECURSIVE steps(w, pos, id, fin) AS (
  SELECT w, pos, id, false FROM start
  UNION ALL (
  WITH sides AS (SELECT w, pos, id, CASE WHEN lead(w) OVER s = w THEN lead(id) OVER s END AS nxt, CASE WHEN lag(w) OVER s = w THEN lag(id) OVER s END AS prv
    FROM steps WHERE NOT fin WINDOW s AS (ORDER BY w::BIGINT * 4294967296 + pos)),
  ranked AS MATERIALIZED (SELECT s.w, s.pos, s.id, m.merged, p.merged AS before FROM sides s LEFT JOIN merges m ON m.a = s.id AND m.b = s.nxt LEFT JOIN merges p ON p.a = s.prv AND p.b = s.id),
  least AS MATERIALIZED (SELECT w, min(merged) AS best FROM ranked GROUP BY w),
  marked AS MATERIALIZED (SELECT r.w, r.pos, r.id, r.merged, l.best, coalesce(r.merged = l.best, false) AS hit, coalesce(r.before = l.best, false) AS after_hit FROM ranked r JOIN least l USING (w)),
  twins AS MATERIALIZED (SELECT DISTINCT w FROM marked WHERE hit AND after_hit),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) AS n FROM marked WHERE w IN (FROM twins)),
  runs AS (SELECT *, n - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS run FROM numbered),
  chosen AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY pos) % 2 = 1 AS takes FROM runs),
  every AS (SELECT w, pos, id, merged, best, takes, coalesce(lag(takes) OVER (PARTITION BY w ORDER BY pos), false) AS taken FROM chosen
    UNION ALL SELECT w, pos, id, merged, best, hit, after_hit FROM marked WHERE w NOT IN (FROM twins))
  SELECT w, pos, CASE WHEN takes THEN merged ELSE id END, best IS NULL FROM every WHERE NOT taken))
SELECT w, list(id ORDER BY pos) AS ids FROM steps WHERE fin GROUP BY w ORDER BY w
"""


@lru_cache(maxsize=2)
def _engine(ranks_path: str) -> tuple[duckdb.DuckDBPyConnection, np.ndarray, np.ndarray]:
    """A connection that holds the merge table, the ids of the single bytes, and the number of bytes of each id."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, merged = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True))
    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
    merges = pa.table({"a": a, "b": b, "merged": merged})  # noqa: F841
    con.execute("CREATE TABLE merges AS FROM merges")
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return con, np.array([ranks[bytes([i])] for i in range(256)], np.int32), lengths


def _contract(raw: list[bytes], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other and the number of each word's, by the recursive query, so many bytes of words at a time."""
    con, single, _ = _engine(ranks_path)
    flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        part, size = [], 0
        while at < len(raw) and (size < CHUNK_BYTES or not part):
            part.append(raw[at])
            size += len(raw[at])
            at += 1
        n = np.fromiter(map(len, part), np.int64, len(part))
        ids = single[np.frombuffer(b"".join(part), np.uint8)]
        w = np.repeat(np.arange(len(part), dtype=np.int32), n)
        pos = (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        con.register("start", pa.table({"w": w, "pos": pos, "id": ids}))
        got = con.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
        con.unregister("start")
        counts.append(np.diff(got.offsets.to_numpy()).astype(np.int64))
        flat.append(got.flatten().to_numpy())
    return np.concatenate(flat), np.concatenate(counts)


def _cut(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _joined(pieces: list[np.ndarray], starts: list[int], lengths: np.ndarray) -> np.ndarray | None:
    """One encoding of a word from those of its pieces, or None where two pieces have no token in common."""
    out = []
    first = 0  # of the piece at hand
    for ids, start, nxt, nxt_start in zip(pieces, starts, [*pieces[1:], None], [*starts[1:], 0], strict=True):
        if nxt is None:
            out.append(ids[first:])
            break
        ends, nxt_ends = start + np.cumsum(lengths[ids]), nxt_start + np.cumsum(lengths[nxt])
        # a token is told by its place: both its ends; only tokens behind what is taken already count
        own, other = (ends - lengths[ids]) * len(lengths) + ids, (nxt_ends - lengths[nxt]) * len(lengths) + nxt
        _, i, j = np.intersect1d(own[first:], other, return_indices=True)
        if not len(i):
            return None
        k = len(i) // 2  # in the middle, far from both edges
        out.append(ids[first : first + i[k] + 1])
        first = j[k] + 1
    return np.concatenate(out)


def _encode_long(raw: list[bytes], ranks_path: str, piece: int, overlap: int) -> list[np.ndarray]:
    """The ids of long words, from overlapping pieces where these can be joined."""
    number: dict[bytes, int] = {}
    cuts = []
    for x in raw:
        starts = [0] if len(x) <= piece else list(range(0, len(x) - overlap, piece - overlap))
        cuts.append((starts, [number.setdefault(x[s : s + piece], len(number)) for s in starts]))
    ids = _cut(*_contract(list(number), ranks_path))
    lengths = _engine(ranks_path)[2]
    out = [_joined([ids[k] for k in which], starts, lengths) for starts, which in cuts]
    again = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(again, _encode_long([raw[i] for i in again], ranks_path, piece * GROW, overlap * GROW) if again else [], strict=True):
        out[i] = x
    return out


def encode_words(words: list[str], ranks_path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and the number of each word's."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    long = [i for i, x in enumerate(raw) if len(x) > LONG]
    if not long:
        return _contract(raw, ranks_path)
    made = iter(_encode_long([raw[i] for i in long], ranks_path, PIECE, OVERLAP))
    short = iter(_cut(*_contract([x for x in raw if len(x) <= LONG], ranks_path)))
    ids = [next(made) if len(x) > LONG else next(short) for x in raw]
    return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


class _Pool:
    """Arrays that are numbered as they come, one after the other in one array."""

    def __init__(self) -> None:
        self.flat, self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.n = 0

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)])

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(flat))
        self.starts, self.counts = (self._room(x, self.n + len(counts)) for x in (self.starts, self.counts))
        self.flat[self.used : self.used + len(flat)] = flat
        new = slice(self.n, self.n + len(counts))
        self.starts[new], self.counts[new] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.n = self.used + len(flat), self.n + len(counts)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the given numbers one after the other, and the length of each."""
        n = self.counts[which]
        return self.flat[np.repeat(self.starts[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: A space before something else: no word of the pattern goes on over it.
CUT = re.compile(r" (?=\S)")


class _Pieces(dict):
    """Numbers pieces as they come; what is to be split for a new one goes to a list. A piece that is empty or begins with white space is -1: before it no text may be cut."""

    def __init__(self, lead: str, new: list[str], taken: Callable[[], int]):
        self.lead, self.new, self.taken = lead, new, taken

    def __missing__(self, piece: str) -> int:
        if self.lead and (not piece or piece[0].isspace()):
            n = -1
        else:
            n = self.taken() + len(self.new)
            self.new.append(self.lead + piece)
        self[piece] = n
        return n


class WordEncoder:
    """Encodes batches of texts; pieces and words met before are looked up."""

    def __init__(self, ranks_path: str = RANKS):
        self.ranks_path, self.pattern = ranks_path, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids = _Numbers(), _Pool()
        self.new: list[str] = []
        self.piece_ids = _Pool()
        taken = self.piece_ids.__len__
        self.pieces, self.first = _Pieces(" ", self.new, taken), _Pieces("", self.new, taken)

    def _encode_new(self) -> None:
        """The ids of the pieces that are new: those of their words."""
        split = list(map(self.pattern.findall, self.new))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.words) > len(self.word_ids):
            self.word_ids.add(*encode_words(list(islice(self.words, len(self.word_ids), None)), self.ranks_path))
        flat, n = self.word_ids.gather(numbers)
        before = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]
        self.piece_ids.add(flat, np.diff(before))
        self.new.clear()

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of the texts."""
        if max(len(self.pieces) + len(self.first), len(self.words)) > REMEMBERED:
            self.forget()
        number, none = self.pieces.__getitem__, np.zeros(0, np.int64)
        per_text = []
        for t in texts:
            if not t:
                per_text.append(none)
                continue
            parts = t.split(" ")
            numbers = np.fromiter(map(number, parts[1:]), np.int64, len(parts) - 1)
            if len(numbers) and numbers.min() < 0:
                parts = CUT.split(t)
                numbers = np.fromiter(map(number, parts[1:]), np.int64, len(parts) - 1)
            per_text.append(np.concatenate([[self.first[parts[0]]], numbers]))
        if self.new:
            self._encode_new()
        ids, n = self.piece_ids.gather(np.concatenate(per_text) if per_text else none)
        before = np.cumsum([0, *map(len, per_text)])
        return np.concatenate([[0], np.cumsum(n)])[before], ids


@lru_cache(maxsize=2)
def shared_encoder(ranks_path: str) -> WordEncoder:
    """The encoder of a Python worker, which keeps its words from task to task."""
    return WordEncoder(ranks_path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(id, ids array<int>) of every row."""
    out_type = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(ranks_path)
        for whole in batches:
            for batch in text_slices(whole, "text", 8_000_000):
                offsets, ids = encoder.batch(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], schema=out_type)

    rows = spread(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(id, n_tokens) of every row."""
    return encode(docs, id_col, text_col, ranks_path).select(id_col, F.size("ids").cast("long").alias("n_tokens"))

"""Garbled text from wrong character encoding (problem 10).

Every distinct clean unit of the corpus is garbled under every encoding chain, and the units of the documents are hash-joined with the
garbled forms; a match that is verified is replaced by its original.

Units of a text: tokens, the runs of ASCII letters, digits and non-ASCII characters that hold one of the latter, and the runs of non-ASCII
characters in them. All encodings here keep ASCII punctuation and white space, so a garbled token is the garbled
form of a token. Two kinds of chain:

- strong: one character becomes several (UTF-8 or a double-byte code read as a single-byte code, once or twice). The form of a run is evidence.
- weak: characters are exchanged one by one, merged or lost (a single-byte code read as another, as UTF-8 with
  replacement characters, or as a double-byte code). Only the form of a whole token is evidence, if it is long enough to be no symbol.

Verified: the original is found in at least as many texts as the form, is not itself a garbled form, and the
form differs from it. Copies of a text count once; where both are in equally many texts, their rows decide. The form of a run is verified too where the original is in at least as many texts
as the rarest character of the form is as a run of its own: a meeting of clean characters is rarer than they are, so a
garbled source that holds much of the corpus is found although its forms outnumber their originals. In a document with verified units, other units that match the same chain are restored too.
Characters that were lost come back where the corpus knows the word and something of it is left; a replacement character inside or beside a word, or next to
another one, is reported even where it does not, and one that stands alone where its line is a line of a text without
replacement characters but for the characters beyond ASCII. Alone in a line that is found nowhere else it may be meant, and is not reported.

Defined cases: null and empty texts are never garbled; a repeated id comes out once; ties between originals
go to the one in more texts, then to the first chain, then to the smaller original.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import slices, text_slices
from ledgerloom.session import checkpointed, spread

TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]*[\x80-\U0010ffff][A-Za-z0-9\x80-\U0010ffff]*")
RUN = re.compile(r"[\x80-\U0010ffff]+")
LOST = "�"
LOST_FOR_GOOD = r"[\p{L}\p{M}\p{N}]\x{FFFD}|\x{FFFD}[\p{L}\p{M}\p{N}\x{FFFD}]"
#: Single-byte codes, the most common first; bytes without a character stay control characters or are lost.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "iso8859-15", "cp1254", "cp1253", "koi8-r", "iso8859-2")
SOURCES = ("cp1252", "mac_roman", "cp1250", "cp850", "cp437", "cp1251")
DOUBLE_BYTE = ("cp949", "cp932", "gbk", "big5")
MULTI_BYTE = ("cp949>", "cp932>", "gbk>")
#: Hangul, kana and Han, with ASCII between.
EAST = re.compile(r"[A-Za-z0-9\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u3400-\u9fff\uac00-\ud7a3]+")
TWICE = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251")


@lru_cache(maxsize=64)
def _table(code: str, keep: bool) -> str:
    """The 256 characters of a single-byte code; bytes without one are themselves (keep) or lost."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(code))
        except UnicodeDecodeError:
            out.append(chr(b) if keep else LOST)
    return "".join(out)


def _read(code: str, keep: bool = True) -> Callable[[bytes], str]:
    table = _table(code, keep)
    return lambda raw: codecs.charmap_decode(raw, "strict", table)[0]


def _write(code: str) -> Callable[[str], bytes | None]:
    def run(text: str) -> bytes | None:
        try:
            return text.encode(code)
        except UnicodeEncodeError:
            return None

    return run


def _as_stored(code: str) -> Callable[[str], bytes]:
    """Bytes of a text that was read with _read(code)."""
    back = {ch: b for b, ch in enumerate(_table(code, True))}
    return lambda text: bytes(back[ch] for ch in text)


@lru_cache(maxsize=1)
def chains() -> list[tuple[str, bool, Callable[[str], str | None]]]:
    """(name, strong, garble) of every chain."""
    out: list[tuple[str, bool, Callable[[str], str | None]]] = []

    def add(name: str, strong: bool, write: Callable, read: Callable) -> None:
        out.append((name, strong, lambda text: None if (raw := write(text)) is None else read(raw)))

    utf8 = _write("utf-8")
    for code in SINGLE:
        add(f"utf-8>{code}", True, utf8, _read(code))
        if LOST in _table(code, False):
            add(f"utf-8>{code}, lossy", True, utf8, _read(code, False))
    for a in TWICE:
        for b in TWICE:
            add(f"utf-8>{a}>utf-8>{b}", True, lambda text, a=a: _read(a)(text.encode()).encode(), _read(b))
    for code in ("cp1252", "latin-1"):
        for k in (3,):
            add(f"utf-8>{code} x{k}", True, lambda text, code=code: _read(code)(_read(code)(text.encode()).encode()).encode(), _read(code))
    for source in ("cp949", "cp932", "gbk"):
        for code in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251"):
            add(f"{source}>{code}", True, _write(source), _read(code))
    for source in SOURCES:
        for code in SINGLE:
            if source != code:
                add(f"{source}>{code}", False, _write(source), _read(code))
        add(f"{source}>utf-8", False, _write(source), lambda raw: raw.decode("utf-8", "replace"))
    for code in DOUBLE_BYTE:
        add(f"utf-8>{code}", False, utf8, lambda raw, code=code: raw.decode(code, "replace"))
    add("cp949>utf-8", False, _write("cp949"), lambda raw: raw.decode("utf-8", "replace"))
    for code in DOUBLE_BYTE:
        for source in ("cp1252", "cp949"):
            if source != code:
                add(f"{source}>{code}", False, _write(source), lambda raw, code=code: raw.decode(code, "replace"))
    return out


TOKEN_KIND, RUN_KIND, CHAR_KIND = 0, 1, 2


def units(text: str) -> set[tuple[str, int]]:
    """Distinct (unit, kind) of a text; characters are units for being originals only."""
    tokens = set(TOKEN.findall(text))
    runs = {r for t in tokens for r in RUN.findall(t)}
    return {(t, TOKEN_KIND) for t in tokens} | {(r, RUN_KIND) for r in runs} | {(ch, CHAR_KIND) for r in runs for ch in r}


def forms(unit: str, kind: int) -> Iterator[tuple[int, str, str]]:
    """(chain number, form, original) of a unit under the chains for which such a unit is evidence.

    A no-break space in the form of a run may have become a space: the pieces beside it are evidence too, but are no form of
    anything, so their original is themselves.
    """
    is_run = kind != TOKEN_KIND
    for k, (name, strong, garble) in enumerate(chains()):
        if strong != is_run or (form := garble(unit)) is None or form == unit:
            continue
        if strong and name.startswith(MULTI_BYTE) and (kind == CHAR_KIND or not EAST.fullmatch(unit)):
            continue  # these codes hold all sorts of symbols, whose two bytes look like two letters
        if name.endswith(">utf-8") and LOST not in form:
            continue  # nothing was lost: the form is the text and the unit the garbled one
        if not form.strip(LOST):
            continue  # everything was lost: such a form is that of many units, and is reported as lost, not restored
        yield k, form, unit
        if kind == RUN_KIND and name.startswith("utf-8>") and "\xa0" in form:
            for piece in form.split("\xa0"):
                if len(piece) > 1 and RUN.fullmatch(piece):
                    yield k, piece, piece


def _long_enough(form: str, is_run: bool) -> bool:
    if is_run:
        return len(form) > 1
    return len(form) >= 4 or (len(form) == 3 and any(ch.isascii() and ch.isalpha() for ch in form))


_UNIT_COUNTS = "unit string, kind int, df long, rows long"
#: Units a task counts before it hands them on, and forms (and their bytes) that are handed to the tasks that look for them.
COUNTED_AT_ONCE, MOST_FORMS, MOST_FORM_BYTES = 300_000, 200_000, 8_000_000


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, kind, df, rows): counts of a task; a text is counted by its first row, df, and by every row."""

    def counts(df: Counter, n: Counter) -> pa.RecordBatch:
        keys = list(n)
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([df[x] for x in keys], pa.int64()), pa.array(n.values(), pa.int64())], names=["unit", "kind", "df", "rows"])

    df, n = Counter(), Counter()
    for batch in (part for whole in batches for part in text_slices(whole, "text", 2_000_000)):
        for first, text in zip(batch.column("first").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text and not text.isascii():
                own = units(text)
                n.update(own)
                if first:
                    df.update(own)
        if len(n) > COUNTED_AT_ONCE:
            yield counts(df, n)
            df, n = Counter(), Counter()
    yield counts(df, n)


def _matcher(wanted: frozenset[tuple[str, int]] | None):
    """(id, form, kind) of the units of texts that are wanted; of all tokens and runs where nothing is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text", 2_000_000)):
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and not text.isascii():
                    own = units(text)
                    rows += [(i, u, k) for u, k in (own if wanted is None else own & wanted) if k != CHAR_KIND]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32()), strict=True)], names=["id", "form", "kind"])

    return run


def _form_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 500)):  # a unit has some 150 forms
        rows: list[tuple] = []
        for unit, kind, df, n in zip(*(batch.column(c).to_pylist() for c in ("unit", "kind", "df", "rows")), strict=True):
            to = TOKEN_KIND if kind == TOKEN_KIND else RUN_KIND
            rows += [(form, to, original, df, n, chain, _long_enough(form, to == RUN_KIND)) for chain, form, original in forms(unit, kind)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["form", "kind", "original", "odf", "orows", "chain", "long"])


def restore_text(text: str, matches: list[dict]) -> tuple[str, int]:
    """The text with its matched units replaced, and the number of replaced places.

    matches: form, kind, and its options (ok, odf, chain, original); chain is the negative number of the chain.
    """
    votes: Counter[int] = Counter()
    for m in matches:
        votes.update({o["chain"] for o in m["options"] if o["ok"]})
    best: tuple[dict[str, str], dict[str, str]] = ({}, {})
    for m in matches:
        options = [o for o in m["options"] if o["ok"] or (votes[o["chain"]] and LOST not in m["form"])]
        if options:  # the chain that explains most of this text, then the more frequent original
            best[m["kind"]][m["form"]] = max(options, key=lambda o: (votes[o["chain"]], o["ok"], o["chain"], o["odf"]))["original"]
    tokens, runs = best
    n = 0

    def run(m: re.Match) -> str:
        nonlocal n
        new = runs.get(m[0])
        n += new is not None and new != m[0]
        return m[0] if new is None else new

    def token(m: re.Match) -> str:
        nonlocal n
        if (new := tokens.get(m[0])) is not None:
            n += 1
            return new
        return RUN.sub(run, m[0])

    return TOKEN.sub(token, text), n


def _restorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole, "text", 2_000_000)):
        done = [restore_text(t, m or []) for t, m in zip(batch.column("text").to_pylist(), batch.column("matches").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64()), pa.array([t.count(LOST) for t, _ in done], pa.int64())],
            names=["id", "restored", "n_replaced", "n_lost"],
        )


#: Units that one task makes the forms of, some 150 each.
UNITS_A_TASK = 10_000


def garbled_units(docs: DataFrame, most_forms: int = MOST_FORMS) -> DataFrame:
    """(id, form, kind, options) of docs(id, text): units that are garbled forms of other units of the corpus.

    options: array of struct(ok, odf, chain, original), one a chain at most, verified ones (ok) first, then by number of texts. While the
    forms are at most most_forms they are handed to the tasks that look for them, beyond that all units are joined with them.
    """
    texts = spread(docs.select("id", "text").where("id is not null and text is not null"))
    # one row of each text counts for it: the one of the least id; only ids and hashes meet by hash, so a hot text is no hot task
    hashed = texts.select("id", F.xxhash64("text").alias("hash")).distinct()
    firsts = hashed.groupBy("hash").agg(F.min("id").alias("id")).select("id").distinct().withColumn("first", F.lit(True))
    counted = texts.join(firsts, "id", "left").select("first", "text").mapInArrow(_count_units, _UNIT_COUNTS)
    counted = checkpointed(counted.groupBy("unit", "kind").agg(F.sum("df").alias("df"), F.sum("rows").alias("rows")).where("df > 0"))
    # dealt by number: the units are few bytes, but their forms are many
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // UNITS_A_TASK))
    made = counted.repartition(tasks).mapInArrow(_form_rows, "form string, kind int, original string, odf long, orows long, chain int, long boolean")
    seen = counted.where(F.col("kind") != CHAR_KIND).select(F.col("unit").alias("form"), "kind", F.col("df").alias("fdf"), F.col("rows").alias("frows"))
    hits = checkpointed(made.join(seen, ["form", "kind"]))
    # texts with the rarest character of a form as a run of its own; none for tokens, whose characters don't decide
    alone = counted.where((F.col("kind") == RUN_KIND) & (F.char_length("unit") == 1)).select(F.col("unit").alias("ch"), F.col("df").alias("alone"))
    as_many = F.struct("odf", "orows") >= F.struct("fdf", "frows")
    rarer = hits.where((F.col("kind") == RUN_KIND) & F.col("long") & ~as_many).select("form", "kind").distinct()
    parts = rarer.withColumn("ch", F.explode(F.split("form", ""))).where("ch <> ''").join(alone, "ch", "left")
    rarest = parts.groupBy("form", "kind").agg(F.min(F.coalesce("alone", F.lit(0))).alias("rarest"))
    hits = hits.join(rarest, ["form", "kind"], "left")
    ok = F.col("long") & (as_many | F.coalesce(F.col("odf") >= F.col("rarest"), F.lit(False)))
    # originals that are garbled themselves don't count
    bad = hits.where((F.col("kind") == RUN_KIND) & ok).select(F.col("form").alias("run")).distinct()
    runs_of = F.regexp_extract_all("original", F.lit(r"([^\x00-\x7f]+)"), 1)
    garbled_original = hits.select("original", F.explode(runs_of).alias("run")).distinct().join(bad, "run", "left_semi").select("original").distinct()
    clean = hits.join(garbled_original, "original", "left_anti")
    # of each chain the original in the most texts, of equal ones the smallest
    each = clean.select("form", "kind", "chain", "original", "odf", ok.alias("ok")).groupBy("form", "kind", "chain", "original", "ok").agg(F.max("odf").alias("odf"))
    top = each.groupBy("form", "kind", "chain").agg(F.max(F.struct("ok", "odf")).alias("top"), F.min_by("original", F.struct((~F.col("ok")).alias("not_ok"), (-F.col("odf")).alias("fewer"), "original")).alias("original"))
    option = F.struct(F.col("top.ok").alias("ok"), F.col("top.odf").alias("odf"), (-F.col("chain")).alias("chain"), "original")
    options = checkpointed(top.groupBy("form", "kind").agg(F.sort_array(F.collect_list(option), asc=False).alias("options")))
    held = options.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("form")), F.lit(0)).alias("bytes")).first()
    few = held["n"] <= most_forms and held["bytes"] <= MOST_FORM_BYTES
    wanted = frozenset((r["form"], r["kind"]) for r in options.select("form", "kind").collect()) if few else None
    found = texts.mapInArrow(_matcher(wanted), "id long, form string, kind int").distinct()
    return found.join(options, ["form", "kind"]).select("id", "form", "kind", "options")


def lost_for_good(docs: DataFrame) -> DataFrame:
    """(id) of docs(id, text) with replacement characters that are evidence without a known original."""
    plain = lambda c: F.octet_length(c) == F.char_length(c)
    rows = docs.select("id", "text").where(F.col("id").isNotNull() & ~plain("text"))
    lost = F.contains("text", F.lit(LOST))
    sure = F.col("text").rlike(LOST_FOR_GOOD)
    line = F.explode(F.split("text", r"[\r\n]+")).alias("line")
    shape = F.trim(F.regexp_replace("line", r"[^\x00-\x7f]+", LOST))
    few = checkpointed(rows.where(lost).select("id", "text", sure.alias("sure")))  # texts with a replacement character
    lone = few.where("not sure").select("id", line).where(F.contains("line", F.lit(LOST)))
    lone = lone.withColumn("shape", shape).where(F.col("shape").rlike("[A-Za-z0-9]")).select("id", F.xxhash64("shape").alias("shape"))
    found = few.where("sure").select("id")
    if not lone.isEmpty():
        clean = rows.where(~lost).select(line).where(~plain("line")).select(F.xxhash64(shape).alias("shape")).distinct()
        found = found.union(lone.join(clean, "shape", "left_semi").select("id"))
    return found.distinct()


def garbled(docs: DataFrame) -> DataFrame:
    """(id) of docs(id, text) in which at least one stretch is garbled."""
    return garbled_units(docs).where(F.col("options")[0]["ok"]).select("id").union(lost_for_good(docs)).distinct()


def restore(docs: DataFrame) -> DataFrame:
    """(id, restored, n_replaced, n_lost) of the garbled docs(id, text); n_lost: replacement characters that remain."""
    units_ = garbled_units(docs).groupBy("id").agg(F.collect_list(F.struct("form", "kind", "options")).alias("matches"))
    units_ = units_.where(F.exists("matches", lambda m: m["options"][0]["ok"])).join(lost_for_good(docs), "id", "full")
    texts = docs.where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return texts.join(units_, "id").mapInArrow(_restorer, "id long, restored string, n_replaced long, n_lost long")

"""Personal information inside free text (problem 6).

Windows around what can be part of an e-mail address, number, address or name are split into tokens and labelled by a skip-chain
conditional random field (crf.py): tokens of a text that repeat or resemble each other share a learnt potential, and loopy
message passing makes their labels agree. The field is trained here, on sentences made by pii_sentences.py; a
directory of known persons is a feature, not a filter, so persons that are not listed are found too; a large directory is
joined with the tokens of the texts. Found spans are replaced by typed placeholders.

Screening: outside the windows there is nothing that the model could label (a name has two parts or a Korean form of
address, a number at least six digits, an e-mail address a sign), so those tokens are "other" by constraint.
The scores of a token are the sum of what it and its four neighbours give, cached for each distinct token, and
chains are solved in batches; the whole text is always read. Rows are independent: no shuffle before the final distinct.

Defined cases: null and blank texts have no finds; a value is the exact string as it stands in the text; a
value found twice in a field of a record counts once; ids may be null (the finds then have a null id).
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import crf
from ledgerloom.llm.pii_sentences import KO_ROLES, Maker
from ledgerloom.llm.text import text_slices
from ledgerloom.session import spread

KINDS = ("address", "email", "idnum", "name", "phone")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Sentences the model is fitted on (the documented bound of its sample), and the seed they are made with.
TRAINING_SENTENCES, SEED = 6000, 20240117

TOKEN = re.compile(
    r"[\w.+%-]*[\w+%][@＠][\w-]+(?:\.[\w-]+)*"
    r"|[(\[]\s?(?:at|dot|AT|DOT)\s?[)\]]|[@＠]"
    r"|\d+[A-Za-z]\w+"
    r"|[+(]?\d[\d./()\-]*\d\)?(?:-?[A-Za-z]\b)?|\(?\d\)?[A-Za-z]?\b"
    r"|[가-힣]+(?:\d+[가-힣]+)*"
    r"|[^\W\d_가-힣][^\W가-힣’']*(?:[._+\-][^\W가-힣]+)*(?:['’](?=[^\W\d_])[^\W가-힣]+)?"
    r"|\d+|[^\w\s]|_+"
)
_CAP = r"[A-ZÀ-ÖØ-Þ]"
#: What a window can begin with.
SEED_AT = re.compile(
    r"[@＠]|[(\[]\s?(?:at|AT)\s?[)\]]|\w (?i:at [\w-]+ dot) "
    r"|(?<![\w#-])(?:[A-Z]{2} ?)?[+(]?\d(?:[ ./()\-]{0,2}\d){5,}"
    r"|(?<![\w-])[A-Z]{1,2}-?\d[\dA-Z-]{5,}"
    rf"|(?<![\w-]){_CAP}(?:[^\W\d_]+(?:-{_CAP}[^\W\d_]+)?|\.),? (?:(?:de|van|von|el|der|den|da|di|du|la|le|al|bin|dos|del)[ -])*(?:el-|al-|d['’])?{_CAP}[^\W\d_]"
    r"|\d[A-Za-z]?,? (?:bis, )?(?:[a-z]+ )?[A-ZÀ-Þ][^\W\d_]+ [A-ZÀ-Þ]|[a-zß](?:weg|straße|strasse|gasse|platz|allee) \d|\b(?:rue|calle|rua|Calle|Rua|Rue|via|Via|avenida|Avenida) (?:d[a-z]{1,2} )?[A-ZÀ-Þ]|[가-힣]\d*(?:로|길)\s?\d"
    r"|[가-힣]{2,4} ?(?:님|씨)|담당자 [가-힣]{2,4}"
)
LEFT, RIGHT = 28, 48

STREETS = frozenset("street st road rd avenue ave lane court close terrace drive square way".split())
BEFORE_STREET = frozenset("rue calle rua via avenida rúa".split())
PARTICLES = frozenset("de van von el der den da di du la le al bin dos del".split())
TITLES = frozenset("mr mrs ms dr prof frau herr m mme señor señora sr sra senhora senhor".split())
CLASSES = ("PAD", "mail", "atword", "at", "dot", "given", "family", "both", "cap", "upper", "initial", "particle", "title", "street", "beforestreet", "strasse", "flat", "bis", "lower", "n1", "n5", "n6", "n8", "nsep", "nword", "idword", "mixed", "koname", "koform", "koaddr", "ko", "comma", "stop", "open", "punct")
CLASS = {c: i for i, c in enumerate(CLASSES)}
OFFSETS = (-2, -1, 0, 1, 2)


DIRECTORY_KINDS = ("given", "family", "starts", "ends", "korean", "korean_tails")


class Directory:
    """Known persons: given and family names, the beginnings and ends of family names, Korean names."""

    def __init__(self, given: set[str], family: set[str], korean: set[str]):
        self.given, self.family, self.korean = {x.casefold() for x in given}, {x.casefold() for x in family}, set(korean)
        self.starts, self.ends = {x[:3] for x in self.family if len(x) > 4}, {x[-3:] for x in self.family if len(x) > 4}
        self.korean_tails = {x[1:] for x in self.korean}

    @classmethod
    def of(cls, names: list[str | None]) -> Directory:
        given, family, korean = set(), set(), set()
        for name in names:
            parts = (name or "").split()
            if len(parts) == 1 and re.fullmatch(r"[가-힣]{2,4}", parts[0]):
                korean.add(parts[0])
            elif len(parts) > 1:
                given.add(parts[0])
                family.update(parts[-1].split("-"))
        return cls(given, family, korean)

    def is_family(self, low: str) -> bool:
        return all(p in self.family or (len(p) > 4 and p[:3] in self.starts and p[-3:] in self.ends) for p in low.split("-"))


def classify(token: str, known: Directory) -> str:
    """The coarse class of a token."""
    low, ch = token.casefold(), token[0]
    if "@" in token or "＠" in token:
        if len(token) == 1:
            return "at"
        host = re.split("[@＠]", token)[-1]
        return "mail" if "." in host and re.search(r"[A-Za-z]", host) else "atword"
    if low.strip("()[] ") in ("at", "dot") and ch in "([":
        return low.strip("()[] ")
    if not token[-1].isalnum() and not any(c.isalnum() for c in token):
        return "comma" if token == "," else "stop" if token in ".!?" else "open" if token in "(<\"'“„«=|:" else "punct"
    digits = sum(c.isdigit() for c in token)
    if "가" <= ch <= "힣":
        if digits:
            return "koaddr" if re.search(r"(?:로|길)$", token) else "mixed"
        if token[:1] in "님씨" or token in ("님이", "님은", "님께"):
            return "koform"
        if re.search(r"(?:시|구|동|군)$", token) and len(token) > 2:
            return "koaddr"
        return "koname" if token in known.korean or (len(token) == 3 and token[1:] in known.korean_tails) else "ko"
    if digits:
        letters = [c for c in token if c.isalpha()]
        if not letters:
            return ("n1" if digits < 5 else "n5" if digits == 5 else "n6" if digits < 8 else "n8") if token.isdigit() else "nsep"
        if re.fullmatch(r"[A-Z]{2}\d{6,7}[A-Z]?|\d{7,8}-?[A-Z]", token):
            return "idword"
        return "nword" if re.fullmatch(r"\d{1,4}[A-Za-z]", token) else "mixed"
    if low in STREETS:
        return "street"
    if low in BEFORE_STREET:
        return "beforestreet"
    if low in ("flat", "apt", "unit"):
        return "flat"
    if low == "bis":
        return "bis"
    if re.fullmatch(r"\w+(?:weg|straße|strasse|gasse|platz|allee)", token) and token[0].isupper():
        return "strasse"
    if low in PARTICLES and ch.islower():
        return "particle"
    if low in TITLES:
        return "title"
    if not ch.isupper():
        if low[:3] in ("el-", "al-") and known.is_family(low[3:]):
            return "family"
        return "lower"
    if len(token) == 1:
        return "initial"
    given, family = low in known.given, known.is_family(low)
    return "both" if given and family else "given" if given else "family" if family else "upper" if token.isupper() else "cap"


def describe(token: str, known: Directory) -> list[str]:
    """Features of a token by itself."""
    c = classify(token, known)
    out = ["c=" + c]
    if c in ("lower", "cap", "upper", "ko", "title", "particle", "koform", "punct", "open", "stop", "comma"):
        out.append("w=" + token.casefold()[:16])
    if any(ch.isdigit() for ch in token):
        pattern = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", token)))[:24]
        out += ["p=" + pattern, f"d={sum(ch.isdigit() for ch in token)}", "p0=" + pattern[:4], "p1=" + pattern[-4:]]
    elif token.isalpha():
        out += ["e=" + token.casefold()[-2:], f"u={token[0].isupper()}{token.isupper()}"]
    return out


PAD_FEATURES = ["c=PAD"]


def chain_features(tokens: list[str], known: Directory) -> list[list[str]]:
    """All features of the tokens of a window: those of the neighbours by offset, and classes in context."""
    own = [PAD_FEATURES] * 2 + [describe(t, known) for t in tokens] + [PAD_FEATURES] * 2
    cls = ["PAD", *(classify(t, known) for t in tokens), "PAD"]
    out = []
    for i in range(len(tokens)):
        f = [f"{o}:{x}" for o in OFFSETS for x in own[i + 2 + o]]
        out.append([*f, f"L:{cls[i]}/{cls[i + 1]}", f"R:{cls[i + 1]}/{cls[i + 2]}", f"T:{cls[i]}/{cls[i + 1]}/{cls[i + 2]}"])
    return out


def label(text: str, spans: list[tuple[int, int, str]], marks: list[re.Match]) -> list[str]:
    out = ["O"] * len(marks)
    for a, b, kind in spans:
        inside = [i for i, m in enumerate(marks) if m.start() < b and m.end() > a]
        for k, i in enumerate(inside):
            out[i] = ("I-" if k else "B-") + kind
    return out


def stems(token: str) -> list[str]:
    """What a token shares with those that resemble it: its stem, the parts at its hyphens, the first syllables of a Korean word."""
    low = token.casefold()
    if "가" <= token[0] <= "힣":
        return [low[:3]] if len(low) > 2 else []
    if not token.replace("-", "").isalpha():
        return [re.sub(r"\D", "", low)] if sum(c.isdigit() for c in low) > 5 else []
    return [p[: max(4, len(p) - 2)] for p in low.split("-") if len(p) > 4]


class Ties:
    """The skip edges of a text: every token that can be part of an entity is tied to the last one like it."""

    def __init__(self) -> None:
        self.same: dict[str, int] = {}
        self.like: dict[str, int] = {}

    def of(self, token: str, at: int) -> list[tuple[int, int, int]]:
        ch = token[0]
        if not (len(token) > 3 and (ch.isupper() or ch.isdigit())) and not (len(token) > 1 and "가" <= ch <= "힣"):
            return []
        low, edges = token.casefold(), []
        if (before := self.same.get(low)) is not None:
            edges.append((before, at, crf.REPEATED))
        near = {k for x in stems(token) if (k := self.like.get(x)) is not None and k != before}
        edges += [(k, at, crf.SIMILAR) for k in sorted(near)]
        self.same[low] = at
        for x in stems(token):
            self.like[x] = at
        return edges


@lru_cache(maxsize=2)
def model(sentences: int = TRAINING_SENTENCES, seed: int = SEED) -> crf.Crf:
    """The field fitted to made texts; windows are cut from them as from any text.

    Words are left out of the features in a part of the texts, so that wording counts for less than shape, and the words of names always, since the
    names of a text are none of these. The skip potentials
    are fitted on other texts than the rest, so that the model's certainty there is what it is on unseen text.
    """
    maker = Maker(seed)
    known = Directory(maker.known_given, maker.known_family, maker.known_korean)
    rng = random.Random(seed)
    roles = {"w=" + w for w in KO_ROLES}  # what is left before a form of address is a name
    data = []
    for _ in range(sentences):
        text, spans = maker.sentence()
        for a, b in windows(text):
            marks = list(TOKEN.finditer(text, a, b))
            drop = 1.0 if rng.random() < 0.15 else 0.25
            feats = chain_features([m[0] for m in marks], known)
            gold = label(text, spans, marks)
            of_names = [m[0].casefold() for m, y in zip(marks, gold, strict=True) if y.endswith("-name")]
            own = {"w=" + w[:16] for w in of_names} | {"e=" + w[-2:] for w in of_names if "가" <= w[0] <= "힣"}
            kept = lambda x: (f := x.partition(":")[2]) not in own and (f[:2] != "w=" or f in roles or rng.random() >= drop)  # noqa: E731, B023
            data.append(([[x for x in f if kept(x)] for f in feats], gold))
    field = crf.train(data, LABELS)
    tokens, lengths, gold, skips = [], [], [], []
    for _ in range(sentences // 4):
        text, spans = maker.sentence(most=6)
        ties = Ties()
        for a, b in windows(text):
            marks = list(TOKEN.finditer(text, a, b))
            if marks:
                for k, m in enumerate(marks):
                    skips += ties.of(m[0], len(gold) + k)
                tokens += chain_features([m[0] for m in marks], known)
                gold += [LABELS.index(y) for y in label(text, spans, marks)]
                lengths.append(len(marks))
    field.fit_skips(field.unary(tokens), np.array(lengths), np.array(skips, np.int64).reshape(-1, 3), np.array(gold))
    return field


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text that can hold personal information, with some context, not overlapping."""
    out: list[list[int]] = []
    for m in SEED_AT.finditer(text):
        a, b = max(0, m.start() - LEFT), min(len(text), m.end() + RIGHT)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    for k, w in enumerate(out):  # to white space, so that no token is cut
        a, b = w
        while a > 0 and not text[a - 1].isspace() and (k == 0 or a > out[k - 1][1]):
            a -= 1
        while b < len(text) and not text[b].isspace() and (k + 1 == len(out) or b < out[k + 1][0]):
            b += 1
        w[:] = a, b
    return [(a, b) for a, b in out]


class Tagger:
    """Finds spans in batches of texts."""

    def __init__(self, field: crf.Crf, known: Directory, gate: bool = True):
        self.field, self.known, self.gate = field, known, gate
        self.number: dict[str, int] = {"": 0}
        self.classes: list[int] = [CLASS["PAD"]]
        self.parts: list[np.ndarray] = [self._part(PAD_FEATURES)]
        zero = np.zeros(len(LABELS), np.float32)
        get = lambda x: field.weights[k] if (k := field.index.get(x)) is not None else zero
        self.left = np.array([[get(f"L:{a}/{b}") for b in CLASSES] for a in CLASSES])
        self.right = np.array([[get(f"R:{a}/{b}") for b in CLASSES] for a in CLASSES])
        self.three = {tuple(CLASS[c] for c in x[2:].split("/")): field.weights[k] for x, k in field.index.items() if x.startswith("T:")}

    def _part(self, features: list[str]) -> np.ndarray:
        out = np.zeros((len(OFFSETS), len(LABELS)), np.float32)
        for i, o in enumerate(OFFSETS):
            for x in features:
                if (k := self.field.index.get(f"{o}:{x}")) is not None:
                    out[i] += self.field.weights[k]
        return out

    def _token(self, token: str) -> int:
        k = self.number.get(token)
        if k is None:
            k = self.number[token] = len(self.parts)
            self.classes.append(CLASS[classify(token, self.known)])
            self.parts.append(self._part(describe(token, self.known)))
        return k

    def learn(self, known: Iterable[dict]) -> None:
        """Add parts of listed names. A token's class depends on the directory alone, not on the text, so a token that is
        numbered already has been looked up before."""
        for x in known:
            getattr(self.known, x["kind"]).add(x["key"])

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text."""
        if len(self.parts) > 300_000:
            self.__init__(self.field, self.known, self.gate)
        starts, ends, tokens, lengths, owner = [], [], [], [], []
        skips: list[tuple[int, int, int]] = []
        for t, text in enumerate(texts):
            if not text:
                continue
            ties = Ties()
            for a, b in windows(text) if self.gate else [(0, len(text))]:
                n = len(starts)
                for m in TOKEN.finditer(text, a, b):
                    w = m[0]
                    skips += ties.of(w, len(starts))
                    starts.append(m.start())
                    ends.append(m.end())
                    tokens.append(self._token(w))
                    owner.append(t)
                if len(starts) > n:
                    lengths.append(len(starts) - n)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not starts:
            return out
        # two pads around every chain, so that neighbours are found by position
        n = np.array(lengths)
        first = np.cumsum(n) - n
        chain = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(starts)) + 2 + 4 * chain
        padded = np.zeros(len(starts) + 4 * len(n), np.int64)
        padded[at] = tokens
        parts = np.stack(self.parts)
        unary = sum(parts[padded[at + o], i] for i, o in enumerate(OFFSETS))
        cls = np.array(self.classes)[padded]
        a, b, c = cls[at - 1], cls[at], cls[at + 1]
        unary = unary + self.left[a, b] + self.right[b, c]
        code = (a * len(CLASSES) + b) * len(CLASSES) + c
        used, inverse = np.unique(code, return_inverse=True)
        zero = np.zeros(len(LABELS), np.float32)
        k = len(CLASSES)
        unary += np.stack([self.three.get((u // k // k, u // k % k, u % k), zero) for u in used.tolist()])[inverse]
        marginals = self.field.marginals(unary.astype(np.float32), n, np.array(skips, np.int64).reshape(-1, 3))
        best = marginals.argmax(axis=1)
        last = set((first + n - 1).tolist())
        i = 0
        hits = np.flatnonzero(best > 0)
        done = -1
        for i in hits.tolist():
            if i <= done:
                continue
            kind = LABELS[best[i]][2:]
            inside, j = LABELS.index("I-" + kind), i
            while j not in last and best[j + 1] == inside:
                j += 1
            done = j
            if (span := trim(texts[owner[i]], starts[i], ends[j], kind)) is not None:
                out[owner[i]].append((*span, kind))
        return out


def trim(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span as its kind begins and ends; None where it can't be of that kind."""
    value = text[a:b]
    if kind == "phone":
        m = re.search(r"[+(\d][\d\s./()\-]*\d(?![A-Za-z\d])", value)
        number = m[0] if m else ""
        while sum(c.isdigit() for c in number) > 15:  # no number is longer: the last group belongs to what follows
            cut = re.search(r"[\s./()\-]+\d+$", number)
            number = number[: cut.start()] if cut else ""
        if sum(c.isdigit() for c in number) < 7:
            return None
        if number[0] == "(" and ")" not in number:
            m, number = re.search(r"\d", value), number[1:]
        return a + m.start(), a + m.start() + len(number)
    if kind == "idnum":
        m = re.search(r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", value, re.S)
        if not m or sum(c.isdigit() for c in value) < 5:
            return None
        return a + m.start(), a + m.end()
    if kind == "email":
        m = re.search(r"[\w+%](?:.*\w)?", value, re.S)
        if not m or not re.search(r"(?:@|＠|[(\[]\s?at\s?[)\]]|\bat\b).*(?:\.|[(\[]\s?dot|\bdot\b)", value, re.I | re.S):  # a host has a dot
            return None
        return a + m.start(), a + m.end()
    if kind == "name":
        if m := re.fullmatch(r"([가-힣]{2,4}?)(?:님|씨)[가-힣]{0,3}", value):  # a form of address written together with the name
            return a, a + len(m[1])
        value = re.sub(r"['’]s$", "", value)
    m = re.search(r"\w(?:.*\w)?", value, re.S)
    if not m or (kind == "name" and re.fullmatch(r"[A-Za-zÀ-ÿ’'.-]+", value) and kind == "name"):
        return None
    return a + m.start(), a + m.end()


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
    return "".join([*out, text[at:]])


#: Names that are handed to the workers whole; a longer directory is joined with the tokens of the texts.
MOST_NAMES = 20_000


def directory(persons: DataFrame, most: int = MOST_NAMES) -> Directory | None:
    """The directory of persons(name), or None where it has more names than most."""
    names = [r[0] for r in persons.select("name").distinct().limit(most + 1).collect()]
    return Directory.of(sorted(n for n in names if n)) if len(names) <= most else None


_KNOWN = "key string, kind string"


def _parts_of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = Directory.of(batch.column("name").to_pylist())
        rows = [(x, kind) for kind in DIRECTORY_KINDS for x in sorted(getattr(d, kind))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["key", "kind"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, key, kind): what classify looks up for the tokens of each text."""
    for batch in batches:
        rows = set()
        for h, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a, b in windows(text or ""):
                for m in TOKEN.finditer(text, a, b):
                    low = m[0].casefold()
                    if "가" <= m[0][0] <= "힣":
                        rows |= {(h, m[0], "korean"), (h, m[0][1:], "korean_tails")}
                    elif m[0][0].isalpha():
                        rows.add((h, low, "given"))
                        for p in low.removeprefix("el-").removeprefix("al-").split("-"):
                            rows |= {(h, p, "family"), (h, p[:3], "starts"), (h, p[-3:], "ends")}
        cols = list(zip(*sorted(rows), strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["text_key", "key", "kind"])


def with_known(texts: DataFrame, persons: DataFrame) -> DataFrame:
    """texts with the column known, an array of struct(kind, key): the parts of listed names that each text can hold.

    For directories of any size: parts of names and tokens of texts meet in a join, and a text's row has only its own.
    """
    keyed = texts.withColumn("text_key", F.sha2("text", 256))
    asked = keyed.select("text_key", "text").mapInArrow(_asked, "text_key string, key string, kind string").distinct()
    parts = persons.where("name is not null").select("name").mapInArrow(_parts_of_names, _KNOWN).distinct()
    known = asked.join(parts, ["key", "kind"]).groupBy("text_key").agg(F.collect_list(F.struct("kind", "key")).alias("known"))
    return keyed.join(known, "text_key", "left").drop("text_key")


_FOUND = pa.schema([("id", pa.string()), ("field", pa.string()), ("kind", pa.string()), ("value", pa.string())])
_REDACTED = pa.schema([("id", pa.string()), ("field", pa.string()), ("redacted", pa.string()), ("n_found", pa.int64())])


def _tagged(texts: DataFrame, persons: DataFrame, rows_of: Callable[[tuple, list], list[tuple]], schema: pa.Schema, ddl: str, most_names: int) -> DataFrame:
    """rows_of((id, field, text), spans) of every text that is not null, each row once."""
    field, known = model(), directory(persons, most_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field, known or Directory(set(), set(), set()))
        for whole in batches:
            for batch in text_slices(whole, "text", 1_000_000):
                if known is None:
                    tagger.learn(x for row in batch.column("known").to_pylist() for x in row or ())
                cols = [batch.column(c).to_pylist() for c in ("id", "field", "text")]
                rows = [x for row, spans in zip(zip(*cols, strict=True), tagger.batch(cols[2]), strict=True) for x in rows_of(row, spans)]
                made = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, schema.types, strict=True)], schema=schema)

    rows = spread(texts.where("text is not null").select("id", "field", "text"))
    return (rows if known is not None else with_known(rows, persons)).mapInArrow(run, ddl).distinct()


def find(texts: DataFrame, persons: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(id, field, kind, value) of texts(id, field, text), each once; persons(name) are known persons."""
    return _tagged(texts, persons, lambda row, spans: [(row[0], row[1], k, row[2][a:b]) for a, b, k in spans], _FOUND, "id string, field string, kind string, value string", most_names)


def redact(texts: DataFrame, persons: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(id, field, redacted, n_found) of the texts(id, field, text) that hold personal information; equal rows come out once."""
    one = lambda row, spans: [(row[0], row[1], placeholders(row[2], spans), len(spans))] if spans else []
    return _tagged(texts, persons, one, _REDACTED, "id string, field string, redacted string, n_found long", most_names)

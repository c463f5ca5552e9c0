"""The value rail (G11): dates, amounts and names of an answer that neither context nor query has.

Values are taken from a text kind by kind, the more specific first, and a character belongs to one value only. They are compared by a key that does
not depend on how a date or amount is written, then as words with edges: a needle is not found inside a longer run of its own script, but a
Korean particle may follow it. Evaluated in Arrow batches, since values claim characters by position.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed word lists: courtesies and meeting notes, products everyone knows, who signs, words that only say what kind of thing a name is.
COURTESY = "thank thanks you please best regards sincerely dear warm wishes kind hello hi happy good morning afternoon evening night monday tuesday wednesday thursday friday saturday sunday".split()
MEETING = "next steps action items quick sync follow up".split()
PRODUCTS = [
    "google calendar", "google drive", "google docs", "google sheets", "google slides", "google meet", "google forms",
    "microsoft teams", "microsoft office", "microsoft excel", "microsoft word", "microsoft powerpoint", "microsoft outlook",
]
SIGNING = "team support desk department help".split()
SIGN_OFF = ["thank you", "thanks", "regards", "sincerely", "warm wishes"]
CLASSIFIERS = "project team plan program initiative phase operation 프로젝트 팀".split()
#: Fixed multipliers and units of amounts, and characters that are not seen.
MULTIPLIER = {"백만": 1_000_000, "억": 100_000_000, "만": 10_000, "천": 1_000}
CURRENCY = ["원", "달러", "USD", "%", "퍼센트"]
UNSEEN = "​‌‍⁠﻿"

ORDINARY = frozenset(COURTESY + MEETING)
#: Fixed patterns: what counts as a value. Numbers, the more specific kind first: dates, grouped numbers, amounts with multipliers, amounts with a unit, long
#: numbers; names are runs of capitalised words, and runs of Latin words that touch Hangul.
_GAP = rf"[\s{UNSEEN}]+"
_UNIT, _TIMES = "|".join(CURRENCY), "|".join(MULTIPLIER)
_TERM = rf"\d+(?:\.\d+)?(?:{_TIMES})+"
_TERMS = rf"{_TERM}(?:\s?{_TERM})*"
NUMBERS = [
    re.compile(p)
    for p in (
        r"(?<!\d)\d{4}(?:[-./]\d{1,2}){2}(?!\d)|(?:\d{4}년\s*)?\d{1,2}월\s*\d{1,2}일",
        r"(?<![\d,，])\d{1,3}(?:[,，]\d{3})+(?:[.．]\d+)?(?!\d)",
        rf"(?<!\d){_TERMS}(?:\s?(?:{_UNIT}))?(?!\d)",
        rf"(?<!\d)\d+(?:\.\d+)?\s?(?:{_UNIT})(?!\d)",
        r"(?<!\d)\d{4,}(?!\d)",
    )
]
TITLE = re.compile(rf"(?<![A-Za-z])[A-Z][a-z]+(?:{_GAP}[A-Z][a-z]+)+(?![A-Za-z])")
LATIN = re.compile(rf"(?<![A-Za-z])[A-Za-z]{{2,}}(?:{_GAP}[A-Za-z]{{2,}})+(?![A-Za-z])")
HANGUL = re.compile("[가-힣]")
_DATE = re.compile(r"(?:(\d{4})[-./년]\s*)?(\d{1,2})[-./월]\s*(\d{1,2})일?")
_WIDE = str.maketrans("，．", ",.")
_EDGE = {"digit": r"\d", "hangul": "[가-힣]", "letter": r"[^\W\d_가-힣]"}


def show(text: str) -> str:
    """Characters that are not seen as spaces."""
    return re.sub(f"[{UNSEEN}]", " ", text)


def plain(text: str) -> str:
    return " ".join(show(text).lower().split())


def folded(text: str) -> str:
    """Plain, with possessives dropped and separators as spaces."""
    return plain(re.sub(r"[_-]+", " ", re.sub(r"['’]s\b", "", show(text))))


def numbers(text: str) -> list[str]:
    """Numbers in order of place; what one kind has taken is no part of another."""
    taken, found = bytearray(len(text)), []
    for kind in NUMBERS:
        for m in kind.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                found.append((a, m[0]))
    return [x for _, x in sorted(found)]


def _touches_hangul(text: str, a: int, b: int) -> bool:
    return bool(HANGUL.match(show(text[:a]).rstrip()[-1:]) or HANGUL.match(show(text[b:]).lstrip()[:1]))


def _is_boilerplate(text: str, span: str, a: int, b: int) -> bool:
    """Courtesies, well-known products, and a team that signs at the very end."""
    words = [w for x in show(span).lower().split() if (w := x.strip(".,!?;:'\""))]
    if words and (ORDINARY.issuperset(words) or " ".join(words) in PRODUCTS):
        return True
    signs = bool(words) and words[-1] in SIGNING and not text[b:].strip(" \t\r\n.!?~")
    return signs and any(s in " ".join(text[:a].lower().split()) for s in SIGN_OFF)


def names(text: str) -> list[str]:
    """Runs of capitalised words, and Latin words of any case inside Korean text."""
    spans = [m.span() for m in TITLE.finditer(text)] + [m.span() for m in LATIN.finditer(text) if _touches_hangul(text, *m.span())]
    return [text[a:b] for a, b in spans if not _is_boilerplate(text, text[a:b], a, b)]


def values_of(text: str) -> list[str]:
    """All values of a text, each spelling once without regard to case."""
    out: dict[str, str] = {}
    for x in numbers(text) + names(text):
        out.setdefault(x.lower(), x)
    return list(out.values())


def amount(span: str) -> float | None:
    """The number that an amount stands for: multipliers in a row multiply, terms add up."""
    text = span.strip().translate(_WIDE)
    text = re.sub(rf"\s?(?:{_UNIT})$", "", text)
    if re.fullmatch(_TERMS, text):
        total = 0.0
        for digits, units in re.findall(rf"(\d+(?:\.\d+)?)((?:{_TIMES})+)", text):
            term = float(digits)
            for unit in re.findall(_TIMES, units):
                term *= MULTIPLIER[unit]
            total += term
        return total
    bare = text.replace(",", "")
    return float(bare) if re.fullmatch(r"\d+(?:\.\d*)?", bare) else None


def key(span: str) -> str:
    """G11d: one key for a date, an amount or a text, however it is written; a date without a year equals only another without one."""
    if (m := _DATE.fullmatch(span)) and (m[1] or span.endswith("일")):
        return f"date::{int(m[1]):04d}-{int(m[2]):02d}-{int(m[3]):02d}" if m[1] else f"date::????-{int(m[2]):02d}-{int(m[3]):02d}"
    if (n := amount(span)) is not None:
        return f"amount::{int(n) if n == int(n) else n}"
    return "text::" + folded(span)


def _script(ch: str) -> str | None:
    return "digit" if ch.isdigit() else "hangul" if HANGUL.match(ch) else "letter" if ch.isalpha() else None


@lru_cache(maxsize=4096)
def _bounded(needle: str) -> re.Pattern:
    first, last = _script(needle[0]), _script(needle[-1])
    return re.compile((f"(?<!{_EDGE[first]})" if first else "") + re.escape(needle) + (f"(?!{_EDGE[last]})" if last else ""))


def contains_bounded(text: str, needle: str) -> bool:
    """F16: the needle somewhere in the text, not inside a longer run of the script that it begins or ends with."""
    return bool(needle) and needle in text and bool(_bounded(needle).search(text))


def bare_name(name: str) -> str:
    """G11e: a folded name without words at its edges that only say what it is; empty where nothing but ordinary words is left."""
    words = name.split()
    while words and words[0] in CLASSIFIERS:
        words.pop(0)
    while words and words[-1] in CLASSIFIERS:
        words.pop()
    return " ".join(words) if any(w not in ORDINARY for w in words) else ""


class Source:
    """A text that values can rest on."""

    def __init__(self, text: str):
        self.plain, self.folded = plain(text), folded(text)
        self.keys = {key(x) for x in values_of(text)} if self.plain else set()

    def has(self, span: str) -> bool:
        """G11f."""
        k = key(span)
        if k in self.keys or contains_bounded(self.plain, plain(span)):
            return True
        if not k.startswith("text::"):
            return False
        name = k.removeprefix("text::")
        return contains_bounded(self.folded, name) or contains_bounded(self.folded, bare_name(name))


def check(answer: str | None, context: str | None, query: str | None) -> tuple[list[str], list[str]]:
    """Values of the answer, and those without ground; nothing without a context."""
    rests = Source(context or "")
    if not rests.plain or not (found := values_of(answer or "")):
        return [], []
    asked = Source(query or "")
    return found, [x for x in found if not rests.has(x) and not asked.has(x)]


def _batch(answer: pd.Series, context: pd.Series, query: pd.Series) -> pd.DataFrame:
    rows = [check(*row) for row in zip(answer, context, query, strict=True)]
    return pd.DataFrame({"candidates": [c for c, _ in rows], "ungrounded": [u for _, u in rows]})


def value_rail(answer: Column, context: Column, query: Column) -> Column:
    """struct(candidates, ungrounded)."""
    return F.pandas_udf(_batch, "struct<candidates:array<string>,ungrounded:array<string>>")(answer, context, query)

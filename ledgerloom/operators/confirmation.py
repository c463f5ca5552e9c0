"""The confirmation rail (G12): answers that confirm or deny something about a removed value or an identity, without ground.

A finding needs three things: the query probes (names a removed value, introduces one, or equates two names), the answer commits (confirms or
denies it, at once or after a hedge), and the claim so made is in neither the context nor, clause by clause and with equal negation, close to it. Evaluated
row by row in Arrow batches, since claims are cut out by position.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.operators.values import plain

#: Fixed word lists: what happened to a value, and what kind of value is protected.
REMOVED = "deleted retired removed revoked rotated purged scrubbed wiped decommissioned deprecated sunset archived discontinued expired invalidated".split()
REMOVED_KO = ["삭제된", "삭제됐", "폐기된", "폐기됐", "회수된", "철회된", "지워진", "지워졌", "없앤"]
FORMER_KO, TOKEN_KO = ["이전", "예전", "과거"], "토큰"
PROTECTED = "token key credential secret password mapping account customer client entity company database record project".split()
PROTECTED_KO = "토큰 키 자격증명 비밀번호 매핑 계정 고객 회사 데이터베이스 기록 프로젝트".split()
#: Fixed word lists: what two names can be said to be the same of, and other ways to say so.
THINGS, THINGS_KO = "account customer entity project company mapping".split(), "계정 고객 프로젝트 매핑 회사".split()
ALIKE = "essentially basically practically effectively".split()
#: Fixed word lists: leads of an answer.
STRONG = ["yes", "no", "nope", "correct", "confirmed", "indeed", "affirmative", *(f"that{s} {w}" for s in ("'s", " is") for w in ("correct", "right", "true"))]
STRONG_KO = ["네", "예", "아니요", "아니오", "맞습니다", "맞아요", "그렇습니다", "아닙니다", "아니에요"]
WEAK = ["yeah", "yep", "yup", "sure", "absolutely", "definitely", "of course", "you got it", "true", "precisely", "right", "certainly"]
RESTATED = ["it did", "indeed it did", *(f"i can {v} you {t}it did" for v in ("tell", "confirm") for t in ("", "that "))]
TURNS = ["however", "but", "that said", "although", "nevertheless"]
AFTER_TURN = ["i can confirm", "confirm that", "is currently", "is indeed", "is in fact", "is active", "yes", "that's true", "thats true", "it is true"]
EXACT, EXACT_KO = ["exact", "precise", "specific"], ["정확한", "정확히"]
#: Fixed word lists: negation, words without content, particles behind a Latin word.
NEGATIVE = ["not", *(f"{v}{a}t" for v in ("isn", "wasn", "aren", "weren", "doesn", "didn", "won") for a in ("'", "’", "")), "cannot", "can't", "can’t", "cant", "never", "false", "untrue", "incorrect", "denied", "no longer", "canceled", "cancelled"]
NEGATIVE_KO = ["아니", "않", "거짓", "취소"]
SMALL = frozenset("a an the is was were are be been to of and or that this it its for on in at as with we i you your our do does did has have had will would can could so right just only yet already still s".split())
PARTICLES = "에서 에게 한테 으로 까지 부터 이나 는 은 이 가 을 를 와 과 도 만 의 로 에 나".split()
NEAR, LEAST_CLAIM, LONGEST, ECHO, CLOSE, LEAST_TOKENS = 45, 12, 120, 0.4, 0.65, 2
UNSEEN = re.compile("[​-‏⁠﻿]+")


def _words(words: list[str]) -> str:
    """Any of the words, with any white space between the parts of one."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + ")"


#: Fixed patterns, of the lists above: what asks, what commits, what denies.
_I = re.I | re.S
_removed = re.compile(rf"\b{_words(REMOVED)}\b|{_words(REMOVED_KO)}|{_words(FORMER_KO)}\s*{TOKEN_KO}", _I)
_protected = re.compile(rf"\b{_words(PROTECTED)}s?\b|{_words(PROTECTED_KO)}", _I)
_introduced = re.compile(r"\b(?:began|begins|starts?|started)\s+with\s+(?P<value>\S[^.?!,;:]{0,60})", _I)
_code = re.compile(r"[\"'`][^\"'`]{1,40}[\"'`]|[A-Za-z0-9]+[_-][A-Za-z0-9_-]*[\"'`]?")
_NAME = r"[A-Z][A-Za-z0-9]{2,}"
_same = re.compile(
    rf"\bsame\s+{_words(THINGS)}s?\s+as\b|\bidentical\s+{_words(THINGS)}s?\b|\bconfusion\s+with\b|\bone\s+and\s+the\s+same\b|\b{_words(ALIKE)}\s+identical\b|\bunder\s+a\s+different\s+(?:label|name)\b"
    rf"|같은\s*{_words([*THINGS_KO, '거', '것'])}|동일한\s*{_words(THINGS_KO)}|[와과]\s*동일",
    _I,
)
_equated = re.compile(rf"\b[Ii]s\s+{_NAME}\s+the\s+{_NAME}\s+{_words(THINGS)}\b|\b[Ii]s(?:n['’]?t)?\s+{_NAME}\s+(?:really|just|actually|truly)\s+{_NAME}\b")
_implied = re.compile(r"\b(?:does\s+(?:that|this)\s+imply|implies?\s+that)\b", _I)
_is_other = re.compile(rf"{_NAME}\s+(?:is|are)\s+{_NAME}\b")
_strong = re.compile(rf"(?:{_words(STRONG)}|{_words(STRONG_KO)})\b", _I)
_weak = re.compile(rf"(?:{_words(WEAK)}|{_words(RESTATED)})\b[,.\s]*", _I)
_lead = re.compile(rf"(?:{_words(STRONG)}|{_words(STRONG_KO)}|{_words(WEAK)}|{_words(RESTATED)})[,.\s]*", _I)
_no_denial = re.compile(r"(?:\bi\s+)?\b(?:cannot|can['’]t|can\s+not)\s+deny\b\s*(?:that\s+)?", _I)
_twice_not = re.compile(r"\bnot\s+the\s+case\s+that\b.{0,80}?\b(?:is|was|does)(?:n'?t|\s+not)\b", _I)
_turn = re.compile(rf"\b{_words(TURNS)}\b", _I)
_refused = re.compile(r"\b(?:cannot|can['’]t|unable\s+to|won['’]t|will\s+not)\s+confirm\b", _I)
_affirmed = re.compile(rf"\b{_words(AFTER_TURN)}\b", _I)
_refused_ko = re.compile(rf"(?:확인[도을]?\s*(?:못|할\s*수\s*없)|부인[도을]?\s*못).{{0,80}}?{_words(STRONG_KO[:2] + STRONG_KO[4:7])}", _I)
_exact = re.compile(rf"\b{_words(EXACT)}\b|{_words(EXACT_KO)}", _I)
_negative = re.compile(rf"\b{_words(NEGATIVE)}\b|{_words(NEGATIVE_KO)}", _I)
_particle = re.compile(rf"(?<=[A-Za-z0-9]){_words(PARTICLES)}")
_date = re.compile(r"(?<!\d)(\d{4})(?:[-./]|년\s*)(\d{1,2})(?:[-./]|월\s*)(\d{1,2})(?:일|(?!\d))")
_EDGES = " .,:;\"'"


def _tokens(text: str) -> list[str]:
    return [t for t in re.findall(r"[0-9a-z]+|[가-힣]+", text.lower()) if len(t) > 1 and t not in SMALL]


def _alike(a: str, b: str) -> bool:
    """equal, or a shared beginning that is long for the script."""
    if a == b:
        return True
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    short = min(len(a), len(b))
    if "가" <= a[0] <= "힣" or "가" <= b[0] <= "힣":
        return n >= 2 and n >= 0.5 * short
    return n >= 4 or (short >= 3 and n >= 0.75 * short)


def _share(tokens: list[str], others: list[str]) -> float:
    return sum(any(_alike(t, o) for o in others) for t in tokens) / len(tokens) if tokens else 0.0


def undecorated(text: str) -> str:
    """without leading punctuation, symbols and white space of any kind."""
    return text[next((i for i, ch in enumerate(text) if not ch.isspace() and unicodedata.category(ch)[0] not in "PS"), len(text)) :]


def folded(text: str) -> str:
    """plain, without possessives and particles behind Latin words, separators as spaces."""
    return plain(re.sub("[_-]+", " ", _particle.sub("", re.sub(r"['’]s\b", "", text))))


def dates(text: str) -> set[tuple[int, ...]]:
    """D6."""
    return {tuple(map(int, m)) for m in _date.findall(text)}


def asks_for_removed(query: str) -> bool:
    """A removed something with a protected noun near it."""
    return any(_protected.search(query, max(0, m.start() - NEAR), min(len(query), m.end() + NEAR)) for m in _removed.finditer(query))


def introduces_value(query: str) -> bool:
    """Began or starts with a code or a quotation, at the end of its clause."""
    for m in _introduced.finditer(query):
        value = m["value"].strip()
        if _code.fullmatch(value):
            return True
    return False


def asks_for_identity(query: str) -> bool:
    """Two names said to be the same."""
    m = _implied.search(query)
    return bool(_same.search(query) or _equated.search(query) or (m and _is_other.search(query, m.end())))


def _echoes(rest: str, query: str) -> bool:
    tokens = _tokens(rest)
    return not tokens or _share(tokens, _tokens(query)) >= ECHO


def _confirms_after_refusing(answer: str) -> bool:
    """I can't confirm that, however it is so."""
    if m := _refused.search(answer):
        turn = _turn.search(answer, m.end(), m.end() + 220)
        if turn and _affirmed.search(answer, turn.end(), turn.end() + 220):
            return True
    return False


def commits(answer: str, query: str) -> bool:
    """G12c."""
    if _strong.match(answer):
        return True
    weak = _weak.match(answer)
    return bool(
        (weak and _echoes(answer[weak.end() :], query))
        or (_no_denial.search(answer) and _echoes(_no_denial.sub("", answer, count=1), query))
        or (_twice_not.search(answer) and _echoes(answer, query))
        or _confirms_after_refusing(answer)
        or _refused_ko.search(answer)
        or (_exact.search(query) and _exact.search(answer))
    )


def claim_of(answer: str, query: str) -> str:
    """G12d: what is confirmed: what follows a turn of speech, else a denial that is denied, else the lead; the query where too little is left."""
    parts = []
    if _confirms_after_refusing(answer):
        parts += _turn.split(answer, maxsplit=1)[1:]
    if m := _no_denial.match(answer):
        parts.append(answer[m.end() :])
    lead = _lead.match(answer)
    parts.append(answer[lead.end() :] if lead else answer)
    return next((p for x in parts if len(p := x.strip(_EDGES)) >= LEAST_CLAIM), query.strip())


def grounded(claim: str, context: str, loosely: bool) -> bool:
    """G12e: some clause of the context with the claim's negation says the same, has its date, or (loosely) most of its words."""
    said, flat, on, tokens = plain(claim), folded(claim), dates(claim), _tokens(claim)
    if len(said) < LEAST_CLAIM:
        return False
    denies = bool(_negative.search(claim))
    for clause in filter(str.strip, re.split("[.!?;]+", context)):
        if bool(_negative.search(clause)) != denies:
            continue
        if said in plain(clause) or (len(flat) >= LEAST_CLAIM and flat in folded(clause)) or on & dates(clause):
            return True
        if loosely and len(tokens) >= LEAST_TOKENS and _share(tokens, _tokens(clause)) >= CLOSE:
            return True
    return False


def check(answer: str | None, context: str | None, query: str | None) -> tuple[str | None, str | None]:
    """(span, reason) of a finding, else two nulls."""
    a, q = undecorated(UNSEEN.sub("", answer or "").strip()), query or ""
    identity, removed = asks_for_identity(q), asks_for_removed(q) or introduces_value(q)
    if not a or not (identity or removed) or not commits(a, q):
        return None, None
    claim = claim_of(a, q)
    if grounded(claim, context or "", loosely=not identity):
        return None, None
    return (claim if len(claim) <= LONGEST else claim[: LONGEST - 3] + "..."), "deleted_referent" if removed else "identity_mapping"


def _batch(answer: pd.Series, context: pd.Series, query: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([check(a, c, q) for a, c, q in zip(answer, context, query, strict=True)], columns=["span", "reason"])


def confirmation_rail(answer: Column, context: Column, query: Column) -> Column:
    """struct(span, reason), both null where nothing is found."""
    return F.pandas_udf(_batch, "span string, reason string")(answer, context, query)

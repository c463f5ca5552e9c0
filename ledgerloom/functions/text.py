"""Text functions of the ledger (F1-F11, P10), as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens: fixed pattern.
TOKEN = r"[A-Za-z0-9_./:-]+|[가-힣]+"
#: Words that a query loses: fixed list.
STOPWORDS = (
    "a an the and or but if is are was were be been being to of for in on "
    "at by with as that this these those it its we you they i he she may "
    "might will would should could do does did not no so than then until "
    "after before still just only also both note"
).split()
PUNCTUATION = ".,;:!?'\"()[]{}-"
#: Punctuation glued to a long token: fixed pattern.
GLUED = r"([A-Za-z0-9][A-Za-z0-9_/:-]{3,})([.,;:])(?=\s|$)"


def tokenize(c: Column) -> Column:
    """lower-cased tokens in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1), F.lower)


def tokens_of(text: str) -> list[str]:
    """F1 for a query on the driver."""
    return [t.lower() for t in re.findall(TOKEN, text)]


def contains_ci(text: Column, needle: str) -> Column:
    """case-insensitive containment; sharp s is folded as two letters."""
    fold = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.contains(fold(text), F.lit(needle.casefold()))


def normalize(c: Column) -> Column:
    """trimmed, lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def detach_punctuation(c: Column) -> Column:
    """punctuation glued to a long token is set apart."""
    return F.regexp_replace(c, GLUED, "$1 $2")


def normalized_query(query: str) -> str:
    """F4 and F5 for a query on the driver."""
    query = re.sub(GLUED, r"\1 \2", query)
    return " ".join(w for w in query.split() if w.strip(PUNCTUATION).lower() not in STOPWORDS)


def strip_stopwords(c: Column) -> Column:
    """a text without the stop words."""
    edge = r"^[.,;:!?'\"()\[\]{}-]+|[.,;:!?'\"()\[\]{}-]+$"
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.lower(F.regexp_replace(w, edge, "")).isin(*STOPWORDS))
    return F.array_join(words, " ")


def _literal(span: Column) -> Column:
    """A pattern that matches the span as it stands, without regard to case; an end of quoting inside it is quoted by itself."""
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(span, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def _by_length(spans: Column) -> Column:
    return F.array_sort(F.filter(spans, lambda s: s.isNotNull() & (s != "")), lambda a, b: F.length(b) - F.length(a))


def redact(c: Column, spans: Column, marker: str = "[REDACTED]") -> Column:
    """every span, longest first, replaced without regard to case."""
    return F.aggregate(_by_length(spans), c, lambda t, s: F.regexp_replace(t, _literal(s), F.lit(marker)))


def redact_counted(c: Column, spans: Column, marker: str = "[REDACTED]") -> Column:
    """struct(text, n): the same with the number of spans that were replaced."""
    start = F.struct(c.alias("text"), F.lit(0).cast("long").alias("n"))
    step = lambda t, s: F.struct(F.regexp_replace(t["text"], _literal(s), F.lit(marker)).alias("text"), (t["n"] + F.coalesce(F.regexp_like(t["text"], _literal(s)), F.lit(False)).cast("long")).alias("n"))
    return F.aggregate(_by_length(spans), start, step)


def dedup_keep_order(c: Column) -> Column:
    """First spelling of each entry, without regard to case."""
    low = F.transform(c, F.lower)
    return F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def safe_session_id(c: Column) -> Column:
    """a session id that is safe as a file name."""
    safe = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "-"), r"^\.+", "")
    return F.substring(F.when(safe == "", "session").otherwise(F.coalesce(safe, F.lit("session"))), 1, 200)


def raw_safe_name(name: Column, text: Column) -> Column:
    """a safe file name that keeps its suffix, told apart by a hash of what it holds."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}._-]", "-")
    suffix = F.regexp_extract(safe, r"[^.](\.[^.]+)$", 1)
    stem = F.regexp_replace(safe, r"(?<=[^.])\.[^.]+$", "")
    return F.concat(F.when(stem == "", "raw").otherwise(stem), F.lit("-"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12), suffix)


def default_sparse_keys(tags: Column, content: Column) -> Column:
    """P10: up to 24 distinct tags and long words, sorted."""
    words = F.transform(F.split(content, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")))
    both = F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.filter(words, lambda w: F.length(w) > 2))
    return F.slice(F.array_sort(F.array_distinct(both)), 1, 24)


def proper_noun_pairs(c: Column) -> Column:
    """F8: runs of two or more capitalised words."""
    return F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1)


def code_spans(c: Column) -> Column:
    """F8: joined codes that hold a digit."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+)\b"), 1), lambda x: x.rlike("[0-9]"))

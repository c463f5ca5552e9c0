"""Column functions shared by the operators (JVM-side, no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of Unicode letters and digits, lower-cased.
WORD = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Without surrounding white space of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Lower-cased, without surrounding white space."""
    return F.lower(strip(c))


def seconds(c: Column) -> Column:
    """Epoch seconds of an ISO-8601 string with offset; null where it is none."""
    return F.unix_seconds(c.try_cast("timestamp"))


def micros(c: Column) -> Column:
    """Epoch microseconds of an ISO-8601 string with offset; null where it is none."""
    return F.unix_micros(c.try_cast("timestamp"))


def words(c: Column) -> Column:
    """All words of a text in order, with repeats; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


def ids(c: Column) -> Column:
    """An id array without null and empty entries; null gives an empty array."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps, the right one winning; null counts as empty."""
    keys = F.coalesce(F.map_keys(right), F.array().cast("array<string>"))
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(keys, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(kept, right))


def scope_matches(a: Column, b: Column) -> Column:
    """Either side names nothing, or both name something in common."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return none(a) | none(b) | F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def fold_separators(c: Column) -> Column:
    """possessives dropped, invisible characters and runs of separators as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"['’]s\b", ""), "[\u200b-\u200f\u2060\ufeff]+", " "), r"(?U)[\s_-]+", " "))

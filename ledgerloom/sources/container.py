"""A portable ledger in one folder (S5-S7, V9, V10): a section of JSON lines for each kind of record, and a header with counts and digests.

Sections are written and read by Spark in parallel. The digest of a section is a sum over the records' hashes, so it needs no order
and no single file; each failure of a check is an error of its own, raised before any data is returned.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.integrity import FORBIDDEN_KEYS, forbidden_keys
from ledgerloom.sources.schemas import EDGE, NODE, PATCH

MAGIC, VERSION = "ledgerloom-container", "0.1"
SECTIONS = {"nodes": NODE, "patches": PATCH, "edges": EDGE}


class ContainerError(ValueError):
    """A container can't be read; the message says which check failed."""


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def digest(lines: DataFrame) -> tuple[int, str]:
    """Number of lines, and the sum modulo 2**128 of the first half of their SHA-256."""
    h = F.sha2("value", 256)
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(38,0)")
    row = lines.agg(F.count("*").alias("n"), *[F.sum(part(1 + 8 * k)).alias(f"p{k}") for k in range(4)]).first()
    total = sum(int(row[f"p{k}"] or 0) << (32 * (3 - k)) for k in range(4)) % (1 << 128)
    return row["n"], f"{total:032x}"


def guard(df: DataFrame) -> None:
    """V9: no record may hold a key of the forbidden list at any depth."""
    bad = forbidden_keys(_lines(df), "value").first()
    if bad is not None:
        raise ContainerError(f"a record holds one of {', '.join(FORBIDDEN_KEYS)}")


def narrowed(sessions: DataFrame, session_ids: list[str] | None = None) -> DataFrame:
    """The sessions of a pack of the whole ledger: all, or those of the given ids; other sections are never narrowed."""
    return sessions if session_ids is None else sessions.where(F.col("id").isin(*session_ids))


def write(root: str, spark: SparkSession, **sections: DataFrame) -> dict:
    """Write the sections below root, then the header, whose presence marks a complete container."""
    header = {"container": MAGIC, "version": VERSION, "sections": []}
    for name in SECTIONS:
        if name in sections:
            guard(sections[name])
            lines = _lines(sections[name])
            lines.write.mode("overwrite").text(f"{root}/{name}")
            n, d = digest(spark.read.text(f"{root}/{name}"))
            header["sections"].append({"name": name, "count": n, "digest": d})
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/header")
    return header


def read(root: str, spark: SparkSession, validate: bool = True) -> dict[str, DataFrame]:
    """The sections of a container, checked: magic, version, header, counts, digests, forbidden keys, in this order."""
    try:
        text = spark.read.text(f"{root}/header").first()
        header = json.loads(text[0])
    except Exception as e:  # noqa: BLE001
        raise ContainerError(f"header can't be read: {e}") from e
    if header.get("container") != MAGIC:
        raise ContainerError("not a container")
    if header.get("version") != VERSION:
        raise ContainerError(f"unknown version {header.get('version')}")
    if not isinstance(header.get("sections"), list):
        raise ContainerError("header has no sections")
    out = {}
    for s in header["sections"]:
        if s["name"] not in SECTIONS:
            continue  # sections of later versions are left alone
        lines = spark.read.text(f"{root}/{s['name']}")
        n, d = digest(lines)
        if n != s["count"]:
            raise ContainerError(f"{s['name']}: {n} records, the header has {s['count']}")
        if d != s["digest"]:
            raise ContainerError(f"{s['name']}: digest differs")
        df = spark.read.schema(SECTIONS[s["name"]]).json(f"{root}/{s['name']}")
        if validate:
            guard(df)
        out[s["name"]] = df
    return out

"""Versioned snapshots of a table (S9): a new folder for each version, and a pointer that is changed last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import raw_safe_name


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("version long, path string").json(f"{root}/_versions")
    except Exception:  # noqa: BLE001 - no version yet
        return None


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """The latest committed version and its folder."""
    rows = _versions(spark, root)
    row = rows.agg(F.max(F.struct("version", "path")).alias("m")).first() if rows is not None else None
    return (row["m"]["version"], row["m"]["path"]) if row and row["m"] else None


def commit(df: DataFrame, root: str) -> int:
    """Write df as the next version; readers see it when its entry is there. One writer a table."""
    spark = df.sparkSession
    last = current(spark, root)
    version = (last[0] if last else 0) + 1
    path = f"{root}/v{version:06d}"
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").json(f"{root}/_versions")
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    if version is not None:
        return spark.read.parquet(f"{root}/v{version:06d}")
    last = current(spark, root)
    if last is None:
        raise FileNotFoundError(f"no version below {root}")
    return spark.read.parquet(last[1])


def append_audit(events: DataFrame, root: str) -> None:
    """Audit events are only ever appended."""
    events.write.mode("append").json(f"{root}/audit")


def append_raw(texts: DataFrame, root: str) -> None:
    """texts(name, text) are only ever appended, under a name that tells them apart."""
    texts.select(raw_safe_name(F.col("name"), F.col("text")).alias("source_id"), "text").write.mode("append").json(f"{root}/raw")

"""Sources of ledger records (S1-S4, S8, S15, S17, H5): JSON directories, JSONL, raw text, code files, event messages.

Schemas are explicit. Malformed records are kept apart, never dropped in silence: readers return them with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.schemas import EDGE, NODE, PATCH

SCHEMAS = {"nodes": NODE, "patches": PATCH, "edges": EDGE}


def read_directory(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One JSON document a file, in the order of file names (ord); documents that can't be read have corrupt set."""
    schema = f"{SCHEMAS[kind]}, corrupt string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("multiLine", True).json(f"{root}/{kind}")
    return rows.withColumn("ord", F.col("_metadata.file_name"))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("corrupt is null and id is not null").drop("corrupt")


def problems(rows: DataFrame) -> DataFrame:
    """H5: (ord, corrupt) of documents that can't be read."""
    return rows.where("corrupt is not null or id is null").select("ord", "corrupt")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """S3: node records, one a line; blank lines are skipped and a missing id follows from content and source."""
    rows = spark.read.schema(f"{NODE}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)
    own = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("/", "content", "source.label", "source.quote"), 256), 1, 12))
    return rows.where("corrupt is null").drop("corrupt").withColumn("id", F.coalesce("id", own)).withColumn("status", F.coalesce("status", F.lit("active")))


def read_raw(spark: SparkSession, path: str, most: int | None = 300) -> DataFrame:
    """(source_id, line_no, line) of text files, lines from 1, cut to a preview; most None gives whole lines, which grep needs."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_id"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    return lines.where("line <> ''").select("source_id", (F.col("k") + 1).alias("line_no"), (F.col("line") if most is None else F.substring("line", 1, most)).alias("line"))


def grep(nodes: DataFrame, raw: DataFrame, needle: str, limit: int = 20, tags: bool = True) -> DataFrame:
    """(kind, id, line_no, text): nodes with the needle in content, id or (with tags) a tag by id, then raw lines by source and line.

    A node's text is whole, a raw line is shown to its first 300 characters. raw is searched as it is given: read it with most=None.
    """
    n = F.lit(needle.lower())
    tagged = F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), n)), F.lit(False)) if tags else F.lit(False)
    memory = nodes.where(F.contains(F.lower("content"), n) | F.contains(F.lower("id"), n) | tagged).select(F.lit("memory").alias("kind"), "id", F.lit(0).alias("line_no"), F.col("content").alias("text"))
    lines = raw.where(F.contains(F.lower("line"), n)).select(F.lit("raw").alias("kind"), F.col("source_id").alias("id"), F.col("line_no").cast("int").alias("line_no"), F.substring("line", 1, 300).alias("text"))
    return memory.unionByName(lines).orderBy("kind", "id", "line_no").limit(limit)


#: Folders that hold no code of one's own.
SKIPPED = ("node_modules", "__pycache__", "build", "dist", "target", "venv", "coverage", "vendor")


def read_code(spark: SparkSession, path: str, pattern: str = "*.{py,js,ts,tsx,jsx,rs,go,java,rb,sh,toml,md}", skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, text) of code files below a folder, without folders that are skipped or begin with a dot."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    whole = F.col("_metadata.file_path")
    parts = F.slice(F.split(F.replace(whole, F.lit(path.rstrip("/")), F.lit("")), "/"), 1, 1_000)
    inside = F.filter(parts, lambda x, i: i < F.size(parts) - 1)
    out = F.exists(inside, lambda x: x.isin(*skip) | (x.startswith(".") & (x != ".")))
    return rows.where(~out).select(whole.alias("path"), F.col("value").alias("text"))


def event_message(text: Column) -> Column:
    """A message as a JSON object: the text itself where it is one, else an object that holds it as raw_stdin."""
    keys = F.json_object_keys(text)
    return F.when(keys.isNotNull(), text).otherwise(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("raw_stdin"))))


def event_prompt(message: Column) -> Column:
    """The prompt of a JSON message: the first of its known places, else the message itself."""
    at = lambda p: F.get_json_object(message, p)
    return F.coalesce(at("$.prompt"), at("$.user_prompt"), at("$.message"), at("$.input"), at("$.messages[-1].content"), message)


def event_session(message: Column) -> Column:
    """The session of a JSON message: the first known place that is not empty."""
    at = lambda p: F.nullif(F.get_json_object(message, p), F.lit(""))
    return F.coalesce(*[at(f"$.{k}") for k in ("session_id", "sessionId", "conversation_id", "conversationId", "thread_id")])

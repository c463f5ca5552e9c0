import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import container, readers, snapshots
from ledgerloom.sources.schemas import EDGE, NODE


def node(i, **kw):
    return {"schema_version": "x.memory_node.v0.1", "id": i, "type": "memory", "content": "text of " + i, "status": "active", "relations": {"supersedes": ["mem_b"]}, **kw}


def frame(spark, *rows):
    return spark.read.schema(NODE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_directory_with_a_corrupt_document(spark, tmp_path):
    os.makedirs(tmp_path / "nodes")
    for name, text in (("mem_a.json", json.dumps(node("mem_a"), indent=1)), ("mem_b.json", "{oops"), ("mem_c.json", json.dumps(node("mem_c")))):
        (tmp_path / "nodes" / name).write_text(text)
    rows = readers.read_directory(spark, str(tmp_path), "nodes").cache()
    assert [r["id"] for r in readers.valid(rows).orderBy("ord").collect()] == ["mem_a", "mem_c"]
    assert [r["ord"] for r in readers.problems(rows).collect()] == ["mem_b.json"]


def test_jsonl_raw_and_grep(spark, tmp_path):
    (tmp_path / "seed.jsonl").write_text('{"content": "Alpha fact", "source": {"label": "chat"}}\n\n{"id": "mem_1", "content": "beta"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "seed.jsonl"))
    assert sorted(r["id"][:4] for r in rows.collect()) == ["mem_", "mem_"] and rows.where("id = 'mem_1'").count() == 1
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "a.txt").write_text("one\r\nalpha two\n\n" + "x" * 1000 + "alpha")
    raw = readers.read_raw(spark, str(tmp_path / "raw"))
    assert {(r["line_no"], len(r["line"])) for r in raw.collect()} == {(1, 3), (2, 9), (4, 300)}
    assert [r["kind"] for r in readers.grep(rows, raw, "ALPHA").collect()] == ["memory", "raw"]


def test_grep_searches_whole_lines_ids_and_tags(spark, tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "a.txt").write_text("one\r\nalpha two\n\n" + "x" * 1000 + "alpha")
    raw = readers.read_raw(spark, str(tmp_path / "raw"), most=None)
    long = "y" * 400 + " alpha"
    rows = frame(spark, node("mem_1", content=long), node("mem_alpha", content="b"), node("mem_2", content="c", tags=["d", "Alphabet"]), node("mem_3", content="e", tags=["f"]), node("mem_4", content="g"))
    got = [(r["kind"], r["id"], r["line_no"], r["text"]) for r in readers.grep(rows, raw, "ALPHA").collect()]
    assert got == [("memory", "mem_1", 0, long), ("memory", "mem_2", 0, "c"), ("memory", "mem_alpha", 0, "b"), ("raw", "a.txt", 2, "alpha two"), ("raw", "a.txt", 4, "x" * 300)]


def test_container_round_trip_and_checks(spark, tmp_path):
    nodes = frame(spark, node("mem_a", tags=["t"], metadata='{"k": 1}'), node("mem_b", content='quote " and \\ and\nline'))
    edges = spark.createDataFrame([("s", "edge_1", "mem_a", "mem_b", "supersedes", None, None)], EDGE)
    root = str(tmp_path / "c")
    container.write(root, spark, nodes=nodes, edges=edges)
    back = container.read(root, spark)
    as_json = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)))).collect())
    assert as_json(back["nodes"]) == as_json(nodes) and as_json(back["edges"]) == as_json(edges)
    with pytest.raises(container.ContainerError, match="holds one of"):
        container.write(str(tmp_path / "bad"), spark, nodes=nodes.withColumnRenamed("metadata", "user_id"))
    part = next(p for p in (tmp_path / "c" / "nodes").iterdir() if p.name.endswith(".txt") and "text of" in p.read_text())
    part.write_text(part.read_text().replace("text of", "TEXT of"))
    for p in (tmp_path / "c" / "nodes").glob(".*.crc"):
        p.unlink()
    with pytest.raises(container.ContainerError, match="digest"):
        container.read(root, spark)
    with pytest.raises(container.ContainerError, match="header"):
        container.read(str(tmp_path / "none"), spark)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, root)
    assert snapshots.commit(spark.range(3).toDF("x"), root) == 1 and snapshots.commit(spark.range(5).toDF("x"), root) == 2
    assert snapshots.load(spark, root).count() == 5 and snapshots.load(spark, root, 1).count() == 3


def test_messages(spark):
    rows = [('{"prompt": "p", "sessionId": "s"}',), ('{"messages": [], "session_id": "", "thread_id": "t"}',), ("not json",)]
    df = spark.createDataFrame(rows, "m string").select(readers.event_prompt(F.col("m")).alias("p"), readers.event_session(F.col("m")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [("p", "s"), (rows[1][0], "t"), ("not json", None)]


def test_small_sources(spark, tmp_path):
    for name in ("a.py", "node_modules/b.js", ".git/c.py", "src/.x/d.py", "src/e.py", "notes.txt"):
        os.makedirs(os.path.dirname(tmp_path / "code" / name), exist_ok=True)
        (tmp_path / "code" / name).write_text("x = 1")
    got = [r["path"].split("/code/")[1] for r in readers.read_code(spark, str(tmp_path / "code")).collect()]
    assert sorted(got) == ["a.py", "src/e.py"]
    rows = spark.createDataFrame([('{"a": 1}',), ("plain",), (None,), ("[1]",)], "t string").select(readers.event_message(F.col("t")).alias("m")).collect()
    assert [json.loads(r["m"]) for r in rows] == [{"a": 1}, {"raw_stdin": "plain"}, {"raw_stdin": ""}, {"raw_stdin": "[1]"}]
    tagged = frame(spark, node("mem_1", content="x", tags=["alpha"]))
    none = spark.createDataFrame([], "source_id string, line_no int, line string")
    assert readers.grep(tagged, none, "alpha").count() == 1 and readers.grep(tagged, none, "alpha", tags=False).count() == 0
    texts = spark.createDataFrame([("n.txt", "one"), ("n.txt", "two"), (None, None)], "name string, text string")
    snapshots.append_raw(texts, str(tmp_path / "ledger"))
    snapshots.append_raw(texts.limit(1), str(tmp_path / "ledger"))
    back = spark.read.json(str(tmp_path / "ledger" / "raw"))
    assert back.count() == 4 and back.select("source_id").distinct().count() == 3
    sessions = spark.createDataFrame([("s1",), ("s2",)], "id string")
    assert container.narrowed(sessions).count() == 2 and [r["id"] for r in container.narrowed(sessions, ["s2", "x"]).collect()] == ["s2"]


def test_batches_of_a_stream(spark, tmp_path):
    """ST3: events come in, are appended, and a batch operator runs on each micro-batch; a batch that is run again replaces its own part."""
    from ledgerloom.streaming import sessions as streams

    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.json").write_text('{"session_id": "s", "prompt": "one"}\n{"sessionId": "t", "message": "two"}\n')
    make = lambda b: b.select(readers.event_session(F.col("value")).alias("session"), readers.event_prompt(F.col("value")).alias("prompt"))
    run = lambda: streams.each_batch(spark.readStream.text(str(tmp_path / "in")), make, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (tmp_path / "in" / "b.json").write_text('{"thread_id": "u", "input": "three"}\n')
    run()
    run()
    got = {(r["session"], r["prompt"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("s", "one"), ("t", "two"), ("u", "three")}

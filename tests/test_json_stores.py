from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import json_stores as J
from lodestrata.sources.document_sink import write_documents


def test_arrays_with_rejects(spark, tmp_path):
    files = {"a.json": '[{"b": 1, "a": "x"}, 5, "{}", null, [{}], {}]', "b.json": "[]", "c.json": '{"a": 1}', "d.json": "[{", "e.json": "", "f.json": "null", "sub/g.json": '[{"a": 7}]', "h.txt": "[1]"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "i.json").write_bytes(b'[{"a": "\xff"}]')
    got = sorted((os.path.basename(r["path"]), -1 if r["at"] is None else r["at"], r["record"], r["reject"]) for r in J.array_records(spark, f"file://{tmp_path}").collect())
    assert got == [
        ("a.json", 0, '{"a": "x", "b": 1}', None), *[("a.json", i, None, "no object") for i in (1, 2, 3, 4)], ("a.json", 5, "{}", None), ("c.json", -1, None, "no list"), ("d.json", -1, None, "no json"),
        ("f.json", -1, None, "no list"), ("g.json", 0, '{"a": 7}', None), ("i.json", -1, None, "no json"),
    ]
    rows = J.records(spark, f"file://{tmp_path}", "a string, b int").collect()
    assert sorted((str(r["a"]), r["b"]) for r in rows) == [("7", None), ("None", None), ("x", 1)]


def snapshot(folder, name, at, **fields):
    (folder / name).write_text(fields.pop("raw", None) or json.dumps(fields))
    os.utime(folder / name, (at, at))


def test_newest_sessions(spark, tmp_path):
    said = lambda *texts: [{"role": "user", "content": [{"type": "text", "text": t} for t in texts]}]
    for i in range(12):
        snapshot(tmp_path, f"session-{i}.json", 1000 + i, session_id=f"s{i}", created_at=100.0 + i, messages=said(f"hello {i}"))
    snapshot(tmp_path, "session-x.json", 2000, raw="{broken")
    snapshot(tmp_path, "session-y.json", 2001, summary="given", model="m", message_count=9, created_at=50.0)
    snapshot(tmp_path, "session-z.json", 2002, messages=[{"role": "assistant", "content": []}, *said(" ", ""), *said("a" * 70, "b" * 30)], created_at=300.0)
    snapshot(tmp_path, "latest.json", 3000, session_id="s11", created_at=9999.0)
    got = [tuple(r) for r in J.sessions(spark, f"file://{tmp_path}", 4).collect()]
    assert got == [("z", "a" * 70 + " " + "b" * 9, 3, "", 300.0), ("s11", "hello 11", 1, "", 111.0), ("s10", "hello 10", 1, "", 110.0), ("y", "given", 9, "m", 50.0)]
    snapshot(tmp_path, "latest.json", 3000, session_id="other", messages=[])
    assert [r[:2] for r in map(tuple, J.sessions(spark, f"file://{tmp_path}", 1).collect())] == [("other", "(latest session)")]
    plan = J.sessions(spark, f"file://{tmp_path}", 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(modific" in plan


def test_index_of_sessions(spark, tmp_path):
    index = J.SessionIndex(spark, f"file://{tmp_path}/index")
    make = lambda rows: spark.createDataFrame(rows, index.schema)
    snapshot(tmp_path, "session-1.json", 1000, session_id="f1", created_at=5.0, messages=[], title="file")
    snapshot(tmp_path, "session-2.json", 1000, raw="[")
    assert [r["title"] for r in index.newest(5, f"file://{tmp_path}").collect()] == ["file"] and index.newest(5).count() == 0
    index.upsert(make([("a", "one", 1, 1.0, 1.0), ("b", "two", 1, 1.0, 3.0), ("a", "later", 1, 1.0, 2.0)]))
    index.upsert(make([("c", "three", 1, 1.0, None), ("b", "new", 2, 1.0, 9.0)]))
    assert [r["title"] for r in index.newest(5, f"file://{tmp_path}").collect()] == ["new", "later", "three"]
    index.remove(make([("b", None, None, None, None), ("zz", None, None, None, None)]))
    assert [r["session_id"] for r in index.newest(1).collect()] == ["a"]


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    write_documents(spark.createDataFrame([("a.md", "one"), ("b.md", None), ("a.md", "two")], "name string, body string"), path)
    read = lambda: {f: (tmp_path / "out" / f).read_text() for f in os.listdir(path)}
    assert read() == {"a.md": "two", "b.md": ""}
    rows = spark.range(40).select(F.when(F.col("id") == 33, F.lit("sub/x")).otherwise(F.concat("id", F.lit(".md"))).alias("name"), F.lit("new").alias("body"))
    with pytest.raises(Exception, match="no name"):
        write_documents(rows.union(spark.createDataFrame([("a.md", "new")], "name string, body string")), path)
    assert read() == {"a.md": "two", "b.md": ""}
    write_documents(spark.createDataFrame([("a.md", "three")], "name string, body string"), f"file://{path}")
    assert read() == {"a.md": "three", "b.md": ""}


def test_transcripts(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", " hi "), (1, 1, "user", "hello"), (2, 1, "user", None)], "c long, t long, role string, text string")
    got = {r["c"]: r["markdown"] for r in J.transcript(turns, "c", "t").collect()}
    assert got == {1: "# Session Transcript\n\n## User\n\nhello\n\n## Assistant\n\nhi\n", 2: "# Session Transcript\n\n## User\n\n"}


def test_without_a_limit_all_sessions_count(spark, tmp_path):
    for i in range(30):
        snapshot(tmp_path, f"session-{i}.json", 1000 + i, session_id=f"s{i}", created_at=100.0 + i, messages=[])
    snapshot(tmp_path, "latest.json", 3000, session_id="other", messages=[])
    assert J.sessions(spark, f"file://{tmp_path}", None).count() == 31


def test_the_driver_sees_no_names_of_documents(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    from lodestrata.sources import document_sink as D
    from lodestrata.sources import ingest as I

    class Folders:
        """What the driver may do."""

        def __init__(self, files) -> None:
            self.create_dir, self.delete_dir = files.create_dir, files.delete_dir

    driver, opened, formatted = os.getpid(), D.opened, DataFrameReader.format
    limited = lambda path: (Folders(opened(path)[0]) if os.getpid() == driver else opened(path)[0], opened(path)[1])
    monkeypatch.setattr(D, "opened", limited)
    monkeypatch.setattr(I, "opened", limited)
    monkeypatch.setattr(DataFrameReader, "format", lambda self, source: pytest.fail("the driver lists files") if source == "binaryFile" else formatted(self, source))
    rows = spark.range(50).select(F.concat(F.lit("d"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("text "), "id").alias("body"))
    path = str(tmp_path / "out")
    for body in ("old", None):
        write_documents(rows.withColumn("body", F.lit(body)) if body else rows, path, 4)
    (tmp_path / "out" / "_hidden.md").write_text("no")
    (tmp_path / "out" / "top.MD").write_bytes(b"a\xffb")
    assert sorted(os.listdir(path)) == ["000", "001", "002", "003", "_hidden.md", "top.MD"]
    got = {r["path"].rsplit("/", 1)[1]: r for r in I.files(spark, f"file://{path}").collect()}
    assert {n: r["text"] for n, r in got.items()} == {f"d{i}.md": f"text {i}" for i in range(50)} | {"top.MD": "a�b"}
    assert all(r["path"].startswith("file:/") and os.path.exists(r["path"].removeprefix("file:")) for r in got.values())
    assert abs(got["top.MD"]["modified"].timestamp() - os.path.getmtime(f"{path}/top.MD")) < 1


def test_documents_of_queries_are_dealt_to_folders(spark, sf):
    from lodestrata.plans import folders

    path = folders._folder(spark, sf).removeprefix("file://")
    inside = [os.listdir(f"{path}/{name}") for name in os.listdir(path)]
    assert len(inside) == 1024 and sum(map(len, inside)) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert max(map(len, inside)) < 10

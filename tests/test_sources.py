"""Readers, writers and the stream."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.sources import readers, writers
from folioscope.streaming import landing

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"a","n":1}\n\n[1]\n{"id":"b","n":true}\n{"id":"c","id":"d"}\n{"id":"e","x":1}\n')
    lenient = [(r["id"], r["_bad"]) for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), ROW).collect()]
    assert [b for _, b in lenient] == [None, "not an object", "wrong type", None, None]
    strict = [r["_bad"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), ROW, strict=True).collect()]
    assert strict == [None, "blank line", "not an object", "wrong type", "repeated key", "unknown key"]
    assert [(r["line"], r["value"][:7]) for r in readers.numbered_json_lines(spark, str(tmp_path / "a.jsonl")).collect()][1] == (3, "[1]")


def test_json_objects(spark, tmp_path):
    for name, text in (("a", '{"id":"x","n":2}'), ("b", '{"id":"x","id":"y"}'), ("c", "[]"), ("d", " " * 200)):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "e.json").write_bytes(b"\xff{}")
    rows = {r["path"][-6]: r for r in readers.json_objects(spark, str(tmp_path), ROW, max_bytes=100).collect()}
    assert {k: r["_bad"] for k, r in rows.items()} == {"a": None, "b": "repeated key", "c": "not an object", "d": "too large", "e": "not UTF-8"} and rows["a"]["n"] == 2


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("path,label,n,more\na,yes,1,\nb,what,x,\n")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = readers.csv_manifest(spark, str(tmp_path / "t.csv"), schema, {"label": ["yes", "no"]}).collect()
    assert [(r["n"], r["_bad"]) for r in rows] == [(1, None), (None, "label")]
    with pytest.raises(readers.SourceError, match="split"):
        readers.csv_manifest(spark, str(tmp_path / "t.csv"), schema.add("split", T.StringType()))


def test_results_and_files(spark, tmp_path):
    page = {"text_lines": [{"text": "a", "confidence": 0.5, "bbox": [0, 0, 1, 1]}, {"text": "b"}], "page": 1}
    for name, held in (("r1", {"x": [page], "y": [page, page]}), ("r2", {"x": [page]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(held))
    rows = readers.ocr_results(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r["source_name"], r["text"], r["_bad"]) for r in rows) == [("x", "a\nb", "in several files")] * 2 + [("y", "a\nb", None)] * 2
    tree = readers.file_tree(spark, str(tmp_path), keep=r"\.json$", leave="r2").collect()
    assert len(tree) == 1 and tree[0]["size"] == len(json.dumps({"x": [page], "y": [page, page]}))
    for name in ("a.png", "b.PNG", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted((r["stem"], r["_bad"]) for r in readers.files_by_stem(spark, str(tmp_path)).collect()) == [("a", "several files")] * 2 + [("b", None)]


def test_parallel_blocks_and_marks(spark):
    df = spark.createDataFrame([(["a", " ", "b"], [1, 2, 3])], "text array<string>, left array<int>")
    assert [tuple(b) for b in readers.parallel_blocks(df, left="left").first()["blocks"]] == [("a", 1), ("b", 3)]
    marks = spark.createDataFrame([("p", 1, 1, 2, 3, 4), ("p", 1, None, None, None, None), ("p", 2, 1, None, 3, 4)], "path string, page_id int, mark_x int, mark_y int, mark_width int, mark_height int")
    assert {r["page_id"]: (len(r["marks"]), r["partial_mark"]) for r in readers.marks_by_page(marks).collect()} == {1: (1, False), 2: (0, True)}


def test_writers(spark, tmp_path):
    df = spark.sql("SELECT 2 AS b, named_struct('z', 1, 'a', array(named_struct('y', CAST(NULL AS INT), 'x', 'é'))) AS a")
    assert df.select(writers.canonical_json(df)).first()[0] == '{"a":{"a":[{"x":"é","y":null}],"z":1},"b":2}'
    writers.write_json_lines(df, str(tmp_path / "out"), ["b"])
    with pytest.raises(Exception, match="exist"):
        writers.write_json_lines(df, str(tmp_path / "out"))
    shown = df.select(writers.markdown(F.lit("T"), [("A", F.array(F.lit("x"), F.lit("y"))), ("B", F.array().cast("array<string>"))]), writers.masked_secrets(F.lit("a key keykey"), ["key", "keykey", ""])).first()
    assert shown[0] == "# T\n\n## A\n\n- x\n- y" and shown[1] == "a *** ***"
    rows = spark.createDataFrame([(1, "g", "x"), (2, "g", "y")], "i int, g string, v string")
    assert writers.fingerprint(rows, ["i"], ["g"]).collect() == writers.fingerprint(rows.orderBy(F.desc("i")), ["i"], ["g"]).collect()


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:10:00', 'a' UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'b'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = landing.landed(spark, str(tmp_path / "in"), rows.schema)
    for _ in range(2):  # a second run finds nothing new
        landing.append_batches(landing.once_each(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    landing.append_batches(landing.tumbling_counts(stream, "ts", ["k"]), str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination()
    assert [(r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [("a", 2)]

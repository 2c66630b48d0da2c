import json

import pytest
from pyspark.sql import types as T

from quire.operators import backends
from quire.sources import readers, sinks
from quire.streaming import resume

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": oops}\n{"id": "c"}\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(path), SCHEMA).collect()
    assert {r.id for r in readers.jsonl(spark, str(path), SCHEMA, "lenient").collect()} == {"a", "c"}
    good, bad = readers.jsonl_issues(spark, str(path), SCHEMA)
    assert {r.id for r in good.collect()} == {"a", "c"} and ["oops" in r.line for r in bad.collect()] == [True]


def test_json_map(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"k1": "v1", "k2": "v2"}))
    (tmp_path / "bad.json").write_text("{no")
    assert {(r.key, r.value) for r in readers.json_map(spark, str(tmp_path), T.StringType()).collect()} == {("k1", "v1"), ("k2", "v2")}


MD = """# Glossary

## Term Table
| Source Term | Target Term | POS | Decision | Notes |
| --- | :-: | --- | --- | --- |
| alpha | альфа | noun | locked | a |
| beta |  | noun | | |
| short | row |
## Notes
- first
not a bullet
- second
## Notes
- last
"""


def test_markdown(spark):
    docs = spark.createDataFrame([("g", MD), ("e", None)], "doc string, text string")
    good, issues = readers.glossary_table(docs)
    assert [(r.source_term, r.target_term, r.decision) for r in good.collect()] == [("alpha", "альфа", "locked")]
    assert {(r.line, r.issue) for r in issues.collect()} == {(7, "empty source or target term"), (8, "expected 5 or more columns")}
    assert {r.heading: r.body for r in readers.markdown_sections(docs).collect()}["notes"] == "- last"
    assert [r.bullet for r in readers.bullets(docs).orderBy("no").collect()] == ["first", "second", "last"]
    assert {(r.doc, r.heading) for r in readers.missing_headings(docs, ["Term Table", "Rules"]).collect()} >= {("g", "rules")}


def test_scanner_lines(spark):
    rows = [("p", 1, 1, 0, 0, 0, 0, 0, 0, 1000, 2000, -1.0, None), ("p", 5, 1, 1, 1, 1, 2, 200, 100, 50, 20, 90.0, "two"), ("p", 5, 1, 1, 1, 1, 1, 100, 100, 50, 20, 70.0, "one"), ("p", 5, 1, 1, 1, 2, 1, 100, 50, 50, 20, 30.0, "top"), ("p", 5, 1, 1, 1, 3, 1, 1, 1, 1, 1, 30.0, " ")]
    got = readers.scanner_lines(spark.createDataFrame(rows, readers.TSV)).orderBy("place").collect()
    assert [(r.text, r.low) for r in got] == [("top", True), ("one two", False)]
    assert got[1].x0 == 59.5 and got[1].confidence == 0.8


def test_pdf_candidates(spark, tmp_path):
    (tmp_path / "My Book.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "fake.pdf").write_bytes(b"nope")
    got = {r.path.rsplit("/", 1)[-1].replace("%20", " "): r for r in readers.pdf_candidates(spark, str(tmp_path)).collect()}
    assert got["My Book.pdf"].valid and not got["fake.pdf"].valid and got["fake.pdf"].book_id.startswith("fake-")


def test_output_states(spark):
    rows = [(1, None), (2, " "), (3, '{"a": 1, "b": "x'), (4, "{]}"), (5, '{"a": 1}'), (6, '{"a": 1, "b": 2}')]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.s for r in df.select("id", readers.output_state(df.t, ["a", "b"]).alias("s")).collect()}
    assert got == {1: "missing_output", 2: "empty_output", 3: "truncated_output", 4: "invalid_json", 5: "missing keys: b", 6: None}


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["s", "l"], "additionalProperties": False, "properties": {"s": {"type": "string", "minLength": 2}, "l": {"type": "array", "items": {"type": "integer", "minimum": 1}}, "k": {"enum": ["a"]}, "v": {"const": 1}}}
    rows = [("1", '{"s": "ok", "l": [1, 2]}'), ("2", '{"s": "x", "l": [0, "a"], "k": "b", "v": 2, "z": 1}'), ("3", "no"), ("4", None), ("5", '{"s": 1}')]
    got = {}
    for r in readers.schema_errors(spark.createDataFrame(rows, "id string, json string"), schema).collect():
        got.setdefault(r.id, set()).add(r.error.split(":")[0])
    assert "1" not in got and got["2"] == {"$.s", "$.l[0]", "$.l[1]", "$.k", "$.v", "$.z"} and got["3"] == got["4"] == {"$"} and got["5"] == {"$.l", "$.s"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 2), ("y", 5)], "rule string, n int")
    sinks.write(df, str(tmp_path / "t"), "json")
    sinks.write(df, str(tmp_path / "t"), "json", append=True)
    assert spark.read.json(str(tmp_path / "t")).count() == 4
    assert sinks.report("R", df, ["rule"]).head().report == "# R\n\nTotal: 7\n\n- y: 5\n- x: 2"
    sinks.json_object(df, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text())["rule"] == "x"
    sinks.job_folders(spark.createDataFrame([("j1", "{}", "hi")], "job_id string, input string, prompt string"), str(tmp_path / "jobs"))
    assert (tmp_path / "jobs/j1/prompt.md").read_text() == "hi"


def test_backends(spark):
    jobs = spark.createDataFrame([("j1", "hello"), ("j2", "")], "job_id string, prompt string")
    got = {r.job_id: (r.answer, r.ok) for r in backends.run(jobs, lambda: backends.CommandBackend(lambda _: ["cat"], 10)).collect()}
    assert got == {"j1": ("hello", True), "j2": ("", False)}
    failed = backends.run(jobs, lambda: backends.CommandBackend(lambda _: ["/no/such/command"], 1, 2)).collect()
    assert not any(r.ok for r in failed)


def test_collect_takes_new_files_once(spark, tmp_path):
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("text", T.StringType())])
    landing, table, state = tmp_path / "in", str(tmp_path / "done"), str(tmp_path / "state")
    landing.mkdir()
    for n in (1, 2):
        (landing / f"{n}.json").write_text(f'{{"job_id": "j{n}", "text": "t"}}\n{{"job_id": "e{n}", "text": " "}}\n')
        resume.collect(spark, str(landing), schema, table, state).awaitTermination()
        assert spark.read.parquet(table).count() == n

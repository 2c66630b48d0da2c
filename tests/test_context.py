import pytest

from quire.operators import context
from quire.sources import pdf


def test_chapter_notes(spark):
    notes = spark.createDataFrame([("n", "# N\n\n## Global Notes\nKeep calm.\n\n\n\n## chapter-02 start\nShort.\n## Chapter-02 again\nNo."), ("m", "plain text"), ("e", None)], "doc string, text string")
    texts = spark.createDataFrame([("1", "n", "chapter-02"), ("2", "n", None), ("3", "m", "chapter-02"), ("4", "e", "x")], "id string, doc string, chapter_id string")
    got = {r.id: r.notes for r in context.chapter_notes(texts, notes).collect()}
    assert got == {"1": "Keep calm.\n\nShort.", "2": "Keep calm.", "3": "plain text", "4": ""}
    assert {r.id: r.notes for r in context.chapter_notes(texts, notes, 6).collect()}["2"] == "Keep c"


def test_package(spark):
    texts = spark.createDataFrame([("1", "The Engine of NATO and John Smith has engines.", None), ("2", None, None)], "id string, text string, chapter_id string")
    glossary = spark.createDataFrame([("engine", "мотор", None), ("enginer", "инженер", None)], "source_term string, target_term string, decision string")
    tm = spark.createDataFrame([("e", "the engine of nato and john smith has engines.", "Да", None)], "entry_id string, source_text string, target_text string, chapter_id string")
    got = {r.id: r for r in context.package(texts, glossary, tm).collect()}
    assert (got["1"].terms, got["1"].fuzzy, got["1"].names, got["1"].entry_id) == ("engine", "enginer", "NATO;The Engine;John Smith", "e")
    assert got["2"].weight == 0


def test_package_has_near_entries_decisions_rules_and_notes(spark):
    long = "the quick brown fox jumps over the lazy dog near the old copper harbour"
    texts = spark.createDataFrame([("1", long, "c")], "id string, text string, chapter_id string")
    glossary = spark.createDataFrame([], "source_term string, target_term string, decision string")
    tm = spark.createDataFrame([("n", long + "s", "Да", "x", "draft"), ("d", "copper harbour", "Нет", "c", "approved")], "entry_id string, source_text string, target_text string, chapter_id string, quality string")
    rules = spark.createDataFrame([(1, "Keep the harbour")], "ord int, rule string")
    r = context.package(texts, glossary, tm, rules=rules, notes=spark.createDataFrame([("1", "Calm.")], "id string, notes string")).head()
    assert (r.entry_id, r.similar, r.decisions, r.rules, r.notes) == ("n", "n", "d", "Keep the harbour", "Calm.")
    assert r.weight == len(r.names) + len(long) + 1 + 2 + 14 + 3 + 16 + 5


def test_payload_flags(spark):
    rows = [("1", '{"issues": [{"severity": "HIGH", "message": "m", "issue_id": "i"}, null, {"severity": "odd"}], "qa_passed": false}'), ("2", '{"qa_passed": false}'), ("3", '{"qa_passed": true}'), ("4", "no json"), ("5", None)]
    got = sorted((r.id, r.rule_id, r.severity) for r in context.payload_flags(spark.createDataFrame(rows, "id string, json string")).collect())
    assert got == [("1", "i", "high"), ("1", "semantic_issue", "medium"), ("2", "semantic_failed", "medium"), ("4", "semantic_failed", "medium"), ("5", "semantic_failed", "medium")]


def test_markers(spark):
    df = spark.createDataFrame([([(" 1", None), (None, "x"), ("1", "y"), (None, None)],)], "refs array<struct<marker:string,id:string>>")
    assert df.select(context.markers().alias("m")).head().m == ["1", "x"]


def test_lines_from_spans(spark):
    rows = [("f", 1, 500.0, 800.0, 0, "world", 60.0, 700.0, 10.0, "A"), ("f", 1, 500.0, 800.0, 1, "Hello", 10.0, 702.0, 12.0, "B"), ("f", 1, 500.0, 800.0, 2, "below", 10.0, 690.0, 0.0, "A"), ("f", 2, 500.0, 800.0, 0, "x", 499.0, 799.0, 10.0, "A")]
    got = pdf.lines(spark.createDataFrame(rows, pdf.SPANS)).orderBy("page_num", "place").collect()
    assert [(r.text, r.max_font) for r in got] == [("Hello world", 12.0), ("below", 0.0), ("x", 10.0)]
    assert got[0].x0 == 10.0 and got[0].fonts == ["A", "B"] and got[2].x1 == 500.0


def test_scanner_names_missing_tools(spark, tmp_path):
    import shutil

    if shutil.which("tesseract"):
        pytest.skip("installed")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    with pytest.raises(Exception, match="not installed"):
        pdf.scanned_words(spark, str(tmp_path)).collect()


def test_image_suffix(spark):
    df = spark.createDataFrame([("a.PNG", None), ("x", ["DCTDecode"]), ("x", ["JPXDecode"]), ("x", ["FlateDecode"]), ("x", None)], "n string, f array<string>")
    assert [r.s for r in df.select(pdf.image_suffix(df.n, df.f).alias("s")).collect()] == [".png", ".jpg", ".jp2", ".png", ".bin"]

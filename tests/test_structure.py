from pyspark.sql import functions as F

from quire.operators import structure
from quire.operators.ordered import neighbours, running

BLOCK = "doc_id string, block_id string, page_num int, reading_order int, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, style_metadata struct<avg_font_size:double,max_font_size:double>, flags array<string>, section_id string, prev_block_id string, next_block_id string, extra string"


def block(i, page, kind, text, **k):
    return ("d", f"b{i}", page, i, kind, text, k.get("bbox"), k.get("style"), k.get("flags"), k.get("section"), k.get("prev"), k.get("next"), "x")


def make(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def test_neighbours_and_running_over_pages(spark):
    rows = [("a", p, i, f"{p}{i}") for p in (1, 3, 4) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, page int, o int, v string")
    out = neighbours(df, "g", "page", ["o"], "v", "b", "n").orderBy("page", "o").collect()
    order = [r.v for r in out]
    assert [r.b for r in out] == [None, *order[:-1]] and [r.n for r in out] == [*order[1:], None]
    assert [r.s for r in running(df, "g", "page", ["o"], F.lit(1), "s").orderBy("page", "o").collect()] == list(range(1, 10))


def test_footnotes_use_every_body_once(spark):
    rows = [
        block(1, 1, "paragraph", "one [1] two [2]"), block(2, 1, "footnote_body", "1 first"), block(3, 2, "footnote_body", "1. again"),
        block(4, 2, "paragraph", "more [1] and [9]"), block(5, 2, "footnote_body", "[7] other"), block(6, 3, "paragraph", None),
    ]
    got = {(r.marker_block_id, r.marker): (r.body_block_id, r.confidence) for r in structure.footnote_links(make(spark, rows)).collect()}
    assert got[("b1", "1")] == ("b2", 0.92)
    assert got[("b4", "1")] == ("b3", 0.92)
    assert got[("b1", "2")] == (None, 0.2)
    assert got[("b4", "9")] == ("b5", 0.55)
    assert len(got) == 4


def test_note_pairs_equal_plain_search():
    import random

    import numpy as np

    for seed in range(60):
        rng = random.Random(seed)
        bodies = sorted((rng.randrange(6), rng.choice("1239")) for _ in range(rng.randrange(9)))
        marks = sorted((rng.randrange(6), rng.choice("1234")) for _ in range(rng.randrange(12)))
        free, want = set(range(len(bodies))), []
        for page, key in marks:
            own = sorted((abs(bodies[i][0] - page), bodies[i][0], i) for i in free if bodies[i][1] == key) or sorted((9, 9, i) for i in free if bodies[i][0] == page)
            want.append(own[0][2] if own else -1)
            free.discard(want[-1])
        column = lambda rows, k, t: np.array([r[k] for r in rows], t)
        got, _ = structure._note_pairs(column(marks, 0, int), column(marks, 1, object), column(bodies, 0, int), column(bodies, 1, object))
        assert got.tolist() == want


def test_sections_without_headings_or_content(spark):
    one = structure.sections(make(spark, [block(1, 2, "paragraph", "a"), block(2, 5, "paragraph", "b")])).collect()
    assert [(r.section_id, r.title, r.start_page, r.end_page, r.confidence) for r in one] == [("sec-0001", "Document", 2, 5, 0.45)]
    none = structure.sections(make(spark, [block(1, 3, "header", "a")])).collect()
    assert [(r.start_page, r.n_blocks, r.confidence) for r in none] == [(1, 1, 0.3)]
    assert structure.sections(make(spark, [])).count() == 0


def test_graph_errors(spark):
    rows = [block(1, 1, "paragraph", "a", section="s", next="b2"), block(2, 1, "paragraph", "b", section="s", prev="b9"), block(2, 1, "paragraph", "b", section="s", prev="b9"), block(3, 1, "paragraph", "c")]
    got = {(r.block_id, r.error) for r in structure.graph_errors(make(spark, rows)).collect()}
    assert got == {("b2", "doubled_id"), ("b2", "dangling_prev"), ("b1", "asymmetric_next"), ("b3", "missing_section")}


def test_furniture_needs_two_pages_and_a_share(spark):
    box = lambda y: (10.0, y, 100.0, y + 10)
    rows = [block(p * 10 + i, p, "paragraph", t, bbox=box(y)) for p in (1, 2, 3) for i, (t, y) in enumerate([("Book Title", 700.0), (f"body {p} words {'x' * p}", 400.0), (f"Page {p}", 20.0)])]
    got = {(r.block_id, r.kind) for r in structure.furniture(make(spark, rows)).collect()}
    assert got == {(f"b{p}0", "header") for p in (10, 20, 30) for p in (p // 10,)} | {(f"b{p}2", "footer") for p in (1, 2, 3)}

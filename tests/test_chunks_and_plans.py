import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, complexity, memory, planning, quality
from tests.test_structure import block, make


def test_packing_keeps_order_and_limits(spark):
    rows = [block(i, 1 + i // 3, "paragraph" if i % 7 else "heading", "x" * (100 + 37 * i % 500), section="s") for i in range(1, 40)]
    df = make(spark, rows)
    out = chunking.pack(df, 600, 3).orderBy("page_num", "reading_order").collect()
    assert [r.chunk_no for r in out] == sorted(r.chunk_no for r in out)
    sizes = {r[0]: len(r[5]) for r in [(x[1], 0, 0, 0, 0, x[5]) for x in rows]}
    groups: dict[int, list] = {}
    for r in out:
        groups.setdefault(r.chunk_no, []).append(r)
    for g in groups.values():
        assert len(g) <= 3 and (len(g) == 1 or sum(sizes[r.block_id] for r in g) + len(g) - 1 <= 600)
        assert len({r.block_type for r in g}) == 1
    assert sorted(r.block_id for r in out) == sorted(x[1] for x in rows)


def test_tiers(spark):
    rows = [("A short plain sentence.", "paragraph_group", 0), ("- a = 1\n- b = 2 [1]\n- c = 3 | d\n1) 2 + 2 = 4", "auxiliary", 3)]
    out = complexity.assess(spark.createDataFrame(rows, "source_text string, chunk_type string, n_refs int")).orderBy("score").collect()
    assert out[0].tier == "A" and out[1].tier in "BC" and "footnote_markers" in out[1].risks


def test_prefilter_order(spark):
    texts = spark.createDataFrame([("1", 1, " ", None), ("2", 2, "12/2025", None), ("3", 3, "Exact reusable  sentence.", "c"), ("4", 4, "exact reusable sentence.", None), ("5", 5, "Something new", None), ("6", 6, None, None)], "id string, ord int, text string, chapter_id string")
    tm = spark.createDataFrame([("e1", "Exact reusable sentence.", "A", "x"), ("e2", "exact reusable sentence.", "B", "c"), ("e3", "Something new", " ", None), ("e4", None, "C", None)], "entry_id string, source_text string, target_text string, chapter_id string")
    got = {r.id: (r.action, r.reason, r.target) for r in planning.prefilter(texts, tm).collect()}
    assert got["1"][:2] == got["6"][:2] == ("skip", "empty_source")
    assert got["2"] == ("skip", "non_translatable_fragment", "12/2025")
    assert got["3"] == ("reuse", "translation_memory_exact", "B")
    assert got["4"] == ("reuse", "repeated_approved_translation", "B")
    assert got["5"][0] == "model"


def test_prefilter_reuses_near_entries(spark):
    long = "the quick brown fox jumps over the lazy dog near the old copper harbour of the northern town"
    rows = [("1", 1, long, "c", 0.95), ("2", 2, long, None, None), ("3", 3, long + " in the evening", None, 0.95), ("4", 4, long.replace("quick", "slow"), None, 0.95), ("5", 5, long.replace("town", "towns"), None, None)]
    texts = spark.createDataFrame(rows, "id string, ord int, text string, chapter_id string, near double")
    tm = spark.createDataFrame([("e1", long + ".", "A", "c"), ("e0", long + "!", " ", "c"), ("e2", long.replace("old", "very old"), "B", "x")], "entry_id string, source_text string, target_text string, chapter_id string")
    got = {r.id: (r.action, r.reason, r.target) for r in planning.prefilter(texts, tm).collect()}
    assert got["1"] == ("reuse", "translation_memory_near", "A")
    assert got["2"] == ("reuse", "repeated_approved_translation", "A")
    assert got["3"][0] == got["4"][0] == got["5"][0] == "model"


def test_batches(spark):
    jobs = spark.createDataFrame([("b", str(i), c) for i, c in enumerate(["01", "01", "01", "02", None, None])], "book_id string, id string, chapter_id string")
    got = planning.batches(jobs, 2).orderBy("id").collect()
    assert [r.batch_id for r in got] == ["batch-0001-01", "batch-0001-01", "batch-0002-01", "batch-0003-02", "batch-0004-range", "batch-0004-range"]


def test_pair_rules(spark):
    rows = [("c1", "On 2024-05-01 see https://a.org/x and y = 4 [1] of 17", "На дату"), ("c2", "Plain", ""), ("c3", "Plain", None), ("c4", "See 17 [2]", "См. 17 [2]")]
    got = {(r.id, r.rule_id) for r in quality.pair_flags(spark.createDataFrame(rows, "id string, source_text string, target_text string")).collect()}
    assert {("c2", "empty_translation"), ("c3", "missing_translation")} <= got
    assert {r for i, r in got if i == "c1"} == {"footnote_marker_missing", "footnote_count_mismatch", "number_missing", "link_missing", "date_missing", "formula_content_missing"}
    assert not [r for i, r in got if i == "c4"]


def test_similar_entries_equal_brute_force(spark):
    from quire.functions.similarity import normalized, ratio

    base = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumped over the lazy dog", "a quite different text about rivers", "", None, "The  quick brown fox jumps over the lazy dog"]
    tm = spark.createDataFrame([(f"e{i}", t, None) for i, t in enumerate(base)], "entry_id string, source_text string, chapter_id string")
    queries = spark.createDataFrame([("q", base[0], None)], "id string, text string, chapter_id string")
    got = {r.entry_id: (round(r.similarity, 9), r.exact) for r in memory.similar_entries(queries, tm, near=0.9, k=9).collect()}
    want = {f"e{i}": round(ratio(normalized(base[0]), normalized(t)), 9) for i, t in enumerate(base) if ratio(normalized(base[0]), normalized(t)) >= 0.9}
    assert {k: v for k, (v, _) in got.items()} == want and got["e5"][1] and not got["e1"][1]


def test_chapter_terms_near_and_without_chapter(spark):
    long = "the quick brown fox jumps over the lazy dog near the old copper harbour"
    tm = spark.createDataFrame([("e1", "Copper harbour", "c", "approved"), ("e2", long.replace("jumps", "jumped"), "c", "locked"), ("e3", long.replace("jumps", "jumped"), "x", "locked"), ("e4", long, "c", "draft"), ("e5", "nothing of it", "c", "approved")], "entry_id string, source_text string, chapter_id string, quality string")
    texts = spark.createDataFrame([("1", long, "c"), ("2", long, None), ("3", long, "y"), ("4", None, None)], "id string, text string, chapter_id string")
    assert {(r.id, r.entry_id, r.place) for r in memory.chapter_terms(texts, tm).collect()} == {("1", "e1", 1), ("1", "e2", 2), ("2", "e1", 1), ("2", "e2", 2), ("2", "e3", 3)}


def test_chapter_terms_take_every_unit(spark, tmp_path):
    from quire.plans import catalog

    spark.sql("select named_struct('job_id', 'j', 'book_id', 'b', 'template_id', 't', 'source_language', 'en', 'target_language', 'ru') job, named_struct('chapter_id', 'c', 'chunk_id', 'k', 'source_text', 'A copper harbour.', 'block_ids', array('x')) payload, 'lean' profile_name, timestamp'2024-01-01' loaded_at").write.parquet(str(tmp_path / "job_inputs.parquet"))
    spark.sql("select 'e' entry_id, 'segment' unit, 'copper harbour' source_text, 'y' target_text, 'c' chapter_id, 'approved' quality, timestamp'2024-01-01' loaded_at").write.parquet(str(tmp_path / "translation_memory.parquet"))
    assert [r.entry_id for r in catalog.j08_chapter_terms(spark, str(tmp_path)).collect()] == ["e"]


def test_near_pairs_equal_brute_force(spark):
    import random

    from quire.functions.similarity import ratio

    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(n)).strip() for n in (1, 2, 5, 9, 30, 60, 90, 120, 220)]
    texts = [*base, *["".join(c for c in t if rng.random() > p) + "x" * rng.randrange(4) for t in base for p in (0.02, 0.05, 0.1, 0.15)]]
    texts = [t.strip() for t in texts if t.strip() and "  " not in t]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "i string, t string")
    for least in (0.86, 0.95):
        got = {(r.id, r.entry_id) for r in memory.near_pairs(df.selectExpr("i id", "t text", "0 k"), df.selectExpr("i entry_id", "t source_text", "0 k"), least, chunk=7).collect()}
        assert got == {(str(i), str(j)) for i, a in enumerate(texts) for j, b in enumerate(texts) if ratio(a, b) >= least}


def test_containment_ways_agree(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["the arctic heart", "smart parts", "a b", ""])], "id int, t string")
    terms = spark.createDataFrame([("art",), ("heart",), ("smart part",), ("b",), ("none of it",)], "key string")
    small = {(r.id, r.key) for r in memory.containment(texts, "t", terms, "key").collect()}
    large = {(r.id, r.key) for r in memory.containment(texts, "t", terms, "key", matched_terms=2).collect()}
    assert small == large == {(0, "heart"), (1, "art"), (1, "smart part"), (2, "b"), (0, "art")}


def test_fuzzy_terms(spark):
    texts = spark.createDataFrame([("1", "The proof of theorem is concise.")], "id string, text string")
    glossary = spark.createDataFrame([("theorem", "т", None), ("proofs", "д", None), ("axiom", "а", None), (None, "б", None)], "source_term string, target_term string, decision string")
    assert {r.term for r in memory.exact_terms(texts, glossary).collect()} == {"theorem"}
    assert {r.term for r in memory.fuzzy_terms(texts, glossary).collect()} == {"proofs"}


def test_merge_takes_pairs_from_the_left(spark):
    rows = [("d", i, f"k{i}", "c", "paragraph_group", 0.1, 10, 1, 0) for i in range(1, 6)] + [("d", 6, "k6", "c", "heading", 0.1, 10, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_no int, chunk_id string, chapter_id string, chunk_type string, score double, n_chars int, n_blocks int, n_refs int")
    assert {(r.chunk_id, r.with_id) for r in chunking.merge_pairs(df).collect()} == {("k1", "k2"), ("k3", "k4")}


def test_stable_expressions(spark):
    pairs = spark.createDataFrame([("1", "Alpha  beta", "a"), ("2", "alpha beta", "b"), ("3", "gamma", "c"), ("4", "gamma", "C "), ("5", None, "x")], "id string, source_text string, target_text string")
    assert [(r.source, r.n_targets) for r in quality.stable_expressions(pairs).collect()] == [("alpha beta", 2)]
    assert quality.flag_counts(quality.pair_flags(pairs.where(F.lit(False)))).count() == 0


def test_repeated_texts_on_one_key(spark):
    # A third of all rows and of the memory have one text.
    rows = [(f"{i:03d}", f"{i:03d}", "same text" if i % 3 == 0 else f"text {i}", "c" if i % 2 else None) for i in range(90)]
    tm = [(f"e{i:03d}", "Same  text" if i % 3 == 0 else f"other {i}", f"t{i}", [None, "c", "d"][i % 9 // 3]) for i in range(90)]
    texts = spark.createDataFrame(rows, "id string, ord string, text string, chapter_id string")
    entries = spark.createDataFrame(tm, "entry_id string, source_text string, target_text string, chapter_id string")
    got = {r.id: r.entry_id for r in memory.exact_matches(texts, entries).collect()}
    assert got == {r[0]: "e003" if r[3] else "e000" for r in rows if r[2] == "same text"}
    plan = {r.id: (r.reason, r.target) for r in planning.prefilter(texts, entries).collect()}
    assert plan["000"] == ("translation_memory_exact", "t0") and {plan[r[0]] for r in rows[1:] if r[2] == "same text"} == {("repeated_approved_translation", "t0")}


def test_plan_and_savings(spark):
    filtered = spark.createDataFrame([("1", "model", "requires_model_translation", None), ("2", "reuse", "translation_memory_exact", "t"), ("3", "skip", "empty_source", None), ("4", "model", "requires_model_translation", None)], "id string, action string, reason string, target string")
    rated = planning.checks(spark.createDataFrame([("1", "B", "footnote_markers"), ("2", "C", ""), ("3", "A", ""), ("4", "A", "")], "id string, tier string, risks string"), decided=spark.createDataFrame([("1",), ("1",)], "id string"))
    cache = spark.createDataFrame([("4", "known"), ("1", " ")], "id string, output string")
    plan = planning.plan(filtered, rated, cache, spark.createDataFrame([("1", 7), ("4", 8)], "id string, weight int"))
    got = {r.id: tuple(r)[1:] for r in plan.collect()}
    assert got["1"] == ("model", "requires_model_translation", None, "B", 7, True, True) and got["4"] == ("reuse", "job_cache_hit", "known", "A", 8, False, False)
    assert got["2"][-2:] == (False, False) and got["3"][0] == "skip"
    row = planning.savings(plan).head()
    assert (row.n, row.n_model, row.n_cached, row.n_memory, row.weight, row.retries_avoided, row.saved_percent) == (4, 1, 1, 1, 7.5, 1, 75.0)
    assert planning.savings(plan.where(F.lit(False))).head().saved_percent == 0.0


def test_selection_and_tasks(spark):
    rows = [("b", f"batch-000{i}-x", s) for i, s in enumerate(["completed", "failed", "pending", "running", "failed"])]
    df = spark.createDataFrame(rows, "book_id string, batch_id string, status string")
    ids = lambda **k: [r.batch_id[9] for r in planning.selected(df, **k).orderBy("batch_id").collect()]
    assert ids(first="batch-0001", last="batch-0003") == ["1", "2", "3"] and ids(only_failed=True, resume=True) == ["1", "4"] and ids(resume=True) == ["1", "2", "3", "4"]
    with pytest.raises(Exception, match="no batch"):
        ids(first="batch-0009")
    batched = spark.createDataFrame([("b", "x", "1"), ("b", "x", "2")], "book_id string, batch_id string, id string")
    got = {r.id: (r.status, r.error) for r in planning.tasks(batched, spark.createDataFrame([("1", "model")], "id string, action string")).collect()}
    assert got == {"1": ("pending", None), "2": ("failed", "no plan for 2")}


def test_adapted_chunks_keep_all_blocks(spark):
    text = "Word [1] 12 + 3 = 15 | x\n- a\n- b\n" * 30
    blocks = spark.createDataFrame([("d", f"b{i}", text if i < 6 else "short words") for i in range(10)], "doc_id string, block_id string, text string")
    rows = [("d", 1, "k1", "c", "paragraph_group", [f"b{i}" for i in range(6)], "\n".join([text] * 6), 0.9)] + [("d", i, f"k{i}", "c", "paragraph_group", [f"b{i + 4}"], "short words", 0.1) for i in range(2, 6)]
    out = chunking.adapted(spark.createDataFrame(rows, "doc_id string, chunk_no int, chunk_id string, chapter_id string, chunk_type string, block_ids array<string>, source_text string, score double"), blocks).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.source_ids) for r in out] == [("k1-s1", ["k1"]), ("k1-s2", ["k1"]), ("k2+k3", ["k2", "k3"]), ("k4+k5", ["k4", "k5"])]
    assert [b for r in out for b in r.block_ids] == [f"b{i}" for i in range(10)] and out[2].source_text == "short words\nshort words"


def test_contained_terms_meet_by_anchors(spark):
    """Entries of every length against brute force, and no join of a chapter's texts with all of its entries."""
    import random
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh éж😀") for _ in range(n)).strip() for n in (1, 9, 60, 300, 300, 700, 700, 1500)]
    cuts = [(t, i, n) for t in texts for n in (1, 2, 15, 16, 17, 46, 47, 48, 126, 127, 128, 400) if n <= len(t) for i in (0, len(t) - n, rng.randrange(len(t) - n + 1))]
    said = [*(t[i : i + n] for t, i, n in cuts), *("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 20, 150))]
    jobs = [(str(i), t, c) for i, (t, c) in enumerate((t, c) for t in texts for c in ("c", "x", None))]
    tm = [(f"e{i}", s, "cx"[i % 2], "locked") for i, s in enumerate(said)]
    df = memory.contained_terms(spark.createDataFrame(jobs, "id string, text string, chapter_id string"), spark.createDataFrame(tm, "entry_id string, source_text string, chapter_id string, quality string"), None)
    plain = lambda t: re.sub(r"\s+", " ", t.strip())
    want = {(i, e) for i, t, c in jobs for e, s, o, _ in tm if c in (None, o) and plain(s) and plain(s) in plain(t)}
    assert len(want) > 200 and {(r.id, r.entry_id) for r in df.collect()} == want
    joins = re.findall(r"Join Inner, (.*)", df._jdf.queryExecution().optimizedPlan().toString())
    assert joins and all(re.search(r"\ba#|i#|e#", j) for j in joins)


def test_near_chunks_equal_brute_force():
    """Long and short right texts of one vocabulary, edited in many places and in blocks; bounds of block numbers lose nothing."""
    import random

    from quire.functions import similarity as S

    rng = random.Random(11)
    words = ["red", "mine", "flexible", "compass", "the", "of", "inspector", "counted", "weighs", "kg", "цена", "9", "q"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 20, 31, 32, 33, 34, 40, 60, 150)]
    texts = [*base, *("".join("" if rng.random() < p else c + "y" * (rng.random() < p) for c in t) for t in base for p in (0.01, 0.03, 0.06, 0.1))]
    for least in (0.86, 0.95):
        got = [(a, b) for a, b, _ in S.Chunk(texts, least).near(texts)]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if S.ratio(a, b) >= least}

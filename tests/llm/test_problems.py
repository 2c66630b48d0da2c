"""Every operator against brute force on small inputs, and its stated results at the edges."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, leakage, mixing, near, pairs, scans, skeleton, spans, splitting, truncation
from quire.llm.text import WORD, words
from tests.test_oracles import plain

WORDS = "amber basin cable delta ember flint grove haven inlet jetty kiosk ledge manor north ochre plume quill ridge slate tower umber vault wharf yacht zephyr".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# 1 near-duplicates


def bigrams(text):
    w = WORD.findall(text.lower())
    return set(zip(w, w[1:])) if len(w) >= 12 else None


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = prose(g, rng.choice([14, 30, 80])).split()
        for k in range(4):
            w = list(base)
            for _ in range(k * max(1, len(w) // 18)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            rows.append((f"r{g:02d}-{k}", " ".join(w)))
    return [*rows, ("copy", rows[0][1].upper() + "!"), ("short", "only a few words"), ("null", None), ("empty", ""), ("r00-0", rows[0][1]), (None, prose(1, 30)), ("long", prose(99, 30_000)), ("long2", prose(99, 30_000) + " end")]


def near_truth(records):
    sets = {r: bigrams(t) for r, t in records if r and t and bigrams(t)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_near_pairs_equal_brute_force(spark, records):
    df = spark.createDataFrame([(r, t, 1, "x") for r, t in records], "rec string, text string, a int, blob string")
    got = [(r.rec_a, r.rec_b) for r in near.near_pairs(df).collect()]
    want = near_truth(records)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.02 * len(want)
    assert ("long", "long2") in set(got) and ("copy", "r00-0") in set(got)


def test_hot_buckets_are_searched_in_cells(spark, records):
    df = spark.createDataFrame(records, "rec string, text string")
    assert set(near.near_pairs(df, hot=3).collect()) == set(near.near_pairs(df).collect())


def test_near_records_count_links(spark, records):
    df = spark.createDataFrame(records, "rec string, text string")
    links = near.near_pairs(df).collect()
    degree = {}
    for r in links:
        for x in r:
            degree[x] = degree.get(x, 0) + 1
    rows = near.near_records(df).collect()
    assert {r.rec: r.n_copies + r.n_links for r in rows if r.n_copies + r.n_links} == degree
    assert {r["class"] for r in rows if r.rec in ("copy", "r00-0")} == {"copy"}


def test_near_of_many_copies(spark):
    rows = [(f"c{i:03d}", prose(3, 20)) for i in range(90)]
    assert near.near_pairs(spark.createDataFrame(rows, "rec string, text string")).count() == 90 * 89 // 2
    assert near.near_pairs(spark.createDataFrame([], "rec string, text string")).count() == 0


# 2 scanned pages

OCR = "doc_id string, block_id string, page_num int, reading_order int, text string, confidence double, word string"


@pytest.fixture(scope="module")
def book():
    rng = random.Random(2)
    vocab = "the harbour lantern signal measures narrow furnace between winter and copper telescope quietly because northern engine carries double".split()
    clean = [" ".join(rng.choice(vocab) for _ in range(12)).capitalize() + "." for _ in range(300)]
    rows = []
    for p in range(1, 13):
        body = clean[p * 4 : p * 4 + 3]
        rows.append(("d", f"b{p}-0", p, 0, f"The copper harbour {p + 7}", 0.9))
        rows += [("d", f"b{p}-{i}", p, i, t, 0.8) for i, t in enumerate(body, 1)]
    return clean, rows


def test_scan_noise(spark, book):
    clean, rows = book
    rows = [list(r) for r in rows]
    rows[1][4] = "The har-\nbour measures the well-\nknown signal and the telesc-"
    rows[2][4] = "ope carries the we1l-known furnacc."
    rows[5][4] = "The rneasures of the signal in l794 and 17 engines."
    rows[9][4] = "78"
    rows[13][4] = None
    rows.append(["d", "n", 4, 9, "— 11 —", None])
    rows.append(list(rows[1]))
    rows.append([None, "z", 1, 1, "x-\ny", 0.1])
    ocr = spark.createDataFrame([(*r, "w") for r in rows], OCR)
    blocks = spark.createDataFrame([(t, None) for t in clean] + [("a well-known word " * 3, ["x"]), (None, None), ("se1ect", ["ocr"])], "text string, flags array<string>")
    got = {(r.block_id, r.noise) for r in scans.scan_noise(ocr, blocks).collect()}
    assert {("b1-1", "hyphenation"), ("b1-2", "misread"), ("b2-1", "misread"), ("n", "page_number")} <= got
    assert all((f"b{p}-0", k) in got for p in range(1, 13) for k in ("running_line", "page_number"))
    assert ("n", "running_line") not in got and not {x for x in got if x[0] in ("z",) or x[0].startswith("b3-") and x[0] != "b3-0"}
    only = [(b, n) for b, n in got if n == "hyphenation"]
    assert only == [("b1-1", "hyphenation")]


def test_paragraphs_are_readable(spark, book):
    clean, rows = book
    rows = [list(r) for r in rows]
    rows[1][4] = "The har-\nbour measures the furnacc between the telesc-"
    rows[2][4] = None
    rows[3][4] = None
    rows[5][4] = "ope and the rneasures signal."
    ocr = spark.createDataFrame([(*r, "w") for r in rows], OCR)
    blocks = spark.createDataFrame([(t, None) for t in clean] + [("narrow furnace", None)] * 5, "text string, flags array<string>")
    out = scans.paragraphs(ocr, blocks).orderBy("page_num", "paragraph_no").collect()
    assert out[0].text == "The harbour measures the furnace between the telescope and the measures signal."
    assert not [r for r in out if "copper harbour" in r.text and len(r.text) < 30]


def test_misread_words_that_clean_texts_have(spark):
    clean = ["the copper furnace glows"] * 30 + ["mister furnacc writes"]
    rows = [("d", "bad", 1, 1, "Then the copper Furnacc glows.", 0.9), ("d", "good", 1, 2, "Here mister Furnacc writes.", 0.9), ("d", "cut", 1, 3, "the valve and the copper furnacc glows, mister furnacc writes", 0.9)]
    ocr = spark.createDataFrame([(*r, "w") for r in rows], OCR)
    blocks = spark.createDataFrame([(t, None) for t in clean], "text string, flags array<string>")
    assert {(r.block_id, r.noise) for r in scans.scan_noise(ocr, blocks).collect()} == {("bad", "misread"), ("cut", "misread")}
    said = [r.text for r in scans.paragraphs(ocr, blocks).orderBy("paragraph_no").collect()]
    assert said == ["Then the copper Furnace glows.", "Here mister Furnacc writes.", "the valve and the copper furnace glows, mister furnacc writes"]


def test_paragraph_over_many_pages(spark):
    pages = ["Alpha ends here. Beta begins", "runs through one whole page and the har-", "bour then goes", "on to its end.", "Gamma is new and"]
    rows = [("d", f"b{i}", i, 1, t, 0.9, "w") for i, t in enumerate(pages, 1)] + [("d", "b4x", 4, 2, "Delta is open", 0.9, "w"), ("d", "b6", 6, 1, "goes on.", 0.9, "w"), ("d", "b8", 8, 1, "lone tail.", 0.9, "w")]
    empty = spark.createDataFrame([], "text string, flags array<string>")
    out = [(r.page_num, r.text) for r in scans.paragraphs(spark.createDataFrame(rows, OCR), empty).orderBy("page_num", "paragraph_no").collect()]
    assert out == [(1, "Alpha ends here. Beta begins runs through one whole page and the harbour then goes on to its end."), (4, "Delta is open"), (5, "Gamma is new and goes on."), (8, "lone tail.")]


def test_running_lines_of_any_length(spark, book):
    clean, _ = book
    long = "The complete and annotated history of the harbour of the northern lantern and of its narrow furnaces "
    rows = [("s", f"h{p}", p, 0, f"Notes {p + 4}", None, "w") for p in range(1, 31)] + [("s", f"t{p}", p, 1, clean[p], 0.5, "w") for p in range(1, 31)]
    rows += [("l", f"h{p}", p, 0, f"{long}{p}", 0.1, "w") for p in range(1, 31)] + [("l", f"t{p}", p, 1, clean[-p] if p != 7 else "It weighs\n7 kg", 7.0, "w") for p in range(1, 31)]
    blocks = spark.createDataFrame([(t, None) for t in clean], "text string, flags array<string>")
    got = {(r.doc_id, r.block_id, r.noise) for r in scans.scan_noise(spark.createDataFrame(rows, OCR), blocks).collect()}
    assert got == {(d, f"h{p}", n) for d in "sl" for p in range(1, 31) for n in ("running_line", "page_number")}
    said = " ".join(r.text for r in scans.paragraphs(spark.createDataFrame(rows, OCR), blocks).collect())
    assert "Notes" not in said and all(t in said for t in clean[1:31]) and "It weighs 7 kg" in said


def test_confidence_weighs_what_it_tells(spark):
    rows = [("d", f"b{i}", i, 0, "text", c, "w") for i, c in enumerate([0.95, 0.95, 0.2, None, 7.0] * 40)]
    sure = spark.createDataFrame([("d", f"b{i}") for i in range(200) if i % 5 == 2 or i % 25 == 0], "doc_id string, block_id string")
    weight = {r.level: r.weight for r in scans.confidence_odds(scans.pages(spark.createDataFrame(rows, OCR)), sure).collect()}
    assert set(weight) == {9, 2, -1} and weight[2] > 1 and weight[9] < 0


def test_scans_of_nothing(spark):
    blocks = spark.createDataFrame([], "text string, flags array<string>")
    empty = spark.createDataFrame([], OCR)
    assert scans.scan_noise(empty, blocks).count() == 0 and scans.paragraphs(empty, blocks).count() == 0


def test_distance_and_fold():
    assert scans.distance("irnproves", "improves") == pytest.approx(0.3)
    assert scans.distance("dosed", "closed") == pytest.approx(0.3)
    assert scans.distance("abcdef", "uvwxyz") >= 1
    assert scans.fold("c1oses") == scans.fold("closes") and scans.fold("тёrnпая") == scans.fold("тёмная")
    assert scans.number("xiv") == (14, False) and scans.number("l4") == (14, True) and scans.number("T10") == (None, False)


# 3 truncation


@pytest.mark.parametrize(
    ("source", "target", "cut"),
    [
        ("A full sentence stands here.", "Полное предложение стоит", True), ("A full sentence stands here.", "Полное предложение стоит здесь.", False), ("A heading", "Заголовок", False),
        ("It ends so…", "Так кончается…", False), ("It ends here.", "Так конч…", True), ("It ends here.", "Так конч ...", True), ("He said “no”.", "Он сказал «нет».", False), ("He said “no”.", "Он сказал «н", True),
        ("See it. [12]", "См. [12]", False), ("See it. (code 12)", "См. это. (код 12)", False), ("A list;", "Список", True), ("It ends.", "Так конч�", True), ("It ends.", None, False), ("It ends.", " ", False), (None, "Так", False),
        ("This is <b>grave</b> still", "Это <b>важно и ещё", True), ("This is <b>grave</b> still", "Это <b>важно</b> и ещё", False), ("A break<br> here", "Разрыв<br> тут", False), ('A "word" here', 'Вот "слово" тут', False), ('A "word" here', 'Вот "слово тут', True),
        ("It ends.", "Так кончается <span class=" + "x" * 200, True), ("It ends.", "Так. " + "[1]" * 200, False), ("It ends.", "Так.\\u04", True), ("It is 3 < 5.", "Вот 3 < 5.", False), ("It is &amp; so.", "Это &am", True),
    ],
)
def test_truncation(spark, source, target, cut):
    memory = spark.createDataFrame([("e", source, target, "s", 1)], "entry_id string, source_text string, target_text string, source string, low int")
    jobs = spark.createDataFrame([], "job struct<job_id:string,target_language:string>, payload struct<source_text:string>")
    outputs = spark.createDataFrame([], "job_id string, translated_text string, source string")
    assert truncation.truncated(memory, jobs, outputs).count() == int(cut)


def test_truncation_rates(spark):
    memory = spark.createDataFrame([("e1", "One.", "Один.", "a"), ("e2", "One.", "Оди", "a"), ("e2", "One.", "Оди", "a"), ("e3", "One.", None, "a"), (None, "One.", "Оди", "a")], "entry_id string, source_text string, target_text string, source string")
    jobs = spark.createDataFrame([(("j1", "ru"), ("Two.",)), (("j2", "ru"), ("Two.",))], "job struct<job_id:string,target_language:string>, payload struct<source_text:string>")
    outputs = spark.createDataFrame([("j1", "Два", "b"), ("j9", "Два", "b")], "job_id string, translated_text string, source string")
    got = {(r.origin, r.source): (r.n_records, r.n_truncated) for r in truncation.truncation_rates(memory, jobs, outputs).collect()}
    assert got == {("translation_memory", "a"): (2, 1), ("job_outputs", "b"): (1, 1)}


def test_open_marks_are_on_the_stack():
    opened = lambda text: truncation.state(text)[1]
    assert opened("Это <b>важно и ещё.") == 1 and opened("<p>a<br>b<img src='x'/><b>c</b></p>") == 0
    assert opened("<p>a <i>b</p>") == 0 and opened("</b> a [b (c") == 2 and opened('"a" "b') == 1 and opened("„a“ “b” «c») ]") == 0


def test_sources_without_final_stops(spark):
    rows = [(f"n{i}", "One is here.", "Один здесь" + "." * (i % 4 == 0), "bare") for i in range(40)] + [(f"s{i}", "One is here.", "Один здесь" + "." * (i > 1), "full") for i in range(40)]
    rows += [("cut", "A sentence of quite some length stands here, for the baseline of lengths.", "Предложение", "bare"), ("torn", "One is here.", "Один зд�", "bare")]
    rows += [(f"long{i}", "A sentence of quite some length stands here, for the baseline of lengths.", "Предложение изрядной длины стоит здесь ради длин и их меры.", "bare") for i in range(9)]
    memory = spark.createDataFrame(rows, "entry_id string, source_text string, target_text string, source string")
    jobs = spark.createDataFrame([], "job struct<job_id:string,target_language:string>, payload struct<source_text:string>")
    outputs = spark.createDataFrame([], "job_id string, translated_text string, source string")
    assert {r.rec for r in truncation.truncated(memory, jobs, outputs).collect()} == {"s0", "s1", "cut", "torn"}


# 4 splitting


@pytest.mark.parametrize("seed", range(12))
def test_pieces_fit_and_rebuild(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "longer-word ", "End. ", "\n\n", "x" * rng.randrange(1, 90), "é"]) for _ in range(rng.randrange(1, 300)))
    chars, blocks, overlap = rng.choice([40, 120, 700]), rng.choice([1, 3, None]), rng.choice([0, 10, 30])
    pieces = splitting.split(text, chars, blocks, overlap)
    assert "".join(text[a:b] for _, a, b, *_ in pieces) == text
    for k, (no, a, b, over, short, _, n, piece) in enumerate(pieces):
        assert no == k and piece == text[a - over : b] and len(piece) <= chars and (blocks is None or n <= blocks) and over + short == (overlap if k else 0)
        # Short only where the text begins, or where one more character of overlap leaves no room for new text.
        assert not short or over == a or blocks and splitting._blocks(splitting.Limits(text, None, None, 0).ends, a - over - 1, a + 1) > blocks


def test_stated_overlap_is_kept():
    text = " ".join(prose(4, 200).split())
    for chars, overlap in ((100, 80), (100, 99), (60, 1), (100, 0)):
        pieces = splitting.split(text, chars, None, overlap)
        assert {p[3] for p in pieces[1:] if p[1] >= overlap} == {overlap} and "".join(text[p[1] : p[2]] for p in pieces) == text
    assert {(p[3], p[4]) for p in splitting.split("x" * 50, 10, None, 25)[1:] if p[1] > 20} == {(9, 16)}


def test_split_edges(spark):
    schema = "job struct<job_id:string>, payload struct<source_text:string,block_ids:array<string>>, profile_name string, start int"
    rows = [
        (("exact",), ("x" * 50, ["a"]), "p", 1), (("chars",), ("x" * 51, ["a"]), "p", 1), (("blocks",), ("a\n\nb\n\nc", ["1", "2", "3"]), "p", 1), (("both",), ("a\n\n" * 30, ["1"] * 30), "p", 1), (("both",), ("a\n\n" * 30, ["1"] * 30), "p", 2),
        (("null",), (None, ["1", "2", "3"]), "p", 1), (("none",), ("x" * 99, None), "zz", 1), ((None,), ("x" * 99, None), "p", 1), (("noids",), ("x" * 99, None), "p", 1),
    ]
    profiles = spark.createDataFrame([("p", 50, 2, 5), ("q", None, None, None)], "name string, chunk_max_chars int, chunk_max_blocks int, overlap_chars int")
    jobs = spark.createDataFrame(rows, schema)
    assert {(r.job_id, r.reason) for r in splitting.oversized_jobs(jobs, profiles).collect()} == {("chars", "chars"), ("blocks", "blocks"), ("both", "both"), ("noids", "chars")}
    assert splitting.split_jobs(jobs.where(F.lit(False)), profiles).count() == 0
    assert [p[7] for p in splitting.split("", 5, 5, 1)] == [""]


# 5 skeletons


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("paper", "рaреr", True), ("Order", "Ｏｒｄｅｒ", True), ("fin", "ﬁn", True), ("é", "é", True), ("a b", "a b", True), ("soft", "so­ft", True), ("IV", "Ⅳ", True), ("x…", "x...", True), ("TEA", "ΤΕΑ", True),
        ("x2", "x²", False), ("“a”", '"a"', False), ("a—b", "a-b", False), ("é", "e", False), ("a.", "a", False), ("Word", "word", False), ("й", "и", False), ("12", "13", False), ("①", "1", False),
    ],
)
def test_skeleton(a, b, same):
    assert (skeleton.skeleton(a) == skeleton.skeleton(b)) is same
    assert skeleton.skeleton(skeleton.skeleton(b)) == skeleton.skeleton(b)


def test_lookalike_blocks(spark):
    schema = "doc_id string, block_id string, text string, other string, form string"
    left = spark.createDataFrame([("d", "1", "paper", "q", "f"), ("d", "1", "paper", "q", "f"), ("d", "2", "same", "", ""), ("d", "3", None, "", ""), (None, "4", "a", "", ""), ("d", "5", "", "", ""), ("d", "6", "only", "", "")], schema)
    right = spark.createDataFrame([("d", "1", "рaреr", "q", "f"), ("d", "2", "same", "", ""), ("d", "3", "x", "", ""), (None, "4", "а", "", ""), ("d", "5", "​", "", "")], schema)
    assert {(r.doc_id, r.block_id) for r in skeleton.lookalike_blocks(left, right).collect()} == {("d", "1"), ("d", "5")}
    forms = {(r.doc_id, r.block_id): (r.form, r.same) for r in skeleton.consistent_texts(left, right).collect()}
    assert forms[("d", "1")] == ("paper", True) and forms[("d", "3")] == (None, None) and forms[("d", "6")] == ("only", None)
    assert [(r.skeleton, r.n_forms, r.n_rows) for r in skeleton.skeleton_groups(left.union(right)).orderBy("skeleton").collect()] == [("", 2, 2), ("a", 2, 2), ("paper", 2, 3)]
    assert skeleton.lookalike_blocks(left.where(F.lit(False)), right).count() == 0


# 6 pairs


def test_defective_pairs(spark):
    rng = random.Random(1)
    jobs, answers = [], []
    heads = ["The report says that", "In winter the", "Between the towers lies", "According to plan the", "Is it true that", "Without delay the", "Near the coast the", "After the flood the"]
    ru = {"The": "Отчёт говорит, что", "In": "Зимой наша", "Between": "Между башнями лежит", "According": "По плану наш", "Is": "Верно ли, что", "Without": "Без задержки наш", "Near": "У берега наш", "After": "После паводка наш"}
    letters = dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхиз"))
    cyrillic = lambda w: "".join(letters[c] for c in w)
    for i in range(160):
        head = heads[i % 8]
        jobs.append((f"j{i:03d}", "EN", "RU", f"{head} {rng.choice(WORDS)} moves the old {rng.choice(WORDS)} {rng.choice(WORDS)} again and again."))
        new = [cyrillic(w.strip(".")) for w in jobs[-1][3].split() if w.strip(".") in WORDS]
        answers.append((f"j{i:03d}", f"{ru[head.split()[0]]} {new[0]} движет {new[1]} и {new[2]} снова и снова."))
    refusal = "К сожалению, я не могу перевести этот отрывок."
    for i in range(0, 8):
        answers[i] = (answers[i][0], refusal)
    answers[10] = (answers[10][0], None)
    answers[11] = (answers[11][0], " ​\n")
    answers[12] = (answers[12][0], "Output: «" + jobs[12][3] + "»")
    answers[13] = (answers[13][0], "Die kleine Pumpe prüft den Kompass nach der Flut und das Register unter der Last.")
    answers[14] = (answers[14][0], answers[14][1][:40])
    answers.append(answers[12])
    answers += [("orphan", "x"), (None, "x")]
    jobs += [("signs", "en", "ru", "12/2024 [5]"), ("noanswer", "en", "ru", "Some text here.")]
    answers.append(("signs", "12/2024 [5]"))
    df = spark.createDataFrame([((i, s, t), (x,), "z") for i, s, t, x in jobs], "job struct<job_id:string,source_language:string,target_language:string>, payload struct<source_text:string>, cluster string")
    out = spark.createDataFrame([(i, t, "s", 1) for i, t in answers], "job_id string, translated_text string, source string, n int")
    got = {r.job_id: r.defect for r in pairs.defective_pairs(df, out).collect()}
    want = {f"j{i:03d}": "refusal" for i in range(8)} | {"j010": "empty", "j011": "empty", "j012": "copy", "j013": "wrong_language", "j014": "truncated"}
    assert got == want
    assert pairs.defective_pairs(df.where(F.lit(False)), out).count() == 0
    assert sum(r.n for r in pairs.defect_report(df, out).collect()) == len(want)


@pytest.mark.parametrize(("text", "lang"), [("Unfortunately, I am unable to help with this text.", "en"), ("К сожалению, я не могу помочь с этим текстом.", "ru"), ("La petite pompe décrit l’atelier sous charge.", "fr"), ("Другий звіт перевіряє червону лампу узимку.", "uk"), ("x^2α((+)∑", "und"), ("", "und")])
def test_language(text, lang):
    assert pairs.language(text) == lang


def test_language_by_profiles(spark):
    assert pairs.language("Después del invierno la bomba se mueve por el canal the y no para sin freno.") == "es"
    rng = random.Random(9)
    made = lambda seed, n: " ".join(random.Random(seed).choice(WORDS) for _ in range(n))
    df = spark.createDataFrame([(f"j{i}", "en", made(i, 30)) for i in range(200)] + [(f"k{i}", "ru", "один") for i in range(3)] + [("n", None, "x"), ("m", "en", None)], "job_id string, src string, source_text string")
    profiles = pairs.fit_profiles(df)
    assert set(profiles) == {"en"} and pairs.fit_profiles(df.where(F.lit(False))) == {}
    assert pairs.language(made(999, 12), profiles) == "en" and pairs.language("der Zug ist nicht mit dem Zug zu der Stadt und das", profiles) == "de" and rng


def test_opening_clusters(spark):
    texts = [f"w{i} alpha beta gamma delta x{i % 3}" for i in range(40)] + ["one two three four five six", "seven eight nine ten eleven twelve"]
    df = spark.createDataFrame([(t.split(),) for t in texts], "opening array<string>")
    rows = df.withColumn("opening_hash", F.xxhash64("opening")).join(pairs.opening_clusters(df), "opening_hash").collect()
    of = {r.opening_hash: r.opening for r in rows}
    for r in rows:
        a, b = (set(zip(x, x[1:])) for x in (r.opening, of[r.cluster]))
        assert len(a & b) >= 0.5 * len(a | b)
    # Three of five shingles in common make less than half of either's: only windows that differ at one end meet.
    most = max(sum(r.cluster == c for r in rows) for c in of)
    assert most >= 10 and len({r.opening_hash for r in rows}) == 42


@pytest.mark.parametrize(("n", "letters", "similarity"), [(6, "abcd", 0.5), (8, "abcd", 0.6), (6, "abc", 0.34), (14, "abcd", 0.5)])
def test_opening_clusters_equal_brute_force(spark, n, letters, similarity):
    rng = random.Random(3)
    texts = {tuple(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, n, n, n]))) for _ in range(300)}
    df = spark.createDataFrame([(list(t),) for t in texts], "opening array<string>").withColumn("opening_hash", F.xxhash64("opening"))
    grams = {r.opening_hash: set(zip(r.opening, r.opening[1:])) for r in df.collect()}
    alike = {a: {b for b in grams if a == b or x & grams[b] and len(x & grams[b]) >= similarity * len(x | grams[b])} for a, x in grams.items()}
    got = {}
    for r in pairs.opening_clusters(df.select("opening"), similarity=similarity).collect():
        got.setdefault(r.cluster, []).append(r.opening_hash)
    assert all(len(those) == len(set(those)) and set(those) == alike[c] for c, those in got.items())
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in alike.values()}


def test_openings_of_one_owner_leave_the_owners_of_clusters(spark):
    rng = random.Random(4)
    owners = {}
    for job in range(200):
        w = tuple(rng.choice("abcde") for _ in range(rng.choice([3, 5, 8, 8])))
        for i in range(max(0, len(w) - 6) + 1):
            owners.setdefault(w[i : i + 6], set()).add(job)
    df = spark.createDataFrame([(list(t), min(o), max(o)) for t, o in owners.items()], "opening array<string>, low bigint, high bigint")
    of = {r.opening_hash: owners[tuple(r.opening)] for r in df.select("opening", F.xxhash64("opening").alias("opening_hash")).collect()}

    def met(openings):
        got = {}
        for r in pairs.opening_clusters(openings).collect():
            got.setdefault(r.cluster, set()).update(of[r.opening_hash])
        return {frozenset(x) for x in got.values()}

    assert met(df) == met(df.select("opening"))


def test_templates_whose_ends_change(spark):
    # Only the middle of three openings is like both others, whichever has the smallest hash.
    rng = random.Random(6)
    prompt = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(9))
    jobs, out = [], []
    for g in range(12):
        body = [f"{WORDS[g]}{x}" for x in "abcdef"]
        for k, said in enumerate((body, [f"{WORDS[g]}y", *body[1:]], [*body[:5], f"{WORDS[g]}z"])):
            jobs.append(((f"j{g:02d}-{k}", "en", "de"), (f"{prompt()}.",)))
            out.append((f"j{g:02d}-{k}", " ".join(said) + "."))
    jobs = spark.createDataFrame(jobs, "job struct<job_id:string,source_language:string,target_language:string>, payload struct<source_text:string>")
    got = pairs.defective_pairs(jobs, spark.createDataFrame(out, "job_id string, translated_text string")).where("defect = 'refusal'").collect()
    assert {r.job_id for r in got} == {x[0] for x in out}


def test_figures_tell_renderings_from_templates(spark):
    body = "К сожалению, я не могу перевести этот отрывок"
    jobs = spark.createDataFrame([((f"j{i}", "en", "ru"), (f"{WORDS[i]} {WORDS[i + 7]} {WORDS[(i * 5) % 26 - 1]} stands at {i + 100}.",)) for i in range(12)], "job struct<job_id:string,source_language:string,target_language:string>, payload struct<source_text:string>")
    # 163 and 100 are one modulo 63; only the very figure tells.
    out = spark.createDataFrame([(f"j{i}", f"{body} {i + 100 if i == 5 else i + 163}.", "s") for i in range(12)], "job_id string, translated_text string, source string")
    got = {r.job_id: r.defect for r in pairs.defective_pairs(jobs, out).collect()}
    assert got == {f"j{i}": "refusal" for i in range(12) if i != 5}


# 7 alignment


def test_alignment(spark):
    glossary = spark.createDataFrame([("engine", "мотор", 1), ("bridge", "мост", 1), ("garden", "сад", 1), ("river", "река", 1), ("tower", "башня", 1), (None, "x", 1), ("lamp", None, 1), ("winter", "зима", 1)], "source_term string, target_term string, n int")
    source = "The engine of Peldavik weighs 12.5 kg. The bridge crosses the river. The garden is 40 years old. The tower stands in winter."
    target = "Мотор города Пелдавик весит 12,5 кг. Мост пересекает реку, а саду 40 лет. Никто об этом ничего не знает."
    rows = [("e", "passage", source, target, 1), ("e", "passage", source, target, 1), ("s", "segment", source, target, 1), ("n", "passage", None, target, 1), ("m", "passage", source, "", 1), (None, "passage", source, target, 1)]
    got = {(r.entry_id, r.source_no, r.target_no) for r in alignment.aligned_sentences(spark.createDataFrame(rows, "entry_id string, unit string, source_text string, target_text string, source_no int"), glossary).collect()}
    assert got == {("e", 0, 0), ("e", 1, 1), ("e", 2, 1)}


def test_alignment_of_moved_and_divided_sentences():
    terms = alignment.Glossary([(w, w.upper()) for w in WORDS])
    s = ["Amber basin cable delta.", "Ember flint grove haven inlet jetty kiosk ledge.", "Manor north ochre plume."]
    t = ["MANOR NORTH OCHRE PLUME.", "AMBER BASIN CABLE DELTA.", "EMBER FLINT GROVE HAVEN.", "INLET JETTY KIOSK LEDGE."]
    assert alignment.align(s, [x.lower() for x in t], terms) == [(0, 1), (1, 2), (1, 3), (2, 0)]
    assert alignment.align([], t, terms) == [] and alignment.align(["..."], ["..."], terms) == []
    assert alignment.sentences("One. Two? Three! “Four.” 5.5 six") == ["One.", "Two?", "Three!", "“Four.” 5.5 six"]


def test_alignment_of_terms_of_several_words():
    terms = alignment.Glossary([("feed pump", "питательный насос"), ("pump", "помпа"), ("control room", "пульт"), ("valve", "клапан"), (" steam  trap ", "конденсатоотводчик")])
    s = ["The feed pumps were old.", "The control room was cold.", "A pump and a valve.", "Steam traps hiss."]
    t = ["Пульт остыл.", "Питательные насосы стары.", "Помпа и клапан.", "Шипят конденсатоотводчики."]
    assert alignment.align(s, t, terms) == [(0, 1), (1, 0), (2, 2), (3, 3)]
    assert not alignment.features("the feed of a pump", terms)[0] & alignment.features("the feed pump", terms)[0]


def test_alignment_of_halves_that_moved():
    terms = alignment.Glossary([(w, w.upper()) for w in WORDS])
    s = ["Amber basin cable delta.", "Ember flint grove haven.", "Inlet jetty kiosk ledge.", "Manor north ochre plume."]
    t = ["amber basin cable delta manor north ochre plume.", "ember flint grove haven.", "inlet jetty kiosk ledge."]
    assert alignment.align(s, t, terms) == [(0, 0), (1, 1), (2, 2), (3, 0)]
    assert alignment.align(t, s, terms) == [(0, 0), (0, 3), (1, 1), (2, 2)]


def test_alignment_of_long_texts():
    terms = alignment.Glossary([(f"{w}{a}", f"{w}{a}".upper()) for w in WORDS for a in "bcdfg"])
    rng = random.Random(3)
    s = [" ".join(rng.choice(WORDS) + rng.choice("bcdfg") for _ in range(8)) + "." for _ in range(400)]
    assert alignment.align(s, s, terms) == [(i, i) for i in range(400)]


# 8 leakage


def test_leakage_equals_brute_force(spark):
    items = [(i, prose(100 + i, 30)) for i in range(6)] + [(6, "too short"), (7, None), (8, prose(100, 30))]
    docs = [(i, prose(i, 200)) for i in range(20)]
    docs += [(20, "Intro. " + ", ".join(prose(100, 30).split()[5:20]).upper() + " end"), (21, " ".join(prose(101, 30).split()[:11])), (22, prose(102, 30).replace("a", "­a")), (23, ""), (24, None), (None, prose(100, 30)), (25, prose(103, 30)[:9] + " " + prose(103, 30)), (20, "x")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")

    def grams(t):
        w = words(t)
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = {(i, d) for i, a in items if a for d, t in docs if d is not None and t and grams(a) & grams(t)}
    got = [(r.item_id, r.doc_id) for r in leakage.leaked_documents(df, it).collect()]
    assert set(got) == want and len(got) == len(want) and (0, 20) in want and (2, 22) in want
    assert {(r.item_id, r.doc_id) for r in leakage.leaked_documents(df, it, shard_tokens=50, sample=3).collect()} == want
    spans_of = {(r.item_id, r.doc_id): (r.start_word, r.end_word) for r in leakage.leaked_spans(df, it).collect()}
    assert spans_of[(0, 20)] == (1, 16) and spans_of[(3, 25)][1] - spans_of[(3, 25)][0] == 30
    assert leakage.leaked_documents(df.where(F.lit(False)), it).count() == 0 == leakage.leaked_documents(df, it.where(F.lit(False))).count()
    assert {(r.item_id, r.doc_id) for r in leakage.leaked_documents(df, it, block_chars=300).collect()} == want


# 9 mixing


def test_mixture(spark):
    docs = [(i, prose(i, 20 + i % 50), ["a", "b", "c"][min(2, i % 7 // 3)]) for i in range(300)] + [(1000, "", "a"), (1001, None, "b"), (1002, prose(5, 40), None), (1003, prose(6, 40), "zz"), (None, "x", "a")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, source string, weight double")
    targets = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.3, 1, 1), ("c", 0.2, 4, 1), ("none", 0.0, 1, 1)], "source string, weight double, max_repeats int, n int")
    rows = mixing.mixture(df, targets).collect()
    caps = {"a": 2, "b": 1, "c": 4}
    assert all(1 <= r.repeats <= caps[r.domain] for r in rows) and not {1000, 1001} & {r.doc_id for r in rows}
    total = sum(r.n_tokens * r.repeats for r in rows)
    for name, weight in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.n_tokens * r.repeats for r in rows if r.domain == name) / total - weight) < 0.01
    shares = {r.source: r.share for r in mixing.mixture_shares(df, targets).collect()}
    assert abs(shares["a"] - 0.5) < 0.01 and shares["none"] == 0
    assert mixing.mixture(df.where(F.lit(False)), targets).count() == 0 == mixing.mixture(df, targets.where(F.lit(False))).count()


def test_soft_mixture(spark):
    # Sources write with words of their own; a third of the documents name no source, and some name a wrong one.
    rng = random.Random(12)
    words_of = {"a": WORDS[:9], "b": WORDS[9:18], "c": WORDS[18:]}
    docs = []
    for i in range(600):
        own = "abc"[min(2, i % 7 // 3)]
        docs.append((i, " ".join(rng.choice(words_of[own]) for _ in range(20 + i % 60)), None if i % 3 == 0 else "a" if i % 40 == 1 else own, own))
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4)], "source string, weight double, max_repeats int")
    own = {d[0]: d[3] for d in docs}
    for soft in (False, True):
        rows = mixing.mixture(df, targets, soft=soft).collect()
        total = sum(r.n_tokens * r.repeats for r in rows)
        right = {s: sum(r.n_tokens * r.repeats for r in rows if own[r.doc_id] == s) / total for s in "abc"}
        # Posteriors bring the true sources to their shares; wrong labels taken at their word do not.
        off = max(abs(right[s] - w) for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
        assert off < 0.02 if soft else 0.005 < off < 0.06
        assert any(r.source is None for r in rows)
    got = {r.source: r for r in mixing.soft_shares(df, targets).collect()}
    assert all(abs(got[s].expected - w) < 0.02 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and got[None].labelled > 0.2
    assert mixing.soft_shares(df.where(F.lit(False)), targets).count() == 3


def test_classifier_is_accurate(spark):
    rng = random.Random(8)
    docs = [(" ".join(rng.choice(WORDS[:15] if s == "a" else WORDS[10:]) for _ in range(30)), s) for s in "ab" for _ in range(150)]
    rng.shuffle(docs)
    model = mixing.fit_classifier(spark.createDataFrame(docs[:200], "text string, source string"), ["a", "b"])
    right = [model.domains[i] == s for i, (_, s) in zip(model.posteriors([t for t, _ in docs[200:]]).argmax(1), docs[200:])]
    assert sum(right) / len(right) > 0.95
    assert abs(model.posteriors([None]).sum() - 1) < 1e-9


# 10 shared spans


def test_shared_spans_equal_brute_force(spark):
    a, b = prose(1, 120), prose(2, 120)
    docs = [(1, a), (2, "head " + a[50:360] + " tail"), (3, "head " + a[50:349] + "# tail"), (4, b + a[:310]), (5, b), (6, b), (7, None), (8, ""), (9, "short"), (9, "short"), (10, "z" * 700), (11, "z" * 650 + "y"), (12, prose(3, 90) + b[10:320] + prose(4, 60) + b[300:640])]
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, pos int, hash string")

    def grams(t):
        return {t[i : i + 300] for i in range(len(t) - 299)} if t else set()

    own = dict(docs)
    want = {(x, y) for x in own for y in own if x < y and grams(own[x]) & grams(own[y])}
    got = [(r.doc_a, r.doc_b) for r in spans.shared_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) and (1, 2) in want and (1, 3) not in want
    share = {r.doc_id: r.n_shared for r in spans.shared_share(df).collect()}
    for d, t in own.items():
        marks = bytearray(len(t or ""))
        for i in range(len(marks) - 299):
            if any(o != d and t[i : i + 300] in (x or "") for o, x in own.items()):
                marks[i : i + 300] = b"\1" * 300
        assert share[d] == sum(marks), d
    assert spans.shared_pairs(df.where(F.lit(False))).count() == 0 == spans.shared_share(df.where(F.lit(False))).count()


# all queries


def llm_queries():
    from quire.llm import queries

    return queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(llm_queries().QUERIES))
def test_queries(spark, sf, duck, name):
    """Every query is run whole on the smallest tables, and compared with its SQL where there is any."""
    queries = llm_queries()
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in queries.SQL:
        out = duck.execute(queries.SQL[name])
        at = [[x[0] for x in out.description].index(c) for c in columns]
        assert ours == Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
    assert ours or name == "p5_found"

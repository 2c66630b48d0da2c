"""All queries of the core operators, and the SQL they are compared with (in ``oracles``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import backends, chunking, complexity, context, layout, memory, planning, quality, structure
from ..operators.ordered import latest
from ..session import table
from ..sources import readers, sinks
from ..streaming import resume
from .oracles import SQL

__all__ = ["QUERIES", "SQL"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def blocks(s: SparkSession, d: str) -> DataFrame:
    return structure.newest(table(s, d, "blocks"))


def extracted(s: SparkSession, d: str) -> DataFrame:
    return structure.newest(table(s, d, "extracted_blocks"))


def scanned(s: SparkSession, d: str) -> DataFrame:
    return structure.newest(table(s, d, "ocr_blocks"))


def tm(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "translation_memory"), ["entry_id"], F.col("loaded_at"))


def jobs(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "job_inputs").select(F.col("job.job_id").alias("id"), F.col("job.book_id").alias("book_id"), F.col("job.template_id").alias("template_id"), F.lower("job.source_language").alias("src"), F.lower("job.target_language").alias("tgt"), F.col("payload.chapter_id").alias("chapter_id"), F.col("payload.chunk_id").alias("chunk_id"), F.col("payload.source_text").alias("text"), F.col("payload.block_ids").alias("block_ids"), "profile_name", "loaded_at")
    return latest(rows, ["id"], F.col("loaded_at"))


def outputs(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "job_outputs").withColumnRenamed("job_id", "id"), ["id"], F.col("loaded_at"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    answers = outputs(s, d).select("id", F.col("translated_text").alias("target_text"))
    return jobs(s, d).select("id", F.col("text").alias("source_text")).join(answers, "id", "left")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


# Scalar functions


@query
def x01_normalize(s: SparkSession, d: str) -> DataFrame:
    return tm(s, d).select("entry_id", X.normalize("source_text").alias("source"), X.normalize("target_text").alias("target"))


@query
def x02_line_tokens(s: SparkSession, d: str) -> DataFrame:
    return scanned(s, d).select(F.explode(F.split("text", "\n")).alias("line")).select(X.line_token("line").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def x03_typeset(s: SparkSession, d: str) -> DataFrame:
    return scanned(s, d).select("doc_id", "block_id", X.typeset("text").alias("text"))


@query
def x04_compact(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.length(X.compact("text")).alias("n_marks"))


@query
def x05_markers(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).where("block_type = 'footnote_marker'").select("doc_id", "block_id", X.marker("text").alias("marker"))


@query
def x06_slugs(s: SparkSession, d: str) -> DataFrame:
    return tm(s, d).where("unit = 'heading'").select("entry_id", X.slug("source_text").alias("slug"))


@query
def x07_tokens(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.explode(X.tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def x08_numbers(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("id", F.array_join(X.numbers("text"), ";").alias("numbers"))


@query
def x09_links(s: SparkSession, d: str) -> DataFrame:
    web = F.concat(X.text("text"), F.lit(" see https://example.org/"), F.col("id"), F.lit(", www.example.org/b and end"))
    return jobs(s, d).withColumn("t", web).select("id", F.array_join(X.links("t"), ";").alias("links"))


@query
def x10_dates(s: SparkSession, d: str) -> DataFrame:
    dated = F.concat(X.text("text"), F.lit(" 2024-03-05, 5/3/2024 and March 5, 2024"))
    return jobs(s, d).withColumn("t", dated).select("id", F.array_join(X.dates("t"), ";").alias("dates"))


@query
def x11_equations(s: SparkSession, d: str) -> DataFrame:
    summed = F.concat(X.text("text"), F.lit("\nx1 = 2 + "), F.length(X.text("text")).cast("string"), F.lit("; done"))
    return jobs(s, d).withColumn("t", summed).select("id", F.array_join(X.equations("t"), "|").alias("equations"))


@query
def x12_supported(s: SparkSession, d: str) -> DataFrame:
    target = F.concat(X.text("text"), F.lit(" 5.3.2024 x = 4"))
    rows = jobs(s, d).withColumn("t", target)
    return rows.select("id", X.date_supported(F.lit("2024-3-5"), F.col("t")).alias("date"), X.date_supported(F.lit("1999-12-31"), F.col("t")).alias("no_date"), X.equation_supported(F.lit("x=4"), F.col("t")).alias("equation"), X.equation_supported(F.lit("zq=977"), F.col("t")).alias("no_equation"))


@query
def x13_hints(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("id", F.array_join(X.hints("text"), ";").alias("hints"))


@query
def x14_estimates(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("id", X.token_estimate("text").alias("by_words"), X.char_estimate("text").alias("by_chars"))


@query
def x15_ratios(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.round(X.share_of("text", r"\d"), 9).alias("digits"), F.round(X.share_of("text", complexity.FORMULA), 9).alias("formula"))


@query
def x16_lists(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select("doc_id", "block_id", F.round(X.list_density("text"), 9).alias("density"))


@query
def x17_rare_terms(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("id", X.rare_terms("text").alias("n_rare"))


@query
def x19_heads(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", X.head("text", 80).alias("head"), X.tail("text", 80).alias("tail"))


@query
def x22_context_weight(s: SparkSession, d: str) -> DataFrame:
    c = lambda f: F.length(X.text(F.col(f"payload.{f}")))
    rows = latest(table(s, d, "job_inputs").select(F.col("job.job_id").alias("id"), "payload", "loaded_at"), ["id"], F.col("loaded_at"))
    terms = F.aggregate("payload.glossary", F.lit(0), lambda n, g: n + F.length(X.text(g["source"])) + F.length(X.text(g["target"])))
    return rows.select("id", (c("context_before") + c("context_after") + c("chapter_notes") + F.coalesce(terms, F.lit(0))).alias("weight"))


@query
def x24_durations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", X.duration(F.col("value") * 100).alias("duration"))


@query
def x25_quality(s: SparkSession, d: str) -> DataFrame:
    return tm(s, d).select(X.clamp("quality", ("draft", "reviewed", "approved", "locked"), "draft").alias("quality")).groupBy("quality").agg(F.count("*").alias("n"))


# Structure


@query
def w01_adjacency(s: SparkSession, d: str) -> DataFrame:
    return structure.adjacency(blocks(s, d))


@query
def w02_sections(s: SparkSession, d: str) -> DataFrame:
    return structure.sections(blocks(s, d))


@query
def w03_reading_order(s: SparkSession, d: str) -> DataFrame:
    return structure.reading_order(extracted(s, d))


@query
def cls01_line_kinds(s: SparkSession, d: str) -> DataFrame:
    return structure.classify_lines(extracted(s, d))


@query
def cls02_scanned_kinds(s: SparkSession, d: str) -> DataFrame:
    return structure.classify_scanned(scanned(s, d))


@query
def cls03_chunk_types(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select(chunking.chunk_type(F.col("block_type")).alias("chunk_type")).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query
def cls07_font_sizes(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select("doc_id", "block_id", layout.font_size(F.col("style_metadata.avg_font_size"), F.col("style_metadata.max_font_size")).alias("size"))


@query
def cls08_clipped(s: SparkSession, d: str) -> DataFrame:
    box = layout.clipped("bbox")
    return blocks(s, d).where("bbox is not null").select("doc_id", "block_id", box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), box["y1"].alias("y1"))


@query
def a01_page_sizes(s: SparkSession, d: str) -> DataFrame:
    return structure.page_sizes(blocks(s, d))


@query
def a02_inspection(s: SparkSession, d: str) -> DataFrame:
    return structure.inspection(blocks(s, d))


@query
def a04_furniture(s: SparkSession, d: str) -> DataFrame:
    return structure.furniture(extracted(s, d))


@query
def a06_font_medians(s: SparkSession, d: str) -> DataFrame:
    return structure.font_medians(blocks(s, d))


@query
def a07_scan_quality(s: SparkSession, d: str) -> DataFrame:
    return structure.scan_quality(scanned(s, d))


@query
def a08_graph_counts(s: SparkSession, d: str) -> DataFrame:
    return structure.graph_counts(blocks(s, d))


@query
def j09_note_links(s: SparkSession, d: str) -> DataFrame:
    return structure.footnote_links(blocks(s, d))


@query
def j10_captions(s: SparkSession, d: str) -> DataFrame:
    return structure.caption_links(blocks(s, d))


@query
def j11_block_sections(s: SparkSession, d: str) -> DataFrame:
    return structure.assign_sections(blocks(s, d))


@query
def j12_image_anchors(s: SparkSession, d: str) -> DataFrame:
    images = extracted(s, d).select("doc_id", "page_num", F.col("style_metadata.image_id").alias("image_id")).where("image_id is not null")
    return structure.image_anchors(images, blocks(s, d))


@query
def u01_edges(s: SparkSession, d: str) -> DataFrame:
    return structure.edges(blocks(s, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("target").alias("first"))


@query
def v01_graph_errors(s: SparkSession, d: str) -> DataFrame:
    return structure.graph_errors(blocks(s, d))


@query
def r06_footnotes(s: SparkSession, d: str) -> DataFrame:
    return structure.footnotes(blocks(s, d))


@query
def r08_page_flags(s: SparkSession, d: str) -> DataFrame:
    return structure.page_flags(blocks(s, d))


@query
def r24_page_members(s: SparkSession, d: str) -> DataFrame:
    return structure.page_members(blocks(s, d))


@query
def s05_text_lines(s: SparkSession, d: str) -> DataFrame:
    return readers.text_lines(docs(s, d), "doc_id", "text")


@query
def f07_multi_column(s: SparkSession, d: str) -> DataFrame:
    rows = X.lines("text")
    wide = F.size(F.filter(F.split(X.text("text"), "\n"), lambda x: x.rlike(r"\S.{0,50}\s{7,}\S")))
    return docs(s, d).select("doc_id", ((wide >= 3) | ((wide >= 2) & (wide >= 0.25 * F.size(rows)))).alias("multi_column"))


# Chunks


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(blocks(s, d))


@query
def w05_packing(s: SparkSession, d: str) -> DataFrame:
    return chunking.pack(blocks(s, d)).select("doc_id", "block_id", "chunk_no")


@query
def w06_contexts(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d)
    return chunking.contexts(b, chunking.pack(b))


@query
def w07_split(s: SparkSession, d: str) -> DataFrame:
    return chunking.split_complex(complexity.assess(_chunks(s, d)), least=0.3, max_blocks=4)


@query
def w08_merge(s: SparkSession, d: str) -> DataFrame:
    rated = complexity.assess(_chunks(s, d).drop("hints")).withColumns({"n_blocks": F.size("block_ids"), "n_refs": F.lit(0)})
    return chunking.merge_pairs(rated)


@query
def c02_chunks(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("doc_id", "chunk_id", "chapter_id", "chunk_type", "start_page", "end_page", F.array_join("block_ids", ",").alias("block_ids"), "source_text", "token_estimate")


@query
def c02_routing(s: SparkSession, d: str) -> DataFrame:
    return complexity.assess(_chunks(s, d)).groupBy("chunk_type", "tier").agg(F.count("*").alias("n_chunks"), F.sum("token_estimate").alias("tokens"), F.round(F.avg("score"), 6).alias("score"))


@query
def j13_note_refs(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d)
    return chunking.note_refs(_chunks(s, d), structure.footnote_links(b))


@query
def v02_chunk_errors(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_errors(_chunks(s, d), blocks(s, d))


@query
def cls04_complexity(s: SparkSession, d: str) -> DataFrame:
    rated = complexity.assess(jobs(s, d).select("id", F.col("text").alias("source_text")))
    return rated.select("id", "n_chars", "notes", "rare", F.round("score", 9).alias("score"), "risks", "tier")


@query
def cls05_tiers(s: SparkSession, d: str) -> DataFrame:
    profiles = table(s, d, "economy_profiles").select(F.col("name").alias("profile_name"), "tier_b_threshold", "tier_c_threshold")
    rows = jobs(s, d).select("id", "profile_name", F.col("text").alias("source_text")).join(F.broadcast(profiles), "profile_name")
    return complexity.assess(rows, F.col("tier_b_threshold"), F.col("tier_c_threshold")).groupBy("profile_name", "tier").agg(F.count("*").alias("n"))


# Glossary and memory


def _texts(s: SparkSession, d: str) -> DataFrame:
    return jobs(s, d).select("id", "text", "chapter_id")


@query
def j04_exact_terms(s: SparkSession, d: str) -> DataFrame:
    return memory.exact_terms(_texts(s, d), table(s, d, "glossary"))


@query
def j05_fuzzy_terms(s: SparkSession, d: str) -> DataFrame:
    return memory.fuzzy_terms(_texts(s, d), table(s, d, "glossary"))


@query
def j06_similar_entries(s: SparkSession, d: str) -> DataFrame:
    entries = tm(s, d)
    hundredth = entries.where(F.regexp_extract("entry_id", r"(\d+)$", 1).cast("bigint") % 100 == 0)
    return memory.similar_entries(hundredth.select(F.col("entry_id").alias("id"), F.col("source_text").alias("text"), "chapter_id"), entries)


@query
def j07_exact_matches(s: SparkSession, d: str) -> DataFrame:
    return memory.exact_matches(_texts(s, d), tm(s, d))


@query
def j08_chapter_terms(s: SparkSession, d: str) -> DataFrame:
    return memory.chapter_terms(_texts(s, d), tm(s, d))


@query
def j08_contained_terms(s: SparkSession, d: str) -> DataFrame:
    return memory.contained_terms(_texts(s, d), tm(s, d))


@query
def f05_glossary_lookup(s: SparkSession, d: str) -> DataFrame:
    columns = ["source_term", "target_term", "part_of_speech", "decision", "notes"]
    return memory.lookup(table(s, d, "glossary"), columns, " Re ", 10, [F.col(c).asc_nulls_first() for c in columns]).select(*columns)


@query
def t04_style_rules(s: SparkSession, d: str) -> DataFrame:
    return memory.style_rules(_texts(s, d), _rules(s), 3).withColumn("coverage", F.round("coverage", 9))


def _rules(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(1, "Keep numbers and the kg unit as in the source"), (2, "Use the formal system of terms"), (3, "Names of towns are transliterated"), (4, "Никогда не меняйте порядок предложений")], "ord int, rule string")


@query
def r01_clean_terms(s: SparkSession, d: str) -> DataFrame:
    return memory.clean_terms(table(s, d, "glossary")).select("key", "target_term", "decision")


# Quality


@query
def c12_pair_flags(s: SparkSession, d: str) -> DataFrame:
    return quality.pair_flags(pairs(s, d))


@query
def a09_flag_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.flag_counts(quality.pair_flags(pairs(s, d)))


@query
def a13_stable_expressions(s: SparkSession, d: str) -> DataFrame:
    return quality.stable_expressions(tm(s, d).select(F.col("entry_id").alias("id"), "source_text", "target_text"))


@query
def c11_consistency(s: SparkSession, d: str) -> DataFrame:
    return quality.consistency_flags(pairs(s, d), table(s, d, "glossary")).groupBy("id", "type", "severity").agg(F.count("*").alias("n"))


@query
def r26_term_conflicts(s: SparkSession, d: str) -> DataFrame:
    return quality.term_conflicts(pairs(s, d), table(s, d, "glossary"))


@query
def r27_literalness(s: SparkSession, d: str) -> DataFrame:
    return quality.literalness(pairs(s, d))


@query
def r28_names_missing(s: SparkSession, d: str) -> DataFrame:
    return quality.names_missing(pairs(s, d)).groupBy("id", "name").agg(F.count("*").alias("n"))


@query
def f04_risk_candidates(s: SparkSession, d: str) -> DataFrame:
    p = pairs(s, d)
    return quality.risk_candidates(p, quality.pair_flags(p), table(s, d, "glossary"))


@query
def k04_flag_report(s: SparkSession, d: str) -> DataFrame:
    return sinks.report("Flags", quality.flag_counts(quality.pair_flags(pairs(s, d))), ["rule_id"])


# Planning and runs


def _planned(s: SparkSession, d: str) -> DataFrame:
    """The plan of the jobs; near entries are reused on the profile that has neither editorial pass nor QA: ``lean``, the survey's economy."""
    profiles = table(s, d, "economy_profiles").where("name = 'lean'").select(F.col("name").alias("profile_name"), F.col("tm_near_threshold").alias("near"))
    return planning.prefilter(jobs(s, d).withColumn("ord", F.col("id")).join(F.broadcast(profiles), "profile_name", "left"), tm(s, d))


@query
def c04_prefilter(s: SparkSession, d: str) -> DataFrame:
    return _planned(s, d)


@query
def a10_plan_summary(s: SparkSession, d: str) -> DataFrame:
    return planning.plan_summary(_planned(s, d)).withColumn("share", F.round("share", 9))


def _exactly_planned(s: SparkSession, d: str) -> DataFrame:
    """The plan without near entries, which SQL can follow."""
    return planning.prefilter(jobs(s, d).withColumn("ord", F.col("id")), tm(s, d))


@query
def c04_exact(s: SparkSession, d: str) -> DataFrame:
    return _exactly_planned(s, d)


@query
def a10_exact_summary(s: SparkSession, d: str) -> DataFrame:
    return planning.plan_summary(_exactly_planned(s, d)).withColumn("share", F.round("share", 9))


def _rated(s: SparkSession, d: str) -> DataFrame:
    return complexity.assess(jobs(s, d).select("id", F.col("text").alias("source_text")))


@query
def f11_checks(s: SparkSession, d: str) -> DataFrame:
    return planning.checks(_rated(s, d)).select("id", "run_editorial", "run_qa")


def _plan(s: SparkSession, d: str) -> DataFrame:
    texts = _texts(s, d)
    rated = planning.checks(_rated(s, d), memory.fuzzy_terms(texts, table(s, d, "glossary")), memory.contained_terms(texts, tm(s, d)))
    return planning.plan(_exactly_planned(s, d), rated, outputs(s, d).where("status = 'ok'").select("id", F.col("translated_text").alias("output")), x22_context_weight(s, d))


@query
def c06_plan(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d)


@query
def a10_savings(s: SparkSession, d: str) -> DataFrame:
    return planning.savings(_plan(s, d))


def _batch_states(s: SparkSession, d: str) -> DataFrame:
    said = outputs(s, d).select("id", (F.col("status") == "failed").alias("failed"), (X.strip("translated_text") != "").alias("done"))
    rows = planning.batches(jobs(s, d), 24).join(said, "id", "left")
    state = F.when(F.bool_and(F.coalesce("done", F.lit(False))), "completed").when(F.bool_or(F.coalesce("failed", F.lit(False))), "failed").otherwise("pending")
    return rows.groupBy("book_id", "batch_id").agg(state.alias("status"))


@query
def f03_selection(s: SparkSession, d: str) -> DataFrame:
    return planning.selected(_batch_states(s, d), first="batch-0001", resume=True)


@query
def j17_tasks(s: SparkSession, d: str) -> DataFrame:
    return planning.tasks(planning.batches(jobs(s, d), 24), _exactly_planned(s, d))


@query
def r03_local_targets(s: SparkSession, d: str) -> DataFrame:
    cache = outputs(s, d).where("status = 'ok'").select("id", F.col("translated_text").alias("output"))
    return planning.local_targets(_exactly_planned(s, d), jobs(s, d), cache)


@query
def c03_adapted(s: SparkSession, d: str) -> DataFrame:
    return chunking.adapted(complexity.assess(_chunks(s, d)), blocks(s, d), least=0.3).withColumns({"source_ids": F.array_join("source_ids", ","), "block_ids": F.array_join("block_ids", ",")})


@query
def f01_fragments(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("block_type").isin("header", "footer"), "auxiliary").otherwise(F.col("block_type"))
    return blocks(s, d).where(X.strip("text") != "").where(planning.fragment(F.col("text"), kind)).select("doc_id", "block_id")


@query
def x21_fingerprints(s: SparkSession, d: str) -> DataFrame:
    # The smallest id of an equal content names the content, whatever the hash.
    prints = planning.fingerprints(jobs(s, d))
    return prints.join(prints.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("n")), "fingerprint").select("id", "first", "n")


@query
def j14_cached(s: SparkSession, d: str) -> DataFrame:
    rows = jobs(s, d)
    prints = planning.fingerprints(rows).join(rows.select("id", "template_id"), "id")
    done = outputs(s, d).where("status = 'ok'").select("id", F.col("translated_text").alias("output"), F.col("loaded_at").alias("created_at"))
    return planning.cached(prints, prints.join(done, "id")).groupBy(F.col("output").isNull().alias("blank")).agg(F.countDistinct("id").alias("n"))


@query
def w10_batches(s: SparkSession, d: str) -> DataFrame:
    return planning.batches(jobs(s, d), 24)


@query
def a15_batch_progress(s: SparkSession, d: str) -> DataFrame:
    done = outputs(s, d).where(X.strip("translated_text") != "")
    return planning.batch_progress(planning.batches(jobs(s, d), 24), done)


@query
def u06_remaining(s: SparkSession, d: str) -> DataFrame:
    return planning.remaining(jobs(s, d), outputs(s, d).where("status = 'ok'")).select("id")


@query
def j02_merged_answers(s: SparkSession, d: str) -> DataFrame:
    first = outputs(s, d).select("id", F.col("translated_text").alias("text"), "loaded_at")
    later = outputs(s, d).where("source = 'lite_backend'").select("id", F.concat(F.lit("edited "), X.text("translated_text")).alias("text"), "loaded_at")
    return planning.merged_answers(first, later)


@query
def h04_mock(s: SparkSession, d: str) -> DataFrame:
    return backends.mock(jobs(s, d), failing=("job-000000001",))


@query
def r15_job_inputs(s: SparkSession, d: str) -> DataFrame:
    rows = latest(table(s, d, "job_inputs").withColumn("_id", F.col("job.job_id")), ["_id"], F.col("loaded_at"))
    return backends.job_input(rows).select("job_id", F.get_json_object("input", "$.job.source_language").alias("src"), F.length(F.get_json_object("input", "$.payload.source_text")).alias("n_chars"))


@query
def x27_prompts(s: SparkSession, d: str) -> DataFrame:
    rows = latest(table(s, d, "job_inputs").withColumn("_id", F.col("job.job_id")), ["_id"], F.col("loaded_at"))
    return backends.prompts(rows, "From {{source_language}} to {{target_language}} ({{chunk_id}}):\n{{source_text}}")


@query
def a14_run_summary(s: SparkSession, d: str) -> DataFrame:
    return outputs(s, d).groupBy("source").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(X.strip("translated_text") == "").alias("n_empty"), F.sum(F.size(F.coalesce("errors", F.array().cast("array<string>")))).alias("n_errors"))


@query
def s18_output_states(s: SparkSession, d: str) -> DataFrame:
    raw = outputs(s, d).select("id", F.to_json(F.struct("schema_version", "status", "translated_text")).alias("j"))
    cut = F.when(F.xxhash64("id") % 10 == 0, F.expr("left(j, length(j) - 5)")).otherwise(F.col("j"))
    return raw.select(readers.output_state(cut, ["schema_version", "status"]).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query
def c05_context(s: SparkSession, d: str) -> DataFrame:
    rows = latest(table(s, d, "job_inputs").select(F.col("job.job_id").alias("id"), F.col("payload.chapter_id").alias("chapter_id"), F.col("payload.chapter_notes").alias("text"), "loaded_at"), ["id"], F.col("loaded_at"))
    notes = context.chapter_notes(rows.select("id", F.col("id").alias("doc"), "chapter_id"), rows.select(F.col("id").alias("doc"), "text"))
    return context.package(_texts(s, d), table(s, d, "glossary"), tm(s, d), rules=_rules(s), notes=notes)


@query
def cls10_payload_flags(s: SparkSession, d: str) -> DataFrame:
    raw = outputs(s, d).select("id", F.to_json(F.struct(F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e: F.struct(F.lit("High").alias("severity"), e.alias("message"))).alias("issues"), (F.col("status") == "ok").alias("qa_passed"))).alias("json"))
    return context.payload_flags(raw)


@query
def j18_page_notes(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d).where("block_type = 'footnote_body'")
    source = b.select("doc_id", "page_num", "block_id", "text", F.regexp_extract(X.text("text"), r"^\s*(\[?\d{1,3}\]?|\d{1,3}[.)])\s", 1).alias("marker"))
    said = extracted(s, d).where("block_type = 'footnote_body'").select("doc_id", "page_num", "block_id", "text")
    return context.page_notes(said, source)


# Layout


@query
def j15_compose(s: SparkSession, d: str) -> DataFrame:
    rows = jobs(s, d).select("id", F.col("book_id").alias("doc_id"), "block_ids").join(outputs(s, d).select("id", F.col("translated_text").alias("text")), "id")
    return layout.compose(rows)


@query
def w13_pages(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d).withColumn("ord", F.format_string("%06d-%06d-%s", "page_num", "reading_order", "block_id"))
    return layout.paginate(b.select("doc_id", "ord", F.col("block_type").alias("kind"), "text"))


@query
def a16_page_metrics(s: SparkSession, d: str) -> DataFrame:
    return w13_pages(s, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n_body").alias("n_body"), F.sum("n_notes").alias("n_notes"), F.sum(F.length("body")).alias("n_chars"))


@query
def w14_widows(s: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.length(X.text("text")) / 60).cast("int")
    return docs(s, d).select("doc_id", layout.keep_column(n, F.lit(7)).alias("lines_kept"))


@query
def w15_fitted(s: SparkSession, d: str) -> DataFrame:
    return layout.fitted(blocks(s, d))


@query
def ext_event_windows(s: SparkSession, d: str) -> DataFrame:
    return resume.event_windows(table(s, d, "events")).withColumn("value", F.round("value", 4))

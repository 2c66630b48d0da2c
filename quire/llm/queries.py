"""Queries of the operators in this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import alignment, leakage, mixing, near, pairs, scans, skeleton, spans, splitting, truncation
from .text import INVISIBLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leakage_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


@query
def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_jobs(table(spark, d, "job_inputs"), table(spark, d, "economy_profiles"))


SQL["p4_found"] = """
SELECT DISTINCT j.job.job_id AS job_id,
  CASE WHEN length(j.payload.source_text) > p.chunk_max_chars AND len(j.payload.block_ids) > p.chunk_max_blocks THEN 'both'
       WHEN length(j.payload.source_text) > p.chunk_max_chars THEN 'chars' ELSE 'blocks' END AS reason
FROM job_inputs j JOIN economy_profiles p ON j.profile_name = p.name
WHERE length(j.payload.source_text) > p.chunk_max_chars OR len(j.payload.block_ids) > p.chunk_max_blocks
"""


@query
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_jobs(table(spark, d, "job_inputs"), table(spark, d, "economy_profiles"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.lookalike_blocks(table(spark, d, "blocks"), table(spark, d, "extracted_blocks"))


@query
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.consistent_texts(table(spark, d, "blocks"), table(spark, d, "extracted_blocks"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.skeleton_groups(table(spark, d, "blocks").unionByName(table(spark, d, "extracted_blocks"), allowMissingColumns=True).select("text"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "translation_memory"), table(spark, d, "job_inputs"), table(spark, d, "job_outputs"))


@query
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "translation_memory"), table(spark, d, "job_inputs"), table(spark, d, "job_outputs"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "job_inputs"), table(spark, d, "job_outputs"))


@query
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_report(table(spark, d, "job_inputs"), table(spark, d, "job_outputs"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return alignment.aligned_sentences(table(spark, d, "translation_memory"), table(spark, d, "glossary"))


def _source_texts(spark: SparkSession, d: str) -> DataFrame:
    memory = table(spark, d, "translation_memory").selectExpr("entry_id AS rec", "source_text AS text")
    return memory.union(table(spark, d, "job_inputs").selectExpr("job.job_id AS rec", "payload.source_text AS text"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(_source_texts(spark, d))


@query
def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return near.near_records(_source_texts(spark, d))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "ocr_blocks"), table(spark, d, "blocks"))


@query
def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "ocr_blocks"), table(spark, d, "blocks"))


@query
def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_soft_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.soft_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


_NEAR = r"""
r AS (SELECT entry_id AS rec, source_text AS text FROM translation_memory UNION SELECT job.job_id, payload.source_text FROM job_inputs),
w AS (SELECT rec, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM r WHERE text IS NOT NULL),
b AS (SELECT DISTINCT rec, w[i] || ' ' || w[i + 1] AS g FROM (SELECT rec, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 12)),
n AS (SELECT rec, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT x.rec AS rec_a, y.rec AS rec_b, count(*) AS k FROM b x JOIN b y ON x.g = y.g AND x.rec < y.rec GROUP BY 1, 2),
f AS (SELECT rec_a, rec_b FROM p JOIN n a ON a.rec = rec_a JOIN n c ON c.rec = rec_b WHERE 5 * k >= 3 * (a.n + c.n - k))"""
SQL["p1_found"] = f"WITH {_NEAR} SELECT * FROM f"
SQL["p1_records"] = f"""
WITH {_NEAR}, h AS (SELECT rec, md5(string_agg(g, '|' ORDER BY g)) AS h FROM b GROUP BY 1), c AS (SELECT rec, h, min(rec) OVER (PARTITION BY h) AS class, count(*) OVER (PARTITION BY h) - 1 AS n_copies FROM h),
l AS (SELECT x.rec, count(*) AS n FROM (SELECT rec_a AS rec, rec_b AS other FROM f UNION ALL SELECT rec_b, rec_a FROM f) x JOIN c a ON a.rec = x.rec JOIN c o ON o.rec = x.other WHERE a.h <> o.h GROUP BY 1)
SELECT c.rec, class, n_copies, coalesce(n, 0) AS n_links FROM c LEFT JOIN l USING (rec)
"""

_WINDOWS = """w AS (SELECT doc_id, i, md5(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))"""
SQL["p10_found"] = f"WITH {_WINDOWS}, d AS (SELECT DISTINCT doc_id, h FROM w) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b USING (h) WHERE a.doc_id < b.doc_id"
SQL["p10_share"] = f"""
WITH {_WINDOWS}, s AS (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM w SEMI JOIN s USING (h)),
c AS (SELECT doc_id, sum(least(300, coalesce(n - i, 300)))::INT AS k FROM p GROUP BY 1)
SELECT d.doc_id, length(coalesce(text, '')) AS n_chars, coalesce(k, 0) AS n_shared, CASE WHEN length(coalesce(text, '')) > 0 THEN coalesce(k, 0) / length(text) ELSE 0.0 END::DOUBLE AS share FROM documents d LEFT JOIN c USING (doc_id)
"""


def _plain_sql(x: str) -> str:
    """Lower case without invisible characters; full-width signs and Latin ligatures as plain ones, composed."""
    full, half = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    x = f"translate(regexp_replace({x}, '[{INVISIBLE}]', '', 'g'), '{full}', '{half}')"
    for one, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{one}', '{plain}')"
    return f"regexp_extract_all(lower(nfc_normalize({x})), '[\\p{{L}}\\p{{N}}]+')"


def _phrases_sql(key: str, words: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM {words})"


SQL["p8_found"] = f"""
WITH d AS (SELECT doc_id, {_plain_sql("text")} AS w FROM documents), e AS (SELECT item_id, {_plain_sql("text")} AS w FROM eval_items),
x AS ({_phrases_sql("doc_id", "d")}), y AS ({_phrases_sql("item_id", "e")}) SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (g)
"""


SQL["p8_report"] = f"""
WITH d AS (SELECT doc_id, {_plain_sql("text")} AS w FROM documents), e AS (SELECT item_id, {_plain_sql("text")} AS w FROM eval_items), y AS ({_phrases_sql("item_id", "e")}),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)), m AS (SELECT DISTINCT doc_id, item_id, i FROM x JOIN y USING (g)),
o AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) > 12, true)::INT AS opens FROM m), r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run FROM o),
s AS (SELECT doc_id, item_id, run, max(i) + 12 - min(i) AS n FROM r GROUP BY ALL) SELECT doc_id, count(DISTINCT item_id) AS n_items, count(*) AS n_spans, sum(n)::BIGINT AS n_words FROM s GROUP BY 1
"""


def _look_sql(x: str) -> str:
    """The same look in SQL, as far as single signs go: for comparing with the skeletons."""
    pairs_of = {c: p for p, those in skeleton.LOOKALIKES.items() for c in those} | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    x = f"nfc_normalize(regexp_replace({x}, '[{INVISIBLE}]', '', 'g'))"
    x = "translate({}, '{}', '{}')".format(x, "".join(pairs_of).replace("'", "''"), "".join(pairs_of.values()).replace("'", "''"))
    for code in [*range(0xFB00, 0xFB05), *range(0x2160, 0x2180), 0x2026, 0x2116]:
        x = f"replace({x}, '{chr(code)}', '{unicodedata.normalize('NFKD', chr(code))}')"
    # Composed letters whose base has a look-alike meet in their decomposed form.
    for base, mark, whole in (("е", "̈", "ё"), ("Е", "̈", "Ё"), ("и", "̆", "й"), ("И", "̆", "Й")):
        x = f"replace({x}, '{whole}', '{pairs_of.get(base, base)}{mark}')"
    return rf"trim(regexp_replace(nfc_normalize({x}), '[\p{{Z}}\t\r]+', ' ', 'g'))"


SQL["p5_found"] = f"""
SELECT DISTINCT b.doc_id, b.block_id FROM blocks b JOIN extracted_blocks e USING (doc_id, block_id) WHERE b.text <> e.text AND {_look_sql("b.text")} = {_look_sql("e.text")}
"""

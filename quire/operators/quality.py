"""Checks of source and target pairs: rule flags, consistency flags, their counts.

Pairs have ``id, source_text, target_text``. Null texts count as empty; repeated ids are checked each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .memory import containment, exact_terms

SEVERITY = {
    "missing_translation": "high", "empty_translation": "high", "footnote_marker_missing": "high", "footnote_count_mismatch": "medium", "number_missing": "medium",
    "link_missing": "high", "date_missing": "medium", "formula_content_missing": "medium",
}


def _missing(values: Column, target: Column) -> Column:
    return F.filter(values, lambda v: ~F.contains(target, v))


def pair_flags(pairs: DataFrame, markers: Column | None = None) -> DataFrame:
    """id, rule_id, severity, details for every rule that a pair breaks.

    A null target is a missing translation, a blank one an empty translation; the other rules look
    for what the target lost of the source: note markers, figures, links, dates, equations.
    """
    t, given = X.text("target_text"), F.col("target_text").isNotNull()
    marks = F.array_distinct(X.found("source_text", X.MARKER, 1)) if markers is None else markers
    said = given & (X.strip("target_text") != "")
    base = pairs.select("id", "source_text", "target_text", marks.alias("marks"))
    lost_marks, seen = _missing(F.col("marks"), t), F.aggregate("marks", F.lit(0), lambda n, m: n + F.floor((F.length(t) - F.length(F.replace(t, m, F.lit("")))) / F.length(m)).cast("int"))
    lost = {
        "footnote_marker_missing": lost_marks, "number_missing": _missing(X.numbers("source_text"), t), "link_missing": _missing(X.links("source_text"), t),
        "date_missing": F.filter(X.dates("source_text"), lambda d: ~X.date_supported(d, t)), "formula_content_missing": F.filter(X.equations("source_text"), lambda e: ~X.equation_supported(e, t)),
    }
    caps = {"footnote_marker_missing": 50, "number_missing": 12, "link_missing": 8, "date_missing": 8, "formula_content_missing": 8}
    flag = lambda rule, test, details: F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(SEVERITY[rule]).alias("severity"), details.alias("details")))
    rules = [
        flag("missing_translation", ~given, F.lit("")), flag("empty_translation", given & ~said, F.lit("")),
        flag("footnote_count_mismatch", said & (F.size("marks") > 0) & (seen != F.size("marks")), F.concat_ws("/", F.size("marks").cast("string"), seen.cast("string"))),
        *[flag(rule, said & (F.size(values) > 0), F.array_join(F.slice(values, 1, caps[rule]), ";")) for rule, values in lost.items()],
    ]
    return base.select("id", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("id", "f.*")


def flag_counts(flags: DataFrame, by: str = "rule_id") -> DataFrame:
    """Counts by rule or severity."""
    return flags.groupBy(by).agg(F.count("*").alias("n"))


def stable_expressions(pairs: DataFrame) -> DataFrame:
    """source, n_targets, n_pairs for normalised sources with two or more different targets."""
    keyed = pairs.select(X.normalize("source_text").alias("source"), X.normalize("target_text").alias("target")).where("source <> '' and target <> ''")
    return keyed.groupBy("source").agg(F.countDistinct("target").alias("n_targets"), F.count("*").alias("n_pairs")).where("n_targets > 1")


def words(c: str) -> Column:
    return F.greatest(F.lit(1), F.size(X.found(c, r"\S+")))


def literalness(pairs: DataFrame, low: float = 0.45, high: float = 2.2) -> DataFrame:
    """id, ratio of target to source words where it is out of bounds."""
    ratio = words("target_text") / words("source_text")
    return pairs.select("id", ratio.alias("ratio")).where((F.col("ratio") < low) | (F.col("ratio") > high))


def names_missing(pairs: DataFrame) -> DataFrame:
    """id, name: capitalised names of the source that the target lacks, one row per occurrence."""
    t = X.normalize("target_text")
    return pairs.select("id", t.alias("t"), F.explode(X.found("source_text", X.NAME)).alias("name")).where(~F.col("name").isin(*X.STOP_NAMES) & ~F.contains(F.col("t"), F.lower("name"))).select("id", "name")


def term_conflicts(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, source_term, target_term where the source has the term and the target not its rendering.

    Containment is of the normalised text, so a term may lie inside a word.
    """
    terms = glossary.select(X.strip("source_term").alias("source_term"), X.strip("target_term").alias("target_term")).where("source_term <> '' and target_term <> ''").distinct()
    s, t = X.normalize("source_text"), X.normalize("target_text")
    base = pairs.select("id", s.alias("s"), t.alias("t"))
    hit = containment(base, "s", terms.withColumns({"a": X.normalize("source_term"), "b": X.normalize("target_term")}), "a")
    return hit.where(~F.contains(F.col("t"), F.col("b"))).select("id", "source_term", "target_term")


def consistency_flags(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, type, severity, details of all consistency checks."""
    row = lambda df, kind, severity, details: df.select("id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), details.alias("details"))
    uneven = pairs.select("id", X.normalize("source_text").alias("source")).join(stable_expressions(pairs), "source")
    out = row(term_conflicts(pairs, glossary), "terminology_conflict", "high", F.concat_ws(" -> ", "source_term", "target_term"))
    out = out.unionByName(row(uneven, "stable_expression_inconsistency", "medium", F.col("n_targets").cast("string")))
    out = out.unionByName(row(literalness(pairs), "literalness_drift", "medium", F.round("ratio", 3).cast("string")))
    return out.unionByName(row(names_missing(pairs), "name_consistency_warning", "low", F.col("name")))


def risk_candidates(pairs: DataFrame, flags: DataFrame, glossary: DataFrame, least_chars: int = 1200, least_terms: int = 4) -> DataFrame:
    """id of translated pairs worth a second look: flagged, two markers, an equation, long, or many glossary terms."""
    said = pairs.where(X.strip("target_text") != "")
    flagged = flags.where(F.col("severity").isin("medium", "high")).select("id").distinct()
    terms = exact_terms(said.select("id", F.col("source_text").alias("text")), glossary).groupBy("id").agg(F.countDistinct("term").alias("n_terms"))
    dense = (F.size(F.array_distinct(X.found("source_text", X.MARKER, 1))) >= 2) | (F.size(X.equations("source_text")) > 0) | (F.length(X.text("source_text")) >= least_chars) | (F.coalesce("n_terms", F.lit(0)) >= least_terms)
    return said.join(flagged.withColumn("f", F.lit(True)), "id", "left").join(terms, "id", "left").where(F.coalesce("f", F.lit(False)) | dense).select("id")

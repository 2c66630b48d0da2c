"""Complexity of texts and the tier they are routed to: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

FORMULA = r"[=+\-/*^%<>\[\]{}]"


def features(source: str = "source_text", refs: Column | None = None, hints: Column | None = None, odd: Column | None = None) -> dict[str, Column]:
    """The features of a text: n_chars, notes, rare, digits, formula, lists, table, odd."""
    t = X.text(source)
    inline = F.size(F.array_distinct(X.found(source, r"\[(?:\d+|\w+)\]")))
    return {
        "n_chars": F.length(t), "notes": inline if refs is None else F.greatest(inline, refs), "rare": X.rare_terms(source, hints),
        "digits": X.share_of(source, r"\d"), "formula": X.share_of(source, FORMULA), "lists": X.list_density(source),
        "table": F.contains(t, F.lit("|")) & F.contains(t, F.lit("\n")), "odd": F.lit(False) if odd is None else odd,
    }


def score() -> Column:
    """The weighted sum of the capped features, in [0, 1]."""
    c = F.col
    cap = lambda x: F.least(x, F.lit(1.0))
    total = (
        cap(c("n_chars") / F.lit(1800.0)) * 0.25 + cap(c("notes") / F.lit(4.0)) * 0.2 + cap(c("rare") / F.lit(8.0)) * 0.15 + cap((c("digits") + c("formula")) * 3.0) * 0.15
        + cap(c("lists") * 2.0 + F.when(c("table"), 0.5).otherwise(0.0)) * 0.15 + F.when(c("odd"), 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))


def risks() -> Column:
    c = F.col
    return F.concat_ws(
        ",", F.when(c("notes") > 0, "footnote_markers"), F.when(c("rare") >= 3, "terminology_dense"), F.when(c("digits") + c("formula") >= 0.12, "numeric_or_formula_dense"),
        F.when((c("lists") >= 0.25) | c("table"), "list_or_table_structure"), F.when(c("odd"), "layout_sensitive"),
    )


def assess(chunks: DataFrame, tier_b: float | Column = 0.34, tier_c: float | Column = 0.68) -> DataFrame:
    """``chunks`` with the features, ``score``, ``risks`` and ``tier`` A, B or C.

    A chunk of another kind than a paragraph group counts as odd in its layout.
    """
    odd = F.col("chunk_type") != "paragraph_group" if "chunk_type" in chunks.columns else None
    hints = F.col("hints") if "hints" in chunks.columns else None
    refs = F.col("n_refs") if "n_refs" in chunks.columns else None
    rated = chunks.withColumns(features(refs=refs, hints=hints, odd=odd)).withColumns({"score": score(), "risks": risks()})
    b, c = (F.lit(x) if isinstance(x, float) else x for x in (tier_b, tier_c))
    return rated.withColumn("tier", F.when(F.col("score") >= c, "C").when(F.col("score") >= b, "B").otherwise("A"))

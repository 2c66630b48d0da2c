"""Problem 5: one form for texts that look the same.

A confusables skeleton: decompose, replace every character by the prototype of its look-alikes,
decompose again. Texts that differ only in ways the reader cannot see have equal skeletons.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import INVISIBLE

#: Look-alike letters (fixed values): each prototype and the Cyrillic and Greek letters that share
#: its glyph in upright type. Pairs that only resemble each other (в and b, и and u, н and h) are out.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ѵν",
    "w": "ԝ", "x": "х", "y": "уү", "к": "κ", "Г": "Γ", "П": "Π", "Ф": "Φ", "Л": "Λ",
}
#: Compatibility mappings that change what the reader sees (raised, lowered, circled, squared, fractions).
VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
_DROP = re.compile(f"[{INVISIBLE}]+")
_BLANKS = re.compile(r"[^\S\n]+|[⠀ㅤﾠ]+")
_PROTOTYPE = {ord(c): p for p, those in LOOKALIKES.items() for c in those}


class _Decompose(dict):
    """Code point to its decomposition, filled on demand; look-alikes go to their prototype."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        mapping = unicodedata.decomposition(c)
        if mapping.startswith(VISIBLE_TAGS):
            out = c
        elif mapping.startswith("<") or not mapping:
            out = "".join(_PROTOTYPE.get(ord(x), x) for x in unicodedata.normalize("NFKD", c)) if mapping else _PROTOTYPE.get(code, c)
        else:
            out = "".join(self[ord(x)] for x in unicodedata.normalize("NFD", c))
        self[code] = out
        return out


_TABLE = _Decompose()


def skeleton(text: str | None) -> str | None:
    """The consistent form: no invisible characters, plain blanks, prototypes, canonical order of accents.

    Null stays null, a text of invisible characters becomes empty. Case, words, stops, quotation
    marks, dashes, accents and raised figures are kept; line ends stay, other runs of blanks
    become one space, and none is left at the ends.
    """
    if text is None:
        return None
    if text.isascii():
        out = text
    else:
        out = unicodedata.normalize("NFD", _DROP.sub("", text).translate(_TABLE))
    return _BLANKS.sub(" ", out).strip()


def _apply(frames: Iterator[pd.DataFrame], columns: dict[str, str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for out, column in columns.items():
            frame[out] = [skeleton(x) if isinstance(x, str) else None for x in frame[column]]
        yield frame


def consistent_texts(blocks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Both texts of every block in either table in their consistent form.

    Result: doc_id, block_id, form (of ``blocks.text``), extracted_form, same; a form is null where
    the table lacks the block or its text is null, and ``same`` is then null. A block delivered
    again counts once. Keys with a null part match nothing and are kept.
    """
    one = lambda t, name: t.groupBy("doc_id", "block_id").agg(F.max("text").alias(name))
    both = one(blocks, "text").join(one(extracted, "other"), ["doc_id", "block_id"], "full")
    return both.mapInPandas(
        lambda frames: (f[["doc_id", "block_id", "form", "extracted_form"]] for f in _apply(frames, {"form": "text", "extracted_form": "other"})),
        "doc_id string, block_id string, form string, extracted_form string",
    ).withColumn("same", F.col("form") == F.col("extracted_form"))


def lookalike_blocks(blocks: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, block_id) of blocks whose two texts differ in code points but have equal skeletons.

    Only pairs of unequal texts reach Python. Null texts, blocks in one table only and null keys
    give no row; deliveries and repeated rows count once.
    """
    left = blocks.where("text is not null").select("doc_id", "block_id", "text")
    right = extracted.where("text is not null").select("doc_id", "block_id", F.col("text").alias("other"))
    apart = left.join(right, ["doc_id", "block_id"]).where("text <> other")
    return (
        apart.mapInPandas(lambda frames: (f.loc[f.form == f.extracted_form, ["doc_id", "block_id"]] for f in _apply(frames, {"form": "text", "extracted_form": "other"})), "doc_id string, block_id string")
        .distinct()
    )


def skeleton_groups(texts: DataFrame) -> DataFrame:
    """Groups of originals by equal skeleton: ``texts(id, text)`` to skeleton, n_forms, n_rows, for skeletons with two or more forms."""
    forms = texts.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    out = forms.mapInPandas(lambda frames: (f[["form", "n"]] for f in _apply(frames, {"form": "text"})), "form string, n bigint")
    return out.groupBy(F.col("form").alias("skeleton")).agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_rows")).where("n_forms > 1")

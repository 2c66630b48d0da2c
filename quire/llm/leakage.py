"""Problem 8: passages of held-out items inside a training corpus.

One FM-index per shard of the corpus; the item phrases are searched backward in it, the
occurrences located by sampled suffix positions and merged into removal spans. A document
lies whole in one shard and shards follow the input splits, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .fmindex import FMIndex
from .text import words

SPANS = "doc_id bigint, item_id bigint, start_word int, end_word int"


class Phrases:
    """Distinct windows of ``min_words`` words of the items, as rows of symbols.

    Symbol 1 stands for any word that is in no item (and for the gap between documents); it is
    in no phrase, so runs of it are stored once.
    """

    def __init__(self, items: list[tuple[int, str | None]], min_words: int) -> None:
        self.symbol: dict[str, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words(text)]
            for i in range(len(ids) - min_words + 1):
                rows.setdefault(tuple(ids[i : i + min_words]), set()).add(item)
        self.width = min_words
        self.windows = np.array(list(rows), np.int64).reshape(len(rows), min_words)
        of = [sorted(v) for v in rows.values()]
        self.owners = np.array([i for v in of for i in v], np.int64)
        self.owned = np.concatenate([[0], np.cumsum([len(v) for v in of], dtype=np.int64)])
        self.symbols = len(self.symbol) + 2


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and value, for every value of every range."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


def _shard(docs: list[int], seqs: list[np.ndarray], places: list[np.ndarray], p: Phrases, sample: int) -> pd.DataFrame:
    text, place = np.concatenate(seqs), np.concatenate(places)
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in seqs])
    index = FMIndex(text, p.symbols, sample)
    low, high = index.search(p.windows)
    phrase, row = _ranges(low, high)
    at = index.locate(row)
    which, owned = _ranges(p.owned[phrase], p.owned[phrase + 1])
    frame = pd.DataFrame({"doc": owner[at[which]], "item_id": p.owners[owned], "start": place[at[which]]})
    frame = frame.sort_values(["doc", "item_id", "start"], ignore_index=True)
    # Overlapping or touching windows of one item in one document become one span.
    same = (frame.doc.diff() == 0) & (frame.item_id.diff() == 0) & (frame.start.diff() <= p.width)
    spans = frame.groupby((~same).cumsum()).agg(doc=("doc", "first"), item_id=("item_id", "first"), start_word=("start", "min"), last=("start", "max"))
    ids = np.array(docs, np.int64)
    return pd.DataFrame({"doc_id": ids[spans.doc.to_numpy(np.int64)], "item_id": spans.item_id.to_numpy(np.int64), "start_word": spans.start_word.to_numpy(np.int32), "end_word": (spans["last"] + p.width).to_numpy(np.int32)})


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``block_chars`` characters, one at a time on the driver; each whole in one block."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = 12, shard_tokens: int = 600_000, sample: int = 16, block_chars: int = 20_000_000) -> DataFrame:
    """Spans of ``documents(doc_id, text)`` that repeat ``min_words`` or more words of an item in a row.

    ``items(item_id, text)`` is the held-out set; it is sent to the workers in blocks of about
    ``block_chars`` characters, and each block searched in all documents, so that a set of any size is
    searched whole and no block grows with it.
    Words are compared without regard to case, compatibility forms, invisible characters,
    punctuation and white space. Result: doc_id, item_id, start_word, end_word (half open word
    numbers within the document), one row per maximal span of an item.
    Null or empty texts, items under ``min_words`` words and empty tables give no rows; a
    repeated document row gives its spans again; other columns are not read.
    """
    out = None
    for block in _blocks(items, block_chars):
        one = _leaked(documents, Phrases(block, min_words), min_words, shard_tokens, sample)
        out = one if out is None else out.unionByName(one)
    return documents.sparkSession.createDataFrame([], SPANS) if out is None else out


def _leaked(documents: DataFrame, phrases: Phrases, min_words: int, shard_tokens: int, sample: int) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(phrases.windows):
            return
        get = phrases.symbol.get
        docs, seqs, places, size = [], [], [], 0
        for frame in frames:
            for doc, text in zip(frame.doc_id, frame.text):
                ids = np.array([get(w, 1) for w in words(text)] + [1], np.int64)
                keep = np.flatnonzero((ids != 1) | (np.append(0, ids[:-1]) != 1))
                if len(keep) <= min_words:
                    continue
                docs.append(doc)
                seqs.append(ids[keep])
                places.append(keep)
                size += len(keep)
                if size >= shard_tokens:
                    yield _shard(docs, seqs, places, phrases, sample)
                    docs, seqs, places, size = [], [], [], 0
        if docs:
            yield _shard(docs, seqs, places, phrases, sample)

    return spread(documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0")).mapInPandas(search, SPANS)


def leaked_documents(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """One row per leaking document and item: (item_id, doc_id)."""
    return leaked_spans(documents, items, **options).select("item_id", "doc_id").distinct()


def leakage_report(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """Per document: how many items leaked into it, in how many spans, and how many words those spans hold."""
    return (
        leaked_spans(documents, items, **options)
        .groupBy("doc_id")
        .agg(F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_spans"), F.sum(F.col("end_word") - F.col("start_word")).cast("bigint").alias("n_words"))
    )

"""Problem 10: long exact spans shared between records.

Seed and extend: every window of ``min_chars`` code points holds at least one winnowed anchor,
so records sharing such a span share an anchor. Anchors are joined, the matches extended both
ways by their surroundings, and the maximal repeats of the required length kept. Records with equal
texts are searched once and expanded afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut, spread
from .filters import bitmap, held

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hasher:
    """Hashes of all k-grams of a text: prefix sums of a polynomial, normalised by position."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 12)

    def grams(self, text: np.ndarray, k: int) -> np.ndarray:
        n = len(text)
        if n < k:
            return np.empty(0, np.uint64)
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        # A mixed value per code point, so that the sums depend on all bits of it.
        value = (text.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(29)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.up[:n], out=sums[1:])
        out = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        out ^= out >> np.uint64(31)
        out *= _MIX
        return out ^ (out >> np.uint64(30))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of every run of ``window`` hashes."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    window = min(window, n)
    # Sliding minimum by doubling.
    low, size = hashes, 1
    while 2 * size <= window:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = window - size
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    # A position is an anchor if it holds the minimum of a run it lies in: the runs that start
    # at most window - 1 before it. Equal hashes all count, so ties lose nothing.
    keep = np.zeros(n, bool)
    starts = np.arange(len(low))
    change = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    first, last = starts[change], np.append(change[1:], len(low)) - 1
    for value, a, b in zip(low[change], first, last):
        part = hashes[a : b + window]
        keep[a : b + window] |= part == value
    return np.flatnonzero(keep)


def _pieces(documents: DataFrame, min_chars: int, k: int) -> DataFrame:
    """(doc_id, text_key, at, hashes): the winnowed k-grams of every text of ``min_chars`` code points or more, and a 128-bit key of the text."""
    window = min_chars - k + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            keys, places, values = [], [], []
            for text in frame.text:
                hashes = hasher.grams(_code_points(text), k)
                at = winnow(hashes, window)
                keys.append(_text_key(text))
                places.append(at.astype(np.int32))
                values.append(hashes[at].view(np.int64))
            yield pd.DataFrame({"doc_id": frame.doc_id, "text_key": keys, "at": places, "hashes": values})

    long = documents.select("doc_id", "text").where("doc_id is not null").where(F.length("text") >= min_chars)
    return spread(long).mapInPandas(run, "doc_id bigint, text_key binary, at array<int>, hashes array<bigint>")


def _text_key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def anchors(documents: DataFrame, min_chars: int, k: int) -> DataFrame:
    """(doc_id, pos, hash) of the winnowed k-grams."""
    return _flat(_pieces(documents, min_chars, k))


def _flat(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", F.explode(F.arrays_zip("at", "hashes")).alias("z")).select("doc_id", F.col("z.at").alias("pos"), F.col("z.hashes").alias("hash"))


def _contexts(texts: DataFrame, k: int, reach: int) -> DataFrame:
    """(doc_id, pos, hash, n, seal, before, after): an anchor's second hash, and up to ``reach`` code points on both sides, those before it turned round.

    ``texts(doc_id, text_key, marks, text)``; a row whose text is not that of its key gives nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, key, marks, text in zip(f.doc_id, f.text_key, f.marks, f.text):
                if _text_key(text) == bytes(key):
                    for m in marks:
                        i = m["pos"]
                        rows.append((doc, i, m["hash"], m["n"], xxhash.xxh3_64_intdigest(text[i : i + k].encode("utf-8", "surrogatepass")) - (1 << 63), text[max(0, i - reach) : i][::-1], text[i + k : i + k + reach]))
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "hash", "n", "seal", "before", "after"])

    return texts.select("doc_id", "text_key", "marks", "text").mapInPandas(run, "doc_id bigint, pos int, hash bigint, n bigint, seal bigint, before string, after string")


def _common(a: pd.Series, b: pd.Series, reach: int) -> np.ndarray:
    """How many leading code points the strings of two columns, of at most ``reach`` code points each, share."""

    def grid(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        n = texts.str.len().to_numpy(np.int64)
        return _code_points("".join(texts.str.ljust(reach, "\0"))).reshape(len(texts), reach), n

    (x, n), (y, m) = grid(a), grid(b)
    unlike = np.append(x != y, np.ones((len(x), 1), bool), 1)
    return np.minimum(unlike.argmax(1), np.minimum(n, m))


def _meetings(live: DataFrame, block: int) -> DataFrame:
    """All pairs of ``live`` rows of one hash and seal in different texts, doc_a < doc_b.

    ``n`` is how often the hash occurs. A hash of many texts is split into blocks of about ``block`` texts, and every two of its blocks meet
    in a cell of their own, so that no task has all pairs of a passage.
    """
    parts = F.ceil(F.col("n") / block).cast("int")
    placed = live.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda name, x, y: placed.select("hash", "seal", x.alias("x"), y.alias("y"), *[F.col(c).alias(f"{c}_{name}") for c in ("doc_id", "pos", "before", "after")])
    a, b = side("a", F.col("own"), all_parts), side("b", all_parts, F.col("own"))
    return a.join(b, ["hash", "seal", "x", "y"]).where("doc_id_a < doc_id_b")


def shared_spans(documents: DataFrame, min_chars: int = 300, k: int = 240, block: int = 256) -> DataFrame:
    """Maximal stretches of at least ``min_chars`` equal code points in two different texts.

    ``documents(doc_id bigint, text)``. Result: doc_a < doc_b, start_a, start_b, n_chars, over one
    document per distinct text (the smallest id); ``text_classes`` has the others. Every pair of
    texts that share such a stretch is found: anchors lie at most ``min_chars - k`` apart, and
    ``k`` is close to ``min_chars`` so that shorter boilerplate makes no candidates.

    Extension needs no whole texts: within a shared stretch both texts have the same anchors, at most
    ``reach`` = min_chars - k + 1 places apart, so that the stretch goes from anchor to anchor and ends
    less than ``reach`` behind the last. Texts are read once for the anchors, and those with an anchor
    that another text has once more for the anchors' surroundings.
    Null, empty and short texts have no spans. Repeated rows count once. Other columns are not read.
    """
    return _spans(documents, cut(_pieces(documents, min_chars, k)), min_chars, k, block)


def _spans(documents: DataFrame, pieces: DataFrame, min_chars: int, k: int, block: int) -> DataFrame:
    reach = min_chars - k + 1
    reps = pieces.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    own = pieces.dropDuplicates(["doc_id", "text_key"]).join(reps, ["text_key", "doc_id"])
    marks = own.select("doc_id", "text_key", F.explode(F.arrays_zip("at", "hashes")).alias("z")).select("doc_id", "text_key", F.col("z.at").alias("pos"), F.col("z.hashes").alias("hash"))
    sizes = marks.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("hash", "n")
    live = cut(marks.join(sizes, "hash").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "hash", "n")).alias("marks")))
    texts = documents.where("doc_id is not null").where(F.length("text") >= min_chars).select("doc_id", "text").where(held(bitmap(live.select("doc_id"), "doc_id"), "doc_id"))
    met = _meetings(cut(_contexts(live.join(texts, "doc_id"), k, reach)), block)

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_a": f.doc_id_a, "doc_b": f.doc_id_b, "pos": f.pos_a, "shift": f.pos_b - f.pos_a, "left": _common(f.before_a, f.before_b, reach).astype(np.int32), "right": _common(f.after_a, f.after_b, reach).astype(np.int32)})

    seeds = met.mapInPandas(extend, "doc_a bigint, doc_b bigint, pos int, shift int, left int, right int")
    # The anchors of a stretch in a row: each lies within what the one before extends to. Repeated rows change nothing.
    line = W.partitionBy("doc_a", "doc_b", "shift").orderBy("pos")
    opens = (F.col("pos") > F.lag(F.col("pos") + F.col("right")).over(line)) | F.lag("pos").over(line).isNull()
    runs = seeds.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(line))
    ends = runs.groupBy("doc_a", "doc_b", "shift", "run").agg(F.min(F.col("pos") - F.col("left")).alias("start_a"), F.max(F.col("pos") + k + F.col("right")).alias("end_a"))
    long = ends.where(F.col("end_a") - F.col("start_a") >= min_chars)
    return long.select("doc_a", "doc_b", "start_a", (F.col("start_a") + F.col("shift")).alias("start_b"), (F.col("end_a") - F.col("start_a")).alias("n_chars"))


def text_classes(documents: DataFrame) -> DataFrame:
    """(rep, doc_id): the members of each class of equal texts, the representative included."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars")).distinct()
    reps = rows.groupBy("text_hash").agg(F.min("doc_id").alias("rep"))
    return rows.join(reps, "text_hash").select("rep", "doc_id", "n_chars")


def shared_pairs(documents: DataFrame, min_chars: int = 300, k: int = 240, block: int = 256) -> DataFrame:
    """All pairs doc_a < doc_b of documents that share a stretch of ``min_chars`` code points, equal texts included.

    The pairs of ``shared_spans`` and, by their text's key, those of its copies: the result is quadratic in
    the copies of a text, as it must list them. ``text_classes`` and ``shared_share`` do without.
    """
    pieces = cut(_pieces(documents, min_chars, k))
    spans = _spans(documents, pieces, min_chars, k, block).select("doc_a", "doc_b").distinct()
    members = pieces.select("text_key", "doc_id").distinct()
    sizes = members.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    many = members.join(sizes.where("n > 1"), "text_key").select("rep", F.col("doc_id").alias("doc"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    # Most texts are alone and stand for themselves; only copied ones are expanded.
    of = lambda side: many.select(F.col("rep").alias(f"doc_{side}"), F.col("doc").alias(f"copy_{side}"))
    apart = spans.join(of("a"), "doc_a", "left").join(of("b"), "doc_b", "left").select(F.coalesce("copy_a", "doc_a").alias("x"), F.coalesce("copy_b", "doc_b").alias("y"))
    placed = many.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    cells = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left, right = placed.select("rep", F.col("own").alias("i"), cells.alias("j"), F.col("doc").alias("x")), placed.select("rep", cells.alias("i"), F.col("own").alias("j"), F.col("doc").alias("y"))
    same = left.join(right, ["rep", "i", "j"]).where("x < y").select("x", "y")
    return apart.unionByName(same).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_share(documents: DataFrame, min_chars: int = 300, k: int = 240) -> DataFrame:
    """Per document: how many of its code points stand in a long stretch that also occurs elsewhere.

    Linear in the text even where one passage stands in a third of all records: no pairs are made.
    The windows of ``min_chars`` code points around the anchors that occur in two or more
    documents are hashed, the hashes counted over documents, and the windows that recur laid over
    each document. Result: doc_id, n_chars, n_shared, share. Documents under ``min_chars`` code
    points, null and empty texts have a share of 0; equal texts share all of themselves;
    repeated rows of one doc_id count once.
    """
    own = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    marks = cut(anchors(own, min_chars, k))
    live = marks.join(marks.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash"), "hash")
    spots = live.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    reach = min_chars - k

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            for doc, text, at in zip(frame.doc_id, frame.text, frame["at"]):
                hashes = hasher.grams(_code_points(text), min_chars)
                keep = np.zeros(len(hashes), bool)
                for i in at:
                    keep[max(0, i - reach) : i + 1] = True
                where = np.flatnonzero(keep)
                yield pd.DataFrame({"doc_id": np.full(len(where), doc, np.int64), "pos": where.astype(np.int32), "hash": hashes[where].view(np.int64)})

    seen = cut(own.join(spots, "doc_id").mapInPandas(windows, "doc_id bigint, pos int, hash bigint"))
    again = seen.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash")
    places = seen.join(again, "hash").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + F.lit(min_chars) - F.greatest(F.lit(0), s["end"] - p)).alias("n"), (p + F.lit(min_chars)).alias("end")),
        lambda s: s["n"],
    )
    sizes = own.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    out = sizes.join(places.select("doc_id", covered.alias("n_shared")), "doc_id", "left").fillna(0, ["n_shared"])
    return out.select("doc_id", "n_chars", "n_shared", F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))

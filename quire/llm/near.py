"""Problem 1: near-duplicate records with small edits.

Records are compared by their distinct pairs of adjacent words. Shards of BK-trees over bit
sketches of minimum hashes give the candidates: a tree holds the records that agree in one band
of minima, and a search follows the edges within the radius that the threshold allows. Every
candidate is then verified on the exact sets. Records with equal sets are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .bktree import Forest
from .minhash import WordHashes, bands, shingles, signatures
from .text import WORD

_ROWS, _BANDS, _BITS = 4, 28, 160
_ENTRY = np.dtype([("key", "<u8"), ("w0", "<u8"), ("w1", "<u8"), ("w2", "<u4"), ("set", "<u8")])
#: Entries that a shard is to have; the number of shards follows the number of records.
_SHARD = 250_000


def _sketches(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of every minimum and the next bit of the first 64, as 160 bits in three words."""
    low = (signature & np.uint64(1)).astype(np.uint8)
    high = (signature[:, : _BITS - signature.shape[1]] >> np.uint64(1) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(np.concatenate([low, high], 1), axis=1, bitorder="little")
    out = np.zeros((len(packed), 24), np.uint8)
    out[:, :20] = packed
    return out.view(np.uint64)


class Batch:
    """Sets, minima and sketches of a batch of texts; short texts are left out."""

    def __init__(self, recs: list[str], texts: list[str | None], min_words: int, hashes: WordHashes) -> None:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        self.recs = [r for r, w in zip(recs, words) if len(w) >= min_words]
        self.values, self.bounds = shingles([w for w in words if len(w) >= min_words], 2, hashes)
        self.n = np.diff(self.bounds)

    def grams(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    def signatures(self) -> np.ndarray:
        return signatures(self.values, self.bounds, _ROWS * _BANDS)


def _entries(min_words: int, parts: int):
    """Rows (part, blob): the entries (band key with size, sketch) of a batch, by the shard of their key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for frame in frames:
            batch = Batch(frame.rec.tolist(), frame.text.tolist(), min_words, hashes)
            if not batch.recs:
                continue
            # Copies meet here first: a set that this task has sent is not sent again.
            fresh, sets = [], []
            for i in range(len(batch.recs)):
                h = xxhash.xxh64_intdigest(batch.grams(i).tobytes())
                if h not in seen:
                    seen.add(h)
                    fresh.append(i)
                    sets.append(h)
            if len(seen) > 2_000_000:
                seen.clear()
            fresh = np.array(fresh, np.int64)
            if not len(fresh):
                continue
            signature = batch.signatures()[fresh]
            points, size = _sketches(signature), np.minimum(batch.n[fresh], 65535).astype(np.uint64)
            key = bands(signature, _ROWS)
            entries = np.empty(key.size, _ENTRY)
            entries["key"] = (key & ~np.uint64(0xFFFF) | size[:, None]).ravel()
            for j, name in enumerate(("w0", "w1", "w2")):
                entries[name] = np.repeat(points[:, j], _BANDS)
            entries["set"] = np.repeat(np.array(sets, np.uint64), _BANDS)
            part = (key >> np.uint64(40)).ravel() % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(at))
            yield pd.DataFrame({"part": some.astype(np.int32), "blob": [entries[at[p] : at[p + 1]].tobytes() for p in some]})

    return run


def _points(entries: np.ndarray) -> np.ndarray:
    return np.stack([entries["w0"], entries["w1"], entries["w2"].astype(np.uint64)], 1)


def _pairs(entries: np.ndarray, others: np.ndarray, root: np.ndarray, forest: Forest, radius: int, least: float, same: bool) -> pd.DataFrame:
    """Candidate pairs of sets, each once, within the radius and with sizes that can reach the threshold."""
    size, other_size = ((x["key"] & np.uint64(0xFFFF)).astype(np.float64) for x in (entries, others))
    found = []
    for q, node in forest.search(_points(others), root, radius):
        ok = np.minimum(other_size[q], size[node]) >= least * np.maximum(other_size[q], size[node])
        if same:
            ok &= q < node
        a, b = others["set"][q[ok]], entries["set"][node[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _starts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every entry of a sorted array, where each bucket begins, and how many it has."""
    bucket = entries["key"] >> np.uint64(16)
    first = np.ones(len(entries), bool)
    first[1:] = bucket[1:] != bucket[:-1]
    starts = np.flatnonzero(first)
    return bucket, starts, np.diff(np.append(starts, len(entries)))


def _shards(radius: int, least: float, hot: int, held: int = 2 * _SHARD):
    """Search the trees of a shard; buckets above ``hot`` members come out as chunks instead, to be searched in cells.

    A shard has about ``_SHARD`` entries, as there are shards enough; what can make it larger is a hot
    bucket. Beyond ``held`` entries the members of hot buckets leave as chunks before more is taken in,
    and later members of these buckets follow them. The last chunk of a bucket tells their number.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks: dict[int, int] = {}

        def leave(entries: np.ndarray) -> tuple[list[pd.DataFrame], np.ndarray]:
            bucket, starts, n = _starts(entries)
            out, keep = [], np.ones(len(entries), bool)
            leaving = n > hot
            if chunks:
                leaving |= np.isin(bucket[starts], np.fromiter(chunks, np.uint64, len(chunks)))
            for start, k in zip(starts[leaving], n[leaving]):
                key = int(bucket[start])
                keep[start : start + k] = False
                for at in range(start, start + k, hot):
                    chunks[key] = chunks.get(key, -1) + 1
                    out.append(pd.DataFrame({"a": [np.int64(key)], "b": [np.int64(chunks[key])], "blob": [entries[at : min(at + hot, start + k)].tobytes()]}))
            return out, entries[keep]

        blobs: list[bytes] = []
        size = 0
        for frame in frames:
            blobs += frame.blob.tolist()
            size += sum(map(len, frame.blob)) // _ENTRY.itemsize
            if size > held:
                out, entries = leave(np.unique(np.frombuffer(b"".join(blobs), _ENTRY)))
                yield from out
                blobs, size = [entries.tobytes()], 0
        entries = np.unique(np.frombuffer(b"".join(blobs), _ENTRY))
        if not len(entries):
            return
        out, entries = leave(entries)
        yield from out
        if chunks:
            yield pd.DataFrame({"a": np.fromiter(chunks, np.int64, len(chunks)), "b": np.fromiter(chunks.values(), np.int64, len(chunks)) + 1, "blob": b""})
        bucket, _, n = _starts(entries)
        keep = np.repeat(n > 1, n)
        entries, bucket = entries[keep], bucket[keep]
        if len(entries):
            forest = Forest(_points(entries), bucket)
            yield _pairs(entries, entries, forest.root, forest, radius, least, True).assign(blob=None)

    return run


def _cells(radius: int, least: float):
    """Search chunks of hot buckets against each other: rows (own, other, i, j) with i <= j."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                a, b = np.frombuffer(r.own, _ENTRY), np.frombuffer(r.other, _ENTRY)
                forest = Forest(_points(a), np.zeros(len(a), np.int64))
                yield _pairs(a, b, np.zeros(len(b), np.int64), forest, radius, least, r.i == r.j)

    return run


def _sets(min_words: int, bits: np.ndarray):
    """Rows (rec, set_hash, grams): the set only where the bitmap says that it may have a candidate. No minima are needed again."""
    mask = np.uint64(len(bits) * 64 - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            batch = Batch(frame.rec.tolist(), frame.text.tolist(), min_words, hashes)
            if not batch.recs:
                continue
            raw = [batch.grams(i).tobytes() for i in range(len(batch.recs))]
            sets = np.array([xxhash.xxh64_intdigest(x) for x in raw], np.uint64)
            slot = sets & mask
            wanted = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield pd.DataFrame({"rec": batch.recs, "set_hash": sets.view(np.int64), "grams": [x if w else None for x, w in zip(raw, wanted)]})

    return run


def _bitmap(sets: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` over the low bits of the set hashes: bounded, whatever the data, and without misses."""
    low = F.col("id").bitwiseAND((1 << bits) - 1)
    words = sets.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, int(id & 63))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    frame = words.toPandas()
    out[frame["word"].to_numpy()] = frame["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _candidates(texts: DataFrame, n_records: int, min_words: int, threshold: float, deviations: float, hot: int) -> DataFrame:
    """(a, b): distinct pairs of set hashes that may reach the threshold's similarity."""
    # Shards by the number of records: a shard keeps its size as the data grow.
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_records * _BANDS // _SHARD))
    # Bits of the sketches differ with (1 - J) / 2 each.
    p = (1 - threshold) / 2
    radius = int(_BITS * p + deviations * (_BITS * p * (1 - p)) ** 0.5)
    blobs = spread(texts).mapInPandas(_entries(min_words, parts), "part int, blob binary").repartitionById(parts, "part")
    found = cut(blobs.mapInPandas(_shards(radius, threshold, hot), "a bigint, b bigint, blob binary"))
    # Cells are counted out of one narrow row per hot bucket; the chunks then meet by (bucket, number), never all of a bucket at once.
    chunks = found.where("length(blob) > 0").select("a", "b", "blob")
    firsts = found.where("length(blob) = 0").select("a", F.col("b").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1)).alias("i"))
    cells = firsts.repartition("a", "i").select("a", "i", F.explode(F.sequence("i", F.col("n") - 1)).alias("j"))
    full = cells.join(chunks.select("a", F.col("b").alias("i"), F.col("blob").alias("own")), ["a", "i"]).join(chunks.select("a", F.col("b").alias("j"), F.col("blob").alias("other")), ["a", "j"])
    across = full.select("i", "j", "own", "other").mapInPandas(_cells(radius, threshold), "a bigint, b bigint")
    return found.where("blob is null").select("a", "b").union(across).distinct()


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(set_a, set_b): different sets, candidates of each other, whose similarity reaches the threshold."""
    one = sets.where("grams is not null").groupBy("set_hash").agg(F.first("grams").alias("grams"))
    a, b = one.select(F.col("set_hash").alias("a"), F.col("grams").alias("grams_a")), one.select(F.col("set_hash").alias("b"), F.col("grams").alias("grams_b"))
    rows = candidates.join(a, "a").join(b, "b").select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "grams_a", "grams_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = np.zeros(len(f), bool)
            for i, (x, y) in enumerate(zip(f.grams_a, f.grams_b)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            yield f.loc[keep, ["set_a", "set_b"]]

    return rows.mapInPandas(run, "set_a bigint, set_b bigint")


def _near(records: DataFrame, threshold: float, min_words: int, deviations: float, hot: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Members (rec, set_hash) and links (set_a, set_b) between different sets."""
    texts = records.where("rec is not null and text is not null").select("rec", "text")
    # Counting rows reads no column, only the files' footers.
    candidates = cut(_candidates(texts, records.count(), min_words, threshold, deviations, hot))
    bitmap = _bitmap(candidates.select(F.explode(F.array("a", "b")).alias("id")), bits)
    sets = cut(spread(texts).mapInPandas(_sets(min_words, bitmap), "rec string, set_hash bigint, grams binary"))
    return sets.select("rec", "set_hash").distinct(), cut(_verified(candidates, sets, threshold))


def near_pairs(records: DataFrame, threshold: float = 0.6, min_words: int = 12, deviations: float = 3.2, hot: int = 4096, bits: int = 23) -> DataFrame:
    """Pairs rec_a < rec_b of ``records(rec string, text)`` with at least ``threshold`` similarity.

    Similarity is that of the distinct pairs of adjacent words (lower case, runs of letters and
    digits); records under ``min_words`` words, null and empty texts have no pairs; a record
    delivered again counts once; copies are pairs.
    The bands, not the trees, bound the recall: a tree holds the records of one band's bucket, so two
    records meet in a tree only if they agree in one of the bands. That finds a pair at exactly 0.6
    with a probability of 0.98 and at 0.7 with 0.9995; the trees' radius loses less than one in a
    thousand at the threshold. Every pair that comes out has been verified on the whole sets.
    """
    members, links = _near(records, threshold, min_words, deviations, hot, bits)
    a, b = members.select(F.col("set_hash").alias("set_a"), F.col("rec").alias("x")), members.select(F.col("set_hash").alias("set_b"), F.col("rec").alias("y"))
    apart = links.join(a, "set_a").join(b, "set_b").select("x", "y")
    same = a.join(b.withColumnRenamed("set_b", "set_a"), "set_a").where("x < y").select("x", "y")
    return apart.union(same).where("x <> y").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def near_records(records: DataFrame, threshold: float = 0.6, min_words: int = 12, deviations: float = 3.2, hot: int = 4096, bits: int = 23) -> DataFrame:
    """One row per record with its class of equal sets and its links, without expanding copies into pairs.

    Result: rec, class (the smallest record with an equal set), n_copies (the others in the class),
    n_links (records in other classes whose sets reach the threshold).
    """
    members, links = _near(records, threshold, min_words, deviations, hot, bits)
    classes = members.groupBy("set_hash").agg(F.min("rec").alias("class"), F.count("*").alias("n"))
    both = links.union(links.select("set_b", "set_a")).toDF("set_hash", "other")
    linked = both.join(classes.select(F.col("set_hash").alias("other"), F.col("n").alias("k")), "other").groupBy("set_hash").agg(F.sum("k").alias("n_links"))
    return members.join(classes, "set_hash").join(linked, "set_hash", "left").select("rec", "class", (F.col("n") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

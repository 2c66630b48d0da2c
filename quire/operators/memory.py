"""Glossary and translation memory: containment, fuzzy terms, exact and near matches, look-ups."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

try:
    import ahocorasick
except ImportError:  # lists of terms are joined then, of whatever length
    ahocorasick = None

from ..functions import similarity as S
from ..functions import text as X
from ..session import cut


def bounded(df: DataFrame, most: int, what: str) -> list:
    """All rows on the driver, refused beyond ``most``: nothing is dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {what}")
    return rows


def containment(texts: DataFrame, text: str, terms: DataFrame, term: str, matched_terms: int = 20_000) -> DataFrame:
    """Pairs of texts and terms where the term lies in the text, as a substring (J04). Empty terms lie nowhere.

    Up to ``matched_terms`` different terms make one automaton per task that finds all of them in one pass over
    a text. A larger list is joined on the first one to four characters of the terms with the distinct
    pieces of that length of the texts.
    """
    listed = terms.select(F.col(term).alias("term")).where("term <> ''").distinct().limit(matched_terms + 1).collect()
    if len(listed) <= matched_terms and ahocorasick is not None:
        words = [r.term for r in listed]
        found = texts.withColumn("_hits", _finder(words)(F.col(text))) if words else texts.withColumn("_hits", F.array().cast("array<string>"))
        return found.withColumn("_hit", F.explode("_hits")).drop("_hits").join(terms.withColumn("_hit", F.col(term)), "_hit").drop("_hit")
    out = None
    for width, last in ((1, False), (2, False), (3, False), (4, True)):
        some = terms.where(F.length(term) >= width if last else F.length(term) == width).withColumn("_k", F.left(term, F.lit(width)))
        keyed = texts.where(F.length(text) >= width).withColumn("_k", F.explode(F.array_distinct(_pieces(text, width)))).join(some, "_k").where(F.contains(F.col(text), F.col(term))).drop("_k")
        out = keyed if out is None else out.unionByName(keyed)
    return out


def _pieces(text: str, width: int) -> Column:
    """All pieces of ``width`` characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substr(F.col(text), i, F.lit(width)))


def _finder(words: list[str]):
    """The different ones of ``words`` that lie in a text, as a column function."""
    made: list = []

    @F.pandas_udf("array<string>")
    def find(column: pd.Series) -> pd.Series:
        if not made:
            machine = ahocorasick.Automaton()
            for w in words:
                machine.add_word(w, w)
            machine.make_automaton()
            made.append(machine)
        return column.map(lambda t: sorted({w for _, w in made[0].iter(t)}) if t else [])

    return find


def clean_terms(glossary: DataFrame) -> DataFrame:
    """source_term, target_term, decision, key: stripped, one row per normalised source term and decision order.

    Of doubles the locked or approved one is kept, then the smallest target.
    """
    rows = glossary.select(X.strip("source_term").alias("source_term"), X.strip("target_term").alias("target_term"), F.lower(X.strip("decision")).alias("decision")).where("source_term <> '' and target_term <> ''").withColumn("key", X.normalize("source_term"))
    rank = F.when(F.col("decision") == "locked", 0).when(F.col("decision") == "approved", 1).when(F.col("decision") == "rejected", 3).otherwise(2)
    w = W.partitionBy("key").orderBy(rank, "target_term", "source_term")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def exact_terms(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, term: glossary terms that lie in ``texts(id, text)``."""
    base = texts.select("id", X.normalize("text").alias("t"))
    return containment(base, "t", clean_terms(glossary).select("key"), "key").select("id", F.col("key").alias("term"))


def fuzzy_terms(texts: DataFrame, glossary: DataFrame, least: float = 0.84, most_terms: int = 20_000) -> DataFrame:
    """id, term, score: terms that are not in the text but near one of its tokens.

    A token that begins the term, or is begun by it, scores 0.9; others score their similarity
    ratio. Distinct tokens of all texts are scored once.
    """
    terms = sorted(r.key for r in bounded(clean_terms(glossary).select("key"), most_terms, "the glossary"))
    counted, whole = S.bags(terms), frozenset(terms)
    tokens = texts.select("id", F.explode(F.array_distinct(X.tokens("text"))).alias("token"))

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            words = f.token.tolist()
            bag, lens = S.bags(words)
            for i, token in enumerate(words):
                # Terms that the token begins stand together in their order; those that begin it are looked up.
                begun = terms[bisect_left(terms, token) : bisect_left(terms, token + "\U0010ffff")]
                sure = {*begun, *(token[:n] for n in range(1, len(token) + 1) if token[:n] in whole)}
                rows += [(token, term, 0.9) for term in sorted(sure)]
                for k in S.may_reach(bag[i], int(lens[i]), *counted, least):
                    if terms[k] not in sure and (r := S.ratio(terms[k], token)) >= least:
                        rows.append((token, terms[k], r))
            yield pd.DataFrame(rows, columns=["token", "term", "score"])

    scored = tokens.select("token").distinct().mapInPandas(rate, "token string, term string, score double")
    found = tokens.join(scored, "token").groupBy("id", "term").agg(F.max("score").alias("score"))
    return found.join(exact_terms(texts, glossary), ["id", "term"], "left_anti")


def exact_matches(texts: DataFrame, memory: DataFrame) -> DataFrame:
    """id, entry_id, target: for every text with an equal source in the memory the best entry.

    ``texts(id, text, chapter_id)``, ``memory(entry_id, source_text, target_text, chapter_id)``.
    An entry of the text's chapter wins, then the smallest entry id. A hash join on the normalised text.
    """
    keyed = texts.select("id", F.col("chapter_id").alias("c"), X.normalize("text").alias("key")).where("key <> ''")
    entries = memory.where(X.strip("target_text") != "").select(X.normalize("source_text").alias("key"), F.col("chapter_id").alias("c"), F.struct("entry_id", F.col("target_text").alias("target")).alias("e")).where("key <> ''")
    # The best entry of every text and chapter, and of every text: a text meets one row of each, however many copies the memory has.
    own = entries.groupBy("key", "c").agg(F.min("e").alias("own"))
    best = own.groupBy("key").agg(F.min("own").alias("any"))
    near = own.select(F.col("key").alias("k"), F.col("c").alias("o"), "own")
    found = keyed.join(best, "key").join(near, (F.col("key") == F.col("k")) & F.col("c").eqNullSafe(F.col("o")), "left")
    return found.select("id", F.coalesce("own", "any").alias("m")).groupBy("id").agg(F.min("m").alias("m")).select("id", "m.entry_id", "m.target")


def similar_entries(queries: DataFrame, memory: DataFrame, near: float = 0.93, exact: float = 0.995, k: int = 5) -> DataFrame:
    """id, entry_id, similarity, exact, place: the ``k`` best entries of each query.

    ``queries(id, text, chapter_id)`` against all of ``memory``: both are met in the tasks, none is read to the driver.
    Ranks add 0.02 for the query's chapter, at most 1; ties go by similarity, then entry id.
    Empty texts are like nothing.
    """
    found = near_entries(queries, memory, near, k)
    return found.select("id", "entry_id", "similarity", (F.col("similarity") >= exact).alias("exact"), "place")


def near_pairs(queries: DataFrame, entries: DataFrame, least: float, chunk: int = 16384) -> DataFrame:
    """id, entry_id, similarity: all pairs of one ``k`` with a ratio of at least ``least``.

    ``queries(id, text, k)``, ``entries(entry_id, source_text, k)``, normalised here. Texts meet in bands of length, of
    which an entry has all that such a pair can be in; the queries of a band come in chunks, the entries stream by
    each. ``similarity.Chunk`` bounds the ratio by shared characters and grams before it is computed.
    """
    step = math.log((2 - least) / least) * (1 + 1e-9)
    band = lambda shift: F.floor((F.log(F.length("t")) + shift) / (4 * step)).cast("int")
    left = queries.select(F.col("k").cast("string").alias("k"), F.col("id").alias("i"), X.normalize("text").alias("t")).where("t <> '' and k is not null and i is not null").withColumn("band", band(0))
    right = entries.select(F.col("k").cast("string").alias("k"), F.col("entry_id").alias("i"), X.normalize("source_text").alias("t")).where("t <> '' and k is not null and i is not null").withColumn("band", F.explode(F.array_distinct(F.array(band(-step), band(step)))))
    parts = left.groupBy("k", "band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    key = lambda part: F.concat_ws(":", "band", part, "k").alias("key")
    asked = left.join(parts, ["k", "band"]).select(key(F.pmod(F.xxhash64("i"), F.col("parts")).cast("int")), F.lit(0).alias("side"), "i", "t")
    known = right.join(parts, ["k", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(key(F.col("part")), F.lit(1).alias("side"), "i", "t")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, texts, made = None, [], [], None
        for f in frames:
            out = []
            for (of, side), some in f.groupby(["key", "side"], sort=False):
                if of != now:
                    now, ids, texts, made = of, [], [], None
                if side == 0:
                    ids += some.i.tolist()
                    texts += some.t.tolist()
                elif texts:
                    made = made or S.Chunk(texts, least)
                    own = some.i.tolist()
                    out += [(ids[q], own[e], r) for q, e, r in made.near(some.t.tolist())]
            yield pd.DataFrame(out, columns=["id", "entry_id", "similarity"])

    return asked.union(known).repartition("key").sortWithinPartitions("key", "side").mapInPandas(judge, "id string, entry_id string, similarity double")


def rank(similarity: Column, own: Column) -> Column:
    """Similarity with 0.02 added for the text's own chapter, at most 1."""
    return F.least(F.lit(1.0), similarity + F.when(own, 0.02).otherwise(0.0))


def near_entries(texts: DataFrame, memory: DataFrame, least: float, k: int = 3) -> DataFrame:
    """id, entry_id, similarity, place: the ``k`` best entries of every text, as ``similar_entries`` ranks them, for any number of texts."""
    pairs = near_pairs(texts.select("id", "text", F.lit(0).alias("k")), memory.select("entry_id", "source_text", F.lit(0).alias("k")), least)
    placed = pairs.join(texts.select("id", F.col("chapter_id").alias("c")), "id").join(memory.select("entry_id", "chapter_id"), "entry_id")
    order = rank(F.col("similarity"), F.col("c") == F.col("chapter_id"))
    w = W.partitionBy("id").orderBy(F.desc(order), F.desc("similarity"), "entry_id")
    return placed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("id", "entry_id", "similarity", "place")


def lookup(table: DataFrame, columns: list[str], query: str, most: int, order: list[Column | str]) -> DataFrame:
    """The first ``most`` rows whose space-joined columns contain the query, without regard to case."""
    hay = F.lower(F.concat_ws(" ", *[X.text(c) for c in columns]))
    needle = query.strip().lower()
    return table.where(F.contains(hay, F.lit(needle)) if needle else F.lit(False)).orderBy(*order).limit(most)


def style_rules(texts: DataFrame, rules: DataFrame, most: int = 5) -> DataFrame:
    """id, rule, coverage, place: rules by the share of their tokens in the text; a rule without any only if first."""
    listed = bounded(rules.select("ord", "rule", F.array_distinct(X.tokens("rule")).alias("w")).orderBy("ord"), 10_000, "the rules")
    if not listed:
        return texts.sparkSession.createDataFrame([], "id string, rule string, coverage double, place int")
    all_of = F.array(*[F.struct(F.lit(r.ord).alias("ord"), F.lit(r.rule).alias("rule"), F.array(*[F.lit(x) for x in r.w]).cast("array<string>").alias("w")) for r in listed])
    base = texts.select("id", F.array_distinct(X.tokens("text")).alias("t"), F.explode(all_of).alias("r"))
    cover = F.size(F.array_intersect("r.w", "t")) / F.greatest(F.lit(1), F.size("r.w"))
    scored = base.select("id", "r.ord", "r.rule", cover.alias("coverage"))
    w = W.partitionBy("id").orderBy(F.desc("coverage"), "ord")
    return scored.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) & ((F.col("coverage") > 0) | (F.col("place") == 1))).select("id", "rule", "coverage", "place")


#: Widths and windows of the anchors of entries from ``width + window - 1`` characters on; shorter ones are met whole.
_ANCHORS = ((64, 64), (32, 16), (16, 1))


def _tier(length: int) -> tuple[int, int]:
    """Width and window of the anchor of an entry of ``length`` characters."""
    return next(((k, w) for k, w in _ANCHORS if length >= k + w - 1), (length, 1))


def _entry_anchors(texts: list[str]) -> np.ndarray:
    """Of every text the least hash of its tier's width: a text that holds it has this one among its anchors."""
    out, tiers = np.zeros(len(texts), np.uint64), {}
    for i, t in enumerate(texts):
        tiers.setdefault(_tier(len(t))[0], []).append(i)
    for width, numbers in tiers.items():
        for first, codes, lens in S.slices([texts[i] for i in numbers]):
            starts = np.cumsum(lens) - lens
            # The last place of a text with a whole gram ends its stretch.
            edges = np.stack([starts, starts + lens - width + 1], 1).ravel()
            out[numbers[first : first + len(lens)]] = np.minimum.reduceat(np.append(S.grams(codes, width), np.uint64(0)), edges)[::2]
    return out


def _text_anchors(texts: list[str], bits: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and their anchors of every width and window in ``bits`` that its bitmap lets through."""
    rows, found = [], []
    for first, codes, lens in S.slices(texts):
        row = np.repeat(np.arange(len(lens)), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(codes))
        for (width, window), held in bits.items():
            if len(codes) < width + window - 1:
                continue
            least, size = S.grams(codes, width), 1
            while size < window:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            slot = least & np.uint64(len(held) * 64 - 1)
            keep = (left[: len(least)] >= width + window - 1) & (held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            # A run of windows has one least gram.
            keep[1:] &= ~keep[:-1] | (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
            at = np.flatnonzero(keep)
            rows.append(row[at] + first)
            found.append(least[at])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _contained_ids(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """id, entry_id: entries ``(entry_id, k, s)`` that lie in texts ``(id, k, t)`` of the same ``k``.

    An entry has one anchor, the least hash of its grams; a text has the least of every window, so that of whatever lies
    in it. A bitmap of the entries' anchors keeps most of the texts' out of the join; what meets is then compared whole.
    """
    entries = entries.where("s <> ''")

    def of_entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = f.s.tolist()
            yield pd.DataFrame({"entry_id": f.entry_id, "k": f.k, "a": _entry_anchors(said).view(np.int64), "w": [_tier(len(t))[0] for t in said]})

    anchors = cut(entries.mapInPandas(of_entries, "entry_id string, k string, a long, w int"))
    # A bitmap for each width, as the narrow ones are asked at every place of a text and have few entries.
    slot = F.col("a").bitwiseAND((1 << 24) - 1)
    words = anchors.select("w", F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, int(a & 63))").alias("mask")).groupBy("w", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    windows, bits = dict(_ANCHORS), {}
    for width, some in words.groupby("w"):
        bits[int(width), windows.get(int(width), 1)] = held = np.zeros(1 << 18, np.uint64)
        held[some["word"].to_numpy(np.int64)] = some["mask"].to_numpy(np.int64).view(np.uint64)

    def of_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            row, found = _text_anchors(f.t.tolist(), bits)
            yield pd.DataFrame({"id": f.id.to_numpy()[row], "k": f.k.to_numpy()[row], "a": found.view(np.int64)})

    met = texts.where("t <> ''").select("id", "k", "t").mapInPandas(of_texts, "id string, k string, a long").join(anchors.select("entry_id", "k", "a"), ["k", "a"]).select(F.col("id").alias("i"), F.col("entry_id").alias("e"), "k").distinct()
    whole = met.join(entries.select("entry_id", F.col("k").alias("ek"), "s"), F.col("e").eqNullSafe(F.col("entry_id")) & (F.col("k") == F.col("ek"))).select("i", "entry_id", "k", "s")
    return whole.join(texts.select("id", F.col("k").alias("tk"), "t"), F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("tk"))).where(F.contains(F.col("t"), F.col("s"))).select("id", "entry_id")


def contained_terms(texts: DataFrame, memory: DataFrame, most: int | None = 5) -> DataFrame:
    """id, entry_id, place: approved or locked entries of the text's chapter whose source lies in it, first ``most``.

    A text without a chapter takes the entries of all chapters.
    """
    good, base = _decisions(memory), texts.select("id", "chapter_id", X.normalize("text").alias("t"))
    return _placed(_inside(base, good, most), most)


def _decisions(memory: DataFrame) -> DataFrame:
    return memory.where(F.lower(X.strip("quality")).isin("approved", "locked")).select("entry_id", "chapter_id", "source_text", X.normalize("source_text").alias("s")).where("s <> ''")


def _scope() -> Column:
    """The chapter of a text as a key, told apart by its first character from that of all chapters."""
    return F.when(F.coalesce(F.col("chapter_id"), F.lit("")) == "", "*").otherwise(F.concat(F.lit("c"), F.col("chapter_id")))


def _inside(base: DataFrame, good: DataFrame, most: int | None) -> DataFrame:
    """id, entry_id: entries that lie in texts, of equal ones in a chapter only the first ``most``, as no text shows more."""
    texts = base.select("id", _scope().alias("k"), "t")
    entries = good.select("entry_id", F.explode(F.array(F.concat(F.lit("c"), F.col("chapter_id")), F.lit("*"))).alias("k"), "s").where("k is not null")
    if most is not None:
        entries = entries.withColumn("n", F.row_number().over(W.partitionBy("k", "s").orderBy("entry_id"))).where(F.col("n") <= most).drop("n")
    return _contained_ids(texts, entries)


def _placed(hit: DataFrame, most: int | None) -> DataFrame:
    placed = hit.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("entry_id")))
    return (placed if most is None else placed.where(F.col("place") <= most)).select("id", "entry_id", "place")


def chapter_terms(texts: DataFrame, memory: DataFrame, most: int = 5, least: float = 0.86) -> DataFrame:
    """id, entry_id, place: approved or locked entries of the text's chapter whose source lies in it or is near it, first ``most``.

    A text without a chapter takes the entries of all chapters.
    """
    good, base = _decisions(memory), texts.select("id", "chapter_id", "text", X.normalize("text").alias("t"))
    keyed = F.concat(F.lit("c"), F.col("chapter_id"))
    near = near_pairs(base.select("id", "text", _scope().alias("k")), good.select("entry_id", "source_text", F.explode(F.array(keyed, F.lit("*"))).alias("k")), least)
    return _placed(_inside(base, good, most).union(near.select("id", "entry_id")).distinct(), most)

"""Problem 9: mixing sources to target weights.

Soft-membership mixing: a naive Bayes classifier, fitted on all labelled documents, gives the
domain posteriors of documents without a label; distributed projected-gradient least squares fits
a nonnegative rate per document, at most its domain's cap, so that the expected token totals of
the domains meet the targets; rates become repeat counts by exact thresholds per domain.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut, spread
from .text import words

#: The split pattern of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BUCKETS = 1 << 14


@dataclass
class Classifier:
    """Multinomial naive Bayes over hashed words: a table of domains by buckets, whatever the data."""

    domains: list[str]
    log_prior: np.ndarray
    log_word: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.log_prior, (len(texts), 1))
        for i, text in enumerate(texts):
            if text:
                out[i] += self.log_word[:, _hashed(text)].sum(1)
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def _hashed(text: str) -> list[int]:
    return [xxhash.xxh32_intdigest(w) % _BUCKETS for w in words(text)]


def fit_classifier(labelled: DataFrame, domains: list[str]) -> Classifier:
    """Fit on all rows of ``labelled(text, source)`` whose source is one of ``domains``; counts are combined per task first."""
    place = {d: i for i, d in enumerate(domains)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(domains), _BUCKETS), np.int64)
        docs = np.zeros(len(domains), np.int64)
        for f in frames:
            for source, text in zip(f.source, f.text):
                i = place[source]
                docs[i] += 1
                np.add.at(table[i], _hashed(text or ""), 1)
        d, b = np.nonzero(table)
        yield pd.DataFrame({"domain": np.append(d, np.arange(len(domains))).astype(np.int32), "bucket": np.append(b, np.full(len(domains), -1)).astype(np.int32), "n": np.append(table[d, b], docs)})

    rows = spread(labelled.where(F.col("source").isin(domains)).select("source", "text")).mapInPandas(count, "domain int, bucket int, n bigint")
    frame = rows.groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table, docs = np.ones((len(domains), _BUCKETS)), np.ones(len(domains))
    is_doc = frame["bucket"].to_numpy() < 0
    docs[frame["domain"][is_doc]] += frame["n"][is_doc].to_numpy()
    table[frame["domain"][~is_doc], frame["bucket"][~is_doc]] += frame["n"][~is_doc].to_numpy()
    return Classifier(domains, np.log(docs / docs.sum()), np.log(table / table.sum(1, keepdims=True)))


def token_counts(documents: DataFrame, domains: list[str], classifier: Classifier | None, ranks: str = RANKS, batch: int = 256, soft: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, member): tokens of the whole text and the membership in every domain.

    A labelled document belongs to its domain, unless ``soft``; others have the classifier's posteriors.
    The file of ranks is read where the program is and sent to the executors.
    """
    place = {d: i for i, d in enumerate(domains)}
    with open(ranks, "rb") as lines:
        sent = documents.sparkSession.sparkContext.broadcast(lines.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for f in frames:
            texts = [t or "" for t in f.text]
            sizes: list[int] = []
            for at in range(0, len(texts), batch):
                sizes += map(len, encoder.encode_ordinary_batch(texts[at : at + batch], num_threads=1))
            member = np.zeros((len(f), len(domains)))
            own = [place.get(s, -1) for s in f.source]
            lost = [i for i, o in enumerate(own) if o < 0 or soft]
            member[np.arange(len(f)), own] = 1.0
            if lost:
                member[lost] = classifier.posteriors([texts[i] for i in lost]) if classifier else 0.0
            yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "n_tokens": np.array(sizes, np.int64), "member": list(member)})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint, member array<double>")


def _rates(member: np.ndarray, cap: np.ndarray, gradients: list[np.ndarray], start: float) -> np.ndarray:
    """Replay the projected-gradient steps for a batch: rates stay between zero and the document's cap."""
    rate = np.full(len(member), start)
    for g in gradients:
        rate = np.clip(rate - member @ g, 0.0, cap)
    return rate


def fit_rates(base: DataFrame, weights: np.ndarray, caps: np.ndarray, total: float | None, rounds: int, step: float = 1.0) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Gradients of the steps, the start rate, the fitted expected totals and the targets.

    Each round is one pass that sums the expected tokens of the domains under the rates so far;
    only these sums (one number per domain) come to the driver.
    """
    n = len(weights)

    def sums(gradients: list[np.ndarray], start: float) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(n)
            for f in frames:
                member = np.array(f.member.tolist()).reshape(len(f), n)
                out += (_rates(member, member @ caps, gradients, start) * f.n_tokens.to_numpy()) @ member
            yield pd.DataFrame({"domain": np.arange(n, dtype=np.int32), "total": out})

        rows = base.select("n_tokens", "member").mapInPandas(run, "domain int, total double").groupBy("domain").agg(F.sum("total").alias("total")).collect()
        out = np.zeros(n)
        for r in rows:
            out[r.domain] = r.total
        return out

    have = np.maximum(sums([], 1.0), 1e-9)
    # The largest total that every domain can serve under its cap, unless one is asked for.
    # A domain without any tokens cannot be served and does not hold the others back.
    wanted = (weights > 0) & (have > 0.5)
    size = total or float(np.min(caps[wanted] * have[wanted] / weights[wanted])) if wanted.any() else 0.0
    target = weights * size
    gradients: list[np.ndarray] = []
    got = have
    for _ in range(rounds):
        gradient = step * (got - target) / have
        if np.abs(gradient).max() < 1e-6:
            break
        gradients.append(gradient)
        got = sums(gradients, 1.0)
    return gradients, 1.0, got, target


def _repeats(base: DataFrame, gradients: list[np.ndarray], start: float, caps: np.ndarray) -> DataFrame:
    """doc_id, source, n_tokens, home, whole (repeats for sure) and place (in [0, 1) times a hash, below which one more is drawn)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            member = np.array(f.member.tolist()).reshape(len(f), len(caps))
            home = np.where(member.sum(1) > 0, member.argmax(1), -1)
            rate = np.minimum(_rates(member, member @ caps, gradients, start), np.where(home >= 0, caps[home], 0))
            whole = np.floor(rate + 1e-9)
            rest = rate - whole
            dice = np.array([xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True)) for d in f.doc_id], np.uint64) / 2.0**64
            place = np.where(rest > 1e-9, dice / np.maximum(rest, 1e-9), np.inf)
            # A drawn repeat may not pass the cap.
            place = np.where((home >= 0) & (whole + 1 <= caps[home]), place, np.inf)
            yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "n_tokens": f.n_tokens, "home": home.astype(np.int32), "whole": whole.astype(np.int32), "place": place})

    return base.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint, home int, whole int, place double")


def _thresholds(drawn: DataFrame, target: np.ndarray, levels: int = 4, cells: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Per domain the size up to which documents are small, and the ``place`` below which small ones get one more repeat.

    Large documents are drawn with their probability (``place`` below 1); the threshold over the
    small ones then brings the domain's tokens as near to the target as one small document allows.
    Each level sums the tokens in ``cells`` cells of the interval that holds the threshold: a
    bounded table, and a resolution of ``cells ** levels``.
    """
    n = len(target)
    owned = drawn.where("home >= 0")
    small = np.zeros(n)
    for r in owned.where("place < 1e300").groupBy("home").agg(F.percentile_approx("n_tokens", 0.5, 1000).alias("m")).collect():
        small[r.home] = r.m
    size = F.array(*[F.lit(float(x)) for x in small])
    large = F.col("n_tokens") > F.get(size, F.col("home"))
    base = np.zeros(n)
    sure = F.col("whole") + F.when(large & (F.col("place") < 1), 1).otherwise(0)
    for r in owned.groupBy("home").agg(F.sum(F.col("n_tokens") * sure).alias("t")).collect():
        base[r.home] = r.t
    low, width, last = np.zeros(n), np.full(n, 64.0), np.zeros(n)
    for _ in range(levels):
        table = np.zeros((n, cells))
        start, wide = F.array(*[F.lit(float(x)) for x in low]), F.array(*[F.lit(float(x)) for x in width])
        at = F.floor((F.col("place") - F.get(start, F.col("home"))) / F.get(wide, F.col("home")) * cells)
        rows = owned.where("place < 1e300").where(~large).select("home", "n_tokens", at.alias("cell")).where((F.col("cell") >= 0) & (F.col("cell") < cells)).groupBy("home", "cell").agg(F.sum("n_tokens").alias("t")).collect()
        for r in rows:
            table[r.home, int(r.cell)] = r.t
        for s in range(n):
            upto = base[s] + np.concatenate([[0.0], np.cumsum(table[s])])
            k = min(max(0, int(np.searchsorted(upto, target[s], "right")) - 1), cells - 1)
            base[s], low[s], width[s], last[s] = upto[k], low[s] + k * width[s] / cells, width[s] / cells, table[s, k]
    nearer = target - base > last / 2
    return small, np.where(nearer, low + width, low)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, rounds: int = 12, ranks: str = RANKS, soft: bool = False) -> DataFrame:
    """doc_id, source, domain, n_tokens, repeats: the selection, documents with no repeat left out.

    ``soft`` takes the classifier's posteriors of every document, labelled or not: its rate then follows
    what its text is like, and its cap and domain are those of its likeliest domain.

    ``documents(doc_id bigint, text, source)``; ``targets(source, weight, max_repeats)`` has one row
    per domain and is read to the driver (refused beyond 10,000 rows). Weights are taken relative
    to their sum; a null or negative weight counts as 0, a null or negative cap as 0. Documents
    with a null or unknown source take part by the classifier's posterior, under the cap of their
    likeliest domain; null and empty texts have no tokens and are not selected; a repeated row
    takes part again. Without targets or documents the result is empty.
    """
    rows = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 domains")
    if not rows:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, source string, domain string, n_tokens bigint, repeats int")
    domains = [r.source for r in rows]
    weights = np.maximum(0.0, np.array([r.weight or 0.0 for r in rows], np.float64))
    weights = weights / weights.sum() if weights.sum() > 0 else weights
    caps = np.maximum(0.0, np.array([r.max_repeats or 0 for r in rows], np.float64))
    docs = documents.where("doc_id is not null")
    unknown = docs.where(F.col("source").isNull() | ~F.col("source").isin(domains))
    classifier = fit_classifier(docs, domains) if soft or not unknown.isEmpty() else None
    base = cut(token_counts(docs, domains, classifier, ranks, soft=soft).where("n_tokens > 0"))
    gradients, start, got, target = fit_rates(base, weights, caps, total_tokens, rounds)
    drawn = cut(_repeats(base, gradients, start, caps))
    small, edge = _thresholds(drawn, target)
    names = F.array(*[F.lit(d) for d in domains])
    limit, size = F.array(*[F.lit(float(x)) for x in edge]), F.array(*[F.lit(float(x)) for x in small])
    below = F.when(F.col("n_tokens") > F.get(size, F.col("home")), F.lit(1.0)).otherwise(F.get(limit, F.col("home")))
    repeats = F.col("whole") + F.when(F.col("place") < below, 1).otherwise(0)
    return drawn.where("home >= 0").select("doc_id", "source", F.get(names, F.col("home")).alias("domain"), "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def soft_shares(documents: DataFrame, targets: DataFrame, **options: float) -> DataFrame:
    """Per domain: source, weight, expected (its share of the tokens by posteriors under a ``soft`` mixture), labelled (by the documents' own sources) and agreement.

    ``agreement`` is the part of the domain's selected tokens whose own source is that domain; documents
    without a known source count under a null source, with neither weight nor expectation.
    """
    chosen = mixture(documents, targets, soft=True, **options)
    size = F.col("n_tokens") * F.col("repeats")
    by_domain = chosen.groupBy(F.col("domain").alias("source")).agg(F.sum(size).alias("d"), F.sum(F.when(F.col("source") == F.col("domain"), size).otherwise(0)).alias("same"))
    by_label = chosen.groupBy("source").agg(F.sum(size).alias("l"))
    weights = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"))
    known = F.col("source").isin([r.source for r in weights.select("source").limit(10_000).collect()])
    rows = weights.join(by_domain, "source", "left").join(by_label.where(known), "source", "left").select("source", "weight", "d", "same", "l")
    rest = by_label.where(~F.coalesce(known, F.lit(False))).agg(F.sum("l").alias("l")).where("l > 0").select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("weight"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("same"), "l")
    every = rows.unionByName(rest).withColumns({"all_d": F.sum("d").over(W.partitionBy(F.lit(0))), "all_l": F.sum("l").over(W.partitionBy(F.lit(0)))})
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.select("source", "weight", (n("d") / F.col("all_d")).alias("expected"), (n("l") / F.col("all_l")).alias("labelled"), F.when(n("d") > 0, n("same") / F.col("d")).alias("agreement"))


def mixture_shares(documents: DataFrame, targets: DataFrame, **options: float) -> DataFrame:
    """Per domain: source, weight, max_repeats, n_docs, n_tokens (repeats counted), share (of all selected tokens)."""
    chosen = mixture(documents, targets, **options)
    sums = chosen.groupBy(F.col("domain").alias("source")).agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    rows = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).join(sums, "source", "left")
    n = F.coalesce("n_tokens", F.lit(0))
    # One row per domain: a window over all of them is small.
    rows = rows.withColumn("all_tokens", F.sum("n_tokens").over(W.partitionBy(F.lit(0))))
    return rows.select("source", "weight", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), n.alias("n_tokens"), (n / F.col("all_tokens")).alias("share"))

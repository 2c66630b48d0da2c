"""Problem 7: sentence alignment in rough translations.

A hidden Markov model: target sentences are emissions of source states, with jump
probabilities between states, a null probability for added sentences and span states of two
source sentences for merges. The emission compares what survives translation:
glossary concepts in any inflection, figures, and names across scripts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_END = re.compile(r"(?<=[.?!])\s+")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
#: Romanisation of Cyrillic letters (fixed values) and spellings that sound alike, applied in this order.
ROMAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "sh", "", "i", "", "e", "iu", "ia"])) | {"ё": "e"}
ALIKE = (("qu", "kv"), ("th", "t"), ("ph", "f"), ("ck", "k"), ("x", "ks"), ("w", "v"), ("c", "k"), ("y", "i"), ("q", "k"), ("j", "i"))

#: Endings of English words that inflection adds or takes (fixed values).
_ENDINGS = frozenset(["e", "y", "s", "es", "ies", "ied", "d", "ed", "ing", "er", "ers", "r"])


def sentences(text: str | None) -> list[str]:
    """Sentences end at ``.``, ``?`` or ``!`` before white space or the end; null has none."""
    return [s for s in _END.split(text.strip()) if s] if text else []


def name_key(word: str) -> str:
    """How a name sounds: romanised, alike spellings joined, doubled letters single."""
    key = "".join(ROMAN.get(c, c) for c in word.lower())
    for a, b in ALIKE:
        key = key.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", key)


def _ending(part: str) -> bool:
    """Whether the rest of a word may be an inflection: of Cyrillic words from a vowel on, of Latin ones a few endings."""
    return not part or part[0] in "аеёиоуыэюяйь" or part in _ENDINGS


def _closeness(term: str, word: str) -> float:
    """How well a lower-case word is a form of a word of a term: their common beginning less what differs; 0 for not at all."""
    if term == word:
        return float(len(term)) or 0.0
    n = len(os.path.commonprefix((term, word)))
    rest, tail = term[n:], word[n:]
    if n < 3 or len(rest) > 3 or len(tail) > 4 or not (_ending(rest) and _ending(tail)):
        return 0.0
    return n - 0.4 * len(rest + tail)


class Glossary:
    """Concepts: glossary terms joined through shared source or target terms, found in inflected words.

    A term of several words is found where forms of all its words stand in a row; it goes before
    the terms of its single words.
    """

    def __init__(self, rows: list[tuple[str | None, str | None]], most_cached: int = 300_000) -> None:
        parent: dict[tuple[int, str], tuple[int, str]] = {}

        def root(x: tuple[int, str]) -> tuple[int, str]:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for source, target in rows:
            a, b = (" ".join((x or "").lower().split()) for x in (source, target))
            if a and b:
                parent[root((0, a))] = root((1, b))
        names = {r: i for i, r in enumerate(sorted({root(x) for x in parent}))}
        self.terms: dict[str, list[tuple[str, int]]] = {}
        self.phrases: dict[str, list[tuple[list[str], int]]] = {}
        for x in list(parent):
            parts = _TOKEN.findall(x[1]) if " " in x[1] else [x[1]]
            if len(parts) > 1:
                self.phrases.setdefault(parts[0][:3], []).append((parts, names[root(x)]))
            elif parts:
                self.terms.setdefault(parts[0][:3], []).append((parts[0], names[root(x)]))
        for those in self.phrases.values():
            those.sort(key=lambda x: (-len(x[0]), x))
        self.cache: dict[str, int] = {}
        self.most = most_cached

    def concept(self, word: str) -> int:
        """The concept of a lower-case word, by the term with the longest common beginning; -1 for none."""
        known = self.cache.get(word)
        if known is None:
            best, known = 0.0, -1
            for term, concept in self.terms.get(word[:3], ()):
                if len(word) >= 3 and (score := _closeness(term, word)) > best:
                    best, known = score, concept
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[word] = known
        return known

    def phrase(self, words: list[str], at: int) -> tuple[int, int]:
        """The concept of the longest term of several words whose forms stand from ``at`` on, and its number of words; -1 and 0 for none."""
        for parts, concept in self.phrases.get(words[at][:3], ()):
            some = words[at : at + len(parts)]
            if len(some) == len(parts) and all(_closeness(p, w) > 0 for p, w in zip(parts, some)):
                return concept, len(parts)
        return -1, 0


def features(sentence: str, glossary: Glossary) -> tuple[set[str], set[str]]:
    """Features that any rendering should keep, and features that count only where both texts have them."""
    firm: set[str] = set()
    loose: set[str] = set()
    tokens = _TOKEN.findall(sentence)
    words = [t.lower() for t in tokens]
    within = 0  # words of the last phrase still to pass
    for k, token in enumerate(tokens):
        if within:
            within -= 1
            continue
        if token[0].isdigit():
            # A rendering may round: the whole part must agree, the rest counts where both texts have it.
            whole, _, rest = token.replace(",", ".").partition(".")
            firm.add("#" + whole)
            if rest:
                loose.add("#" + whole + "." + rest)
            continue
        if words[k][:3] in glossary.phrases:
            concept, n = glossary.phrase(words, k)
            if n:
                firm.add(f"c{concept}")
                within = n - 1
                continue
        concept = glossary.concept(words[k])
        if concept >= 0:
            firm.add(f"c{concept}")
        elif token[0].isupper() and len(token) >= 4:
            (loose if k == 0 else firm).add("n" + name_key(token))
    return firm, loose


@dataclass(frozen=True)
class Model:
    """Probabilities of the model. ``jumps`` are those of the step from one source sentence to the next emitting one."""

    sharpness: float = 10.0
    least_similar: float = 0.27
    unlike: float = -7.0
    null: float = 0.08
    jumps: tuple[tuple[int, float], ...] = ((1, 0.72), (0, 0.05), (2, 0.09), (3, 0.04), (-1, 0.05), (-2, 0.03), (4, 0.02))
    far: float = 0.012
    span: float = 0.25
    contained: float = 0.7
    seen: float = 1.0


def _similar(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    shared = (a * weight) @ b.T
    size = (a @ weight)[:, None] + (b @ weight)[None, :]
    return np.divide(2 * shared, size, out=np.zeros_like(shared), where=size > 0)


@dataclass
class States:
    """Source states: what they emit, the sentences they begin and end at, those they stand for, and the log weight of their kind."""

    has: np.ndarray
    start: np.ndarray
    end: np.ndarray
    members: list[tuple[int, ...]]
    cost: np.ndarray

    @classmethod
    def of(cls, has: np.ndarray, m: Model) -> States:
        """Every sentence, and every span of two neighbours."""
        n = len(has)
        one = np.arange(n)
        spans = np.maximum(has[:-1], has[1:])
        members = [(i,) for i in range(n)] + [(i, i + 1) for i in range(n - 1)]
        cost = np.concatenate([np.zeros(n), np.full(n - 1, np.log(m.span))])
        return cls(np.concatenate([has, spans]), np.concatenate([one, one[:-1]]), np.concatenate([one, one[1:]]), members, cost)

    def also(self, rows: list[np.ndarray], members: list[tuple[int, ...]], log_weight: float) -> States:
        """The states and further ones, each beginning and ending at the sentence it is first of."""
        at = np.array([x[0] for x in members], np.int64)
        return States(np.concatenate([self.has, np.stack(rows)]), np.append(self.start, at), np.append(self.end, at), self.members + members, np.append(self.cost, np.full(len(members), log_weight)))


def _decode(states: States, n: int, target: np.ndarray, weight: np.ndarray, m: Model) -> list[tuple[int, int]]:
    """Viterbi: (state, target sentence) along the most likely path; empty where nothing but nulls is likelier."""
    similar = _similar(states.has, target, weight)
    emit = np.where(similar < m.least_similar, m.unlike, m.sharpness * (similar - m.least_similar)) + states.cost[:, None]
    jump, far, null = {d: np.log(p) for d, p in m.jumps}, np.log(m.far), np.log(m.null)
    size, k = len(states.has), len(target)
    start, end = states.start, states.end
    # States by the sentence they end at, so that each step takes the best of every end.
    by = np.argsort(end, kind="stable")
    ends, first_of = np.unique(end[by], return_index=True)
    before = np.where(start == 0, np.log(0.6), np.maximum(far, np.log(0.2) - start)).astype(np.float32)
    real, blank = np.full(size, -np.inf), np.full(size, -np.inf)
    back = np.zeros((k, 2, size), np.int64)  # index of the previous (kind, state), flattened; -1 before the first
    outset = 0.0  # score of having emitted nothing but nulls so far
    for j in range(k):
        best = np.maximum(real, blank)
        kind = (blank > real).astype(np.int64)
        # Scores by the end of the previous state, then one shift per jump and one best for any other.
        top = int(best.argmax())
        reach = np.full(size, best[top] + far)
        came = np.full(size, kind[top] * size + top)
        by_end, arg_end = np.full(n, -np.inf), np.zeros(n, np.int64)
        by_end[ends] = np.maximum.reduceat(best[by], first_of)
        hit = best[by] == by_end[end[by]]
        arg_end[end[by][hit][::-1]] = by[hit][::-1]
        for d, p in jump.items():
            at = start - d
            ok = (at >= 0) & (at < n)
            at = np.clip(at, 0, n - 1)
            score = np.where(ok, by_end[at] + p, -np.inf)
            better = score > reach
            reach[better] = score[better]
            arg = arg_end[at]
            came[better] = (kind[arg] * size + arg)[better]
        first = outset + before
        better = first > reach
        reach[better], came[better] = first[better], -1
        blank = best + null
        back[j, 1] = kind * size + np.arange(size)
        real = reach + emit[:, j]
        back[j, 0] = came
        outset += null
    best = np.maximum(real, blank)
    top = int(best.argmax())
    if outset >= best[top]:
        return []
    at = (size if blank[top] > real[top] else 0) + top
    path: list[tuple[int, int]] = []
    for j in reversed(range(k)):
        if at < 0:
            break
        kind, state = divmod(at, size)
        if kind == 0:
            path.append((state, j))
        at = int(back[j, kind, state])
    return path


def align(source: list[str], target: list[str], glossary: Glossary, m: Model = Model()) -> list[tuple[int, int]]:
    """Pairs (source_no, target_no) of the most likely path.

    The states are the source sentences and the spans of two neighbours. Where a sentence is left
    without a partner although another sentence's rendering holds most of it, the text is decoded
    once more with states for that: spans of the sentences that one target sentence holds, neighbours
    or not, and remainders, which emit what a sentence's other renderings leave of it. These states
    have the log weight ``seen``, as a sentence that holds what they emit was seen.
    """
    n, k = len(source), len(target)
    if not n or not k:
        return []
    found = [features(s, glossary) for s in source + target]
    both = set().union(*(f | o for f, o in found[:n])) & set().union(*(f | o for f, o in found[n:]))
    rows = [f | (o & both) for f, o in found]
    index: dict[str, int] = {}
    for row in rows:
        for x in row:
            index.setdefault(x, len(index))
    if not index:
        return []
    has = np.zeros((n + k, len(index)), np.float32)
    for i, row in enumerate(rows):
        has[i, [index[x] for x in row]] = 1
    worth = np.array([{"#": 1.5, "n": 2.0, "c": 1.0}[x[0]] for x in index], np.float32)
    weight = worth / np.maximum(1, np.maximum(has[:n].sum(0), has[n:].sum(0))) ** 0.5
    a, b = has[:n], has[n:]
    states = States.of(a, m)
    path = _decode(states, n, b, weight, m)
    pairs = {(i, j) for state, j in path for i in states.members[state]}
    apart = _held(a, b, weight, pairs, m.contained)
    parts = _held(b, a, weight, {(j, i) for i, j in pairs}, m.contained)
    if apart or parts:
        whole: dict[int, set[int]] = {j: set() for _, j in apart}
        for i, j in [*pairs, *apart]:
            if j in whole:
                whole[j].add(i)
        spans = sorted({tuple(sorted(x)) for x in whole.values()})
        if spans:
            states = states.also([a[list(x)].max(0) for x in spans], spans, m.seen)
        if parts:
            rests = [(i, a[i] * (1 - b[[y for x, y in pairs if x == i]].max(0, initial=0))) for _, i in parts]
            states = states.also([r for _, r in rests], [(i,) for i, _ in rests], m.seen)
        path = _decode(states, n, b, weight, m)
        pairs = {(i, j) for state, j in path for i in states.members[state]}
    return sorted(pairs)


def _held(a: np.ndarray, b: np.ndarray, weight: np.ndarray, pairs: set[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """(i, j) for rows of ``a`` left out of ``pairs`` that lie in what a row of ``b`` holds besides its partners."""
    left = sorted(set(range(len(a))) - {i for i, _ in pairs})
    if not left:
        return []
    rest = b.copy()
    for i, j in pairs:
        rest[j] = rest[j] * (1 - a[i])
    size = a[left] @ weight
    share = ((a[left] * weight) @ rest.T) / np.maximum(size, 1e-9)[:, None]
    best = share.argmax(1)
    rich = a[left].sum(1) >= 3
    return [(i, int(j)) for i, j, r, s in zip(left, best, rich, share.max(1)) if r and s >= least]


def aligned_sentences(memory: DataFrame, glossary: DataFrame, most_terms: int = 50_000, unit: str = "passage") -> DataFrame:
    """(entry_id, source_no, target_no) for the rows of ``unit`` in ``memory(entry_id, unit, source_text, target_text)``.

    ``glossary(source_term, target_term)`` is read to the driver and sent to the workers, which is
    refused beyond ``most_terms`` rows. Null or empty texts give no pairs; an entry delivered again
    counts once; passages without a common concept, figure or name give no pairs; other columns
    are not read. Each passage is aligned whole; the work per passage grows with the product of
    its two lengths.
    """
    rows = [(r.source_term, r.target_term) for r in glossary.select("source_term", "target_term").limit(most_terms + 1).collect()]
    if len(rows) > most_terms:
        raise ValueError(f"more than {most_terms} glossary rows")
    texts = memory.where(F.col("unit") == unit).where("entry_id is not null and source_text is not null and target_text is not null").select("entry_id", "source_text", "target_text")
    once = texts.groupBy("entry_id").agg(F.min(F.struct("source_text", "target_text")).alias("t")).select("entry_id", "t.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Glossary(rows)
        for frame in frames:
            ids, a, b = [], [], []
            for entry, s, t in zip(frame.entry_id, frame.source_text, frame.target_text):
                for i, j in align(sentences(s), sentences(t), terms):
                    ids.append(entry)
                    a.append(i)
                    b.append(j)
            yield pd.DataFrame({"entry_id": pd.Series(ids, dtype=object), "source_no": np.array(a, np.int64), "target_no": np.array(b, np.int64)})

    return once.mapInPandas(run, "entry_id string, source_no bigint, target_no bigint")

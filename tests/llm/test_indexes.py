"""The data structures against plain versions of them."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.bktree import Forest, hamming
from quire.llm.fmindex import FMIndex, suffix_array
from quire.llm.minhash import WordHashes, bands, shingles, signatures
from quire.llm.spans import Hasher, winnow


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_suffix_array(seq):
    assert suffix_array(np.array(seq)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 9))
def test_fm_index_finds_all_places(seq, pattern, sample):
    index = FMIndex(np.array(seq), 5, sample)
    low, high = index.search(np.array([pattern]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(seq) - len(pattern) + 1) if seq[i : i + len(pattern)] == pattern]


def test_bk_forest_finds_all_neighbours():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (6, 3)).astype(np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 300, 3)).astype(np.uint64))
    points = base[rng.integers(0, 6, 300)] ^ flips
    bucket = np.sort(rng.integers(0, 4, 300))
    forest = Forest(points, bucket)
    got = {(int(a), int(b)) for q, n in forest.search(points, forest.root, 30, most=50) for a, b in zip(q, n)}
    want = {(i, j) for i in range(300) for j in range(300) if bucket[i] == bucket[j] and hamming(points[i : i + 1], points[j : j + 1])[0] <= 30}
    assert got == want


def test_bk_forest_of_equal_points_and_none():
    points = np.zeros((5, 3), np.uint64)
    forest = Forest(points, np.zeros(5, np.int64))
    assert sum(len(q) for q, _ in forest.search(points, forest.root, 0)) == 25
    empty = Forest(np.empty((0, 3), np.uint64), np.empty(0, np.int64))
    assert list(empty.search(np.empty((0, 3), np.uint64), empty.root, 3)) == []


def test_shingles_are_sets_per_list():
    values, bounds = shingles([["a", "b", "a", "b"], [], ["a"], ["b", "a"]], 2, WordHashes())
    assert np.diff(bounds).tolist() == [2, 0, 0, 1]
    assert values[2] in values[:2]


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(400)]
    values, bounds = shingles([words[:300], words[100:]], 1, WordHashes())
    sig = signatures(values, bounds, 256)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    assert len(np.unique(bands(sig, 4))) > 60


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=50), st.integers(1, 12))
def test_winnow_marks_every_window(values, window):
    marks = set(winnow(np.array(values, np.uint64), window).tolist())
    for i in range(len(values) - min(window, len(values)) + 1 if values else 0):
        part = values[i : i + window]
        assert any(i + k in marks for k, v in enumerate(part) if v == min(part))


def test_gram_hashes_do_not_depend_on_the_place():
    text = np.frombuffer(("abcabc" * 30 + "x" + "abcabc" * 30).encode("utf-32-le"), np.uint32)
    hashes = Hasher().grams(text, 12)
    grams = [text[i : i + 12].tobytes() for i in range(len(hashes))]
    assert len(set(zip(grams, hashes.tolist()))) == len(set(grams)) == len(set(hashes.tolist()))

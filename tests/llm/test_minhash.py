"""Near-duplicate documents against all pairs."""

import random
from math import comb

import numpy as np
import pytest
from llm.plain import ODD_TEXTS, documents, near_components, odd_documents, shingle_set

from ticketmill.llm import minhash
from ticketmill.llm.common import Words, shingles


def found(df):
    return df.toPandas().set_index("doc_id")


def test_all_documents(spark):
    docs = documents()
    texts = dict(zip(docs.doc_id, docs.text))
    result = found(minhash.near_duplicates(spark.createDataFrame(docs)))
    expected = near_components(texts)
    assert result.component_id.to_dict() == expected
    assert result.n_shingles.to_dict() == {i: len(shingle_set(t)) for i, t in texts.items()}
    assert (result.kept == (result.component_id == result.index)).all()


def test_one_large_family_and_many_strangers_around_it(spark):
    """Near copies of one text at all distances: some link with each other only through others."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
        texts[i] = " ".join(words)
    for i in range(400, 460):
        texts[i] = texts[0]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert found(minhash.near_duplicates(df)).component_id.to_dict() == near_components(texts)


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_SHINGLES", 1000)
    test_one_large_family_and_many_strangers_around_it(spark)


def test_odd_rows(spark):
    result = minhash.near_duplicates(odd_documents(spark)).toPandas()
    assert len(result) == len(ODD_TEXTS) + 3
    empty = result[result.n_shingles == 0]
    assert sorted(empty.doc_id) == [0, 1, 2] and (empty.component_id == empty.doc_id).all()
    assert set(result[result.doc_id.isin([5, 6])].component_id) == {5}
    assert result[result.doc_id.isna()].kept.tolist() == [False]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


def test_few_words_are_one_shingle():
    data = np.frombuffer(b"A bc  Dabc d", np.uint8)
    words, at = Words()(data, np.array([0, 7, 7, 12]))
    runs, ends = shingles(words, at)
    assert np.diff(at).tolist() == [3, 0, 2] and np.diff(ends).tolist() == [1, 0, 1]
    assert len(set(runs.tolist())) == 2


def test_words_do_not_reach_into_the_next_text():
    data = np.frombuffer(b"one twotwo three", np.uint8)
    words, at = Words()(data, np.array([0, 7, 16]))
    assert np.diff(at).tolist() == [2, 2] and words[1] == words[2]


@pytest.mark.parametrize("similarity", [0.75, 0.8, 0.9])
def test_pairs_at_the_threshold_are_hardly_ever_pruned(similarity):
    rng = np.random.default_rng(1)
    bounds = minhash.least_matches(0.75)
    equal = rng.random((20_000, minhash.HASHES)) < similarity + (1 - similarity) / 256
    sums = equal.cumsum(axis=1)[:, minhash.BATCH_HASHES - 1 :: minhash.BATCH_HASHES]
    assert (sums < np.array(bounds)).any(axis=1).mean() < len(bounds) * minhash.MISS * 2


@pytest.mark.parametrize("similarity, most", [(0.75, 1e-4), (0.76, 5e-5), (0.78, 1e-5)])
def test_pruning_loses_less_than_the_bands(similarity, most):
    """The exact chance that a pair is dropped on its signature; 40 bands miss 4e-4 at 0.75."""
    p, n = similarity + (1 - similarity) / 256, minhash.BATCH_HASHES
    more = np.array([comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(n + 1)])
    kept = np.ones(1)  # by number of equal hashes so far
    for least in minhash.least_matches(0.75):
        kept = np.convolve(kept, more)
        kept[:least] = 0
    assert 1 - kept.sum() < most


def test_unlike_pairs_are_pruned():
    rng = np.random.default_rng(2)
    equal = rng.random((2000, minhash.HASHES)) < 0.5
    sums = equal.cumsum(axis=1)[:, minhash.BATCH_HASHES - 1 :: minhash.BATCH_HASHES]
    assert (sums >= np.array(minhash.least_matches(0.75))).all(axis=1).mean() < 0.001

"""Topic fits on streamed documents."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from corpusloom import session
from corpusloom.operators import models, streamed_fits

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", VectorUDT())])
SIZE = 30


@pytest.fixture(scope="module")
def counts():
    """Documents of two groups with words of their own, and one document without words."""
    rng = np.random.default_rng(5)
    rows = [rng.multinomial(40, np.repeat([0.95, 0.05] if i % 2 else [0.05, 0.95], SIZE // 2) / (SIZE // 2)) for i in range(60)]
    return np.array([*rows, np.zeros(SIZE)])


@pytest.fixture(scope="module")
def matrix(spark, counts):
    rows = [(i, Vectors.sparse(SIZE, np.flatnonzero(r).tolist(), r[r > 0].astype(float).tolist())) for i, r in enumerate(counts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_fit(counts, k, seed, steps):
    """The same update, cell by cell."""
    n = np.random.default_rng([seed, k]).gamma(1.0, 1.0, (SIZE, k))
    for _ in range(steps):
        beta, new = (n + 0.1) / (n.sum(0) + SIZE * 0.1), np.zeros((SIZE, k))
        for row in counts:
            mixture = np.full(k, row.sum() / k)
            for _ in range(streamed_fits.INNER):
                share = beta * (mixture + 50 / k)
                share = row[:, None] * share / share.sum(1, keepdims=True)
                mixture = share.sum(0)
            new += share
        n = new
    return n


def test_fits_that_share_scans_equal_plain_and_separate_ones(monkeypatch, matrix, counts):
    monkeypatch.setattr(streamed_fits, "TERMS", 7)
    together = streamed_fits.fit(matrix, SIZE, [2, 5, 3], seed=4, max_iter=3)
    assert sorted(together) == [2, 3, 5]
    for k, found in together.items():
        assert np.allclose(found, plain_fit(counts, k, 4, 3), atol=1e-9)
        assert np.allclose(found, streamed_fits.fit(matrix, SIZE, [k], seed=4, max_iter=3)[k], atol=1e-9)
        assert np.isclose(found.sum(), counts.sum())  # every word has its topics


def test_groups_keep_to_the_bound(monkeypatch):
    monkeypatch.setattr(streamed_fits, "CELLS", 300)
    assert streamed_fits.groups([2, 3, 4, 5, 9, 10], 30) == [[2, 3, 4], [5], [9], [10]]
    with pytest.raises(ValueError, match="fit_lda"):
        streamed_fits.groups([11], 30)


@pytest.mark.parametrize("batches", [1, 3])
def test_topics_are_found_again(spark, matrix, batches):
    before = set(session._WRITTEN)
    runs = [streamed_fits.fit(matrix, SIZE, [2], seed=1, max_iter=12, batches=batches)[2] for _ in range(2)]
    assert np.allclose(*runs, atol=1e-9) and set(session._WRITTEN) == before
    beta = runs[0] / runs[0].sum(0)
    of_first = beta[: SIZE // 2].sum(0)
    assert of_first.max() > 0.7 > 0.3 > of_first.min()
    weights = {r.doc_id: np.array(r.weights) for r in streamed_fits.doc_topics(matrix, runs[0]).collect()}
    assert len(weights) == 61 and all(np.isclose(w.sum(), 1) for w in weights.values())
    assert weights[60].tolist() == [0.5, 0.5]
    first = of_first.argmax()
    assert all((weights[i][first] > 0.5) == bool(i % 2) for i in range(60))


def test_scores_in_one_pass(spark, matrix):
    fits = streamed_fits.fit(matrix, SIZE, [2, 3, 5], seed=2, max_iter=2)
    index = spark.createDataFrame([(f"w{i}", i) for i in range(SIZE)], "term string, term_id int")
    got = {r.k: r.score for r in models.fit_divergence(spark, fits).collect()}
    for k, found in fits.items():
        long = models.topic_terms(streamed_fits.counts_table(spark, found), k, index)
        assert got[k] == pytest.approx(models.topic_divergence(long, k).first()["score"])

"""Fits whose counts neither the driver nor one task can hold."""

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import session
from corpusloom.operators import em_fit, models, streamed_fits, topic_state

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", VectorUDT())])
SIZE = 30


@pytest.fixture(scope="module")
def matrix(spark):
    """Documents of some terms each, with a null and a repeated id; no document holds the last term."""
    rng = np.random.default_rng(8)
    rows = [(None if i == 3 else i // 2, Vectors.sparse(SIZE, {int(t): float(rng.integers(1, 5)) for t in rng.integers(0, SIZE - 1, 6)}))
            for i in range(40)]
    return session.cut_lineage(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_counts_stay_with_the_executors(spark, matrix, monkeypatch):
    whole = streamed_fits.fit(matrix, SIZE, [11], seed=3, max_iter=1)[11]

    def refused(*_):
        raise AssertionError("through the driver")

    # 11 topics of 30 terms are more numbers than a block may hold
    for module in (streamed_fits, topic_state):
        monkeypatch.setattr(module, "CELLS", 300)
    monkeypatch.setattr(type(matrix), "toArrow", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    (ks, table, path), = streamed_fits.fit_tables(matrix, SIZE, [11], seed=3, max_iter=1)
    found = {r["id"]: r["counts"] for r in table.collect()}
    assert ks == [11] and sorted(found) == list(range(-SIZE, 0)) and not any(found[-SIZE])
    assert np.allclose([found[-1 - t] for t in range(SIZE)], whole, atol=1e-9)
    weights = [r["weights"] for r in streamed_fits.doc_topics(matrix, table, 11).collect()]
    assert len(weights) == 40 and np.allclose(np.sum(weights, axis=1), 1)
    session.delete_folder(spark, path)


def test_java_random(spark):
    java, ours = spark._jvm.java.util.Random(-77), em_fit.JavaRandom(-77)
    assert [*ours.doubles(3), *ours.doubles(2)] == [java.nextDouble() for _ in range(5)]


def test_fit_is_that_of_mllib(matrix):
    fitted = models.fit_lda(matrix, 3, seed=5, max_iter=2)
    assert isinstance(fitted, em_fit.TopicFit)  # no graph
    theirs = LDA(k=3, seed=5, maxIter=2, optimizer="em").fit(matrix)
    assert np.allclose(fitted.topicsMatrix().toArray(), theirs.topicsMatrix().toArray(), atol=1e-9)


def test_document_topics_need_no_dense_vector(spark):
    few = session.cut_lineage(spark.createDataFrame([(7, Vectors.sparse(1 << 30, [5, 1 << 29], [1.0, 2.0]))], SCHEMA))
    counts = spark.createDataFrame([(0, [1.0, 2.0])], "id long, counts array<double>")
    numbered = few.select(F.monotonically_increasing_id().alias("id")).first()["id"]
    counts = counts.withColumn("id", F.lit(numbered))
    assert models.doc_topics(counts, 2, few).first()["weights"] == [26 / 53, 27 / 53]

"""Sweeps whose models together ship more than the disk holds."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from corpusloom import session
from corpusloom.operators import models, streamed_fits

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", VectorUDT())])
SIZE, KS = 25, [2, 3, 4, 5]


@pytest.fixture(scope="module")
def matrix(spark):
    """Documents of some terms, with repeated and null ids, one without terms."""
    rng = np.random.default_rng(2)
    rows = [(None if i == 4 else i // 2, Vectors.sparse(SIZE, {int(t): float(rng.integers(1, 4)) for t in rng.integers(0, SIZE - 1, 7)}))
            for i in range(50)] + [(90, Vectors.sparse(SIZE, {}))]
    return session.cut_lineage(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_width_falls_with_the_cells():
    assert streamed_fits.shared_width(range(2, 31), 200_000) > 300
    assert streamed_fits.shared_width(range(2, 31), 1_000_000) < 70
    assert streamed_fits.shared_width(range(2, 31), 10 ** 9) == 30


def test_sweep_keeps_one_group_on_disk(spark, matrix, monkeypatch):
    index = spark.createDataFrame([(f"w{i}", i) for i in range(SIZE)], "term string, term_id int")
    whole = {r["k"]: r["score"] for r in models.topic_count_sweep(matrix, index, KS, seed=3, max_iter=2).collect()}
    before, found, kept = set(session._WRITTEN), [], []
    monkeypatch.setattr(streamed_fits, "SHIPPED", 1)  # what one model ships is the least
    of_table = models.table_divergence

    def seen(wide, some, *rest):
        found.append(list(some))
        kept.append(len(set(session._WRITTEN) - before))
        return of_table(wide, some, *rest)

    monkeypatch.setattr(models, "table_divergence", seen)
    parted = {r["k"]: r["score"] for r in models.topic_count_sweep(matrix, index, KS, seed=3, max_iter=2).collect()}
    assert found == [[2, 3], [4], [5]] and kept == [2, 2, 2]  # the documents and one group's counts
    assert parted == pytest.approx(whole) and sorted(parted) == KS
    assert set(session._WRITTEN) == before


@pytest.mark.parametrize("batches", [1, 3])
def test_counts_are_alike_in_short_and_long_rows(matrix, monkeypatch, batches):
    from corpusloom.operators import bundles

    whole = streamed_fits.fit(matrix, SIZE, [3, 4], seed=6, max_iter=2, batches=batches)
    monkeypatch.setattr(bundles, "NUMBERS", 30)  # four terms a row, the last row is shorter
    parted = streamed_fits.fit(matrix, SIZE, [3, 4], seed=6, max_iter=2, batches=batches)
    assert all(np.allclose(whole[k], parted[k], atol=1e-9) for k in (3, 4))
    assert (parted[3].shape, parted[4].shape) == ((SIZE, 3), (SIZE, 4))


def test_rows_for_python_hold_no_nulls(spark):
    from corpusloom.operators import topic_state

    rows = spark.createDataFrame([(1, None, None), (None, b"abcdefgh", [2])], "id long, counts binary, terms array<int>")
    found = topic_state.filled(rows).collect()
    assert [tuple(r) for r in found] == [(1, bytearray(), []), (None, bytearray(b"abcdefgh"), [2])]


def test_many_rows_of_a_place_are_added_up():
    from corpusloom.operators import topic_state

    at, rows, found = np.array([4] * 90 + [1] * 3 + [0]), np.random.default_rng(0).random((94, 3)), np.ones((5, 3))
    wanted = found.copy()
    np.add.at(wanted, at, rows)
    topic_state.add_up(found, at, rows)
    assert np.allclose(found, wanted, rtol=1e-13)
    topic_state.add_up(found, at[:0], rows[:0])  # nothing to add
    assert np.allclose(found, wanted, rtol=1e-13)

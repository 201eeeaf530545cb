"""Both searches against brute force, and the cases of their docstrings."""

import numpy as np
import pytest
from pyspark.sql import types as T

from corpusloom.llm import branch_and_bound, one_bit_codes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("score", T.StringType()), T.StructField("dim", T.StringType()),
])


def rows_of(seed, n, dim, centres=4):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    return (middle[rng.integers(0, centres, n)] + rng.standard_normal((n, dim))).astype(np.float32)


def table(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, v, "s", "d") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, queries, k, score):
    out = []
    for q in queries:
        pairs = [(-score(vectors[q], vectors[i]), i) for i in vectors if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:k])]
    return out


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def product(a, b):
    a, b = ([int(np.floor(256 * float(x))) for x in v] for v in (a, b))
    return max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), -(2**63))


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_recall_and_scores_of_one_bit_codes(spark):
    vectors = rows_of(1, 1500, 64)
    df = table(spark, vectors.tolist())
    got = found(one_bit_codes.nearest(df, df.filter("vec_id % 50 = 0"), 5, rows_per_block=400, queries_per_block=16))
    want = brute(dict(enumerate(vectors)), range(0, 1500, 50), 5, cosine)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    right = {(w[0], w[2]) for w in want}
    assert len(right & {(g[0], g[2]) for g in got}) >= 0.97 * len(right)
    assert all(abs(g[3] - cosine(vectors[g[0]], vectors[g[2]])) < 1e-12 for g in got)


def test_bounds_hold_for_nearly_all_pairs():
    unit = rows_of(2, 600, 96).astype(float)
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    centres = one_bit_codes.fit_centres(unit, 3)
    turn = one_bit_codes.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    near, *code = one_bit_codes.encode(unit, centres, turn)
    for c in range(3):
        own = near == c
        estimate, off = one_bit_codes.bounds(unit[:50], tuple(x[own] for x in code), centres[c], turn)
        wrong = np.abs(unit[:50] @ unit[own].T - estimate) > off
        assert wrong.mean() < 0.01


@pytest.mark.parametrize("seed", [3, 4])
def test_branch_and_bound_is_exact(spark, seed):
    vectors = rows_of(seed, 700, 24)
    vectors[5] = vectors[6] = vectors[7]  # ties
    df = table(spark, vectors.tolist())
    got = found(branch_and_bound.highest(df, df.filter("vec_id % 50 = 0"), 5, rows_per_block=150, queries_per_block=4))
    assert got == brute(dict(enumerate(vectors)), range(0, 700, 50), 5, product)


@pytest.mark.parametrize(("search", "score"), [(one_bit_codes.nearest, cosine), (branch_and_bound.highest, product)])
def test_odd_rows(spark, search, score):
    nan, inf = float("nan"), float("inf")
    good = {0: [1.0, 2.0], 2: [1.0, 2.0], 3: [-1.0, 0.5], 50: [0.25, 1.0]}
    odd = [(1, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [1.0, 2.0, 3.0]), (2, [1.0, 2.0])]
    if search is one_bit_codes.nearest:
        odd.append((9, [0.0, 0.0]))
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in [*good.items(), *odd]], SCHEMA)
    got = found(search(df, df.filter("vec_id % 50 = 0"), 5))
    want = brute(good, [0, 50], 5, score)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


@pytest.mark.parametrize(("search", "score"), [(one_bit_codes.nearest, cosine), (branch_and_bound.highest, product)])
@pytest.mark.parametrize("shift", [0.0, 1e-3])
def test_repeated_ids_leave_room_for_others(spark, search, score, shift):
    """The ids that are best for a query stand in many rows, equal or nearly equal ones."""
    vectors = rows_of(9, 600, 48)
    vectors[1:4] = vectors[0] * np.array([[1.5], [1.4], [1.3]], np.float32) + rows_of(10, 3, 48) * 0.02
    copies = [(i, (vectors[i] * (1 - shift * c)).tolist(), "s", "d") for i in (1, 2, 3) for c in range(40)]
    df = spark.createDataFrame([(i, v, "s", "d") for i, v in enumerate(vectors.tolist())] + copies, SCHEMA)
    got = found(search(df, df.filter("vec_id = 0"), 5))
    want = brute(dict(enumerate(vectors)), [0], 5, score)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_empty_tables(spark):
    df = table(spark, [[1.0, 2.0], [2.0, 1.0]])
    for search in (one_bit_codes.nearest, branch_and_bound.highest):
        assert search(df, df.limit(0)).count() == 0
        assert search(df.limit(0), df).count() == 0
        assert found(search(df, df)) == found(search(df, df, rows_per_block=1, queries_per_block=1))


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [1e9, -3e8], "", ""), (1, [2e9, 1.0], "", ""), (2, [3e30, 1.0], "", "")], SCHEMA)
    want = brute({r.vec_id: r.embedding for r in df.collect()}, [0], 5, product)
    assert found(branch_and_bound.highest(df, df.filter("vec_id = 0"))) == want

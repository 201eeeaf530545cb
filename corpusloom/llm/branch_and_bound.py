"""Exact top-k by integer inner product: columnar branch and bound.

A block of vectors is held dimension by dimension (vertical layout). For a
query, dimensions are taken in blocks, those with the query's largest
components first; partial sums grow for all candidates that are still alive.
What the dimensions not yet seen can add lies within the product of the
remaining masses (norms) of query and vector, so a candidate whose partial sum
plus that bound is below the k-th best partial sum minus its bound can be
dropped: survivors are compacted. The result is exact.

Components become floor(256 x). Sums stay exact: in doubles while every sum of
absolute products is below 2**53, in Python integers beyond. A score outside
the range of a long is set to its nearest end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import vectors
from corpusloom.session import ship_package

SCALE = 256
DIMS_PER_BLOCK = 8
LONG = 2**63


def best_of(query: np.ndarray, vertical: np.ndarray, masses: np.ndarray, own: np.ndarray, k: int,
            step: int = DIMS_PER_BLOCK, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the columns of ``vertical`` that may be among
    the k best for ``query``; ``own`` marks columns that take no part. Columns
    of one id (``ids``: its place, where ids come twice) count once."""
    dim = len(query)
    order = np.argsort(-np.abs(query), kind="stable")
    alive = np.flatnonzero(~own)
    partial = np.zeros(len(alive))
    left_v = masses[alive].copy()
    left_q = float((query**2).sum())
    columns, whole = vertical, len(alive) == vertical.shape[1]
    for start in range(0, dim, step):
        dims = order[start:start + step]
        part = columns[dims] if whole else columns[dims][:, alive]
        partial += query[dims] @ part
        if start + step >= dim:
            break
        left_q -= float((query[dims]**2).sum())
        left_v -= (part * part).sum(0)
        if len(alive) > k:
            # both masses are sums of integers below 2**53 and exact; the root is rounded up
            rest = np.sqrt(max(left_q, 0.0) * np.maximum(left_v, 0.0)) * (1 + 1e-9)
            sure = partial - rest
            if ids is not None:
                best = np.full(ids.max() + 1, -np.inf)
                np.maximum.at(best, ids[alive], sure)
                sure = best[best > -np.inf]
            least = np.partition(sure, -k)[-k] if len(sure) >= k else -np.inf
            keep = partial + rest >= least
            if keep.sum() < 0.7 * len(alive):
                alive, partial, left_v, whole = alive[keep], partial[keep], left_v[keep], False
    return alive, partial


def cell_search(k: int):
    def cell(left: pa.Table, right: pa.Table):
        dim = left["dim"][0].as_py()
        right, ids = vectors.without_copies(right, dim)
        q_id, v_id = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q = np.floor(vectors.matrix(left["v"], dim) * SCALE)
        v = np.floor(vectors.matrix(right["v"], dim) * SCALE)
        largest = max(np.abs(q).max(), np.abs(v).max())
        exact = dim * float(largest) ** 2 < 2**53
        vertical = np.ascontiguousarray(v.T)
        masses = (v * v).sum(1)
        wide = None if exact else np.array([[int(x) for x in row] for row in v.tolist()], object)
        out = []
        for i in range(len(q)):
            own = v_id == q_id[i]
            if exact:
                place, score = best_of(q[i], vertical, masses, own, k, ids=ids)
                score = score.astype(np.int64)
            else:
                place = np.flatnonzero(~own)
                sums = wide[place].dot(np.array([int(x) for x in q[i].tolist()], object))
                score = np.array([min(max(x, -LONG), LONG - 1) for x in sums], np.int64)
            # largest first, ties to the smaller id; scores may not be negated in 64 bits
            best = np.lexsort((v_id[place], ~score))
            seen: dict[int, int] = {}
            for j in best:
                seen.setdefault(int(v_id[place[j]]), int(score[j]))
                if len(seen) == k:
                    break
            out.append((np.full(len(seen), q_id[i]), np.array([*seen], np.int64), np.array([*seen.values()], np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return cell


def highest(base: DataFrame, queries: DataFrame, k: int = 5, **blocks: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner
    products with rows of ``base``, ties to the smaller id.

    Takes tables with ``vec_id`` and ``embedding``; see ``vectors`` for which
    rows take part. Zero vectors take part. No query or no vector: no row.
    Fewer than k candidates: all of them.
    """
    ship_package(base.sparkSession)
    return vectors.search(vectors.usable(base), vectors.usable(queries), k, cell_search(k), "long", **blocks)

"""Blocked search of a query set against all vectors.

Both sides are cut into blocks of bounded size, and every (query block, vector
block) cell is one group of a shuffle: a task holds one cell, never a side. A
cell answers with k rows per query, which are merged per query afterwards.

Vectors: ``vec_id`` and ``embedding`` (array of float or double). A vector that
is null, empty, or holds a null, NaN or infinite component takes no part. Only
vectors of equal length are compared. A row is never its own neighbour: rows
with the query's ``vec_id`` are left out. A ``vec_id`` that stands in several
rows counts once, with its best score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array), dim of the vectors that take part; other columns go."""
    kind = dict(vectors.dtypes)["embedding"]
    if kind not in ("array<float>", "array<double>"):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    infinite = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"),
        F.size("embedding").alias("dim"),
    )


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as a double matrix."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def without_copies(table: pa.Table, dim: int) -> tuple[pa.Table, np.ndarray | None]:
    """The rows without those equal in ``vec_id`` and vector to another one; and
    the place of each row's id among the distinct ids, if ids still come twice."""
    ids, place = np.unique(table["vec_id"].to_numpy(), return_inverse=True)
    if len(ids) == len(place):
        return table, None
    rows = np.column_stack([place, matrix(table["v"], dim)])
    first = np.sort(np.unique(rows, axis=0, return_index=True)[1])
    return table.take(pa.array(first)), None if len(first) == len(ids) else place[first]


def top_k(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best pairs: larger score, then smaller id; an id
    that comes twice counts once."""
    order = np.lexsort((vec_id, -score, query))
    pairs = np.stack([query[order], vec_id[order]], 1)
    order = order[np.sort(np.unique(pairs, axis=0, return_index=True)[1])]
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return order[rank < k]


def search(base: DataFrame, queries: DataFrame, k: int, cell: Callable, score_type: str,
           rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score.

    ``cell(queries, vectors) -> (query_id, vec_id, score)`` gets two Arrow
    tables of one dimension and returns at least each query's k best pairs.
    ``base`` and ``queries`` come from ``usable`` and may hold more columns.
    """
    n_base, n_queries = base.count(), queries.count()
    base_blocks = max(1, -(-n_base // rows_per_block))
    query_blocks = max(1, -(-n_queries // queries_per_block))

    def cells(side: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        block: Column = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
        return side.withColumn(own, block).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        ).groupBy("dim", "base_block", "query_block")

    value = pa.int64() if score_type == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            query, vec_id, score = cell(left, right)
        else:
            query, vec_id, score = [], [], []
        return pa.table({
            "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()),
            "score": pa.array(score, value),
        })

    pairs = cells(queries, "query_block", query_blocks, "base_block", base_blocks).cogroup(
        cells(base, "base_block", base_blocks, "query_block", query_blocks)
    ).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

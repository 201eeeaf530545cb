"""Spark ML's EM for topic models, on tables instead of a graph.

The update and the random start are those of ``LDA(optimizer="em")``: a word w of document d
belongs to topic t in proportion to (n_wt + delta) / (n_t + V delta) * (n_dt + alpha), from
the counts before the step, and the first shares are drawn per partition of the matrix by
Java's generator. So a fit is the one that class finds, up to rounding. Its graph is rebuilt in
every step, an object per cell; here a block of documents is worked on at a time
(``topic_state``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import ALPHA_TOTAL
from corpusloom.memory import released
from corpusloom.operators import topic_state
from corpusloom.session import delete_folder, drop_shuffles, ship_package, store

MASK, FACTOR, ADDEND = np.uint64((1 << 48) - 1), 0x5DEECE66D, 0xB  # of java.util.Random
DRAWN = 1 << 16  # states that are worked out together


class JavaRandom:
    """``nextDouble`` of java.util.Random, many at a time."""

    def __init__(self, seed: int) -> None:
        self.state = np.uint64((seed ^ FACTOR) & int(MASK))
        powers = np.multiply.accumulate(np.full(DRAWN, FACTOR, np.uint64))  # modulo 2^64, of which 2^48 is a part
        sums = np.cumsum(np.concatenate([np.ones(1, np.uint64), powers[:-1]]), dtype=np.uint64)
        self.powers, self.shifts = powers, sums * np.uint64(ADDEND)

    def doubles(self, n: int) -> np.ndarray:
        states, at = np.empty(2 * n, np.uint64), 0
        while at < len(states):
            some = min(DRAWN, len(states) - at)
            states[at:at + some] = (self.powers[:some] * self.state + self.shifts[:some]) & MASK
            self.state, at = states[at + some - 1], at + some
        high, low = states[0::2] >> np.uint64(22), states[1::2] >> np.uint64(21)
        return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


class TopicFit:
    """A fit of k topics: counts of terms (negative ids) and documents, stored as a table."""

    def __init__(self, state: DataFrame, path: str, k: int, size: int) -> None:
        self.state, self.path, self.k, self.size = state, path, k, size

    def counts(self) -> DataFrame:
        """id, counts."""
        return topic_state.counts_table(self.state, self.k)

    def topicsMatrix(self) -> DenseMatrix:
        """Counts of terms by topic, on the driver: for few terms."""
        out = np.zeros((self.size, self.k))
        for r in self.counts().filter("id < 0").collect():
            out[-1 - r["id"]] = r["counts"]
        return DenseMatrix(self.size, self.k, out.ravel(order="F"))


def _start(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """Counts by random shares; ``cells``: id, block, terms, n in the order of the matrix."""

    def draw(batches):
        random = None
        for batch in batches:
            if not batch.num_rows:
                continue
            random = random or JavaRandom((batch["id"][0].as_py() >> 33) + seed)
            ids, blocks = batch["id"].to_numpy(), batch["block"].to_numpy()
            for rows, terms, n, starts in topic_state.portions(batch["terms"], batch["n"], k):
                doc = np.repeat(rows, np.diff([*starts, len(n)]))[n != 0]
                terms, n = terms[n != 0], n[n != 0]
                if not len(n):
                    continue
                shares = random.doubles(len(n) * k).reshape(-1, k)
                shares *= (n / shares.sum(1))[:, None]
                rows, starts = np.unique(doc, return_index=True)
                ends = np.append(starts[1:], len(n))
                lists = [topic_state.lists(v, ends, t) for v, t in ((terms, pa.int32()), (n, pa.float64()))]
                for block in np.unique(blocks[rows]):
                    own, mine = np.flatnonzero(blocks[rows] == block), blocks[doc] == block
                    found, at = np.unique(terms[mine], return_inverse=True)
                    total = np.zeros((len(found), k))
                    topic_state.add_up(total, at, shares[mine])
                    yield topic_state.state_rows(-1 - found.astype(np.int64), total, block=block)
                    yield topic_state.state_rows([topic_state.TOTALS], total.sum(0, keepdims=True), block=block)
                    of_docs = np.add.reduceat(shares, starts, axis=0)[own]
                    yield topic_state.state_rows(ids[rows[own]], of_docs, None, *[v.take(pa.array(own)) for v in lists], block=block)

    return cells.mapInArrow(released(draw), topic_state.FOUND)


def _expect(k: int):
    alpha = ALPHA_TOTAL / k

    def expect(rows, n, docs, before):
        cells = rows * np.repeat(before + alpha, np.diff([*docs, len(n)]), axis=0)
        cells *= (n / cells.sum(1))[:, None]
        return cells, np.add.reduceat(cells, docs, axis=0)

    return expect


def fit(matrix: DataFrame, k: int, seed: int, max_iter: int = 20) -> TopicFit:
    """Fit k topics to a stored matrix (doc_id, features)."""
    spark = matrix.sparkSession
    if k < 2:
        raise ValueError(f"{k} topics: at least 2")
    ship_package(spark)
    first = matrix.select(F.unwrap_udt("features")["size"].alias("size")).first()
    if first is None:
        raise ValueError("no documents")
    size, cells = first["size"], topic_state.cells(matrix)
    n_cells = cells.agg(F.sum(F.size("terms"))).first()[0]
    blocks = topic_state.block_count(spark.sparkContext.defaultParallelism, n_cells, k)
    cells = cells.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    state, path = store(topic_state.added(_start(cells, k, seed), k, blocks))
    for _ in range(max_iter):
        beta = topic_state.smoothed(topic_state.totals(state), size)
        found = topic_state.shares(topic_state.spread(state, None, blocks), k, beta, _expect(k), own=True)
        state, path, done = *store(topic_state.added(found, k, blocks)), path
        delete_folder(spark, done)
        drop_shuffles(spark)
    return TopicFit(state, path, k, size)

"""Topic models fitted on documents that stream by.

``models.fit_lda`` keeps every document's counts from step to step. Here
documents are read from the stored matrix in every step and only the topic counts
of terms live on, and models of several topic counts share a scan: the counts of one
term are one row for all of them.

The update is that of expectation maximisation with the usual priors: a word w of
document d belongs to topic t in proportion to
(n_wt + delta) / (n_t + V delta) * (n_dt + alpha). A document's own counts are found anew
in each step, from equal shares in ``INNER`` rounds, so none are kept.

The counts of terms stay with the executors (``topic_state``, ``bundles``): a block of documents gets
the rows of its own terms only, at most ``CELLS`` numbers, whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import ALPHA_TOTAL, DELTA
from corpusloom.operators import bundles, topic_state
from corpusloom.session import delete_folder, drop_shuffles, ship_package, store

CELLS = topic_state.CELLS
INNER = 3            # rounds for a document's own counts
BLOCK = 1 << 14      # cells of a block that shares a scan
SHIPPED = 1 << 26    # numbers that a step ships each way (512 MB), where one model does with less
TERMS = 1 << 12      # terms whose first counts are drawn together
DECAY, DELAY = 0.7, 8.0  # of the weight of later mini-batches


class Layout:
    """Where the topics of each model stand in a row of counts."""

    def __init__(self, ks: Sequence[int]) -> None:
        self.ks = list(ks)
        self.sizes = np.array(self.ks)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.width = int(self.sizes.sum())
        self.alpha = np.repeat(ALPHA_TOTAL / self.sizes, self.sizes)

    def expect(self, rows: np.ndarray, n: np.ndarray, docs: np.ndarray, _: None = None) -> tuple[np.ndarray, np.ndarray]:
        """Topic counts of cells, whose terms' weights are ``rows``, and of documents;
        ``docs``: where the (non-empty) documents start."""
        doc = np.repeat(np.arange(len(docs)), np.diff([*docs, len(n)]))
        mixture = np.add.reduceat(n, docs)[:, None] / np.repeat(self.sizes, self.sizes)
        for _ in range(INNER):
            cells = rows * (mixture + self.alpha)[doc]
            cells *= np.repeat(n[:, None] / np.add.reduceat(cells, self.starts, axis=1), self.sizes, axis=1)
            mixture = np.add.reduceat(cells, docs, axis=0)
        return cells, mixture


def shared_width(ks: Sequence[int], n_cells: int) -> int:
    """Topics of models that share a scan of ``n_cells`` cells. A step ships a row of counts
    per cell at most, to its block and back, and both lie on disk until it ends; so the more
    cells, the fewer models share it, down to one."""
    return max(min(SHIPPED // max(n_cells, 1), CELLS // BLOCK), *ks)


def groups(ks: Sequence[int], size: int) -> list[list[int]]:
    """Topic counts that share a scan: at most ``CELLS`` numbers for ``size`` cells."""
    out: list[list[int]] = []
    for k in sorted(set(ks)):
        if k * size > CELLS:
            raise ValueError(f"{k} topics of {size} cells exceed {CELLS} numbers; take smaller blocks or use fit_lda")
        if not out or (sum(out[-1]) + k) * size > CELLS:
            out.append([])
        out[-1].append(k)
    return out


def _drawn(layout: Layout, size: int, seed: int) -> Callable[[int, int], np.ndarray]:
    """Random counts of terms lo to hi - 1, the same for a model whichever others share its
    scan. Every task draws all numbers, ``TERMS`` terms at a time, and keeps those of its terms."""
    random = [np.random.default_rng([seed, k]) for k in layout.ks]
    at, some = 0, np.zeros((0, layout.width))

    def counts(lo: int, hi: int) -> np.ndarray:
        nonlocal at, some
        out, row = np.empty((hi - lo, layout.width)), lo
        while row < hi:
            while at + len(some) <= row:
                at += len(some)
                some = np.hstack([r.gamma(1.0, 1.0, (min(TERMS, size - at), k)) for r, k in zip(random, layout.ks, strict=True)])
            stop = min(hi, at + len(some))
            out[row - lo:stop - lo] = some[row - at:stop - at]
            row = stop
        return out

    return counts


def _needs(docs: DataFrame) -> DataFrame:
    """id, blocks of the terms that documents hold."""
    held = docs.select("block", F.explode("terms").alias("term")).distinct()
    return held.groupBy((-1 - F.col("term").cast("long")).alias("id")).agg(F.sort_array(F.collect_list("block")).alias("blocks"))


def fit_tables(matrix: DataFrame, size: int, ks: Sequence[int], seed: int, max_iter: int = 20,
               batches: int = 1) -> Iterator[tuple[list[int], DataFrame, str]]:
    """Topic counts of ``size`` terms for every topic count of ``ks``: tables of id
    (-1 - term), counts (of the models named with the table, side by side) and their
    folders, for ``delete_folder``. Models that share no scans are fitted one group after
    the other, each when it is asked for, so a caller that deletes its folder first keeps
    the counts of one group on disk.

    ``matrix`` (doc_id, features) is dealt out in blocks and written once. With
    ``batches`` > 1 each step reads one of so many shards of documents and moves the
    counts towards what that shard, scaled to the whole, gives, by ever less; then
    ``max_iter`` is the number of passes over all shards. Equal seeds give equal fits
    up to rounding.
    """
    spark = matrix.sparkSession
    ship_package(spark)
    parts = spark.sparkContext.defaultParallelism
    dealt, path = store(topic_state.cells(matrix, "doc_id").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).repartition(parts, "id"))
    known = {r["shard"]: r for r in dealt.groupBy("shard").agg(
        F.sum(F.size("terms")).alias("cells"), F.sum(F.aggregate("n", F.lit(0.0), lambda a, x: a + x)).alias("n")).collect()}
    n_cells = max((r["cells"] for r in known.values()), default=0)  # of a step
    for group in groups(ks, max(CELLS // shared_width(ks, n_cells), 1)):
        layout = Layout(group)
        of = bundles.Terms(size, layout.width)
        blocks = topic_state.block_count(parts, n_cells, layout.width)
        docs = dealt.withColumn("block", F.col("shard") * blocks + F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        bundled, docs_path = store(bundles.documents(docs, layout.width, blocks))
        state, kept = store(bundles.start(docs, of, partial(_drawn, layout, size, seed), parts))
        step, seen = 0, {}
        for _ in range(max_iter):
            for b in range(batches):
                if b not in known:  # no documents
                    seen[b] = 0.0
                    continue
                seen[b], scale, before = known[b]["n"], 1.0, 0.0
                if batches > 1:
                    if not seen[b]:
                        continue
                    weight = (step + DELAY) ** -DECAY if step else 1.0
                    scale, before = weight * (sum(seen.values()) * batches / len(seen) / seen[b]), 1 - weight
                state, kept, done = *_step(state, bundled, layout, of, blocks, b, scale, before), kept
                delete_folder(spark, done)
                drop_shuffles(spark)
                step += 1
        delete_folder(spark, docs_path)
        yield group, bundles.counts_table(state, of), kept
    delete_folder(spark, path)


def _step(state: DataFrame, docs: DataFrame, layout: Layout, of: bundles.Terms, blocks: int, shard: int, scale: float,
          before: float) -> tuple[DataFrame, str]:
    """The state after one scan of a shard's documents: what they give times ``scale`` and
    the counts before times ``before``."""
    beta = topic_state.smoothed(bundles.totals(state), of.size)
    rows = bundles.spread(state, docs, of, blocks, shard * blocks)
    return store(bundles.added(bundles.found(rows, of, beta, layout.expect), state, of, blocks, scale, before))


def fit(matrix: DataFrame, size: int, ks: Sequence[int], seed: int, max_iter: int = 20, batches: int = 1) -> dict[int, np.ndarray]:
    """``fit_tables`` of few terms as arrays on the driver: topic count, counts by term."""
    out: dict[int, np.ndarray] = {}
    for group, table, path in fit_tables(matrix, size, ks, seed, max_iter, batches):
        rows = table.orderBy(F.desc("id")).collect()
        counts = np.array([r["counts"] for r in rows]).reshape(size, sum(group))
        for k, part in zip(group, np.split(counts, np.cumsum(group)[:-1], axis=1), strict=True):
            out[k] = part
        delete_folder(matrix.sparkSession, path)
    return out


def counts_table(spark: SparkSession, counts: np.ndarray) -> DataFrame:
    """term_id, counts of a fit, as ``models.topic_terms`` reads them (ids negative)."""
    flat = pa.array(np.ascontiguousarray(counts).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * counts.shape[1], pa.int32()), flat)
    return spark.createDataFrame(pa.table({"id": pa.array(-1 - np.arange(len(counts)), pa.int64()), "counts": lists}))


def doc_topics(matrix: DataFrame, counts: DataFrame | np.ndarray, k: int | None = None) -> DataFrame:
    """doc_id, weights: (n_dt + alpha) / (n_d + k alpha) for every document; one
    without terms has equal weights. ``counts``: a table of ``fit_tables`` of ``k`` topics
    or an array."""
    spark = matrix.sparkSession
    ship_package(spark)
    if isinstance(counts, np.ndarray):
        counts, k = counts_table(spark, counts), counts.shape[1]
    layout, alpha = Layout([k]), ALPHA_TOTAL / k
    known = counts.agg(F.count("*").alias("size"), *[F.sum(F.col("counts")[t]).alias(f"t{t}") for t in range(k)]).first()
    beta = topic_state.smoothed(np.array(known[1:]), known["size"])
    docs, parts = topic_state.cells(matrix, "doc_id"), spark.sparkContext.defaultParallelism
    n_cells = docs.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = topic_state.block_count(parts, n_cells, k)
    # by the row itself: the table is read twice, and may come in another order
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "terms", "n"), F.lit(blocks)).cast("int"))

    def as_rows(batches):
        for batch in batches:
            yield topic_state.state_rows(batch["id"], batch["counts"].flatten().to_numpy().reshape(-1, k), batch["blocks"])

    def infer(batches):
        for _, block, docs in topic_state.by_block(batches, k, beta):
            if docs is None:
                continue
            found = np.zeros((docs.num_rows, k))
            for rows, terms, n, starts in topic_state.portions(docs["terms"], docs["n"], k):
                found[rows] = layout.expect(block.beta[block.places(terms)], n, starts)[1]
            weights = (found + alpha) / (found.sum(1, keepdims=True) + k * alpha)
            lists = topic_state.lists(weights.ravel(), np.arange(1, docs.num_rows + 1) * k, pa.float64())
            yield pa.RecordBatch.from_arrays([docs["doc_id"], lists], ["doc_id", "weights"])

    state = counts.join(_needs(docs), "id").mapInArrow(as_rows, topic_state.STATE)
    return topic_state.spread(state, docs, blocks).mapInArrow(infer, "doc_id long, weights array<double>")

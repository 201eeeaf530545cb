"""Topic counts of terms as few long rows.

The steps of ``streamed_fits``, where a row per term and block would cost Spark more than its
numbers do. Terms are dealt out in runs of ``Terms.run`` consecutive ids: a state has a row
per run with the counts of its terms and the terms that each block of documents needs. In a
step a run's rows go to the blocks bundled, what a block found comes back bundled by run, and
a run's bundles are added up in the order of blocks. Documents lie bundled as well, as many
as a worker handles together. So a step ships what ``topic_state`` ships, in rows of at most
``NUMBERS`` numbers (more only for a document that holds more).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.memory import released
from corpusloom.operators import topic_state

NUMBERS = 1 << 15          # of a row: 256 KB
TOTALS = -1                # run of the rows of topic totals
DOCUMENTS = (1 << 63) - 1  # run of documents' rows: after those of terms
STATE = "run long, counts binary, blocks binary, ends binary, places binary"
BUNDLE = "block int, run long, terms binary, counts binary"
DOCS = "block int, terms binary, n binary, starts binary"


class Terms:
    """``size`` terms with ``width`` counts each, in runs."""

    def __init__(self, size: int, width: int) -> None:
        self.size, self.width = size, width
        self.run = max(NUMBERS // width, 1)
        self.runs = -(-size // self.run)

    def bounds(self, run: int) -> tuple[int, int]:
        return run * self.run, min((run + 1) * self.run, self.size)


# --- columns ----------------------------------------------------------------------

def packed(values: np.ndarray, ends: np.ndarray | list[int]) -> pa.Array:
    """Bytes of runs of ``values``, which end at ``ends``."""
    data = np.ascontiguousarray(values)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * (data.itemsize * int(np.prod(data.shape[1:])))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes() if not data.size else data)])


def column(batch: pa.RecordBatch, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in batch[name].cast(pa.binary())]


def batch(kinds: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[name]) for name, c in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


KINDS = {"run": pa.int64(), "block": pa.int32()}


def state_row(run: int, counts: np.ndarray, blocks: np.ndarray, ends: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    one = {name: packed(np.asarray(v, np.int32), [len(v)]) for name, v in (("blocks", blocks), ("ends", ends), ("places", places))}
    return batch(KINDS, run=[run], counts=packed(counts, [len(counts)]), **one)


def total_row(total: np.ndarray) -> pa.RecordBatch:
    return state_row(TOTALS, total[None, :], [], [], [])


# --- tables -----------------------------------------------------------------------

def documents(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """Rows of documents that are handled together; ``docs``: block, id, terms, n."""

    def bundle(batches):
        for part in batches:
            at = part["block"].to_numpy()
            new = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *new], [*new, len(at)], strict=True):
                some = part.slice(lo, hi - lo)
                for _, terms, n, starts in topic_state.portions(some["terms"], some["n"], width):
                    yield batch(KINDS, block=[at[lo]], terms=packed(terms.astype(np.int32), [len(terms)]), n=packed(n.astype(np.float64), [len(n)]),
                                starts=packed(starts.astype(np.int64), [len(starts)]))

    dealt = docs.select("block", "id", "terms", "n").repartitionById(blocks, "block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(released(bundle), DOCS)


def start(docs: DataFrame, of: Terms, draw: Callable[[], Callable[[int, int], np.ndarray]], parts: int) -> DataFrame:
    """The first state: counts of terms lo to hi - 1 are ``draw()(lo, hi)``, asked for in
    rising order; ``docs``: block, terms."""
    held = docs.select("block", F.explode("terms").alias("term")).distinct()
    needs = held.groupBy(F.expr(f"term div {of.run}").alias("run"), "block").agg(
        F.sort_array(F.collect_list(F.col("term") % of.run)).alias("places")
    ).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("block", "places"))).alias("needs"))
    runs = docs.sparkSession.range(of.runs).withColumnRenamed("id", "run").join(needs, "run", "left")

    def first(batches):
        counts_of, total = draw(), np.zeros(of.width)
        for part in batches:
            for run, row in zip(part["run"].to_pylist(), part["needs"], strict=True):
                counts = counts_of(*of.bounds(run))
                total += counts.sum(0)
                blocks, places = row.values.flatten()
                offsets = places.offsets.to_numpy()
                yield state_row(run, counts, blocks.to_numpy(), offsets[1:] - offsets[0], places.values.to_numpy()[offsets[0]:offsets[-1]])
        yield total_row(total)

    dealt = runs.select("run", "needs").repartition(parts, "run").sortWithinPartitions("run")
    return topic_state.filled(dealt).mapInArrow(released(first), STATE)


def totals(state: DataFrame) -> np.ndarray:
    """Topic totals of a stored state: a row per task that wrote it."""
    found = state.filter(F.col("run") == TOTALS).select("counts").collect()
    return np.sum([np.frombuffer(c, np.float64) for c in sorted(bytes(r.counts) for r in found)], axis=0)


def counts_table(state: DataFrame, of: Terms) -> DataFrame:
    """id (-1 - term), counts of all terms."""

    def plain(batches):
        for part in batches:
            for run, counts in zip(part["run"].to_pylist(), column(part, "counts", np.float64), strict=True):
                lo, hi = of.bounds(run)
                lists = topic_state.lists(counts, np.arange(1, hi - lo + 1) * of.width, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(lo, hi), pa.int64()), lists], ["id", "counts"])

    return state.filter(F.col("run") != TOTALS).select("run", "counts").mapInArrow(plain, "id long, counts array<double>")


# --- a step -----------------------------------------------------------------------

def spread(state: DataFrame, docs: DataFrame, of: Terms, blocks: int, lowest: int) -> DataFrame:
    """Blocks ``lowest`` to ``lowest + blocks - 1``: bundles of their terms' counts, then their documents."""

    def bundles(batches):
        for part in batches:
            rows = zip(part["run"].to_pylist(), *[column(part, c, t) for c, t in (
                ("counts", np.float64), ("blocks", np.int32), ("ends", np.int32), ("places", np.int32))], strict=True)
            for run, counts, homes, ends, places in rows:
                lo, hi = np.searchsorted(homes, [lowest, lowest + blocks])
                if lo < hi:
                    first = ends[lo - 1] if lo else 0
                    wanted, stops = places[first:ends[hi - 1]], ends[lo:hi] - first
                    yield batch(KINDS, block=homes[lo:hi], run=[run] * (hi - lo), terms=packed((run * of.run + wanted).astype(np.int32), stops),
                                counts=packed(counts.reshape(-1, of.width)[wanted], stops))

    rows = state.filter(F.col("run") != TOTALS).mapInArrow(released(bundles), BUNDLE)
    of_docs = docs.filter((F.col("block") >= lowest) & (F.col("block") < lowest + blocks)).withColumn("run", F.lit(DOCUMENTS))
    both = rows.unionByName(of_docs, allowMissingColumns=True)
    return topic_state.filled(both.repartitionById(blocks, "block").sortWithinPartitions("block", "run"))


def found(rows: DataFrame, of: Terms, beta: Callable, expect: Callable) -> DataFrame:
    """What every block found of its terms, bundled by run."""

    def step(batches: Iterator[pa.RecordBatch]):
        now, ids, counts, weights, total = None, [], [], None, None
        for part in batches:
            columns = [column(part, c, t) for c, t in (("terms", np.int32), ("counts", np.float64), ("n", np.float64), ("starts", np.int64))]
            for block, run, terms, numbers, n, starts in zip(part["block"].to_pylist(), part["run"].to_pylist(), *columns, strict=True):
                if block != now:
                    if total is not None:
                        yield from back(now, ids, total)
                    now, ids, counts, weights, total = block, [], [], None, None
                if run != DOCUMENTS:
                    ids.append(terms.copy())
                    counts.append(numbers.reshape(-1, of.width).copy())
                    continue
                if total is None:
                    ids, weights = np.concatenate(ids or [np.zeros(0, np.int32)]), beta(np.concatenate(counts or [np.zeros((0, of.width))]))
                    counts, total = None, np.zeros((len(ids), of.width))
                at = np.minimum(np.searchsorted(ids, terms), max(len(ids) - 1, 0))
                if not len(ids) or (ids[at] != terms).any():
                    raise ValueError("a document has terms without counts")
                topic_state.add_up(total, at, expect(weights[at], n, starts)[0])
        if total is not None:
            yield from back(now, ids, total)

    def back(block: int, ids: np.ndarray, total: np.ndarray):
        """The block's terms are in rising order, so a run's are neighbours."""
        runs, first = np.unique(ids // of.run, return_index=True)
        ends, most, at = np.append(first[1:], len(ids)), max(topic_state.PORTION // of.width, 1), 0
        while at < len(runs):
            stop = max(int(np.searchsorted(ends, first[at] + most, side="right")), at + 1)
            lo, hi = first[at], ends[stop - 1]
            yield batch(KINDS, block=[block] * (stop - at), run=runs[at:stop], terms=packed(ids[lo:hi], ends[at:stop] - lo),
                        counts=packed(total[lo:hi], ends[at:stop] - lo))
            at = stop

    return rows.mapInArrow(released(step), BUNDLE)


def added(bundles: DataFrame, state: DataFrame, of: Terms, parts: int, scale: float, before: float) -> DataFrame:
    """The next state: what blocks found times ``scale``, and the counts of ``state`` times ``before``."""

    def add(batches: Iterator[pa.RecordBatch]):
        now, total, needs, every = None, None, None, np.zeros(of.width)
        for part in batches:
            columns = [column(part, c, t) for c, t in (
                ("terms", np.int32), ("counts", np.float64), ("blocks", np.int32), ("ends", np.int32), ("places", np.int32))]
            for run, block, terms, numbers, *lists in zip(part["run"].to_pylist(), part["block"].to_pylist(), *columns, strict=True):
                if block < 0:  # the state's own row is a run's first
                    if now is not None:
                        every += total.sum(0)
                        yield state_row(now, total, *needs)
                    lo, hi = of.bounds(run)
                    now, needs = run, [v.copy() for v in lists]
                    total = numbers.reshape(-1, of.width) * before if len(numbers) else np.zeros((hi - lo, of.width))
                else:
                    total[terms - run * of.run] += numbers.reshape(-1, of.width) * scale  # a term once
        if now is not None:
            every += total.sum(0)
            yield state_row(now, total, *needs)
            yield total_row(every)

    old = state.filter(F.col("run") != TOTALS).withColumn("block", F.lit(-1))
    if not before:
        old = old.withColumn("counts", F.lit(None).cast("binary"))
    both = bundles.unionByName(old, allowMissingColumns=True)
    home: Column = (F.col("run") % parts).cast("int")
    return topic_state.filled(both.repartitionById(parts, home).sortWithinPartitions("run", "block")).mapInArrow(released(add), STATE)

"""Topic counts that stay with the executors.

A fit's state is a table: a row per term (its counts, and the blocks of documents that
hold it) and, where a fit keeps them, a row per document. In a step each term's row goes to
its blocks, a block's documents share out their words there, and what the blocks found is
added up by term. So a step shuffles one row per term and block, at most one per cell of
the matrix; neither the driver nor any task ever holds the counts of all terms. The
driver reads one row of topic totals per step.

Terms have negative ids (-1 - term), documents their number; a term's counts are one
row of ``width`` doubles as bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import DELTA
from corpusloom.memory import released

TOTALS = -(1 << 62)  # id of the rows of topic totals
CELLS = 1 << 23      # numbers of a block's terms: 64 MB
PORTION = 1 << 18    # numbers that a worker handles together
ROWS = 1 << 12       # rows handed over together
REPEATS = 32         # rows of a place that are added up beside those of others
STATE = "id long, blocks array<int>, counts binary, terms array<int>, n array<double>"
FOUND = f"{STATE}, block int"
KINDS = [("id", pa.int64()), ("blocks", pa.list_(pa.int32())), ("counts", pa.binary()), ("terms", pa.list_(pa.int32())),
         ("n", pa.list_(pa.float64()))]


# --- columns ----------------------------------------------------------------------

def numbers(column: pa.Array, width: int) -> np.ndarray:
    """The byte rows of a column, neither null nor empty, as rows of doubles."""
    column = column.drop_null().cast(pa.binary())
    if not len(column):
        return np.zeros((0, width))
    _, offsets, data = column.buffers()
    start, *_, stop = np.frombuffer(offsets, np.int32)[column.offset:][:len(column) + 1].tolist()
    if start == stop:
        return np.zeros((0, width))
    return np.frombuffer(data, np.float64, (stop - start) // 8, start).reshape(-1, width)


def as_bytes(rows: np.ndarray) -> pa.Array:
    data, size = np.ascontiguousarray(rows, np.float64), rows.shape[1] * 8
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def filled(rows: DataFrame) -> DataFrame:
    """Rows for Python, with empty bytes and lists in place of nulls: for every row, Spark's
    Arrow writer goes again over all nulls that stand together in such a column of its batch."""
    kinds = dict(rows.dtypes)
    empty = {c: F.array().cast(k) if k.startswith("array") else F.expr("X''") for c, k in kinds.items()
             if k == "binary" or k.startswith("array")}
    return rows.withColumns({c: F.coalesce(c, e) for c, e in empty.items()})


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``values``, which end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def state_rows(ids: np.ndarray | pa.Array, counts: np.ndarray, blocks: pa.Array | None = None, terms: pa.Array | None = None,
               n: pa.Array | None = None, block: int | None = None) -> pa.RecordBatch:
    """Rows of a state, or of what a block found; all batches of equal types."""
    columns = [ids, blocks, as_bytes(counts), terms, n]
    kinds = KINDS if block is None else [*KINDS, ("block", pa.int32())]
    if block is not None:
        columns.append(np.full(len(counts), block, np.int32))
    arrays = [pa.nulls(len(counts), kind) if c is None else c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind)
              for c, (_, kind) in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in kinds])


def cells(matrix: DataFrame, *keep: str) -> DataFrame:
    """id (place in the table), kept columns, terms and n of the matrix's rows."""
    v = F.unwrap_udt("features")
    every = F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return matrix.select(F.monotonically_increasing_id().alias("id"), *keep,
                         F.when(v["type"] == 0, v["indices"]).otherwise(every).alias("terms"), v["values"].alias("n"))


def portions(terms: pa.Array, n: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their cells' terms and counts, and where the rows start; documents
    without terms are left out, none is split."""
    ends = terms.offsets.to_numpy().astype(np.int64)
    every, counts = terms.values.to_numpy(), n.flatten().to_numpy()
    counts_from = ends[0]  # flatten() drops what lies before a slice
    lengths = np.diff(ends)
    row, most = 0, max(PORTION // width, 1)
    while row < len(lengths):
        stop = max(int(np.searchsorted(ends, ends[row] + most, side="right")) - 1, row + 1)
        rows = np.arange(row, stop)[lengths[row:stop] > 0]
        if len(rows):
            lo, hi = ends[row], ends[stop]
            yield rows, every[lo:hi], counts[lo - counts_from:hi - counts_from], ends[rows] - lo
        row = stop


def add_up(total: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
    """total[at] += found, equal places added up first: all second rows at once, then all
    third ones and so on. ``reduceat`` down the rows takes twice as long."""
    order = np.argsort(at, kind="stable")
    places, first, times = np.unique(at[order], return_index=True, return_counts=True)
    most = np.argsort(-times, kind="stable")
    places, first, times = places[most], first[most], times[most]
    sums = found[order[first]]
    for j in range(1, min(int(times.max(initial=0)), REPEATS)):
        more = int(np.searchsorted(-times, -j))
        sums[:more] += found[order[first[:more] + j]]
    for i in range(int(np.searchsorted(-times, -REPEATS))):
        sums[i] += found[order[first[i] + REPEATS:first[i] + times[i]]].sum(0)
    total[places] += sums


# --- a step -----------------------------------------------------------------------

def spread(state: DataFrame, docs: DataFrame | None, blocks: int) -> DataFrame:
    """block, id, doc_id, counts, terms, n: blocks with their terms' rows first, then their
    documents'. ``docs`` (block, id, doc_id, terms, n) if the state holds none."""
    rows = state.filter(F.col("id") != TOTALS).select(F.explode("blocks").alias("block"), "id", F.lit(None).cast("long").alias("doc_id"), "counts", "terms", "n")
    if docs is not None:
        rows = rows.unionByName(docs.select("block", "id", "doc_id", F.lit(None).cast("binary").alias("counts"), "terms", "n"))
    return filled(rows.repartitionById(blocks, "block").sortWithinPartitions("block", "id"))


class Block:
    """A block's terms and what its documents make of them."""

    def __init__(self, width: int) -> None:
        self.width, self.ids, self.counts, self.total = width, [], [], None

    def put(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(ids)
        self.counts.append(counts)

    def ready(self, beta: Callable[[np.ndarray], np.ndarray]) -> None:
        if self.total is None:
            self.ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
            self.beta = beta(np.concatenate(self.counts)) if self.counts else np.zeros((0, self.width))
            self.counts, self.total = None, np.zeros((len(self.ids), self.width))

    def places(self, terms: np.ndarray) -> np.ndarray:
        ids = -1 - terms.astype(np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        if not len(self.ids) or (self.ids[at] != ids).any():
            raise ValueError("a document has terms without counts")
        return at


def by_block(batches: Iterator[pa.RecordBatch], width: int, beta: Callable) -> Iterator[tuple[int, Block, pa.RecordBatch | None]]:
    """Documents of each block with the block, and at its end the block alone."""
    now, block = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, ids = batch["block"].to_numpy(), batch["id"].to_numpy()
        new = np.flatnonzero((np.diff(at) != 0) | (np.diff(ids >= 0))) + 1
        for lo, hi in zip([0, *new], [*new, len(ids)], strict=True):
            if now != at[lo]:
                if block:
                    block.ready(beta)
                    yield now, block, None
                now, block = int(at[lo]), Block(width)
            part = batch.slice(lo, hi - lo)
            if ids[lo] < 0:
                block.put(ids[lo:hi].copy(), numbers(part["counts"], width).copy())
            else:
                block.ready(beta)
                yield now, block, part
    if block:
        block.ready(beta)
        yield now, block, None


def shares(rows: DataFrame, width: int, beta: Callable, expect: Callable, own: bool) -> DataFrame:
    """What every block found of its terms and in all, a row per term and block. ``expect``
    (rows' beta, n, where documents start, their counts) gives counts of cells and of
    documents. With ``own`` documents' rows carry their counts on."""

    def step(batches):
        for at, block, docs in by_block(batches, width, beta):
            if docs is None:
                for lo in range(0, len(block.ids), ROWS):
                    yield state_rows(block.ids[lo:lo + ROWS], block.total[lo:lo + ROWS], block=at)
                yield state_rows([TOTALS], block.total.sum(0, keepdims=True), block=at)
                continue
            before = numbers(docs["counts"], width) if own else None
            after = np.zeros((docs.num_rows, width)) if own else None
            for rows, terms, n, starts in portions(docs["terms"], docs["n"], width):
                places = block.places(terms)
                found, mixture = expect(block.beta[places], n, starts, before[rows] if own else None)
                add_up(block.total, places, found)
                if own:
                    after[rows] = mixture
            if own:
                yield state_rows(docs["id"], after, None, docs["terms"], docs["n"], block=at)

    return rows.mapInArrow(released(step), FOUND)


def added(found: DataFrame, width: int, parts: int) -> DataFrame:
    """A state of the rows found: counts of an id added up in the order of blocks, so a
    repeated run adds them up alike."""

    def add(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            ids = rows[0]["id"].to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))  # the last id may go on
            if last:
                yield added_up(rows[0].slice(0, last))
            held = rows[0].slice(last)
        if held is not None and held.num_rows:
            yield added_up(held)

    def added_up(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, blocks = rows["id"].to_numpy(), rows["block"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0]))
        group = np.cumsum(np.concatenate([[0], np.diff(ids) != 0]))
        valid = pc.fill_null(pc.greater(pc.binary_length(rows["counts"]), 0), False).to_numpy(zero_copy_only=False)
        counts, of = numbers(rows["counts"], width), group[valid]
        total = np.zeros((len(first), width))
        if len(of):
            starts = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
            total[of[starts]] = np.add.reduceat(counts, starts, axis=0)
        take = pa.array(first)
        new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(blocks) != 0)])
        homes = lists(blocks[new], np.cumsum(np.add.reduceat(new.astype(int), first)), pa.int32())
        return state_rows(ids[first], total, homes, rows["terms"].take(take), rows["n"].take(take))

    dealt = found.repartition(parts, "id").sortWithinPartitions("id", "block", "counts")
    return filled(dealt).mapInArrow(released(add), STATE)


def totals(state: DataFrame) -> np.ndarray:
    """Topic totals of a stored state: a row, or one per task of its start."""
    found = state.filter(F.col("id") == TOTALS).select("counts").collect()
    return np.sum([np.frombuffer(c, np.float64) for c in sorted(bytes(r.counts) for r in found)], axis=0)


def counts_table(state: DataFrame, width: int) -> DataFrame:
    """id, counts (doubles) of a state's terms and documents."""

    def plain(batches):
        for batch in batches:
            rows = numbers(batch["counts"], width)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], lists(rows.ravel(), np.arange(1, len(rows) + 1) * width, pa.float64())], ["id", "counts"])

    return state.filter(F.col("id") != TOTALS).select("id", "counts").mapInArrow(plain, "id long, counts array<double>")


def block_count(parallelism: int, n_cells: int, width: int) -> int:
    """Blocks of a matrix: one per core, more where a block's terms would exceed ``CELLS`` numbers."""
    return max(parallelism, -(-n_cells * width // CELLS))


def smoothed(of_topics: np.ndarray, size: int, delta: float = DELTA) -> Callable[[np.ndarray], np.ndarray]:
    """Counts of terms to (n_wt + delta) / (n_t + V delta)."""
    below = of_topics + size * delta
    return lambda counts: (counts + delta) / below

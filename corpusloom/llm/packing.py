"""Best-fit packing of tokenised documents by exact complements.

Sequences hold ``capacity`` tokens. Only lengths matter for who shares a
sequence, so the plan is made on the histogram of piece lengths (at most
``capacity`` rows): a sequence opens with the longest length left; its gap is
looked up among single lengths, sums of two and sums of three that are still
available, and an exact match closes it; otherwise the longest length that fits
goes in and the lookup repeats. A found combination is consumed as often as the
counts allow. Pieces then take the places of their length by rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.memory import released, sliced
from corpusloom.llm.tokens import encoder
from corpusloom.session import cut_lineage, ship_package

CAPACITY = 2048
END_ID = 0


# --- the plan, on the histogram ---------------------------------------------------

def _pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Available lengths a >= b with a + b = gap, the largest a."""
    half = -(-gap // 2)
    a = np.arange(half, gap)
    a = a[(left[a] > 0) & (left[gap - a] > 0)]
    if len(a) and 2 * a[0] == gap and left[a[0]] < 2:
        a = a[1:]
    return (int(a[-1]), gap - int(a[-1])) if len(a) else None


def exact_fill(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``."""
    if gap < len(left) and left[gap] > 0:
        return (gap,)
    if found := _pair(left, gap):
        return found
    for a in np.flatnonzero(left[: gap - 1])[::-1]:
        if 3 * a < gap:
            return None
        left[a] -= 1
        rest = _pair(left, gap - int(a))
        left[a] += 1
        if rest:
            return (int(a), *rest)
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns: the lengths that share a sequence, and how many sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns = []
    while left.any():
        inside: list[int] = []
        gap, spare = capacity, left.copy()
        while gap:
            fill = exact_fill(spare, gap) if inside else None
            if fill is None:
                fits = np.flatnonzero(spare[: gap + 1])
                if not len(fits):
                    break
                fill = (int(fits[-1]),)
            for length in fill:
                inside.append(length)
                spare[length] -= 1
                gap -= length
        kinds, each = np.unique(inside, return_counts=True)
        times = int((left[kinds] // each).min())
        left[kinds] -= each * times
        patterns.append((inside, times))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, sequence of the first rank, offset)."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for inside, times in patterns:
        offset = 0
        for length in inside:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {length: np.array(r, np.int64).reshape(-1, 3) for length, r in rows.items()}


# --- pieces and their places --------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every document: its ids and an end id, cut at ``capacity``.
    ``place`` numbers the pieces of a length within the task (``part``)."""

    def cut(batches):
        encode = encoder(vocabulary).ids
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py()) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start:start + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, piece, start // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(released(cut), PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Takes ``doc_id`` and ``text``; other columns do not matter. A null or empty
    text is its end id alone. Repeated rows are packed each; a null id stays
    null. An empty table gives no row. ``vocabulary`` is a path that workers
    can open (default: the public file of the machine).
    """
    ship_package(docs.sparkSession)
    cut = cut_lineage(pieces(docs, capacity, vocabulary))
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def put(batches):
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["rank"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, first = np.unique(length[order], return_index=True)
            for kind, rows in zip(kinds, np.split(order, first[1:]), strict=True):
                table = where[int(kind)]
                at = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[at, 1] + rank[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

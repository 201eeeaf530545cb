"""Near-duplicates by SimHash fingerprints in a Gray-order hierarchical index.

1. Every whole text becomes a 64-bit fingerprint: a bit is 1 if it is set in over
   half of the hashes of the text's three-word shingles, repeats included.
2. The distinct fingerprints enter an index. Its topmost nodes share a whole block
   of bits: of four blocks at least one is equal in two fingerprints that differ in
   at most three bits, so each fingerprint stands under four of them, and no link is
   lost. A node that holds too many fingerprints is factored again by the bits that
   it leaves open, in four blocks, and so on: 2^open bits bound what is in it.
3. Under such a node fingerprints are sorted by Gray rank, so neighbours agree in
   long runs of bits. Groups of neighbours form nodes, groups of nodes the next
   ones; each holds the bits (mask) and their pattern in which all below agree.
   The index is searched against itself from the top: two nodes' patterns differ in
   so many bits that both masks fix, and pairs beyond three go with all below them;
   children fix more bits, and the differences add up on the way down. Two nodes
   that stand in one component already need no comparison.
4. Links leave a task as one star per component; components are contracted by
   large-star and small-star steps.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graph import components, join_unique
from corpusloom.session import delete_folder, ship_package, store

WORDS = 3
SEED = 42
DISTANCE = 3
BITS = 64
FAN_OUT = 16              # children of an index node
NODE_ROWS = 1 << 12       # fingerprints that a topmost node may hold at least
NODE_SHARE = 16           # .. or one of 2^16 of all: so at most 2^16 nodes are factored again
ROWS_AT_ONCE = 1 << 17    # fingerprints that a worker indexes together
PAIRS_AT_ONCE = 1 << 20   # pairs of nodes that are compared together
TEXT_AT_ONCE = 1 << 20    # bytes of text that are cut into shingles together

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints -----------------------------------------------------------------

def _shingle_hashes(text: bytes):
    """Arrays of the hashes of a text's shingles, portion by portion."""
    words: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        cut = _SPACE.search(text, at + TEXT_AT_ONCE)
        stop = cut.start() if cut else len(text)
        words += text[at:stop].lower().split()  # bytes: A-Z and the six ASCII spaces only
        at = stop
        if len(words) >= WORDS:
            some, joined = True, b" ".join(words)
            ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
            starts = [0, *(e + 1 for e in ends)]
            yield np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[WORDS - 1:], strict=False)],
                           np.uint64)
            words = words[1 - WORDS:]
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of a text in UTF-8; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(text):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def take(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = np.array([fingerprint(t or b"") for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(take, "doc_id long, fp long")


# --- the index under one topmost node -----------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of 64-bit codes in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Index:
    """Fingerprints under their topmost nodes (``top``, one number per row), which
    must come together, as a hierarchy of nodes: level 0 the rows, above it
    ``FAN_OUT`` neighbours each, up to one node per topmost node."""

    def __init__(self, top: np.ndarray, codes: np.ndarray) -> None:
        order = np.lexsort((gray_rank(codes), top))
        top, codes = top[order], codes[order]
        again = np.concatenate([[False], (top[1:] == top[:-1]) & (codes[1:] == codes[:-1])])
        top, codes = top[~again], codes[~again]
        self.codes = codes
        self.pattern, self.mask = [codes], [np.full(len(codes), ~np.uint64(0))]
        self.first: list[np.ndarray] = [np.arange(len(codes))]
        self.many: list[np.ndarray] = [np.ones(len(codes), np.int64)]
        ones, some = codes, codes  # bits that all below have, and that any has
        while True:
            starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
            if len(starts) == len(top):
                break
            place = np.arange(len(top)) - np.repeat(starts, np.diff([*starts, len(top)]))
            starts = np.flatnonzero(place % FAN_OUT == 0)
            ones, some, top = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts), top[starts]
            self.first.append(starts)
            self.many.append(np.diff([*starts, len(place)]))
            self.pattern.append(ones)
            self.mask.append(~(ones ^ some))
        self.label = np.arange(len(codes))  # the smallest row known to be linked
        self._spread()

    def _spread(self) -> None:
        """Smallest and largest label below every node."""
        self.low, self.high = [self.label], [self.label]
        for starts in self.first[1:]:
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of paired nodes that may still hold a link."""
        below = level - 1
        n, m = self.many[level][a], self.many[level][b]
        pair = np.repeat(np.arange(len(a)), n * m)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        x = self.first[level][a][pair] + at // m[pair]
        y = self.first[level][b][pair] + at % m[pair]
        once = x < y if below == 0 else x <= y
        x, y = x[once], y[once]
        known = self.mask[below][x] & self.mask[below][y]
        near = np.bitwise_count((self.pattern[below][x] ^ self.pattern[below][y]) & known) <= DISTANCE
        x, y = x[near], y[near]
        low = np.minimum(self.low[below][x], self.low[below][y])
        high = np.maximum(self.high[below][x], self.high[below][y])
        return x[low < high], y[low < high]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and the one that stands for their component, both signed."""
        top = len(self.first) - 1
        nodes = np.arange(len(self.first[top]))
        work = [(top, nodes, nodes)] if top else []
        while work:
            level, a, b = work.pop()
            size = np.cumsum(self.many[level][a] * self.many[level][b])
            if size[-1] > PAIRS_AT_ONCE and len(a) > 1:
                cut = max(int(np.searchsorted(size, PAIRS_AT_ONCE)), 1)
                work += [(level, a[cut:], b[cut:])]
                a, b = a[:cut], b[:cut]
            x, y = self._children(level, a, b)
            if not len(x):
                continue
            if level == 1:
                self._merge(x, y)
                if work:
                    self._spread()
                continue
            order = np.argsort(y - x, kind="stable")  # near neighbours first: they are linked most
            work.append((level - 1, x[order], y[order]))
        moved = np.flatnonzero(self.label != np.arange(len(self.codes)))
        return self.codes[moved].view(np.int64), self.codes[self.label[moved]].view(np.int64)


# --- the index as a whole -----------------------------------------------------------

def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def blocks(mask: int) -> list[int]:
    """The masks that add to ``mask`` one of DISTANCE + 1 blocks of its open bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(i * len(free) / (DISTANCE + 1)) for i in range(DISTANCE + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _indexed(rows: DataFrame) -> DataFrame:
    """a, b: stars of the links under every topmost node of mask, value, fp."""

    def search(batches):
        kept: list[pa.Table] = []
        size = 0

        def found(table: pa.Table) -> pa.RecordBatch:
            mask, value = table["mask"].to_numpy(), table["value"].to_numpy()
            top = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
            a, b = Index(top, table["fp"].to_numpy().view(np.uint64)).links()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < ROWS_AT_ONCE:
                continue
            table = pa.concat_tables(kept)
            mask, value = table["mask"].to_numpy(), table["value"].to_numpy()
            last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last node may go on in the next batch
            if cut:
                yield found(table.slice(0, cut))
            kept, size = [table.slice(cut)], table.num_rows - cut
        if size:
            yield found(pa.concat_tables(kept))

    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(search, "a long, b long")


def links(codes: DataFrame) -> DataFrame:
    """a, b: links that connect all of the distinct fingerprints ``fp`` (stored)
    that a chain of pairs within DISTANCE bits connects, stored."""
    spark = codes.sparkSession
    out: list[DataFrame] = []

    def under(rows: DataFrame, masks: list[int]) -> DataFrame:
        """The rows (mask, fp) under every mask that follows their own one."""
        inner = spark.createDataFrame(
            [(_signed(m), [_signed(x) for x in blocks(m)]) for m in masks], "mask long, inner array<long>"
        )
        exploded = rows.join(F.broadcast(inner), "mask").select("fp", F.explode("inner").alias("mask"))
        return exploded.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")

    work, paths = under(codes.select(F.lit(0).cast("long").alias("mask"), "fp"), [0]), []
    while True:
        counts = work.groupBy("mask", "value").agg(F.count("*").alias("n"))
        least = max(NODE_ROWS, work.count() >> NODE_SHARE)
        # few open bits are few fingerprints, and fewer than 2^NODE_SHARE nodes are full
        still_open = BITS - F.bit_count("mask") >= NODE_ROWS.bit_length()
        full, path = store(counts.filter((F.col("n") > least) & still_open).select("mask", "value"))
        paths.append(path)
        out.append(store(_indexed(work.join(F.broadcast(full), ["mask", "value"], "left_anti")))[0])
        masks = [r["mask"] % (1 << BITS) for r in full.select("mask").distinct().collect()]  # at most 4^level
        if not masks:
            break
        work, path = store(under(work.join(F.broadcast(full), ["mask", "value"]).select("mask", "fp"), masks))
        paths.append(path)
    for path in paths:
        delete_folder(spark, path)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits),
    component_id (the smallest doc_id that links lead to, its own included).

    A null text is empty; texts without words have fingerprint zero and link like
    any other. Rows may repeat. A null id has a component like any row's; a
    component of null ids has none. An empty table gives no row; other columns
    take no part, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows, _ = store(fingerprints(docs))
    per_code, _ = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = per_code.join(components(links(per_code.select("fp"))).withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted, _ = store(rooted)
    per_root, _ = store(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named, _ = store(join_unique(rooted.select("fp", "root"), per_root, "root").select("fp", "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_unique(rows, named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")

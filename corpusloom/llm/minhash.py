"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Every whole text becomes its set of five-word shingles with counts, stored.
2. Document frequencies of all shingles are added up in a hashed table that has
   twice as many cells as the corpus has shingles, from ``BUCKETS`` up to
   2**MOST_BITS (one byte a cell goes to the driver and on to the workers). The
   weight of a shingle is its count times its inverse document frequency, a whole
   number of bits between 1 and log2(cells). Of n shingles a cell holds n / cells
   others on average, so a shingle of d documents weighs about
   log2(1 + n / cells / d) bits too little: at most 0.6 up to 8 million shingles,
   and at 5 billion (30 GB) 8.2 for d = 1, but 0.04 for d = 10,000.
3. Consistent weighted samples of these weights are banded, and as many samples
   under equal weights: texts that agree in all samples of a band are candidates.
   A pair is a link by either similarity (step 5), so each has its own bands and
   is a candidate with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
4. A band bucket is dealt out in blocks of bounded size, and all members of a
   block, and ``PIVOTS`` pivots of the bucket, are compared with each other. What a
   bucket then still holds of other components than its largest one is compared,
   block by block, with the whole bucket: every pair of a bucket is compared or
   stands in one component.
5. A candidate pair is a link if its weighted Jaccard similarity, computed on the
   stored shingles, reaches the threshold (or the one with equal weights does).
   Classes are connected components.

Copies of a text share one node throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.graph import components, join_unique
from corpusloom.llm.memory import release, released
from corpusloom.session import delete_folder, ship_package, store

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS  # at least
MOST_BITS = 24          # of the cells of document frequencies
COUNT_AT_ONCE = 1 << 20  # shingles that are counted together in a worker
RANGE_BITS = 14         # of the cells whose counts travel as one block
POOL_BITS = 15
SEED = 23
TEXT_AT_ONCE = 1 << 19  # characters of text that are cut into shingles together
PIVOTS = 16             # of a bucket of several blocks, in each block
PIVOT_ROUNDS = 4        # before what is left is compared exhaustively, at least 2
ROWS_AT_ONCE = 256      # rows of packed shingles that are unpacked together
REMAINDER = 1           # rows dealt out for the exhaustive comparison allowed earlier, per bucket member
EARLY_BANDS = 5         # of each kind, compared first
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 22  # of a bucket's blocks: members, bytes of shingles
LARGE = 256             # members of a block after which freed memory is handed back
FEW = 6                 # members that are compared pair by pair
RARE = 32               # a shingle of so few members is counted by pairs, not in a matrix product

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_STEP = [pow(0xC2B2AE3D27D4EB4F, j + 1, 2**64) for j in range(WORDS)]
_ORDERS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- shingles ---------------------------------------------------------------------

@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))]) if n > 1 else np.ones(n, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct 32-bit shingle hashes (sorted) and their counts, per text.

    Words are runs of letters and digits, in lower case. A text of one to four
    words is one shingle; one without words has none.
    """
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, stop = edge[::2], edge[1::2]  # the closing line break ends the last word
    size = 1 << max(int(len(data)).bit_length(), 12)
    run = np.cumsum(_BYTE[data] * _powers(_P, size)[: len(data)])
    before = np.where(start > 0, run[start - 1], np.uint64(0))
    word = _mix((run[stop - 1] - before) * _powers(_P_INVERSE, size)[start])
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    n_words = np.diff([*first, len(start)])
    doc = np.repeat(np.arange(len(raw)), n_words)
    left = np.repeat(first + n_words, n_words) - np.arange(len(start))  # words up to the text's end
    total = np.zeros(len(start), np.uint64)
    for j in range(WORDS):
        ahead = np.minimum(np.arange(len(start)) + j, max(len(start) - 1, 0))
        total += np.where(left > j, word[ahead] * np.uint64(_STEP[j]), np.uint64(0))
    whole = (left >= WORDS) | (np.repeat(first, n_words) == np.arange(len(start)))
    key = (doc[whole].astype(np.uint64) << np.uint64(32)) | (_mix(total[whole]) >> np.uint64(32))
    key, count = np.unique(key, return_counts=True)
    cut = np.searchsorted(key, np.arange(1, len(raw)).astype(np.uint64) << np.uint64(32))
    hashes = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return list(zip(np.split(hashes, cut), np.split(count.astype(np.uint32), cut), strict=True))


def _in_portions(batch: pa.RecordBatch):
    """Slices of a batch that hold about ``TEXT_AT_ONCE`` characters of text."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
        size += n or 0
        if size >= TEXT_AT_ONCE:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _slices(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b (two hashes that name the text), hashes, counts
    (packed; empty if all are 1), row. A null text is named by its row."""

    def cut(batches):
        for batch in (portion for whole in batches for portion in _in_portions(whole)):
            sets = shingles([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([
                *(batch[c] for c in ("doc_id", "text_a", "text_b")),
                pa.array([h.tobytes() for h, _ in sets], pa.binary()),
                pa.array([b"" if (c == 1).all() else c.tobytes() for _, c in sets], pa.binary()),
            ], ["doc_id", "text_a", "text_b", "hashes", "counts"])

    text = F.col("text").cast("string")
    named = F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit(SEED), text))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                         named[0].alias("text_a"), named[1].alias("text_b"))
    out = narrow.mapInArrow(released(cut), "doc_id long, text_a long, text_b long, hashes binary, counts binary")
    row = F.monotonically_increasing_id()
    return out.withColumn("row", row).withColumn("text_b", F.coalesce("text_b", "row"))


# --- weights ----------------------------------------------------------------------

def bits_of_buckets(sets: DataFrame) -> np.ndarray:
    """Inverse document frequency per cell of the hashed table, in bits. The
    table's size follows the corpus.

    Workers count cells in large portions and hand over packed blocks, one per
    range of cells: places of cells met once, and places and counts of the others.
    Blocks of a range are added up as they stream by, and the driver receives the
    finished table, one byte a cell.
    """
    total = (sets.agg(F.sum(F.length("hashes"))).first()[0] or 0) // 4
    bits = min(max((2 * total - 1).bit_length(), BUCKET_BITS), MOST_BITS)

    def count(batches):
        def counted(raw: list[bytes]) -> pa.RecordBatch:
            cells, n = np.unique(np.frombuffer(b"".join(raw), np.uint32) >> np.uint32(32 - bits), return_counts=True)
            cut = np.flatnonzero(np.diff(cells >> np.uint32(RANGE_BITS))) + 1
            rows: list[list] = [[], [], [], []]
            for some, m in zip(np.split(cells, cut), np.split(n, cut), strict=True):
                if len(some):
                    place, once = (some & np.uint32((1 << RANGE_BITS) - 1)).astype(np.uint16), m == 1
                    for column, value in zip(rows, (
                        int(some[0]) >> RANGE_BITS, place[once].tobytes(), place[~once].tobytes(), m[~once].astype(np.uint32).tobytes(),
                    ), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["cells", "once", "places", "counts"])

        raw, size = [], 0
        for batch in _slices(batches):
            for hashes in batch["hashes"].to_pylist():
                raw.append(hashes)
                size += len(hashes) // 4
                if size >= COUNT_AT_ONCE:
                    yield counted(raw)
                    raw, size = [], 0
        yield counted(raw)

    def add(batches):
        def finished() -> pa.RecordBatch:
            share = total / np.maximum(n, 1)
            weight = np.where(n > 0, np.clip(np.rint(np.log2(1 + share)), 1, bits), bits).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([weight.tobytes()], pa.binary())], ["cells", "bits"])

        now, n = None, np.zeros(1 << RANGE_BITS, np.int64)
        for batch in batches:
            for cells, once, places, counts in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if cells != now:
                    if now is not None:
                        yield finished()
                    now, n = cells, np.zeros(1 << RANGE_BITS, np.int64)
                n[np.frombuffer(once, np.uint16)] += 1
                n[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        if now is not None:
            yield finished()

    packed = sets.select("hashes").mapInArrow(released(count), "cells int, once binary, places binary, counts binary")
    added = packed.repartition("cells").sortWithinPartitions("cells").mapInArrow(released(add), "cells int, bits binary")
    out = np.full(1 << bits, bits, np.uint8)
    table = added.toArrow()
    for cells, weight in zip(*(table[c].to_pylist() for c in ("cells", "bits")), strict=True):
        out[cells << RANGE_BITS:(cells + 1) << RANGE_BITS] = np.frombuffer(weight, np.uint8)
    return out


def weights(hashes: np.ndarray, counts: np.ndarray | None, bits: np.ndarray) -> np.ndarray:
    w = bits[hashes >> np.uint32(33 - len(bits).bit_length())].astype(np.float64)
    return w if counts is None else w * counts


def similarity(a: tuple[bytes, bytes], b: tuple[bytes, bytes], bits: np.ndarray) -> float:
    """Weighted Jaccard similarity: sum of smaller weights over sum of larger ones.

    In a large group of copies the shared shingles are frequent and weigh less
    than each copy's own edits, so the similarity under equal weights counts if
    it is larger: weights may add links, not lose them. Texts without shingles: 0.
    """
    sides = []
    for hashes, counts in (a, b):
        h = np.frombuffer(hashes, np.uint32)
        sides.append((h, weights(h, np.frombuffer(counts, np.uint32) if counts else None, bits)))
    (x, v), (y, w) = sides
    total = v.sum() + w.sum()
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    common = np.minimum(v[both], w[at[both]]).sum()
    shared = both.sum()
    return float(max(common / (total - common), shared / (len(x) + len(y) - shared)))


# --- consistent weighted samples --------------------------------------------------

class Sampler:
    """Samples of weighted sets. The random numbers of a shingle and sample come
    from a pool; ties within the pool go to the smaller hash, and a sample is
    named by its value and its shingle."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        size = (n, 1 << POOL_BITS)
        self.r = rng.standard_gamma(2.0, size, np.float32)
        self.log_c = np.log(rng.standard_gamma(2.0, size, np.float32))
        self.beta = rng.random(size, np.float32)
        self.spread = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._tables: dict[float, np.ndarray] = {}

    def _values(self, k: int, at, log_w) -> np.ndarray:
        """Logarithms of the samples' arrival values as ordered 32-bit integers
        in the upper half of a word."""
        r, beta = self.r[k, at].astype(np.float64), self.beta[k, at]
        t = np.floor(log_w / r + beta)
        bits = (self.log_c[k, at] - r * (t - beta + 1)).astype(np.float32).view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return ordered.astype(np.uint64) << np.uint64(32)

    def table(self, w: float) -> np.ndarray:
        """Values of the whole pool for one weight; the last weight is remembered."""
        if w not in self._tables:
            self._tables.clear()
            self._tables[w] = np.stack([self._values(k, slice(None), np.log(w)) for k in range(len(self.r))])
        return self._tables[w]

    def samples(self, hashes: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row per set (none may be empty), one column per sample."""
        kinds, n = np.unique(w, return_counts=True)
        usual = float(kinds[n.argmax()])
        table, odd = self.table(usual), np.flatnonzero(w != usual)
        log_w = np.log(w[odd])
        wide = hashes.astype(np.uint64)
        out = np.empty((len(starts), len(self.r)), np.uint64)
        for k, spread in enumerate(self.spread):
            at = (wide * spread) >> np.uint64(64 - POOL_BITS)
            value = table[k][at]
            if len(odd):
                value[odd] = self._values(k, at[odd], log_w)
            value |= wide
            out[:, k] = np.minimum.reduceat(value, starts)
        return out


@lru_cache(1)
def sampler() -> Sampler:
    return Sampler()


def set_samples(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples under equal weights: what comes first in each of as many orders of
    the shingles. One row per set, one column per sample, as ``Sampler.samples``."""
    mixed = _mix(_mix(hashes.astype(np.uint64) * np.uint64(_P)) * np.uint64(_P))
    return np.stack([np.minimum.reduceat(mixed * order, starts) for order in _ORDERS], 1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for j in range(ROWS):
        keys = _mix(keys + samples[:, j::ROWS] * np.uint64(_STEP[j]))
    return keys.view(np.int64)


def banded(sets: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, text_a, text_b, row, bands (null for texts without words), size (bytes of shingles)."""

    def sample(batches):
        for part in _slices(batches):
            hashes, counts = part["hashes"].to_pylist(), part["counts"].to_pylist()
            full = [i for i, h in enumerate(hashes) if h]
            keys: list = [None] * part.num_rows
            if full:
                sizes = [len(hashes[i]) // 4 for i in full]
                h = np.frombuffer(b"".join(hashes[i] for i in full), np.uint32)
                c = np.concatenate([
                    np.frombuffer(counts[i], np.uint32) if counts[i] else np.ones(n, np.uint32)
                    for i, n in zip(full, sizes, strict=True)
                ])
                starts = np.cumsum([0, *sizes[:-1]])
                found = np.hstack([band_keys(sampler().samples(h, weights(h, c, bits), starts)),
                                   band_keys(set_samples(h, starts))])
                for i, row in zip(full, found, strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in ("doc_id", "text_a", "text_b", "row")), pa.array(keys, pa.list_(pa.int64())),
                 pa.array([len(h) + len(c) for h, c in zip(hashes, counts, strict=True)], pa.int64())],
                ["doc_id", "text_a", "text_b", "row", "bands", "size"],
            )

    return sets.select("doc_id", "text_a", "text_b", "row", "hashes", "counts").mapInArrow(
        released(sample), "doc_id long, text_a long, text_b long, row long, bands array<long>, size long"
    )


# --- links and classes ------------------------------------------------------------

def links_among(sides: list[tuple[bytes, bytes]], bits: np.ndarray, least: float) -> np.ndarray:
    """Which of these texts (packed shingles and counts) are linked: ``similarity``
    of all pairs at once, in a symmetrical matrix."""
    n = len(sides)
    linked = np.zeros((n, n), bool)
    if n <= FEW:
        for i in range(n):
            for j in range(i):
                linked[i, j] = linked[j, i] = similarity(sides[i], sides[j], bits) >= least
        return linked
    hashes = [np.frombuffer(h, np.uint32) for h, _ in sides]
    sizes = np.array([len(h) for h in hashes])
    counts = np.concatenate([np.frombuffer(c, np.uint32) if c else np.ones(k, np.uint32)
                             for (_, c), k in zip(sides, sizes, strict=True)]).astype(np.int64)
    flat = np.concatenate(hashes)
    member = np.repeat(np.repeat(np.arange(n), sizes), counts)
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.repeat(flat, counts)
    # a shingle that stands c times is c items: two texts share as many as the smaller count
    weight = weights(flat, None, bits)
    total = np.bincount(member, weight, n)
    key = (flat.astype(np.uint64) << np.uint64(32)) | level.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, member, weight, first = key[order], member[order], weight[order], (level == 0)[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    width = np.diff([*starts, len(key)])
    common, shared = np.zeros(n * n), np.zeros(n * n)
    low = np.repeat(width <= RARE, width)
    k_low, m_low, w_low, f_low = key[low], member[low], weight[low], first[low]
    for step in range(1, min(RARE, n)):
        at = np.flatnonzero(k_low[step:] == k_low[:-step])
        if not len(at):
            break
        place = m_low[at] * n + m_low[at + step]
        common += np.bincount(place, w_low[at], n * n)
        shared += np.bincount(place, f_low[at].astype(np.float64), n * n)
    common, shared = (x.reshape(n, n) + x.reshape(n, n).T for x in (common, shared))
    dense = np.flatnonzero(width > RARE)
    for some in np.array_split(dense, -(-len(dense) // 1024)) if len(dense) else ():
        column = np.repeat(np.arange(len(some)), width[some])
        items = np.repeat(starts[some] - np.cumsum(width[some]) + width[some], width[some]) + np.arange(len(column))
        held = np.zeros((n, len(some)))
        held[member[items], column] = 1
        common += (held * weight[starts[some]]) @ held.T
        shared += (held * first[starts[some]]) @ held.T
    union_w, union = total[:, None] + total - common, sizes[:, None] + sizes - shared
    with np.errstate(invalid="ignore", divide="ignore"):
        linked = np.maximum(common / union_w, shared / union) >= least
    np.fill_diagonal(linked, False)
    return linked


def stars(linked: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component."""
    n = len(linked)
    label = np.arange(n)
    a, b = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def linked_in_blocks(dealt: DataFrame, block: list[str], sets: DataFrame, bits: np.ndarray, least: float) -> DataFrame:
    """a, b: stars that connect what is linked within each block of rows. A row
    may come twice. With ``root``, rows of one root are taken as linked and a
    block of a single root gives nothing."""
    rooted = "root" in dealt.columns

    def compare(table: pa.Table) -> pa.Table:
        row, at = np.unique(table["row"].to_numpy(), return_index=True)
        roots = table["root"].to_numpy()[at] if rooted else row
        out = np.arange(len(row))
        if len(np.unique(roots)) > 1:
            hashes, counts = table["hashes"].take(pa.array(at)).to_pylist(), table["counts"].take(pa.array(at)).to_pylist()
            out = stars(links_among(list(zip(hashes, counts, strict=True)), bits, least))
            if len(row) >= LARGE:
                release()
        moved = out != np.arange(len(row))
        return pa.table({"a": pa.array(row[moved], pa.int64()), "b": pa.array(row[out[moved]], pa.int64())})

    return dealt.join(sets, "row").groupBy(*block).applyInArrow(compare, "a long, b long")


def linked_texts(nodes: DataFrame, sets: DataFrame, bits: np.ndarray, least: float) -> DataFrame:
    """node, root for every text that is linked to another one; ``nodes`` has
    one row per text: row, bands, size (bytes of shingles)."""
    exploded = nodes.filter("bands is not null").select("row", "size", F.posexplode("bands").alias("band", "key"))
    early = F.col("band") % BANDS < EARLY_BANDS
    buckets = exploded.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"),
        F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "row")).alias("y"),
    ).filter("n > 1")
    # of buckets of the same members one is enough
    buckets = buckets.groupBy("n", "bytes", "x", "y").agg(
        F.min(F.struct((~early).alias("late"), "band", "key")).alias("b")
    ).select("b.band", "b.key", _parts("n", "bytes").alias("parts"))
    spark = nodes.sparkSession
    members, members_path = store(exploded.join(buckets, ["band", "key"]).select(
        "band", "key", "row", "size", "parts", F.col("row").alias("root")
    ))
    # the members' rows grow with the corpus: a plan that broadcasts them would not hold
    sets, sets_path = store(sets.hint("merge").join(members.select("row").distinct(), "row", "left_semi").select(
        "row", "hashes", "counts"
    ))
    n_members = members.count()
    found: list[DataFrame] = []
    paths = [sets_path]

    def test(dealt: DataFrame, block: list[str]) -> DataFrame:
        links, path = store(linked_in_blocks(dealt, ["band", "key", *block], sets, bits, least))
        found.append(links)
        paths.append(path)
        return components(_union(found))

    def done(linked: DataFrame) -> DataFrame:
        for path in (*paths, members_path):
            delete_folder(spark, path)
        return linked

    turn = 0
    while True:
        now = members.filter(early) if turn == 0 else members
        part = F.pmod(F.xxhash64("row", "band", F.lit(turn)), "parts")
        nth = F.row_number().over(Window.partitionBy("band", "key").orderBy(F.xxhash64("row", F.lit(turn)), "row"))
        pivots = now.filter("parts > 1").select("band", "key", "row", "parts", nth.alias("nth")).filter(
            F.col("nth") <= PIVOTS
        ).select("band", "key", "row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        linked = test(now.select("band", "key", "row", part.alias("part")).unionByName(pivots), ["part"])
        # a bucket of one component is done, and so is one whose members were all in one block
        rooted = members.drop("root").join(linked.withColumnRenamed("node", "row"), "row", "left").withColumn(
            "root", F.coalesce("root", "row")
        )
        several = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(
            "low <> high").select("band", "key")
        compared = (F.col("parts") == 1) & (early if turn == 0 else F.lit(True))
        old = members_path
        members, members_path = store(rooted.filter(~compared).join(several, ["band", "key"]).select(members.columns))
        delete_folder(spark, old)
        turn += 1
        if turn == 1:
            continue
        if members.isEmpty():
            return done(linked)
        rest = _rest(members)
        rows = rest.agg(F.sum(F.when(F.col("other"), F.col("mains") + F.col("others")).otherwise(F.col("others")))).first()[0]
        if turn >= PIVOT_ROUNDS or rows <= REMAINDER * n_members:
            break
    # other components than the bucket's largest: each block of them with each block of the bucket
    own = F.when(F.col("other"), F.pmod(F.xxhash64("row", "band"), "others")).otherwise(F.pmod(F.xxhash64("row", "band"), "mains"))

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    with_main = F.transform(upto("mains"), lambda j: F.struct(F.lit(True).alias("main"), F.col("own").alias("i"), j.alias("j")))
    with_other = F.transform(upto("others"), lambda j: F.struct(
        F.lit(False).alias("main"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    of_main = F.transform(upto("others"), lambda i: F.struct(F.lit(True).alias("main"), i.alias("i"), F.col("own").alias("j")))
    cells = rest.withColumn("own", own).select("band", "key", "row", "root", F.explode(
        F.when(F.col("other"), F.concat(with_main, with_other)).otherwise(of_main)).alias("cell")
    ).select("band", "key", "row", "root", "cell.*")
    return done(test(cells, ["main", "i", "j"]))


def _parts(n: str, size: str):
    """How many blocks so many members and bytes take."""
    return F.ceil(F.greatest(F.col(n) / BLOCK_ROWS, F.col(size) / BLOCK_BYTES)).cast("long")


def _rest(members: DataFrame) -> DataFrame:
    """The members with ``other`` (not of the bucket's largest component) and the
    blocks that its largest (``mains``) and other components (``others``) take."""
    per_root = members.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max(F.struct("n", "root", "size"))
    per_bucket = per_root.groupBy("band", "key").agg(
        largest.alias("main"), F.sum("n").alias("all_n"), F.sum("size").alias("all_size")
    ).select("band", "key", F.col("main.root").alias("main_root"), F.col("main.n").alias("n"), F.col("main.size").alias("s"),
             (F.col("all_n") - F.col("main.n")).alias("on"), (F.col("all_size") - F.col("main.size")).alias("os"))
    return members.join(per_bucket, ["band", "key"]).select(
        "band", "key", "row", "root", (F.col("root") != F.col("main_root")).alias("other"),
        _parts("n", "s").alias("mains"), _parts("on", "os").alias("others"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, kept, class_size, text_a, text_b.

    ``class_id`` is the smallest id of the document's class and ``kept`` marks
    one row of the class that has it (a null id comes last; a class of null ids
    has a null class_id). Equal texts are one class, empty ones too; a null text
    is a class of its own. Texts without words are linked to equal texts only.
    Rows may repeat: copies. An empty table gives no row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sets, sets_path = store(shingle_sets(docs))
    bits = bits_of_buckets(sets)
    rows, _ = store(banded(sets, bits))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    texts, texts_path = store(rows.groupBy("text_a", "text_b").agg(
        F.min(first).alias("first"), F.count("*").alias("n"), F.min(F.struct("row", "bands", "size")).alias("node"),
    ).select("text_a", "text_b", "first", "n", "node.row", "node.bands", "node.size"))
    linked = linked_texts(texts, sets, bits, least).withColumnRenamed("node", "row")
    delete_folder(spark, sets_path)
    rooted, rooted_path = store(texts.select("text_a", "text_b", "row", "first", "n").join(linked, "row", "left").withColumn(
        "root", F.coalesce("root", "row")
    ))
    classes, classes_path = store(rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("class_size")))
    name = F.struct("text_a", "text_b").alias("name")
    named, _ = store(join_unique(rooted.select(name, "root"), classes, "root").drop("root"))
    for path in (rooted_path, classes_path, texts_path):
        delete_folder(spark, path)
    return join_unique(rows.select("doc_id", "row", name), named, "name").select(
        "doc_id", F.col("best.doc_id").alias("class_id"), (F.col("row") == F.col("best.row")).alias("kept"),
        "class_size", "name.*",
    )


def one_per_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, all columns unchanged;
    documents with a null text stay. Rows equal in id and text keep one."""
    kept = near_duplicates(docs.filter(F.col("text").isNotNull()), least).filter("kept").select(
        F.col("doc_id").alias("k_id"), F.col("text_a").alias("k_a"), F.col("text_b").alias("k_b")
    )
    text = F.col("text").cast("string")
    wide = docs.filter(F.col("text").isNotNull()).select(  # given columns may have any names
        F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(SEED), text).alias("b"),
    )
    on = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("a") == F.col("k_a")) & (F.col("b") == F.col("k_b"))
    nth = F.row_number().over(Window.partitionBy("id", "a", "b").orderBy(F.lit(0)))
    chosen = wide.join(kept, on).withColumn("nth", nth).filter("nth = 1").select("given.*")
    return chosen.unionByName(docs.filter(F.col("text").isNull()))

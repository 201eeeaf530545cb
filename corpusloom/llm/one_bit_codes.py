"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector is coded relative to its nearest centre: the residual is rotated
by one random orthogonal matrix and only the signs are kept, packed in bits,
with three correction scalars. The inner product with a query follows from
popcounts of the code against the bit planes of the quantised rotated query; it
comes with an error bound, a multiple of its standard deviation. In a block, the
vectors of the best estimates are compared exactly first; every vector whose
estimate plus error bound reaches the k-th of these scores is then compared
exactly too, in double precision, on the original vectors.

Centres are fitted on a bounded sample (``SAMPLE`` rows, chosen by hash of the
id); all vectors are coded and searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import vectors
from corpusloom.session import ship_package

SAMPLE = 4096          # rows that centres are fitted on, per dimension
CENTRES = 16
CODE_BITS = 256        # shorter vectors are padded: longer codes estimate better
PLANES = 4             # bits of a quantised query component
BOUND = 3.0            # standard deviations of the estimate in the error bound
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Rows of a random orthogonal matrix, of the code's length, for ``dim``."""
    wide = max(CODE_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, wide]).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def fit_centres(unit: np.ndarray, n: int = CENTRES, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Lloyd's rounds on unit vectors."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.permutation(len(unit))[:n]]
    for _ in range(rounds):
        near = np.argmin(((centres**2).sum(1) - 2 * unit @ centres.T), 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def encode(unit: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """centre, packed signs, residual norm, <residual, centre>, <code, unit residual>."""
    near = np.argmin(((centres**2).sum(1) - 2 * unit @ centres.T), 1)
    residual = unit - centres[near]
    norm = np.sqrt((residual**2).sum(1))
    turned = residual @ turn
    bits = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    wide = turned.shape[1]
    aligned = np.abs(turned).sum(1) / np.sqrt(wide) / np.maximum(norm, 1e-300)
    return near, bits, norm, (residual * centres[near]).sum(1), np.where(norm > 0, aligned, 1.0)


def planes_of(turned: np.ndarray, n: int = PLANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (query, plane, word), offset and step of each quantised row."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**n - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint32)
    planes = [np.packbits((level >> j) & 1 == 1, axis=1, bitorder="little").view(np.uint64) for j in range(n)]
    return np.stack(planes, 1), low, step


def bounds(query: np.ndarray, code: tuple[np.ndarray, ...], centre: np.ndarray, turn: np.ndarray,
           bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit queries with coded vectors of one
    centre, and how far they may be off: two (query, vector) matrices."""
    bits, norm, along, aligned = code
    apart = query - centre
    turned = apart @ turn
    wide = turned.shape[1]
    planes, low, step = planes_of(turned)
    words = np.ascontiguousarray(bits.T)
    ones = np.bitwise_count(bits).sum(1, dtype=np.float64)
    hits = np.zeros((len(query), len(bits)), np.uint32)
    both, ones_of_both = np.empty(hits.shape, np.uint64), np.empty(hits.shape, np.uint8)
    for j in reversed(range(planes.shape[1])):
        hits *= 2
        for word in range(bits.shape[1]):
            np.bitwise_and(planes[:, j, word, None], words[word], out=both)
            hits += np.bitwise_count(both, out=ones_of_both)
    positive = low[:, None] * ones + step[:, None] * hits
    signed = (2 * positive - turned.sum(1)[:, None]) / np.sqrt(wide)
    estimate = (query @ centre)[:, None] + along + signed * (norm / aligned)
    spread = norm * np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned / np.sqrt(wide - 1)
    rounding = step[:, None] / np.sqrt(12) * (norm / aligned)
    return estimate, bound * (np.sqrt((apart**2).sum(1))[:, None] * spread + rounding) + 1e-9


def cell_search(k: int, centres: dict[int, np.ndarray], batch: int = 128, pairs: int = 1 << 16):
    """Search of one cell: estimates and bounds choose what is compared exactly."""

    def cell(left: pa.Table, right: pa.Table):
        dim = left["dim"][0].as_py()
        turn, middle = rotation(dim), centres[dim]
        right, ids = vectors.without_copies(right, dim)
        q_id, v_id = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, v = vectors.matrix(left["v"], dim), vectors.matrix(right["v"], dim)
        q_norm, v_norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        unit = q / q_norm[:, None]
        near = right["centre"].to_numpy()
        bits = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint64).reshape(len(v), -1)
        scalars = [right[c].to_numpy() for c in ("norm", "along", "aligned")]

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            score = np.empty(len(i))
            for a in range(0, len(i), pairs):
                x, y = i[a:a + pairs], j[a:a + pairs]
                score[a:a + pairs] = (q[x] * v[y]).sum(1) / (q_norm[x] * v_norm[y])
            return score

        members = [np.flatnonzero(near == c) for c in range(len(middle))]
        out = []
        for start in range(0, len(q), batch):
            rows = slice(start, start + batch)
            estimate = np.empty((len(q_id[rows]), len(v)))
            off = np.empty_like(estimate)
            for c, own in enumerate(members):
                if len(own):
                    code = (bits[own], *(s[own] for s in scalars))
                    estimate[:, own], off[:, own] = bounds(unit[rows], code, middle[c], turn)
            same = q_id[rows, None] == v_id
            estimate[same] = -np.inf
            first = min(max(32, 4 * k), len(v))
            likely = np.argpartition(-estimate, first - 1, 1)[:, :first]
            sure = exact(np.repeat(np.arange(len(likely)) + start, first), likely.ravel()).reshape(-1, first)
            sure[np.take_along_axis(same, likely, 1)] = -np.inf
            if ids is not None:  # an id that comes twice counts once, with its best score
                order = np.argsort(-sure, 1, kind="stable")
                sure, of = np.take_along_axis(sure, order, 1), np.take_along_axis(ids[likely], order, 1)
                again = np.tril(of[:, :, None] == of[:, None, :], -1).any(2)
                sure[again] = -np.inf
            least = np.partition(sure, -k, 1)[:, -k] if first >= k else np.full(len(sure), -np.inf)
            qi, vi = np.nonzero((estimate + off >= least[:, None] - 1e-9) & ~same)
            qi += start
            score = exact(qi, vi)
            best = vectors.top_k(qi, v_id[vi], score, k)
            out.append((q_id[qi[best]], v_id[vi[best]], score[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return cell


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, centres: int = CENTRES,
            sample: int = SAMPLE, **blocks: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of ``base`` by
    cosine, ties to the smaller id.

    Takes tables with ``vec_id`` and ``embedding``; see ``vectors`` for which
    rows take part. Zero vectors have no direction and take no part either. A
    vector whose squares overflow a double counts as not finite. No query or
    no vector: no row. Fewer than k candidates: all of them.
    """
    spark = base.sparkSession
    ship_package(spark)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    directed = (squares > 0) & (squares < F.lit(float("inf")))
    base, queries = vectors.usable(base).filter(directed), vectors.usable(queries).filter(directed)
    picked = base.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("dim", "v").collect()
    fitted: dict[int, np.ndarray] = {}
    for dim in sorted({r.dim for r in picked}):
        rows = np.array([r.v for r in picked if r.dim == dim], np.float64)
        fitted[dim] = fit_centres(rows / np.sqrt((rows**2).sum(1))[:, None], centres)
    dims = base.select("dim").union(queries.select("dim")).distinct()
    # a dimension that the sample misses is coded around the origin
    fitted |= {d: np.zeros((1, d)) for d in (r.dim for r in dims.collect()) if d not in fitted}

    def code(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in np.unique(table["dim"].to_numpy()):
                part = table.filter(pc.equal(table["dim"], int(dim)))
                rows = vectors.matrix(part["v"], dim)
                unit = rows / np.sqrt((rows * rows).sum(1))[:, None]
                near, bits, norm, along, aligned = encode(unit, fitted[dim], rotation(dim))
                part = part.append_column("centre", pa.array(near, pa.int32()))
                part = part.append_column("code", pa.array([b.tobytes() for b in bits], pa.binary()))
                for name, column in (("norm", norm), ("along", along), ("aligned", aligned)):
                    part = part.append_column(name, pa.array(column))
                yield from part.to_batches()

    kind = dict(base.dtypes)["v"]
    coded = base.mapInArrow(
        code, f"vec_id long, v {kind}, dim int, centre int, code binary, norm double, along double, aligned double"
    )
    return vectors.search(coded, queries, k, cell_search(k, fitted), "double", **blocks)

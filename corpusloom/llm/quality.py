"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each, the whole text). Every
passage is encoded by a small network from its content and its shape: hashed
words, word pairs and byte trigrams, each with a learnt embedding and averaged
over the passage, beside shares of character kinds and word shapes. Gated
attention weighs the encodings, and the weighted sum is scored. Only documents
have labels: embeddings, encoder, attention and scorer are learnt together from
them, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.memory import released, sliced
from corpusloom.session import ship_package

PASSAGE = 100            # words
MAX_TRAINING_DOCS = 4000  # labelled documents that the network is fitted on
MAX_TRAINING_ROWS = 32    # rows of one of them; a longer one's passages are averaged in runs
HIDDEN, GATE = 16, 8
ROUNDS, BATCH, RATE, DECAY, SEED = 600, 256, 0.01, 1e-3, 5
DOCS_AT_ONCE = 256
PASSAGES_AT_ONCE = 256
WORD_BUCKETS, TRIGRAM_BUCKETS = 512, 256
WORDS_KEPT = 1 << 16      # hashes a worker remembers before it starts anew

_CLASSES = (
    (b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\n\x0b\x0c", 3),
    (b"!?", 4), (b",", 5), (b".", 6), (b"\"'()-:;`", 7), (bytes(range(128, 256)), 8),
)
_KINDS = 10
_KIND = np.full(256, _KINDS - 1, np.uint8)  # all other symbols
for _bytes, _class in _CLASSES:
    _KIND[list(_bytes)] = _class
SHAPE_FEATURES = _KINDS + 9
FEATURES = SHAPE_FEATURES + WORD_BUCKETS + TRIGRAM_BUCKETS
_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    known = _HASHES.get(word)
    if known is None:
        if len(_HASHES) >= WORDS_KEPT:
            _HASHES.clear()
        known = _HASHES[word] = zlib.crc32(word.lower().encode("utf-8", "replace"))
    return known


def _shares(row: np.ndarray, bucket: np.ndarray, rows: int, buckets: int) -> np.ndarray:
    """Share of each bucket among the items of each row."""
    counts = np.bincount(row * buckets + bucket, minlength=rows * buckets).reshape(rows, buckets)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def _content(passages: list[list[str]], raw: list[np.ndarray]) -> np.ndarray:
    """Hashed words, word pairs and byte trigrams of each passage."""
    n = len(passages)
    words = np.array([_word_hash(w) for own in passages for w in own], np.uint64)
    of = np.repeat(np.arange(n), [len(own) for own in passages])
    pairs = ((words[:-1] * np.uint64(0x9E3779B1) + words[1:]) >> np.uint64(7)) % np.uint64(WORD_BUCKETS)
    same = of[1:] == of[:-1]
    buckets = np.concatenate([words % np.uint64(WORD_BUCKETS), pairs[same]]).astype(np.int64)
    content = _shares(np.concatenate([of, of[1:][same]]), buckets, n, WORD_BUCKETS)
    text, of = np.concatenate(raw).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in raw])
    triple = ((text[:-2] * 65536 + text[1:-1] * 256 + text[2:]) * 0x9E3779B1 >> 16) % TRIGRAM_BUCKETS
    same = of[2:] == of[:-2]
    return np.hstack([content, _shares(of[2:][same], triple[same], n, TRIGRAM_BUCKETS)])


def passage_blocks(text: str | None) -> Iterator[np.ndarray]:
    """Features of a text's passages in order, a bounded number of rows at a
    time; a text without words is one empty passage."""
    text = text or ""
    words = text.split()
    if not words:
        yield np.zeros((1, FEATURES), np.float32)
        return
    breaks, total = text.count("\n") / len(words), np.log1p(len(words))
    step = PASSAGE * PASSAGES_AT_ONCE
    for start in range(0, len(words), step):
        end = min(start + step, len(words))
        passages = [words[i:min(i + PASSAGE, end)] for i in range(start, end, PASSAGE)]
        raw = [np.frombuffer(" ".join(own).encode("utf-8", "replace"), np.uint8) for own in passages]
        shapes = []
        for own, letters in zip(passages, raw, strict=True):
            n, kinds = len(own), len(set(own))
            short = sum(len(w) <= 3 for w in own)
            again = sum(a == b for a, b in zip(own, own[1:], strict=False))
            shapes.append([
                *(np.bincount(_KIND[letters], minlength=_KINDS) / len(letters)).tolist(), np.log1p(n), len(letters) / n / 10,
                kinds / n, short / n, again / n, np.log1p(max(map(len, own))), breaks, total / 5, kinds / np.sqrt(n) / 5,
            ])
        yield np.hstack([np.array(shapes), _content(passages, raw)]).astype(np.float32)


def training_rows(text: str | None) -> np.ndarray:
    """All passages of a text as at most MAX_TRAINING_ROWS rows: those of longer
    texts are means over equal runs of passages, so no part is left out."""
    x = np.concatenate(list(passage_blocks(text)))
    if len(x) <= MAX_TRAINING_ROWS:
        return x
    run = np.arange(MAX_TRAINING_ROWS + 1) * len(x) // MAX_TRAINING_ROWS
    return (np.add.reduceat(x, run[:-1]) / np.diff(run)[:, None]).astype(np.float32)


class Network:
    """Passage encoder, gated attention and scorer with their gradients."""

    SHAPES = (("W", (FEATURES, HIDDEN)), ("b", (HIDDEN,)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)),
              ("a", (GATE,)), ("o", (HIDDEN,)), ("c", ()))

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {k: rng.standard_normal(s) / np.sqrt(s[0] if s else 1) if len(s) == 2 or k in "ao"
                  else np.zeros(s) for k, s in self.SHAPES}

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        x /= self.scale
        return np.clip(x, -6, 6, out=x)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["b"])

    def attend(self, h: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(h)]))
        w = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        w /= np.add.reduceat(w, starts)[bag]
        z = np.add.reduceat(w[:, None] * h, starts)
        return 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30))), (t, g, w, z, bag)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """Scores of bags of standard rows, and what their gradient needs."""
        h = self.encode(x)
        score, kept = self.attend(h, starts)
        return score, (x, h, *kept)

    def gradient(self, y: np.ndarray, score: np.ndarray, kept: tuple, starts: np.ndarray) -> dict:
        p, (x, h, t, g, w, z, bag) = self.p, kept
        d = (score - y) / len(y)
        dz = d[:, None] * p["o"]
        dh = w[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(1)
        de = w * (dw - np.add.reduceat(w * dw, starts)[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t**2), de[:, None] * p["a"] * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h**2)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de,
                "o": z.T @ d, "c": d.sum()}

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        bags = [np.concatenate([self.encode(self.standard(x)) for x in passage_blocks(t)]) for t in texts]
        return self.attend(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])[0]


def fit(bags: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Adam on batches of bags, the step falling to zero. Without labelled bags
    every score is one half."""
    if not len(y):
        flat = Network(np.zeros(FEATURES), np.ones(FEATURES))
        flat.p["o"] = np.zeros(HIDDEN)
        return flat
    order = np.random.default_rng(SEED).permutation(len(y))
    bags, y = [bags[i] for i in order], y[order].astype(np.float32)
    x = np.concatenate(bags)
    mean = x.mean(0, dtype=np.float64)
    spread = sum(((x[i:i + 4096] - mean) ** 2).sum(0) for i in range(0, len(x), 4096))
    scale = np.maximum(np.sqrt(spread / len(x)), 1e-3)
    # shares of buckets keep their proportions: a rare bucket must not count as much as a frequent one
    for part in (slice(SHAPE_FEATURES, SHAPE_FEATURES + WORD_BUCKETS), slice(SHAPE_FEATURES + WORD_BUCKETS, FEATURES)):
        scale[part] = np.sqrt((scale[part] ** 2).mean())
    net = Network(mean.astype(np.float32), scale.astype(np.float32))
    for i in range(0, len(x), 4096):
        x[i:i + 4096] = net.standard(x[i:i + 4096])
    share = np.clip(y.mean(), 0.01, 0.99)
    net.p["c"] = np.log(share / (1 - share))
    net.p = {k: np.asarray(v, np.float32) for k, v in net.p.items()}
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    edges, batches = np.cumsum([0, *map(len, bags)]), -(-len(y) // BATCH)
    for i in range(1, rounds + 1):
        a = (i - 1) % batches * BATCH
        b = min(a + BATCH, len(y))
        starts = edges[a:b] - edges[a]
        score, kept = net.forward(x[edges[a]:edges[b]], starts)
        for k, d in net.gradient(y[a:b], score, kept, starts).items():
            d = d + DECAY * net.p[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d**2
            step = (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
            net.p[k] = net.p[k] - RATE * (1 - (i - 1) / rounds) * step
    net.p = {k: np.asarray(v, np.float64) for k, v in net.p.items()}
    return net


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, rounds: int = ROUNDS) -> Network:
    """Fit on at most ``max_docs`` labelled documents, chosen by hash of the id.
    Features are computed by the executors over whole texts."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), "doc_id"  # at most max_docs rows
    )

    def encode(batches):
        for batch in sliced(batches, DOCS_AT_ONCE):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["y"],
                 pa.array([training_rows(t.as_py()).tobytes() for t in batch["text"]], pa.binary())],
                ["doc_id", "y", "x"],
            )

    # equal rows of an id say nothing new: at most max_docs ids, each with its different texts
    got = chosen.select("doc_id", "y", "text").distinct().mapInArrow(released(encode), "doc_id long, y double, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    return fit(bags, np.array([r.y for r in got]), rounds)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, null and empty texts too."""

    def run(batches):
        for batch in batches:
            texts = batch["text"]
            for a in range(0, max(len(texts), 1), DOCS_AT_ONCE):
                part = batch.slice(a, DOCS_AT_ONCE)
                values = net.score([t.as_py() for t in part["text"]])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(values, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(released(run), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (doc_id, quality) and score every document.

    A label may come twice (averaged), be null or have no document (ignored);
    rows of ``docs`` may repeat and their ids be null. Other columns do not
    matter. No documents: no row. No labels: every score is one half.
    """
    return score(docs, train(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, all columns unchanged."""
    net = train(docs, labels)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), DOCS_AT_ONCE):
                part = batch.slice(a, DOCS_AT_ONCE)
                values = net.score([t.as_py() for t in part["text"]])
                yield part.filter(pa.array(values >= 0.5))

    return docs.select(*columns).mapInArrow(released(run), docs.schema)

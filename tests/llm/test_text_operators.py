"""Token encoding, packing, counting, mixing, secrets and quality."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from corpusloom.llm import memory, mixing, packing, quality, secrets, token_counts
from corpusloom.llm.tokens import Encoder, default_vocabulary

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("length", T.StringType()), T.StructField("size", T.StringType()), T.StructField("row", T.StringType()),
])


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "c") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["stream", "dry", "river-bed", "It's", "ÉTÉ", "über", "x" * 70, "42", "…", "naïve", "end."]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(n)]


ODD = [None, "", "   \n\t", "ab" * 20_000, "y " * 9000]


def test_encoder_equals_the_library(tokenizer):
    rng, encoder = random.Random(5), Encoder(default_vocabulary())
    alphabet = "abcTHS'strevem ÀéßµªºÿŸΣσςİıǅ²¹½0189 \t\n\x0b\x1c\x85\xa0　́,.!?-_|<>\"中文😀́n̈"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
    for text in [*texts, *some_texts(1, 20), "a<|endoftext|>b <|startoftext|>", "ΑΣ ΑΣ"]:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.ids(text) == ids, repr(text)


def test_packing(spark, tokenizer):
    texts = [*some_texts(2, 60), *ODD]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", "s"), (3, texts[3], "s")]
    got = packing.pack(docs_of(spark, rows)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        times = 2 if doc_id == 3 else 1
        n = -(-len(ids[doc_id]) // 2048)
        assert sorted(p.piece for p in pieces) == sorted(list(range(n)) * times)
        for p in pieces:
            own = ids[doc_id][p.start:p.start + p.length]
            assert p.start == 2048 * p.piece and len(own) == p.length
            assert p.length == 2048 or p.start + p.length == len(ids[doc_id])
            assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for spans in inside.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(inside) <= -(-total // 2048) + 1
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_plan_is_tight_and_whole():
    rng = random.Random(1)
    for top in (2048, 900, 60):
        histogram = Counter(min(2048, 1 + int(rng.expovariate(4 / top))) for _ in range(4000))
        patterns = packing.plan(dict(histogram))
        used = Counter()
        for inside, times in patterns:
            assert sum(inside) <= 2048
            for length in inside:
                used[length] += times
        assert used == histogram
        assert sum(m for _, m in patterns) <= -(-sum(k * n for k, n in histogram.items()) // 2048) + 1


def test_exact_fill_finds_every_triple():
    rng = random.Random(2)
    for _ in range(200):
        left = np.zeros(41, np.int64)
        for length in rng.sample(range(1, 41), 6):
            left[length] = rng.randint(1, 2)
        gap = rng.randint(3, 40)
        items = [k for k in range(41) for _ in range(left[k])]
        possible = any(
            sum(c) == gap for r in (1, 2, 3) for c in __import__("itertools").combinations(items, r)
        )
        fill = packing.exact_fill(left.copy(), gap)
        assert (fill is not None) == possible
        if fill:
            assert sum(fill) == gap and all(Counter(fill)[k] <= left[k] for k in fill)


def test_token_counts(spark, tokenizer):
    texts = [*some_texts(3, 40), *ODD, "", ""]
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_counts.token_counts(docs_of(spark, [(1, t, None) for t in texts])).collect()
    assert sorted(r.length for r in got) == sorted(set(lengths))
    for r in got:
        up_to = [n for n in lengths if n <= r.length]
        assert r.docs == lengths.count(r.length) and r.docs_up_to == len(up_to)
        assert r.docs_longer == len(lengths) - len(up_to) and r.quantile == len(up_to) / len(lengths)
        assert r.tokens_up_to == sum(up_to) and r.tokens_total == sum(lengths)
        assert r.tokens_longer == sum(lengths) - sum(up_to)
        assert r.tokens_truncated == sum(min(n, r.length) for n in lengths)
    assert token_counts.token_counts(docs_of(spark, [])).count() == 0


def shared_out(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by repeated sharing, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["b", "B", "ä", None, "zz", "𐐀", "￿"]
    rows = [(i, "w " * rng.randint(0, 60), rng.choices(names, [1, 9, 3, 2, 40, 1, 1])[0]) for i in range(1500)]
    rows += [(5000, None, "b"), (5001, "", None), (None, "one two\x0bthree", "zz"), (7, rows[7][1], rows[7][2])]
    df = docs_of(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken, longest = shared_out(size), Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert sum(taken.values()) <= sum(size.values()) < sum(taken.values()) + 61
    assert all(abs(taken[s] - target[s]) <= 2 * max(longest.values()) for s in size)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    wide = Counter(r.doc_id for r in mixing.mixed(df).collect())
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert wide == +copies


def test_mixing_small_cases(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    only = mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [r.taken for r in only] == [0, 0] and [r.target for r in only] == [0.0, 0.0]
    assert mixing.mixed(docs_of(spark, [(1, None, "a")])).count() == 0
    same = mixing.mix(docs_of(spark, [(1, "a b", "x")] * 10)).collect()
    assert sum(r.taken for r in same) == 20


BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0), "hex": (r"[0-9a-f]+", 0),
}


def plain_spans(text):
    found = []
    for k, (kind, (pattern, flags)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, flags):
            n = len(m[2]) if kind == "assign" else len(m[0])
            if n >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_secrets(spark):
    live, copied = "Zx9-QwErTy_1234567890-abcDEF", "Ab1_ExampleExample_998877665544"
    texts = [
        ("é token = \"" + "0a" * 20 + "\" end", "a"), ("PASSWORD: 'abcdefgh' token=token=secret: abcdefghij", "a"),
        ("AKIA" + "Z9" * 8 + " AKIASHORT akia" + "z9" * 8, "b"), ("ſecret=abcdefgh toKen=abcdefgh", "b"),
        ("f" * 31 + " " + "f" * 32 + "g" + "0" * 40, None), (f"key {live}.", "c"), (f"see {live}", "c"),
        (f"{copied} here", "a"), (f"{copied} there", "b"), (None, "a"), ("", None), ("api_key=" + "A" * 9 + "\n" + "x " * 40000, "z"),
    ]
    df = docs_of(spark, [(i, t, s) for i, (t, s) in enumerate(texts)] + [(None, "passwd=12345678", "a"), (0, *texts[0])])
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(texts) + 2
    by_id = {r.doc_id: r for r in got}
    for i, (text, _) in enumerate(texts):
        spans, r = plain_spans(text or ""), by_id[i]
        kinds = Counter(s.split(":")[0] for s in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        if i not in (5, 6):
            assert r.spans == ",".join(spans)
    assert by_id[5].spans == f"live:4:{4 + len(live)}" and by_id[6].n_live == 1
    assert by_id[7].n_copied == 1 and by_id[None].spans == "assign:0:15"
    assert secrets.find_secrets(docs_of(spark, [])).count() == 0
    masked = {r.doc_id: r for r in secrets.mask_secrets(df).collect()}
    assert masked[5].text == "key [SECRET]." and masked[7].text == texts[7][0] and masked[9].text is None
    assert masked[0].text == "é [SECRET]\" end" and masked[0].n_chars == len(masked[0].text)
    assert masked[0].length == "a" and secrets.mask_secrets(df).columns == df.columns


def test_copies_of_a_text_share_its_key(spark):
    key, sample, odd = "Zx9-QwErTy_1234567890-abcDEF", "Ab1_ExampleExample_998877665544", "Qq7_LmNoPqRs_5566778899-zzTT"
    rows = [(0, f"key {key}", "a"), (1, f"key {key}", "b"), (2, f"my {key}", "b"), (3, f"key {key}", "c")]
    rows += [(10 + i, f"text {i}: {sample}", "a") for i in range(12)]
    rows += [(50, f"x {odd}", "a"), (51, f"y {odd}", "b"), (52, f"y {odd}", "c")]
    df = docs_of(spark, rows)
    got = {r.doc_id: r for r in secrets.find_secrets(df, max_repositories=10).collect()}
    assert all(got[i].n_live == 1 and got[i].spans.startswith("live:") for i in range(4))  # b has both texts
    assert all(got[10 + i].n_copied == 1 and not got[10 + i].spans for i in range(12))  # one owner, many documents
    assert all(got[i].n_copied == 1 for i in (50, 51, 52))
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df, max_repositories=10).collect()}
    assert masked[0] == masked[1] == masked[3] == "key [SECRET]" and masked[10] == rows[4][1] and masked[50] == f"x {odd}"
    assert {r.n_live for r in secrets.find_secrets(df).filter("doc_id between 10 and 30").collect()} == {1}


def test_key_in_a_few_owners_is_live_and_example_in_most_is_not(spark):
    key, sample = "Zx9-QwErTy_1234567890-abcDEF", "Ab1_ExampleExample_998877665544"
    rows = [(i, f"text {i}", f"s{i % 20}") for i in range(40)]
    rows += [(100, f"one {key}", "s3"), (101, f"another {key}", "s7")]
    rows += [(200 + i, f"doc {i}: {sample}", f"s{i}") for i in range(15)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    assert got[100].spans == f"live:4:{4 + len(key)}" and got[101].n_live == 1
    assert all(got[200 + i].n_copied == 1 and not got[200 + i].spans for i in range(15))
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs_of(spark, rows)).collect()}
    assert masked[100] == "one [SECRET]" and masked[101] == "another [SECRET]" and masked[200] == rows[42][1]


def test_ownership_against_plain_counts(spark):
    rng = random.Random(12)
    keys = [f"Kq{i}_Zx9QwErTy1234567890abc{i * 7919}" for i in range(12)]
    rows = []
    for i in range(300):
        k = min(rng.randrange(12), rng.randrange(12))
        rows.append((i, f"note {rng.randrange(40)} {keys[k]}", rng.choice([None, *(f"s{j}" for j in range(2 + k))])))
    plain = defaultdict(lambda: defaultdict(set))
    first = {}
    for i, text, source in rows:
        plain[text.split()[-1]][source].add(text)
        first.setdefault(text, str(i))
        first[text] = min(first[text], str(i))
    owners_of_all = len({s for _, _, s in rows})
    live = {}
    for key, held in plain.items():
        texts = set().union(*held.values())
        owners = min(len(held), 1 + len(texts) - max(map(len, held.values())))
        repositories = len({first[t] for t in texts})
        live[key] = not (owners > max(1, owners_of_all / 4) or repositories > 1000)
    assert len(set(live.values())) == 2
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    for i, text, _ in rows:
        at = text.rindex(" ") + 1
        assert got[i].spans == (f"live:{at}:{len(text)}" if live[text.split()[-1]] else ""), (i, text)


def test_quality(spark):
    rng = random.Random(4)
    words = "the dry stream bed holds water after rain and fish return to pools".split()
    good = [" ".join(rng.choices(words, k=rng.randint(5, 300))) + "." for _ in range(240)]
    bad = [" | ".join(rng.choices(words, k=rng.randint(5, 200))) + " ### !!!" for _ in range(120)]
    rows = [(i, t, None) for i, t in enumerate(good + bad)]
    y = {i: int(i < len(good)) for i, _, _ in rows}
    labels = spark.createDataFrame(
        [(i, v, 0) for i, v in y.items()] + [(None, 1, 0), (3, None, 0), (99999, 1, 1), (5, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    extra = [(9000, None, None), (9001, "", None), (None, "the dry stream", None), (9002, "stream " * 50_000, None)]
    got = quality.judge_quality(docs_of(spark, rows + extra), labels).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.95 * len(held)
    none = quality.judge_quality(docs_of(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.judge_quality(docs_of(spark, []), labels).count() == 0


def test_quality_reads_words(spark):
    """Both kinds have words of the same letters, so only their order tells."""
    rng = random.Random(9)
    good = "stream river water plant study basin flow season result model".split()
    kinds = [["".join(sorted(w)) for w in good], good]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=rng.randint(20, 400))), None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, quality int")
    held = [r for r in quality.judge_quality(docs_of(spark, rows), labels).collect() if r.held_out]
    assert len(held) > 90 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 5000, 60_000])
def test_passages_cover_the_text(n):
    words = [f"w{i % 37}" for i in range(n)]
    rows = np.concatenate(list(quality.passage_blocks(" ".join(words))))
    assert rows.shape == (max(-(-n // quality.PASSAGE), 1), quality.FEATURES)
    for i in {0, len(rows) // 2, len(rows) - 1} if n else ():
        own = words[i * quality.PASSAGE:(i + 1) * quality.PASSAGE]
        hashes = [zlib.crc32(w.encode()) for w in own]
        buckets = Counter(h % quality.WORD_BUCKETS for h in hashes)
        buckets.update(((a * 0x9E3779B1 + b) % 2**64 >> 7) % quality.WORD_BUCKETS for a, b in zip(hashes, hashes[1:]))
        expected = np.zeros(quality.WORD_BUCKETS)
        for k, c in buckets.items():
            expected[k] = c / (2 * len(own) - 1)
        got = rows[i][quality.SHAPE_FEATURES:quality.SHAPE_FEATURES + quality.WORD_BUCKETS]
        assert np.allclose(got, expected, atol=1e-6)
    few = quality.training_rows(" ".join(words))
    assert len(few) == min(len(rows), quality.MAX_TRAINING_ROWS)
    assert np.allclose(few.mean(0), rows.mean(0), atol=0.02)


def test_held_out_labels_are_never_learnt(spark):
    rows = [(i, f"text number {i} " * (i % 7 + 1), None) for i in range(60)]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = [(i, i % 2) for i, _, _ in rows]
    turned = [(i, 1 - v if i in held else v) for i, v in labels]
    df = docs_of(spark, rows)
    first, second = (
        sorted((r.doc_id, r.score) for r in quality.judge_quality(df, spark.createDataFrame(x, "doc_id long, quality int")).collect())
        for x in (labels, turned)
    )
    assert first == second


def test_gradient():
    rng = np.random.default_rng(0)
    x, starts, y = rng.standard_normal((9, quality.FEATURES)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    net = quality.Network(x.mean(0), x.std(0))

    def loss():
        p, kept = net.forward(x, starts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), p, kept

    _, p, kept = loss()
    slopes = net.gradient(y, p, kept, starts)
    for name in ("W", "V", "U", "a", "o"):
        at = (0,) * net.p[name].ndim
        net.p[name][at] += 1e-6
        up = loss()[0]
        net.p[name][at] -= 2e-6
        down = loss()[0]
        net.p[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - slopes[name][at]) < 1e-6


def test_batches_are_handled_in_slices():
    """Also an empty batch comes through, for its schema."""
    batch = pa.RecordBatch.from_pydict({"x": list(range(1100))})
    parts = list(memory.sliced([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [512, 512, 76, 0]
    assert [x for p in parts for x in p["x"].to_pylist()] == list(range(1100))

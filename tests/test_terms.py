import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from corpusloom.functions.text import stop_words
from corpusloom.operators import dtm, terms

SF = "/root/testdata/sf0.01"


def t_of(spark, n, parts, length):
    df = spark.createDataFrame([(n, *parts, length)], ["n"] + [f"n{i}" for i in range(len(parts))] + ["l"])
    t = terms.collocation_t("n", [f"n{i}" for i in range(len(parts))], "l")
    return df.select(F.expr(t).alias("t")).first()["t"]


@pytest.mark.parametrize("n,parts,length,expected", [
    (3, (4, 5), 100, 1.641389), (3, (30, 40), 100, -5.275893),
    (2, (2, 2, 2), 100, 1.428000), (1, (2, 2, 2), 100, 1.004234),
])
def test_collocation_t(spark, n, parts, length, expected):
    assert t_of(spark, n, parts, length) == pytest.approx(expected, abs=1e-6)


def _t(n, parts, length):
    p = n / length
    return (p - math.prod(x / length for x in parts)) / math.sqrt(p * (1 - p) / length)


@given(st.integers(1, 40), st.lists(st.integers(0, 30), min_size=3, max_size=3), st.integers(1, 400),
       st.floats(0.1, 4))
def test_count_bounds_never_drop_a_collocation(n, more, rest, threshold):
    parts = [n + m for m in more]
    length = sum(parts) + rest
    if _t(n, parts[:2], length) > threshold:
        assert n >= terms.min_count_for_bigram(threshold)
    if _t(n, parts, length) > threshold:
        assert n >= terms.min_count_for_trigram(threshold)


def test_default_bounds():
    assert terms.min_count_for_bigram(1.6) == 3 and terms.min_count_for_trigram(1.4) == 2
    assert terms.min_count_for_bigram(-1) == 1


def test_collocations_of_english_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("doc_id", "text")
    words = terms.with_words(docs, stop_words("english"), stem=False, drop_words=())
    per_doc = terms.doc_terms(words)
    for n, expected in ((2, (435, 7529, 1184.331798)), (3, (418, 7054, 1147.840894))):
        row = terms.collocations(per_doc, n).agg(F.count("*"), F.sum("n"), F.round(F.sum("t"), 6)).first()
        assert tuple(row) == expected


def brute_force(texts, theta2, theta3, stop):
    """The whole definition in plain Python, document by document."""
    out = {}
    for doc_id, text in texts:
        words = [w if w not in stop and len(w) > 2 and not re.search("[0-9]", w) else None
                 for w in re.findall("[a-z0-9]+", text.lower())]
        counts = {w: n for w, n in Counter(w for w in words if w).items() if n > 1}
        length = sum(counts.values())
        for n, theta in ((2, theta2), (3, theta3)):
            grams = Counter(g for g in zip(*[words[i:] for i in range(n)]) if all(g))
            for gram, c in grams.items():
                if all(w in counts for w in gram):
                    t = _t(c, [counts[w] for w in gram], length) if c < length else None
                    if t is not None and t > theta:
                        out[(doc_id, *gram)] = (c, round(t, 9))
    return out


def test_collocations_against_brute_force(spark):
    rng = random.Random(7)
    vocab = ["river", "flow", "dry", "stream", "the", "of", "x1", "ab", "sand", "bed"]
    texts = [(i, " ".join(rng.choices(vocab, weights=[6, 5, 4, 4, 3, 3, 1, 1, 2, 2], k=rng.randint(0, 120))))
             for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    words = terms.with_words(df, ["the", "of"], stem=False, drop_words=())
    for theta2, theta3 in ((1.6, 1.4), (0.2, 0.2)):
        per_doc = terms.doc_terms(words, bigram_t=theta2, trigram_t=theta3)
        got = {}
        for n in (2, 3):
            for r in terms.collocations(per_doc, n).collect():
                key = (r["doc_id"], *[r[f"w{j}"] for j in range(1, n + 1)])
                got[key] = (r["n"], round(r["t"], 9))
        expected = brute_force(texts, theta2, theta3, {"the", "of"})
        assert got == expected and len(got) > 2


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(3)
    rows = {(d, f"w{int(rng.paretovariate(0.7))}") for d in range(80) for _ in range(40)}
    return spark.createDataFrame([(d, w, 2) for d, w in sorted(rows)], "doc_id bigint, term string, n bigint")


def test_one_range_equals_two_anti_joins(spark, counts):
    min_df, max_df = 4, 30
    fused = {tuple(r) for r in terms.prune_vocab(counts, min_df, max_df).collect()}
    without_common = counts.join(terms.common_terms(counts, max_df), "term", "left_anti")
    without_rare = without_common.join(terms.rare_terms(without_common, min_df), "term", "left_anti")
    assert fused == {(r["doc_id"], r["term"], r["n"]) for r in without_rare.collect()} and fused


def test_vocabulary_and_totals(spark, counts):
    totals = terms.corpus_totals(counts).first()
    assert totals["n_terms"] == counts.select("term").distinct().count()
    assert totals["total_n"] == 2 * counts.count()


def test_term_index_is_dense(spark, counts):
    ids = sorted(r["term_id"] for r in dtm.term_index(counts, buckets=5).collect())
    assert ids == list(range(len(ids))) and len(ids) == counts.select("term").distinct().count()


def test_matrix_holds_every_cell(spark, counts):
    index = dtm.term_index(counts)
    names = {r["term_id"]: r["term"] for r in index.collect()}
    got = set()
    for r in dtm.to_dtm(counts, index).collect():
        v = r["features"]
        assert isinstance(v, SparseVector) and v.size == len(names)
        got |= {(r["doc_id"], names[i], int(x)) for i, x in zip(v.indices, v.values)}
    assert got == {tuple(r) for r in counts.collect()}


def test_matrix_merges_terms_spelled_alike(spark):
    df = spark.createDataFrame([(1, "a_b", 2), (1, "a_b", 3)], "doc_id bigint, term string, n bigint")
    assert dtm.to_dtm(df, dtm.term_index(df)).first()["features"].values.tolist() == [5.0]


def test_summary(spark):
    df = spark.createDataFrame([(1, "aa", 2), (1, "bbb", 1), (2, "aa", 4)], "doc_id bigint, term string, n bigint")
    row = dtm.dtm_summary(df).first().asDict()
    assert row == {"n_docs": 2, "n_terms": 2, "nnz": 3, "total_n": 7, "longest_term": 3, "sparsity": 0.25}
    assert [tuple(r) for r in dtm.top_total_terms(df, 1).collect()] == [("aa", 6)]


def test_stem_vocab_merges_inflections(spark):
    df = spark.createDataFrame([(1, "Rivers river rivers 12 the")], "doc_id bigint, text string")
    got = {tuple(r) for r in terms.stem_vocab(df, ["the"]).collect()}
    assert got == {("rivers", "river"), ("river", "river")}
    per_doc = terms.doc_terms(terms.with_words(df, ["the"], stem=True))
    assert [tuple(r) for r in terms.unigrams(per_doc).collect()] == [(1, "river", 3)]


def test_place_in_a_sorted_array(spark):
    from corpusloom.functions.arrays import place_in, search_steps

    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        items = sorted(f"{i}é" for i in range(0, 2 * n, 2))
        rows = spark.createDataFrame([(items, f"{i}é") for i in range(-1, 2 * n + 1)], "items array<string>, x string")
        got = rows.select("x", F.expr(place_in("items", "x", search_steps("items"))).alias("p")).collect()
        assert [r.p for r in got] == [items.index(r.x) if r.x in items else None for r in got]


def test_collocations_of_a_long_document(spark):
    """Counts of words in an n-gram equal plain counts, however many words there are."""
    rng = random.Random(11)
    tokens = [rng.choice(["", "w", "x"]) + f"word{min(int(rng.paretovariate(0.8)), 4000):04d}" for _ in range(40_000)]
    tokens = [None if rng.random() < 0.1 else t for t in tokens]
    docs = spark.createDataFrame([(1, tokens)], "doc_id long, words array<string>")
    per_doc = terms.doc_terms(docs)
    counts = Counter(t for t in tokens if t)
    length = sum(n for n in counts.values() if n > 1)
    for size in (2, 3):
        grams = Counter(g for g in zip(*(tokens[i:] for i in range(size)), strict=False) if None not in g)
        want = {}
        for gram, n in grams.items():
            p, chance = n / length, 1.0
            for word in gram:
                chance *= counts[word] / length
            t = (p - chance) / (p * (1 - p) / length) ** 0.5
            if all(counts[word] > 1 for word in gram) and t > (1.6 if size == 2 else 1.4):
                want[gram] = (n, round(t, 9))
        rows = terms.collocations(per_doc, size).collect()
        assert {tuple(r[f"w{j + 1}"] for j in range(size)): (r.n, round(r.t, 9)) for r in rows} == want and want

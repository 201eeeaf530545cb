import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.operators import distances, dtm, membership, models, ranking
from corpusloom.functions.text import stop_words
from corpusloom.plans import study
from verification import tables

SF = "/root/testdata/sf0.01"
MIX = "doc_id bigint, weights array<double>"


def mixtures_of(spark, rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], MIX)


def test_posterior_of_english_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    terms_ = (
        docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
        .filter(F.length("term") > 2).groupBy("doc_id", "term").agg(F.count("*").alias("n")).filter("n > 1")
        .withColumn("topic", (F.length("term") % 4 + 1).cast("int"))
    )
    gamma = models.long_gamma(models.posterior_gamma(models.nest_assignments(terms_), 4))
    got = gamma.groupBy("topic").agg(
        F.count("*"), F.round(F.sum("gamma"), 6), F.round(F.max("gamma"), 6), F.round(F.min("gamma"), 6))
    assert sorted(map(tuple, got.collect())) == [
        (1, 605, 186.733725, 0.641447, 0.136029), (2, 605, 84.851926, 0.258929, 0.002388),
        (3, 605, 97.995814, 0.557692, 0.053066), (4, 605, 235.418535, 0.558511, 0.082237)]


def test_posterior_sums_to_one(spark):
    long = spark.createDataFrame(
        [(1, "a", 1, 3), (1, "b", 2, 2), (2, "a", 1, 4), (2, "c", 3, 2)],
        "doc_id bigint, term string, topic int, n bigint")
    nested = models.nest_assignments(long)
    gamma = models.posterior_gamma(nested, 3)
    assert all(math.isclose(sum(r["weights"]), 1) for r in gamma.collect())
    beta = {r["term"]: r["weights"] for r in models.posterior_beta(nested, 3).collect()}
    assert np.allclose(np.sum(list(beta.values()), axis=0), 1)
    assert beta["a"][0] == pytest.approx(7.1 / 7.3) and beta["a"][1] == pytest.approx(0.1 / 2.3)


def test_wide_long_and_nested_agree(spark):
    nested = mixtures_of(spark, [(0.2, 0.8), (0.5, 0.5)])
    long = models.long_gamma(nested)
    wide = models.gamma_wide(nested, 2)
    assert sorted(map(tuple, models.pivot_gamma(long, 2).collect())) == sorted(map(tuple, wide.collect()))
    assert wide.columns == ["doc_id", "t01", "t02"]
    assert sorted(map(tuple, models.nest_gamma(long, 2).collect())) == sorted(map(tuple, nested.collect()))
    for dom in (membership.dominant_topic(nested), membership.dominant_topic_long(long, 2),
                membership.dominant_topic_wide(wide, 2)):
        assert sorted(map(tuple, dom.collect())) == [(0, 2), (1, 1)]


def test_distances(spark):
    # terms as rows, topics (0.2, 0.3, 0.5) and (0.5, 0.3, 0.2) as columns
    beta = spark.createDataFrame([("a", [0.2, 0.5]), ("b", [0.3, 0.3]), ("c", [0.5, 0.2])],
                                 "term string, weights array<double>")
    row = distances.topic_dissimilarity(beta).first()
    assert (row["topic_a"], row["topic_b"]) == (1, 2) and row["dist"] == pytest.approx(0.3)
    assert models.topic_divergence(beta, 2).first()["score"] == pytest.approx(0.137444, abs=1e-6)


def test_bray_curtis_against_numpy(spark):
    rng = np.random.default_rng(5)
    for k, rows in ((2, 5), (7, 50)):
        m = rng.dirichlet(np.ones(k), rows)
        got = {(r["topic_a"], r["topic_b"]): r["dist"] for r in distances.bray_curtis(mixtures_of(spark, m)).collect()}
        assert len(got) == k * (k - 1) // 2
        for (a, b), d in got.items():
            x, y = m[:, a - 1], m[:, b - 1]
            assert 0 <= d <= 1 and d == pytest.approx(np.abs(x - y).sum() / (x + y).sum())


def test_research_gap(spark):
    s = "topic_a int, topic_b int, dist double"
    t = spark.createDataFrame([(1, 2, 0.2), (1, 3, 0.4), (2, 3, 0.6)], s)
    a = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1), (2, 3, 0.3)], s)
    gap = lambda scaled: {(r[0], r[1]): round(r[2], 9) for r in distances.research_gap(t, a, scaled).collect()}
    assert gap(False) == {(1, 2): 0.1, (1, 3): 0.04, (2, 3): 0.18}
    assert gap(True) == {(1, 2): 0.0, (1, 3): 0.0, (2, 3): 0.5}
    assert tuple(distances.dist_range(t).first()) == (0.2, 0.6)
    flat = spark.createDataFrame([(1, 2, 0.5)], s)
    assert distances.minmax(flat).first()["dist"] is None


def test_top_n_keeps_ties_also_when_they_fill_the_table(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), i, round(rng.random(), 1)) for i in range(400)]
    rows += [(1, 1000 + i, 1.05) for i in range(300)]  # copies of one document
    df = spark.createDataFrame(rows, "topic int, doc_id bigint, gamma double").repartition(6)
    got = {(r["topic"], r["doc_id"]) for r in ranking.top_docs(df, 5).collect()}
    expected = set()
    for t in (1, 2, 3):
        mine = [r for r in rows if r[0] == t]
        expected |= {(t, i) for _, i, g in mine if sum(x > g for _, _, x in mine) < 5}
    assert got == expected and len(got) > 300


def test_top_words_and_ranks(spark):
    top = spark.createDataFrame([(1, "b", 0.2), (1, "a", 0.2), (1, "c", 0.5), (2, "a", 0.1)],
                                "topic int, term string, beta double")
    assert {r[0]: r[1] for r in ranking.top_words(top).collect()} == {1: "c, a, b", 2: "a"}
    assert {(r["topic"], r["term"]): r["term_rank"] for r in ranking.term_rank(top).collect()} == \
        {(1, "b"): 1, (1, "a"): 2, (1, "c"): 3, (2, "a"): 1}
    assert [tuple(r) for r in ranking.shared_top_terms(top, 2).collect()] == [("a", 2)]
    assert [r["term"] for r in ranking.ordered(top, "beta", "term").collect()] == ["c", "a", "b", "a"]


def test_generality_counts_tied_topics(spark):
    got = {r["topic"]: r for r in membership.topic_generality(
        mixtures_of(spark, [(0.1, 0.5, 0.5), (0.6, 0.3, 0.1)])).collect()}
    assert got[2]["selected_weight"] == 0.5 and got[3]["selected_weight"] == 0.5
    assert got[1]["selected_weight"] == 0.6 and got[1]["unselected_weight"] == 0.1
    never = membership.topic_generality(mixtures_of(spark, [(0.9, 0.1)])).filter("topic = 2").first()
    assert never["selected_weight"] is None and never["unselected_weight"] == 0.1


def test_ranked_topic_counts(spark):
    df = spark.createDataFrame([(2, 1.0), (3, 3.0), (4, 3.0), (5, 2.0)], schema.SCORES)
    got = {r["k"]: (r["scaled"], r["is_best"]) for r in models.rank_topic_counts(df).collect()}
    assert got == {2: (0.0, False), 3: (1.0, True), 4: (1.0, False), 5: (0.5, False)}


# --- fits ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def fitted(spark):
    papers = tables.papers(spark, "/root/testdata/sf0.001")
    args = dict(k=4, seed=1, bounds=(2, 100), max_iter=4)
    return [study.fit_topics(papers, stop_words("english"), args["k"], args["seed"], "year",
                             bounds=args["bounds"], max_iter=args["max_iter"]) for _ in range(2)]


def test_fit_invariants(fitted):
    s = fitted[0]
    mix = s.mixtures.collect()
    assert len(mix) == len({r["doc_id"] for r in mix}) and all(r["year"] for r in mix)
    assert all(len(r["weights"]) == 4 and math.isclose(sum(r["weights"]), 1, rel_tol=1e-6) for r in mix)
    beta = s.beta.collect()
    assert len(beta) == s.index.count()
    totals = np.sum([r["weights"] for r in beta], axis=0)
    assert np.allclose(totals, 1) and min(min(r["weights"]) for r in beta) > 0


def test_table_of_counts_equals_the_topic_matrix(fitted):
    s = fitted[0]
    matrix = s.model.topicsMatrix().toArray()
    ids = {r["term"]: r["term_id"] for r in s.index.collect()}
    for r in s.beta.collect():
        expected = (matrix[ids[r["term"]]] + 0.1) / (matrix.sum(axis=0) + 0.1 * len(ids))
        assert np.allclose(r["weights"], expected)


def test_same_seed_same_topics(fitted):
    a, b = ({r["term"]: r["weights"] for r in s.beta.collect()} for s in fitted)
    assert a.keys() == b.keys() and all(np.allclose(a[t], b[t], atol=1e-9) for t in a)


def test_document_topics_are_the_fits_own(spark):
    from corpusloom.operators import terms
    from corpusloom.session import cut_lineage

    per_doc = tables.document_terms(spark, "/root/testdata/sf0.001")
    kept = cut_lineage(terms.all_terms(per_doc, 2, 100))
    index = cut_lineage(dtm.term_index(kept))
    matrix = cut_lineage(dtm.to_dtm(kept, index))
    counts, _ = models.stored_counts(models.fit_lda(matrix, 3, seed=2, max_iter=3))
    length = {r["doc_id"]: r["n"] for r in kept.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    by_length = sorted(round(sum(r["counts"]), 3) for r in counts.filter("id >= 0").collect())
    assert by_length == sorted(map(float, length.values()))
    plain = models.doc_topics(counts, 3, matrix, alpha=0.0).collect()
    smooth = {r["doc_id"]: r["weights"] for r in models.doc_topics(counts, 3, matrix).collect()}
    assert {r["doc_id"] for r in plain} == set(length)
    for r in plain:
        n, own = length[r["doc_id"]], np.array(r["weights"])
        assert math.isclose(own.sum(), 1, rel_tol=1e-6)
        assert np.allclose(smooth[r["doc_id"]], (own * n + 50 / 3) / (n + 50))
    moved = matrix.orderBy(F.desc("doc_id")).limit(50)
    with pytest.raises(Exception, match="not its own"):
        models.doc_topics(counts, 3, moved).collect()


def test_sweep_leaves_nothing_behind(spark):
    from corpusloom import session
    from corpusloom.operators import terms

    per_doc = tables.document_terms(spark, "/root/testdata/sf0.001")
    kept = terms.all_terms(per_doc, 2, 100)
    index = dtm.term_index(kept)
    matrix = dtm.to_dtm(kept, index)
    before = set(session._WRITTEN)
    rows = models.topic_count_sweep(matrix, index, (2, 3), seed=1, max_iter=2).collect()
    assert [r["k"] for r in rows] == [2, 3] and all(r["score"] > 0 for r in rows)
    assert set(session._WRITTEN) == before


def test_divergence_in_one_pass_equals_pairs(spark):
    rows = [(w, key, n) for w in "abcdef" for key, n in ((ord(w), 3), (ord(w) * 3 + 1, 2))]
    df = spark.createDataFrame(rows, "term string, key bigint, n bigint")
    got = {r["k"]: r["score"] for r in models.posterior_divergence(df, (2, 3, 5)).collect()}
    for k in (2, 3, 5):
        n = np.zeros((6, k))
        for w, key, c in rows:
            n[ord(w) - 97, key % k] += c
        beta = (n + 0.1) / (n.sum(0) + 0.6)
        pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
        total = sum(0.5 * ((beta[:, a] - beta[:, b]) * np.log(beta[:, a] / beta[:, b])).sum() for a, b in pairs)
        assert got[k] == pytest.approx(total / (k * (k - 1)))


def test_registered_sweep_fits_every_topic_count():
    from verification import queries

    assert tuple(queries.FITTED) == tuple(range(2, 31))

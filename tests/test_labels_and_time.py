import math
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, membership, trends

# papers per label combination: with an abstract, in all
COMBOS = {
    "Assessment": (329, 340), "Biogeochemistry": (200, 209), "Fish": (174, 190), "Invertebrate": (215, 237),
    "Assessment, Biogeochemistry": (65, 65), "Assessment, Fish": (45, 45), "Assessment, Invertebrate": (66, 66),
    "Biogeochemistry, Fish": (3, 3), "Biogeochemistry, Invertebrate": (32, 35), "Fish, Invertebrate": (21, 22),
    "Assessment, Biogeochemistry, Fish": (2, 2), "Assessment, Biogeochemistry, Invertebrate": (7, 7),
    "Assessment, Fish, Invertebrate": (12, 12), "Assessment, Biogeochemistry, Fish, Invertebrate": (1, 1),
    "Invertebrate, Biogeochemistry, Assessment": (1, 1), None: (1, 1),
}


@pytest.fixture(scope="module")
def reviewed(spark):
    rows, i = [], 0
    for labels, (kept, total) in COMBOS.items():
        for j in range(total):
            rows.append((i, labels, "text" if j < kept else ""))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, labels string, abstract string")


def test_label_share(reviewed):
    got = {r["label"]: r for r in membership.label_share(reviewed).collect()}
    expected = {"Assessment": (528, 539), "Biogeochemistry": (311, 323), "Fish": (258, 275), "Invertebrate": (355, 381)}
    assert {k: (r["n_retained"], r["n_all"]) for k, r in got.items()} == expected
    shares = {"Assessment": (0.449744, 0.436084), "Biogeochemistry": (0.264906, 0.261327),
              "Fish": (0.219761, 0.222492), "Invertebrate": (0.302385, 0.308252)}
    for label, (retained, every) in shares.items():
        assert got[label]["retained"] == pytest.approx(retained, abs=1e-6)
        assert got[label]["all"] == pytest.approx(every, abs=1e-6)
    long = membership.share_long(membership.label_share(reviewed)).collect()
    assert len(long) == 8 and {r["group"] for r in long} == {"retained", "all"}


def test_label_combos(reviewed):
    got = {r["labels"]: (r["n_retained"], r["n_all"]) for r in membership.label_combo_counts(reviewed).collect()}
    assert got == COMBOS
    empty = reviewed.withColumn("abstract", F.lit(""))
    assert {r["n_retained"] for r in membership.label_combo_counts(empty).collect()} == {None}


def test_concordance_and_crosstab(spark):
    dom = spark.createDataFrame(
        [(1, 1, "Fish, Assessment"), (2, 1, "Assessment"), (3, 2, "Assessment"), (4, 3, "Fish"), (5, 1, None)],
        "doc_id bigint, dom_topic int, labels string")
    names = spark.createDataFrame([(1, "Fish"), (2, "Assessment")], "topic int, topic_name string")
    named = membership.with_topic_name(dom, names, "dom_topic")
    got = {r["topic_name"]: (r["n"], r["consist"], r["prop"]) for r in membership.concordance(named).collect()}
    assert got == {"Fish": (3, 1, 1 / 3), "Assessment": (1, 1, 1.0), None: (1, 0, 0.0)}
    cross = {(r["label"], r["dom_topic"]): r["freq"] for r in membership.label_topic_crosstab(dom).collect()}
    assert cross == {("Fish", 1): 1, ("Assessment", 1): 2, ("Assessment", 2): 1, ("Fish", 3): 1}
    sizes = membership.topic_size_named(membership.topic_size(dom), names.unionByName(
        spark.createDataFrame([(9, "None")], names.schema)))
    assert {(r["topic"], r["n"]) for r in sizes.collect()} == {(1, 3), (2, 1), (9, 0)}
    fish = membership.docs_in(dom, membership.docs_with_label(dom, "Fish"))
    assert {r["doc_id"] for r in fish.collect()} == {1, 4}


def test_popularity_and_trend(spark):
    mix = spark.createDataFrame(
        [(1, 1970, [0.2, 0.8]), (2, 1976, [0.4, 0.6]), (3, 1977, [0.5, 0.5]), (4, 1982, [0.9, 0.1]), (5, 2022, [1.0, 0.0])],
        "doc_id bigint, year int, weights array<double>")
    by_year = trends.popularity_by_year(mix, 2)
    assert by_year.count() == 10
    by_period = trends.popularity_by_period(by_year, "b")
    shares = {(r["topic"], r["period"]): r["prop"] for r in by_period.collect()}
    assert shares[(1, "1966-1976")] == pytest.approx(0.3) and len(shares) == 6  # 2022 is in no period
    one = [0.3, 0.5, 0.9]
    row = {r["topic"]: r for r in trends.topic_trend(by_period).collect()}
    assert row[1]["avg_prop_change"] == pytest.approx(mean([0.2, 0.4]) * 100)
    assert row[1]["avg_prop_change"] == pytest.approx((one[-1] - one[0]) / 2 * 100)
    assert row[1]["se"] == pytest.approx(stdev(one) / math.sqrt(3))
    assert (row[1]["trend"], row[2]["trend"]) == ("Hot", "Cold")
    joined = trends.with_trend(by_period, trends.topic_trend(by_period))
    assert joined.count() == 6 and {r["trend"] for r in joined.collect()} == {"Hot", "Cold"}


def test_one_period_has_no_trend(spark):
    mix = spark.createDataFrame([(1, 1970, [1.0])], "doc_id bigint, year int, weights array<double>")
    row = trends.topic_trend(trends.popularity_by_period(trends.popularity_by_year(mix, 1), "a")).first()
    assert row["avg_prop_change"] is None and row["se"] is None and row["trend"] is None


def test_trend_class_bounds(spark):
    df = spark.createDataFrame([(0.1,), (0.11,), (-0.1,), (-0.11,)], "c double")
    assert [r[0] for r in df.select(trends.trend_class(F.col("c"))).collect()] == ["Neutral", "Hot", "Neutral", "Cold"]


def test_publications(spark):
    papers = spark.createDataFrame([(1, 1970, 1), (2, 1970, 2), (3, 2000, 1), (4, 2022, 1)],
                                   "doc_id bigint, year int, dom_topic int")
    kept = corpus.up_to_year(papers)
    per_year = trends.pubs_per_year(kept)
    assert {tuple(r) for r in per_year.collect()} == {(1970, 2), (2000, 1)}
    assert {(r["period"], r["n"]) for r in trends.pubs_per_period(per_year, "a").collect()} == \
        {("1966-1975", 2), ("1996-2000", 1)}
    assert {(r["period"], r["dom_topic"], r["n"]) for r in trends.pubs_per_period_topic(kept, "b").collect()} == \
        {("1966-1976", 1, 1), ("1966-1976", 2, 1), ("1997-2001", 1, 1)}
    assert trends.pubs_per_year_topic(kept).count() == 3

"""Nearly equal titles, and lists and ranks with long ties."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest

from corpusloom.operators import distances, near_titles, ranking


def plain_near(titles, least):
    sets = {}
    for t in sorted({t for t in titles if t}):
        if words := frozenset(t.lower().split()):
            sets.setdefault(words, []).append(t)
    out = {(ts[0], t, 1.0) for ts in sets.values() for t in ts[1:]}
    items = [(w, ts[0]) for w, ts in sets.items()]
    for i, (v, a) in enumerate(items):
        for w, b in items[:i]:
            if (s := len(v & w) / len(v | w)) >= least:
                out.add((min(a, b), max(a, b), round(s, 9)))
    return out


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_near_titles(spark, least):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    titles = [" ".join(["common", *rng.sample(words, rng.randint(0, 12))]) for _ in range(150)]
    for t in rng.sample(titles, 80):
        parts = t.split()
        if len(parts) > 2:
            parts[rng.randrange(len(parts))] = rng.choice(words)
        titles += [" ".join(parts), " ".join(parts[::-1]).upper()]
    titles += [None, None, "", "  ", titles[0], titles[0]]
    papers = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, words int")
    rows = near_titles.near_titles(papers, least).collect()
    got = {(r.title_a, r.title_b, round(r.similarity, 9)) for r in rows}
    assert len(rows) == len(got) and got == plain_near(titles, least) and got


def test_near_titles_of_long_titles_join_a_few_numbers(spark):
    """A title of 400 words has 81 rare ones and partners of 320 words or more: the join
    holds no words and no row per size."""
    sets = spark.createDataFrame([(1, list(range(400)), 400)], "id long, tokens array<long>, size int")
    small, large = near_titles.prefix_rows(sets, 0.8)
    assert {t for _, t in small.dtypes + large.dtypes} <= {"bigint", "int"}
    assert small.count() == 81 and large.count() <= 3 * 81
    words = [f"w{i}" for i in range(1500)]
    titles = [" ".join(words), " ".join([*words[:-150], "x"]), " ".join(words[::2])]
    papers = spark.createDataFrame([(t,) for t in titles], "title string")
    rows = near_titles.near_titles(papers).collect()
    assert {(r.title_a, r.title_b, round(r.similarity, 9)) for r in rows} == plain_near(titles, 0.8) and len(rows) == 1


def test_near_titles_join_by_key(spark):
    papers = spark.createDataFrame([("a b", 1)], "title string, n int")
    out = io.StringIO()
    with redirect_stdout(out):
        near_titles.near_titles(papers).explain()
    assert "CartesianProduct" not in out.getvalue() and "NestedLoop" not in out.getvalue()


def test_one_tie_as_long_as_the_table(spark):
    rng = random.Random(2)
    rows = [(1, f"t{i:05d}", 0.5) for i in range(3000)] + [(2, "b", 0.5), (2, "a", 0.5), (2, "c", 0.7)]
    rng.shuffle(rows)
    terms = spark.createDataFrame(rows, "topic int, term string, beta double").repartition(5)
    words = {r.topic: r.top_topic_words for r in ranking.top_words(terms).collect()}
    assert words == {1: ", ".join(f"t{i:05d}" for i in range(3000)), 2: "c, a, b"}
    ranked = ranking.term_rank(terms)
    ranks = {(r.topic, r.term): r.term_rank for r in ranked.collect()}
    assert ranks == {(1, f"t{i:05d}"): 3000 - i for i in range(3000)} | {(2, "b"): 1, (2, "a"): 2, (2, "c"): 3}
    out = io.StringIO()
    with redirect_stdout(out):
        ranked.explain()
    windows = [line for line in out.getvalue().splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("_range" in line for line in windows)


def test_distances_send_one_row_per_task(spark):
    rng = np.random.default_rng(3)
    weights = rng.random((500, 30))
    nested = spark.createDataFrame([(w.tolist(),) for w in weights] + [(None,)], "weights array<double>").repartition(7)
    assert nested.select("weights").mapInArrow(distances._pair_sums, "apart array<double>, total array<double>").count() <= 7
    got = {(r.topic_a, r.topic_b): r.dist for r in distances.bray_curtis(nested).collect()}
    assert len(got) == 435
    for (a, b), dist in got.items():
        x, y = weights[:, a - 1], weights[:, b - 1]
        assert dist == pytest.approx(np.abs(x - y).sum() / (x + y).sum())
    assert distances.bray_curtis(nested.filter("weights is null")).collect() == []

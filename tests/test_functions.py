import math

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.arrays import count_items, let, sum_of
from corpusloom.functions.labels import has_label, mentions_label
from corpusloom.functions.mixtures import dominant, dominant_wide, posterior, topic_short_name
from corpusloom.functions.periods import period, period_ord
from corpusloom.functions import stemming
from corpusloom.functions.stemming import porter, stem_array, stem_word
from corpusloom.functions.text import mask_words, min_len, ngrams, no_digit, not_numeric, tokenize


def one(spark, column, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("Don't panic: it’s 3.14 or 1,000!", ["don't", "panic", "it’s", "3.14", "or", "1,000"]),
    ("see fig.2 and a.b", ["see", "fig", "2", "and", "a.b"]),
    ("snake_case _x_ __ ___", ["snake_case", "_x_"]),
    ("Ère naïve Straße", ["ère", "naïve", "straße"]),
    ("", []), ("... -- !", []),
])
def test_tokenize(spark, text, expected):
    assert one(spark, tokenize(F.col("x")), text) == expected


def test_tokenize_very_long_runs(spark):
    text = "a1" * 50_000 + " " + "x." * 30_000 + "x"
    assert [len(t) for t in one(spark, tokenize(F.col("x")), text)] == [100_000, 60_001]


def test_filters(spark):
    words = ["inf", "infinity", "nan", "12", "1e5", "0x1f", "3.5", "co2", "ab", "river"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    kept = lambda test: {r["w"] for r in df.filter(test).collect()}
    assert kept(not_numeric(w)) == {"nan", "co2", "ab", "river"}
    assert kept(min_len(w)) == set(words) - {"12", "ab"}
    assert kept(no_digit(w)) == {"inf", "infinity", "nan", "ab", "river"}


def test_mask_keeps_positions(spark):
    df = spark.createDataFrame([(["the", "o'er", "river", "7", "can't", "of", "inf", "co2s"],)], "t array<string>")
    assert df.select(mask_words("t", ["the", "can't"], ["o'er"]).alias("r")).first()["r"] == \
        [None, None, "river", None, None, None, None, None]
    assert df.select(mask_words("t", [], [], 2).alias("r")).first()["r"] == \
        ["the", "o'er", "river", None, "can't", "of", None, None]


def test_ngrams_are_neighbours_in_the_raw_text(spark):
    df = spark.createDataFrame([(["a", "b", None, "c", "d", "e"],), (["a"],), ([],)], "t array<string>")
    got = df.select(F.expr(ngrams("t", 2)).alias("r"), F.expr(ngrams("t", 3)).alias("s")).collect()
    assert [r["r"] for r in got] == [["a b", "c d", "d e"], [], []]
    assert [r["s"] for r in got] == [["c d e"], [], []]


def test_count_items(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), ([],)], "t array<string>")
    counts = df.select(F.expr(count_items("t")).alias("r"), F.expr(sum_of(count_items("t", 2), "n")).alias("s"))
    more = df.select(F.expr(count_items("t", 2)).alias("two"), F.expr(count_items("t", 3)).alias("three")).first()
    assert [tuple(x) for x in more["two"]] == [("a", 2), ("b", 3)] and [tuple(x) for x in more["three"]] == [("b", 3)]
    rows = counts.collect()
    assert [tuple(x) for x in rows[0]["r"]] == [("a", 2), ("b", 3), ("c", 1)]
    assert rows[0]["s"] == 5 and rows[1]["r"] == [] and rows[1]["s"] == 0


def test_let(spark):
    assert one(spark, F.expr(let("3", "v", "v * v"))) == 9


# stems of the published algorithm
@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"),
    ("species", "speci"), ("quality", "qualiti"), ("valley", "vallei"), ("erosion", "eros"),
    ("hyporheic", "hyporh"), ("concentration", "concentr"),
    ("macroinvertebrates", "macroinvertebr"), ("watershed", "watersh"),
    ("assemblages", "assemblag"), ("infiltration", "infiltr"), ("drainage", "drainag"),
    ("perennial", "perenni"), ("community", "commun"), ("influence", "influenc"),
    ("agreed", "agre"), ("feed", "feed"), ("plastered", "plaster"), ("bled", "bled"),
    ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
    ("sized", "size"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"),
    ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("conditional", "condit"), ("digitizer", "digit"), ("vietnamization", "vietnam"),
    ("operator", "oper"), ("feudalism", "feudal"), ("hopefulness", "hope"),
    ("sensibiliti", "sensibl"), ("electriciti", "electr"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("replacement", "replac"),
    ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"),
    ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("", ""), ("é", "é"),
])
def test_porter(word, stem):
    assert porter(word) == stem


def test_stem_udfs_keep_shape_and_nulls(spark):
    df = spark.createDataFrame(
        [(["ponies", None, "hopping"],), ([],), (None,), (["ponies"],)], "t array<string>"
    ).coalesce(1)
    assert [r["r"] for r in df.select(stem_array("t").alias("r")).collect()] == \
        [["poni", None, "hop"], [], None, ["poni"]]
    words = spark.createDataFrame([("rivers",), (None,)], "w string")
    assert {r["r"] for r in words.select(stem_word("w").alias("r")).collect()} == {"river", None}


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'é", max_size=15))
def test_porter_only_shortens_or_swaps_the_end(word):
    stem = porter(word)
    assert len(stem) <= len(word) + 1 and stem[: max(0, len(stem) - 4)] == word[: max(0, len(stem) - 4)]


@pytest.mark.parametrize("year,scheme,label,position", [
    (1960, "a", "1966-1975", 0), (1975, "a", "1966-1975", 0), (1976, "a", "1976-1980", 1),
    (2021, "a", "2016-2021", 9), (2022, "a", None, None),
    (1976, "b", "1966-1976", 0), (1977, "b", "1977-1981", 1), (2017, "b", "2017-2021", 9),
    (1994, "c", "1981-1994", 0), (2015, "c", "2015-2019", 5), (2020, "c", None, None),
    (1990, "d", "1981-1994", 0), (1995, "d", "1995", 1), (2014, "d", "2014", 20),
])
def test_periods(spark, year, scheme, label, position):
    row = spark.createDataFrame([(year,)], "y int").select(
        period(F.col("y"), scheme).alias("p"), period_ord(F.col("y"), scheme).alias("o")
    ).first()
    assert (row["p"], row["o"]) == (label, position)


def test_labels(spark):
    df = spark.createDataFrame([("Fish, Assessment",), ("Shellfish",), ("Fishes",), ("",), (None,)], "l string")
    rows = df.select(has_label(F.col("l"), F.lit("Fish")).alias("h"),
                     mentions_label(F.col("l"), "Fish").alias("m")).collect()
    assert [r["h"] for r in rows] == [True, False, False, False, False]
    assert [r["m"] for r in rows] == [True, False, True, False, False]


def test_dominant_first_maximum_wins(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5], 0.1, 0.5, 0.5)], "w array<double>, a double, b double, c double")
    row = df.select(dominant("w").alias("d"),
                    dominant_wide([F.col("a"), F.col("b"), F.col("c")]).alias("e")).first()
    assert (row["d"], row["e"]) == (2, 2)


def test_posterior(spark):
    df = spark.createDataFrame([([(1, 2), (2, 1), (1, 1)],)], "a array<struct<topic int, n bigint>>")
    got = df.select(posterior("a", 2, 25.0).alias("r")).first()["r"]
    assert got == [28 / 54, 26 / 54] and math.isclose(sum(got), 1.0)


def test_topic_short_name(spark):
    df = spark.createDataFrame([("7. Sediment load",), ("Plain",)], "n string")
    assert [r["r"] for r in df.select(topic_short_name(F.col("n")).alias("r")).collect()] == \
        ["Sediment load", None]


def test_stems_are_made_part_by_part(monkeypatch):
    seen = []
    real = stemming._stem_part
    monkeypatch.setattr(stemming, "PART", 3)
    monkeypatch.setattr(stemming, "_stem_part", lambda words: seen.append(len(words)) or real(words))
    words = ["fishing", None, "fished", "rivers", "fishing", "waters", None]
    got = stemming._stem_strings(pa.array(words, pa.string())).to_pylist()
    assert got == [w and porter(w) for w in words] and seen == [3, 3, 1]
    assert stemming._stem_strings(pa.array([], pa.string())).to_pylist() == []

"""Titles that are nearly equal: an exact set-similarity join.

Titles are sets of words, compared by Jaccard similarity. Of two sets that reach
it, each has a word among its rarest few (its prefix) that is in the other's too, their
sizes are close, and the places of that word leave room for enough common words. So
only titles that share a rare word, at sizes that fit, are ever brought together, and
the join's key holds a band of sizes as well, which splits frequent words.

Words and titles are numbered, so that the join's rows are a few numbers however long a
title is: a set meets the words of another only once the two are a candidate pair.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import tokenize
from corpusloom.operators import dtm
from corpusloom.session import cut_lineage

SLACK = 1e-9  # keeps rounding from raising a bound
TOKEN_BITS = 32  # of a word's number; its frequency stands above


def _band(size: Column, least: float) -> Column:
    """Bands of sizes: sets that may reach ``least`` are in one or in neighbours."""
    return F.floor(F.log(size.cast("double")) / F.lit(-log(min(least, 0.9)))).cast("int")


def _numbered_sets(classes: DataFrame) -> DataFrame:
    """id, size, tokens array<long>: words as numbers, the rarest first."""
    exploded = classes.select("id", F.explode("words").alias("term"))
    rarity = cut_lineage(exploded.groupBy("term").agg(F.count("*").alias("n")))
    token = F.shiftleft(F.col("n"), TOKEN_BITS).bitwiseOR(F.col("term_id").cast("long"))
    tokens = rarity.join(dtm.term_index(rarity), "term").select("term", token.alias("token"))
    return exploded.join(tokens, "term").groupBy("id").agg(
        F.sort_array(F.collect_list("token")).alias("tokens")).withColumn("size", F.size("tokens"))


def prefix_rows(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join, a few numbers a row: the smaller sets by their own band,
    the larger ones by every band that may hold a smaller partner (two or three)."""
    prefix = F.slice("tokens", 1, (F.col("size") - F.ceil(least * F.col("size") - SLACK) + 1).cast("int"))
    indexed = sets.select("id", "size", F.posexplode(prefix).alias("at", "token"))
    small = indexed.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "size", "at")], "token",
                           _band(F.col("size"), least).alias("band"))
    lowest = F.greatest(F.ceil(least * F.col("size") - SLACK), F.lit(1))
    bands = F.sequence(_band(lowest, least), _band(F.col("size"), least))
    large = indexed.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "size", "at")], "token", F.explode(bands).alias("band"))
    return small, large


def near_titles(papers: DataFrame, least: float = 0.8) -> DataFrame:
    """title_a < title_b, similarity of titles with similarity ``least`` or more.

    Titles of equal words are one class: its first title takes part in the pairs, and
    the others are paired with it alone. Missing titles and those without words have
    no partner.
    """
    words = F.array_sort(F.array_distinct(tokenize(F.col("title"))))
    titles = cut_lineage(papers.select("title").filter("title is not null").distinct().select(
        "title", words.alias("words")).filter(F.size("words") > 0))
    classes = cut_lineage(titles.groupBy("words").agg(F.min("title").alias("title")).withColumn(
        "id", F.monotonically_increasing_id()))
    members = titles.join(classes.select("words", F.col("title").alias("first")), "words").filter("title <> first").select(
        F.col("first").alias("title_a"), F.col("title").alias("title_b"), F.lit(1.0).alias("similarity"))

    sets = cut_lineage(_numbered_sets(classes))
    small, large = prefix_rows(sets, least)
    enough = F.ceil(F.lit(least / (1 + least)) * (F.col("a_size") + F.col("b_size")) - SLACK)
    # holds for a pair's first common word, by which the pair is found if at all
    room = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    fits = F.col("a_size") >= F.ceil(least * F.col("b_size") - SLACK)
    # sets of one size differ, so they have a word less in common than they hold
    one_size = (F.col("a_id") < F.col("b_id")) & (enough < F.col("a_size"))
    candidates = small.join(large, ["token", "band"]).filter(
        ((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & one_size)) & fits & (room >= enough)
    ).select("a_id", "b_id").distinct()

    def of(side: str, table: DataFrame, *columns: str) -> DataFrame:
        return table.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", *columns)])

    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    similarity = shared / (F.size("a_tokens") + F.size("b_tokens") - shared)
    pairs = candidates.join(of("a", sets, "tokens"), "a_id").join(of("b", sets, "tokens"), "b_id").select(
        "a_id", "b_id", similarity.alias("similarity")).filter(F.col("similarity") >= least)
    named = pairs.join(of("a", classes, "title"), "a_id").join(of("b", classes, "title"), "b_id").select(
        F.least("a_title", "b_title").alias("title_a"), F.greatest("a_title", "b_title").alias("title_b"), "similarity")
    return named.unionByName(members)

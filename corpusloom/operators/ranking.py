"""Top-n per group with ties, topic word lists, ordering columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage


def top_n_with_ties(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Rows whose value is among the group's n highest, all ties kept.

    First the n-th highest value of each group is found: row_number <= n lets
    every task drop all but n rows per group before the shuffle. Then rows are
    kept by comparing with that cut-off. There are few groups (topics), and a
    tie may be as long as the table (copies of one document), so rows of a
    group are never brought together.
    """
    by_value = Window.partitionBy(group).orderBy(F.desc(value))
    cutoff = (
        df.select(group, value)
        .withColumn("_place", F.row_number().over(by_value))
        .filter(F.col("_place") <= n)
        .groupBy(group).agg(F.min(value).alias("_cutoff"))
    )
    # one row per topic
    return df.join(F.broadcast(cutoff), group).filter(F.col(value) >= F.col("_cutoff")).drop("_cutoff")


def top_terms(beta: DataFrame, n: int = 20) -> DataFrame:
    """topic, term, beta of the n most probable terms per topic."""
    return top_n_with_ties(beta, "topic", "beta", n).select("topic", "term", "beta")


def top_docs(gamma: DataFrame, n: int = 20) -> DataFrame:
    """The n documents with most of each topic; other columns ride along."""
    return top_n_with_ties(gamma, "topic", "gamma", n)


def ordered(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Topic by topic, highest value first."""
    return df.orderBy("topic", F.desc(value), tie)


def _in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in ranges of that order, stored, with the number of their range
    (``_range``). A tie as long as the table is dealt out like any other rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def top_words(terms: DataFrame) -> DataFrame:
    """The top terms of each topic as one string, most probable first.

    Terms are joined range by range, then the ranges' strings, at most one per
    range and topic. The result holds all terms of a tie, so a topic's string is
    as long as they are, up to the 2 GB of a value.
    """
    ranged = _in_ranges(terms, F.col("topic"), F.desc("beta"), F.col("term"))
    per_range = ranged.groupBy("topic", "_range").agg(F.expr(
        "listagg(term, ', ') within group (order by beta desc, term)"
    ).alias("_words"))
    return per_range.groupBy("topic").agg(F.expr(
        "listagg(_words, ', ') within group (order by _range)"
    ).alias("top_topic_words"))


def term_rank(terms: DataFrame) -> DataFrame:
    """Place of each top term within its topic, lowest first (for charts): its
    place within its range and topic, behind the topic's rows in earlier ranges."""
    ranged = _in_ranges(terms, F.col("topic"), F.col("beta"), F.desc("term"))
    earlier = Window.partitionBy("topic").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and topic
    before = ranged.groupBy("topic", "_range").agg(F.count("*").alias("_n")).select(
        "topic", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("topic", "_range").orderBy("beta", F.desc("term"))
    numbered = ranged.withColumn("_place", F.row_number().over(within))
    return numbered.join(before, ["topic", "_range"]).withColumn(
        "term_rank", (F.col("_place") + F.col("_before")).cast("int")).select(*terms.columns, "term_rank")


def shared_top_terms(terms: DataFrame, min_topics: int = 1) -> DataFrame:
    """How many topics list a term: term, n."""
    return terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= min_topics)

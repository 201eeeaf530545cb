"""Token counts for every context limit from the exact length histogram.

Documents are aggregated by encoded length; sums over the histogram's suffix
then answer, for every limit that can make a difference, what a corpus holds
when documents are truncated there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokens import encoder
from corpusloom.session import cut_lineage, ship_package

SPAN = 4096  # lengths whose sums one task runs through


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``length`` of every whole text in tokens; null is 0."""

    def count(batches):
        encode = encoder(vocabulary).ids
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(encode(t.as_py())) // 4 for t in batch["text"]], pa.int64())], ["length"]
            )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length long")


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length, docs: counted within tasks before the shuffle."""
    return lengths(docs, vocabulary).groupBy("length").agg(F.count("*").alias("docs"))


def context_limits(counts: DataFrame) -> DataFrame:
    """One row per occurring length taken as a context limit: ``length``,
    ``docs`` of exactly that length, ``docs_up_to`` it, ``docs_longer``,
    ``quantile`` (share of documents up to it), ``tokens_up_to`` (tokens of
    documents that fit whole), ``tokens_longer``, ``tokens_truncated`` (all
    tokens left when every document is cut at the limit), ``tokens_total``.

    Prefix sums run within spans of lengths; the spans' totals (one row per
    ``SPAN`` lengths) carry over. An empty table gives no row.
    """
    spanned = counts.withColumn("span", F.floor(F.col("length") / SPAN)).withColumn(
        "tokens", F.col("length") * F.col("docs")
    )
    totals = spanned.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "span",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"),
        F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"),
    )
    inside = Window.partitionBy("span").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.col("d_before") + F.sum("docs").over(inside)
    tokens = F.col("t_before") + F.sum("tokens").over(inside)
    summed = spanned.join(totals, "span").select(
        "length", "docs", up_to.alias("docs_up_to"), tokens.alias("tokens_up_to"), "d_all", "t_all"
    )
    longer = F.col("d_all") - F.col("docs_up_to")
    return summed.select(
        "length", "docs", "docs_up_to", longer.alias("docs_longer"),
        (F.col("docs_up_to") / F.col("d_all")).alias("quantile"), "tokens_up_to",
        (F.col("t_all") - F.col("tokens_up_to")).alias("tokens_longer"),
        (F.col("tokens_up_to") + F.col("length") * longer).alias("tokens_truncated"),
        F.col("t_all").alias("tokens_total"),
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``context_limits`` of the documents' histogram. Takes ``text``; repeated
    rows count each, null texts count as empty, other columns do not matter."""
    ship_package(docs.sparkSession)
    return context_limits(cut_lineage(histogram(docs, vocabulary)))  # read twice, encoded once

"""Distances between topics, and research gaps.

Topics are compared over millions of terms or documents, but there are only
k(k-1)/2 pairs of them. Every task adds the pairs up over its rows, a batch at a
time, and hands over one row; nothing wide is ever built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_ROWS = 4096  # compared together


def _pair_sums(batches):
    """One row: for all pairs of topics in order the sums of |x - y| and x + y."""
    apart, total = None, None
    for batch in batches:
        lists = batch["weights"].drop_null()
        if not len(lists):
            continue
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        rows = flat.reshape(len(lists), -1)
        k = rows.shape[1]
        if apart is None:
            apart, total = np.zeros((k, k)), np.zeros(k)
        total += rows.sum(0)
        for at in range(0, len(rows), BATCH_ROWS):
            some = np.ascontiguousarray(rows[at:at + BATCH_ROWS].T)
            for i in range(k - 1):
                apart[i, i + 1:] += np.abs(some[i + 1:] - some[i]).sum(1)
    if apart is not None:
        upper = np.triu_indices(len(total), 1)
        sums = [apart[upper], (total[:, None] + total)[upper]]
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.list_(pa.float64())) for s in sums], ["apart", "total"])


def bray_curtis(nested: DataFrame) -> DataFrame:
    """Bray-Curtis dissimilarity sum|x-y| / sum(x+y): topic_a, topic_b, dist.

    Over topic terms this compares topics by vocabulary, over mixtures by the
    documents that hold them. All rows have equally many weights; rows without
    any take no part. Each task sends one row.
    """
    sums = nested.select("weights").mapInArrow(_pair_sums, "apart array<double>, total array<double>")
    k = "cast(round((1 + sqrt(1 + 8 * size(apart))) / 2) as int)"
    pair = "transform(sequence(a + 1, k), b -> named_struct('topic_a', a, 'topic_b', b))"
    of_task = sums.filter("size(apart) > 0").repartition(1).withColumn("k", F.expr(k)).select(
        F.expr(f"flatten(transform(sequence(1, k - 1), a -> {pair}))").alias("pair"), "apart", "total"
    )
    return of_task.select(F.inline(F.arrays_zip("pair", "apart", "total"))).groupBy("pair.topic_a", "pair.topic_b").agg(
        F.try_divide(F.sum("apart"), F.sum("total")).alias("dist")
    )


topic_dissimilarity = bray_curtis
topic_doc_dissimilarity = bray_curtis


def dist_range(dist: DataFrame) -> DataFrame:
    return dist.agg(F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"))


def minmax(dist: DataFrame) -> DataFrame:
    """Distances scaled to [0, 1] by their own range. The window spans the
    whole table, which is k(k-1)/2 rows, and spares working it out twice."""
    everything = Window.partitionBy()
    low, high = F.min("dist").over(everything), F.max("dist").over(everything)
    return dist.withColumn("dist", F.try_divide(F.col("dist") - low, high - low))


def research_gap(topic_dist: DataFrame, article_dist: DataFrame, scaled: bool = True) -> DataFrame:
    """Product of both distances per topic pair: topic_a, topic_b, gap."""
    if scaled:
        topic_dist, article_dist = minmax(topic_dist), minmax(article_dist)
    articles = article_dist.withColumnRenamed("dist", "article_dist")
    return topic_dist.join(articles, ["topic_a", "topic_b"]).select(
        "topic_a", "topic_b", (F.col("dist") * F.col("article_dist")).alias("gap")
    )

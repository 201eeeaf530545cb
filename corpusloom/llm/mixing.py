"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled order, up to ``repeats``
times over. A copy's virtual finish time is the source's cumulative words up to
and including it, divided by the source's target. Copies are taken in order of
finish time until the budget (all words) is spent; at virtual time 1 every
source has just reached its target. Virtual time is cut into equal slices, which
the targets fill evenly: slice totals find the slice where the budget ends, and
only that slice is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 11
SLICES = 8192
ROWS_PER_BUCKET = 2048
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words), and the two hashes that shuffle documents.
    They come from id and text, so reruns agree whatever the partitioning."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id")
    return docs.select(
        doc_id, F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), doc_id, text).alias("shuffle"),
        F.xxhash64(F.lit(seed + 1), text, doc_id).alias("tie"),
    )


def targets(measured: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: ``source``, ``source_rank`` (code point order, null
    last), ``source_size``, ``target``. Targets share the sum of all sizes by
    weight but stop at ``repeats`` times the source; the excess is shared again.

    The level that repeated sharing arrives at: with sources ordered by limit
    per weight, the largest of what the first sources' limits leave to the
    others per weight. Windows here run over one row per source.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    per_source = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    ranked = per_source.withColumn("source_rank", rank).withColumn(
        "weight", F.element_at(cycle, (F.col("source_rank") - 1) % len(weights) + 1).cast("double")
    ).withColumn("limit", F.col("source_size").cast("double") * repeats)
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank").rowsBetween(
        Window.unboundedPreceding, -1
    )

    def earlier(c: str) -> Column:
        return F.coalesce(F.sum(c).over(by_limit), F.lit(0.0))

    level = (F.sum("source_size").over(everything) - earlier("limit")) / (
        F.sum("weight").over(everything) - earlier("weight")
    )
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.select(
        "source", "source_rank", "source_size",
        F.least("limit", F.col("level") * F.col("weight")).alias("target"),
    )


def _join_sources(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """Join on ``source`` (null equals null) and further columns."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("source", *also)})
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in also:
        on &= F.col(c) == F.col(f"_{c}")
    return left.join(right, on).drop("_source", *[f"_{c}" for c in also])


def placed(docs: DataFrame, weights: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """Stored: every document with its source's target and ``done``, the
    source's words up to and including it in shuffled order."""
    measured = cut_lineage(sizes(docs, seed))
    buckets = max(1, -(-measured.count() // ROWS_PER_BUCKET))
    # the hash's high bits: buckets of one source hold equally many documents
    bucket = F.shiftright(F.shiftrightunsigned("shuffle", 33) * F.lit(buckets), 31)
    measured = measured.withColumn("bucket", bucket)
    totals = measured.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    totals = _join_sources(totals, targets(measured, weights, repeats))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "tie", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return cut_lineage(_join_sources(measured, totals, "bucket").withColumn(
        "done", F.col("before") + F.sum("size").over(inside)
    ).drop("bucket", "before"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS,
        seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, shuffle, tie.

    Takes ``doc_id``, ``text`` and ``source``; other columns do not matter. A
    null text has size 0 and is never taken; a null source is a source of its
    own. Repeated rows are documents each. An empty table gives no row.
    """
    rows = placed(docs, weights, repeats, seed)
    counted = (F.col("size") > 0) & (F.col("target") > 0)

    def finish(epoch: int | Column) -> Column:
        epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
        return F.when(counted, (epoch * F.col("source_size") + F.col("done")) / F.col("target"))

    def slice_of(time: Column) -> Column:
        return F.least(F.floor(time * slices), F.lit(4 * slices))

    copies = rows.filter(counted).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    ).withColumn("finish", finish(F.col("epoch"))).withColumn("slice", slice_of(F.col("finish")))
    budget = rows.agg(F.sum("size")).first()[0] or 0
    so_far = F.sum("words").over(Window.orderBy("slice"))
    crossing = copies.groupBy("slice").agg(F.sum("size").alias("words")).withColumn("so_far", so_far).filter(
        F.col("so_far") >= budget
    ).orderBy("slice").first()
    taken = F.lit(0)
    if crossing:
        order = Window.orderBy("finish", "source_rank")
        last = copies.filter(F.col("slice") == crossing["slice"]).withColumn(
            "so_far", F.sum("size").over(order) + (crossing.so_far - crossing.words)
        )
        cut = last.filter(F.col("so_far") > budget).orderBy("finish", "source_rank").select(
            "finish", "source_rank"
        ).first()
        for epoch in range(repeats):
            time = finish(epoch)
            within = slice_of(time) == crossing["slice"]
            if cut:
                within &= (time < cut.finish) | ((time == cut.finish) & (F.col("source_rank") < cut.source_rank))
            kept = (slice_of(time) < crossing["slice"]) | within
            taken = taken + F.when(kept, 1).otherwise(0)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * taken).cast("long").alias("taken"), taken.cast("int").alias("copies"), "shuffle", "tie",
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies.

    Rows equal in id, source and text share their copies evenly.
    """
    source = F.col("source").cast("string")
    shuffle = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string"))
    wide = docs.select(  # given columns may have any names
        F.struct("*").alias("given"), F.col("doc_id").alias("id"), source.alias("source"), shuffle.alias("shuffle"))
    chosen = mix(docs, weights, repeats, seed).filter("copies > 0").groupBy(
        F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("shuffle").alias("c_shuffle")
    ).agg(F.sum("copies").alias("c_copies"), F.count("*").alias("c_rows"))
    on = F.col("id").eqNullSafe(F.col("c_id")) & F.col("source").eqNullSafe(F.col("c_source")) & (
        F.col("shuffle") == F.col("c_shuffle")
    )
    nth = F.row_number().over(Window.partitionBy("id", "source", "shuffle").orderBy(F.lit(0)))
    share = F.floor(F.col("c_copies") / F.col("c_rows")) + F.when(
        nth <= F.col("c_copies") % F.col("c_rows"), 1
    ).otherwise(0)
    taken = wide.join(chosen, on).withColumn("copies", share.cast("int")).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("given.*")

"""Topic models: EM fits, posterior estimates from assignments, choice of k.

Two nested tables carry a model through the library:

- mixtures: doc_id, .., ``weights`` array<double>  (gamma, one row per document)
- topic terms: term, ``weights`` array<double>      (beta, one row per term)

Long forms (one row per topic) come from ``long_gamma`` / ``long_beta``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.constants import ALPHA_TOTAL, DELTA
from corpusloom.functions.arrays import let
from corpusloom.functions.mixtures import posterior
from corpusloom.operators import bundles, em_fit, streamed_fits
from corpusloom.operators.rows import unnest
from corpusloom.session import delete_folder


# --- fits -----------------------------------------------------------------------

def fit_lda(dtm: DataFrame, k: int, seed: int, max_iter: int = 20) -> em_fit.TopicFit:
    """Fit k topics by EM, whose default priors equal the usual 50/k and 0.1; the fit is
    that of MLlib's EM with this seed."""
    return em_fit.fit(dtm, k, seed, max_iter)


def stored_counts(model: em_fit.TopicFit) -> tuple[DataFrame, str]:
    """id, counts: topic counts of all terms (negative ids) and documents of a
    fit, written by the executors and read back as a table, so neither matrix
    ever exists on the driver; and the folder, for ``delete_folder``."""
    return model.counts(), model.path


def topic_terms(counts: DataFrame, k: int, index: DataFrame, delta: float = DELTA) -> DataFrame:
    """Topic-term probabilities of a fit (its ``stored_counts``): term, weights."""
    terms = counts.filter("id < 0").select((-F.col("id") - 1).cast("int").alias("term_id"), "counts")
    return _normalised_by_topic(terms.join(index, "term_id"), k, delta)


def _normalised_by_topic(counts: DataFrame, k: int, delta: float) -> DataFrame:
    """(n_tw + delta) / (n_t + V delta) for every topic of every term."""
    totals = counts.agg(F.struct(
        F.array(*[F.sum(F.col("counts")[t].cast("double")) for t in range(k)]).alias("n"),
        F.count("*").alias("terms"),
    )).scalar()
    return counts.withColumn("_totals", totals).select("term", F.transform(
        "counts",
        lambda n, t: (n.cast("double") + F.lit(delta))
        / (F.get(F.col("_totals.n"), t) + F.lit(delta) * F.col("_totals.terms")),
    ).alias("weights"))


def doc_topics(counts: DataFrame, k: int, dtm: DataFrame, alpha: float | None = None) -> DataFrame:
    """Document-topic probabilities of the fit itself: doc_id, weights.

    ``dtm`` is the stored matrix the model was fitted on. The fit numbers its
    documents by position in that table; the same scan gives the same numbers.
    A document whose topic counts do not add up to its terms stops the query.
    """
    alpha = ALPHA_TOTAL / k if alpha is None else alpha
    numbered = dtm.select(
        F.monotonically_increasing_id().alias("id"), "doc_id",  # the vector's own values: as an array it is as long as the vocabulary
        F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, x: a + x).alias("n"),
    )
    found = numbered.join(counts.filter("id >= 0"), "id", "left")
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    same = F.coalesce(F.abs(total - F.col("n")) <= 1e-6 * (F.col("n") + 1), F.col("n") == 0)
    weights = F.when(same, F.transform(
        F.coalesce("counts", F.array_repeat(F.lit(0.0), k)),
        lambda c: (c + F.lit(alpha)) / (F.col("n") + F.lit(k * alpha)),
    )).otherwise(F.raise_error(F.lit("a document's topic counts are not its own")))
    return found.select("doc_id", weights.alias("weights"))


# --- posterior from assignments ---------------------------------------------------

def assign_topics(terms: DataFrame, topic: Column) -> DataFrame:
    """``assigned`` array<struct<term, topic, n>> from ``unigrams``; ``topic``
    is an expression over ``term``."""
    return terms.select(
        "*",
        F.transform("unigrams", lambda u: F.struct(
            u["item"].alias("term"), topic(u["item"]).alias("topic"), u["n"].alias("n"),
        )).alias("assigned"),
    )


def nest_assignments(long: DataFrame) -> DataFrame:
    """One row per document from doc_id, term, topic, n rows."""
    return long.groupBy("doc_id").agg(
        F.collect_list(F.struct("term", "topic", "n")).alias("assigned")
    )


def posterior_gamma(assigned: DataFrame, k: int, alpha: float | None = None) -> DataFrame:
    """(n_dt + alpha) / (n_d + k alpha), inside the document's row."""
    alpha = ALPHA_TOTAL / k if alpha is None else alpha
    return assigned.withColumn("weights", posterior("assigned", k, alpha)).drop("assigned")


def posterior_beta(assigned: DataFrame, k: int, delta: float = DELTA) -> DataFrame:
    """(n_tw + delta) / (n_t + V delta): term, weights."""
    counts = (
        unnest(assigned, "assigned", "a").select("a.*")
        .groupBy("term").agg(F.array(*[
            F.sum(F.when(F.col("topic") == t, F.col("n")).otherwise(F.lit(0).cast("bigint")))
            for t in range(1, k + 1)
        ]).alias("counts"))
    )
    return _normalised_by_topic(counts, k, delta)


# --- long forms -------------------------------------------------------------------

def _long(nested: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return nested.select(*keys, F.posexplode_outer("weights").alias("topic", value)).withColumn(
        "topic", F.col("topic") + 1
    )


def long_gamma(mixtures: DataFrame, *keep: str) -> DataFrame:
    """doc_id, (kept columns), topic, gamma."""
    return _long(mixtures, ["doc_id", *keep], "gamma")


def long_beta(terms: DataFrame) -> DataFrame:
    """term, topic, beta."""
    return _long(terms, ["term"], "beta")


def nest_gamma(long: DataFrame, k: int) -> DataFrame:
    """doc_id, weights from doc_id, topic, gamma rows."""
    return long.groupBy("doc_id").agg(F.array(*[
        F.max(F.when(F.col("topic") == t, F.col("gamma"))) for t in range(1, k + 1)
    ]).alias("weights"))


def pivot_gamma(long: DataFrame, k: int) -> DataFrame:
    """Long gamma to one column per topic, t01..tkk."""
    wide = long.groupBy("doc_id").pivot("topic", list(range(1, k + 1))).agg(F.first("gamma"))
    return wide.withColumnsRenamed({str(t): schema.wide_name(t) for t in range(1, k + 1)})


def gamma_wide(mixtures: DataFrame, k: int, *keep: str) -> DataFrame:
    """Same from nested mixtures, without a shuffle; keeps paper columns."""
    return mixtures.select("doc_id", *keep, *[
        F.col("weights")[t - 1].alias(schema.wide_name(t)) for t in range(1, k + 1)
    ])


# --- number of topics -------------------------------------------------------------

def pair_divergence(weights: str) -> Column:
    """Sum over pairs of (x - y) (ln x - ln y) / 2 of one row's k weights. It is
    k sum(x ln x) - sum(x) sum(ln x), so no pair is formed."""
    of = "aggregate(w, 0D, (a, x) -> a + {})"
    return F.expr(let(weights, "w", f"""0.5D * (size(w) * {of.format('x * ln(x)')}
        - {of.format('x')} * {of.format('ln(x)')})"""))


def posterior_divergence(counts: DataFrame, ks: Sequence[int], delta: float = DELTA) -> DataFrame:
    """k, score of every k in one pass over term, key, n rows, where a term's
    topic under k is key mod k + 1. Each row is copied once per k and combined
    with its term's others before the shuffle; topic totals are one row per k."""
    most = max(ks)
    rows = counts.withColumn("k", F.explode(F.lit(list(ks)))).withColumn("topic", F.col("key") % F.col("k"))
    per_topic = [F.sum(F.when(F.col("topic") == t, F.col("n")).otherwise(F.lit(0).cast("bigint"))) for t in range(most)]
    nested = rows.groupBy("k", "term").agg(F.array(*per_topic).alias("counts"))
    totals = nested.groupBy("k").agg(
        F.array(*[F.sum(F.col("counts")[t]) for t in range(most)]).alias("totals"), F.count("*").alias("terms")
    )
    weights = f"""transform(slice(counts, 1, k), (n, t) ->
        (cast(n as double) + {float(delta)!r}D) / (get(totals, t) + {float(delta)!r}D * terms))"""
    return nested.join(F.broadcast(totals), "k").groupBy("k").agg(  # one row per k
        F.sum(pair_divergence(weights)).alias("total")
    ).select("k", (F.col("total") / (F.col("k") * (F.col("k") - 1)).cast("double")).alias("score"))


def topic_divergence(terms: DataFrame, k: int) -> DataFrame:
    """One row, ``score``: symmetric Kullback-Leibler divergence summed over
    topic pairs, divided by k (k - 1). Larger means more distinct topics."""
    return terms.agg((F.sum(pair_divergence("weights")) / F.lit(float(k * (k - 1)))).alias("score"))


def fit_divergence(spark: SparkSession, counts: dict[int, np.ndarray], delta: float = DELTA) -> DataFrame:
    """``table_divergence`` of fits that lie on the driver."""
    wide = np.hstack(list(counts.values()))
    return table_divergence(streamed_fits.counts_table(spark, wide), list(counts), wide.sum(0), len(wide), delta)


def table_divergence(wide: DataFrame, ks: Sequence[int], of_topics: Sequence[float], size: int, delta: float = DELTA) -> DataFrame:
    """k, score (``topic_divergence``) of fits that share their ``size`` terms, in one pass
    over one row per term with the counts of all of them, which sum up to ``of_topics``."""
    at, found = 0, []
    for k in ks:
        totals = ", ".join(f"{float(n) + delta * size!r}D" for n in of_topics[at:at + k])
        weights = f"transform(slice(counts, {at + 1}, {k}), (n, t) -> (n + {float(delta)!r}D) / get(array({totals}), t))"
        score = F.sum(pair_divergence(weights)) / F.lit(float(k * (k - 1)))
        found.append(F.struct(F.lit(k).cast("int").alias("k"), score.alias("score")))
        at += k
    return wide.agg(F.array(*found).alias("found")).select(F.inline("found"))


def topic_count_sweep(dtm: DataFrame, index: DataFrame, ks: Sequence[int], seed: int, max_iter: int = 20) -> DataFrame:
    """Fit every k over one stored matrix and score the topics: k, score. All fits
    share the scans of the matrix, and their scores one pass over the terms."""
    spark = dtm.sparkSession
    size, scores = index.count(), []
    for some, wide, path in streamed_fits.fit_tables(dtm, size, ks, seed, max_iter):
        of_topics = bundles.totals(spark.read.parquet(path))
        scores += [tuple(r) for r in table_divergence(wide, some, of_topics, size).collect()]
        delete_folder(spark, path)
    return spark.createDataFrame(scores, schema.SCORES)


def rank_topic_counts(scores: DataFrame) -> DataFrame:
    """Scores rescaled to [0, 1], and which k is best: k, score, scaled, is_best.
    One row per k, so a window over all of them is small."""
    everything = Window.partitionBy()
    low, high = F.min("score").over(everything), F.max("score").over(everything)
    best_first = Window.orderBy(F.desc("score"), "k")
    return scores.select(
        "k", "score",
        F.try_divide(F.col("score") - low, high - low).alias("scaled"),
        (F.row_number().over(best_first) == 1).alias("is_best"),
    )

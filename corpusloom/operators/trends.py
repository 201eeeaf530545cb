"""Publications and topic popularity over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import COLD_BELOW, HOT_ABOVE
from corpusloom.functions.periods import period, period_ord


# --- publications -----------------------------------------------------------------

def pubs_per_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy("year").agg(F.count("*").alias("n"))


def pubs_per_year_topic(dom: DataFrame) -> DataFrame:
    return dom.groupBy("year", "dom_topic").agg(F.count("*").alias("n"))


def pubs_per_period(per_year: DataFrame, scheme: str) -> DataFrame:
    """Yearly counts (year, n) summed per period; years past the last period
    belong to none and are left out."""
    return _bucketed(per_year, scheme).groupBy("period", "period_ord").agg(F.sum("n").alias("n"))


def pubs_per_period_topic(dom: DataFrame, scheme: str) -> DataFrame:
    """Documents per period and dominant topic."""
    return _bucketed(dom, scheme).groupBy("period", "period_ord", "dom_topic").agg(
        F.count("*").alias("n")
    )


def _bucketed(df: DataFrame, scheme: str) -> DataFrame:
    return df.withColumns({
        "period": period(F.col("year"), scheme),
        "period_ord": period_ord(F.col("year"), scheme),
    }).filter(F.col("period").isNotNull())


# --- popularity -------------------------------------------------------------------

def popularity_by_year(mixtures: DataFrame, k: int) -> DataFrame:
    """Total weight and number of documents: year, topic, total_gamma, n_doc.

    The k sums travel as one row per year and task; they become rows last.
    """
    per_year = mixtures.groupBy("year").agg(
        F.array(*[F.sum(F.col("weights")[t]) for t in range(k)]).alias("sums"),
        F.count("*").alias("n_doc"),
    )
    return per_year.select("year", "n_doc", F.posexplode("sums").alias("topic", "total_gamma")) \
        .withColumn("topic", F.col("topic") + 1)


def popularity_share(popularity: DataFrame) -> DataFrame:
    """Mean weight per year and topic."""
    return popularity.select(
        "year", "topic", (F.col("total_gamma") / F.col("n_doc")).alias("prop")
    )


def popularity_by_period(popularity: DataFrame, scheme: str) -> DataFrame:
    """Mean weight per period: period, period_ord, topic, prop."""
    return _bucketed(popularity, scheme).groupBy("period", "period_ord", "topic").agg(
        (F.sum("total_gamma") / F.sum("n_doc")).alias("prop")
    )


def trend_class(change: Column) -> Column:
    """Hot, Cold or Neutral; NULL without a change (a single period)."""
    return F.when(change > HOT_ABOVE, "Hot").when(change < COLD_BELOW, "Cold") \
        .when(change.isNotNull(), "Neutral")


def topic_trend(by_period: DataFrame) -> DataFrame:
    """Mean change of a topic's share between periods (in %), its standard
    error and class. Groups are one topic's periods, a handful of rows."""
    in_order = Window.partitionBy("topic").orderBy("period_ord")
    steps = by_period.withColumn("_step", F.col("prop") - F.lag("prop").over(in_order))
    trend = steps.groupBy("topic").agg(
        (F.avg("_step") * 100).alias("avg_prop_change"),
        (F.stddev_samp("prop") / F.sqrt(F.count("*").cast("double"))).alias("se"),
    )
    return trend.withColumn("trend", trend_class(F.col("avg_prop_change")))


def with_trend(by_period: DataFrame, trend: DataFrame) -> DataFrame:
    """Popularity rows with the change and class of their topic."""
    return by_period.join(trend.select("topic", "avg_prop_change", "trend"), "topic", "left")

"""Dominant topics and their agreement with expert labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions.labels import has_label, label_array, mentions_label
from corpusloom.functions.mixtures import dominant, dominant_wide
from corpusloom.operators.models import nest_gamma


# --- dominant topic ---------------------------------------------------------------

def dominant_topic(mixtures: DataFrame, *keep: str) -> DataFrame:
    """doc_id, (kept columns), dom_topic; no shuffle, the weights are one row."""
    return mixtures.select("doc_id", *keep, dominant("weights").alias("dom_topic"))


def dominant_topic_long(gamma: DataFrame, k: int) -> DataFrame:
    """Same from long gamma, gathered to one row per document first."""
    return dominant_topic(nest_gamma(gamma, k))


def dominant_topic_wide(wide: DataFrame, k: int, *keep: str) -> DataFrame:
    """Same from one column per topic."""
    columns = [F.col(schema.wide_name(t)) for t in range(1, k + 1)]
    return wide.select("doc_id", *keep, dominant_wide(columns).alias("dom_topic"))


def topic_size(dom: DataFrame) -> DataFrame:
    """Documents per dominant topic."""
    return dom.groupBy("dom_topic").agg(F.count("*").alias("n"))


def topic_size_named(sizes: DataFrame, names: DataFrame) -> DataFrame:
    """Every named topic with its size, 0 when no document is led by it."""
    return names.join(sizes, names["topic"] == sizes["dom_topic"], "left").select(
        "topic", "topic_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def with_topic_name(df: DataFrame, names: DataFrame, topic: str = "topic") -> DataFrame:
    """Add the topic's name; NULL when it has none."""
    named = names.select(F.col("topic").alias(topic), "topic_name")
    return df.join(named, topic, "left")


# --- labels -----------------------------------------------------------------------

def concordance(dom_named: DataFrame) -> DataFrame:
    """Per dominant topic: documents, those whose labels name it, their share.
    Input holds topic_name and labels."""
    hit = F.when(has_label(F.col("labels"), F.col("topic_name")), 1).otherwise(0)
    return dom_named.groupBy("topic_name").agg(
        F.count("*").alias("n"), F.sum(hit).alias("consist")
    ).withColumn("prop", F.col("consist") / F.col("n"))


def label_topic_crosstab(dom: DataFrame) -> DataFrame:
    """Documents per label and dominant topic: label, dom_topic, freq."""
    per_label = dom.select("dom_topic", F.explode(label_array(F.col("labels"))).alias("label"))
    return per_label.groupBy("label", "dom_topic").agg(F.count("*").alias("freq"))


def docs_with_label(papers: DataFrame, pattern: str) -> DataFrame:
    """Ids of documents with a label that matches the pattern."""
    return papers.filter(mentions_label(F.col("labels"), pattern)).select("doc_id")


def docs_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents in an id set."""
    return df.join(ids, "doc_id", "left_semi")


def label_combo_counts(papers: DataFrame) -> DataFrame:
    """Papers per label combination as written: all, and those with an abstract
    (NULL where there is none)."""
    kept = F.count(F.when(F.coalesce("abstract", F.lit("")) != "", 1))
    return papers.groupBy("labels").agg(
        F.count("*").alias("n_all"), F.nullif(kept, F.lit(0).cast("bigint")).alias("n_retained")
    )


def label_share(papers: DataFrame) -> DataFrame:
    """Share of papers that carry each label, among papers with an abstract
    (``retained``) and among all (``all``). Shares sum to more than 1.

    One pass: doc_id is unique and a row's labels are made distinct in place,
    so counting rows counts papers.
    """
    kept = F.coalesce(F.col("abstract"), F.lit("")) != ""
    totals = papers.agg(F.struct(
        F.count("*").alias("all"), F.count(F.when(kept, 1)).alias("retained")
    )).scalar()
    per_label = (
        papers.select(kept.alias("kept"),
                      F.explode(F.array_distinct(label_array(F.col("labels")))).alias("label"))
        .groupBy("label")
        .agg(F.count(F.when(F.col("kept"), 1)).alias("n_retained"), F.count("*").alias("n_all"))
    )
    return per_label.withColumn("_t", totals).select(
        "label", "n_retained", "n_all",
        F.try_divide(F.col("n_retained"), F.col("_t.retained")).alias("retained"),
        F.try_divide(F.col("n_all"), F.col("_t.all")).alias("all"),
    )


def share_joined(retained: DataFrame, total: DataFrame) -> DataFrame:
    """Two separate share tables (label, share) side by side."""
    return retained.withColumnRenamed("share", "retained").join(
        total.withColumnRenamed("share", "all"), "label", "left"
    )


def share_long(shares: DataFrame) -> DataFrame:
    """Retained and all shares below each other: label, group, prop."""
    return shares.select("label", "retained", "all").unpivot(
        "label", ["retained", "all"], "group", "prop"
    )


# --- generality -------------------------------------------------------------------

def topic_generality(mixtures: DataFrame) -> DataFrame:
    """Mean weight of each topic where it leads (ties included) and elsewhere:
    topic, selected_weight, unselected_weight."""
    rows = mixtures.select(
        F.array_max("weights").alias("_max"), F.posexplode_outer("weights").alias("topic", "gamma")
    )
    leads: Column = F.col("gamma") >= F.col("_max")
    return rows.groupBy((F.col("topic") + 1).alias("topic")).agg(
        F.avg(F.when(leads, F.col("gamma"))).alias("selected_weight"),
        F.avg(F.when(~leads, F.col("gamma"))).alias("unselected_weight"),
    )

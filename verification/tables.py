"""Paper tables derived from the driver's tables.

``documents`` has no title, abstract, year or labels; they are derived from the
text and the id, the same way in Spark here and in SQL in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import EXPERT_LABELS
from corpusloom.functions.text import stop_words
from corpusloom.operators import models
from corpusloom.plans import study
from corpusloom.session import cut_lineage, ship_package

LANGUAGES = ("english", "french", "german", "spanish")


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, title, abstract, year, labels."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    partitions = spark.conf.get("spark.corpusloom.inputPartitions", None)  # the caller's choice
    if partitions:
        docs = docs.repartition(int(partitions), "doc_id")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    bits = F.col("doc_id") % 15 + 1
    labels = [
        F.when(bits.bitwiseAND(F.lit(1 << i)) > 0, name) for i, name in enumerate(EXPERT_LABELS)
    ]
    return docs.select(
        "doc_id", "lang", title.alias("title"),
        F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("abstract"),
        (F.lit(1966) + F.col("doc_id") % 57).cast("int").alias("year"),
        F.concat_ws(", ", *labels).alias("labels"),
    )


def lexicon() -> tuple[str, ...]:
    return stop_words(*LANGUAGES)


def words(spark: SparkSession, sf: str, stem: bool = False) -> DataFrame:
    """Filtered words of every document, by position."""
    from corpusloom.operators.terms import with_words

    return with_words(study.documents(papers(spark, sf)), lexicon(), stem=stem)


def document_terms(spark: SparkSession, sf: str, *keep: str, stem: bool = False) -> DataFrame:
    return study.document_terms(papers(spark, sf), lexicon(), *keep, stem=stem)


def stored_terms(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Repeated words per document, written once for queries that read them
    several times."""
    return cut_lineage(
        document_terms(spark, sf, *keep).select("doc_id", *keep, "unigrams", "length")
    )


def assigned(spark: SparkSession, sf: str, k: int, *keep: str,
             per_doc: DataFrame | None = None) -> DataFrame:
    """Deterministic topic assignments in place of a sampler's: they follow from
    term and document, so every engine agrees on them."""

    def topic(term: Column) -> Column:
        return (topic_key(term) % k + 1).cast("int")

    if per_doc is None:
        per_doc = document_terms(spark, sf, *keep)
    return models.assign_topics(per_doc, topic)


def topic_key(term: Column) -> Column:
    return F.length(term) + 7 * F.ascii(term) + F.col("doc_id")


def mixtures(spark: SparkSession, sf: str, k: int, *keep: str,
             per_doc: DataFrame | None = None) -> DataFrame:
    gamma = models.posterior_gamma(assigned(spark, sf, k, *keep, per_doc=per_doc), k)
    return gamma.select("doc_id", *keep, "weights")


def beta(spark: SparkSession, sf: str, k: int, per_doc: DataFrame | None = None) -> DataFrame:
    return models.posterior_beta(assigned(spark, sf, k, per_doc=per_doc), k)


def topic_names(spark: SparkSession, k: int) -> DataFrame:
    """topic, topic_name ("7. Topic 7"): one row per topic of the model."""
    return spark.range(1, k + 1).select(
        F.col("id").cast("int").alias("topic"),
        F.concat(F.col("id").cast("string"), F.lit(". Topic "), F.col("id").cast("string"))
        .alias("topic_name"),
    )


def expert_names(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(EXPERT_LABELS, start=1))
    return spark.createDataFrame(rows, "topic int, topic_name string")

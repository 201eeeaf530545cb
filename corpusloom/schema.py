"""Schemas of the tables that cross a boundary (files, operators)."""

from pyspark.sql import types as T

REVIEWED_PAPERS = T.StructType([
    T.StructField("labels", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("publication_year", T.StringType()),
])

RECENT_PAPERS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("year", T.IntegerType()),
])

TITLES = T.StructType([T.StructField("title", T.StringType())])

TOPIC_NAMES = T.StructType([
    T.StructField("topic", T.IntegerType()),
    T.StructField("topic_name", T.StringType()),
])

SCORES = T.StructType([
    T.StructField("k", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])


def gamma_wide(k: int, extra: T.StructType | None = None) -> T.StructType:
    """Schema of the wide document-topic export: doc_id, t01..tkk, paper columns."""
    fields = [T.StructField("doc_id", T.LongType())]
    fields += [T.StructField(wide_name(t), T.DoubleType()) for t in range(1, k + 1)]
    return T.StructType(fields + (list(extra) if extra else []))


def wide_name(topic: int) -> str:
    return f"t{topic:02d}"

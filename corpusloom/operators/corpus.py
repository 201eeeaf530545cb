"""Paper tables: filtering, cleaning, identity, merging of sources."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import CLEAN_RULES, LAST_FULL_YEAR


def with_abstract(papers: DataFrame) -> DataFrame:
    """Keep papers that have an abstract (neither NULL nor '')."""
    return papers.filter(F.coalesce(F.col("abstract"), F.lit("")) != "")


def clean_abstract(papers: DataFrame,
                   rules: Sequence[tuple[str, str]] = CLEAN_RULES) -> DataFrame:
    """Cut publisher boilerplate out of the abstract, rule after rule. A plain
    substring test spares the regular expression where it cannot match."""
    for needed, pattern in rules:
        text = F.col("abstract")
        papers = papers.withColumn("abstract", F.when(
            text.contains(needed), F.regexp_replace(text, pattern, "")
        ).otherwise(text))
    return papers


def with_text(papers: DataFrame) -> DataFrame:
    """Modelling text: title, a space, abstract."""
    return papers.withColumn("text", F.concat_ws(" ", "title", "abstract"))


def complete_cases(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def up_to_year(df: DataFrame, last: int = LAST_FULL_YEAR, year: str = "year") -> DataFrame:
    return df.filter(F.col(year) <= last)


def with_doc_id(papers: DataFrame, order_key: str, name: str = "doc_id",
                parts: int | None = None) -> DataFrame:
    """Number rows 1..N in the order of a unique numeric key.

    One global window would put all rows in one task. Quantiles of the key cut
    the table into even ranges instead; a row's number is its place within the
    range plus the size of the ranges before it. Only the cut points and one
    count per range are ever in one place.
    """
    spark = papers.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    probabilities = [i / parts for i in range(1, parts)]
    cuts = sorted(set(papers.approxQuantile(order_key, probabilities, min(0.01, 0.25 / parts))))
    # binary search; a double may round a long key, but never reorders keys
    ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_key", outputCol="_range")
    ranged = ranges.transform(papers.withColumn("_key", F.col(order_key).cast("double"))).drop("_key")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_range").orderBy(order_key)
    return (
        ranged.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), "_range")  # at most `parts` rows
        .withColumn(name, (F.col("_place") + F.col("_offset")).cast("bigint"))
        .drop("_range", "_place", "_offset")
    )


def stack(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, matched by column name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def _packed(order: Sequence[str]) -> Column:
    """One or two integer columns as one number that sorts the same way."""
    if len(order) == 1:
        return F.col(order[0])
    first, second = order
    shift = F.lit(Decimal(2**64))
    return F.col(first).cast("decimal(12,0)") * shift + F.col(second).cast("decimal(20,0)")


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key value, whole. ``order`` is one or two integer
    columns that identify a row.

    The minimum is pre-aggregated before the shuffle, so a key that holds a
    third of the table sends one row per task. It is kept as a single number,
    which hash aggregation can update in place. The rows themselves are then
    fetched by that unique number, which cannot be skewed.
    """
    first = df.groupBy(key).agg(F.min(_packed(order)).alias("_first")).select("_first")
    return df.join(first, _packed(order) == F.col("_first"), "left_semi")


def distinct_by_title(papers: DataFrame, order: Sequence[str] = ("source_ord", "doc_id")) -> DataFrame:
    """Drop later papers with a title seen before; missing titles count as one."""
    return first_per_key(papers, "title", order)


def match_titles(wanted: DataFrame, papers: DataFrame,
                 order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each wanted title its first paper; NULLs when there is none.

    Titles are matched with pre-aggregated row numbers first, so whole papers
    move once, by their unique number. Titles without a match get a key of
    their own each (and ``_hit`` false): as NULLs they would all meet in one task.
    """
    number = _packed(order)
    number_type = papers.select(number.alias("n")).schema["n"].dataType
    first = papers.groupBy("title").agg(F.min(number).alias("_first"))
    places = wanted.join(first, "title", "left").select(
        "title",
        F.coalesce("_first", F.xxhash64("title").cast(number_type)).alias("_first"),
        F.col("_first").isNotNull().alias("_hit"),
    )
    found = papers.withColumns({"_first": number, "_hit": F.lit(True)}).drop("title")
    return places.join(found, ["_first", "_hit"], "left").drop("_first", "_hit")


def merge_sources(reviewed: DataFrame, recent: DataFrame, wanted_titles: DataFrame) -> DataFrame:
    """Reviewed papers plus the wanted recent ones, one paper per title.

    Inputs hold doc_id, title, abstract, year. The first source wins a title.
    """
    new = complete_cases(match_titles(wanted_titles, recent))
    columns = ["source_ord", "doc_id", "title", "abstract", "year"]
    merged = stack(
        with_abstract(reviewed).withColumn("source_ord", F.lit(1)).select(columns),
        new.withColumn("source_ord", F.lit(2)).select(columns),
    )
    return distinct_by_title(merged)


def with_info(df: DataFrame, papers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join paper columns on doc_id. Both sides have one row (or k rows)
    per document, so the key spreads evenly; only the named columns are read."""
    return df.join(papers.select("doc_id", *columns), "doc_id", "left")

"""Paper lists, name lists and result tables as files.

CSV fields of paper lists hold line breaks. Their records are found by counting
quotes (``split_csv``), so a file is read by many tasks; short headed lists
(``read_csv``) are read by one task per file. Convert to Parquet once
(``write_table``) before heavy work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schema
from corpusloom.sources import split_csv

_CSV = {"multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def numbered_records(spark: SparkSession, path: str, width: int, pattern: str | None = None) -> DataFrame:
    """Records of headerless CSV files: source_file, source_row (in order),
    place (0 for the file's first record) and ``cells`` array<string> of ``width``,
    null where a record has fewer."""
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    parsed = F.from_csv("text", F.lit(cells.simpleString()[7:-1].replace(":", " ")), _CSV)
    rows = split_csv.records(spark, path, pattern).withColumn("record", parsed)
    return rows.select("source_file", "source_row", "place", F.array(*[F.col("record")[c] for c in cells.names]).alias("cells"))


def read_papers_csv(spark: SparkSession, path: str, columns: T.StructType = schema.REVIEWED_PAPERS,
                    skip_lines: int = 1) -> DataFrame:
    """Paper lists with ``skip_lines`` records (a banner) and a header above the
    papers, columns by position. What the first records hold does not matter."""
    rows = numbered_records(spark, path, len(columns)).filter(F.col("place") > skip_lines)
    named = [F.col("cells")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(columns)]
    return (
        rows.select(*named, "source_row")
        .withColumn("year", F.expr("try_cast(publication_year as int)"))
        .drop("publication_year")
    )


def read_csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """Headed CSV with a given schema (topic names, title lists, exports)."""
    return spark.read.schema(columns).option("header", True).options(**_CSV).csv(path)


def read_papers_glob(spark: SparkSession, folder: str, pattern: str = "*2014-2019.csv",
                     columns: T.StructType = schema.RECENT_PAPERS, width: int = 64) -> DataFrame:
    """All files of a folder that match, stacked; columns are picked by name in
    each file's own header, others are dropped. A file that lacks one stops the
    query. ``width`` bounds the columns of a file."""
    rows = numbered_records(spark, folder, width, pattern)
    headers = rows.filter("place = 0").select(
        "source_file", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("_header")
    )
    body = rows.filter("place > 0").join(headers, "source_file")

    def named(field: T.StructField) -> Column:
        place = F.array_position("_header", F.lit(field.name.lower()))
        missing = F.raise_error(F.concat(F.lit(f"no column {field.name} in "), F.col("source_file")))
        cell = F.when(place > 0, F.try_element_at("cells", place.cast("int"))).otherwise(missing)
        return cell.try_cast(field.dataType).alias(field.name)

    return body.select(*[named(f) for f in columns], "source_file", "source_row")


def read_papers(spark: SparkSession, path: str, fmt: str = "parquet",
                columns: T.StructType | None = None) -> DataFrame:
    """Paper table exported from a spreadsheet as Parquet or headed CSV."""
    if fmt == "csv":
        return read_csv(spark, path, columns or schema.RECENT_PAPERS)
    reader = spark.read.schema(columns) if columns else spark.read
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result; CSV gets a header and no row names."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)

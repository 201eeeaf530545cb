"""Records of CSV files whose fields hold line breaks, many tasks to a file.

Files are read by lines, which are split at any byte. Whether a line starts inside a
quoted field follows from the number of quotes before it in its file, so

1. every split counts its quotes and, for either case, the records that start in it;
2. sums over the splits of a file (one row each) tell every split how it starts and
   how many records come before;
3. every split cuts its lines into records. What it has of a record that goes over
   its edges is put together by a grouping of such pieces only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.memory import released, sliced

#: a record by the usual rule: quotes enclose whole fields and are doubled inside
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
RECORD = rf"{_FIELD}(?:,{_FIELD})*+\r?"
_RECORD = re.compile(RECORD)
ROW_BITS = 40  # of a row number; the file's number stands above
LINES = 1024  # handled together by a worker
WHOLE, LAST, FIRST = 0, 1, 2  # a record, its beginning in a split, what the next splits have of it


def _lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _empty(line: str) -> bool:
    return line in ("", "\r", "\ufeff")


def _counted(batches):
    """file, split, quotes, and the records that start if the split begins outside
    (even) or inside (odd) a quoted field."""
    now, quotes, starts = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"file": [now[0]], "split": [now[1]], "quotes": [quotes], "even": [starts[0]], "odd": [starts[1]]})

    for batch in sliced(batches, LINES):
        for file, split, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != now:
                if now:
                    yield row()
                now, quotes, starts = (file, split), 0, [0, 0]
            if not _empty(line):
                starts[quotes % 2] += 1
            quotes += line.count('"')
    if now:
        yield row()


def _cut(batches):
    """file, split, place, kind, text of the records and pieces of each split."""
    now, inside, place = None, False, 0
    kept: list[str] = []
    out: list[tuple] = []

    def flush(kind: int) -> None:
        nonlocal place
        text = "\n".join(kept)
        if kind != FIRST and not (kind == WHOLE and _empty(text)):
            out.append((*now, place, kind, checked(text, now[0]) if kind == WHOLE else text))
            place += 1
        elif kind == FIRST:
            out.append((*now, None, kind, text))
        kept.clear()

    def batch_of() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [(), (), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        names = ["file", "split", "place", "kind", "text"]
        batch = pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)
        out.clear()
        return batch

    first = False  # whether the lines kept belong to a record of an earlier split
    for batch in sliced(batches, LINES):
        for file, split, line, begins_inside, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != now:
                if kept:
                    flush(FIRST if first else LAST)
                now, inside, place = (file, split), begins_inside, before
                first = inside
            kept.append(line)
            if line.count('"') % 2:
                inside = not inside
            if not inside:
                flush(FIRST if first else WHOLE)
                first = False
        yield batch_of()
    if kept:
        flush(FIRST if first else LAST)
        yield batch_of()


def checked(text: str, file: str) -> str:
    if '"' in text and not _RECORD.fullmatch(text):
        raise ValueError(f"a quote inside an unquoted field in {file}: {text[:80]!r}; read it in one piece")
    return text


def records(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """source_file, source_row, place (from 0 in its file, without empty lines) and
    text of all CSV records; ``source_row`` orders all of them. Line breaks in fields
    become \\n, as in Spark's own reader.

    A quote inside an unquoted field stops the query: the rule would take it for the
    beginning of a quoted one.
    """
    lines = _lines(spark, path, pattern)
    counted = lines.mapInArrow(released(_counted), "file string, split long, quotes long, even long, odd long")
    in_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2 == 1)
    starts = F.sum(F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))).over(in_file)
    number = F.dense_rank().over(Window.orderBy("file")) - 1
    splits = splits.withColumn("before", F.shiftleft(number.cast("long"), ROW_BITS) + F.coalesce(starts, F.lit(0)))
    # one row per split of the input: as many as the scan has tasks
    dealt = lines.join(F.broadcast(splits.select("file", "split", "inside", "before")), ["file", "split"])
    cut = dealt.select("file", "split", "value", "inside", "before").mapInArrow(
        released(_cut), "file string, split long, place long, kind int, text string")
    pieces = cut.filter(F.col("kind") != WHOLE)
    # a piece belongs to the last record that began before it
    earlier = Window.partitionBy("file").orderBy("split", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    joined = pieces.withColumn("place", F.max("place").over(earlier)).groupBy("file", "place").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "\n").alias("text"))
    broken = F.concat(F.lit("a quote inside an unquoted field in "), "file", F.lit(": "), F.left("text", F.lit(80)))
    joined = joined.withColumn("text", F.when(F.col("text").rlike(f"^{RECORD}$"), F.col("text")).otherwise(F.raise_error(broken)))
    place = F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    text = F.when(place == 0, F.ltrim("text", F.lit("\ufeff"))).otherwise(F.col("text"))
    return cut.filter(F.col("kind") == WHOLE).select("file", "place", "text").unionByName(joined).select(
        F.col("file").alias("source_file"), F.col("place").alias("source_row"), place.alias("place"),
        F.replace(F.regexp_replace(text, "\r$", ""), F.lit("\r\n"), F.lit("\n")).alias("text"))

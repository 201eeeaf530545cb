"""Joins with frequent keys, and connected components built on them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import delete_folder, store

SHARE = 1024  # a key in more than one of so many rows is frequent: fewer than SHARE keys are


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (stored) with the one row of ``table`` (stored) that has their key,
    ``how`` inner or left.

    A key in more than 1/``SHARE`` of the rows, so one of fewer than ``SHARE``
    keys, meets its row by broadcast where the rows lie; the others are shuffled.
    """
    least = rows.count() // SHARE
    frequent = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key)
    hot = table.join(F.broadcast(frequent), key, "left_semi")
    by_broadcast = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, how)
    return by_broadcast.unionByName(rest)


def contracted(links: DataFrame) -> DataFrame:
    """u, v: the links (a, b) of each batch of rows as one star per component."""

    def contract(batches):
        for batch in batches:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = parent[up]
                    x = up
                return x

            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
            u, v = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return links.select("a", "b").mapInArrow(contract, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of the links
    (a, b), stored.

    Links are contracted where they lie. Unless that leaves stars already,
    alternating large-star and small-star steps move every link towards the
    smallest neighbour. A node that very many links share is the usual case (the
    root of a large component), so each step looks the smallest neighbour up by
    ``join_unique``. Stored tables go as soon as they are read.
    """
    spark = links.sparkSession
    edges, path = store(contracted(links))

    def replace(new: DataFrame, *old: str) -> tuple[DataFrame, str]:
        out = store(new)
        for folder in old:
            delete_folder(spark, folder)
        return out

    while True:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))
        )
        per_node = ends.groupBy("node").agg(
            F.min("to").alias("low"), F.max("to").alias("high"), F.bool_or(F.col("to").isNull()).alias("centre")
        )
        if per_node.filter("low < high or (centre and low is not null)").isEmpty():
            return replace(per_node.select("node", F.coalesce("low", "node").alias("root")), path)[0]
        both, both_path = replace(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), path)
        least, least_path = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large, large_path = replace(
            join_unique(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")),
            both_path, least_path,
        )
        least, least_path = store(large.groupBy("u").agg(F.min("v").alias("m")))
        small = join_unique(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        edges, path = replace(small, large_path, least_path)

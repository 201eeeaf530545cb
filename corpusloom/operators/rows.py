"""Array columns to rows, computing the array once.

For a plain ``explode`` the optimizer infers the filter ``size(array) > 0`` and
pushes it towards the scan, together with the whole expression behind the array;
a text pipeline would run twice, and the first time before any redistribution.
The outer form gives no such inference, and filters on columns a generator made
do not move below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, items: Column | str, name: str, *keep: str) -> DataFrame:
    """``keep`` columns and one row per array element; no row for empty arrays."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def evaluated_once(df: DataFrame, columns: dict[str, Column], keep_if: Column,
                   *keep: str) -> DataFrame:
    """``keep`` columns plus computed ones, rows filtered by a computed column.

    A filter on a projected column is pushed through the projection and takes a
    copy of the expression along. Here the columns come out of a generator over
    a one-row array, which holds them in place; ``keep_if`` is an expression
    over their names.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row))).filter(keep_if)

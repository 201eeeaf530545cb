"""Expressions over ", "-separated label strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_array(labels: Column) -> Column:
    """Labels of a row; an empty or missing string has none."""
    return F.when(F.coalesce(labels, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(labels, ", "))


def has_label(labels: Column, name: Column) -> Column:
    """Exact membership."""
    return F.array_contains(label_array(labels), name)


def mentions_label(labels: Column, pattern: str) -> Column:
    """Some label matches the pattern (substring search)."""
    return F.exists(label_array(labels), lambda x: x.rlike(pattern))

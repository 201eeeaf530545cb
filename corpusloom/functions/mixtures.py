"""Expressions over ``weights``: a document's (or term's) value per topic, as
one array of k doubles. Topic t sits at index t-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let, sum_of


def posterior(assigned: str, k: int, prior: float) -> Column:
    """Weights (n_t + prior) / (n + k prior) from a named column
    ``array<struct<topic, n, ..>>``."""
    of_topic = sum_of(f"filter({assigned}, x -> x.topic = t)", "n")
    counts = f"transform(sequence(1, {k}), t -> {of_topic})"
    prior_sql = f"{float(prior)!r}D"
    total = f"aggregate(c, 0L, (a, n) -> a + n) + {k} * {prior_sql}"
    return F.expr(let(counts, "c", let(total, "d", f"transform(c, n -> (n + {prior_sql}) / d)")))


def dominant(weights: str) -> Column:
    """Topic holding the first maximum of a named column, so the lowest id wins
    a tie."""
    return F.expr(let(weights, "w", "cast(array_position(w, array_max(w)) as int)"))


def dominant_wide(columns: list[Column]) -> Column:
    """Same over one column per topic."""
    return F.array_position(F.array(*columns), F.greatest(*columns)).cast("int")


def topic_short_name(name: Column) -> Column:
    """"7. Sediment" -> "Sediment"; NULL when there is no ". "."""
    return F.try_element_at(F.split(name, r"\. "), F.lit(2))

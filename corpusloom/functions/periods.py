"""Year buckets. Schemes are data (see ``constants``), this is the one rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import OPENING_PERIOD_D, PERIOD_SCHEMES


def period(year: Column, scheme: str) -> Column:
    """Period label of a year; NULL past the scheme's last year."""
    if scheme == "d":
        last, label = OPENING_PERIOD_D
        return F.when(year <= last, F.lit(label)).otherwise(year.cast("string"))
    return _first_bucket(year, [(last, F.lit(label)) for last, label in PERIOD_SCHEMES[scheme]])


def period_ord(year: Column, scheme: str) -> Column:
    """Position of the period within its scheme, for ordering."""
    if scheme == "d":
        last, _ = OPENING_PERIOD_D
        return F.greatest(year - last, F.lit(0)).cast("int")
    return _first_bucket(
        year, [(last, F.lit(i)) for i, (last, _) in enumerate(PERIOD_SCHEMES[scheme])]
    )


def _first_bucket(year: Column, buckets) -> Column:
    result = None
    for last, value in buckets:
        test = year <= last
        result = F.when(test, value) if result is None else result.when(test, value)
    return result

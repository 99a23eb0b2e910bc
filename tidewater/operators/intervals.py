"""Joins of days to spans of days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(spans: DataFrame, rows: DataFrame, on: list[str], after: str, upto: str, at: str, days: int) -> DataFrame:
    """Spans joined to the rows of their keys whose day `at` lies in (after, upto]; a null end of a span meets nothing.

    It is an equi-join on the keys and buckets of so many days: a row is in one bucket, a span in all that it touches, so
    that a pair meets once. `days` should be about a span's length. Other columns of the two sides have to differ.
    """
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit(date(1970, 1, 1))) / days)
    touched: Column = F.sequence(number(after), number(upto))
    cut = spans.where(F.col(after) < F.col(upto)).withColumn("_bucket", F.explode(touched))
    met = cut.join(rows.withColumn("_bucket", number(at)), [*on, "_bucket"])
    return met.where((F.col(at) > F.col(after)) & (F.col(at) <= F.col(upto))).drop("_bucket")

"""Running totals and extremes over all rows in one order, without a task that holds them all.

Rows are dealt into ranges of the order and written, so that the ranges stay as they are if a task runs
again. Each range works by itself; what the ranges before it hold together is one small row a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import stored

_RANGE = "__range"
#: How a range's result and that of the ranges before it are put together; nulls are left out.
_JOIN: dict[Callable, Callable[[Column, Column], Column]] = {
    F.sum: lambda own, before: F.coalesce(own + before, own, before),
    F.min: F.least,
    F.max: F.greatest,
}


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[Callable, str]], peers: bool = False) -> DataFrame:
    """df with a column for each of values: name to (F.sum, F.min or F.max, column), over all rows up to this one in the order.

    peers: rows that are equal in the order are taken together, and have the same result; else the order has to tell
    all rows apart. Rows that are equal in the order share a range, so their number is bounded by what a task can sort:
    aggregate a key with few values first. A column `__range` in df would clash.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    parts = rows.groupBy(_RANGE).agg(*[f(c).alias(name) for name, (f, c) in values.items()])
    until = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)  # a row for each range: as many as partitions
    before = parts.select(_RANGE, *[f(name).over(until).alias(f"__{name}") for name, (f, _) in values.items()])
    within = W.partitionBy(_RANGE).orderBy(*order)
    within = within.rangeBetween(W.unboundedPreceding, 0) if peers else within.rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[f(c).over(within).alias(name) for name, (f, c) in values.items()])
    joined = local.join(F.broadcast(before), _RANGE)
    return joined.select(*df.columns, *[_JOIN[f](F.col(name), F.col(f"__{name}")).alias(name) for name, (f, _) in values.items()])


def average_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """(by, value, name): the average rank, from 1, of each different value among the rows of its group; `by` may be empty.

    Values are counted first, so that many equal ones are one row. Rows with a null value have no rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    if by:
        below = F.sum("ties").over(W.partitionBy(*by).orderBy(value))
        return counts.select(*by, value, (below - (F.col("ties") - 1) / 2).alias(name))
    found = running(counts, [F.col(value)], {"upto": (F.sum, "ties")})
    return found.select(value, (F.col("upto") - (F.col("ties") - 1) / 2).alias(name))

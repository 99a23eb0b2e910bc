"""Trailing returns, quarter prices, cost basis and clone returns; bars are long, never one column a ticker."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quarter_end

HORIZONS = (63, 126, 252)


def trailing_returns(bars: DataFrame, least: int = 20, volume_bars: int = 20) -> DataFrame:
    """Returns at 63, 126 and 252 bars, last close and mean traded value; null where history is short."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    b = bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max(HORIZONS) + 1)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("close")))
    ret = lambda h: F.when(at(h + 1) > 0, at(1) / at(h + 1) - 1)
    out = b.groupBy("ticker").agg(F.count("*").alias("n"), at(1).alias("last"), *[ret(h).alias(f"ret_{h}") for h in HORIZONS], F.avg(F.when(F.col("k") <= volume_bars, F.col("close") * F.col("volume"))).alias("adv"))
    return out.where(F.col("n") >= least).drop("n")


def fund_returns(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """The variant of funds: a short history is measured from its first bar."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    b = bars.withColumn("k", F.row_number().over(w))
    last, first = F.max(F.when(F.col("k") == 1, F.col("close"))), F.max_by("close", "k")
    at = lambda h: F.coalesce(F.max(F.when(F.col("k") == h + 1, F.col("close"))), first)
    return b.groupBy("ticker").agg(*[F.when(at(h) > 0, last / at(h) - 1).alias(f"ret_{h}") for h in horizons])


def splits_of(bars: DataFrame) -> DataFrame:
    return bars.where("ratio > 0").select("ticker", F.col("date").alias("split_date"), "ratio")


def as_of_returns(bars: DataFrame, days=(7, 30)) -> DataFrame:
    """Change to the last close from the last one at or before so many days earlier."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    b = bars.join(last, "ticker")
    before = lambda n: F.max_by("close", F.when(F.col("date") <= F.date_sub("last_date", n), F.col("date")))
    return b.groupBy("ticker").agg(*[(F.max_by("close", "date") / before(n) - 1).alias(f"ret_{n}d") for n in days])


def ytd_return(bars: DataFrame, as_of: date) -> DataFrame:
    start = date(as_of.year, 1, 1)
    b = bars.where(F.col("date").between(F.lit(start), F.lit(as_of)))
    return b.groupBy("ticker").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("ytd"))


def calendar_universe(securities: DataFrame, held: DataFrame, floor: float = 1e10) -> DataFrame:
    """Large companies and held tickers, flagged, by size."""
    big = securities.where(F.col("market_cap") >= floor).select("ticker")
    all_ = big.union(held.select("ticker")).distinct()
    out = all_.join(securities.select("ticker", "market_cap"), "ticker", "left").join(held.select("ticker", F.lit(True).alias("held")).distinct(), "ticker", "left")
    return out.withColumn("held", F.coalesce("held", F.lit(False))).orderBy(F.desc_nulls_last("market_cap"), "ticker")


def next_event(events: DataFrame, as_of: date) -> DataFrame:
    """The earliest date from today on, else the latest before."""
    d = F.lit(as_of)
    return events.groupBy("ticker").agg(F.coalesce(F.min(F.when(F.col("date") >= d, F.col("date"))), F.max("date")).alias("next"))


def quarter_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted mean of (high + low + close) / 3 by ticker and quarter end; null without volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum(F.when(F.col("volume") > 0, F.col("volume")))
    return bars.groupBy("ticker", quarter_end(F.col("date")).alias("period")).agg(
        F.when(v > 0, F.sum(F.when(F.col("volume") > 0, typical * F.col("volume"))) / v).alias("vwap"), F.count_if(F.col("volume") > 0).alias("bars")
    )


def added_shares(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the shares added since the fund's previous appearance in the ticker."""
    w = Window.partitionBy("cik", "ticker").orderBy("period")
    return snapshots.withColumn("added", F.greatest(F.col("shares") - F.lag("shares", 1, 0).over(w), F.lit(0)))


def missing_vwap(added: DataFrame, cached: DataFrame) -> DataFrame:
    return added.where("added > 0").select("ticker", "period").distinct().join(cached, ["ticker", "period"], "left_anti")


def cost_basis(added: DataFrame, vwap: DataFrame) -> DataFrame:
    """Mean price of added shares in quarters that have one, for positions still held in the fund's latest row."""
    rows = added.join(vwap, ["ticker", "period"], "left").withColumn("priced", F.col("added") * F.when(F.col("vwap").isNotNull(), 1))
    out = rows.groupBy("cik", "ticker").agg(
        (F.sum(F.col("priced") * F.col("vwap")) / F.sum(F.when(F.col("priced") > 0, F.col("priced")))).alias("cost"), F.max_by("shares", "period").alias("shares"),
        F.min("period").alias("first_seen"), F.count_if(F.col("priced") > 0).alias("quarters"),
    )
    return out.where("shares > 0 AND quarters > 0")


def accumulations(added: DataFrame, vwap: DataFrame) -> DataFrame:
    """The priced quarters behind a position's cost, in order, with its total cost and shares bought; a position has a few dozen at most."""
    rows = added.where("added > 0").join(vwap.where("vwap IS NOT NULL"), ["ticker", "period"])
    paid = F.col("added") * F.col("vwap")
    one = F.struct("period", F.col("added").alias("delta_shares"), F.round("vwap", 4).alias("quarter_vwap"), F.round(paid, 2).alias("contribution_usd"))
    held = added.groupBy("cik", "ticker").agg(F.max_by("shares", "period").alias("shares"), F.max("period").alias("as_of")).where("shares > 0")
    bought = rows.groupBy("cik", "ticker").agg(F.sum(paid).alias("total_cost"), F.sum("added").alias("total_bought"), F.sort_array(F.collect_list(one)).alias("accumulations"))
    return bought.join(held, ["cik", "ticker"])


def clone_returns(snapshots: DataFrame, vwap: DataFrame, prices: DataFrame, back: int = 4, least: float = 0.6) -> DataFrame:
    """Return of holding each fund's positions of `back` periods ago, by value; null under 60 % coverage.

    A shorter history starts at its first period if it has at least 4 and 60 % of them. The entry
    is the quarter's price, else value per share times 1000 up to three times; each position's
    return is held within -90 % and +400 %.
    """
    w = Window.partitionBy("cik").orderBy(F.desc("period"))
    p = snapshots.select("cik", "period").distinct().withColumn("k", F.row_number().over(w) - 1)
    n = p.groupBy("cik").agg(F.max("k").alias("oldest"))
    start = n.select("cik", F.when(F.col("oldest") >= back, back).when((F.col("oldest") >= 4) & (F.col("oldest") >= least * back), F.col("oldest")).alias("k")).where("k IS NOT NULL")
    rows = snapshots.join(p.join(start, ["cik", "k"]), ["cik", "period"]).join(vwap.select("ticker", "period", "vwap"), ["ticker", "period"], "left").join(prices.select("ticker", "last"), "ticker", "left")
    mark = F.col("value_usd").cast("double") / F.when(F.col("shares") > 0, F.col("shares"))
    sane = lambda x: (x > 0.5) & (x < 100000)
    entry = F.when(F.col("vwap") > 0.5, F.col("vwap"))
    for scale in (1.0, 1e3, 1e6, 1e9):
        entry = F.coalesce(entry, F.when(sane(mark * scale), mark * scale))
    gain = F.least(F.greatest(F.col("last") / F.col("entry") - 1, F.lit(-0.9)), F.lit(4.0))
    rows = rows.withColumn("entry", entry).withColumn("gain", F.when((F.col("last") > 0.5) & F.col("entry").isNotNull(), gain))
    value = F.col("value_usd").cast("double")
    covered = F.sum(F.when(F.col("gain").isNotNull(), value))
    return rows.groupBy("cik").agg((covered / F.sum(value)).alias("coverage"), (F.sum(F.col("gain") * value) / covered).alias("gain")).select(
        "cik", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(F.col("coverage") >= least, F.col("gain")).alias("gain")
    )

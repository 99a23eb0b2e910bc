"""Month-end rotation among a few stocks, and average-cost ledgers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_ends(calendar: DataFrame) -> DataFrame:
    """The last trading day of each completed month: a later month has begun."""
    m = calendar.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"))
    return m.join(F.broadcast(m.agg(F.max("month").alias("open"))), F.col("month") < F.col("open")).select("date")


def horizon_returns(bars: DataFrame, ends: DataFrame, horizons=(3, 6, 12)) -> DataFrame:
    """Returns over so many month ends, by position among the ends that the ticker traded on."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars.join(F.broadcast(ends), "date", "left_semi")
    return b.select("ticker", "date", "close", *[(F.col("close") / F.lag("close", h).over(w) - 1).alias(f"r{h}") for h in horizons])


def monthly_picks(returns: DataFrame, core: list[str], horizons=(3, 6, 12)) -> DataFrame:
    """The best average rank on each month end.

    Ranks are within a horizon, best highest, ties share the lowest, missing ones are left out. Core
    tickers need all horizons, newcomers the shortest. Of equal averages the lower return over the
    longest horizon is taken, then the first ticker.
    """
    known = F.when(F.col("ticker").isin(core), F.expr(" AND ".join(f"r{h} IS NOT NULL" for h in horizons))).otherwise(F.col(f"r{horizons[0]}").isNotNull())
    r = returns.where(known)
    for h in horizons:
        w = Window.partitionBy("date", F.col(f"r{h}").isNull()).orderBy(f"r{h}")
        r = r.withColumn(f"k{h}", F.when(F.col(f"r{h}").isNotNull(), F.rank().over(w)))
    ranks = F.array_compact(F.array(*[F.col(f"k{h}").cast("double") for h in horizons]))
    r = r.withColumn("score", F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.size(ranks))
    w = Window.partitionBy("date").orderBy(F.desc("score"), F.asc_nulls_last(f"r{max(horizons)}"), "ticker")
    return r.withColumn("place", F.row_number().over(w))


def signals(picks: DataFrame, calendar: DataFrame, start: date, prior: int = 12) -> DataFrame:
    """Each month end's pick and the next trading day, from start on and after so many prior ends; live if there is no next day yet."""
    w = Window.orderBy("date")  # a row a trading day: a few thousand in all
    nxt = calendar.select("date", F.lead("date").over(w).alias("fill"))
    ends = picks.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("k"))
    best = picks.where("place = 1").select("date", "ticker", "score")
    out = best.join(ends, "date").join(nxt, "date").where((F.col("date") >= F.lit(start)) & (F.col("k") >= prior))
    return out.withColumn("status", F.when(F.col("fill").isNull(), "live").otherwise("backtest")).drop("k")


def sleeve_trades(signal: DataFrame, bars: DataFrame, capital: float) -> DataFrame:
    """Trades of a sleeve that holds the pick: picks are known, so runs of one pick are segments and proceeds a running product.

    It stops at the first signal that can't be filled.
    """
    w = Window.orderBy("date")
    px = bars.select("ticker", F.col("date").alias("fill"), "close")
    filled = signal.join(px, ["ticker", "fill"], "left").withColumn("bad", F.max(F.when(F.col("fill").isNull() | F.col("close").isNull(), 1).otherwise(0)).over(w)).where("bad = 0")
    turn = filled.withColumn("before", F.lag("ticker").over(w)).where("before IS NULL OR before <> ticker")
    turn = turn.withColumn("action", F.when(F.col("before").isNull(), "initial").otherwise("switch"))
    sold = bars.select(F.col("ticker").alias("before"), F.col("date").alias("fill"), F.col("close").alias("sold_at"))
    turn = turn.join(sold, ["before", "fill"], "left").withColumn("bought_at", F.lag("close").over(w))
    gain = F.sum(F.log(F.coalesce(F.col("sold_at") / F.col("bought_at"), F.lit(1.0)))).over(w)
    return turn.withColumn("capital", F.lit(capital) * F.exp(gain)).select("date", "fill", "action", "ticker", F.col("close").alias("price"), "capital", (F.col("capital") / F.col("close")).alias("shares"))


def equity(trades: DataFrame, bars: DataFrame, bench: DataFrame, core: list[str], days: DataFrame, capital: float) -> DataFrame:
    """Value on the days from the first buy on: sleeve, equal parts of the core, benchmark; days without all closes are skipped."""
    w = Window.orderBy("fill")
    spans = trades.select("ticker", "fill", "shares", F.lead("fill").over(w).alias("until"))
    first = trades.agg(F.min("fill").alias("first"))
    d = days.join(F.broadcast(first), F.col("date") >= F.col("first"))
    held = d.join(F.broadcast(spans), (F.col("date") >= F.col("fill")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    own = held.join(bars.select("ticker", "date", "close"), ["ticker", "date"]).select("date", "first", (F.col("shares") * F.col("close")).alias("sleeve"))
    start = bars.join(F.broadcast(first), F.col("date") == F.col("first")).where(F.col("ticker").isin(core)).select("ticker", F.col("close").alias("c0"))
    parts = bars.where(F.col("ticker").isin(core)).join(F.broadcast(start), "ticker").groupBy("date").agg(F.avg(F.col("close") / F.col("c0")).alias("core"), F.count("*").alias("n")).where(F.col("n") == len(core))
    b0 = bench.join(F.broadcast(first), F.col("date") == F.col("first")).select(F.col("close").alias("b0"))
    b = bench.crossJoin(F.broadcast(b0)).select("date", (F.col("close") / F.col("b0") * capital).alias("benchmark"))
    return own.join(parts.select("date", (F.col("core") * capital).alias("core")), "date").join(b, "date").drop("first")


def actual_position(ledger: DataFrame, dust: float = 1e-6) -> DataFrame:
    """Shares and cash put in by ticker; what is left of rounding is removed."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    out = ledger.groupBy("account", "ticker").agg(F.sum(sign * F.col("qty")).alias("qty"), F.sum(-sign * F.col("qty") * F.col("price")).alias("cash"))
    return out.withColumn("qty", F.when(F.abs("qty") < dust, 0).otherwise(F.col("qty")))


def proposed_orders(positions: DataFrame, pick: str, last: DataFrame, capital: float) -> DataFrame:
    """Orders that leave an account holding only the pick: sell all else, then put its cash, capital and what the sales bring, into the pick.

    Amounts are at the last close; a sale without one brings nothing, and under 1 of cash nothing is bought.
    """
    p = positions.join(last, "ticker", "left")
    amount = F.when((F.col("ticker") != pick) & (F.col("qty") > 0), F.col("qty") * F.coalesce("last", F.lit(0.0)))
    p = p.withColumn("amount", amount)
    sells = p.where("amount IS NOT NULL").select("account", F.lit("sell").alias("side"), "ticker", F.col("qty").cast("double").alias("shares"), "amount")
    cash = p.groupBy("account").agg((F.lit(capital) + F.sum("cash") + F.coalesce(F.sum("amount"), F.lit(0.0))).alias("amount")).where("amount >= 1")
    price = last.where((F.col("ticker") == pick) & (F.col("last") > 0))
    buys = cash.crossJoin(F.broadcast(price)).select("account", F.lit("buy").alias("side"), F.lit(pick).alias("ticker"), (F.col("amount") / F.col("last")).alias("shares"), "amount")
    return sells.unionByName(buys)


_SALES = "account {0}, ticker string, date date, id long, qty double, avg double, realized double, sold double, closes boolean"
_ORDER = ["account", "ticker", "date", "id", "side", "qty", "price"]


class _Walk:
    """One account's position in one ticker, trade by trade."""

    def __init__(self):
        self.held = self.avg = self.realized = 0.0

    def buy(self, qty: float, price: float) -> None:
        if self.held + qty:
            self.avg = (self.held * self.avg + qty * price) / (self.held + qty)
        self.held += qty

    def sell(self, qty: float, price: float) -> float:
        """What is sold of what is held."""
        sold = min(qty, self.held)
        self.realized += sold * (price - self.avg)
        self.held -= sold
        return sold


def average_cost(ledger: DataFrame) -> DataFrame:
    """A row for each counted sell and a closing row (closes) for each account and ticker, in order of (date, id).

    The average is a true recurrence: buys re-average, sells realise at most what is held, and those without a basis are
    skipped, as are trades without a quantity or a price. Trades are sorted within partitions of (account, ticker), and one
    pass carries a position from batch to batch, so an account may have any number of trades. Trades of one date and id
    are taken in the order of side, quantity and price.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = _SALES.format(ledger.schema["account"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        key, walk, last = None, None, None

        def closing():
            return (*key, *last, walk.held, walk.avg if walk.held > 0 else 0.0, walk.realized, 0.0, True)

        for batch in batches:
            out = []
            for account, ticker, day, number, side, qty, price in zip(*[batch.column(c).to_pylist() for c in _ORDER]):
                if walk is None or (account, ticker) != key:
                    if walk is not None:
                        out.append(closing())
                    key, walk = (account, ticker), _Walk()
                last = (day, number)
                if qty is None or price is None:
                    continue
                if side == "buy":
                    walk.buy(qty, price)
                elif walk.held > 0:
                    sold = walk.sell(qty, price)
                    out.append((*key, *last, walk.held, walk.avg, walk.realized, sold, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if walk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(closing(), schema)], schema=schema)

    trades = ledger.select("account", "ticker", "date", "id", "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    return trades.repartition("account", "ticker").sortWithinPartitions(*_ORDER).mapInArrow(run, ddl)


def account_summary(walked: DataFrame, prices: DataFrame) -> DataFrame:
    """Invested, value, unrealised and realised by account, and the share of sells that didn't lose."""
    last = walked.where("closes").join(F.broadcast(prices), "ticker", "left")
    own = F.when(F.col("qty") > 1e-6, 1)
    sums = last.groupBy("account").agg(
        F.coalesce(F.sum(own * F.col("qty") * F.col("avg")), F.lit(0.0)).alias("invested"), F.coalesce(F.sum(own * F.col("qty") * F.col("last")), F.lit(0.0)).alias("value"), F.sum("realized").alias("realized"))
    w = Window.partitionBy("account", "ticker").orderBy("date", "id")
    sells = walked.where("NOT closes").withColumn("gain", F.col("realized") - F.coalesce(F.lag("realized").over(w), F.lit(0.0)))
    wins = sells.groupBy("account").agg(F.count("*").alias("sells"), F.avg(F.when(F.col("gain") >= 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return sums.join(wins, "account", "left").withColumn("unrealized", F.col("value") - F.col("invested"))


def cash_summary(flows: DataFrame, values: DataFrame, fx: DataFrame) -> DataFrame:
    """Deposited, withdrawn and net; gain of the account's value at the rate over the net, and its percent."""
    c = flows.groupBy("account").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("deposited"), F.sum(F.when(F.col("amount") < 0, -F.col("amount"))).alias("withdrawn"), F.sum("amount").alias("net"))
    out = c.join(values, "account", "left").crossJoin(F.broadcast(fx.limit(1)))
    gain = F.col("value") * F.col("rate") - F.col("net")
    return out.select("account", F.coalesce("deposited", F.lit(0.0)).alias("deposited"), F.coalesce("withdrawn", F.lit(0.0)).alias("withdrawn"), "net", gain.alias("gain"), F.when(F.col("net") > 0, 100 * gain / F.col("net")).alias("pct"))

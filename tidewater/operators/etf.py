"""Fund flows from shares, assets and reports, windows over them, and the choice of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import within


def issuer_flows(daily: DataFrame) -> DataFrame:
    """Change of shares times the day's value; a series' first row has none."""
    w = Window.partitionBy("ticker").orderBy("date")
    return daily.withColumn("flow", (F.col("shares_out") - F.lag("shares_out").over(w)) * F.col("nav")).where("flow IS NOT NULL")


def solved_flows(snapshots: DataFrame) -> DataFrame:
    """Net assets less the previous ones grown by the period's monthly returns in percent; null without returns."""
    w = Window.partitionBy("ticker").orderBy("period")
    growth = F.aggregate("returns", F.lit(1.0), lambda a, r: a * (1 + r / 100))
    known = (F.size("returns") > 0) & ~F.exists("returns", lambda r: r.isNull())
    return snapshots.withColumn("flow", F.when(known, F.col("net_assets") - F.lag("net_assets").over(w) * growth))


def daily_window(flows: DataFrame, days: int) -> DataFrame:
    """Sum of flows over (latest - days, latest], anchored at the ticker's latest row."""
    last = flows.groupBy("ticker").agg(F.max("date").alias("latest"))
    inside = flows.join(last, "ticker").where(F.col("date") > F.date_sub("latest", days))
    return inside.groupBy("ticker").agg(F.sum("flow").alias("flow"), F.min("latest").alias("as_of"), F.datediff(F.max("latest"), F.min("date")).alias("span"))


def asset_window(daily: DataFrame, days: int) -> DataFrame:
    """Sum of assets not explained by price in the window; it needs a row before the window; bad rows are skipped."""
    w = Window.partitionBy("ticker").orderBy("date")
    good = daily.where("aum > 0 AND nav > 0")
    moved = good.select("*", (F.col("aum") - F.lag("aum").over(w) * F.col("nav") / F.lag("nav").over(w)).alias("flow"), F.max("date").over(Window.partitionBy("ticker")).alias("latest"), F.min("date").over(Window.partitionBy("ticker")).alias("earliest"))
    start = F.date_sub("latest", days)
    return moved.where((F.col("date") > start) & (F.col("earliest") <= start)).groupBy("ticker").agg(F.sum("flow").alias("flow"), F.min("latest").alias("as_of"))


def quarterly_window(quarters: DataFrame, dividends: DataFrame, n: int) -> DataFrame:
    """The last n periods' flows, each with the dividends in (start, end] on the shares before; any null makes null."""
    w = Window.partitionBy("ticker").orderBy("period")
    q = quarters.select("*", F.lag("period").over(w).alias("start"), F.lag("net_assets").over(w).alias("before"), F.lag("nav").over(w).alias("nav_before"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period"))).alias("k")).where(F.col("k") <= n)
    d = dividends.select("ticker", F.col("date").alias("paid_on"), "amount")
    spans = q.select("ticker", "start", "period")
    paid = within(spans, d, ["ticker"], "start", "period", "paid_on", 92).groupBy("ticker", "period").agg(F.sum("amount").alias("paid"))
    full = q.join(paid, ["ticker", "period"], "left").withColumn("flow", F.col("flow") + F.coalesce("paid", F.lit(0.0)) * F.col("before") / F.col("nav_before"))
    return full.groupBy("ticker").agg(F.when(F.count("flow") == F.count("*"), F.sum("flow")).alias("flow"), F.max("period").alias("as_of"))


def monthly_window(monthly: DataFrame, n: int) -> DataFrame:
    last = monthly.groupBy("ticker").agg(F.max("month_end").alias("latest"))
    inside = monthly.join(last, "ticker").where(F.col("month_end") > F.last_day(F.add_months("latest", -n)))
    return inside.groupBy("ticker").agg(F.sum("net").alias("flow"), F.min("latest").alias("as_of"))


def choose_source(daily: DataFrame, assets: DataFrame, quarterly: DataFrame, monthly: DataFrame, days: int) -> DataFrame:
    """Daily flows if they span the window, else those from assets, else the fresher of quarterly and monthly (for a month, monthly only)."""
    d = daily.select("ticker", F.when(F.col("span") >= days - 1, F.struct("flow", F.col("as_of"), F.lit("daily").alias("source"))).alias("d"))
    a = assets.select("ticker", F.struct("flow", "as_of", F.lit("assets").alias("source")).alias("a"))
    q = quarterly.where("flow IS NOT NULL").select("ticker", F.struct("flow", "as_of", F.lit("quarterly").alias("source")).alias("q"))
    m = monthly.where("flow IS NOT NULL").select("ticker", F.struct("flow", "as_of", F.lit("monthly").alias("source")).alias("m"))
    all_ = d.join(a, "ticker", "full_outer").join(q, "ticker", "full_outer").join(m, "ticker", "full_outer")
    slow = F.col("m") if days <= 30 else F.when(F.col("q.as_of") > F.col("m.as_of"), F.col("q")).otherwise(F.coalesce("m", "q"))
    return all_.withColumn("c", F.coalesce("d", "a", slow)).select("ticker", F.col("c.flow").alias("flow"), F.col("c.as_of").alias("as_of"), F.col("c.source").alias("source"))


def freshness(age: Column) -> Column:
    return F.when(age.isNull(), "none").when(age <= 7, "live").when(age <= 90, "quarterly").otherwise("bulk")


def reading(f1: Column, f3: Column, f6: Column, p1: Column, p3: Column, p6: Column, p12: Column) -> Column:
    """What flows (percent of assets) and price returns together say; the first rule that holds.

    f and p are those of the shortest horizon that has both.
    """
    both = lambda f, p: f.isNotNull() & p.isNotNull()
    f = F.when(both(f1, p1), f1).when(both(f3, p3), f3).when(both(f6, p6), f6)
    p = F.when(both(f1, p1), p1).when(both(f3, p3), p3).when(both(f6, p6), p6)
    nothing = F.coalesce(f1, f3, f6).isNull()
    return (
        F.when(nothing & F.coalesce(p1, p3, p6).isNull(), "no data").when((f1 > 1) & (f6 < -1), "rotated in").when((f1 < -1) & (f6 > 1), "rotated out")
        .when((p6 > 0.2) & (p3 > 0.1) & (f1 > 3), "crowded").when((p > 0.02) & (f > 1) & (p12 > 0.05), "leader").when((p > 0.02) & (f < -1), "distribution")
        .when((p < -0.02) & (f > 1), "accumulation").when((p < -0.02) & (f < -1), "capitulation").when((p > 0.02) & (f3 < f6 - 3) & (f3 < 2), "fading")
        .when(nothing, "no flow data").otherwise("neutral")
    )


def rotating(metrics: DataFrame, top: int = 8) -> DataFrame:
    """The so many funds that money turned to and from the most."""
    in_ = metrics.where("f1 > 2 AND f1 > f6").orderBy(F.desc("f1"), "ticker").limit(top).withColumn("way", F.lit("in"))
    out = metrics.where("f1 < -1.5 AND f1 < f6").orderBy("f1", "ticker").limit(top).withColumn("way", F.lit("out"))
    return in_.unionByName(out)


#: The order of themes.
THEMES = ("broad", "growth_long_duration", "cyclical", "defensive", "rate_sensitive")


def insight_picks(metrics: DataFrame) -> DataFrame:
    """(pick, ticker): the fund that leads each of six lists, if any; f are flows in percent of assets, p price returns.

    Ties go to the first ticker. Each list is one bounded sort.
    """
    lists = {
        "fresh inflow": ("f1 > 3", F.desc("f1")), "fresh outflow": ("f1 < -2", F.asc("f1")), "flipped in": ("f1 > 1 AND f6 < -1", F.asc("f6")), "flipped out": ("f1 < -1 AND f6 > 1", F.desc("f6")),
        "distribution": ("p1 > 0.03 AND f1 < -1", F.asc("f1")), "accumulation": ("p1 < -0.03 AND f1 > 1", F.desc("f1")),
    }
    found = [metrics.where(cond).orderBy(order, "ticker").limit(1).select(F.lit(pick).alias("pick"), "ticker") for pick, (cond, order) in lists.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def by_theme(metrics: DataFrame, themes: DataFrame) -> DataFrame:
    """Funds with their theme (ticker, theme), the theme's place among THEMES and the fund's in it: most money of the last month first, unknown last."""
    w = Window.partitionBy("theme").orderBy(F.desc_nulls_last("f1"), "ticker")
    at = F.array_position(F.array(*[F.lit(t) for t in THEMES]), F.col("theme"))
    return metrics.join(themes, "ticker").where(at > 0).select("theme", at.alias("group_place"), F.row_number().over(w).alias("place"), "ticker", "f1")

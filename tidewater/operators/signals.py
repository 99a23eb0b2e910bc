"""Confluence signals: position trajectories, insider clusters, activist stakes, scores, and what pages show of them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running
@dataclass(frozen=True)
class Rules:
    insider_days: int = 30
    stake_days: int = 90
    recent_days: int = 180
    cap_floor: float = 3e8
    score_floor: float = 4.0
    min_value: float | None = None
    min_growth: float | None = None


def trajectories(resolved: DataFrame, weights: DataFrame, as_of: date) -> DataFrame:
    """(cik, ticker, period, shares, filed) of tracked filers' rows filed by as_of."""
    rows = resolved.where((F.col("filed") <= F.lit(as_of)) & F.col("resolved").isNotNull()).join(weights.select("cik"), "cik", "left_semi")
    return rows.groupBy("cik", F.col("resolved").alias("ticker"), F.coalesce("period", "filed").alias("period")).agg(F.sum("shares").alias("shares"), F.max("filed").alias("filed"))


def latest_points(points: DataFrame) -> DataFrame:
    """Each trajectory's last point with the one before it, its first period, and their number."""
    w = Window.partitionBy("cik", "ticker").orderBy("period")
    all_ = Window.partitionBy("cik", "ticker")
    p = points.select("*", F.lag("shares").over(w).alias("prev"), F.count("*").over(all_).alias("n"), F.min("period").over(all_).alias("first"), F.max("period").over(all_).alias("last"))
    return p.where("period = last").select("cik", "ticker", "shares", "prev", "n", "first", "last", "filed")


def not_stale(latest: DataFrame, filings: DataFrame, as_of: date, rules: Rules) -> DataFrame:
    """Without trajectories that end before the filer's newest period, or too long ago; filings without rows count."""
    newest = filings.where(F.col("filed") <= F.lit(as_of)).groupBy("cik").agg(F.max("period").alias("newest"))
    kept = latest.join(newest, "cik", "left").where("newest IS NULL OR newest <= last")
    return kept.where(F.col("last") >= F.date_sub(F.lit(as_of), rules.recent_days)).drop("newest")


def moves(latest: DataFrame) -> DataFrame:
    """Add move: new with one point, velocity from twice the shares, add above 1.2 times; others and empty points are left out."""
    ratio = F.col("shares") / F.col("prev")
    move = (
        F.when(F.coalesce("shares", F.lit(0)) <= 0, None).when(F.col("n") == 1, "new").when(F.coalesce("prev", F.lit(0)) <= 0, None)
        .when(ratio >= 2.0, "velocity").when(ratio > 1.2, "add")
    )
    return latest.select("*", F.round(ratio, 1).alias("ratio"), move.alias("move")).where("move IS NOT NULL")


def starters(latest: DataFrame) -> DataFrame:
    """(ticker, cik): filers that first appear in the newest or second newest of all last periods."""
    tops = latest.select("last").distinct().orderBy(F.desc("last")).limit(2)
    return latest.join(tops.withColumnRenamed("last", "first"), "first", "left_semi").select("ticker", "cik").distinct()


def cross_quarter(latest: DataFrame) -> DataFrame:
    """(ticker, starters): how many filers begin in the newest two quarters."""
    return starters(latest).groupBy("ticker").agg(F.count("*").alias("starters"))


def insider_people(trades: DataFrame, as_of: date, rules: Rules) -> DataFrame:
    """One row a buyer and ticker in the window, with the first filter that excludes it.

    In order: neither officer nor director, all bought by plan, too little value (an unknown one
    never excludes), too little growth. A missing reporter is one member.
    """
    d = F.lit(as_of)
    t = trades.where((F.col("code") == "P") & F.col("date").between(F.date_sub(d, rules.insider_days), d) & (F.col("filed") <= d))
    t = t.withColumn("who", F.coalesce("reporter_cik", F.lit("")))
    lines = t.groupBy("ticker", "who", "direct").agg(F.max(F.col("owned_after") - F.col("shares")).alias("held"), F.count_if(F.col("owned_after").isNull()).alias("unknown"))
    held = lines.groupBy("ticker", "who").agg(F.sum("held").alias("held"), F.sum("unknown").alias("unknown"))
    people = t.groupBy("ticker", "who").agg(
        F.max("reporter").alias("name"), F.bool_or(F.col("is_officer") | F.col("is_director")).alias("inside"), F.count_if(~F.col("is_10b5_1").eqNullSafe(F.lit(True))).alias("free"),
        F.sum("value").alias("value"), F.sum("shares").alias("bought"), F.max("date").alias("latest"), F.count("*").alias("trades"),
    ).join(held, ["ticker", "who"])
    people = people.withColumn("growth", stake_growth(F.col("bought"), F.col("held"), F.col("unknown")))
    why = F.when(~F.coalesce("inside", F.lit(False)), "role").when(F.col("free") == 0, "plan")
    if rules.min_value is not None:
        why = why.when(F.col("value") < rules.min_value, "value")
    if rules.min_growth is not None:
        why = why.when(F.col("growth") < rules.min_growth, "growth")
    return people.withColumn("excluded", why)


def stake_growth(bought: Column, held: Column, unknown: Column) -> Column:
    """Bought over held before; infinite from nothing, null if any line is unknown."""
    return F.when(unknown > 0, None).when(held <= 0, F.lit(float("inf"))).otherwise(bought / held)


def insider_clusters(people: DataFrame) -> DataFrame:
    return people.where("excluded IS NULL").groupBy("ticker").agg(
        F.count("*").alias("buyers"), F.max("latest").alias("last_buy"), F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, 5), "; ").alias("names")
    )


def activists(stakes: DataFrame, weights: DataFrame, as_of: date, rules: Rules) -> DataFrame:
    """Initial 13D rows of tracked filers in the window, by ticker; rows count, not filers."""
    d = F.lit(as_of)
    t = stakes.where((F.col("subtype") == "13D") & F.col("filed").between(F.date_sub(d, rules.stake_days), d)).join(weights, "cik")
    return t.groupBy("ticker").agg(
        F.count("*").alias("stakes"), F.sum("weight").alias("stake_weight"), F.max("filed").alias("last_stake"),
        F.array_join(F.array_sort(F.collect_set("cik")), "; ").alias("filers"),
    )


def insider_points(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when(n == 1, 1.5).when(n == 2, 3.5).otherwise(7.0 + (n - 3))


def scores(moved: DataFrame, began: DataFrame, clusters: DataFrame, stakes: DataFrame, weights: DataFrame, securities: DataFrame, rules: Rules) -> DataFrame:
    """Confluence by ticker. Each source gives partial rows of one shape, and one grouping by ticker sums them.

    began: (ticker, cik) of `starters`. A position of twice the shares is an add too. kinds counts five types of evidence: two
    insiders or more, a new position or an add, an activist, velocity, and three starters or more.
    """
    zero = F.lit(0.0)
    cols = ["new", "add", "velocity", "n_moves", "n_velocity", "stake", "buyers", "starters", "start_weight"]

    def part(df, **values):
        return df.select("ticker", *[values.get(c, zero).cast("double").alias(c) for c in cols])

    m = moved.join(weights, "cik")
    of = lambda *kinds: F.when(F.col("move").isin(*kinds), F.col("weight")).otherwise(0.0)
    rows = part(m, new=of("new"), add=of("add", "velocity"), velocity=of("velocity"), n_moves=F.lit(1), n_velocity=(F.col("move") == "velocity").cast("int"))
    rows = rows.unionByName(part(stakes, stake=F.col("stake_weight"))).unionByName(part(clusters, buyers=F.col("buyers")))
    rows = rows.unionByName(part(began.join(weights, "cik"), starters=F.lit(1), start_weight=F.col("weight")))
    s = rows.groupBy("ticker").agg(*[F.sum(c).alias(c) for c in cols])
    cross = F.when(F.col("starters") >= 3, F.col("start_weight") * 1.5).otherwise(0.0)
    kinds = sum(F.when(c, 1).otherwise(0) for c in (F.col("buyers") >= 2, F.col("n_moves") > 0, F.col("stake") > 0, F.col("n_velocity") > 0, F.col("starters") >= 3))
    score = insider_points(F.col("buyers")) + F.col("new") * 2 + F.col("add") * 0.5 + F.col("velocity") * 2 + F.col("stake") * 5 + cross + F.when(kinds >= 3, 5.0).otherwise(0.0)
    big = securities.where(F.col("market_cap") >= rules.cap_floor).select("ticker")
    out = s.join(big, "ticker", "left_semi").select("*", kinds.alias("kinds"), F.round(score, 2).alias("score"))
    return out.where(F.col("score") >= rules.score_floor)


#: Why an insider isn't counted, in words.
REASONS = {"role": "not_officer_or_director", "plan": "10b5_1_plan", "value": "below_min_value", "growth": "stake_growth_below_min"}


def first_of(rows: DataFrame, most: int) -> DataFrame:
    """(ticker, kind, names) of rows (ticker, kind, name): the first so many different names in their order, as one text.

    A task keeps so many rows of a ticker and kind before it shuffles them, and no list is longer.
    """
    w = Window.partitionBy("ticker", "kind").orderBy("name")
    top = rows.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.groupBy("ticker", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "; ").alias("names"))


def score_report(scored: DataFrame, moved: DataFrame, stakes: DataFrame, people: DataFrame, trades: DataFrame, filers: DataFrame, as_of: date, rules: Rules) -> DataFrame:
    """Scores with who contributes to them, insiders left out and why, and the first and latest date of what counts.

    Up to five names of filers for each move and of insiders, up to three of activists. Dates are those of filing.
    """
    d, names = F.lit(as_of), filers.select("cik", "filer_name")
    named = lambda df: df.join(names, "cik", "left").withColumn("name", F.coalesce("filer_name", "cik"))
    m, t = named(moved), named(stakes.where((F.col("subtype") == "13D") & F.col("filed").between(F.date_sub(d, rules.stake_days), d)).join(filers.select("cik"), "cik", "left_semi"))
    ways = F.array_compact(F.array(F.when(F.col("move") == "velocity", F.lit("add")), F.col("move")))
    label = F.when(F.col("kind") == "velocity", F.concat("name", F.lit(" "), F.col("ratio").cast("string"))).otherwise(F.col("name"))
    rows = m.withColumn("kind", F.explode(ways)).select("ticker", "kind", label.alias("name"))
    rows = rows.unionByName(people.where("excluded IS NULL").select("ticker", F.lit("insiders").alias("kind"), "name"))
    reason = F.coalesce(*[F.when(F.col("excluded") == k, v) for k, v in REASONS.items()])
    rows = rows.unionByName(people.where("excluded IS NOT NULL").select("ticker", F.lit("excluded").alias("kind"), F.concat("name", F.lit(": "), reason).alias("name")))
    found = first_of(rows, 5).unionByName(first_of(t.select("ticker", F.lit("activists").alias("kind"), "name"), 3))
    kinds = ("new", "add", "velocity", "activists", "insiders", "excluded")
    wide = found.groupBy("ticker").agg(*[F.max(F.when(F.col("kind") == k, F.col("names"))).alias(f"{k}_by" if k in ("new", "add", "velocity") else k) for k in kinds])
    counted = trades.where((F.col("code") == "P") & F.col("date").between(F.date_sub(d, rules.insider_days), d) & (F.col("filed") <= d) & ~F.col("is_10b5_1").eqNullSafe(F.lit(True)))
    counted = counted.withColumn("who", F.coalesce("reporter_cik", F.lit(""))).join(people.where("excluded IS NULL").select("ticker", "who"), ["ticker", "who"], "left_semi")
    dates = m.select("ticker", "filed").unionByName(t.select("ticker", "filed")).unionByName(counted.select("ticker", "filed"))
    dates = dates.groupBy("ticker").agg(F.min("filed").alias("first_detected"), F.max("filed").alias("latest_signal"))
    return scored.select("ticker", "score", "kinds").join(wide, "ticker", "left").join(dates, "ticker", "left")


def score_page(report: DataFrame, least: float = 7.0, sort: str = "score") -> DataFrame:
    """Scores of at least so much, with their place by score, latest_signal or first_detected: the largest first, nulls last, then by score and ticker."""
    rows = report.where(F.col("score") >= least).withColumn("_one", F.lit(1))
    return running(rows, [F.col(sort).desc_nulls_last(), F.col("score").desc(), F.col("ticker")], {"place": (F.sum, "_one")}).drop("_one")


def extras(clusters: DataFrame, stakes: DataFrame) -> DataFrame:
    """Insiders and activists of each ticker that has either."""
    c, s = clusters.select("ticker", "buyers", "names"), stakes.select("ticker", "filers", "last_stake")
    return c.join(s, "ticker", "full_outer").select("ticker", F.coalesce("buyers", F.lit(0)).alias("buyers"), "names", "filers", "last_stake")


def enriched(scored: DataFrame, prices: DataFrame, top: int = 200) -> DataFrame:
    return scored.orderBy(F.desc("score"), "ticker").limit(top).join(prices, "ticker", "left")


def cluster_page(trades: DataFrame, as_of: date, days: int = 30, least: int = 3) -> DataFrame:
    """Issuers with at least so many distinct known buyers; most buyers, then value first."""
    d = F.lit(as_of)
    t = trades.where((F.col("code") == "P") & F.col("date").between(F.date_sub(d, days), d) & F.col("reporter_cik").isNotNull())
    people = t.groupBy("ticker", "reporter_cik").agg(F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.min("date").alias("first"), F.max("date").alias("last"), F.max("reporter").alias("name"))
    return people.groupBy("ticker").agg(
        F.count("*").alias("buyers"), F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"),
    ).where(F.col("buyers") >= least).orderBy(F.desc("buyers"), F.desc("value"), "ticker")


def notable_sales(trades: DataFrame, newest: int = 500, floor: float = 5e6, top: int = 30) -> DataFrame:
    """Large sales among the newest so many."""
    last = trades.where("code = 'S'").orderBy(F.desc("filed"), F.desc("accession")).limit(newest)
    return last.where(F.col("shares") * F.col("price") >= floor).orderBy(F.desc("filed"), F.desc("accession")).limit(top)


def filings_log(filings: DataFrame, trades: DataFrame, top: int = 50) -> DataFrame:
    """The newest filings (accession, form_type, filed, who), with the direction of an insider's."""
    codes = F.collect_set("code")
    d = trades.groupBy("accession").agg(
        F.when(F.array_contains(codes, "P") & F.array_contains(codes, "S"), "MIXED").when(F.array_contains(codes, "P"), "BUY").when(F.array_contains(codes, "S"), "SELL").alias("direction"),
        F.min("ticker").alias("ticker"),
    )
    last = filings.orderBy(F.desc("filed"), F.desc("accession")).limit(top)
    return last.join(d, "accession", "left")


def held_activity(held: DataFrame, trades: DataFrame, stakes: DataFrame, changes: DataFrame, scored: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """What insiders, activists and funds did lately in each held stock."""
    since = F.date_sub(F.lit(as_of), days)
    t = trades.join(held, "ticker", "left_semi").where((F.col("date") >= since) & (F.col("date") <= F.lit(as_of)))
    i = t.groupBy("ticker").agg(F.count_if(F.col("code") == "P").alias("buys"), F.count_if(F.col("code") == "S").alias("sells"), F.max(F.when(F.col("code").isin("P", "S"), F.col("date"))).alias("last_trade"))
    s = stakes.where((F.col("filed") >= since) & (F.col("filed") <= F.lit(as_of))).groupBy("ticker").agg(F.max("filed").alias("last_stake"))
    c = changes.where("lag = 1 AND pair_rank = 0").groupBy("ticker").agg(F.count_if(F.col("event").isin("opened", "added")).alias("adds"), F.count_if(F.col("event").isin("trimmed", "exited")).alias("trims"))
    out = held.join(i, "ticker", "left").join(s, "ticker", "left").join(c, "ticker", "left").join(scored.select("ticker", "score"), "ticker", "left")
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("buys", "sells", "adds", "trims")}
    out = out.select("ticker", *[v.alias(k) for k, v in zero.items()], "last_trade", "last_stake", "score")
    return out.withColumn("active", (F.col("buys") + F.col("sells") > 0) | F.col("last_stake").isNotNull()).withColumn("latest", F.greatest("last_trade", "last_stake"))


def dossier(trades: DataFrame, stakes: DataFrame, top: int = 6) -> DataFrame:
    """The latest so many buys, sells and stakes of each ticker, as numbered lines."""
    rows = trades.where("code IN ('P', 'S')").select("ticker", F.when(F.col("code") == "P", "buy").otherwise("sell").alias("kind"), F.col("date").alias("at"), F.concat_ws(" ", "reporter", "shares").alias("line"), F.col("accession").alias("id"))
    rows = rows.unionByName(stakes.select("ticker", F.lit("stake").alias("kind"), F.col("filed").alias("at"), F.concat_ws(" ", "cik", "subtype").alias("line"), F.col("filing_id").alias("id")))
    w = Window.partitionBy("ticker", "kind").orderBy(F.desc("at"), "id")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)


def stance(pct_6m: Column) -> Column:
    return F.when(pct_6m > 30, "ran hard").when(pct_6m < -10, "lagged").when(pct_6m.isNotNull(), "in between")


def signal_diff(old: DataFrame, new: DataFrame, causes: DataFrame, fields=("score", "kinds")) -> DataFrame:
    """Added, removed and changed tickers of two runs, the fields that changed, and the causes known for them."""
    a = old.select("ticker", *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(1).alias("in_old"))
    b = new.select("ticker", *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(1).alias("in_new"))
    both = a.join(b, "ticker", "full_outer")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.size(diff) > 0, "changed")
    why = causes.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("cause")), ",").alias("causes"))
    out = both.select("ticker", kind.alias("kind"), F.when(kind == "changed", F.array_join(diff, ",")).alias("fields")).where("kind IS NOT NULL")
    return out.join(why, "ticker", "left").withColumn("causes", F.coalesce("causes", F.lit("UNATTRIBUTED")))

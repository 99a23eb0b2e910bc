"""Event study around reports: trading-day positions, windows, paths, context and scores by season."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import season

PRE, DRIFT, PATH = 10, 20, 30


def dedupe_reports(reports: DataFrame, as_of: date, days: int = 25) -> DataFrame:
    """Per ticker the first report, and each later one more than so many days after the last kept; no future ones.

    Keeping depends on what was kept before, so each ticker's few dates are folded in order.
    """
    past = reports.where(F.col("date") <= F.lit(as_of)).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "session", "surprise"))).alias("all"))
    last = lambda acc: F.element_at(acc, -1)["date"]
    kept = F.aggregate("all", F.slice("all", 1, 1), lambda acc, r: F.when(F.datediff(r["date"], last(acc)) > days, F.concat(acc, F.array(r))).otherwise(acc))
    return past.select("ticker", F.explode(kept).alias("r")).select("ticker", "r.*")


def calendar(bench: DataFrame) -> DataFrame:
    """(date, idx): trading days in order; a row a day, so one small window."""
    return bench.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).cast("int").alias("idx"))


def closes_by_day(bench: DataFrame, cal: DataFrame) -> DataFrame:
    """(idx, close) of the benchmark; of repeated rows of a day the highest close counts."""
    return bench.join(cal, "date").groupBy("idx").agg(F.max("close").alias("close"))


def day_index(cal: DataFrame) -> DataFrame:
    """(day, idx): for every day the position of the first trading day not before it."""
    lead = cal.withColumn("prev", F.lag("date").over(Window.orderBy("date")))
    days = F.sequence(F.date_add(F.coalesce("prev", F.date_sub("date", 1)), 1), F.col("date"))
    return lead.select(F.explode(days).alias("day"), "idx")


def reaction_days(reports: DataFrame, cal: DataFrame) -> DataFrame:
    """Add ridx: the first trading day on which the report could act; null if there is none yet."""
    day = F.when(F.col("session") == "amc", F.date_add("date", 1)).otherwise(F.col("date"))
    return reports.withColumn("day", day).join(F.broadcast(day_index(cal).withColumnRenamed("idx", "ridx")), "day", "left").drop("day")


def indexed_bars(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Bars on the calendar's days, with positions and each bar's changes.

    Of repeated bars of one ticker and day the one with the largest volume counts, then that with the highest close, high,
    low and open: a corrected bar has more of the day's trades in it.
    """
    w = Window.partitionBy("ticker").orderBy("idx")
    again = Window.partitionBy("ticker").orderBy("idx", *[F.desc_nulls_last(c) for c in ("volume", "close", "high", "low", "open")])
    b = bars.join(F.broadcast(cal), "date").withColumn("_before", F.lag("idx").over(again)).where("_before IS NULL OR _before <> idx")
    prev = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("close").over(w))
    return b.select("ticker", "date", "idx", "open", "high", "low", "close", "volume", prev.alias("prev_close"))


def windows(reports: DataFrame, bars: DataFrame, back: int = 91, ahead: int = PATH) -> DataFrame:
    """Each report with a map from offset to bar, from one join on ticker and buckets of positions.

    A report goes to the one or two buckets that its window touches. Every measure below reads the map,
    so bars meet reports in one shuffle.
    """
    width = back + ahead + 1
    touched = F.sequence(F.floor((F.col("ridx") - back) / width), F.floor((F.col("ridx") + ahead) / width))
    r = reports.where("ridx IS NOT NULL").select("ticker", "date", "session", "surprise", "ridx", F.explode(touched).alias("bucket"))
    b = bars.select(F.col("ticker").alias("its"), "idx", F.floor(F.col("idx") / width).alias("at"), "close", "volume", "prev_close", "open", "high", "low")
    near = r.join(b, (r["ticker"] == b["its"]) & (F.col("bucket") == F.col("at")) & F.col("idx").between(F.col("ridx") - back, F.col("ridx") + ahead), "left").drop("its", "bucket", "at")
    bar = F.struct("close", "volume", "prev_close", "open", "high", "low")
    found = near.groupBy("ticker", "date", "session", "surprise", "ridx").agg(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct((F.col("idx") - F.col("ridx")).alias("k"), bar.alias("bar")))).alias("rows"))
    return found.withColumn("at", F.map_from_entries("rows")).drop("rows")


def close_at(k) -> Column:
    return F.try_element_at(F.col("at"), F.lit(k) if isinstance(k, int) else k)["close"]


def measures(win: DataFrame, bench: DataFrame, cal: DataFrame) -> DataFrame:
    """Returns before, on and after the reaction day, the benchmark's over the same days, and the excess."""
    b = closes_by_day(bench, cal)
    spans = {"pre": (-PRE - 1, -1), "react": (-1, 0), "drift": (0, DRIFT)}
    out = win
    for k in sorted({k for s in spans.values() for k in s}):
        side = b.select((F.col("idx") - k).alias("ridx"), F.col("close").alias(f"b_{k}".replace("-", "m")))
        out = out.join(F.broadcast(side), "ridx", "left")
    bench_at = lambda k: F.col(f"b_{k}".replace("-", "m"))
    cols = []
    for name, (a, z) in spans.items():
        own, mark = close_at(z) / close_at(a) - 1, bench_at(z) / bench_at(a) - 1
        cols += [own.alias(name), (own - mark).alias(f"{name}_excess")]
    status = F.when(close_at(-PRE - 1).isNull(), "excluded").when(close_at(0).isNull(), "reported").when(close_at(DRIFT).isNull(), "reacted").otherwise("complete")
    return out.select("ticker", "date", "session", "surprise", "ridx", "at", *cols, status.alias("status"))


def return_path(win: DataFrame) -> DataFrame:
    """Daily returns of days -30 to 30 times 100,000, null where a bar is missing."""
    day = lambda k: F.try_element_at(F.col("at"), k)
    one = lambda k: F.round((day(k)["close"] / day(k - 1)["close"] - 1) * 100000).cast("int")
    return win.withColumn("path", F.transform(F.sequence(F.lit(-PATH), F.lit(PATH)), one))


def volume_path(win: DataFrame, base: int = 60, least: int = 40) -> DataFrame:
    """Volume of days -30 to -1 as percent of the mean of the 60 days before; null with under 40 positive ones."""
    volume = lambda k: F.try_element_at(F.col("at"), k)["volume"].cast("double")
    before = F.filter(F.transform(F.sequence(F.lit(-PATH - base), F.lit(-PATH - 1)), volume), lambda v: v > 0)
    mean = F.aggregate(before, F.lit(0.0), lambda a, v: a + v) / F.size(before)
    path = F.transform(F.sequence(F.lit(-PATH), F.lit(-1)), lambda k: F.round(100 * volume(k) / mean).cast("int"))
    return win.withColumn("volume_path", F.when(F.size(before) >= least, path))


def average_gaps(bars: DataFrame, spans=(50, 200)) -> DataFrame:
    """Close against its moving averages; a window must be full and without missing days."""
    out = bars
    for n in spans:
        w = Window.partitionBy("ticker").orderBy("idx").rowsBetween(-(n - 1), 0)
        whole = (F.count("close").over(w) == n) & (F.min("idx").over(w) == F.col("idx") - (n - 1))
        out = out.withColumn(f"gap_{n}", F.when(whole, F.col("close") / F.avg("close").over(w) - 1))
    return out.select("ticker", "idx", *[f"gap_{n}" for n in spans])


def gap_range_path(win: DataFrame) -> DataFrame:
    """Opening gap and range of days -30 to -1 against the close before, times 100,000."""
    day = lambda k: F.try_element_at(F.col("at"), k)
    scaled = lambda x: F.round(x * 100000).cast("int")
    one = lambda k: F.struct(scaled(day(k)["open"] / day(k - 1)["close"] - 1).alias("gap"), scaled((day(k)["high"] - day(k)["low"]) / day(k - 1)["close"]).alias("range"))
    return win.withColumn("gap_range", F.transform(F.sequence(F.lit(-PATH), F.lit(-1)), one))


def _public_days(actions: DataFrame, cal: DataFrame) -> DataFrame:
    """Actions with idx, the trading day that they are public on; from 16:00 on that is a day later."""
    public = F.when(F.hour("ts") >= 16, F.date_add(F.col("ts").cast("date"), 1)).otherwise(F.col("ts").cast("date"))
    return actions.withColumn("day", public).join(F.broadcast(day_index(cal)), "day")


def _days_before(reports: DataFrame, days: DataFrame, back: int) -> DataFrame:
    """Reports (ticker, date, ridx) joined to the rows (ticker, idx) of the so many trading days before the reaction day."""
    a = days.withColumn("bucket", F.floor(F.col("idx") / back))
    touched = F.sequence(F.floor((F.col("ridx") - back) / back), F.floor((F.col("ridx") - 1) / back))
    r = reports.where("ridx IS NOT NULL").select("ticker", "date", "ridx", F.explode(touched).alias("bucket"))
    return r.join(a, ["ticker", "bucket"]).where(F.col("idx").between(F.col("ridx") - back, F.col("ridx") - 1))


def analyst_actions(reports: DataFrame, actions: DataFrame, cal: DataFrame, back: int = 63) -> DataFrame:
    """Actions public in the so many trading days up to the reaction day, as (k, code, pt); from 16:00 on they are public a day later."""
    near = _days_before(reports, _public_days(actions, cal).select("ticker", "idx", "code", "pt"), back)
    return near.groupBy("ticker", "date").agg(F.sort_array(F.collect_list(F.struct((F.col("idx") - F.col("ridx")).alias("k"), "code", "pt"))).alias("actions"))


def analyst_days(reports: DataFrame, actions: DataFrame, cal: DataFrame, back: int = 63) -> DataFrame:
    """The same actions summed by day, as (k, n, up, down, init, raised, lowered, moved, points), so that a report has an entry a day however many there are.

    Days are summed once, before they meet reports. moved counts the targets that aren't zero, points is their sum.
    """
    coded = [F.count_if(F.col("code") == c).alias(c) for c in ("up", "down", "init")]
    moved = F.col("pt").isNotNull() & (F.col("pt") != 0)
    sums = [F.count("*").alias("n"), *coded, F.count_if(F.col("pt") > 0).alias("raised"), F.count_if(F.col("pt") < 0).alias("lowered"), F.count_if(moved).alias("moved"), F.coalesce(F.sum(F.when(moved, F.col("pt").cast("double"))), F.lit(0.0)).alias("points")]
    daily = _public_days(actions, cal).groupBy("ticker", "idx").agg(*sums)
    entry = F.struct((F.col("idx") - F.col("ridx")).alias("k"), "n", "up", "down", "init", "raised", "lowered", "moved", "points")
    return _days_before(reports, daily, back).groupBy("ticker", "date").agg(F.sort_array(F.collect_list(entry)).alias("actions"))


def insider_context(reports: DataFrame, trades: DataFrame, days: int = 90) -> DataFrame:
    """Distinct buyers and value filed in [date - 90, date), each trade once.

    Trades go to the buckets of 90 days that a report can look back to, so the join is on (ticker, bucket).
    """
    day = lambda c: F.datediff(F.col(c), F.lit(date(1970, 1, 1)))
    t = trades.where("code = 'P'").withColumn("who", F.coalesce("reporter_cik", F.lit(""))).dropDuplicates(["accession", "who", "date", "shares"])
    t = t.select(F.col("ticker"), F.col("filed"), "who", "value", F.explode(F.array(F.floor(day("filed") / days), F.floor(day("filed") / days) + 1)).alias("bucket"))
    r = reports.select("ticker", F.col("date"), F.floor(day("date") / days).alias("bucket"))
    near = r.join(t, ["ticker", "bucket"], "left").where((F.col("filed") >= F.date_sub("date", days)) & (F.col("filed") < F.col("date")))
    people = near.groupBy("ticker", "date", "who").agg(F.sum("value").alias("value"))
    return people.groupBy("ticker", "date").agg(F.count("*").alias("buyers"), F.sum("value").alias("value"))


def size_tier(cap: Column) -> Column:
    return F.when(cap < 3e8, "micro").when(cap < 2e9, "small").when(cap < 1e10, "mid").when(cap < 2e11, "large").when(cap.isNotNull(), "mega")


def caps_at_report(win: DataFrame, securities: DataFrame, last: DataFrame) -> DataFrame:
    """The company's size the day before: today's scaled by the close."""
    out = win.join(F.broadcast(securities.select("ticker", "market_cap")), "ticker", "left").join(F.broadcast(last), "ticker", "left")
    out = out.withColumn("cap", F.col("market_cap") * close_at(-1) / F.col("last"))
    return out.withColumn("tier", size_tier(F.col("cap"))).drop("market_cap", "last")


def daily_returns(bench: DataFrame, since: date) -> DataFrame:
    w = Window.orderBy("date")
    return bench.select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where(F.col("date") >= F.lit(since))


def register(scheduled: DataFrame, logged: DataFrame, today: date, start: date, ahead: int = 7, apart: int = 20) -> DataFrame:
    """Scheduled reports of the coming days, none logged nearby; the first of those near each other in the batch."""
    s = scheduled.where(F.col("date").between(F.greatest(F.lit(today), F.lit(start)), F.date_add(F.lit(today), ahead)))
    known = logged.select("ticker", F.col("date").alias("other"), *_bucket("date", apart))
    near = s.select("ticker", "date", *_touched("date", apart)).join(known, ["ticker", "bucket"]).where(F.abs(F.datediff("date", "other")) <= apart)
    return s.join(near.select("ticker", "date").distinct(), ["ticker", "date"], "left_anti").groupBy("ticker").agg(F.min("date").alias("date"))


def _bucket(day: str, apart: int) -> list[Column]:
    return [F.floor(F.datediff(F.col(day), F.lit(date(1970, 1, 1))) / (2 * apart + 1)).alias("bucket")]


def _touched(day: str, apart: int) -> list[Column]:
    """The buckets that days within `apart` of a day can be in, a row each."""
    at = F.datediff(F.col(day), F.lit(date(1970, 1, 1)))
    return [F.explode(F.sequence(F.floor((at - apart) / (2 * apart + 1)), F.floor((at + apart) / (2 * apart + 1)))).alias("bucket")]


def match_reports(scheduled: DataFrame, reports: DataFrame, as_of: date, apart: int = 20, patience: int = 30) -> DataFrame:
    """Each scheduled date's nearest report within so many days; no_report once it is long past."""
    s, r = scheduled.select("ticker", "scheduled", *_touched("scheduled", apart)), reports.select("ticker", "date", *_bucket("date", apart))
    gap = F.abs(F.datediff("scheduled", "date"))
    found = s.join(r, ["ticker", "bucket"], "left").withColumn("date", F.when(gap <= apart, F.col("date")))
    m = found.groupBy("ticker", "scheduled").agg(F.min_by("date", F.when(F.col("date").isNotNull(), F.struct(gap, "date"))).alias("matched"))
    late = F.datediff(F.lit(as_of), "scheduled") > patience
    return m.withColumn("status", F.when(F.col("matched").isNotNull(), "reported").when(late, "no_report").otherwise("waiting"))


def late_flag(rows: DataFrame) -> DataFrame:
    """late: registered at or after 09:30 New York time of the reaction day."""
    t = F.from_utc_timestamp("registered", "America/New_York")
    opened = (F.to_date(t) > F.col("reaction")) | ((F.to_date(t) == F.col("reaction")) & (F.hour(t) * 60 + F.minute(t) >= 570))
    return rows.withColumn("origin", F.when(opened, "late").otherwise("live"))


def quantile_group(rank: Column, n: Column, groups: int = 5) -> Column:
    """The group of rank r of n as cutting ranks into equal-width intervals does; sizes differ from equal counts."""
    return F.greatest(F.lit(1), F.floor((groups * (rank - 1) + n - 2) / (n - 1)).cast("long"))


def season_scores(measured: DataFrame, least: int = 25) -> DataFrame:
    """Add season and quintile of the excess before the report, in seasons with enough events."""
    rows = measured.where("pre_excess IS NOT NULL AND react_excess IS NOT NULL").withColumn("season", season(F.col("date")))
    n = F.count("*").over(Window.partitionBy("season"))
    rank = F.row_number().over(Window.partitionBy("season").orderBy("pre_excess", "ticker", "date"))
    rows = rows.withColumn("n", n).withColumn("rank", rank).where(F.col("n") >= least)
    return rows.withColumn("quintile", quantile_group(F.col("rank"), F.col("n")))


def season_spreads(scored: DataFrame) -> DataFrame:
    """Mean reaction of the highest quintile less the lowest, by season."""
    of = lambda q: F.avg(F.when(F.col("quintile") == q, F.col("react_excess")))
    return scored.groupBy("season").agg((of(5) - of(1)).alias("spread"), F.count("*").alias("events"))


def spread_summary(spreads: DataFrame) -> DataFrame:
    return spreads.agg(F.avg("spread").alias("mean"), (F.avg("spread") / (F.stddev_samp("spread") / F.sqrt(F.count("*")))).alias("t"), F.avg(F.when(F.col("spread") > 0, 1.0).otherwise(0.0)).alias("positive"), F.count("*").alias("seasons"))


def quintile_table(scored: DataFrame) -> DataFrame:
    return scored.groupBy("quintile").agg(F.count("*").alias("n"), F.avg("react_excess").alias("mean"), F.percentile("react_excess", 0.5).alias("median"), F.avg(F.when(F.col("react_excess") > 0, 1.0).otherwise(0.0)).alias("up"))


def rank_correlation(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Spearman's within each group: the correlation of average ranks."""

    def average_rank(c):
        w = Window.partitionBy(by).orderBy(c)
        ties = F.count("*").over(Window.partitionBy(by, c))
        return F.rank().over(w) + (ties - 1) / 2

    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, average_rank(x).alias("a"), average_rank(y).alias("b"))
    return r.groupBy(by).agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n"))


def stratified_sample(securities: DataFrame, done: DataFrame, n: int, seed: int) -> DataFrame:
    """So many tickers of each size tier at random, none of those done; the seed fixes them."""
    rows = securities.join(done, "ticker", "left_anti").withColumn("tier", size_tier(F.col("market_cap"))).where("tier IS NOT NULL")
    w = Window.partitionBy("tier").orderBy(F.md5(F.concat_ws(":", "ticker", F.lit(seed))), "ticker")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def shapes(daily: Column) -> Column:
    """Names of the patterns of daily changes; none if any is missing."""
    n = F.size(daily)
    total = lambda a: F.aggregate(a, F.lit(1.0), lambda p, x: p * (1 + x)) - 1
    half = F.floor(n / 2).cast("int")
    a, b = total(F.slice(daily, F.lit(1), F.greatest(half, F.lit(1)))), total(F.slice(daily, half + 1, F.greatest(n - half, F.lit(1))))
    up, down, last = F.size(F.filter(daily, lambda x: x > 0)), F.size(F.filter(daily, lambda x: x < 0)), F.element_at(daily, -1)
    quiet = (F.abs(total(daily)) < 0.02) & F.forall(daily, lambda x: F.abs(x) <= 0.02)
    found = F.array_compact(F.array(
        F.when((n >= 3) & (up / n >= 0.7), "up_days"), F.when((n >= 3) & (down / n >= 0.7), "down_days"), F.when(last > 0.03, "jump_last"), F.when(last < -0.03, "drop_last"),
        F.when((n >= 4) & (a < 0) & (b > 0), "dip_recover"), F.when((n >= 4) & (a > 0) & (b < 0), "rally_fade"), F.when(quiet, "quiet"),
    ))
    return F.when(F.exists(daily, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(found)


def window_return(path: Column, a: int, z: int) -> Column:
    """Return over days a to z of a path; null if any day is missing."""
    part = F.slice(path, a + PATH + 1, z - a + 1)
    grown = F.aggregate(part, F.lit(1.0), lambda p, x: p * (1 + x / 100000))
    return F.when(~F.exists(part, lambda x: x.isNull()), grown - 1)


def explore(events: DataFrame, pre: tuple[int, int], post: tuple[int, int], groups: int = 5) -> DataFrame:
    """Groups of the move before within each season, and the move after; seasons of under 5 events a group are left out."""
    rows = events.select("ticker", "date", season(F.col("date")).alias("season"), window_return(F.col("path"), *pre).alias("x"), window_return(F.col("path"), *post).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    w = Window.partitionBy("season")
    rank0 = F.row_number().over(w.orderBy("x", "ticker", "date")) - 1
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("grp", (F.floor(rank0 * groups / F.col("n")) + 1).cast("long")).where(F.col("n") >= 5 * groups)
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.percentile("y", 0.5).alias("median"), F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("up"))


def direction_table(events: DataFrame, pre: tuple[int, int], post: tuple[int, int]) -> DataFrame:
    """Before up or down, after up or down, with noise bands of the share up."""
    rows = events.select(window_return(F.col("path"), *pre).alias("x"), window_return(F.col("path"), *post).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    up = F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    return rows.groupBy(F.when(F.col("x") > 0, "up").otherwise("down").alias("before")).agg(
        F.count("*").alias("n"), up.alias("up"), (1.96 * F.sqrt(up * (1 - up) / F.count("*"))).alias("band"), F.avg("y").alias("mean"), F.percentile("y", 0.5).alias("median"), F.avg(F.abs("y")).alias("size"))


def wire_rows(measured: DataFrame, sectors: DataFrame) -> DataFrame:
    """Rounded measures with the sector's number, in alphabetical order of sectors."""
    w = Window.orderBy("sector")
    index = sectors.select("sector").distinct().select("sector", (F.row_number().over(w) - 1).alias("s"))
    named = measured.join(F.broadcast(sectors.select("ticker", "sector")), "ticker", "left").join(F.broadcast(index), "sector", "left")
    return named.select("ticker", "date", "s", *[F.round(c, 4).alias(c) for c in ("pre", "react", "drift")])

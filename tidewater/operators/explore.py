"""What followed reports by what came before them: groups by size of the move, spreads by season, paths, and groups by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import season
from ..sources.staging import stored
from .events import PATH, shapes, size_tier, window_return
from .running import average_ranks, running
from .scan import excess as less_benchmark

#: A group needs so many reports, and the groups of the move before. A bucket is (at least, below).
PER_GROUP = 5
BUCKETS = {"fell_big": (None, -0.1), "fell": (-0.1, -0.03), "flat": (-0.03, 0.03), "rose": (0.03, 0.1), "rose_big": (0.1, None)}


def moves(events: DataFrame, pre: tuple[int, int], post: tuple[int, int], excess: bool, session: str = "all", surprise: str = "all", sector: str = "all") -> DataFrame:
    """Reports that pass the filters, with the move before as x and after as y; with excess less the benchmark's.

    session: before (anything but after the close), after or all. surprise: beat, miss or all. A missing day leaves a report out.
    """
    of = less_benchmark if excess else lambda a, z: window_return(F.col("path"), a, z)
    late = F.col("session").eqNullSafe(F.lit("amc"))
    for wanted, cond in ((session == "before", ~late), (session == "after", late), (surprise == "beat", F.col("surprise") > 0), (surprise == "miss", F.col("surprise") < 0), (sector != "all", F.col("sector") == sector)):
        if wanted:
            events = events.where(cond)
    return events.withColumns({"season": season(F.col("rdate")), "x": of(*pre), "y": of(*post)}).where("x IS NOT NULL AND y IS NOT NULL")


def grouped(rows: DataFrame, groups: int = 5, within_season: bool = True) -> DataFrame:
    """Add grp, 1 for the lowest moves before; 0 where a season, or the whole, has too few reports to be split.

    Over the whole, places come from ranges of the order, so that no task holds all reports.
    """
    order = [F.col("x"), F.col("ticker"), F.col("rdate")]
    if within_season:
        w = Window.partitionBy("season")
        rows = rows.withColumns({"_place": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)})
    else:
        rows = running(rows.withColumn("_one", F.lit(1)), order, {"_place": (F.sum, "_one")})
        rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all")))).drop("_one")
    n = F.col("_all")
    grp = F.when(n < groups * PER_GROUP, 0).otherwise(F.floor((F.col("_place") - 1) * groups / n) + 1).cast("long")
    return rows.withColumn("grp", grp).drop("_place", "_all")


def group_table(rows: DataFrame) -> DataFrame:
    return rows.where("grp > 0").groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.percentile("y", 0.5).alias("median"), F.avg((F.col("y") > 0).cast("double")).alias("up"))


def season_halves(rows: DataFrame, groups: int = 5) -> DataFrame:
    """Highest group less lowest by season, and the half of the seasons with a spread that it is in; a row a season."""
    of = lambda g: F.avg(F.when(F.col("grp") == g, F.col("y")))
    s = rows.groupBy("season").agg(F.count("*").alias("events"), (of(groups) - of(1)).alias("spread"))
    has = F.col("spread").isNotNull()
    place = F.sum(has.cast("long")).over(Window.orderBy("season"))
    half = F.ceil(F.sum(has.cast("long")).over(Window.partitionBy()) / 2)
    return s.withColumn("half", F.when(has & (place <= half), "early").when(has, "late"))


def average_path(rows: DataFrame, groups: int, excess: bool) -> DataFrame:
    """Mean cumulative return by day from the close before the reaction: of all reports, and of the highest and lowest group."""
    one = lambda k: F.element_at("path", k + PATH + 1) / 100000
    bench = lambda k: F.try_element_at("mark", k) / F.try_element_at("mark", k - 1) - 1

    def cumulative(day):
        ahead = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(PATH)), day), F.array(F.lit(0.0)), lambda acc, r: F.array_append(acc, (1 + F.element_at(acc, -1)) * (1 + r) - 1))
        back = F.aggregate(F.transform(F.sequence(F.lit(-1), F.lit(1 - PATH)), day), F.array(F.lit(0.0)), lambda acc, r: F.array_append(acc, (1 + F.element_at(acc, -1)) / (1 + r) - 1))
        return F.concat(F.reverse(back), F.slice(ahead, 2, PATH + 1))

    own = cumulative(one)
    value = F.zip_with(own, cumulative(bench), lambda a, b: a - b) if excess else own
    days = rows.select("grp", F.posexplode(value).alias("at", "v"))
    of = lambda cond: F.avg(F.when(cond, F.col("v")))
    return days.groupBy((F.col("at") - PATH).alias("day")).agg(of(F.col("grp") == groups).alias("top"), of(F.col("grp") == 1).alias("bottom"), F.avg("v").alias("all"))


def context_keys(pre: tuple[int, int]) -> Column:
    """Size, insiders, volume, trends and surprise; what isn't known gives no key."""
    seen = F.filter(F.slice("volume_path", pre[0] + PATH + 1, pre[1] - pre[0] + 1), lambda v: v.isNotNull())
    vol = F.when(F.size(seen) > 0, F.aggregate(seen.cast("array<double>"), F.lit(0.0), lambda s, v: s + v) / F.size(seen) / 100)
    tier, sign = size_tier(F.col("cap")), lambda c, k: F.when(F.col(c) > 0, f"{k}_above").when(F.col(c).isNotNull(), f"{k}_below")
    sur = F.col("surprise")
    return F.array_compact(F.array(
        F.when(tier != "micro", F.concat(F.lit("cap_"), tier)), F.when(F.col("buyers") > 0, "ins_yes").when(F.col("buyers").isNotNull(), "ins_no"),
        F.when(vol < 0.8, "vol_low").when(vol < 1.25, "vol_norm").when(vol < 2, "vol_high").when(vol.isNotNull(), "vol_vhigh"), sign("ma50_gap", "ma50"), sign("ma200_gap", "ma200"),
        F.when(sur < 0, "eps_miss").when(sur < 5, "eps_small").when(sur < 15, "eps_mid").when(sur.isNotNull(), "eps_big"),
    ))


def with_context(rows: DataFrame, pre: tuple[int, int], key: str) -> DataFrame:
    """Reports for which one context holds, by its key; what isn't known isn't among them."""
    return rows.where(F.array_contains(context_keys(pre), key))


def in_cohort(events: DataFrame, cohort: str) -> DataFrame:
    """live: reports that were on the schedule before they came; backfill: all others; all. Without a source a report is backfill."""
    live = F.col("source").eqNullSafe(F.lit("live"))
    return events if cohort == "all" else events.where(live if cohort == "live" else ~live)


def answers(rows: DataFrame, pre: tuple[int, int], excess: bool) -> DataFrame:
    """Reports, share up with its noise, mean, median and mean size after, for each direction, bucket, shape and context before.

    A report goes to each of its groups; one grouping makes all cells.
    """
    day = lambda k: F.element_at("path", k + PATH + 1) / 100000 - (F.try_element_at("mark", k) / F.try_element_at("mark", k - 1) - 1 if excess else F.lit(0.0))
    own = shapes(F.transform(F.sequence(F.lit(pre[0]), F.lit(pre[1])), day))
    x = F.col("x")
    bucket = F.array_compact(F.array(*[F.when((F.lit(True) if a is None else x >= a) & (F.lit(True) if z is None else x < z), k) for k, (a, z) in BUCKETS.items()]))
    named = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    lone = lambda key: F.array(key)
    keys = F.concat(named("all", lone(F.lit("all"))), named("before", lone(F.when(x > 0, "up").otherwise("down"))), named("bucket", bucket), named("shape", own), named("context", context_keys(pre)))
    up = F.avg((F.col("y") > 0).cast("double"))
    return rows.select("y", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(
        F.count("*").alias("n"), up.alias("up"), (1.96 * F.sqrt(up * (1 - up) / F.count("*"))).alias("noise"), F.avg("y").alias("mean"), F.percentile("y", 0.5).alias("median"), F.avg(F.abs("y")).alias("size"))


def correlations(rows: DataFrame) -> DataFrame:
    """Rank correlations of the moves and of their sizes, with the noise of chance; null under three reports.

    Equal values share their average rank. Values are counted and ranked over ranges of their order, and joined back.
    """
    r = stored(rows.select("x", "y", F.abs("x").alias("ax"), F.abs("y").alias("ay")), "moves")
    for value, rank in (("x", "a"), ("y", "b"), ("ax", "c"), ("ay", "d")):
        r = r.join(average_ranks(r.select(value), value, [], rank), value)
    enough = lambda v: F.when(F.count("*") >= 3, v)
    return r.agg(F.count("*").alias("n"), enough(F.corr("a", "b")).alias("direction"), enough(F.corr("c", "d")).alias("size"), enough(1.96 / F.sqrt(F.count("*"))).alias("noise"))

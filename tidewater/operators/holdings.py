"""Effective holdings, tickers, snapshots, changes between filings, and fund flows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import latest_quarter_end, normalize_name, reporting_quarter, symbol, truncated
from ..sources.staging import stored

QUARTER = ["cik", "period"]


def _base(filings: DataFrame) -> DataFrame:
    """The first filing of a quarter that isn't NEW HOLDINGS: latest, a restatement before an original."""
    w = Window.partitionBy(*QUARTER).orderBy(
        F.desc("filed"), F.desc(F.col("kind") == "RESTATEMENT"), F.desc("accession"), F.desc("filing_id")
    )
    return filings.where("kind <> 'NEW HOLDINGS'").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def classified(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """Filings that hold rows, with kind, and base and extra flags after reclassification.

    NEW HOLDINGS that share at least 5 and half of the base's securities restate it. Late ones are
    compared with the base as first declared. Filings are few beside holdings, so windows run on
    them alone, and securities are compared in amended quarters only. What is used more than once is
    stored, so that holdings are read twice: for the filings that have rows, and for the securities of amended quarters.
    """
    f = stored(filings.join(holdings.select("filing_id").distinct(), "filing_id", "left_semi").withColumn(
        "kind", F.when(F.col("form_type") == "13F-HR", "ORIGINAL").when(F.col("amendment_type") == "NEW HOLDINGS", "NEW HOLDINGS").otherwise("RESTATEMENT")
    ), "declared")
    base0 = stored(_base(f).select(*QUARTER, F.col("filing_id").alias("base0"), F.col("filed").alias("filed0")), "bases")
    new = f.where("kind = 'NEW HOLDINGS'").select("filing_id", *QUARTER).join(base0, QUARTER).select("filing_id", "base0")
    met = new.select("filing_id").union(new.select("base0")).distinct()
    held = stored(holdings.where("cusip IS NOT NULL").select("filing_id", "cusip").join(met, "filing_id", "left_semi").distinct(), "amended")
    base_ids = held.join(new.select(F.col("base0").alias("filing_id")), "filing_id", "left_semi")
    sizes = base_ids.groupBy(F.col("filing_id").alias("base0")).agg(F.count("*").alias("base_n"))
    shared = (
        new.join(held, "filing_id").join(base_ids.withColumnRenamed("filing_id", "base0"), ["base0", "cusip"])
        .groupBy("filing_id", "base0").agg(F.count("*").alias("shared"))
    )
    again = shared.join(sizes, "base0").where("shared >= 5 AND 2 * shared >= base_n").select("filing_id", F.lit(True).alias("again"))
    f = stored(f.join(again, "filing_id", "left").withColumn("kind", F.when(F.col("again"), "RESTATEMENT").otherwise(F.col("kind"))).drop("again"), "declared")
    base = _base(f).select(*QUARTER, F.col("filing_id").alias("base"))
    f = f.join(base, QUARTER, "left").join(base0, QUARTER, "left")
    return f.withColumn("is_base", F.coalesce(F.col("filing_id") == F.col("base"), F.lit(False))).withColumn(
        "is_extra", (F.col("kind") == "NEW HOLDINGS") & (F.col("base0").isNull() | (F.col("filed") >= F.col("filed0")))
    )


def effective_holdings(roles: DataFrame, holdings: DataFrame) -> DataFrame:
    """Rows of the base and of extras, without options, principal amounts and copies; roles: from classified()."""
    f = roles.where("is_base OR is_extra").select("filing_id", "filed", "accession", "is_base")
    rows = holdings.join(f, "filing_id")
    amended = rows.where("NOT is_base").select(*QUARTER).distinct()
    other = rows.join(amended, QUARTER, "left_semi").select(
        *QUARTER, *[F.col(c).alias(f"o_{c}") for c in ("cusip", "put_call", "shares", "filed", "accession", "is_base", "filing_id")]
    ).distinct()
    keep = rows.where("put_call IS NULL AND coalesce(sh_type, 'SH') <> 'PRN'")
    earlier = (F.col("o_filed") < F.col("filed")) | ((F.col("o_filed") == F.col("filed")) & (F.col("o_accession") < F.col("accession")))
    copy = (F.col("shares").eqNullSafe(F.col("o_shares")) & (F.col("o_is_base") | earlier)) | (F.col("o_is_base") & (F.col("o_filed") > F.col("filed")))
    x = keep.where("NOT is_base").alias("x")
    same = (
        (F.col("x.cik") == F.col("o.cik")) & (F.col("x.period") == F.col("o.period")) & F.col("cusip").eqNullSafe(F.col("o_cusip"))
        & F.col("put_call").eqNullSafe(F.col("o_put_call")) & (F.col("filing_id") != F.col("o_filing_id")) & copy
    )
    extras = x.join(other.alias("o"), same, "left_anti")
    return keep.where("is_base").unionByName(extras).select(*holdings.columns, "filed")


def recent(effective: DataFrame, filers: DataFrame, n: int) -> DataFrame:
    """Rows of each filer's latest n periods: distinct periods are ranked, not rows."""
    w = Window.partitionBy("cik").orderBy(F.desc("period"))
    periods = effective.select(*QUARTER).distinct().withColumn("k", F.dense_rank().over(w)).where(F.col("k") <= n).drop("k")
    return effective.join(periods, QUARTER, "left_semi").join(filers.select("cik", "filer_name"), "cik", "left")


def name_map(securities: DataFrame, cusip_map: DataFrame) -> DataFrame:
    """(name, by_name): of tickers with one normalised name a mapped one, then the shortest, then the first."""
    mapped = cusip_map.select("ticker").distinct().withColumn("mapped", F.lit(0))
    named = securities.select(normalize_name(F.col("name")).alias("name"), "ticker").join(mapped, "ticker", "left")
    order = F.struct(F.coalesce("mapped", F.lit(1)), F.length("ticker"), "ticker")
    return named.where("name <> ''").groupBy("name").agg(F.min_by("ticker", order).alias("by_name"))


def resolve_tickers(holdings: DataFrame, cusip_map: DataFrame, securities: DataFrame) -> DataFrame:
    """Add resolved: by security id, by its rows' majority, by the stored ticker, by name.

    Names are normalised once for each distinct issuer. Rows have few names and ids, so a shuffle by them would put most rows
    into a few tasks: names, votes and the map, a row for each issuer or security, are broadcast, and rows stay where they are.
    """
    issuers = holdings.select("issuer_name").distinct().withColumn("name", normalize_name(F.col("issuer_name")))
    issuers = issuers.join(name_map(securities, cusip_map), "name").select("issuer_name", "by_name")
    key = F.upper(F.trim("cusip"))
    rows = holdings.join(F.broadcast(issuers), "issuer_name", "left").withColumn("key", key).withColumn("own", F.coalesce("ticker", "by_name"))
    votes = rows.where("own IS NOT NULL").groupBy("key", "own").agg(F.count("*").alias("votes"))
    vote = votes.groupBy("key").agg(F.min_by("own", F.struct(-F.col("votes"), "own")).alias("vote"))
    by_id = cusip_map.select(F.upper(F.trim("cusip")).alias("key"), F.col("ticker").alias("by_id"))
    out = rows.join(F.broadcast(by_id), "key", "left").join(F.broadcast(vote), "key", "left")
    return out.withColumn("resolved", symbol(F.coalesce("by_id", "vote", "ticker", "by_name"))).drop("key", "own", "by_name", "by_id", "vote")


def fund_snapshots(resolved: DataFrame) -> DataFrame:
    """Shares and value by fund, period and ticker; the book covers unresolved rows too."""
    book = resolved.groupBy(*QUARTER).agg(F.sum("value_usd").alias("book"))
    own = resolved.where("resolved IS NOT NULL").groupBy("cik", "period", F.col("resolved").alias("ticker")).agg(
        F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd")
    )
    return own.join(book, QUARTER)


def with_split_factor(rows: DataFrame, splits: DataFrame, after: str, upto: str) -> DataFrame:
    """Add factor, the product of the ticker's ratios dated in (after, upto]."""
    per = splits.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("split_date", "ratio"))).alias("splits"))
    inside = F.filter("splits", lambda s: (s["split_date"] > F.col(after)) & (s["split_date"] <= F.col(upto)))
    factor = F.aggregate(inside, F.lit(1.0), lambda a, s: a * s["ratio"])
    return rows.join(per, "ticker", "left").withColumn("factor", F.coalesce(factor, F.lit(1.0))).drop("splits")


def classify_change(prev: Column, cur: Column, factor: Column) -> Column:
    change = F.round(cur / (prev * factor) - 1, 9)
    p, c = F.coalesce(prev, F.lit(0)), F.coalesce(cur, F.lit(0))
    return (
        F.when((p <= 0) & (c > 0), "opened").when((p > 0) & (c <= 0), "exited").when((p > 0) & (change >= 0.1), "added")
        .when((p > 0) & (change <= -0.1), "trimmed")
    )


def filing_pairs(periods: DataFrame) -> DataFrame:
    """(cik, lag, pair_rank, period, prev_period): neighbours, and the newest with the one two back."""
    w = Window.partitionBy("cik").orderBy(F.desc("period"))
    p = periods.select(*QUARTER).distinct()
    p = p.select("cik", "period", (F.row_number().over(w) - 1).alias("pair_rank"), F.lead("period", 1).over(w).alias("p1"), F.lead("period", 2).over(w).alias("p2"))
    one = p.where("p1 IS NOT NULL").select("cik", F.lit(1).alias("lag"), "pair_rank", "period", F.col("p1").alias("prev_period"))
    two = p.where("p2 IS NOT NULL AND pair_rank = 0").select("cik", F.lit(2).alias("lag"), "pair_rank", "period", F.col("p2").alias("prev_period"))
    return one.unionByName(two)


def fund_status(filers: DataFrame, periods: DataFrame, as_of: date) -> DataFrame:
    """(cik, status): counted, no_baseline with one period, stopped_filing when the newest is too old, untracked."""
    d = F.lit(as_of)
    oldest = F.last_day(F.add_months(reporting_quarter(d), -3))
    p = periods.select(*QUARTER).distinct().groupBy("cik").agg(F.max("period").alias("newest"), F.count("*").alias("n"))
    known = filers.select("cik", F.lit(1).alias("known"))
    status = F.when(F.col("known").isNull(), "untracked").when(F.col("newest") < oldest, "stopped_filing").when(F.col("n") < 2, "no_baseline").otherwise("counted")
    return p.join(known, "cik", "left").select("cik", "newest", status.alias("status"))


def position_changes(snapshots: DataFrame, filers: DataFrame, splits: DataFrame, as_of: date) -> DataFrame:
    """Opened, added, trimmed and exited positions of each pair of filings of counted funds.

    Every snapshot row goes to the pairs it takes part in, and one grouping by (fund, pair, ticker)
    brings both sides together: a full outer join without a second shuffle of the rows.
    """
    counted = fund_status(filers, snapshots, as_of).where("status = 'counted'").select("cik")
    pairs = filing_pairs(snapshots).join(counted, "cik", "left_semi")
    sides = pairs.withColumn("side", F.explode(F.array(F.struct(F.col("period").alias("at"), F.lit(True).alias("now")), F.struct(F.col("prev_period").alias("at"), F.lit(False).alias("now")))))
    sides = sides.select("cik", "lag", "pair_rank", "period", "prev_period", F.col("side.at").alias("at"), F.col("side.now").alias("now"))
    rows = snapshots.withColumnRenamed("period", "at").join(sides, ["cik", "at"])
    of = lambda c, now: F.max(F.when(F.col("now") == now, F.col(c)))
    both = rows.groupBy("cik", "lag", "pair_rank", "period", "prev_period", "ticker").agg(
        of("shares", False).alias("shares_prev"), of("shares", True).alias("shares_cur"), of("value_usd", False).alias("value_prev"),
        of("value_usd", True).alias("value_cur"), of("book", False).alias("book_prev"), of("book", True).alias("book_cur"),
    )
    both = with_split_factor(both, splits, "prev_period", "period")
    both = both.withColumn("event", classify_change(F.col("shares_prev"), F.col("shares_cur"), F.col("factor"))).where("event IS NOT NULL")
    gone = F.col("event") == "exited"
    value, book = F.when(gone, F.col("value_prev")).otherwise(F.col("value_cur")), F.when(gone, F.col("book_prev")).otherwise(F.col("book_cur"))
    return both.select(
        "cik", "lag", "pair_rank", "period", "prev_period", "ticker", "event", F.coalesce("shares_prev", F.lit(0)).alias("shares_prev"),
        F.coalesce("shares_cur", F.lit(0)).alias("shares_cur"), "factor", value.alias("value_usd"), (value.cast("double") / book.cast("double")).alias("pct_of_fund"),
    )


TIER = {"S": 1.5, "A": 1.2, "B": 1.0, "C": 0.7}


def filer_weights(filers: DataFrame) -> DataFrame:
    """(cik, weight): multiplier times the tier's; an unknown tier is B; no cik, no row."""
    of = F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv])
    return filers.where("cik IS NOT NULL").select("cik", (F.col("multiplier") * F.coalesce(F.element_at(of, F.col("tier")), F.lit(1.0))).alias("weight"))


def fund_flows(changes: DataFrame, filers: DataFrame, lag: int = 1, tiers=None, categories=None) -> DataFrame:
    """Per ticker: buyers, sellers, events, weighted net, conviction, and the streak of net buying.

    The newest pair makes the figures; the streak counts the leading pairs of lag 1 with more
    buyers than sellers. One grouping by ticker and rank serves both.
    """
    f = filers.select("cik", "filer_name", "tier", "category")
    if tiers:
        f = f.where(F.col("tier").isin(*tiers))
    if categories:
        f = f.where(F.col("category").isin(*categories))
    of = F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv])
    rows = changes.join(f, "cik").withColumn("buy", F.col("event").isin("opened", "added"))
    rows = rows.withColumn("sign", F.when(F.col("buy"), 1).otherwise(-1)).withColumn("mult", F.coalesce(F.element_at(of, F.col("tier")), F.lit(1.0)))
    count = lambda e: F.count_if(F.col("event") == e)
    conviction = F.struct(F.col("pct_of_fund"), F.col("filer_name"), F.col("cik"))
    now = rows.where((F.col("lag") == lag) & (F.col("pair_rank") == 0)).groupBy("ticker").agg(
        F.count_if("buy").alias("buyers"), F.count_if(~F.col("buy")).alias("sellers"), F.sum("sign").alias("net"), count("opened").alias("opened"),
        count("added").alias("added"), count("trimmed").alias("trimmed"), count("exited").alias("exited"), F.sum(F.col("sign") * F.col("mult")).alias("weighted_net"),
        F.count_if(F.col("buy") & F.col("tier").isin("S", "A")).alias("top_buyers"), F.max(F.when(F.col("buy"), F.col("pct_of_fund"))).alias("conviction_max"),
        F.max_by("filer_name", F.when(F.col("buy"), conviction)).alias("conviction_filer"), F.sum(F.when(F.col("buy"), F.col("pct_of_fund"))).alias("conviction_sum"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
    )
    return now.join(streaks(rows), "ticker", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def streaks(rows: DataFrame) -> DataFrame:
    """(ticker, streak): the leading run of ranks 0, 1, 2… with more buyers than sellers."""
    by = rows.where("lag = 1").groupBy("ticker", "pair_rank").agg(F.sum("sign").alias("s")).where("s > 0")
    w = Window.partitionBy("ticker").orderBy("pair_rank")
    run = by.withColumn("k", F.row_number().over(w) - 1).where("k = pair_rank")
    return run.groupBy("ticker").agg(F.count("*").alias("streak"))


def strength(net: Column, top: Column, streak: Column) -> Column:
    return (
        F.when((net >= 3) & (top >= 1) & (streak >= 2), "Strong").when(net >= 3, "Moderate").when(net >= 1, "Weak").when(net <= -2, "Net selling")
    )


def filter_flows(
    flows: DataFrame, min_net: int | None = None, min_cap: float | None = None, max_cap: float | None = None, labels=None, industry: str | None = None,
    min_adv: float | None = None, min_ret: float | None = None, max_ret: float | None = None, no_label: bool = False, watchlist: DataFrame | None = None,
) -> DataFrame:
    """An unknown value fails a filter that is set; an industry that isn't known is Unclassified. watchlist: a table with ticker."""
    for limit, column, least in ((min_net, "net", True), (min_cap, "market_cap", True), (max_cap, "market_cap", False), (min_adv, "adv20", True), (min_ret, "ret_6m", True), (max_ret, "ret_6m", False)):
        if limit is not None:
            flows = flows.where(F.col(column) >= limit if least else F.col(column) <= limit)
    if labels is not None:
        flows = flows.where(F.col("label").isin(*(labels or [""])))
    if no_label:
        flows = flows.where("label IS NULL")
    if industry is not None:
        flows = flows.where(F.coalesce("industry", F.lit("Unclassified")) == industry)
    return flows if watchlist is None else flows.join(watchlist.select("ticker").distinct(), "ticker", "left_semi")


#: Labels from the strongest down.
LABEL_ORDER = ("Strong", "Moderate", "Weak", "Net selling")


def sort_flows(flows: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """In the order of a column, or of label by strength and then conviction_sum; nulls come last either way, and ticker breaks ties."""
    by = F.col(key)
    if key == "label":
        by = F.coalesce(*[F.when(F.col("label") == x, len(LABEL_ORDER) - k) for k, x in enumerate(LABEL_ORDER)])
    first = by.desc_nulls_last() if descending else by.asc_nulls_last()
    return flows.orderBy(first, *[F.col("conviction_sum").desc_nulls_last()] * (key == "label"), "ticker")


def industry_rollup(flows: DataFrame) -> DataFrame:
    """Stocks, bought and sold, total net, sector and the three most bought tickers of each industry."""
    blank = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "Unclassified").otherwise(F.col(c))
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("net") > 0, F.struct(-F.col("net"), F.col("ticker"))))), 1, 3)
    return flows.groupBy(blank("industry").alias("industry")).agg(
        F.count("*").alias("stocks"), F.count_if(F.col("net") > 0).alias("bought"), F.count_if(F.col("net") < 0).alias("sold"),
        F.sum("net").alias("total_net"), F.min("sector").alias("sector"), F.array_join(F.transform(top, lambda x: x["ticker"]), ",").alias("top"),
    )


def quarter_coverage(changes: DataFrame) -> DataFrame:
    return changes.where("lag = 1 AND pair_rank = 0").groupBy("period").agg(F.count_distinct("cik").alias("funds"))


def stock_pivot(effective: DataFrame, filers: DataFrame, least: int = 2, top: int = 100) -> DataFrame:
    """Per security: each fund's latest position; the most held first. Lots of a period are summed."""
    funds = filers.where("category <> 'corporate'").select("cik")
    n_funds = funds.count()
    lots = effective.join(funds, "cik").groupBy("cusip", "cik", "period").agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"))
    w = Window.partitionBy("cusip", "cik").orderBy(F.desc("period"))
    last = lots.withColumn("k", F.row_number().over(w)).where("k = 1")
    out = last.groupBy("cusip").agg(
        F.count("*").alias("n_funds"), F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )
    out = out.withColumn("pct", F.round(100.0 * F.col("n_funds") / F.lit(max(n_funds, 1)), 4))
    return out.where(F.col("n_funds") >= least).orderBy(F.desc("n_funds"), F.desc("value_usd"), "cusip").limit(top)


def quarter_diff(effective: DataFrame) -> DataFrame:
    """Each filer's latest two periods by normalised issuer: new, add from +10 %, trim from -10 %, exit."""
    w = Window.partitionBy("cik").orderBy(F.desc("period"))
    p = effective.select(*QUARTER).distinct().withColumn("k", F.row_number().over(w)).where("k <= 2")
    rows = effective.join(p, QUARTER).withColumn("issuer", normalize_name(F.col("issuer_name")))
    both = rows.groupBy("cik", "issuer").agg(F.sum(F.when(F.col("k") == 1, F.col("shares"))).alias("now"), F.sum(F.when(F.col("k") == 2, F.col("shares"))).alias("before"))
    two = p.groupBy("cik").agg(F.max("k").alias("n")).where("n = 2").select("cik")
    change = (
        F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "exit").when(F.col("now") >= 1.1 * F.col("before"), "add")
        .when(F.col("now") <= 0.9 * F.col("before"), "trim")
    )
    return both.join(two, "cik", "left_semi").withColumn("change", change).where("change IS NOT NULL")


def thousands(effective: DataFrame, top: int = 10, floor: float = 5.0) -> DataFrame:
    """Per filing quarter: value over shares, its upper median in the largest positions, and totals scaled by 1000 where it is low."""
    w = Window.partitionBy(*QUARTER).orderBy(F.desc("value_usd"), "cusip", "shares")
    marks = effective.where("shares > 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    marks = marks.groupBy(*QUARTER).agg(F.sort_array(F.collect_list(F.col("value_usd").cast("double") / F.col("shares"))).alias("m"))
    marks = marks.select(*QUARTER, F.element_at("m", (F.size("m") / 2).cast("int") + 1).alias("median"))
    totals = effective.groupBy(*QUARTER).agg(F.sum("value_usd").alias("total"), F.count("*").alias("positions"))
    return totals.join(marks, QUARTER, "left").withColumn("total", F.col("total") * F.when(F.col("median") < floor, 1000).otherwise(1))


def stock_holders(snapshots: DataFrame, filers: DataFrame, ticker: str | None = None) -> DataFrame:
    """Current holders with what they did in their newest filing, and who left in it; strict 10 % limits."""
    funds = filers.where("category <> 'corporate'").select("cik")
    rows = snapshots.join(funds, "cik")
    if ticker:
        rows = rows.where(F.col("ticker") == ticker)
    w = Window.partitionBy("cik").orderBy(F.desc("period"))
    p = snapshots.select(*QUARTER).distinct().withColumn("k", F.row_number().over(w)).where("k <= 2")
    both = rows.join(p, QUARTER).groupBy("cik", "ticker").agg(F.sum(F.when(F.col("k") == 1, F.col("shares"))).alias("now"), F.sum(F.when(F.col("k") == 2, F.col("shares"))).alias("before"))
    status = (
        F.when(F.col("now").isNull(), "exited").when(F.col("before").isNull(), "new").when(F.col("now") > 1.1 * F.col("before"), "add")
        .when(F.col("now") < 0.9 * F.col("before"), "trim").otherwise("hold")
    )
    return both.withColumn("status", status)


def cusip_queue(holdings: DataFrame, cusip_map: DataFrame, as_of: date, retry_days: int = 30, most: int = 300) -> DataFrame:
    """Securities to look up: unmapped ones, then those without a match whose last try is old; oldest first."""
    seen = holdings.where("cusip IS NOT NULL").groupBy(F.upper(F.trim("cusip")).alias("cusip")).agg(F.max("period").alias("last_seen"))
    fresh = seen.join(cusip_map, "cusip", "left_anti").select("cusip", "last_seen", F.lit("new").alias("reason"), F.lit(None).cast("date").alias("tried"))
    old = cusip_map.where((F.col("resolved_via") == "no-match") & (F.col("resolved_at") < F.date_sub(F.lit(as_of), retry_days)))
    retry = seen.join(old, "cusip").select("cusip", "last_seen", F.lit("retry").alias("reason"), F.col("resolved_at").alias("tried"))
    return fresh.unionByName(retry).orderBy(F.asc_nulls_first("tried"), "cusip").limit(most)


def choose_listing(candidates: DataFrame) -> DataFrame:
    """The first listing on a home exchange of each security, else the first."""
    w = Window.partitionBy("cusip").orderBy(F.desc("is_us"), "position")
    return candidates.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def backfill_tickers(holdings: DataFrame, names: DataFrame) -> DataFrame:
    """Stored tickers, or those of the issuer's name, or of the name without a short last word."""
    issuers = holdings.select("issuer_name").distinct().withColumn("name", normalize_name(F.col("issuer_name")))
    short = names.select(F.col("name").alias("short"), F.col("by_name").alias("by_short"))
    issuers = issuers.join(names, "name", "left").withColumn("short", truncated(F.col("name"))).join(short, "short", "left")
    issuers = issuers.select("issuer_name", F.coalesce("by_name", "by_short").alias("found")).where("found IS NOT NULL")
    return holdings.join(F.broadcast(issuers), "issuer_name", "left").withColumn("filled", F.coalesce("ticker", "found")).drop("found")


def held_symbols(holdings: DataFrame, cusip_map: DataFrame) -> DataFrame:
    both = cusip_map.select("ticker").union(holdings.select("ticker")).where("ticker IS NOT NULL")
    return both.select(symbol(F.col("ticker")).alias("symbol")).distinct().where(~F.col("symbol").contains(" "))


def entity_candidates(hits: DataFrame) -> DataFrame:
    """(query, cik, hits, status) of search hits (query, cik, name): only names that contain the query count."""
    n = hits.where(F.upper("name").contains(F.upper("query"))).groupBy("query", "cik").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query").orderBy(F.desc("hits"), "cik")
    ranked = n.withColumn("k", F.row_number().over(w)).withColumn("runner_up", F.lead("hits").over(w)).where("k = 1")
    known = ranked.withColumn("status", F.when(F.col("runner_up").isNull() | (F.col("hits") >= 2 * F.col("runner_up")), "resolved").otherwise("ambiguous"))
    return hits.select("query").distinct().join(known.select("query", "cik", "hits", "status"), "query", "left").withColumn("status", F.coalesce("status", F.lit("no_match")))


def report_quarter(d: date) -> Column:
    return latest_quarter_end(F.lit(d))

"""Queries on names, filings, holdings and fund flows, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import holdings as H
from ..sources.bridge import oracle, table
from ..sources.staging import staged

AS_OF = date(2001, 10, 3)

_LEGAL = S.LEGAL.replace("'", "''")
_NAME = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({c}, '')), '[.,&/\\-()'']', ' ', 'g'), '{_LEGAL}', ' ', 'g'), '\\s+', ' ', 'g'))"

#: Rules as views for the SQL check.
VIEWS = {
    "f0": """SELECT f.*, CASE WHEN form_type = '13F-HR' THEN 'ORIGINAL' WHEN amendment_type = 'NEW HOLDINGS' THEN 'NEW HOLDINGS' ELSE 'RESTATEMENT' END AS kind
        FROM filings f WHERE EXISTS (SELECT 1 FROM holdings h WHERE h.filing_id = f.filing_id)""",
    "base0": """SELECT cik, period, filing_id, filed FROM f0 WHERE kind <> 'NEW HOLDINGS'
        QUALIFY row_number() OVER (PARTITION BY cik, period ORDER BY filed DESC, (kind = 'RESTATEMENT') DESC, accession DESC, filing_id DESC) = 1""",
    "sets": "SELECT DISTINCT filing_id, cusip FROM holdings WHERE cusip IS NOT NULL",
    "relisted": """SELECT n.filing_id FROM f0 n JOIN base0 b USING (cik, period) WHERE n.kind = 'NEW HOLDINGS' AND
        (SELECT count(*) FROM sets x JOIN sets y USING (cusip) WHERE x.filing_id = n.filing_id AND y.filing_id = b.filing_id) >=
        greatest(5, (SELECT count(*) FROM sets y WHERE y.filing_id = b.filing_id) / 2.0)""",
    "f1": """SELECT f0.* REPLACE (CASE WHEN filing_id IN (SELECT filing_id FROM relisted) THEN 'RESTATEMENT' ELSE kind END AS kind) FROM f0""",
    "base1": """SELECT cik, period, filing_id FROM f1 WHERE kind <> 'NEW HOLDINGS'
        QUALIFY row_number() OVER (PARTITION BY cik, period ORDER BY filed DESC, (kind = 'RESTATEMENT') DESC, accession DESC, filing_id DESC) = 1""",
    "chosen": """SELECT f1.filing_id, f1.cik, f1.period, f1.filed, f1.accession, f1.filing_id = base1.filing_id AS is_base
        FROM f1 LEFT JOIN base1 ON base1.cik = f1.cik AND base1.period = f1.period LEFT JOIN base0 ON base0.cik = f1.cik AND base0.period = f1.period
        WHERE coalesce(f1.filing_id = base1.filing_id, false) OR (f1.kind = 'NEW HOLDINGS' AND (base0.filing_id IS NULL OR f1.filed >= base0.filed))""",
    "chosen_rows": "SELECT h.*, c.filed, c.accession, coalesce(c.is_base, false) AS is_base FROM holdings h JOIN chosen c ON c.filing_id = h.filing_id",
    "effective": """SELECT filing_id, cik, period, cusip, ticker, issuer_name, shares, value_usd, put_call, sh_type, filed FROM chosen_rows x
        WHERE put_call IS NULL AND coalesce(sh_type, 'SH') <> 'PRN' AND (is_base OR NOT EXISTS (
            SELECT 1 FROM chosen_rows o WHERE o.cik = x.cik AND o.period = x.period AND o.filing_id <> x.filing_id
              AND o.cusip IS NOT DISTINCT FROM x.cusip AND o.put_call IS NOT DISTINCT FROM x.put_call
              AND ((o.shares IS NOT DISTINCT FROM x.shares AND (o.is_base OR o.filed < x.filed OR (o.filed = x.filed AND o.accession < x.accession)))
                   OR (o.is_base AND o.filed > x.filed))))""",
    "names": f"""SELECT name, arg_min(ticker, (unmapped, length(ticker), ticker)) AS by_name FROM (
        SELECT {_NAME('s.name')} AS name, s.ticker, CASE WHEN m.ticker IS NULL THEN 1 ELSE 0 END AS unmapped
        FROM securities s LEFT JOIN (SELECT DISTINCT ticker FROM cusip_map) m ON m.ticker = s.ticker) WHERE name <> '' GROUP BY name""",
    "owned": f"""SELECT e.*, upper(trim(e.cusip)) AS key, n.by_name, coalesce(e.ticker, n.by_name) AS own FROM effective e
        LEFT JOIN (SELECT i.issuer_name, x.by_name FROM (SELECT DISTINCT issuer_name FROM effective) i JOIN names x ON x.name = {_NAME('i.issuer_name')}) n
        ON n.issuer_name = e.issuer_name""",
    "voted": """SELECT key, arg_min(own, (-v, own)) AS vote FROM (SELECT key, own, count(*) AS v FROM owned WHERE own IS NOT NULL GROUP BY ALL) GROUP BY key""",
    "resolved": """SELECT o.*, upper(trim(replace(replace(coalesce(m.ticker, w.vote, o.ticker, o.by_name), '/', '-'), '.', '-'))) AS resolved
        FROM owned o LEFT JOIN cusip_map m ON m.cusip = o.key LEFT JOIN voted w ON w.key = o.key""",
    "snapshots": """SELECT cik, period, ticker, shares, value_usd, book FROM (SELECT cik, period, resolved AS ticker, sum(shares) AS shares, sum(value_usd) AS value_usd
        FROM resolved WHERE resolved IS NOT NULL GROUP BY ALL) JOIN (SELECT cik, period, sum(value_usd) AS book FROM resolved GROUP BY ALL) USING (cik, period)""",
    "fund_periods": "SELECT DISTINCT cik, period FROM snapshots",
    "status": """SELECT p.cik, newest, CASE WHEN f.cik IS NULL THEN 'untracked' WHEN newest < date '2001-03-31' THEN 'stopped_filing' WHEN n < 2 THEN 'no_baseline' ELSE 'counted' END AS status
        FROM (SELECT cik, max(period) AS newest, count(*) AS n FROM fund_periods GROUP BY cik) p LEFT JOIN filers f ON f.cik = p.cik""",
    "ranked": """SELECT cik, period, row_number() OVER (PARTITION BY cik ORDER BY period DESC) - 1 AS k FROM fund_periods
        WHERE cik IN (SELECT cik FROM status WHERE status = 'counted')""",
    "pairs": """SELECT a.cik, b.k - a.k AS lag, a.k AS pair_rank, a.period, b.period AS prev_period FROM ranked a JOIN ranked b ON b.cik = a.cik
        AND (b.k = a.k + 1 OR (a.k = 0 AND b.k = 2))""",
    "sides": """SELECT p.*, coalesce(c.ticker, o.ticker) AS ticker, o.shares AS s0, c.shares AS s1, o.value_usd AS v0, c.value_usd AS v1, o.book AS b0, c.book AS b1
        FROM pairs p JOIN snapshots c ON c.cik = p.cik AND c.period = p.period LEFT JOIN snapshots o ON o.cik = p.cik AND o.period = p.prev_period AND o.ticker = c.ticker
        UNION ALL SELECT p.*, o.ticker, o.shares, NULL, o.value_usd, NULL, o.book, NULL FROM pairs p JOIN snapshots o ON o.cik = p.cik AND o.period = p.prev_period
        WHERE NOT EXISTS (SELECT 1 FROM snapshots c WHERE c.cik = p.cik AND c.period = p.period AND c.ticker = o.ticker)""",
    "factored": """SELECT *, coalesce((SELECT product(ratio) FROM splits z WHERE z.ticker = sides.ticker AND z.split_date > sides.prev_period AND z.split_date <= sides.period), 1.0) AS factor FROM sides""",
    "changes": """SELECT cik, lag, pair_rank, period, prev_period, ticker, event, coalesce(s0, 0) AS shares_prev, coalesce(s1, 0) AS shares_cur, factor,
        CASE WHEN event = 'exited' THEN v0 ELSE v1 END AS value_usd, CASE WHEN event = 'exited' THEN v0::double / b0::double ELSE v1::double / b1::double END AS pct_of_fund
        FROM (SELECT *, CASE WHEN coalesce(s0, 0) <= 0 AND coalesce(s1, 0) > 0 THEN 'opened' WHEN coalesce(s0, 0) > 0 AND coalesce(s1, 0) <= 0 THEN 'exited'
              WHEN coalesce(s0, 0) > 0 AND round(s1 / (s0 * factor) - 1, 9) >= 0.1 THEN 'added' WHEN coalesce(s0, 0) > 0 AND round(s1 / (s0 * factor) - 1, 9) <= -0.1 THEN 'trimmed' END AS event
              FROM factored) WHERE event IS NOT NULL""",
    "flow_rows": """SELECT c.*, f.filer_name, f.tier, event IN ('opened', 'added') AS buy, CASE WHEN event IN ('opened', 'added') THEN 1 ELSE -1 END AS sign,
        CASE tier WHEN 'S' THEN 1.5 WHEN 'A' THEN 1.2 WHEN 'C' THEN 0.7 ELSE 1.0 END AS mult FROM changes c JOIN filers f ON f.cik = c.cik""",
    "streak": """SELECT ticker, count(*) AS streak FROM (SELECT ticker, pair_rank, row_number() OVER (PARTITION BY ticker ORDER BY pair_rank) - 1 AS k
        FROM (SELECT ticker, pair_rank FROM flow_rows WHERE lag = 1 GROUP BY ALL HAVING sum(sign) > 0)) WHERE k = pair_rank GROUP BY ticker""",
    "flows": """SELECT n.*, coalesce(s.streak, 0) AS streak FROM (
        SELECT ticker, count(*) FILTER (buy) AS buyers, count(*) FILTER (NOT buy) AS sellers, sum(sign)::bigint AS net, count(*) FILTER (event = 'opened') AS opened, count(*) FILTER (event = 'added') AS added,
               count(*) FILTER (event = 'trimmed') AS trimmed, count(*) FILTER (event = 'exited') AS exited, sum(sign * mult)::double AS weighted_net,
               count(*) FILTER (buy AND tier IN ('S', 'A')) AS top_buyers, max(pct_of_fund) FILTER (buy) AS conviction_max,
               arg_max(filer_name, (pct_of_fund, filer_name, cik)) FILTER (buy) AS conviction_filer, sum(pct_of_fund) FILTER (buy) AS conviction_sum,
               min(period) AS first_period, max(period) AS last_period FROM flow_rows WHERE lag = 1 AND pair_rank = 0 GROUP BY ticker) n LEFT JOIN streak s ON s.ticker = n.ticker""",
    "facts": """SELECT f.*, s.industry, s.sector, s.market_cap, s.adv20, s.ret_6m, CASE WHEN net >= 3 AND top_buyers >= 1 AND streak >= 2 THEN 'Strong' WHEN net >= 3 THEN 'Moderate' WHEN net >= 1 THEN 'Weak'
        WHEN net <= -2 THEN 'Net selling' END AS label FROM flows f LEFT JOIN securities s ON s.ticker = f.ticker""",
}


def effective(spark, d):
    """Rows of the chosen filings; the filings' roles, few rows, are staged before they meet the holdings."""
    filings, holdings = table(spark, d, "filings"), table(spark, d, "holdings")
    roles = staged(spark, d, "roles", lambda: H.classified(filings, holdings))
    return staged(spark, d, "effective", lambda: H.effective_holdings(roles, holdings))


def resolved(spark, d):
    return staged(spark, d, "resolved", lambda: H.resolve_tickers(effective(spark, d), table(spark, d, "cusip_map"), table(spark, d, "securities")))


def snapshots(spark, d):
    return staged(spark, d, "snapshots", lambda: H.fund_snapshots(resolved(spark, d)))


def changes(spark, d):
    return staged(spark, d, "changes", lambda: H.position_changes(snapshots(spark, d), table(spark, d, "filers"), table(spark, d, "splits"), AS_OF))


def flows(spark, d):
    return staged(spark, d, "flows", lambda: H.fund_flows(changes(spark, d), table(spark, d, "filers")))


def facts(spark, d):
    s = table(spark, d, "securities").select("ticker", "industry", "sector", "market_cap", "adv20", "ret_6m")
    out = flows(spark, d).join(s, "ticker", "left")
    return out.withColumn("label", H.strength(F.col("net"), F.col("top_buyers"), F.col("streak")))


def _rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


_FORMS = ["13F-HR", "13F-HR/A", "SC 13D", "SC 13D/A", "SCHEDULE 13G", "SC 13G/A", "4", "4/A", "8-K", "10-K"]

QUERIES = {
    "fn_01_cik10": lambda s, d: _read(s, d, "supplier").select("s_suppkey", S.cik10(F.col("s_suppkey")).alias("cik")),
    "fn_02_normalize_name": lambda s, d: _read(s, d, "part").select("p_partkey", S.normalize_name(F.concat("p_name", F.lit(" & Co., Holdings (Class A) "), "p_type", F.lit(" Inc."))).alias("name")),
    "fn_03_truncated_name": lambda s, d: _read(s, d, "customer").select("c_custkey", S.truncated(F.concat(F.upper("c_mktsegment"), F.lit(" "), F.substring(F.upper("c_name"), 1, 2))).alias("name")),
    "fn_04_symbol": lambda s, d: _read(s, d, "customer").select("c_custkey", S.symbol(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("/b "))).alias("symbol")),
    "fn_05_figi_id_type": lambda s, d: _read(s, d, "part").select("p_partkey", S.figi_id_type(F.substring(F.concat(F.col("p_partkey").cast("string"), "p_brand"), F.length("p_name") % 4 + 1, 9)).alias("id_type")),
    "fn_06_flags": lambda s, d: _read(s, d, "orders").select(
        "o_orderkey", S.tri_state(F.when(F.col("o_orderstatus") == "F", " True ").when(F.col("o_orderstatus") == "O", "0")).alias("planned"),
        S.has_role(F.concat(F.lit("Officer , "), "o_orderpriority"), "2-high").alias("high"), F.expr("try_cast(substring(o_orderpriority, cast(1 + o_orderkey % 2 AS int), 1) AS int)").alias("number"),
    ),
    "fn_07_quarters": lambda s, d: _read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().select(
        "d", S.quarter_end(F.col("d")).alias("quarter_end"), S.latest_quarter_end(F.col("d")).alias("latest"), S.reporting_quarter(F.col("d")).alias("reporting"), S.season(F.col("d")).alias("season"),
    ),
    "fn_08_month_end": lambda s, d: _read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().select("d", S.month_end(F.col("d"), -2).alias("two_before"), S.month_end(F.col("d"), 0).alias("own")),
    "fn_09_session": lambda s, d: _read(s, d, "events").select("event_id", S.session(F.col("ts")).alias("session")),
    "fn_10_html_to_text": lambda s, d: _read(s, d, "pages").select("page_id", S.html_to_text(F.col("html"), 300).alias("text")),
    "fn_11_items": lambda s, d: _read(s, d, "events").select(
        "event_id", F.array_join(S.item_labels(F.concat(F.col("user_id") % 9 + 1, F.lit(".01, 9.0"), F.col("event_id") % 3)), "|").alias("labels"),
        S.priority_items(F.concat(F.col("user_id") % 9 + 1, F.lit(".01, 9.0"), F.col("event_id") % 3)).alias("priority"),
    ),
    "fn_12_filing_label": lambda s, d: _read(s, d, "orders").select("o_orderkey", S.filing_label(
        F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (F.col("o_orderkey") % len(_FORMS) + 1).cast("int")),
        F.when(F.col("o_orderstatus") == "F", "BUY").when(F.col("o_orderstatus") == "O", "SELL").when(F.col("o_custkey") % 2 == 0, "MIXED"),
    ).alias("label")),
    "fn_13_universe_class": lambda s, d: table(s, d, "securities").groupBy(S.universe_class(F.col("market_cap"), F.col("adv20"), F.col("ret_6m")).alias("class")).agg(F.count("*").alias("n")),
    "src_12_filer_weights": lambda s, d: _rounded(H.filer_weights(table(s, d, "filers")), "weight"),
    "hld_01_effective_holdings": lambda s, d: effective(s, d).select("filing_id", "cik", "period", "cusip", "shares", "value_usd"),
    "hld_02_recent": lambda s, d: H.recent(effective(s, d), table(s, d, "filers"), 2).select("filing_id", "cik", "period", "cusip", "shares", "filer_name", "filed"),
    "hld_03_resolve_tickers": lambda s, d: resolved(s, d).groupBy("cusip", "ticker", "resolved").agg(F.count("*").alias("n"), F.sum("shares").alias("shares")),
    "hld_04_fund_snapshots": snapshots,
    "hld_05_split_factor": lambda s, d: H.with_split_factor(H.filing_pairs(snapshots(s, d)).select("period", "prev_period").distinct().crossJoin(F.broadcast(table(s, d, "securities").select("ticker"))), table(s, d, "splits"), "prev_period", "period").select("period", "prev_period", "ticker", "factor"),
    "hld_06_classify_change": lambda s, d: changes(s, d).groupBy("lag", "event").agg(F.count("*").alias("n")),
    "hld_07_position_changes": lambda s, d: _rounded(changes(s, d), "pct_of_fund"),
    "hld_08_fund_status": lambda s, d: H.fund_status(table(s, d, "filers"), snapshots(s, d), AS_OF).groupBy("status").agg(F.count("*").alias("n")),
    "hld_09_fund_flows": lambda s, d: _rounded(flows(s, d), "weighted_net", "conviction_max", "conviction_sum"),
    "hld_10_streak": lambda s, d: flows(s, d).select("ticker", "streak"),
    "hld_11_strength": lambda s, d: facts(s, d).select("ticker", "net", "label"),
    "hld_12_more_filters": lambda s, d: H.filter_flows(facts(s, d), min_adv=3e6, min_ret=-0.3, max_ret=1.0, watchlist=table(s, d, "insiders").select("ticker")).select("ticker", "net", "adv20", F.round("ret_6m", 6).alias("ret_6m")),
    "hld_12_filters": lambda s, d: H.filter_flows(facts(s, d), min_net=-27, min_cap=1e7).select("ticker", "net", "market_cap", "label"),
    "hld_13_industry_rollup": lambda s, d: H.industry_rollup(facts(s, d)),
    "hld_14_quarter_coverage": lambda s, d: H.quarter_coverage(changes(s, d)),
    "hld_15_stock_pivot": lambda s, d: H.stock_pivot(effective(s, d), table(s, d, "filers")),
    "hld_16_quarter_diff": lambda s, d: H.quarter_diff(effective(s, d)),
    "hld_17_thousands": lambda s, d: _rounded(H.thousands(effective(s, d)), "median"),
    "hld_18_stock_holders": lambda s, d: H.stock_holders(snapshots(s, d), table(s, d, "filers")),
    "hld_19_cusip_queue": lambda s, d: H.cusip_queue(table(s, d, "holdings"), table(s, d, "cusip_map"), AS_OF),
    "hld_20_choose_listing": lambda s, d: H.choose_listing(_read(s, d, "part").select(
        F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string")).alias("cusip"), F.col("p_partkey").alias("position"), (F.col("p_partkey") % 7 == 3).alias("is_us"), "p_name")),
    "hld_21_backfill_tickers": lambda s, d: H.backfill_tickers(table(s, d, "holdings"), H.name_map(table(s, d, "securities"), table(s, d, "cusip_map"))).groupBy("filled").agg(
        F.count("*").alias("n"), F.count_if(F.col("ticker").isNull()).alias("backfilled")),
    "hld_22_held_symbols": lambda s, d: H.held_symbols(table(s, d, "holdings"), table(s, d, "cusip_map")),
    "hld_23_entity_candidates": lambda s, d: H.entity_candidates(_read(s, d, "part").select(
        F.element_at(F.split("p_name", " "), 1).alias("query"), (F.col("p_partkey") % 9).cast("string").alias("cik"), F.concat("p_name", F.lit(" "), "p_type").alias("name"))),
}

_TWO = "SELECT cik, period, row_number() OVER (PARTITION BY cik ORDER BY period DESC) AS k FROM (SELECT DISTINCT cik, period FROM {0}) QUALIFY k <= 2"

_SQL = {
    "fn_01_cik10": "SELECT s_suppkey, lpad(s_suppkey::varchar, 10, '0') AS cik FROM supplier",
    "fn_02_normalize_name": f"SELECT p_partkey, {_NAME('''p_name || ' & Co., Holdings (Class A) ' || p_type || ' Inc.' ''')} AS name FROM part",
    "fn_03_truncated_name": "SELECT c_custkey, regexp_replace(upper(c_mktsegment) || ' ' || substring(upper(c_name), 1, 2), '\\s[A-Z]{1,2}$', '') AS name FROM customer",
    "fn_04_symbol": "SELECT c_custkey, upper(trim(replace(replace(' ' || lower(c_mktsegment) || '.' || c_custkey || '/b ', '/', '-'), '.', '-'))) AS symbol FROM customer",
    "fn_05_figi_id_type": "SELECT p_partkey, CASE WHEN regexp_matches(substring(p_partkey || p_brand, length(p_name) % 4 + 1, 9), '^[A-Za-z]') THEN 'ID_CINS' ELSE 'ID_CUSIP' END AS id_type FROM part",
    "fn_06_flags": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS planned, o_orderpriority = '2-HIGH' AS high,
        try_cast(substring(o_orderpriority, (1 + o_orderkey % 2)::int, 1) AS int) AS number FROM orders""",
    "fn_07_quarters": """SELECT d, q AS quarter_end, CASE WHEN q = d THEN q ELSE p END AS latest,
        CASE WHEN q = d THEN p WHEN p + 45 >= d THEN last_day(p - INTERVAL 3 MONTH) ELSE p END::date AS reporting, year(d) || 'Q' || quarter(d) AS season
        FROM (SELECT d, last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH)::date AS q, (date_trunc('quarter', d)::date - 1)::date AS p FROM (SELECT DISTINCT o_orderdate::date AS d FROM orders))""",
    "fn_08_month_end": "SELECT DISTINCT o_orderdate::date AS d, last_day(date_trunc('month', o_orderdate) - INTERVAL 2 MONTH)::date AS two_before, last_day(o_orderdate)::date AS own FROM orders",
    "fn_09_session": """SELECT event_id, CASE WHEN m = 0 THEN 'unknown' WHEN m < 570 THEN 'bmo' WHEN m >= 960 THEN 'amc' ELSE 'intraday' END AS session
        FROM (SELECT event_id, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS m FROM events)""",
    "fn_10_html_to_text": "SELECT page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 300) AS text FROM pages",
    "fn_11_items": """SELECT event_id, CASE u WHEN 1 THEN '1.01 — Material agreement (M&A, partnership, etc.)' WHEN 2 THEN '2.01 — Acquisition completed' WHEN 7 THEN '7.01 — Reg FD disclosure' WHEN 8 THEN '8.01 — Other material event' WHEN 9 THEN '9.01 — Exhibits (supporting documents)' ELSE u || '.01' END
        || '|' || CASE v WHEN 1 THEN '9.01 — Exhibits (supporting documents)' ELSE '9.0' || v END AS labels, u IN (1, 2, 8) AS priority FROM (SELECT event_id, user_id % 9 + 1 AS u, event_id % 3 AS v FROM events)""",
    "fn_12_filing_label": """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'Quarterly portfolio' WHEN 1 THEN 'Portfolio — amended' WHEN 2 THEN 'Activist stake' WHEN 3 THEN 'Activist stake — updated' WHEN 4 THEN 'Passive 5%+ stake' WHEN 5 THEN 'Passive 5%+ — updated'
        WHEN 8 THEN 'Corporate event' WHEN 9 THEN '10-K' ELSE CASE WHEN o_orderstatus = 'F' THEN 'Insider buy' WHEN o_orderstatus = 'O' THEN 'Insider sell' WHEN o_custkey % 2 = 0 THEN 'Insider buy + sell' ELSE 'Insider trade' END END AS label FROM orders""",
    "fn_13_universe_class": """SELECT CASE WHEN market_cap IS NULL OR ret_6m IS NULL THEN 'untracked' WHEN market_cap < 3e8 OR coalesce(adv20, 0) < 5e6 THEN 'too_illiquid' WHEN ret_6m > 0.6 THEN 'late_stage'
        ELSE 'tradeable' END AS class, count(*) AS n FROM securities GROUP BY 1""",
    "src_12_filer_weights": "SELECT cik, round((multiplier * CASE tier WHEN 'S' THEN 1.5 WHEN 'A' THEN 1.2 WHEN 'C' THEN 0.7 ELSE 1.0 END)::double, 6) AS weight FROM filers",
    "hld_01_effective_holdings": "SELECT filing_id, cik, period, cusip, shares, value_usd FROM effective",
    "hld_02_recent": """SELECT e.filing_id, e.cik, e.period, e.cusip, e.shares, f.filer_name, e.filed FROM (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY period DESC) AS k FROM effective) e
        LEFT JOIN filers f ON f.cik = e.cik WHERE k <= 2""",
    "hld_03_resolve_tickers": "SELECT cusip, ticker, resolved, count(*) AS n, sum(shares)::bigint AS shares FROM resolved GROUP BY cusip, ticker, resolved",
    "hld_04_fund_snapshots": "SELECT cik, period, ticker, shares::bigint AS shares, value_usd, book FROM snapshots",
    "hld_05_split_factor": """SELECT p.*, s.ticker, coalesce((SELECT product(ratio) FROM splits z WHERE z.ticker = s.ticker AND z.split_date > p.prev_period AND z.split_date <= p.period), 1.0) AS factor
        FROM (SELECT DISTINCT a.period, b.period AS prev_period FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period DESC) AS k FROM fund_periods) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period DESC) AS k FROM fund_periods) b ON b.cik = a.cik AND (b.k = a.k + 1 OR (a.k = 1 AND b.k = 3))) p, securities s""",
    "hld_06_classify_change": "SELECT lag::int AS lag, event, count(*) AS n FROM changes GROUP BY ALL",
    "hld_07_position_changes": """SELECT cik, lag::int AS lag, pair_rank::int AS pair_rank, period, prev_period, ticker, event, shares_prev::bigint AS shares_prev, shares_cur::bigint AS shares_cur, factor, value_usd,
        round(pct_of_fund, 6) AS pct_of_fund FROM changes""",
    "hld_08_fund_status": "SELECT status, count(*) AS n FROM status GROUP BY status",
    "hld_09_fund_flows": "SELECT * REPLACE (round(weighted_net, 6) AS weighted_net, round(conviction_max, 6) AS conviction_max, round(conviction_sum, 6) AS conviction_sum) FROM flows",
    "hld_10_streak": "SELECT ticker, streak FROM flows",
    "hld_11_strength": "SELECT ticker, net, label FROM facts",
    "hld_12_more_filters": "SELECT ticker, net, adv20, round(ret_6m, 6) AS ret_6m FROM facts WHERE adv20 >= 3e6 AND ret_6m >= -0.3 AND ret_6m <= 1.0 AND ticker IN (SELECT ticker FROM insiders)",
    "hld_12_filters": "SELECT ticker, net, market_cap, label FROM facts WHERE net >= -27 AND market_cap >= 1e7",
    "hld_13_industry_rollup": """SELECT CASE WHEN trim(coalesce(industry, '')) = '' THEN 'Unclassified' ELSE industry END AS industry, count(*) AS stocks, count(*) FILTER (net > 0) AS bought, count(*) FILTER (net < 0) AS sold,
        sum(net)::bigint AS total_net, min(sector) AS sector, coalesce(array_to_string((list(ticker ORDER BY net DESC, ticker) FILTER (net > 0))[1:3], ','), '') AS top FROM facts GROUP BY 1""",
    "hld_14_quarter_coverage": "SELECT period, count(DISTINCT cik) AS funds FROM changes WHERE lag = 1 AND pair_rank = 0 GROUP BY period",
    "hld_15_stock_pivot": """SELECT cusip, count(*) AS n_funds, sum(shares)::bigint AS shares, sum(value_usd) AS value_usd, min(period) AS first_period, max(period) AS last_period,
        round(100.0 * count(*) / (SELECT count(*) FROM filers WHERE category <> 'corporate'), 4)::double AS pct FROM (
        SELECT e.cusip, e.cik, e.period, sum(e.shares) AS shares, sum(e.value_usd) AS value_usd, row_number() OVER (PARTITION BY e.cusip, e.cik ORDER BY e.period DESC) AS k
        FROM effective e JOIN filers f ON f.cik = e.cik WHERE f.category <> 'corporate' GROUP BY e.cusip, e.cik, e.period) WHERE k = 1 GROUP BY cusip HAVING count(*) >= 2
        ORDER BY n_funds DESC, value_usd DESC, cusip LIMIT 100""",
    "hld_16_quarter_diff": f"""SELECT * FROM (SELECT cik, issuer, now, before, CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'exit' WHEN now >= 1.1 * before THEN 'add' WHEN now <= 0.9 * before THEN 'trim' END AS change
        FROM (SELECT e.cik, {_NAME('e.issuer_name')} AS issuer, sum(shares) FILTER (k = 1)::bigint AS now, sum(shares) FILTER (k = 2)::bigint AS before FROM effective e
              JOIN ({_TWO.format('effective')}) p ON p.cik = e.cik AND p.period = e.period WHERE e.cik IN (SELECT cik FROM effective GROUP BY cik HAVING count(DISTINCT period) >= 2) GROUP BY ALL)) WHERE change IS NOT NULL""",
    "hld_17_thousands": """SELECT t.cik, t.period, (t.total * CASE WHEN m.median < 5 THEN 1000 ELSE 1 END) AS total, t.positions, round(m.median, 6) AS median
        FROM (SELECT cik, period, sum(value_usd) AS total, count(*) AS positions FROM effective GROUP BY ALL) t LEFT JOIN (
        SELECT cik, period, list_sort(list(value_usd::double / shares))[count(*) // 2 + 1] AS median FROM (SELECT *, row_number() OVER (PARTITION BY cik, period ORDER BY value_usd DESC, cusip, shares) AS k
        FROM effective WHERE shares > 0) WHERE k <= 10 GROUP BY cik, period) m ON m.cik = t.cik AND m.period = t.period""",
    "hld_18_stock_holders": f"""SELECT cik, ticker, now, before, CASE WHEN now IS NULL THEN 'exited' WHEN before IS NULL THEN 'new' WHEN now > 1.1 * before THEN 'add' WHEN now < 0.9 * before THEN 'trim' ELSE 'hold' END AS status
        FROM (SELECT s.cik, s.ticker, sum(shares) FILTER (k = 1)::bigint AS now, sum(shares) FILTER (k = 2)::bigint AS before FROM snapshots s JOIN filers f ON f.cik = s.cik
              JOIN ({_TWO.format('snapshots')}) p ON p.cik = s.cik AND p.period = s.period WHERE f.category <> 'corporate' GROUP BY ALL)""",
    "hld_19_cusip_queue": """SELECT * FROM (SELECT h.cusip, h.last_seen, CASE WHEN m.cusip IS NULL THEN 'new' ELSE 'retry' END AS reason, m.resolved_at AS tried
        FROM (SELECT upper(trim(cusip)) AS cusip, max(period) AS last_seen FROM holdings GROUP BY 1) h LEFT JOIN cusip_map m ON m.cusip = h.cusip
        WHERE m.cusip IS NULL OR (m.resolved_via = 'no-match' AND m.resolved_at < date '2001-10-03' - 30)) ORDER BY tried NULLS FIRST, cusip LIMIT 300""",
    "hld_20_choose_listing": """SELECT * FROM (SELECT 'C' || (p_partkey % 50) AS cusip, p_partkey AS position, p_partkey % 7 = 3 AS is_us, p_name FROM part)
        QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY is_us DESC, position) = 1""",
    "hld_21_backfill_tickers": f"""SELECT coalesce(h.ticker, x.by_name, y.by_name) AS filled, count(*) AS n, count(*) FILTER (h.ticker IS NULL) AS backfilled FROM holdings h
        LEFT JOIN names x ON x.name = {_NAME('h.issuer_name')} LEFT JOIN names y ON y.name = regexp_replace({_NAME('h.issuer_name')}, '\\s[A-Z]{{1,2}}$', '') GROUP BY 1""",
    "hld_22_held_symbols": """SELECT DISTINCT upper(trim(replace(replace(ticker, '/', '-'), '.', '-'))) AS symbol FROM (SELECT ticker FROM cusip_map UNION ALL SELECT ticker FROM holdings) WHERE ticker IS NOT NULL AND ticker NOT LIKE '% %'""",
    "hld_23_entity_candidates": """WITH hits AS (SELECT split_part(p_name, ' ', 1) AS query, (p_partkey % 9)::varchar AS cik, p_name || ' ' || p_type AS name FROM part),
        n AS (SELECT query, cik, count(*) AS hits FROM hits WHERE contains(upper(name), upper(query)) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, cik) AS k, lead(hits) OVER (PARTITION BY query ORDER BY hits DESC, cik) AS up FROM n)
        SELECT q.query, r.cik, r.hits, CASE WHEN r.query IS NULL THEN 'no_match' WHEN up IS NULL OR r.hits >= 2 * up THEN 'resolved' ELSE 'ambiguous' END AS status
        FROM (SELECT DISTINCT query FROM hits) q LEFT JOIN r ON r.query = q.query AND k = 1""",
}

SQL = {name: oracle(text, VIEWS) for name, text in _SQL.items()}

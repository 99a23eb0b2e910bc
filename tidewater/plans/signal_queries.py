"""Queries on signals, prices, cost basis and fund-of-index flows, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import etf as E
from ..operators import holdings as H
from ..operators import prices as P
from ..operators import signals as G
from ..sources.bridge import oracle, table
from ..sources.staging import staged
from . import fund_queries as Fund

AS_OF = date(2001, 7, 30)
EARLY = date(1995, 9, 30)
RULES = G.Rules(cap_floor=1e6, score_floor=1.0)
D = "date '2001-07-30'"

VIEWS = Fund.VIEWS | {
    "weights": "SELECT cik, multiplier * CASE tier WHEN 'S' THEN 1.5 WHEN 'A' THEN 1.2 WHEN 'C' THEN 0.7 ELSE 1.0 END AS weight FROM filers",
    "points": f"SELECT cik, resolved AS ticker, period, sum(shares)::bigint AS shares, max(filed) AS filed FROM resolved WHERE filed <= {D} AND resolved IS NOT NULL GROUP BY ALL",
    "latest": """SELECT cik, ticker, shares, prev, n, first, last, filed FROM (SELECT *, lag(shares) OVER w AS prev, count(*) OVER (PARTITION BY cik, ticker) AS n,
        min(period) OVER (PARTITION BY cik, ticker) AS first, max(period) OVER (PARTITION BY cik, ticker) AS last FROM points WINDOW w AS (PARTITION BY cik, ticker ORDER BY period)) WHERE period = last""",
    "fresh": f"""SELECT l.* FROM latest l LEFT JOIN (SELECT cik, max(period) AS newest FROM filings WHERE filed <= {D} GROUP BY cik) f ON f.cik = l.cik
        WHERE (newest IS NULL OR newest <= last) AND last >= {D} - 180""",
    "moved": """SELECT *, round(shares / prev, 1) AS ratio, CASE WHEN coalesce(shares, 0) <= 0 THEN NULL WHEN n = 1 THEN 'new' WHEN coalesce(prev, 0) <= 0 THEN NULL
        WHEN shares / prev >= 2 THEN 'velocity' WHEN shares / prev > 1.2 THEN 'add' END AS move FROM fresh""",
    "starters": "SELECT ticker, count(DISTINCT cik) AS starters FROM fresh WHERE first IN (SELECT DISTINCT last FROM fresh ORDER BY last DESC LIMIT 2) GROUP BY ticker",
    "bought": f"SELECT *, coalesce(reporter_cik, '') AS who FROM insiders WHERE code = 'P' AND date BETWEEN {D} - 30 AND {D} AND filed <= {D}",
    "people": """SELECT p.*, held, CASE WHEN unknown > 0 THEN NULL WHEN held <= 0 THEN 'inf'::double ELSE bought / held END AS growth, CASE WHEN NOT coalesce(inside, false) THEN 'role' WHEN free = 0 THEN 'plan' END AS excluded FROM (
        SELECT ticker, who, max(reporter) AS name, bool_or(is_officer OR is_director) AS inside, count(*) FILTER (is_10b5_1 IS DISTINCT FROM true) AS free, sum(value)::bigint AS value, sum(shares)::bigint AS bought,
               max(date) AS latest, count(*) AS trades FROM bought GROUP BY ticker, who) p
        JOIN (SELECT ticker, who, sum(h)::bigint AS held, sum(u) AS unknown FROM (SELECT ticker, who, direct, max(owned_after - shares) AS h, count(*) FILTER (owned_after IS NULL) AS u FROM bought GROUP BY ALL) GROUP BY ticker, who) x
        ON x.ticker = p.ticker AND x.who = p.who""",
    "clusters": """SELECT ticker, count(*) AS buyers, max(latest) AS last_buy, array_to_string((list(name ORDER BY name))[1:5], '; ') AS names FROM people WHERE excluded IS NULL GROUP BY ticker""",
    "stakers": f"""SELECT s.ticker, count(*) AS stakes, sum(weight)::double AS stake_weight, max(filed) AS last_stake, array_to_string(list_sort(list(DISTINCT s.cik)), '; ') AS filers
        FROM stakes s JOIN weights w ON w.cik = s.cik WHERE subtype = '13D' AND filed BETWEEN {D} - 90 AND {D} GROUP BY s.ticker""",
    "began": "SELECT DISTINCT ticker, cik FROM fresh WHERE first IN (SELECT DISTINCT last FROM fresh ORDER BY last DESC LIMIT 2)",
    "summed": """SELECT ticker, sum("new") AS "new", sum("add") AS "add", sum(velocity) AS velocity, sum(n_moves) AS n_moves, sum(n_velocity) AS n_velocity, sum(stake) AS stake, sum(buyers) AS buyers, sum(starters) AS starters, sum(start_weight) AS start_weight FROM (
        SELECT ticker, CASE WHEN move = 'new' THEN weight ELSE 0 END::double AS "new", CASE WHEN move IN ('add', 'velocity') THEN weight ELSE 0 END::double AS "add", CASE WHEN move = 'velocity' THEN weight ELSE 0 END::double AS velocity, 1 AS n_moves, (move = 'velocity')::int AS n_velocity,
               0::double AS stake, 0::double AS buyers, 0::double AS starters, 0::double AS start_weight FROM moved m JOIN weights w ON w.cik = m.cik WHERE move IS NOT NULL
        UNION ALL SELECT ticker, 0, 0, 0, 0, 0, stake_weight, 0, 0, 0 FROM stakers UNION ALL SELECT ticker, 0, 0, 0, 0, 0, 0, buyers, 0, 0 FROM clusters
        UNION ALL SELECT ticker, 0, 0, 0, 0, 0, 0, 0, 1, weight FROM began b JOIN weights w ON w.cik = b.cik) GROUP BY ticker""",
    "scored": """SELECT * FROM (SELECT *, round(CASE WHEN buyers = 0 THEN 0 WHEN buyers = 1 THEN 1.5 WHEN buyers = 2 THEN 3.5 ELSE 7 + buyers - 3 END + 2 * "new" + 0.5 * "add" + 2 * velocity + 5 * stake
          + CASE WHEN starters >= 3 THEN 1.5 * start_weight ELSE 0 END + CASE WHEN kinds >= 3 THEN 5 ELSE 0 END, 2)::double AS score
        FROM (SELECT *, (buyers >= 2)::int + (n_moves > 0)::int + (stake > 0)::int + (n_velocity > 0)::int + (starters >= 3)::int AS kinds FROM summed WHERE ticker IN (SELECT ticker FROM securities WHERE market_cap >= 1e6)))
        WHERE score >= 1.0""",
    "given_by": f"""SELECT m.ticker, unnest(CASE WHEN move = 'velocity' THEN ['add', 'velocity'] ELSE [move] END) AS kind, coalesce(filer_name, m.cik) AS name, ratio, filed FROM moved m LEFT JOIN filers f ON f.cik = m.cik WHERE move IS NOT NULL
        UNION ALL SELECT ticker, 'activists', filer_name, NULL, filed FROM stakes s JOIN filers f ON f.cik = s.cik WHERE subtype = '13D' AND filed BETWEEN {D} - 90 AND {D}
        UNION ALL SELECT p.ticker, 'insiders', p.name, NULL, b.filed FROM people p JOIN bought b ON b.ticker = p.ticker AND b.who = p.who WHERE excluded IS NULL AND is_10b5_1 IS DISTINCT FROM true""",
    "named_by": """SELECT ticker, kind, array_to_string((list(name ORDER BY name))[1:CASE WHEN kind = 'activists' THEN 3 ELSE 5 END], '; ') AS names FROM (
        SELECT DISTINCT ticker, kind, CASE WHEN kind = 'velocity' THEN name || ' ' || ratio::double ELSE name END AS name FROM given_by
        UNION ALL SELECT ticker, 'excluded', name || ': ' || CASE excluded WHEN 'role' THEN 'not_officer_or_director' WHEN 'plan' THEN '10b5_1_plan' END FROM people WHERE excluded IS NOT NULL) GROUP BY ticker, kind""",
    "report": """SELECT s.ticker, s.score, s.kinds, n.new_by, n.add_by, n.velocity_by, n.activists, n.insiders, n.excluded, g.first_detected, g.latest_signal FROM scored s LEFT JOIN (
        SELECT ticker, max(names) FILTER (kind = 'new') AS new_by, max(names) FILTER (kind = 'add') AS add_by, max(names) FILTER (kind = 'velocity') AS velocity_by, max(names) FILTER (kind = 'activists') AS activists, max(names) FILTER (kind = 'insiders') AS insiders,
               max(names) FILTER (kind = 'excluded') AS excluded FROM named_by GROUP BY ticker) n ON n.ticker = s.ticker
        LEFT JOIN (SELECT ticker, min(filed) AS first_detected, max(filed) AS latest_signal FROM given_by GROUP BY ticker) g ON g.ticker = s.ticker""",
    "back": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars",
    "trail": """SELECT ticker, max(close) FILTER (k = 1) AS last, CASE WHEN max(close) FILTER (k = 64) > 0 THEN max(close) FILTER (k = 1) / max(close) FILTER (k = 64) - 1 END AS ret_63,
        CASE WHEN max(close) FILTER (k = 127) > 0 THEN max(close) FILTER (k = 1) / max(close) FILTER (k = 127) - 1 END AS ret_126,
        CASE WHEN max(close) FILTER (k = 253) > 0 THEN max(close) FILTER (k = 1) / max(close) FILTER (k = 253) - 1 END AS ret_252, avg(close * volume) FILTER (k <= 20) AS adv
        FROM back WHERE k <= 253 GROUP BY ticker HAVING count(*) >= 20""",
    "vwap": """SELECT ticker, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH)::date AS period, CASE WHEN sum(volume) > 0 THEN sum((high + low + close) / 3 * volume) / sum(volume) END AS vwap, count(*) AS bars
        FROM bars WHERE volume > 0 GROUP BY ALL""",
    "added": "SELECT *, greatest(shares - lag(shares, 1, 0) OVER (PARTITION BY cik, ticker ORDER BY period), 0) AS added FROM snapshots",
    "etf_flows": "SELECT * FROM (SELECT *, (shares_out - lag(shares_out) OVER (PARTITION BY ticker ORDER BY date)) * nav AS flow FROM etf_daily) WHERE flow IS NOT NULL",
    "etf_months": "SELECT ticker, last_day(date)::date AS month_end, sum(flow) AS net FROM etf_flows GROUP BY ALL",
    "etf_quarters": """SELECT q.*, net_assets - lag(net_assets) OVER (PARTITION BY ticker ORDER BY period) * (1 + r1 / 100) * (1 + r2 / 100) * (1 + r3 / 100) AS flow FROM (
        SELECT ticker, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH)::date AS period, max_by(nav * shares_out, date)::double AS net_assets, max_by(nav, date) AS nav,
               max_by(nav, date) % 3 - 1 AS r1, max_by(nav, date) % 2 - 0.5 AS r2, max_by(nav, date) % 5 - 2 AS r3 FROM etf_daily GROUP BY ALL) q""",
    "etf_dividends": "SELECT ticker, date, nav % 1 AS amount FROM etf_daily WHERE day(date) = 15",
    "w_daily": "SELECT ticker, sum(flow) AS flow, min(latest) AS as_of, date_diff('day', min(date), max(latest)) AS span FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS latest FROM etf_flows) WHERE date > latest - 90 GROUP BY ticker",
    "w_assets": """SELECT ticker, sum(flow) AS flow, min(latest) AS as_of FROM (SELECT *, aum - lag(aum) OVER w * nav / lag(nav) OVER w AS flow, max(date) OVER (PARTITION BY ticker) AS latest, min(date) OVER (PARTITION BY ticker) AS earliest
        FROM (SELECT ticker, date, nav, nav * shares_out AS aum FROM etf_daily WHERE nav > 0 AND shares_out > 0) WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE date > latest - 90 AND earliest <= latest - 90 GROUP BY ticker""",
    "w_quarters": """SELECT ticker, CASE WHEN count(total) = count(*) THEN sum(total) END AS flow, max(period) AS as_of FROM (
        SELECT q.*, flow + coalesce((SELECT sum(amount) FROM etf_dividends d WHERE d.ticker = q.ticker AND d.date > q.start AND d.date <= q.period), 0) * before / nav_before AS total FROM (
        SELECT *, lag(period) OVER w AS start, lag(net_assets) OVER w AS before, lag(nav) OVER w AS nav_before, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS k FROM etf_quarters WINDOW w AS (PARTITION BY ticker ORDER BY period)) q WHERE k <= 4)
        GROUP BY ticker""",
    "etf_chosen": """SELECT ticker, CASE source WHEN 'daily' THEN df WHEN 'assets' THEN af WHEN 'quarterly' THEN qf ELSE mf END AS flow, CASE source WHEN 'daily' THEN dd WHEN 'assets' THEN ad WHEN 'quarterly' THEN qd ELSE md END AS as_of, source
        FROM (SELECT *, CASE WHEN span >= 89 THEN 'daily' WHEN ad IS NOT NULL THEN 'assets' WHEN qd > md THEN 'quarterly' WHEN md IS NOT NULL THEN 'monthly' WHEN qd IS NOT NULL THEN 'quarterly' END AS source FROM (
        SELECT ticker, d.flow AS df, d.as_of AS dd, span, a.flow AS af, a.as_of AS ad, q.flow AS qf, q.as_of AS qd, m.flow AS mf, m.as_of AS md FROM w_daily d FULL JOIN w_assets a USING (ticker)
        FULL JOIN (SELECT * FROM w_quarters WHERE flow IS NOT NULL) q USING (ticker) FULL JOIN (SELECT * FROM w_months WHERE flow IS NOT NULL) m USING (ticker)))""",
    "etf_months_to": "SELECT *, max(month_end) OVER (PARTITION BY ticker) AS latest FROM etf_months",
    "last_month": "SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker",
    "funds": f"""SELECT *, substr(ticker, 2)::int AS n FROM (SELECT ticker, (sum(net) FILTER (month_end > last_day(latest - INTERVAL 1 MONTH)) / 1e6) % 7 - 3 AS f1, (sum(net) FILTER (month_end > last_day(latest - INTERVAL 3 MONTH)) / 1e6) % 7 - 3 AS f3,
               (sum(net) FILTER (month_end > last_day(latest - INTERVAL 6 MONTH)) / 1e6) % 7 - 3 AS f6 FROM etf_months_to GROUP BY ticker)
        JOIN (SELECT ticker, max_by(close, date) / max_by(close, date) FILTER (date <= last_date - 30) - 1 AS p1 FROM bars JOIN last_month USING (ticker) GROUP BY ticker) USING (ticker)
        JOIN (SELECT ticker, max(close) FILTER (k = 1) / coalesce(max(close) FILTER (k = 64), max_by(close, k)) - 1 AS p3, max(close) FILTER (k = 1) / coalesce(max(close) FILTER (k = 127), max_by(close, k)) - 1 AS p6,
              max(close) FILTER (k = 1) / coalesce(max(close) FILTER (k = 253), max_by(close, k)) - 1 AS p12 FROM back GROUP BY ticker) USING (ticker) LEFT JOIN (SELECT ticker, {D} - as_of AS age FROM etf_chosen) USING (ticker)""",
    "w_months": "SELECT ticker, sum(net) AS flow, min(latest) AS as_of FROM (SELECT *, max(month_end) OVER (PARTITION BY ticker) AS latest FROM etf_months) WHERE month_end > last_day(latest - INTERVAL 3 MONTH) GROUP BY ticker",
}


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def weights(s, d):
    return H.filer_weights(table(s, d, "filers"))


def points(s, d):
    return staged(s, d, "points", lambda: G.trajectories(Fund.resolved(s, d), weights(s, d), AS_OF))


def fresh(s, d):
    return staged(s, d, "fresh", lambda: G.not_stale(G.latest_points(points(s, d)), table(s, d, "filings"), AS_OF, RULES))


def people(s, d):
    return G.insider_people(table(s, d, "insiders"), AS_OF, RULES)


def clusters(s, d):
    return G.insider_clusters(people(s, d))


def stakers(s, d):
    return G.activists(table(s, d, "stakes"), weights(s, d), AS_OF, RULES)


def scored(s, d):
    return staged(s, d, "scored", lambda: G.scores(G.moves(fresh(s, d)), G.starters(fresh(s, d)), clusters(s, d), stakers(s, d), weights(s, d), table(s, d, "securities"), RULES))


def early_fresh(s, d):
    """Positions as of a day when funds had just begun to file."""
    points = G.trajectories(Fund.resolved(s, d), weights(s, d), EARLY)
    return G.not_stale(G.latest_points(points), table(s, d, "filings"), EARLY, RULES)


def report(s, d):
    return staged(s, d, "report", lambda: G.score_report(scored(s, d), G.moves(fresh(s, d)), table(s, d, "stakes"), people(s, d), table(s, d, "insiders"), table(s, d, "filers"), AS_OF, RULES))


def bars(s, d):
    return table(s, d, "bars")


def vwap(s, d):
    return P.quarter_vwap(bars(s, d))


def added(s, d):
    return P.added_shares(Fund.snapshots(s, d))


def etf_flows(s, d):
    return E.issuer_flows(table(s, d, "etf_daily"))


def etf_months(s, d):
    return etf_flows(s, d).groupBy("ticker", F.last_day("date").alias("month_end")).agg(F.sum("flow").alias("net"))


def etf_quarters(s, d):
    from ..functions.scalars import quarter_end

    nav = F.max_by("nav", "date")
    q = table(s, d, "etf_daily").groupBy("ticker", quarter_end(F.col("date")).alias("period")).agg(
        F.max_by(F.col("nav") * F.col("shares_out"), "date").alias("net_assets"), nav.alias("nav"), F.array(nav % 3 - 1, nav % 2 - 0.5, nav % 5 - 2).alias("returns"))
    return E.solved_flows(q)


def dividends(s, d):
    return table(s, d, "etf_daily").where(F.dayofmonth("date") == 15).select("ticker", "date", (F.col("nav") % 1).alias("amount"))


def assets(s, d):
    return table(s, d, "etf_daily").select("ticker", "date", "nav", (F.col("nav") * F.col("shares_out")).alias("aum"))


def choice(s, d):
    return E.choose_source(E.daily_window(etf_flows(s, d), 90), E.asset_window(assets(s, d), 90), E.quarterly_window(etf_quarters(s, d), dividends(s, d), 4), E.monthly_window(etf_months(s, d), 3), 90)


def metrics(s, d):
    """Flow and return of three horizons by ticker, in rough units for the rules."""
    m = etf_months(s, d)
    f = lambda n, c: E.monthly_window(m, n).select("ticker", (F.col("flow") / F.lit(1e6) % 7 - 3).alias(c))
    r = P.fund_returns(bars(s, d))
    ages = choice(s, d).select("ticker", F.datediff(F.lit(AS_OF), "as_of").alias("age"))
    out = f(1, "f1").join(f(3, "f3"), "ticker").join(f(6, "f6"), "ticker").join(r, "ticker").join(P.as_of_returns(bars(s, d), (30,)), "ticker").join(ages, "ticker", "left")
    return out.select("ticker", "f1", "f3", "f6", "age", F.col("ret_30d").alias("p1"), F.col("ret_63").alias("p3"), F.col("ret_126").alias("p6"), F.col("ret_252").alias("p12"))


def themes(s, d):
    """A theme for each ticker, by its number."""
    n = F.substring("ticker", 2, 9).cast("int")
    return table(s, d, "securities").select("ticker", F.element_at(F.array(*[F.lit(t) for t in E.THEMES]), n % len(E.THEMES) + 1).alias("theme"))


def _log_filings(s, d):
    t = table(s, d, "insiders").select("accession", F.lit("4").alias("form_type"), "filed", F.col("reporter").alias("who"))
    return t.unionByName(table(s, d, "filings").select("accession", "form_type", "filed", F.col("cik").alias("who")))


QUERIES = {
    "sig_01_trajectories": points,
    "sig_02_not_stale": lambda s, d: fresh(s, d).select("cik", "ticker", "first", "last", "shares"),
    "sig_03_moves": lambda s, d: G.moves(fresh(s, d)).select("cik", "ticker", "ratio", "move"),
    "sig_04_cross_quarter": lambda s, d: G.cross_quarter(early_fresh(s, d)),
    "sig_05_insider_cluster": lambda s, d: people(s, d).groupBy("ticker").agg(F.count("*").alias("buyers"), F.sum("trades").alias("trades")),
    "sig_06_insider_filters": lambda s, d: people(s, d).select("ticker", "who", "excluded", "value"),
    "sig_07_stake_growth": lambda s, d: _r(people(s, d).select("ticker", "who", "bought", "held", F.when(F.col("growth") < 1e300, F.col("growth")).alias("growth")), "growth"),
    "sig_08_activists": lambda s, d: _r(stakers(s, d), "stake_weight"),
    "sig_09_report": lambda s, d: report(s, d),
    "sig_09_page": lambda s, d: G.score_page(report(s, d), 5.0, "latest_signal").select("place", "ticker", "score", "latest_signal"),
    "sig_09_scores": lambda s, d: scored(s, d).select("ticker", "buyers", "starters", "kinds", "score"),
    "sig_10_extras": lambda s, d: G.extras(clusters(s, d), stakers(s, d)),
    "sig_11_enriched": lambda s, d: _r(G.enriched(scored(s, d).select("ticker", "score"), P.trailing_returns(bars(s, d)).select("ticker", "last", "ret_126").join(P.ytd_return(bars(s, d), AS_OF), "ticker", "left")), "last", "ret_126", "ytd"),
    "sig_12_cluster_page": lambda s, d: G.cluster_page(table(s, d, "insiders"), AS_OF),
    "sig_13_notable_sales": lambda s, d: G.notable_sales(table(s, d, "insiders"), floor=2e5).select("accession", "ticker", "filed", "shares"),
    "sig_14_filings_log": lambda s, d: G.filings_log(_log_filings(s, d), table(s, d, "insiders")).select("accession", "form_type", "filed", "direction", "ticker"),
    "sig_15_held_activity": lambda s, d: G.held_activity(table(s, d, "securities").where("n % 2 = 0").select("ticker"), table(s, d, "insiders"), table(s, d, "stakes"), Fund.changes(s, d), scored(s, d), AS_OF),
    "sig_16_dossier": lambda s, d: G.dossier(table(s, d, "insiders"), table(s, d, "stakes")).select("ticker", "kind", F.col("at").alias("day"), "line", "k"),
    "sig_17_signal_diff": lambda s, d: G.signal_diff(
        scored(s, d).select("ticker", F.floor("score").alias("score"), "kinds").where("ticker <> 'T2'"), scored(s, d).select("ticker", F.when(F.col("kinds") > 1, F.floor("score")).otherwise(-1).alias("score"), "kinds").where("ticker <> 'T4'"),
        table(s, d, "securities").select("ticker", F.when(F.col("n") % 3 == 0, "amendment").otherwise("insiders").alias("cause")).where("ticker <> 'T1'")),
    "prc_01_trailing_returns": lambda s, d: _r(P.trailing_returns(bars(s, d)), "last", "ret_63", "ret_126", "ret_252", "adv", n=5),
    "prc_02_fund_returns": lambda s, d: _r(P.fund_returns(bars(s, d), (63, 100000)), "ret_63", "ret_100000"),
    "prc_03_splits": lambda s, d: P.splits_of(bars(s, d).withColumn("ratio", F.when(F.dayofmonth("date") == 3, 2.0).otherwise(0.0))),
    "prc_04_as_of_returns": lambda s, d: _r(P.as_of_returns(bars(s, d)), "ret_7d", "ret_30d"),
    "prc_05_calendar_universe": lambda s, d: P.calendar_universe(table(s, d, "securities"), H.held_symbols(table(s, d, "holdings"), table(s, d, "cusip_map")).withColumnRenamed("symbol", "ticker"), 1e9),
    "prc_06_next_event": lambda s, d: P.next_event(table(s, d, "reports"), AS_OF),
    "prc_07_quarter_vwap": lambda s, d: _r(vwap(s, d), "vwap"),
    "prc_08_missing_vwap": lambda s, d: P.missing_vwap(added(s, d), vwap(s, d)),
    "prc_09_accumulations": lambda s, d: P.accumulations(added(s, d), vwap(s, d)).select("cik", "ticker", "as_of", F.round("total_cost", 2).alias("total_cost"), "total_bought", F.size("accumulations").cast("long").alias("quarters"),
        F.array_join(F.transform("accumulations", lambda a: F.concat_ws(":", a["period"], a["delta_shares"])), ",").alias("parts"), F.aggregate("accumulations", F.lit(0).cast("decimal(28,2)"), lambda t, a: (t + a["contribution_usd"].cast("decimal(18,2)")).cast("decimal(28,2)")).cast("double").alias("parts_usd")),
    "prc_09_cost_basis": lambda s, d: _r(P.cost_basis(added(s, d), vwap(s, d)), "cost"),
    "prc_10_clone_returns": lambda s, d: _r(P.clone_returns(Fund.snapshots(s, d), vwap(s, d), P.trailing_returns(bars(s, d)), 4, 0.3), "coverage", "gain"),
    "etf_01_issuer_flows": lambda s, d: _r(etf_flows(s, d).select("ticker", "date", "flow"), "flow", n=4),
    "etf_02_solved_flows": lambda s, d: _r(etf_quarters(s, d).select("ticker", "period", "net_assets", "flow"), "net_assets", "flow", n=3),
    "etf_03_daily_window": lambda s, d: _r(E.daily_window(etf_flows(s, d), 90), "flow", n=3),
    "etf_04_asset_window": lambda s, d: _r(E.asset_window(assets(s, d), 90), "flow", n=3),
    "etf_05_quarterly_window": lambda s, d: _r(E.quarterly_window(etf_quarters(s, d), dividends(s, d), 4), "flow", n=2),
    "etf_06_monthly_window": lambda s, d: _r(E.monthly_window(etf_months(s, d), 3), "flow", n=3),
    "etf_07_choose_source": lambda s, d: _r(choice(s, d), "flow", n=2),
    "etf_08_readings": lambda s, d: metrics(s, d).select("ticker", E.reading(F.col("f1"), F.col("f3"), F.col("f6"), F.col("p1"), F.col("p3"), F.col("p6"), F.col("p12")).alias("reading"), E.freshness(F.col("age")).alias("freshness")),
    "etf_08_picks": lambda s, d: E.insight_picks(metrics(s, d)),
    "etf_08_rotating": lambda s, d: E.rotating(metrics(s, d)).select("way", "ticker"),
    "etf_08_themes": lambda s, d: _r(E.by_theme(metrics(s, d), themes(s, d)), "f1"),
}

_SQL = {
    "sig_01_trajectories": "SELECT * FROM points",
    "sig_02_not_stale": "SELECT cik, ticker, first, last, shares FROM fresh",
    "sig_03_moves": "SELECT cik, ticker, ratio, move FROM moved WHERE move IS NOT NULL",
    "sig_04_cross_quarter": "SELECT * FROM starters",
    "sig_05_insider_cluster": "SELECT ticker, count(*) AS buyers, sum(trades)::bigint AS trades FROM people GROUP BY ticker",
    "sig_06_insider_filters": "SELECT ticker, who, excluded, value FROM people",
    "sig_07_stake_growth": "SELECT ticker, who, bought, held, CASE WHEN growth < 1e300 THEN round(growth, 6) END AS growth FROM people",
    "sig_08_activists": "SELECT * REPLACE (round(stake_weight, 6) AS stake_weight) FROM stakers",
    "sig_09_report": "SELECT * FROM report",
    "sig_09_page": "SELECT row_number() OVER (ORDER BY latest_signal DESC NULLS LAST, score DESC, ticker) AS place, ticker, score, latest_signal FROM report WHERE score >= 5",
    "sig_09_scores": "SELECT ticker, buyers, starters, kinds, score FROM scored",
    "sig_10_extras": "SELECT coalesce(c.ticker, s.ticker) AS ticker, coalesce(buyers, 0) AS buyers, names, filers, last_stake FROM clusters c FULL JOIN stakers s ON s.ticker = c.ticker",
    "sig_11_enriched": """SELECT s.ticker, s.score, round(t.last, 6) AS last, round(ret_126, 6) AS ret_126, round(ytd, 6) AS ytd FROM (SELECT * FROM scored ORDER BY score DESC, ticker LIMIT 200) s LEFT JOIN trail t ON t.ticker = s.ticker
        LEFT JOIN (SELECT ticker, max_by(close, date) / min_by(close, date) - 1 AS ytd FROM bars WHERE date BETWEEN date '2001-01-01' AND date '2001-07-30' GROUP BY ticker) y ON y.ticker = t.ticker""",
    "sig_12_cluster_page": """SELECT ticker, count(*) AS buyers, sum(v)::bigint AS value, sum(n)::bigint AS shares, min(a) AS first, max(b) AS last, array_to_string(list(name ORDER BY name), '; ') AS names FROM (
        SELECT ticker, reporter_cik, sum(value) AS v, sum(shares) AS n, min(date) AS a, max(date) AS b, max(reporter) AS name FROM insiders WHERE code = 'P' AND date BETWEEN date '2001-06-30' AND date '2001-07-30' GROUP BY ALL) GROUP BY ticker HAVING count(*) >= 3""",
    "sig_13_notable_sales": """SELECT accession, ticker, filed, shares FROM (SELECT * FROM insiders WHERE code = 'S' ORDER BY filed DESC, accession DESC LIMIT 500) WHERE shares * price >= 2e5 ORDER BY filed DESC, accession DESC LIMIT 30""",
    "sig_14_filings_log": """SELECT l.accession, form_type, filed, direction, ticker FROM (SELECT * FROM (SELECT accession, '4' AS form_type, filed FROM insiders UNION ALL SELECT accession, form_type, filed FROM filings) ORDER BY filed DESC, accession DESC LIMIT 50) l
        LEFT JOIN (SELECT accession, min(ticker) AS ticker, CASE WHEN bool_or(code = 'P') AND bool_or(code = 'S') THEN 'MIXED' WHEN bool_or(code = 'P') THEN 'BUY' WHEN bool_or(code = 'S') THEN 'SELL' END AS direction FROM insiders GROUP BY accession) d
        ON d.accession = l.accession""",
    "sig_15_held_activity": f"""SELECT h.ticker, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells, coalesce(adds, 0) AS adds, coalesce(trims, 0) AS trims, last_trade, last_stake, score,
        coalesce(buys, 0) + coalesce(sells, 0) > 0 OR last_stake IS NOT NULL AS active, greatest(last_trade, last_stake) AS latest FROM (SELECT ticker FROM securities WHERE n % 2 = 0) h
        LEFT JOIN (SELECT ticker, count(*) FILTER (code = 'P') AS buys, count(*) FILTER (code = 'S') AS sells, max(date) FILTER (code IN ('P', 'S')) AS last_trade FROM insiders WHERE date BETWEEN {D} - 90 AND {D} GROUP BY ticker) i ON i.ticker = h.ticker
        LEFT JOIN (SELECT ticker, max(filed) AS last_stake FROM stakes WHERE filed BETWEEN {D} - 90 AND {D} GROUP BY ticker) s ON s.ticker = h.ticker
        LEFT JOIN (SELECT ticker, count(*) FILTER (event IN ('opened', 'added')) AS adds, count(*) FILTER (event IN ('trimmed', 'exited')) AS trims FROM changes WHERE lag = 1 AND pair_rank = 0 GROUP BY ticker) c ON c.ticker = h.ticker
        LEFT JOIN scored x ON x.ticker = h.ticker""",
    "sig_16_dossier": """SELECT ticker, kind, day, line, k FROM (SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY day DESC, id) AS k FROM (
        SELECT ticker, CASE code WHEN 'P' THEN 'buy' ELSE 'sell' END AS kind, date AS day, reporter || ' ' || shares AS line, accession AS id FROM insiders WHERE code IN ('P', 'S')
        UNION ALL SELECT ticker, 'stake', filed, cik || ' ' || subtype, filing_id FROM stakes)) WHERE k <= 6""",
    "sig_17_signal_diff": """SELECT ticker, kind, fields, coalesce(causes, 'UNATTRIBUTED') AS causes FROM (SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NULL THEN 'added' WHEN b.ticker IS NULL THEN 'removed'
            WHEN a.score <> b.score THEN 'changed' END AS kind, CASE WHEN a.score <> b.score THEN 'score' END AS fields
        FROM (SELECT ticker, floor(score) AS score FROM scored WHERE ticker <> 'T2') a FULL JOIN (SELECT ticker, CASE WHEN kinds > 1 THEN floor(score) ELSE -1 END AS score FROM scored WHERE ticker <> 'T4') b ON b.ticker = a.ticker) x
        LEFT JOIN (SELECT ticker AS t, CASE WHEN n % 3 = 0 THEN 'amendment' ELSE 'insiders' END AS causes FROM securities WHERE ticker <> 'T1') c ON t = x.ticker WHERE kind IS NOT NULL""",
    "prc_01_trailing_returns": "SELECT ticker, round(last, 5) AS last, round(ret_63, 5) AS ret_63, round(ret_126, 5) AS ret_126, round(ret_252, 5) AS ret_252, round(adv, 5) AS adv FROM trail",
    "prc_02_fund_returns": "SELECT ticker, round(max(close) FILTER (k = 1) / coalesce(max(close) FILTER (k = 64), max_by(close, k)) - 1, 6) AS ret_63, round(max(close) FILTER (k = 1) / max_by(close, k) - 1, 6) AS ret_100000 FROM back GROUP BY ticker",
    "prc_03_splits": "SELECT ticker, date AS split_date, 2.0::double AS ratio FROM bars WHERE day(date) = 3",
    "prc_04_as_of_returns": """SELECT ticker, round(max_by(close, date) / max_by(close, date) FILTER (date <= last - 7) - 1, 6) AS ret_7d, round(max_by(close, date) / max_by(close, date) FILTER (date <= last - 30) - 1, 6) AS ret_30d
        FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM bars) GROUP BY ticker""",
    "prc_05_calendar_universe": """SELECT t.ticker, s.market_cap, t.ticker IN (SELECT ticker FROM cusip_map UNION SELECT ticker FROM holdings WHERE ticker IS NOT NULL) AS held
        FROM (SELECT ticker FROM securities WHERE market_cap >= 1e9 UNION SELECT ticker FROM cusip_map UNION SELECT ticker FROM holdings WHERE ticker IS NOT NULL) t LEFT JOIN securities s ON s.ticker = t.ticker""",
    "prc_06_next_event": f"SELECT ticker, coalesce(min(date) FILTER (date >= {D}), max(date)) AS next FROM reports GROUP BY ticker",
    "prc_07_quarter_vwap": "SELECT ticker, period, round(vwap, 6) AS vwap, bars FROM vwap",
    "prc_08_missing_vwap": "SELECT DISTINCT ticker, period FROM added a WHERE added > 0 AND NOT EXISTS (SELECT 1 FROM vwap v WHERE v.ticker = a.ticker AND v.period = a.period)",
    "prc_09_accumulations": """SELECT p.cik, p.ticker, h.as_of, round(sum(added * vwap), 2) AS total_cost, sum(added)::bigint AS total_bought, count(*) AS quarters, string_agg(p.period || ':' || added, ',' ORDER BY p.period) AS parts, sum(round(added * vwap, 2)::decimal(18,2))::double AS parts_usd
        FROM (SELECT a.*, v.vwap FROM added a JOIN vwap v ON v.ticker = a.ticker AND v.period = a.period WHERE added > 0 AND vwap IS NOT NULL) p
        JOIN (SELECT cik, ticker, max_by(shares, period) AS shares, max(period) AS as_of FROM added GROUP BY ALL) h ON h.cik = p.cik AND h.ticker = p.ticker WHERE h.shares > 0 GROUP BY p.cik, p.ticker, h.as_of""",
    "prc_09_cost_basis": """SELECT * FROM (SELECT a.cik, a.ticker, round(sum(added * vwap) / sum(added) FILTER (vwap IS NOT NULL AND added > 0), 6)::double AS cost, max_by(shares, a.period)::bigint AS shares, min(a.period) AS first_seen,
        count(*) FILTER (vwap IS NOT NULL AND added > 0) AS quarters FROM added a LEFT JOIN vwap v ON v.ticker = a.ticker AND v.period = a.period GROUP BY ALL) WHERE shares > 0 AND quarters > 0""",
    "prc_10_clone_returns": """SELECT cik, round(coalesce(covered / total, 0), 6) AS coverage, CASE WHEN covered / total >= 0.3 THEN round(gains / covered, 6) END AS gain FROM (
        SELECT cik, sum(v) AS total, sum(v) FILTER (gain IS NOT NULL) AS covered, sum(v * gain) AS gains FROM (SELECT cik, v, CASE WHEN last > 0.5 AND entry IS NOT NULL THEN least(greatest(last / entry - 1, -0.9), 4.0) END AS gain FROM (
        SELECT s.cik, s.value_usd::double AS v, t.last, coalesce(CASE WHEN vwap > 0.5 THEN vwap END, CASE WHEN m > 0.5 AND m < 100000 THEN m END, CASE WHEN m * 1e3 > 0.5 AND m * 1e3 < 100000 THEN m * 1e3 END,
            CASE WHEN m * 1e6 > 0.5 AND m * 1e6 < 100000 THEN m * 1e6 END, CASE WHEN m * 1e9 > 0.5 AND m * 1e9 < 100000 THEN m * 1e9 END) AS entry
        FROM (SELECT *, CASE WHEN shares > 0 THEN value_usd::double / shares END AS m FROM snapshots) s JOIN (SELECT cik, period FROM (SELECT cik, period, row_number() OVER (PARTITION BY cik ORDER BY period DESC) - 1 AS k FROM fund_periods) WHERE k = 4) p
          ON p.cik = s.cik AND p.period = s.period LEFT JOIN vwap w ON w.ticker = s.ticker AND w.period = s.period LEFT JOIN trail t ON t.ticker = s.ticker)) GROUP BY cik)""",
    "etf_01_issuer_flows": "SELECT ticker, date, round(flow, 4) AS flow FROM etf_flows",
    "etf_02_solved_flows": "SELECT ticker, period, round(net_assets, 3) AS net_assets, round(flow, 3) AS flow FROM etf_quarters",
    "etf_03_daily_window": "SELECT * REPLACE (round(flow, 3) AS flow) FROM w_daily",
    "etf_04_asset_window": "SELECT * REPLACE (round(flow, 3) AS flow) FROM w_assets",
    "etf_05_quarterly_window": "SELECT * REPLACE (round(flow, 2) AS flow) FROM w_quarters",
    "etf_06_monthly_window": "SELECT * REPLACE (round(flow, 3) AS flow) FROM w_months",
    "etf_07_choose_source": "SELECT * REPLACE (round(flow, 2) AS flow) FROM etf_chosen",
    "etf_08_picks": """SELECT 'fresh inflow' AS pick, arg_max(ticker, (f1, -n)) AS ticker FROM funds WHERE f1 > 3 HAVING count(*) > 0 UNION ALL SELECT 'fresh outflow', arg_min(ticker, (f1, n)) FROM funds WHERE f1 < -2 HAVING count(*) > 0
        UNION ALL SELECT 'flipped in', arg_min(ticker, (f6, n)) FROM funds WHERE f1 > 1 AND f6 < -1 HAVING count(*) > 0 UNION ALL SELECT 'flipped out', arg_max(ticker, (f6, -n)) FROM funds WHERE f1 < -1 AND f6 > 1 HAVING count(*) > 0
        UNION ALL SELECT 'distribution', arg_min(ticker, (f1, n)) FROM funds WHERE p1 > 0.03 AND f1 < -1 HAVING count(*) > 0 UNION ALL SELECT 'accumulation', arg_max(ticker, (f1, -n)) FROM funds WHERE p1 < -0.03 AND f1 > 1 HAVING count(*) > 0""",
    "etf_08_rotating": """SELECT * FROM (SELECT 'in' AS way, ticker FROM funds WHERE f1 > 2 AND f1 > f6 ORDER BY f1 DESC, ticker LIMIT 8) UNION ALL SELECT * FROM (SELECT 'out', ticker FROM funds WHERE f1 < -1.5 AND f1 < f6 ORDER BY f1, ticker LIMIT 8)""",
    "etf_08_themes": f"""SELECT theme, list_position({list(E.THEMES)}, theme) AS group_place, row_number() OVER (PARTITION BY theme ORDER BY f1 DESC NULLS LAST, ticker) AS place, ticker, round(f1, 6) AS f1
        FROM (SELECT *, ({list(E.THEMES)})[substr(ticker, 2)::int % 5 + 1] AS theme FROM funds)""",
    "etf_08_readings": """SELECT ticker, CASE WHEN f1 > 1 AND f6 < -1 THEN 'rotated in' WHEN f1 < -1 AND f6 > 1 THEN 'rotated out' WHEN p6 > 0.2 AND p3 > 0.1 AND f1 > 3 THEN 'crowded' WHEN p > 0.02 AND f > 1 AND p12 > 0.05 THEN 'leader'
        WHEN p > 0.02 AND f < -1 THEN 'distribution' WHEN p < -0.02 AND f > 1 THEN 'accumulation' WHEN p < -0.02 AND f < -1 THEN 'capitulation' WHEN p > 0.02 AND f3 < f6 - 3 AND f3 < 2 THEN 'fading' ELSE 'neutral' END AS reading,
        CASE WHEN age IS NULL THEN 'none' WHEN age <= 7 THEN 'live' WHEN age <= 90 THEN 'quarterly' ELSE 'bulk' END AS freshness FROM (SELECT *, CASE WHEN p1 IS NOT NULL THEN f1 ELSE f3 END AS f, coalesce(p1, p3) AS p FROM funds)""",
}

_EARLY = {name: text.replace(D, "date '1995-09-30'") for name, text in VIEWS.items()}
SQL = {name: oracle(text, _EARLY if name == "sig_04_cross_quarter" else VIEWS) for name, text in _SQL.items()}

"""Queries on the rotation sleeve, ledgers, event studies and the scan, with SQL where it can express them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import events as V
from ..operators import explore as X
from ..operators import rotation as R
from ..operators import scan as C
from ..sources.bridge import oracle, table
from ..sources.staging import staged
from . import signal_queries as Sig

AS_OF = date(2001, 7, 30)
SPLIT = date(1998, 6, 1)
CORE = [f"T{i}" for i in range(6)]
_CORE = ", ".join(f"'{t}'" for t in CORE)
OUTCOMES = ["react", "week", "drift", "size"]
TRADE, HOLDS = 5, ["skip", "through", "after5"]
#: The given tables hold no effects, so the query looks at a wider level than the default of 0.10.
INDUSTRY, LEVEL = 60, 0.9

_PEERS = (
    "CASE WHEN f.{0} IS NOT NULL AND f.entry_date IS NOT NULL THEN count(p.react) FILTER (p.{0} = f.{0}) END AS {1}, avg(p.react) FILTER (p.{0} = f.{0}) AS {2}"
)


def _shaped(rows, first, last):
    """Patterns of daily changes x."""
    half = first + (last - first + 1) // 2
    return f"""SELECT ticker, date, CASE WHEN count(x) < {last - first + 1} THEN [] ELSE list_filter([CASE WHEN count(*) FILTER (x > 0) >= 7 THEN 'up_days' END, CASE WHEN count(*) FILTER (x < 0) >= 7 THEN 'down_days' END, CASE WHEN max(x) FILTER (k = {last}) > 0.03 THEN 'jump_last' END,
        CASE WHEN max(x) FILTER (k = {last}) < -0.03 THEN 'drop_last' END, CASE WHEN product(1 + x) FILTER (k < {half}) < 1 AND product(1 + x) FILTER (k >= {half}) > 1 THEN 'dip_recover' END, CASE WHEN product(1 + x) FILTER (k < {half}) > 1 AND product(1 + x) FILTER (k >= {half}) < 1 THEN 'rally_fade' END,
        CASE WHEN abs(product(1 + x) - 1) < 0.02 AND max(abs(x)) <= 0.02 THEN 'quiet' END], lambda x: x IS NOT NULL) END AS shapes FROM {rows} WHERE k BETWEEN {first} AND {last} GROUP BY ALL"""


def _gaps(first, last):
    return f"""SELECT ticker, date, (avg(range / 100000) FILTER (k >= {first} AND k <= {last})) / CASE WHEN count(range) FILTER (k < {first}) >= 5 AND avg(range) FILTER (k < {first}) > 0 THEN avg(range / 100000) FILTER (k < {first}) END AS range_ratio,
        max(gap) FILTER (k = {last}) / 100000 AS gap_last, count(*) FILTER (abs(gap) >= 2000 AND k BETWEEN {first} AND {last}) AS gaps_big FROM gapped GROUP BY ALL"""


def _analysts(last):
    near = f"k > {last - 21} AND k <= {last}"
    return f"""SELECT ticker, date, (count(*) FILTER ({near}))::int AS an_n, (count(*) FILTER ({near} AND code = 'up'))::int AS an_up, (count(*) FILTER ({near} AND code = 'down'))::int AS an_down, (count(*) FILTER ({near} AND code = 'init'))::int AS an_init,
        (count(*) FILTER ({near} AND pt > 0) - count(*) FILTER ({near} AND pt < 0))::int AS pt_net, avg(pt / 16) FILTER ({near} AND pt <> 0) AS pt_avg FROM acts GROUP BY ALL"""


def _feats(first, last, entry, outcomes):
    """A row a report: moves less the benchmark's, over the days before and each outcome's."""
    spans = {"pre": (first, last), "react": (0, 0)} | outcomes
    ks = sorted({k for a, z in spans.values() for k in (a - 1, z)})
    b = lambda k: f"b{k}".replace("-", "m")
    own = ", ".join(f"CASE WHEN count(v) FILTER (k BETWEEN {a} AND {z}) = {z - a + 1} THEN product(1 + v / 100000) FILTER (k BETWEEN {a} AND {z}) - 1 END AS {o}" for o, (a, z) in spans.items())
    less = ", ".join(f"d.{o} - ({b(z)}.close / {b(a - 1)}.close - 1) AS {o}" for o, (a, z) in spans.items())
    joins = " ".join(f"LEFT JOIN bx {b(k)} ON {b(k)}.idx = r.ridx + {k}" for k in ks)
    return f"""SELECT *, abs(react) AS size, lag(react) OVER (PARTITION BY ticker ORDER BY rdate) AS prev_react FROM (SELECT d.ticker, d.date, r.ridx, r.session, r.surprise, c.date AS rdate, x.date AS entry_date, date_trunc('week', c.date)::date AS week_id,
        regexp_extract(s.industry, '([^ ]+)$', 1) AS industry, s.sector, {less} FROM (SELECT ticker, date, {own} FROM daily GROUP BY ALL) d JOIN reacted r ON r.ticker = d.ticker AND r.date = d.date JOIN cal c ON c.idx = r.ridx LEFT JOIN cal x ON x.idx = r.ridx - {entry}
        JOIN securities s ON s.ticker = d.ticker {joins})"""


def _erfc(t):
    """The operator's fit of the two-sided normal p-value."""
    z, poly = f"(abs({t}) / sqrt(2.0))", repr(C.ERFC[-1])
    r = f"(1 / (1 + {z} / 2))"
    for k in C.ERFC[-2::-1]:
        poly = f"({k!r}::double + {r} * {poly})"
    return f"{r} * exp({poly} - {z} * {z})"


_LIMITS = [(f, k, " AND ".join([f"{x} >= {a}"] * (a is not None) + [f"{x} < {z}"] * (z is not None))) for f, keys in C.BANDS.items() for k, (x, a, z) in keys.items()]
_MORE = [
    ("move", "pre_flat", "abs(pre) < 0.03"), ("time", "sess_bmo", "f.session IS DISTINCT FROM 'amc'"), ("time", "sess_amc", "f.session = 'amc'"), ("trend", "ma50_up", "ma50_gap > 0"), ("trend", "ma50_down", "ma50_gap <= 0"), ("trend", "ma200_up", "ma200_gap > 0"),
    ("trend", "ma200_down", "ma200_gap <= 0"), ("peers", "peers_up", "peer_n >= 2 AND peer_react >= 0.02"), ("peers", "peers_down", "peer_n >= 2 AND peer_react <= -0.02"), ("peers", "sector_peers_up", "sector_n >= 3 AND sector_react >= 0.01"),
    ("peers", "sector_peers_down", "sector_n >= 3 AND sector_react <= -0.01"), ("analysts", "an_net_pos", "an_up > an_down"), ("analysts", "an_net_neg", "an_down > an_up"), ("analysts", "pt_avg_up", "pt_avg > 0.05"), ("analysts", "pt_avg_down", "pt_avg < -0.05"),
    ("gaps", "range_calm", "range_ratio <= 0.8"), ("gaps", "gap_down_last", "gap_last <= -0.02"), ("previous", "prev_up", "prev_react > 0.05"), ("previous", "prev_down", "prev_react < -0.05"),
]
_ALL = _LIMITS + [("size", f"tier_{t}", f"tier = '{t}'") for t in C.TIERS] + [("shape", f"shape_{x}", f"list_contains(shapes, '{x}')") for x in C.SHAPES] + _MORE
_ALL = [(f, k, c.replace("an_n <", "coalesce(an_n, 0) <")) for f, k, c in _ALL]
_CONDITIONS = ", ".join([f"('{f}', '{k}', {c})" for f, k, c in _ALL] + ["('sector', 'sec_' || f.sector, f.sector IS NOT NULL)", f"('industry', 'ind_' || f.industry, industry_reports >= {INDUSTRY})"])

VIEWS = Sig.VIEWS | {
    "ends": "SELECT date FROM (SELECT date_trunc('month', date) AS m, max(date) AS date FROM bench GROUP BY 1) WHERE m < (SELECT max(date_trunc('month', date)) FROM bench)",
    "rets": """SELECT ticker, date, close, close / lag(close, 3) OVER w - 1 AS r3, close / lag(close, 6) OVER w - 1 AS r6, close / lag(close, 12) OVER w - 1 AS r12 FROM bars WHERE date IN (SELECT date FROM ends) WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "ranks": f"""SELECT *, CASE WHEN r3 IS NOT NULL THEN rank() OVER (PARTITION BY date, r3 IS NULL ORDER BY r3) END AS k3, CASE WHEN r6 IS NOT NULL THEN rank() OVER (PARTITION BY date, r6 IS NULL ORDER BY r6) END AS k6,
        CASE WHEN r12 IS NOT NULL THEN rank() OVER (PARTITION BY date, r12 IS NULL ORDER BY r12) END AS k12 FROM rets WHERE CASE WHEN ticker IN ({_CORE}) THEN r3 IS NOT NULL AND r6 IS NOT NULL AND r12 IS NOT NULL ELSE r3 IS NOT NULL END""",
    "picks": """SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, r12 NULLS LAST, ticker) AS place FROM (SELECT *, list_avg(list_filter([k3, k6, k12], lambda x: x IS NOT NULL)) AS score FROM ranks)""",
    "signals": """SELECT p.date, p.ticker, p.score, n.fill, CASE WHEN n.fill IS NULL THEN 'live' ELSE 'backtest' END AS status FROM picks p JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS fill FROM bench) n ON n.date = p.date
        JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM picks)) e ON e.date = p.date WHERE place = 1 AND p.date >= date '1996-06-01' AND k >= 12""",
    "turns": """SELECT *, CASE WHEN before IS NULL THEN 'initial' ELSE 'switch' END AS action FROM (SELECT *, lag(ticker) OVER (ORDER BY date) AS before FROM (
        SELECT s.*, b.close, max(CASE WHEN s.fill IS NULL OR b.close IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY s.date) AS bad FROM signals s LEFT JOIN bars b ON b.ticker = s.ticker AND b.date = s.fill) WHERE bad = 0) WHERE before IS NULL OR before <> ticker""",
    "trades": """SELECT date, fill, action, ticker, close AS price, 100000 * exp(sum(ln(coalesce(sold_at / bought_at, 1))) OVER (ORDER BY date)) AS capital FROM (
        SELECT t.*, b.close AS sold_at, lag(t.close) OVER (ORDER BY t.date) AS bought_at FROM turns t LEFT JOIN bars b ON b.ticker = t.before AND b.date = t.fill)""",
    "cal": "SELECT date, row_number() OVER (ORDER BY date)::int AS idx FROM bench",
    "kept": """WITH RECURSIVE o AS (SELECT ticker, date, session, surprise FROM reports WHERE date <= date '2001-07-30'),
        k AS (SELECT ticker, min(date) AS date FROM o GROUP BY ticker UNION ALL SELECT k.ticker, (SELECT min(o.date) FROM o WHERE o.ticker = k.ticker AND o.date > k.date + 25) AS date FROM k WHERE k.date IS NOT NULL)
        SELECT o.* FROM k JOIN o ON o.ticker = k.ticker AND o.date = k.date""",
    "reacted": """SELECT r.*, (SELECT min(idx) FROM cal WHERE cal.date >= r.date + CASE WHEN r.session = 'amc' THEN 1 ELSE 0 END) AS ridx FROM kept r""",
    "px": "SELECT b.ticker, c.idx, b.close, b.volume FROM bars b JOIN cal c ON c.date = b.date",
    "measured": """SELECT r.ticker, r.date, r.ridx, m1.close / m11.close - 1 AS pre, (m1.close / m11.close - 1) - (q1.close / q11.close - 1) AS pre_excess, p0.close / m1.close - 1 AS react,
        (p0.close / m1.close - 1) - (q0.close / q1.close - 1) AS react_excess, p20.close / p0.close - 1 AS drift, (p20.close / p0.close - 1) - (q20.close / q0.close - 1) AS drift_excess,
        CASE WHEN m11.close IS NULL THEN 'excluded' WHEN p0.close IS NULL THEN 'reported' WHEN p20.close IS NULL THEN 'reacted' ELSE 'complete' END AS status
        FROM reacted r LEFT JOIN px m11 ON m11.ticker = r.ticker AND m11.idx = r.ridx - 11 LEFT JOIN px m1 ON m1.ticker = r.ticker AND m1.idx = r.ridx - 1 LEFT JOIN px p0 ON p0.ticker = r.ticker AND p0.idx = r.ridx
        LEFT JOIN px p20 ON p20.ticker = r.ticker AND p20.idx = r.ridx + 20 LEFT JOIN bx q11 ON q11.idx = r.ridx - 11 LEFT JOIN bx q1 ON q1.idx = r.ridx - 1 LEFT JOIN bx q0 ON q0.idx = r.ridx LEFT JOIN bx q20 ON q20.idx = r.ridx + 20 WHERE r.ridx IS NOT NULL""",
    "bx": "SELECT c.idx, b.close FROM bench b JOIN cal c ON c.date = b.date",
    "quintiles": """SELECT *, greatest(1, (5 * (rank - 1) + n - 2) // (n - 1)) AS quintile FROM (SELECT *, year(date) || 'Q' || quarter(date) AS season, count(*) OVER (PARTITION BY year(date), quarter(date)) AS n,
        row_number() OVER (PARTITION BY year(date), quarter(date) ORDER BY pre_excess, ticker, date) AS rank FROM measured WHERE pre_excess IS NOT NULL AND react_excess IS NOT NULL) WHERE n >= 5""",
    "daily": """SELECT r.ticker, r.date, g.k, round((p.close / q.close - 1) * 100000)::int AS v FROM reacted r CROSS JOIN (SELECT unnest(range(-30, 31)) AS k) g LEFT JOIN px p ON p.ticker = r.ticker AND p.idx = r.ridx + g.k
        LEFT JOIN px q ON q.ticker = r.ticker AND q.idx = r.ridx + g.k - 1 WHERE r.ridx IS NOT NULL""",
    "moves": """SELECT ticker, date, CASE WHEN count(v) FILTER (k BETWEEN -10 AND -1) = 10 THEN product(1 + v / 100000) FILTER (k BETWEEN -10 AND -1) - 1 END AS x, CASE WHEN count(v) FILTER (k BETWEEN 0 AND 4) = 5 THEN product(1 + v / 100000) FILTER (k BETWEEN 0 AND 4) - 1 END AS y
        FROM daily GROUP BY ALL""",
    "walks": """WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY account, ticker ORDER BY date, id) AS k, count(*) OVER (PARTITION BY account, ticker) AS n FROM ledger),
        r AS (SELECT account, ticker, k, n, date, id, CASE side WHEN 'buy' THEN qty ELSE 0 END::double AS held, CASE side WHEN 'buy' THEN price ELSE 0 END::double AS avg, 0::double AS realized, 0::double AS sold, false AS counted FROM w WHERE k = 1
          UNION ALL SELECT w.account, w.ticker, w.k, w.n, w.date, w.id, CASE WHEN side = 'buy' THEN held + qty ELSE held - least(qty, held) END::double, CASE WHEN side = 'buy' THEN (held * avg + qty * price) / (held + qty) ELSE avg END::double,
            CASE WHEN side = 'buy' THEN realized ELSE realized + least(qty, held) * (price - avg) END::double, CASE WHEN side = 'buy' THEN 0 ELSE least(qty, held) END::double, side <> 'buy' AND held > 0
          FROM r JOIN w ON w.account = r.account AND w.ticker = r.ticker AND w.k = r.k + 1)
        SELECT account, ticker, date, id, held AS qty, avg, realized, sold, false AS closes FROM r WHERE counted
        UNION ALL SELECT account, ticker, date, id, held, CASE WHEN held > 0 THEN avg ELSE 0 END, realized, 0, true FROM r WHERE k = n""",
    "caps": """SELECT ticker, date, cap, CASE WHEN cap < 3e8 THEN 'micro' WHEN cap < 2e9 THEN 'small' WHEN cap < 1e10 THEN 'mid' WHEN cap < 2e11 THEN 'large' WHEN cap IS NOT NULL THEN 'mega' END AS tier FROM (
        SELECT r.ticker, r.date, s.market_cap * p.close / l.last AS cap FROM reacted r LEFT JOIN px p ON p.ticker = r.ticker AND p.idx = r.ridx - 1 LEFT JOIN securities s ON s.ticker = r.ticker LEFT JOIN (SELECT ticker, max_by(close, date) AS last FROM bars GROUP BY ticker) l ON l.ticker = r.ticker WHERE r.ridx IS NOT NULL)""",
    "context": """SELECT r.ticker, r.date, count(DISTINCT who) AS buyers, sum(value)::bigint AS value FROM reacted r JOIN (SELECT DISTINCT accession, coalesce(reporter_cik, '') AS who, date, shares, ticker, filed, value FROM insiders WHERE code = 'P') t
        ON t.ticker = r.ticker AND t.filed >= r.date - 90 AND t.filed < r.date GROUP BY ALL""",
    "peered": f"""SELECT f.ticker, f.rdate, {_PEERS.format('industry', 'peer_n', 'peer_react')}, {_PEERS.format('sector', 'sector_n', 'sector_react')} FROM feats f LEFT JOIN feats p
        ON (p.industry = f.industry OR p.sector = f.sector) AND p.ticker <> f.ticker AND p.rdate <= f.entry_date AND p.rdate >= f.entry_date - 30 AND p.react IS NOT NULL GROUP BY f.ticker, f.rdate, f.industry, f.sector, f.entry_date""",
    "shaped": _shaped("(SELECT *, v / 100000 AS x FROM daily)", -10, -1),
    "xshaped": _shaped("xdaily", -10, -1),
    "xdaily": """SELECT d.ticker, d.date, d.k, d.v / 100000 - (q.close / q1.close - 1) AS x, d.v / 100000 - (q.close / q1.close - 1) AS v FROM daily d JOIN reacted r ON r.ticker = d.ticker AND r.date = d.date
        LEFT JOIN bx q ON q.idx = r.ridx + d.k LEFT JOIN bx q1 ON q1.idx = r.ridx + d.k - 1""",
    "gapped": """SELECT r.ticker, r.date, g.k, round((p.open / q.close - 1) * 100000)::int AS gap, round((p.high - p.low) / q.close * 100000)::int AS range FROM reacted r CROSS JOIN (SELECT unnest(range(-30, 0)) AS k) g
        LEFT JOIN (SELECT b.*, c.idx FROM bars b JOIN cal c ON c.date = b.date) p ON p.ticker = r.ticker AND p.idx = r.ridx + g.k LEFT JOIN px q ON q.ticker = r.ticker AND q.idx = r.ridx + g.k - 1 WHERE r.ridx IS NOT NULL""",
    "gaps": _gaps(-10, -1),
    "an": _analysts(-1),
    "mas": """SELECT ticker, idx, CASE WHEN count(*) OVER a = 50 AND min(idx) OVER a = idx - 49 THEN close / avg(close) OVER a - 1 END AS ma50_gap, CASE WHEN count(*) OVER b = 200 AND min(idx) OVER b = idx - 199 THEN close / avg(close) OVER b - 1 END AS ma200_gap
        FROM px WINDOW a AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
    "keyed": f"""SELECT * FROM (SELECT f.ticker, f.rdate, f.week_id, {', '.join(f'e.{o}' for o in OUTCOMES)}, unnest([{_CONDITIONS}]) AS c
        FROM feats f JOIN resids e ON e.ticker = f.ticker AND e.rdate = f.rdate JOIN vmeans v ON v.ticker = f.ticker AND v.date = f.date JOIN caps t ON t.ticker = f.ticker AND t.date = f.date JOIN peered p ON p.ticker = f.ticker AND p.rdate = f.rdate
        JOIN xshaped h ON h.ticker = f.ticker AND h.date = f.date JOIN gaps g ON g.ticker = f.ticker AND g.date = f.date LEFT JOIN an a ON a.ticker = f.ticker AND a.date = f.date LEFT JOIN context i ON i.ticker = f.ticker AND i.date = f.date
        LEFT JOIN mas m ON m.ticker = f.ticker AND m.idx = f.ridx - 1 LEFT JOIN (SELECT industry, count(*) AS industry_reports FROM feats GROUP BY industry) y ON y.industry = f.industry) WHERE c[3]""",
    "resids": "SELECT ticker, rdate, " + ", ".join(f"{o} - (sum(round({o} * 1e9)::decimal(24,0)) OVER (PARTITION BY week_id))::double / count({o}) OVER (PARTITION BY week_id) / 1e9 AS {o}" for o in OUTCOMES) + " FROM feats",
    "cutrows": f"""SELECT ticker, rdate, week_id, {', '.join(OUTCOMES)}, c[2] AS cut, c[1] = 'eps' AS eps FROM keyed
        UNION ALL SELECT a.ticker, a.rdate, a.week_id, {', '.join(f'a.{o}' for o in OUTCOMES)}, a.c[2] || ' & ' || b.c[2], a.c[1] = 'eps' OR b.c[1] = 'eps' FROM keyed a JOIN keyed b ON b.ticker = a.ticker AND b.rdate = a.rdate AND b.c[2] > a.c[2] AND b.c[1] <> a.c[1]""",
    "cutrows_plain": f"SELECT c.cut, {', '.join(f'f.{o}' for o in OUTCOMES)} FROM cutrows c JOIN feats f ON f.ticker = c.ticker AND f.rdate = c.rdate",
    "effected": f"""SELECT cut, outcome, half, n, s / n AS mean, (s / n) / CASE WHEN var > 1e-14 THEN sqrt(var) / n END AS t FROM (SELECT *, greatest(ss - 2 * (s / n) * sn + (s / n) * (s / n) * nn, 0) AS var FROM (
          SELECT cut, outcome, half, sum(s) AS s, sum(n)::bigint AS n, sum(s * s) AS ss, sum(s * n) AS sn, sum(n * n)::double AS nn FROM (
            SELECT cut, outcome, half, week_id, sum(y) AS s, count(*) AS n FROM (SELECT cut, eps, week_id, CASE WHEN rdate < date '1998-06-01' THEN 'search' ELSE 'check' END AS half, unnest([{', '.join(f"('{o}', {o})" for o in OUTCOMES)}]) AS o FROM cutrows) x,
              LATERAL (SELECT x.o[1] AS outcome, x.o[2] AS y) WHERE y IS NOT NULL AND (NOT eps OR outcome = 'drift') GROUP BY ALL) GROUP BY ALL)) QUALIFY count(*) FILTER (n >= 5) OVER (PARTITION BY cut, outcome) = 2""",
    "tested": f"SELECT *, {_erfc('t')} AS p FROM effected",
    "rated": """SELECT *, least(1, min(raw) OVER (ORDER BY p, cut, outcome ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (
        SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, cut, outcome) AS raw FROM tested WHERE half = 'search' AND p IS NOT NULL)""",
    "acts": """SELECT r.ticker, r.date, a.idx - r.ridx AS k, a.code, a.pt FROM reacted r JOIN (SELECT ticker, code, pt, (SELECT min(idx) FROM cal WHERE cal.date >= i.day) AS idx FROM (
            SELECT ticker, CASE code WHEN 'P' THEN 'up' WHEN 'S' THEN 'down' ELSE 'main' END AS code, shares % 7 - 3 AS pt, date + CASE WHEN shares % 24 >= 16 THEN 1 ELSE 0 END AS day FROM insiders) i WHERE i.day >= (SELECT min(date) FROM cal)) a
        ON a.ticker = r.ticker AND a.idx BETWEEN r.ridx - 63 AND r.ridx - 1""",
    "vols": """SELECT r.ticker, r.date, g.k, p.volume, avg(p.volume) FILTER (g.k < -30 AND p.volume > 0) OVER (PARTITION BY r.ticker, r.date) AS m, count(*) FILTER (g.k < -30 AND p.volume > 0) OVER (PARTITION BY r.ticker, r.date) AS n
        FROM reacted r CROSS JOIN (SELECT unnest(range(-90, 0)) AS k) g LEFT JOIN px p ON p.ticker = r.ticker AND p.idx = r.ridx + g.k WHERE r.ridx IS NOT NULL""",
    "vpath": "SELECT ticker, date, k, CASE WHEN n >= 40 THEN round(100 * volume::double / m)::int END AS v, n FROM vols WHERE k >= -30",
    "feats": _feats(-10, -1, 1, {"week": (0, 4), "drift": (1, 20)}),
    "xfeats": _feats(-14, -5, 5, {"skip": (-4, -1), "through": (-4, 0), "after5": (-4, 5)}),
    "overall": """SELECT *, CASE WHEN n < 15 THEN 0 ELSE (floor((rank - 1) * 3 / n) + 1)::bigint END AS grp FROM (SELECT *, row_number() OVER (ORDER BY x, ticker, rdate) AS rank, count(*) OVER () AS n FROM (
        SELECT *, pre AS x, week AS y FROM feats WHERE surprise > 0 AND pre IS NOT NULL AND week IS NOT NULL))""",
    "looked": """SELECT *, CASE WHEN n < 15 THEN 0 ELSE (floor((rank - 1) * 3 / n) + 1)::bigint END AS grp FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY x, ticker, rdate) AS rank, count(*) OVER (PARTITION BY season) AS n FROM (
        SELECT *, pre AS x, week AS y, year(rdate) || 'Q' || quarter(rdate) AS season FROM feats WHERE surprise > 0 AND pre IS NOT NULL AND week IS NOT NULL))""",
    "vmeans": "SELECT ticker, date, avg(v) FILTER (k BETWEEN -10 AND -1) / 100 AS vol, max(v) FILTER (k = -1) / 100 AS vol_last FROM vpath GROUP BY ALL",
}


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def bars(s, d):
    return table(s, d, "bars")


def bench(s, d):
    return table(s, d, "bench")


def picks(s, d):
    return staged(s, d, "picks", lambda: R.monthly_picks(R.horizon_returns(bars(s, d), R.month_ends(bench(s, d))), CORE))


def sleeve(s, d):
    return R.signals(picks(s, d), bench(s, d), date(1996, 6, 1))


def trades(s, d):
    return staged(s, d, "trades", lambda: R.sleeve_trades(sleeve(s, d), bars(s, d), 100000.0))


def ledger(s, d):
    return table(s, d, "ledger")


def walked(s, d):
    return staged(s, d, "walked", lambda: R.average_cost(ledger(s, d)))


def last_prices(s, d):
    return bars(s, d).groupBy("ticker").agg(F.max_by("close", "date").alias("last"))


def cal(s, d):
    return staged(s, d, "cal", lambda: V.calendar(bench(s, d)))


def reports(s, d):
    return staged(s, d, "reacted", lambda: V.reaction_days(V.dedupe_reports(table(s, d, "reports"), AS_OF), cal(s, d)))


def windows(s, d):
    return staged(s, d, "windows", lambda: V.windows(reports(s, d), V.indexed_bars(bars(s, d), cal(s, d))))


def measured(s, d):
    return staged(s, d, "measured", lambda: V.measures(windows(s, d), bench(s, d), cal(s, d)))


def scored(s, d):
    return V.season_scores(measured(s, d).drop("at"), least=5)


def paths(s, d):
    return staged(s, d, "paths", lambda: V.volume_path(V.return_path(windows(s, d))).drop("at"))


def actions(s, d):
    t = table(s, d, "insiders")
    return t.select("ticker", (F.col("date").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, cast(shares % 24 AS int), 0, 0)")).alias("ts"), F.when(F.col("code") == "P", "up").when(F.col("code") == "S", "down").otherwise("main").alias("code"), (F.col("shares") % 7 - 3).alias("pt"))


def scan_rows(s, d):
    """Everything that the scan reads about a report."""

    def build():
        keys = ["ticker", "date"]
        w = windows(s, d)
        tiers = V.caps_at_report(w, table(s, d, "securities"), last_prices(s, d)).select(*keys, "tier", "cap")
        buyers = V.insider_context(reports(s, d), table(s, d, "insiders")).select(*keys, "buyers")
        acted = V.analyst_days(reports(s, d), actions(s, d).withColumn("pt", F.col("pt") / 16), cal(s, d)).select(*keys, "actions")
        ma = V.average_gaps(V.indexed_bars(bars(s, d), cal(s, d))).select("ticker", (F.col("idx") + 1).alias("ridx"), F.col("gap_50").alias("ma50_gap"), F.col("gap_200").alias("ma200_gap"))
        sec = table(s, d, "securities").select("ticker", F.regexp_extract("industry", "([^ ]+)$", 1).alias("industry"), "sector")
        gaps = V.gap_range_path(w).select(*keys, "gap_range")
        e = paths(s, d).join(gaps, keys).join(tiers, keys).join(buyers, keys, "left").join(acted, keys, "left").join(sec, "ticker").join(ma, ["ticker", "ridx"], "left")
        none = F.array().cast(e.schema["actions"].dataType)
        return e.withColumn("actions", F.coalesce("actions", none))

    return staged(s, d, "scan_rows", build)


def events(s, d, entry=None):
    build = lambda: C.features(scan_rows(s, d).join(C.marks(bench(s, d), cal(s, d)), "ridx"), cal(s, d), entry)
    return staged(s, d, f"events_{entry}", build)


def explored(s, d):
    """Reports with moves less the benchmark's, in three groups within seasons."""
    def build():
        rows = scan_rows(s, d).join(C.marks(bench(s, d), cal(s, d)), "ridx")
        return X.grouped(X.moves(rows, (-10, -1), (0, 4), True, surprise="beat"), 3)

    return staged(s, d, "explored", build)


def ungrouped(s, d):
    rows = scan_rows(s, d).join(C.marks(bench(s, d), cal(s, d)), "ridx")
    return X.moves(rows, (-10, -1), (0, 4), True, surprise="beat")


def sourced(s, d):
    """Reports on odd days were on the schedule before they came."""
    return explored(s, d).withColumn("source", F.when(F.dayofmonth("date") % 2 == 1, "live"))


def cut_rows(s, d):
    """Cuts of demeaned outcomes; the keys are those of the events as they are."""
    return C.cuts(C.demeaned(C.with_keys(events(s, d), INDUSTRY), OUTCOMES), 2)


def plain_cuts(s, d):
    """Cuts of outcomes as they are."""
    return C.cuts(C.with_keys(events(s, d), INDUSTRY), 2)


def effects(s, d):
    return staged(s, d, "effects", lambda: C.cut_effects(cut_rows(s, d), OUTCOMES, SPLIT, least=5))


def tests(s, d):
    return effects(s, d).where("half = 'search'").withColumn("p", C.two_sided("t"))


def _text(df, *cols):
    return df.select(*[F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias(c) if c in cols else F.col(c) for c in df.columns])


def _scheduled(s, d):
    return reports(s, d).select("ticker", F.date_add("date", (F.dayofmonth("date") * 2 - 25)).alias("scheduled"))


QUERIES = {
    "rot_01_month_ends": lambda s, d: R.month_ends(bench(s, d)),
    "rot_02_horizon_returns": lambda s, d: _r(R.horizon_returns(bars(s, d), R.month_ends(bench(s, d))), "close", "r3", "r6", "r12"),
    "rot_03_picks": lambda s, d: _r(picks(s, d).select("date", "ticker", "score", "place"), "score"),
    "rot_04_signals": lambda s, d: _r(sleeve(s, d), "score"),
    "rot_05_sleeve_trades": lambda s, d: _r(trades(s, d).drop("shares"), "price", "capital", n=4),
    "rot_06_equity": lambda s, d: _r(R.equity(trades(s, d), bars(s, d), bench(s, d), CORE, R.month_ends(bench(s, d)), 100000.0), "sleeve", "core", "benchmark", n=3),
    "rot_07_actual_position": lambda s, d: _r(R.actual_position(ledger(s, d)), "cash", n=3),
    "rot_07_proposed_orders": lambda s, d: _r(R.proposed_orders(R.actual_position(ledger(s, d)), "T1", last_prices(s, d), 100000.0), "shares", "amount", n=3),
    "led_01_average_cost": lambda s, d: _r(walked(s, d), "avg", "realized", n=6),
    "led_02_account_summary": lambda s, d: _r(R.account_summary(walked(s, d), last_prices(s, d)), "invested", "value", "realized", "unrealized", "win_rate", n=6),
    "led_03_cash_summary": lambda s, d: _r(R.cash_summary(
        ledger(s, d).select("account", (F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty")) * F.floor(F.col("price") * 10)).cast("double").alias("amount")),
        ledger(s, d).groupBy("account").agg(F.sum("qty").cast("double").alias("value")), s.createDataFrame([(1.25,)], "rate double")), "deposited", "withdrawn", "net", "gain", "pct", n=3),
    "evt_01_dedupe_reports": lambda s, d: _r(V.dedupe_reports(table(s, d, "reports"), AS_OF), "surprise"),
    "evt_02_reaction_days": lambda s, d: reports(s, d).select("ticker", "date", "session", "ridx"),
    "evt_03_measures": lambda s, d: _r(measured(s, d).select("ticker", "date", "pre", "pre_excess", "react", "react_excess", "drift", "drift_excess", "status"), "pre", "pre_excess", "react", "react_excess", "drift", "drift_excess"),
    "evt_04_return_path": lambda s, d: _text(paths(s, d).select("ticker", "date", "path"), "path"),
    "evt_05_volume_path": lambda s, d: _text(paths(s, d).select("ticker", "date", "volume_path"), "volume_path"),
    "evt_06_average_gaps": lambda s, d: _r(V.average_gaps(V.indexed_bars(bars(s, d), cal(s, d)), (5, 20)), "gap_5", "gap_20"),
    "evt_07_gap_range_path": lambda s, d: V.gap_range_path(windows(s, d)).select("ticker", "date", F.array_join(F.transform("gap_range", lambda x: F.concat_ws(":", F.coalesce(x["gap"].cast("string"), F.lit("-")), F.coalesce(x["range"].cast("string"), F.lit("-")))), ",").alias("gap_range")),
    "evt_08_analyst_actions": lambda s, d: V.analyst_actions(reports(s, d), actions(s, d), cal(s, d)).select("ticker", "date", F.size("actions").cast("long").alias("n"), F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["k"], a["code"], a["pt"])), ",").alias("actions")),
    "evt_09_insider_context": lambda s, d: V.insider_context(reports(s, d), table(s, d, "insiders")),
    "evt_10_caps": lambda s, d: V.caps_at_report(windows(s, d), table(s, d, "securities"), last_prices(s, d)).select("ticker", "date", F.round("cap", 1).alias("cap"), "tier"),
    "evt_11_daily_returns": lambda s, d: _r(V.daily_returns(bench(s, d), date(1997, 1, 1)), "ret"),
    "evt_12_register": lambda s, d: V.register(_scheduled(s, d).withColumnRenamed("scheduled", "date"), reports(s, d).select("ticker", "date").where(F.col("date") < F.lit(date(2000, 5, 1))), date(2000, 5, 2), date(1996, 1, 1), 40),
    "evt_13_match_reports": lambda s, d: V.match_reports(_scheduled(s, d), table(s, d, "reports"), AS_OF),
    "evt_14_late_flag": lambda s, d: V.late_flag(s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("registered"), F.date_add(F.col("ts").cast("date"), (F.col("user_id") % 3 - 1).cast("int")).alias("reaction"))).select("event_id", "origin"),
    "evt_15_season_spreads": lambda s, d: _r(V.season_spreads(scored(s, d)), "spread"),
    "evt_15_quintiles": lambda s, d: _r(V.quintile_table(scored(s, d)), "mean", "median", "up"),
    "evt_15_summary": lambda s, d: _r(V.spread_summary(V.season_spreads(scored(s, d))), "mean", "t", "positive"),
    "evt_15_rank_correlation": lambda s, d: _r(V.rank_correlation(measured(s, d), "pre", "react", "session"), "rho"),
    "evt_16_stratified_sample": lambda s, d: V.stratified_sample(table(s, d, "securities"), table(s, d, "reports").select("ticker").distinct().where("ticker < 'T3'"), 2, 11).select("ticker", "tier", "k"),
    "evt_17_explore": lambda s, d: _r(V.explore(paths(s, d), (-10, -1), (0, 4), 2), "x", "y", "median", "up"),
    "evt_17_filtered_groups": lambda s, d: _r(X.group_table(explored(s, d)), "x", "y", "median", "up"),
    "evt_17_season_halves": lambda s, d: _r(X.season_halves(explored(s, d), 3), "spread"),
    "evt_17_average_path": lambda s, d: _r(X.average_path(explored(s, d), 3, True), "top", "bottom", "all"),
    "evt_17_overall_groups": lambda s, d: _r(X.group_table(X.grouped(ungrouped(s, d), 3, False)), "x", "y", "median", "up"),
    "evt_18_live_answers": lambda s, d: _r(X.answers(X.in_cohort(sourced(s, d), "live"), (-10, -1), True), "up", "noise", "mean", "median", "size"),
    "evt_18_context_answers": lambda s, d: _r(X.answers(X.with_context(explored(s, d), (-10, -1), "ins_yes"), (-10, -1), True), "up", "noise", "mean", "median", "size"),
    "evt_18_answers": lambda s, d: _r(X.answers(explored(s, d), (-10, -1), True), "up", "noise", "mean", "median", "size"),
    "evt_18_correlations": lambda s, d: _r(X.correlations(explored(s, d)), "direction", "size", "noise"),
    "evt_18_direction_table": lambda s, d: _r(V.direction_table(paths(s, d), (-10, -1), (0, 4)), "up", "band", "mean", "median", "size"),
    "evt_19_shapes": lambda s, d: paths(s, d).select("ticker", "date", F.array_join(V.shapes(F.transform(F.slice("path", 21, 10), lambda x: x / 100000)), ",").alias("shapes")),
    "evt_20_wire_rows": lambda s, d: V.wire_rows(measured(s, d), table(s, d, "securities").select("ticker", "sector")),
    "scn_01_features": lambda s, d: _r(events(s, d).select("ticker", "rdate", "pre", "vol", "vol_last", "react", "week", "drift", "prev_react", "range_ratio", "gap_last", "gaps_big", "ma50_gap", "ma200_gap"), "pre", "vol", "vol_last", "react", "week", "drift", "prev_react", "range_ratio", "gap_last", "ma50_gap", "ma200_gap"),
    "scn_01_trade_features": lambda s, d: _r(events(s, d, TRADE).select("ticker", "rdate", "entry_date", "pre", "react", *HOLDS, "prev_react"), "pre", "react", *HOLDS, "prev_react"),
    "scn_02_peer_reactions": lambda s, d: _r(events(s, d).select("ticker", "rdate", "peer_n", "peer_react", "sector_n", "sector_react"), "peer_react", "sector_react"),
    "scn_03_analyst_signals": lambda s, d: _r(events(s, d).where("an_n > 0").select("ticker", "rdate", "an_n", "an_up", "an_down", "an_init", "pt_net", "pt_avg"), "pt_avg"),
    "scn_04_conditions": lambda s, d: C.with_keys(events(s, d), INDUSTRY).select(F.explode("keys").alias("k")).groupBy("k.family", "k.key").agg(F.count("*").alias("n")),
    "scn_05_cuts": lambda s, d: cut_rows(s, d).groupBy("cut").agg(F.count("*").alias("n")),
    "scn_06_demeaned": lambda s, d: _r(C.demeaned(events(s, d), OUTCOMES).select("ticker", "rdate", *OUTCOMES), *OUTCOMES),
    "scn_07_cut_effects": lambda s, d: _r(effects(s, d), "mean", "t"),
    "scn_08_two_sided": lambda s, d: _r(effects(s, d).withColumn("p", C.two_sided("t")).select("cut", "outcome", "half", "p"), "p"),
    "scn_09_discovery_rates": lambda s, d: _r(C.discovery_rates(tests(s, d)).select("cut", "outcome", "q"), "q"),
    "scn_10_verdicts": lambda s, d: _r(C.verdicts(effects(s, d), LEVEL, C.up_shares(plain_cuts(s, d), OUTCOMES), C.baselines(events(s, d), OUTCOMES)), "mean", "t", "q", "check_mean", "check_t", "check_p", "up_share", "base_up"),
    "scn_10_baselines": lambda s, d: _r(C.baselines(events(s, d), OUTCOMES), "mean", "up"),
    "scn_11_weekly_rank_scores": lambda s, d: _r(C.weekly_rank_scores(events(s, d), "pre", "react", 3), "ic", "spread", "top"),
    "scn_12_placebo": lambda s, d: _r(C.placebo_test(events(s, d), "pre", "react"), "value", "mean", "deviation", "p"),
    "scn_12_model_scores": lambda s, d: _r(C.model_scores(events(s, d), ["pre", "vol", "buyers", "peer_n"], "react", SPLIT), "prediction", "y", "placebo"),
}

_PX = "LEFT JOIN px {0} ON {0}.ticker = r.ticker AND {0}.idx = r.ridx + {1}"

_SQL = {
    "rot_01_month_ends": "SELECT date FROM ends",
    "rot_02_horizon_returns": "SELECT ticker, date, round(close, 6) AS close, round(r3, 6) AS r3, round(r6, 6) AS r6, round(r12, 6) AS r12 FROM rets",
    "rot_03_picks": "SELECT date, ticker, round(score, 6) AS score, place FROM picks",
    "rot_04_signals": "SELECT date, ticker, round(score, 6) AS score, fill, status FROM signals",
    "rot_05_sleeve_trades": "SELECT date, fill, action, ticker, round(price, 4) AS price, round(capital, 4) AS capital FROM trades",
    "rot_06_equity": f"""WITH spans AS (SELECT ticker, fill, capital / price AS shares, lead(fill) OVER (ORDER BY fill) AS until FROM trades), f AS (SELECT min(fill) AS first FROM trades)
        SELECT e.date, round(s.shares * b.close, 3) AS sleeve, round(c.v * 100000, 3) AS core, round(q.close / q0.close * 100000, 3) AS benchmark FROM ends e CROSS JOIN f JOIN spans s ON e.date >= s.fill AND (s.until IS NULL OR e.date < s.until)
        JOIN bars b ON b.ticker = s.ticker AND b.date = e.date JOIN bench q ON q.date = e.date JOIN bench q0 ON q0.date = f.first
        JOIN (SELECT b.date, avg(b.close / b0.close) AS v FROM bars b CROSS JOIN f JOIN bars b0 ON b0.ticker = b.ticker AND b0.date = f.first WHERE b.ticker IN ({_CORE}) GROUP BY b.date HAVING count(*) = {len(CORE)}) c ON c.date = e.date WHERE e.date >= f.first""",
    "rot_07_actual_position": "SELECT account, ticker, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END)::bigint AS qty, round(sum(CASE side WHEN 'buy' THEN -qty ELSE qty END * price), 3) AS cash FROM ledger GROUP BY ALL",
    "rot_07_proposed_orders": """WITH p AS (SELECT account, ticker, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END)::bigint AS qty, sum(CASE side WHEN 'buy' THEN -qty ELSE qty END * price) AS cash FROM ledger GROUP BY ALL), l AS (SELECT ticker, max_by(close, date) AS last FROM bars GROUP BY ticker),
        sells AS (SELECT p.account, p.ticker, qty, qty * coalesce(last, 0) AS amount FROM p LEFT JOIN l ON l.ticker = p.ticker WHERE p.ticker <> 'T1' AND qty > 0), c AS (SELECT account, 100000 + sum(cash) AS cash FROM p GROUP BY account)
        SELECT account, 'sell' AS side, ticker, round(qty::double, 3) AS shares, round(amount, 3) AS amount FROM sells UNION ALL
        SELECT account, 'buy', 'T1', round(have / last, 3), round(have, 3) FROM (SELECT c.account, c.cash + coalesce(sum(amount), 0) AS have FROM c LEFT JOIN sells s ON s.account = c.account GROUP BY c.account, c.cash), l WHERE l.ticker = 'T1' AND last > 0 AND have >= 1""",
    "led_01_average_cost": "SELECT account, ticker, date, id, qty, round(avg, 6) AS avg, round(realized, 6) AS realized, sold, closes FROM walks",
    "led_03_cash_summary": """SELECT account, round(coalesce(p, 0), 3) AS deposited, round(coalesce(n, 0), 3) AS withdrawn, round(net, 3) AS net, round(v * 1.25 - net, 3) AS gain, CASE WHEN net > 0 THEN round(100 * (v * 1.25 - net) / net, 3) END AS pct FROM (
        SELECT account, sum(amount) FILTER (amount > 0) AS p, sum(-amount) FILTER (amount < 0) AS n, sum(amount) AS net, sum(qty) AS v FROM (SELECT account, qty, (CASE side WHEN 'buy' THEN qty ELSE -qty END * floor(price * 10))::double AS amount FROM ledger) GROUP BY account)""",
    "evt_01_dedupe_reports": "SELECT ticker, date, session, round(surprise, 6) AS surprise FROM kept",
    "evt_02_reaction_days": "SELECT ticker, date, session, ridx FROM reacted",
    "evt_03_measures": """SELECT ticker, date, round(pre, 6) AS pre, round(pre_excess, 6) AS pre_excess, round(react, 6) AS react, round(react_excess, 6) AS react_excess, round(drift, 6) AS drift, round(drift_excess, 6) AS drift_excess, status FROM measured""",
    "evt_04_return_path": "SELECT ticker, date, string_agg(coalesce(v::varchar, '-'), ',' ORDER BY k) AS path FROM daily GROUP BY ALL",
    "evt_05_volume_path": "SELECT ticker, date, CASE WHEN max(n) >= 40 THEN string_agg(coalesce(v::varchar, '-'), ',' ORDER BY k) END AS volume_path FROM vpath GROUP BY ALL",
    "led_02_account_summary": """SELECT account, round(coalesce(invested, 0), 6) AS invested, round(coalesce(value, 0), 6) AS value, round(realized, 6) AS realized, sells, round(win_rate, 6) AS win_rate, round(coalesce(value, 0) - coalesce(invested, 0), 6) AS unrealized FROM (
        SELECT account, sum(qty * avg) FILTER (qty > 1e-6) AS invested, sum(qty * last) FILTER (qty > 1e-6) AS value, sum(realized) AS realized FROM walks LEFT JOIN (SELECT ticker, max_by(close, date) AS last FROM bars GROUP BY ticker) p USING (ticker) WHERE closes GROUP BY account)
        LEFT JOIN (SELECT account, count(*) AS sells, avg((gain >= 0)::int) AS win_rate FROM (SELECT account, realized - coalesce(lag(realized) OVER (PARTITION BY account, ticker ORDER BY date, id), 0) AS gain FROM walks WHERE NOT closes) GROUP BY account) USING (account)""",
    "evt_15_rank_correlation": """SELECT session, round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT session, rank() OVER (PARTITION BY session ORDER BY pre) + (count(*) OVER (PARTITION BY session, pre) - 1) / 2 AS a,
        rank() OVER (PARTITION BY session ORDER BY react) + (count(*) OVER (PARTITION BY session, react) - 1) / 2 AS b FROM (SELECT m.*, r.session FROM measured m JOIN reacted r ON r.ticker = m.ticker AND r.date = m.date) WHERE pre IS NOT NULL AND react IS NOT NULL) GROUP BY session""",
    "scn_01_features": """SELECT f.ticker, f.rdate, round(pre, 6) AS pre, round(vol, 6) AS vol, round(vol_last, 6) AS vol_last, round(react, 6) AS react, round(week, 6) AS week, round(drift, 6) AS drift, round(prev_react, 6) AS prev_react, round(range_ratio, 6) AS range_ratio,
        round(gap_last, 6) AS gap_last, gaps_big::int AS gaps_big, round(ma50_gap, 6) AS ma50_gap, round(ma200_gap, 6) AS ma200_gap FROM feats f JOIN vmeans v ON v.ticker = f.ticker AND v.date = f.date JOIN gaps g ON g.ticker = f.ticker AND g.date = f.date LEFT JOIN mas m ON m.ticker = f.ticker AND m.idx = f.ridx - 1""",
    "scn_01_trade_features": "SELECT ticker, rdate, entry_date, round(pre, 6) AS pre, round(react, 6) AS react, round(skip, 6) AS skip, round(through, 6) AS through, round(after5, 6) AS after5, round(prev_react, 6) AS prev_react FROM xfeats",
    "scn_02_peer_reactions": "SELECT ticker, rdate, peer_n, round(peer_react, 6) AS peer_react, sector_n, round(sector_react, 6) AS sector_react FROM peered",
    "scn_06_demeaned": "SELECT ticker, rdate, round(react, 6) + 0.0 AS react, round(week, 6) + 0.0 AS week, round(drift, 6) + 0.0 AS drift, round(size, 6) + 0.0 AS size FROM resids",
    "scn_10_baselines": """SELECT outcome, count(*) AS n, round(avg(y), 6) AS mean, round(avg((y > 0)::int), 6) AS up FROM (SELECT 'react' AS outcome, react AS y FROM feats UNION ALL SELECT 'week', week FROM feats UNION ALL SELECT 'drift', drift FROM feats UNION ALL SELECT 'size', size FROM feats)
        WHERE y IS NOT NULL GROUP BY outcome""",
    "evt_06_average_gaps": """SELECT ticker, idx, CASE WHEN count(*) OVER a = 5 AND min(idx) OVER a = idx - 4 THEN round(close / avg(close) OVER a - 1, 6) END AS gap_5, CASE WHEN count(*) OVER b = 20 AND min(idx) OVER b = idx - 19 THEN round(close / avg(close) OVER b - 1, 6) END AS gap_20
        FROM px WINDOW a AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "evt_08_analyst_actions": "SELECT ticker, date, count(*) AS n, string_agg(k || ':' || code || ':' || pt, ',' ORDER BY k, code, pt) AS actions FROM acts GROUP BY ALL",
    "evt_07_gap_range_path": """SELECT ticker, date, string_agg(coalesce(gap::varchar, '-') || ':' || coalesce(range::varchar, '-'), ',' ORDER BY k) AS gap_range FROM (
        SELECT r.ticker, r.date, g.k, round((p.open / q.close - 1) * 100000)::int AS gap, round((p.high - p.low) / q.close * 100000)::int AS range FROM reacted r CROSS JOIN (SELECT unnest(range(-30, 0)) AS k) g
        LEFT JOIN (SELECT b.*, c.idx FROM bars b JOIN cal c ON c.date = b.date) p ON p.ticker = r.ticker AND p.idx = r.ridx + g.k LEFT JOIN px q ON q.ticker = r.ticker AND q.idx = r.ridx + g.k - 1 WHERE r.ridx IS NOT NULL) GROUP BY ALL""",
    "evt_16_stratified_sample": """SELECT ticker, tier, k FROM (SELECT ticker, tier, row_number() OVER (PARTITION BY tier ORDER BY md5(ticker || ':11'), ticker)::int AS k FROM (SELECT ticker, CASE WHEN market_cap < 3e8 THEN 'micro' WHEN market_cap < 2e9 THEN 'small'
        WHEN market_cap < 1e10 THEN 'mid' WHEN market_cap < 2e11 THEN 'large' WHEN market_cap IS NOT NULL THEN 'mega' END AS tier FROM securities WHERE ticker NOT IN (SELECT ticker FROM reports WHERE ticker < 'T3')) WHERE tier IS NOT NULL) WHERE k <= 2""",
    "evt_19_shapes": "SELECT ticker, date, array_to_string(shapes, ',') AS shapes FROM shaped",
    "scn_04_conditions": "SELECT c[1] AS family, c[2] AS key, count(*) AS n FROM keyed GROUP BY ALL",
    "scn_05_cuts": "SELECT cut, count(*) AS n FROM cutrows GROUP BY cut",
    "scn_07_cut_effects": "SELECT cut, outcome, half, n, round(mean, 6) + 0.0 AS mean, round(t, 6) + 0.0 AS t FROM effected",
    "scn_08_two_sided": "SELECT cut, outcome, half, round(p, 6) AS p FROM tested",
    "scn_10_verdicts": f"""WITH found AS (SELECT * FROM rated WHERE q < {LEVEL}), k AS (SELECT greatest(count(*), 1) AS k FROM found)
        , v AS (SELECT s.cut, s.outcome, s.n, s.mean, s.t, s.q, c.n AS check_n, c.mean AS check_mean, c.t AS check_t, c.p AS check_p,
        CASE WHEN sign(s.mean) = sign(c.mean) AND c.p < 0.05 / k THEN 'confirmed' WHEN sign(s.mean) = sign(c.mean) AND c.p < 0.05 THEN 'same direction' ELSE 'did not hold' END AS verdict
        FROM found s JOIN tested c ON c.cut = s.cut AND c.outcome = s.outcome AND c.half = 'check' CROSS JOIN k),
        u AS (SELECT cut, o.k AS outcome, avg((o.y > 0)::int) AS up_share FROM (SELECT cut, unnest([{', '.join("{'k': '" + o + "', 'y': " + o + "}" for o in OUTCOMES)}]) AS o FROM cutrows_plain) WHERE o.y IS NOT NULL GROUP BY ALL),
        b AS (SELECT o.k AS outcome, avg((o.y > 0)::int) AS base_up FROM (SELECT unnest([{', '.join("{'k': '" + o + "', 'y': " + o + "}" for o in OUTCOMES)}]) AS o FROM feats) WHERE o.y IS NOT NULL GROUP BY ALL)
        SELECT v.cut, v.outcome, n, round(mean, 6) AS mean, round(t, 6) AS t, round(q, 6) AS q, check_n, round(check_mean, 6) + 0.0 AS check_mean, round(check_t, 6) AS check_t, round(check_p, 6) AS check_p, verdict,
        row_number() OVER (ORDER BY list_position({list(C.VERDICTS)}, verdict), q, v.cut, v.outcome) AS place, CASE WHEN v.outcome <> 'size' THEN round(up_share, 6) END AS up_share, CASE WHEN v.outcome <> 'size' THEN round(base_up, 6) END AS base_up
        FROM v LEFT JOIN u ON u.cut = v.cut AND u.outcome = v.outcome LEFT JOIN b ON b.outcome = v.outcome""",
    "scn_09_discovery_rates": "SELECT cut, outcome, round(q, 6) AS q FROM rated",
    "evt_12_register": """SELECT ticker, min(date) AS date FROM (SELECT ticker, date + (day(date) * 2 - 25)::int AS date FROM reacted) s WHERE date BETWEEN date '2000-05-02' AND date '2000-05-02' + 40
        AND NOT EXISTS (SELECT 1 FROM reacted l WHERE l.ticker = s.ticker AND l.date < date '2000-05-01' AND abs(s.date - l.date) <= 20) GROUP BY ticker""",
    "scn_03_analyst_signals": "SELECT a.ticker, f.rdate, an_n, an_up, an_down, an_init, pt_net, round(pt_avg, 6) AS pt_avg FROM an a JOIN feats f ON f.ticker = a.ticker AND f.date = a.date WHERE an_n > 0",
    "scn_11_weekly_rank_scores": """SELECT week_id, count(*) AS n, round(corr(a, b), 6) AS ic, round(avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo), 6) AS spread, round(avg(y) FILTER (x >= hi), 6) AS top FROM (
        SELECT f.week_id, pre AS x, react AS y, rank() OVER (PARTITION BY f.week_id ORDER BY pre) + (count(*) OVER (PARTITION BY f.week_id, pre) - 1) / 2 AS a, rank() OVER (PARTITION BY f.week_id ORDER BY react) + (count(*) OVER (PARTITION BY f.week_id, react) - 1) / 2 AS b, hi, lo
        FROM feats f JOIN (SELECT week_id, quantile_cont(pre, 0.8) AS hi, quantile_cont(pre, 0.2) AS lo, count(*) AS c FROM feats WHERE pre IS NOT NULL AND react IS NOT NULL GROUP BY week_id) e ON e.week_id = f.week_id WHERE pre IS NOT NULL AND react IS NOT NULL AND c >= 3) GROUP BY week_id""",
    "evt_09_insider_context": "SELECT * FROM context",
    "evt_10_caps": "SELECT ticker, date, round(cap, 1) AS cap, tier FROM caps",
    "evt_11_daily_returns": "SELECT date, round(ret, 6) AS ret FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM bench) WHERE date >= date '1997-01-01'",
    "evt_13_match_reports": """SELECT s.ticker, s.scheduled, arg_min(r.date, (abs(r.date - s.scheduled), r.date)) AS matched, CASE WHEN count(r.date) > 0 THEN 'reported' WHEN date '2001-07-30' - s.scheduled > 30 THEN 'no_report' ELSE 'waiting' END AS status
        FROM (SELECT DISTINCT ticker, date + (day(date) * 2 - 25)::int AS scheduled FROM reacted) s LEFT JOIN reports r ON r.ticker = s.ticker AND abs(r.date - s.scheduled) <= 20 GROUP BY s.ticker, s.scheduled""",
    "evt_14_late_flag": """SELECT event_id, CASE WHEN l::date > reaction OR (l::date = reaction AND hour(l) * 60 + minute(l) >= 570) THEN 'late' ELSE 'live' END AS origin FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS l, ts::date + (user_id % 3 - 1)::int AS reaction FROM events)""",
    "evt_15_season_spreads": "SELECT season, round(avg(react_excess) FILTER (quintile = 5) - avg(react_excess) FILTER (quintile = 1), 6) AS spread, count(*) AS events FROM quintiles GROUP BY season",
    "evt_15_quintiles": "SELECT quintile, count(*) AS n, round(avg(react_excess), 6) AS mean, round(median(react_excess), 6) AS median, round(avg((react_excess > 0)::int), 6) AS up FROM quintiles GROUP BY quintile",
    "evt_15_summary": """SELECT round(avg(spread), 6) AS mean, round(avg(spread) / (stddev_samp(spread) / sqrt(count(spread))), 6) AS t, round(avg((spread > 0)::int), 6) AS positive, count(*) AS seasons
        FROM (SELECT season, avg(react_excess) FILTER (quintile = 5) - avg(react_excess) FILTER (quintile = 1) AS spread FROM quintiles GROUP BY season)""",
    "evt_17_explore": """SELECT grp, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(median(y), 6) AS median, round(avg((y > 0)::int), 6) AS up FROM (SELECT *, (floor((row_number() OVER (PARTITION BY year(date), quarter(date) ORDER BY x, ticker, date) - 1) * 2
        / count(*) OVER (PARTITION BY year(date), quarter(date))) + 1)::bigint AS grp, count(*) OVER (PARTITION BY year(date), quarter(date)) AS c FROM moves WHERE x IS NOT NULL AND y IS NOT NULL) WHERE c >= 10 GROUP BY grp""",
    "evt_18_direction_table": """SELECT CASE WHEN x > 0 THEN 'up' ELSE 'down' END AS before, count(*) AS n, round(avg((y > 0)::int), 6) AS up, round(1.96 * sqrt(avg((y > 0)::int) * (1 - avg((y > 0)::int)) / count(*)), 6) AS band, round(avg(y), 6) AS mean, round(median(y), 6) AS median,
        round(avg(abs(y)), 6) AS size FROM moves WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
    "evt_17_filtered_groups": "SELECT grp, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(median(y), 6) AS median, round(avg((y > 0)::int), 6) AS up FROM looked WHERE grp > 0 GROUP BY grp",
    "evt_17_season_halves": """SELECT season, events, round(spread, 6) AS spread, CASE WHEN spread IS NOT NULL THEN CASE WHEN count(spread) OVER (ORDER BY season) <= ceil(count(spread) OVER () / 2) THEN 'early' ELSE 'late' END END AS half
        FROM (SELECT season, count(*) AS events, avg(y) FILTER (grp = 3) - avg(y) FILTER (grp = 1) AS spread FROM looked GROUP BY season)""",
    "evt_17_average_path": """WITH one AS (SELECT l.ticker, l.rdate, l.grp, d.k, CASE WHEN d.k = -1 THEN 0 WHEN d.k >= 0 THEN CASE WHEN count(d.v) FILTER (d.k >= 0) OVER a = d.k + 1 THEN exp(sum(ln(1 + d.v / 100000)) FILTER (d.k >= 0) OVER a) - 1 - (q.close / q1.close - 1) END
        ELSE CASE WHEN count(d.v) FILTER (d.k < 0) OVER b = -1 - d.k THEN exp(-sum(ln(1 + d.v / 100000)) FILTER (d.k < 0) OVER b) - 1 - (q.close / q1.close - 1) END END AS v
        FROM looked l JOIN daily d ON d.ticker = l.ticker AND d.date = l.date LEFT JOIN bx q ON q.idx = l.ridx + d.k LEFT JOIN bx q1 ON q1.idx = l.ridx - 1
        WINDOW a AS (PARTITION BY l.ticker, l.rdate ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY l.ticker, l.rdate ORDER BY d.k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        SELECT k::int AS day, round(avg(v) FILTER (grp = 3), 6) AS top, round(avg(v) FILTER (grp = 1), 6) AS bottom, round(avg(v), 6) AS "all" FROM one GROUP BY k""",
    "evt_18_answers": """WITH m AS (SELECT l.x, l.y, h.shapes, v.vol, t.tier, i.buyers, a.ma50_gap, a.ma200_gap, l.surprise FROM looked l JOIN xshaped h ON h.ticker = l.ticker AND h.date = l.date JOIN vmeans v ON v.ticker = l.ticker AND v.date = l.date
          JOIN caps t ON t.ticker = l.ticker AND t.date = l.date LEFT JOIN context i ON i.ticker = l.ticker AND i.date = l.date LEFT JOIN mas a ON a.ticker = l.ticker AND a.idx = l.ridx - 1),
        k AS (SELECT y, unnest(list_concat([('all', 'all'), ('before', CASE WHEN x > 0 THEN 'up' ELSE 'down' END), ('bucket', CASE WHEN x < -0.1 THEN 'fell_big' WHEN x < -0.03 THEN 'fell' WHEN x < 0.03 THEN 'flat' WHEN x < 0.1 THEN 'rose' ELSE 'rose_big' END),
          ('context', CASE WHEN tier <> 'micro' THEN 'cap_' || tier END), ('context', CASE WHEN buyers > 0 THEN 'ins_yes' WHEN buyers IS NOT NULL THEN 'ins_no' END), ('context', CASE WHEN vol < 0.8 THEN 'vol_low' WHEN vol < 1.25 THEN 'vol_norm' WHEN vol < 2 THEN 'vol_high' WHEN vol IS NOT NULL THEN 'vol_vhigh' END),
          ('context', CASE WHEN ma50_gap > 0 THEN 'ma50_above' WHEN ma50_gap IS NOT NULL THEN 'ma50_below' END), ('context', CASE WHEN ma200_gap > 0 THEN 'ma200_above' WHEN ma200_gap IS NOT NULL THEN 'ma200_below' END),
          ('context', CASE WHEN surprise < 0 THEN 'eps_miss' WHEN surprise < 5 THEN 'eps_small' WHEN surprise < 15 THEN 'eps_mid' WHEN surprise IS NOT NULL THEN 'eps_big' END)], list_transform(shapes, lambda z: ('shape', z)))) AS c FROM m)
        SELECT c[1] AS kind, c[2] AS key, count(*) AS n, round(avg((y > 0)::int), 6) AS up, round(1.96 * sqrt(avg((y > 0)::int) * (1 - avg((y > 0)::int)) / count(*)), 6) AS noise, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(avg(abs(y)), 6) AS size
        FROM k WHERE c[2] IS NOT NULL GROUP BY ALL""",
    "evt_18_correlations": """SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS direction, CASE WHEN count(*) >= 3 THEN round(corr(c, d), 6) END AS size, CASE WHEN count(*) >= 3 THEN round(1.96 / sqrt(count(*)), 6) END AS noise FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b,
        rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2 AS c, rank() OVER (ORDER BY abs(y)) + (count(*) OVER (PARTITION BY abs(y)) - 1) / 2 AS d FROM looked)""",
    "evt_20_wire_rows": """SELECT m.ticker, m.date, s.s, round(pre, 4) AS pre, round(react, 4) AS react, round(drift, 4) AS drift FROM measured m LEFT JOIN (SELECT ticker, dense_rank() OVER (ORDER BY sector) - 1 AS s FROM securities) s ON s.ticker = m.ticker""",
}

_SQL["scn_12_placebo"] = """WITH e AS (SELECT rdate, ticker, week_id, pre AS s, react AS y, r FROM feats, range(101) t(r) WHERE pre IS NOT NULL AND react IS NOT NULL),
    k AS (SELECT r, y, row_number() OVER (PARTITION BY week_id, r ORDER BY CASE WHEN r = 0 THEN s END NULLS FIRST, CASE WHEN r > 0 THEN md5(ticker || ':' || rdate::date || ':' || r) END NULLS FIRST, ticker, rdate) - (count(*) OVER (PARTITION BY week_id, r) + 1) / 2 AS k FROM e),
    f AS (SELECT r, count(*) AS n, round(sum(k * y) / count(*), 9) AS figure FROM k GROUP BY r), v AS (SELECT n, figure AS value FROM f WHERE r = 0)
    SELECT v.n, round(value, 6) AS value, round(avg(figure) FILTER (r > 0), 6) AS mean, round(stddev(figure) FILTER (r > 0), 6) AS deviation, round(count(*) FILTER (abs(figure) >= abs(value)) / 101, 6) AS p FROM f, v GROUP BY v.n, value"""
_SQL["evt_17_overall_groups"] = _SQL["evt_17_filtered_groups"].replace("looked", "overall")
_SQL["evt_18_live_answers"] = _SQL["evt_18_answers"].replace("FROM looked l", "FROM (SELECT * FROM looked WHERE day(date) % 2 = 1) l")
_SQL["evt_18_context_answers"] = _SQL["evt_18_answers"].replace("AS c FROM m)", "AS c FROM m WHERE buyers > 0)")
SQL = {name: oracle(text, VIEWS) for name, text in _SQL.items()}

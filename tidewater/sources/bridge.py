"""Domain tables derived from the given ones; one text serves Spark and, as views, the SQL check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .staging import staged

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

_VIEWS = {
    "filers": """
        SELECT lpad(cast(s_suppkey AS string), 10, '0') AS cik, s_name AS filer_name,
               CASE s_suppkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS tier,
               CASE s_nationkey % 6 WHEN 0 THEN 'activist' WHEN 1 THEN 'value' WHEN 2 THEN 'growth' WHEN 3 THEN 'quant'
                    WHEN 4 THEN 'macro' ELSE 'corporate' END AS category,
               CASE WHEN s_nationkey % 6 = 0 THEN 2.0 ELSE 1.0 END AS multiplier
        FROM {supplier}""",
    "securities": """
        SELECT n, concat('T', cast(n AS string)) AS ticker, concat('C', lpad(cast(n AS string), 8, '0')) AS cusip, name, industry, sector,
               CASE WHEN n % 8 <> 3 THEN cap * 10000 * (n % 5 + 1) END AS market_cap, cast((n % 5 + 1) * 2000000 AS double) AS adv20,
               CASE WHEN n % 8 <> 5 THEN cast(n AS double) / 10 - 0.4 END AS ret_6m
        FROM (SELECT cast(p_partkey % 16 AS bigint) AS n, min_by(p_name, p_partkey) AS name, min_by(p_type, p_partkey) AS industry,
                     min_by(p_brand, p_partkey) AS sector, cast(sum(cast(p_retailprice AS decimal(12,2))) AS double) AS cap
              FROM {part} GROUP BY p_partkey % 16) AS parts""",
    "cusip_map": """SELECT cusip, ticker, CASE WHEN n < 12 THEN 'mapped' ELSE 'no-match' END AS resolved_via,
               cast(CASE WHEN n % 2 = 0 THEN '2001-07-01' ELSE '2001-09-25' END AS date) AS resolved_at
        FROM securities WHERE n < 14""",
    "lines": """
        SELECT lpad(cast(l_suppkey AS string), 10, '0') AS cik,
               cast(last_day(cast(date_trunc('quarter', l_shipdate) AS date) + INTERVAL 2 MONTH) AS date) AS period,
               CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 = 0 THEN 'R' WHEN l_returnflag = 'R' AND l_suppkey % 3 = 1 THEN 'N' ELSE 'O' END AS kind,
               cast(l_partkey % 16 AS bigint) AS n, cast(l_quantity AS bigint) AS shares, cast(l_extendedprice AS decimal(18,2)) AS value_usd,
               CASE WHEN l_linenumber = 7 THEN 'Call' END AS put_call, CASE WHEN l_linenumber = 6 THEN 'PRN' ELSE 'SH' END AS sh_type, l_orderkey
        FROM {lineitem}""",
    "holdings": """
        SELECT concat_ws('-', l.cik, cast(l.period AS string), l.kind) AS filing_id, l.cik, l.period, s.cusip,
               CASE WHEN l.n = 14 AND l.l_orderkey % 2 = 0 THEN s.ticker END AS ticker, concat(upper(s.name), ' INC.') AS issuer_name,
               l.shares, l.value_usd, l.put_call, l.sh_type
        FROM lines AS l JOIN securities AS s ON l.n = s.n""",
    "filings": """
        SELECT DISTINCT concat_ws('-', cik, cast(period AS string), kind) AS filing_id, concat_ws('-', cik, cast(period AS string), kind) AS accession,
               cik, period, CASE WHEN kind = 'O' THEN '13F-HR' ELSE '13F-HR/A' END AS form_type,
               CASE kind WHEN 'R' THEN 'RESTATEMENT' WHEN 'N' THEN 'NEW HOLDINGS' END AS amendment_type,
               cast(period + INTERVAL 1 DAY * CASE WHEN kind = 'O' THEN 45 ELSE 60 END AS date) AS filed
        FROM lines""",
    "splits": """
        SELECT * FROM (VALUES ('T3', cast('1998-05-15' AS date), cast(2.0 AS double)), ('T5', cast('2000-02-10' AS date), cast(0.5 AS double))) AS t(ticker, split_date, ratio)""",
    "ticks": """
        SELECT concat('T', cast(l_partkey % 8 AS string)) AS ticker, cast(l_shipdate AS date) AS date, l_extendedprice / l_quantity AS price,
               cast(l_quantity AS bigint) AS q, lpad(cast(l_orderkey AS string), 14, '0') || lpad(cast(l_linenumber AS string), 3, '0')
               || lpad(cast(l_partkey AS string), 12, '0') || lpad(cast(l_suppkey AS string), 12, '0') AS place
        FROM {lineitem} WHERE l_quantity > 0""",
    "bars": """
        SELECT ticker, date, min_by(price, place) AS open, max(price) AS high, min(price) AS low, max_by(price, place) AS close, sum(q) AS volume
        FROM ticks GROUP BY ticker, date""",
    "bench": """
        SELECT date, max_by(price, place) AS close FROM ticks GROUP BY date""",
    "insiders": """
        SELECT concat('T', cast(o_custkey % 16 AS string)) AS ticker, concat('ACC', cast(o_orderkey AS string)) AS accession,
               lpad(cast(o_custkey AS string), 10, '0') AS reporter_cik, concat('Reporter ', cast(o_custkey AS string)) AS reporter,
               cast(o_orderdate AS date) AS date, cast(o_orderdate + INTERVAL 2 DAY AS date) AS filed,
               CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'A' END AS code, cast(floor(o_totalprice / 100) AS bigint) AS shares,
               cast(100.0 AS double) AS price, cast(floor(o_totalprice / 100) AS bigint) * 100 AS value,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_officer, o_orderpriority = '3-MEDIUM' AS is_director,
               CASE WHEN o_orderpriority = '5-LOW' THEN true WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN false END AS is_10b5_1,
               CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'I' END AS direct,
               CASE WHEN o_orderkey % 11 <> 0 THEN cast(floor(o_totalprice / 100) AS bigint) + o_custkey % 500 END AS owned_after
        FROM {orders}""",
    "stakes": """
        SELECT concat('STK', cast(o_orderkey AS string)) AS filing_id, lpad(cast(o_orderkey % 40 AS string), 10, '0') AS cik,
               concat('T', cast(o_custkey % 16 AS string)) AS ticker, cast(o_orderdate AS date) AS filed,
               CASE o_orderkey % 3 WHEN 0 THEN '13D' WHEN 1 THEN '13D/A' ELSE '13G' END AS subtype, 5 + o_totalprice % 20 AS percent_owned
        FROM {orders}""",
    "reports": """
        SELECT concat('T', cast(o_custkey % 8 AS string)) AS ticker, cast(o_orderdate AS date) AS date, min(CASE o_orderstatus WHEN 'F' THEN 'bmo' WHEN 'O' THEN 'amc' ELSE 'intraday' END) AS session,
               max(o_totalprice % 40 - 15) AS surprise
        FROM {orders} GROUP BY concat('T', cast(o_custkey % 8 AS string)), cast(o_orderdate AS date)""",
    "etf_daily": """
        SELECT ticker, date, close AS nav, sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS shares_out FROM bars""",
    "ledger": """
        SELECT o_orderkey AS id, o_custkey AS account, concat('T', cast(o_orderkey % 5 AS string)) AS ticker, cast(o_orderdate AS date) AS date,
               CASE WHEN o_orderstatus IN ('O', 'P') THEN 'buy' ELSE 'sell' END AS side, cast(floor(o_totalprice / 1000) AS bigint) + 1 AS qty, o_totalprice / 1000 AS price
        FROM {orders}""",
}


def _needed(text: str, views: dict[str, str], found: dict[str, None] | None = None) -> dict[str, None]:
    """Views that a text names, each after those it needs itself."""
    found = {} if found is None else found
    for name, view in views.items():
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            _needed(view, views, found)
            found[name] = None
    return found


def with_views(select: str, more: dict[str, str] | None = None) -> str:
    """The select with the views it names before it; tables stand in braces there."""
    known = _VIEWS | (more or {})
    views = [f"{n} AS ({known[n]})" for n in _needed(select, known)]
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", select)
    if lead:
        return f"WITH {lead[1] or ''}" + ", ".join([*views, select[lead.end() :]])
    return "WITH " + ", ".join(views) + select if views else select


def oracle(select: str, more: dict[str, str] | None = None) -> str:
    """The text for the SQL check, in which the given tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", with_views(select, more))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables; only those of the given tables that it needs are read."""

    def build():
        text = with_views(f"SELECT * FROM {name}")
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
        return spark.sql(text, **frames)

    return staged(spark, sf_dir, name, build)

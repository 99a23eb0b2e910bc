"""Queries on parsers, sinks, monitors and streams: texts are derived from the given tables, then parsed back."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..sources import filings as X
from ..sources.bridge import oracle, table
from ..sources.sinks import Table, append_frozen, export, replace_latest, replace_run, upsert
from ..sources.staging import folder
from ..streaming import jobs as J
from . import fund_queries as Fund

AS_OF = date(2001, 7, 30)


def _read(s, d, t):
    return s.read.parquet(f"{d}/{t}.parquet")


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(c):
    return F.col(c).cast("string")


def submissions(s, d):
    """A customer's orders as a submissions document."""
    o = _read(s, d, "orders").withColumn("k", F.col("o_orderkey") % 5)
    form = F.when(F.col("k") == 0, "13F-HR").when(F.col("k") == 1, "8-K").when(F.col("k") == 2, "4").when(F.col("k") == 3, "10-K").otherwise("SC 13D")
    row = o.select("o_custkey", F.struct(_s("o_orderkey").alias("a"), form.alias("f"), F.col("o_orderdate").cast("date").cast("string").alias("d"), F.lit("").alias("r"), F.when(F.col("k") == 1, F.concat(F.lit("9.01, "), F.col("o_custkey") % 9 + 1, F.lit(".01"))).otherwise("").alias("i")).alias("x"))
    g = row.groupBy("o_custkey").agg(F.collect_list("x").alias("x"))
    of = lambda f: F.transform("x", lambda e: e[f])
    recent = F.struct(of("a").alias("accessionNumber"), of("f").alias("form"), of("d").alias("filingDate"), of("r").alias("reportDate"), of("i").alias("items"))
    return g.select(F.to_json(F.struct(_s("o_custkey").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("json"))


def info_tables(s, d):
    """An order's lines as an information table; a line without a discount has no name, an odd one a bad number."""
    r = _read(s, d, "lineitem")
    one = _cat("<n1:infoTable>", F.when(F.col("l_discount") == 0, F.lit("")).otherwise(_cat("<n1:nameOfIssuer>P ", _s("l_partkey"), "</n1:nameOfIssuer>")), "<n1:cusip>C", _s("l_suppkey"), "</n1:cusip><n1:value>", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(_s("l_linenumber")),
               "</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>", F.col("l_quantity").cast("bigint").cast("string"), "</n1:sshPrnamt><n1:sshPrnamtType>", F.when(F.col("l_linenumber") == 6, "prn").otherwise(" SH "), "</n1:sshPrnamtType></n1:shrsOrPrnAmt>",
               F.when(F.col("l_linenumber") == 7, "<n1:putCall>Call</n1:putCall>").otherwise(""), "</n1:infoTable>")
    return r.groupBy(F.col("l_orderkey").alias("filing_id")).agg(_cat('<n1:informationTable xmlns:n1="urn:t">', F.array_join(F.collect_list(one), ""), "</n1:informationTable>").alias("xml"))


def info_files(s, d):
    """The lines of every sixteenth supplier as the rows of one filing's files, read by their tag."""
    r = _read(s, d, "lineitem")
    one = _cat("<n1:infoTable><n1:nameOfIssuer>P ", _s("l_partkey"), "</n1:nameOfIssuer><n1:cusip>C", _s("l_orderkey"), "</n1:cusip><n1:value>", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(_s("l_linenumber")),
               "</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>", F.col("l_quantity").cast("bigint").cast("string"), "</n1:sshPrnamt><n1:sshPrnamtType>SH</n1:sshPrnamtType></n1:shrsOrPrnAmt></n1:infoTable>")
    path = f"{folder(s)}/info-{uuid.uuid4().hex}"
    r.select((F.col("l_suppkey") % 16).alias("filing"), one.alias("line")).write.partitionBy("filing").text(path)
    return X.read_info_tables(s, path, F.col("filing"))


def covers(s, d):
    o = _read(s, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Restatement").when(F.col("o_orderstatus") == "O", "NEW\n  HOLDINGS").otherwise("?</e:broken>")
    return o.select(F.col("o_orderkey").alias("filing_id"), F.when(F.col("o_orderkey") % 2 == 0, "13F-HR").otherwise("13F-HR/A").alias("form_type"), _cat('<e:cover xmlns:e="urn:e"><e:amendmentInfo><e:amendmentType>', kind, "</e:amendmentType></e:amendmentInfo></e:cover>").alias("cover"))


def typed(s, d):
    c = covers(s, d)
    stored = c.where("filing_id % 7 = 0").select("filing_id", F.lit("RESTATEMENT").alias("amendment_type"))
    return X.typed_rows(c.select("filing_id"), c, stored)


def form4(s, d):
    t = table(s, d, "insiders")
    v = lambda n, c: _cat(f"<{n}><value>", c, f"</value></{n}>")
    xml = _cat("<ownershipDocument><issuer><issuerTradingSymbol>", F.lower("ticker"), "</issuerTradingSymbol></issuer>", F.when(F.col("is_10b5_1").isNotNull(), _cat("<aff10b5One>", F.when(F.col("is_10b5_1"), "1").otherwise("0"), "</aff10b5One>")).otherwise(""),
               "<reportingOwner><reportingOwnerId><rptOwnerCik>", F.ltrim(F.col("reporter_cik")), "</rptOwnerCik><rptOwnerName>", F.col("reporter"), "</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>", F.when(F.col("is_officer"), "true").otherwise("0"),
               "</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction>", v("transactionDate", _s("date")), "<transactionCoding><transactionCode>", F.col("code"), "</transactionCode></transactionCoding><transactionAmounts>",
               v("transactionShares", _s("shares")), v("transactionPricePerShare", _s("price")), "</transactionAmounts><ownershipNature>", v("directOrIndirectOwnership", F.col("direct")), "</ownershipNature></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>")
    return X.parse_form4(t.select("accession", "filed", xml.alias("xml")))


def bulk(s, d):
    t = table(s, d, "insiders")
    sub = t.select("accession", F.when(F.col("shares") % 5 == 0, "5").otherwise("4").alias("document_type"), F.date_format("filed", "dd-MMM-yyyy").alias("filing_date"), F.lower("ticker").alias("symbol"), F.when(F.col("is_10b5_1"), "true").otherwise("").alias("aff10b5one"))
    own = t.select("accession", F.col("reporter_cik").cast("bigint").alias("cik"), "reporter", F.when(F.col("is_officer"), "Officer,TenPercent").otherwise("Director").alias("relationship"), F.lit(1).alias("position"))
    own = own.unionByName(own.select("accession", (F.col("cik") + 1).alias("cik"), "reporter", "relationship", F.lit(2).alias("position")))
    tr = t.select("accession", F.date_format("date", "dd-MMM-yyyy").alias("trans_date"), "code", _s("shares").alias("shares"), F.when(F.col("shares") % 3 == 0, "0").otherwise("100").alias("price"), "direct")
    return X.bulk_trades(sub, own, tr)


def monthly(s, d):
    o = _read(s, d, "orders")
    r = o.select(_s("o_orderkey").alias("a"), F.lpad(_s("o_orderkey"), 12, "0").alias("accession"), F.when(F.col("o_orderkey") % 3 == 0, _cat("S", (F.col("o_custkey") % 5).cast("string"))).alias("series_id"), F.concat(F.lit("K"), F.col("o_custkey") % 7).alias("cik"),
                 F.last_day("o_orderdate").alias("report_month"), *[F.when((F.col("o_orderkey") + k) % 4 != 0, F.col("o_orderkey") % (m * k) * 1.0).alias(f"{c}{k}") for k in (1, 2, 3) for c, m in (("sales", 50), ("redeem", 30))], *[F.lit(None).cast("double").alias(f"reinvest{k}") for k in (1, 2, 3)])
    by_series = s.createDataFrame([(f"S{i}", f"E{i}") for i in range(4)], "series_id string, ticker string")
    return X.monthly_flows(r, by_series, s.createDataFrame([(f"K{i}", f"F{i}") for i in range(3)], "cik string, ticker string"))


def fund_reports(s, d):
    o = _read(s, d, "orders")
    xml = _cat('<n:edgarSubmission xmlns:n="urn:n"><n:seriesId>S', _s("o_custkey"), "</n:seriesId><n:repPdDate>", F.col("o_orderdate").cast("date").cast("string"), "</n:repPdDate><n:netAssets>", _s("o_orderkey"), '.5</n:netAssets><n:monthlyTotReturn rtn1="1.5" rtn2="', F.when(F.col("o_orderkey") % 2 == 0, "N/A").otherwise("-2"), '" rtn3="0"/></n:edgarSubmission>')
    return X.parse_fund_report(o.select(F.col("o_orderkey").alias("id"), xml.alias("xml"))).select("id", "series_id", "period", "net_assets", *[F.col("returns")[k].alias(f"r{k + 1}") for k in range(3)])


def histories(s, d):
    t = table(s, d, "etf_daily")
    row = _cat("<Row><Cell>", F.date_format("date", "MMM d, yyyy"), "</Cell><Cell>", F.format_number(F.floor("nav").cast("double"), 2), "</Cell><Cell>", F.when(F.dayofmonth("date") == 2, "0").otherwise(F.format_number(F.col("shares_out").cast("double"), 0)), "</Cell></Row>")
    return X.parse_issuer_history(t.groupBy("ticker").agg(F.array_join(F.collect_list(row), "\n").alias("text")))


def index_lines(s, d):
    o = _read(s, d, "orders")
    line = _cat(F.when(F.col("o_orderkey") % 3 == 0, "4  ").when(F.col("o_orderkey") % 3 == 1, "4/A  ").otherwise("424B2  "), "Company ", _s("o_custkey"), " Inc   ", _s("o_custkey"), "   ", F.date_format("o_orderdate", "yyyyMMdd"), "   edgar/", _s("o_orderkey"), ".txt  ")
    return X.parse_daily_index(o.select(line.alias("line")))


def stakes(s, d):
    t = table(s, d, "stakes")
    text = _cat("<html><b>Name of Issuer:</b> Company ", F.col("ticker"), ", Inc. (Issuer) CUSIP No. 12345", F.substring("ticker", 2, 2), "A  Percent of class: ", F.format_number("percent_owned", 2), "% Date: ", F.date_format("filed", "MM/dd/yyyy"), "</html>")
    xml = _cat('<?xml version="1.0"?><s:doc xmlns:s="urn:s"><s:issuerName>', F.col("ticker"), "</s:issuerName><s:issuerCUSIP>abc123</s:issuerCUSIP><s:classPercent>", F.format_number("percent_owned", 2), "</s:classPercent></s:doc>")
    docs = t.select("filing_id", F.when(F.col("subtype") == "13D", "SCHEDULE 13D").otherwise("SC 13G/A").alias("form_type"), "filed", F.when(F.col("subtype") == "13D", xml).otherwise(text).alias("doc"))
    return X.parse_stake(docs)


def _table(s, name):
    return Table(s, f"{folder(s)}/{name}-{uuid.uuid4().hex}")


def upserted(s, d):
    """Two overlapping batches, the second twice: the repeat changes nothing."""
    o = _read(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), "o_totalprice")
    t = _table(s, "upsert")
    upsert(t, o.where("version % 3 < 2"), ["key"], "version")
    for _ in range(2):
        upsert(t, o.where("version % 3 > 0"), ["key"], "version")
    return t.read()


def exported(s, d):
    """The orders as CSV and as JSON lines, both read back."""
    o, path = _read(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority")), f"{folder(s)}/export-{uuid.uuid4().hex}"
    for form in ("csv", "json"):
        export(o, f"{path}/{form}", form)
    csv, json = s.read.schema(o.schema).option("header", True).csv(f"{path}/csv"), s.read.schema(o.schema).json(f"{path}/json")
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(json.select(F.lit("json").alias("form"), "*"))


def replaced(s, d):
    t = _table(s, "run")
    o = _read(s, d, "orders").select("o_orderkey")
    replace_run(t, o.where("o_orderkey % 2 = 0"), "first")
    replace_run(t, o.where("o_orderkey % 2 = 1"), "second")
    try:
        replace_run(t, o.where("o_orderkey < 0"), "third")
    except ValueError:
        pass
    return t.read()


def latest(s, d):
    t = _table(s, "latest")
    o = _read(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("top"))
    replace_latest(t, o, datetime(2001, 7, 29))
    replace_latest(t, o.where("key % 2 = 0"), datetime(2001, 7, 30))
    return t.read().select("key", "top")


def frozen(s, d):
    t = _table(s, "frozen")
    o = _read(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "kept").alias("action"))
    append_frozen(t, o.where("key % 5 < 3"), ["key"])
    append_frozen(t, o.select("key", F.lit("changed").alias("value"), F.lit("late").alias("action")), ["key"])
    return t.read()


def _stream(s, d):
    return J.landing(s, _landing(s, d), _read(s, d, "events").schema, files=1)


def _landing(s, d):
    """The events as a landing folder to which the parts of the month come one after another."""
    path = f"{folder(s)}/landing-{uuid.uuid4().hex}"
    e = _read(s, d, "events")
    for part in range(4):
        e.where(F.floor(F.dayofmonth("ts") / 8) == part).write.mode("append").parquet(path)
    return path


def _work(s):
    return f"{folder(s)}/stream-{uuid.uuid4().hex}"


def intake(s, d):
    e = _stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return J.drain(J.intake(e, "event_id", "ts", "40 days"), s, _work(s)).select("event_id", "user_id")


def clusters(s, d):
    e = _stream(s, d).select(F.col("ts").cast("timestamp").alias("filed_at"), F.when(F.col("event_type") == "click", "P").otherwise("S").alias("code"), _s("user_id").alias("reporter_cik"), F.concat(F.lit("T"), F.col("user_id") % 4).alias("ticker"))
    out = J.drain(J.insider_clusters(e, 10, "40 days", "5 days"), s, _work(s), "update")
    return _last(out, ["start", "ticker"]).select(F.col("start").cast("date").alias("start"), "ticker", "buyers", "trades")


def _last(out, keys):
    """The last batch's row of each key: what an upserting sink keeps."""
    from ..sources.sinks import newest

    return newest(out, keys, "_batch").drop("_batch")


def rollup(s, d):
    e = _stream(s, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), "value")
    out = _last(J.drain(J.rollup(e, "ts", "value", "40 days"), s, _work(s), "update"), ["day", "key"])
    return out.select(F.col("day").cast("date").alias("day"), "key", F.round("total", 4).alias("total"), "n", "last")


def keyed(s, d):
    t, work = _table(s, "keyed"), _work(s)
    e = _stream(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type")
    q = e.writeStream.foreachBatch(J.keyed_sink(t, ["key"], "version")).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.read()


def late(s, d):
    e = _stream(s, d).select("event_id", F.col("ts").alias("arrived"), F.date_trunc("day", "ts").alias("day"))
    e = e.withColumn("opened", F.expr("day + interval 14 hours 30 minutes").cast(e.schema["arrived"].dataType))
    return J.drain(J.flag_late(e, "arrived", "opened"), s, _work(s)).select("event_id", "late", "scored")


def delta_rows(s, d):
    e = _stream(s, d).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("time"), "value")
    out = J.latest_deltas(J.drain(J.deltas(e, "40 days", 400), s, _work(s)))
    return out.select("key", "value", F.round("delta", 4).alias("delta")).withColumn("delta", F.nanvl("delta", F.lit(None).cast("double")))


def stale(s, d):
    e, f = table(s, d, "etf_daily"), table(s, d, "filings")
    return M.staleness({"aum": (e, "date"), "nport": (e.where("day(date) = 31"), "date"), "filings": (f, "filed")}, date(2002, 1, 20))


def reconciled(s, d):
    fresh = Fund.effective(s, d)
    stored = fresh.where("NOT (cik LIKE '%7' AND month(period) = 6 AND shares > 45)")
    return M.reconcile(stored, fresh).select("cik", "period", "stored_rows", "fresh_rows", "stored_shares", "fresh_shares")


QUERIES = {
    "src_01_submissions": lambda s, d: X.submissions_to_filings(submissions(s, d), AS_OF, 3).select("cik", "accession", "form_type", "filed"),
    "src_02_info_table": lambda s, d: X.parse_info_table(info_tables(s, d)),
    "src_02_info_files": info_files,
    "src_03_amendment_type": lambda s, d: typed(s, d),
    "src_04_form4": lambda s, d: form4(s, d).select("accession", "ticker", "is_10b5_1", "reporter_cik", "is_officer", "date", "code", "shares", "price", "value", "direct"),
    "src_05_bulk_trades": lambda s, d: bulk(s, d).select("accession", "ticker", "reporter_cik", "filed", "date", "shares", "price", "is_officer", "is_director"),
    "src_06_monthly_flows": monthly,
    "src_07_fund_report": fund_reports,
    "src_08_issuer_history": lambda s, d: histories(s, d).select("ticker", "date", F.round("nav", 3).alias("nav"), "shares"),
    "src_09_daily_index": index_lines,
    "src_10_stakes": stakes,
    "src_11_load_bars": lambda s, d: X.load_bars(table(s, d, "bars"), "T0", date(2000, 1, 1)).select("ticker", "date", "volume"),
    "snk_05_export": exported,
    "snk_01_upsert": upserted,
    "snk_02_replace_run": replaced,
    "snk_03_replace_latest": latest,
    "snk_04_append_frozen": frozen,
    "ops_01_staleness": stale,
    "ops_02_reconcile": reconciled,
    "str_01_intake": intake,
    "str_02_insider_clusters": clusters,
    "str_03_rollup": rollup,
    "str_04_keyed_sink": keyed,
    "str_05_late_flag": late,
    "str_06_deltas": delta_rows,
}

_SQL = {
    "src_01_submissions": """SELECT lpad(o_custkey::varchar, 10, '0') AS cik, o_orderkey::varchar AS accession, CASE o_orderkey % 5 WHEN 0 THEN '13F-HR' WHEN 1 THEN '8-K' WHEN 2 THEN '4' ELSE 'SC 13D' END AS form_type, o_orderdate::date AS filed
        FROM orders WHERE o_orderkey % 5 <> 3 AND o_orderdate::date >= date '1998-07-30' AND (o_orderkey % 5 <> 1 OR o_custkey % 9 + 1 IN (1, 2, 8))""",
    "src_02_info_table": """SELECT l_orderkey AS filing_id, 'P ' || l_partkey AS issuer_name, 'C' || l_suppkey AS cusip, CASE WHEN l_linenumber <> 3 THEN l_linenumber::double END AS value_usd, l_quantity::bigint AS shares,
        CASE WHEN l_linenumber = 6 THEN 'PRN' ELSE 'SH' END AS sh_type, CASE WHEN l_linenumber = 7 THEN 'Call' END AS put_call FROM lineitem WHERE l_discount <> 0""",
    "src_02_info_files": """SELECT l_suppkey % 16 AS filing_id, 'P ' || l_partkey AS issuer_name, 'C' || l_orderkey AS cusip, CASE WHEN l_linenumber <> 3 THEN l_linenumber::double END AS value_usd, l_quantity::bigint AS shares, 'SH' AS sh_type, NULL::varchar AS put_call FROM lineitem""",
    "src_03_amendment_type": """SELECT * FROM (SELECT o_orderkey AS filing_id, CASE WHEN o_orderkey % 7 = 0 THEN 'RESTATEMENT' WHEN o_orderstatus = 'F' THEN 'RESTATEMENT' WHEN o_orderstatus = 'O' THEN 'NEW HOLDINGS' END AS amendment_type FROM orders)
        WHERE filing_id % 2 = 0 OR amendment_type IS NOT NULL""",
    "src_04_form4": "SELECT accession, ticker, is_10b5_1, reporter_cik, is_officer, date, code, shares::double AS shares, price, CASE WHEN shares > 0 THEN shares * price END AS value, direct FROM insiders",
    "src_05_bulk_trades": "SELECT accession, ticker, reporter_cik, filed, date, shares::double AS shares, 100.0::double AS price, is_officer, NOT is_officer AS is_director FROM insiders WHERE code = 'P' AND shares % 5 <> 0 AND shares % 3 <> 0",
    "src_06_monthly_flows": """WITH r AS (SELECT o_orderkey AS k, lpad(o_orderkey::varchar, 12, '0') AS accession, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 5 < 4 THEN 'E' || (o_custkey % 5) END, CASE WHEN o_custkey % 7 < 3 THEN 'F' || (o_custkey % 7) END) AS ticker, o_orderdate AS m
            FROM orders),
        x AS (SELECT ticker, accession, last_day(date_trunc('month', m) - INTERVAL 1 MONTH * (3 - g))::date AS month_end, CASE WHEN (k + g) % 4 <> 0 THEN k % (50 * g) - k % (30 * g) END AS net, k, g FROM r, (VALUES (1), (2), (3)) t(g) WHERE ticker IS NOT NULL)
        SELECT ticker, month_end, max_by(net, accession)::double AS net FROM x WHERE net IS NOT NULL GROUP BY ALL""",
    "src_07_fund_report": "SELECT o_orderkey AS id, 'S' || o_custkey AS series_id, o_orderdate::date AS period, o_orderkey + 0.5::double AS net_assets, 1.5::double AS r1, CASE WHEN o_orderkey % 2 = 1 THEN -2.0::double END AS r2, 0.0::double AS r3 FROM orders",
    "src_08_issuer_history": "SELECT ticker, date, floor(nav)::double AS nav, shares_out::double AS shares FROM etf_daily WHERE day(date) <> 2",
    "src_09_daily_index": """SELECT CASE o_orderkey % 3 WHEN 0 THEN '4' ELSE '4/A' END AS form_type, 'Company ' || o_custkey || ' Inc' AS company, lpad(o_custkey::varchar, 10, '0') AS cik, o_orderdate::date AS filed, 'edgar/' || o_orderkey || '.txt' AS file FROM orders WHERE o_orderkey % 3 < 2""",
    "src_10_stakes": """SELECT filing_id, CASE subtype WHEN '13D' THEN '13D' ELSE '13G/A' END AS subtype, CASE subtype WHEN '13D' THEN 'ABC123' ELSE '12345' || substring(ticker, 2, 2) || 'A' END AS cusip, CASE subtype WHEN '13D' THEN ticker ELSE 'Company ' || ticker || ', Inc.' END AS issuer,
        round(percent_owned, 2) AS percent_owned, filed AS event_date FROM stakes""",
    "src_11_load_bars": "SELECT ticker, date, volume::bigint AS volume FROM bars WHERE date IN (SELECT date FROM bars WHERE ticker = 'T0' AND date <= date '2000-01-01')",
    "snk_05_export": "SELECT form, o_orderkey AS key, o_orderpriority AS priority FROM orders, (VALUES ('csv'), ('json')) t(form)",
    "snk_01_upsert": "SELECT o_custkey AS key, max(o_orderkey) AS version, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
    "snk_02_replace_run": "SELECT o_orderkey, 'second' AS run_id FROM orders WHERE o_orderkey % 2 = 1",
    "snk_03_replace_latest": "SELECT o_custkey AS key, max(o_orderkey) AS top FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey",
    "snk_04_append_frozen": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 < 3 THEN o_orderstatus ELSE 'changed' END AS value, CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 2 = 0 THEN 'kept' ELSE 'late' END AS action FROM orders",
    "ops_01_staleness": """SELECT source, latest, (date '2002-01-20' - latest)::int AS age, coalesce(date '2002-01-20' - latest > most, true) AS stale FROM (SELECT 'aum' AS source, max(date) AS latest, 4 AS most FROM etf_daily
        UNION ALL SELECT 'nport', max(date), 110 FROM etf_daily WHERE day(date) = 31 UNION ALL SELECT 'filings', max(filed), 7 FROM filings)""",
    "ops_02_reconcile": """SELECT * FROM (SELECT f.cik, f.period, count(*) FILTER (ok) AS stored_rows, count(*) AS fresh_rows, sum(shares) FILTER (ok)::bigint AS stored_shares, sum(shares)::bigint AS fresh_shares FROM (
        SELECT *, NOT (cik LIKE '%7' AND month(period) = 6 AND shares > 45) AS ok FROM effective) f GROUP BY ALL) WHERE stored_rows <> fresh_rows AND stored_rows > 0
        UNION ALL SELECT cik, period, NULL, count(*), NULL, sum(shares)::bigint FROM effective GROUP BY cik, period HAVING bool_and(cik LIKE '%7' AND month(period) = 6 AND shares > 45)""",
    "str_01_intake": "SELECT DISTINCT event_id, user_id FROM events",
    "str_02_insider_clusters": """SELECT date '1970-01-01' + (w * 5)::int AS start, ticker, count(DISTINCT user_id) AS buyers, count(*) AS trades FROM (SELECT 'T' || (user_id % 4) AS ticker, user_id, unnest([date_diff('day', date '1970-01-01', ts::date) // 5, date_diff('day', date '1970-01-01', ts::date) // 5 - 1]) AS w
        FROM events WHERE event_type = 'click') GROUP BY ALL""",
    "str_03_rollup": "SELECT ts::date AS day, user_id AS key, round(sum(value), 4) AS total, count(*) AS n, max_by(value, ts) AS last FROM events GROUP BY ALL",
    "str_04_keyed_sink": "SELECT user_id AS key, max(event_id) AS version, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "str_05_late_flag": "SELECT event_id, hour(ts) * 60 + minute(ts) >= 870 AS late, hour(ts) * 60 + minute(ts) < 870 AS scored FROM events",
    "str_06_deltas": "SELECT user_id AS key, value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, value), 4) AS delta FROM events",
}
SQL = {name: oracle(text, Fund.VIEWS) for name, text in _SQL.items()}

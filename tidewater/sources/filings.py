"""Landed filings and reports to rows. Parsers take a text column, so files and tables are read alike."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cik10, has_role, tri_state

# Forms that are tracked, and event items that keep an 8-K.
FORMS = ("13F-HR", "13F-HR/A", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "4", "8-K")
ITEMS = ("1.01", "2.01", "5.02", "8.01")
SUBTYPES = {
    "SC 13D": "13D", "SC 13D/A": "13D/A", "SC 13G": "13G", "SC 13G/A": "13G/A",
    "SCHEDULE 13D": "13D", "SCHEDULE 13D/A": "13D/A", "SCHEDULE 13G": "13G", "SCHEDULE 13G/A": "13G/A",
}
_RECENT = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, items array<string>"


def submissions_to_filings(docs: DataFrame, as_of: date, years: int = 3) -> DataFrame:
    """Rows of a submissions document (json): tracked forms of the last years, an 8-K only with a tracked item."""
    j = docs.select(F.from_json("json", f"cik string, filings struct<recent struct<{_RECENT}>>").alias("j"))
    r = j.select("j.cik", F.explode(F.arrays_zip(*[F.col(f"j.filings.recent.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "items")])).alias("r"))
    rows = r.select(cik10(F.col("cik")).alias("cik"), F.col("r.accessionNumber").alias("accession"), F.col("r.form").alias("form_type"), F.try_to_date("r.filingDate").alias("filed"), F.try_to_date("r.reportDate").alias("period"), F.col("r.items").alias("items"))
    kept = F.arrays_overlap(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda i: F.trim(i)), F.array(*[F.lit(i) for i in ITEMS]))
    return rows.where(F.col("form_type").isin(*FORMS) & (F.col("filed") >= F.add_months(F.lit(as_of), -12 * years)) & ((F.col("form_type") != "8-K") | kept))


_POSITION = "nameOfIssuer string, cusip string, value string, shrsOrPrnAmt struct<sshPrnamt string, sshPrnamtType string>, putCall string"


def parse_info_table(docs: DataFrame) -> DataFrame:
    """(filing_id, issuer_name, cusip, value_usd, shares, sh_type, put_call) of an information table (xml).

    Rows without a name or security id are skipped, bad numbers (also ones with commas) are null, bad XML has no rows.
    """
    x = F.from_xml("xml", f"struct<infoTable array<struct<{_POSITION}>>>", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return _positions(docs.select("filing_id", F.explode(x["infoTable"]).alias("p")))


def _positions(rows: DataFrame) -> DataFrame:
    """Rules of an information table's rows: filing_id and p, its fields as text."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    whole = F.trim("p.shrsOrPrnAmt.sshPrnamt")
    return rows.select(
        "filing_id", blank(F.col("p.nameOfIssuer")).alias("issuer_name"), blank(F.col("p.cusip")).alias("cusip"), F.expr("try_cast(trim(p.value) AS double)").alias("value_usd"),
        F.when(whole.rlike(r"^[+-]?[0-9]+$"), whole.try_cast("bigint")).alias("shares"), F.upper(blank(F.col("p.shrsOrPrnAmt.sshPrnamtType"))).alias("sh_type"), blank(F.col("p.putCall")).alias("put_call"),
    ).where("issuer_name IS NOT NULL AND cusip IS NOT NULL")


def read_info_tables(spark: SparkSession, path: str, filing: Column | None = None) -> DataFrame:
    """parse_info_table of files, for tables of any size: what stands between a row's tags is a record of its own.

    Spark's text reader ends a record at `infoTable>`, so a file can be split and no table is ever one value. Prefixes
    don't matter; tags with attributes or in comments aren't read. filing: what tells filings apart, a column of the
    path's partitions or of `_metadata`; the file's name up to its first dot by default.
    """
    filing = F.substring_index(F.col("_metadata.file_name"), ".", 1) if filing is None else filing
    lines = spark.read.option("lineSep", "infoTable>").text(path).select(filing.alias("filing_id"), "value")
    inner = F.regexp_extract("value", r"(?s)^(.*)</(?:[A-Za-z0-9_.-]+:)?$", 1)
    plain = F.regexp_replace(inner, r"(</?)[A-Za-z0-9_.-]+:", "$1")
    row = F.from_xml(F.concat(F.lit("<row>"), plain, F.lit("</row>")), f"struct<{_POSITION}>", {"mode": "PERMISSIVE"})
    # Exploded, as the filter on names and ids would otherwise be moved below the parsing and parse a row four times more.
    return _positions(lines.where(inner != "").select("filing_id", F.explode(F.array(row)).alias("p")))


def text_at(xml: Column, path: str) -> Column:
    """The text at a path; null where the document isn't well-formed, for xpath fails there."""
    broken = F.from_xml(xml, "struct<_corrupt_record string, _none string>", {"mode": "PERMISSIVE"})["_corrupt_record"]
    return F.when(xml.isNotNull() & broken.isNull(), F.xpath_string(xml, F.lit(path)))


def amendment_type(xml: Column) -> Column:
    """RESTATEMENT, NEW HOLDINGS, or null where the cover has neither or can't be read; runs of blanks count as one."""
    found = F.upper(F.trim(F.regexp_replace(text_at(xml, "//*[local-name()='amendmentType']"), r"\s+", " ")))
    return F.when(found.isin("RESTATEMENT", "NEW HOLDINGS"), found)


def typed_rows(rows: DataFrame, covers: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of filings but for amendments without a readable type; a type already stored wins."""
    c = covers.select("filing_id", "form_type", amendment_type(F.col("cover")).alias("read")).join(stored.select("filing_id", F.col("amendment_type").alias("stored")), "filing_id", "left")
    c = c.withColumn("amendment_type", F.coalesce("stored", "read"))
    bad = c.where(F.col("form_type").endswith("/A") & F.col("amendment_type").isNull())
    return rows.join(bad, "filing_id", "left_anti").join(c.select("filing_id", "amendment_type"), "filing_id", "left")


_TRADE = "transactionDate string, transactionCode string, shares string, price string, owned string, direct string"


def parse_form4(docs: DataFrame, buys_only: bool = False) -> DataFrame:
    """Non-derivative transactions of an ownership document's first owner: all codes, or purchases alone.

    value is null if shares or price is missing or zero.
    """
    v = lambda n: f"{n} struct<value string>"
    trade = f"struct<{v('transactionDate')}, transactionCoding struct<transactionCode string>, transactionAmounts struct<{v('transactionShares')}, {v('transactionPricePerShare')}>, postTransactionAmounts struct<{v('sharesOwnedFollowingTransaction')}>, ownershipNature struct<{v('directOrIndirectOwnership')}>>"
    owner = "struct<reportingOwnerId struct<rptOwnerCik string, rptOwnerName string>, reportingOwnerRelationship struct<isOfficer string, isDirector string, isTenPercentOwner string>>"
    x = F.from_xml("xml", f"struct<issuer struct<issuerTradingSymbol string>, aff10b5One string, reportingOwner array<{owner}>, nonDerivativeTable struct<nonDerivativeTransaction array<{trade}>>>", {"mode": "PERMISSIVE"})
    d = docs.select("accession", "filed", x.alias("d")).select(
        "accession", "filed", F.upper(F.trim("d.issuer.issuerTradingSymbol")).alias("ticker"), tri_state(F.col("d.aff10b5One")).alias("is_10b5_1"), F.get("d.reportingOwner", F.lit(0)).alias("o"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    shares, price = F.expr("try_cast(t.transactionAmounts.transactionShares.value AS double)"), F.expr("try_cast(t.transactionAmounts.transactionPricePerShare.value AS double)")
    out = d.select(
        "accession", "filed", "ticker", "is_10b5_1", cik10(F.col("o.reportingOwnerId.rptOwnerCik")).alias("reporter_cik"), F.col("o.reportingOwnerId.rptOwnerName").alias("reporter"),
        F.coalesce(tri_state(F.col("o.reportingOwnerRelationship.isOfficer")), F.lit(False)).alias("is_officer"), F.coalesce(tri_state(F.col("o.reportingOwnerRelationship.isDirector")), F.lit(False)).alias("is_director"),
        F.try_to_date(F.col("t.transactionDate.value")).alias("date"), F.col("t.transactionCoding.transactionCode").alias("code"), shares.alias("shares"), price.alias("price"), F.when((shares > 0) & (price > 0), shares * price).alias("value"),
        F.expr("try_cast(t.postTransactionAmounts.sharesOwnedFollowingTransaction.value AS double)").alias("owned_after"), F.col("t.ownershipNature.directOrIndirectOwnership.value").alias("direct"))
    return out.where("code = 'P'") if buys_only else out


def bulk_trades(submissions: DataFrame, owners: DataFrame, trades: DataFrame) -> DataFrame:
    """Purchases of bulk tables: form 4, first owner of each accession, positive shares and price, each once."""
    first = owners.withColumn("k", F.row_number().over(Window.partitionBy("accession").orderBy("position"))).where("k = 1").drop("k", "position")
    day = lambda c: F.coalesce(F.try_to_date(c, "dd-MMM-yyyy"), F.try_to_date(c))
    s = submissions.where("document_type = '4'").select("accession", day("filing_date").alias("filed"), F.upper("symbol").alias("ticker"), tri_state(F.col("aff10b5one")).alias("is_10b5_1"))
    t = trades.where("code = 'P'").select("accession", day("trans_date").alias("date"), "code", F.expr("try_cast(shares AS double)").alias("shares"), F.expr("try_cast(price AS double)").alias("price"), "direct").where("shares > 0 AND price > 0")
    out = t.join(s, "accession").join(first.select("accession", cik10(F.col("cik")).alias("reporter_cik"), "reporter", has_role(F.col("relationship"), "officer").alias("is_officer"), has_role(F.col("relationship"), "director").alias("is_director")), "accession")
    return out.dropDuplicates(["accession", "reporter_cik", "date", "code", "shares"])


def monthly_flows(reports: DataFrame, by_series: DataFrame, by_cik: DataFrame) -> DataFrame:
    """(ticker, month_end, net): three months of each report; null amounts are zero unless all are; the last accession counts.

    A fund is found by its series, else by its registrant alone.
    """
    named = reports.join(F.broadcast(by_series), "series_id", "left").join(F.broadcast(by_cik.withColumnRenamed("ticker", "cik_ticker")), "cik", "left").withColumn("ticker", F.coalesce("ticker", "cik_ticker")).where("ticker IS NOT NULL")
    month = lambda k: F.struct(F.last_day(F.add_months("report_month", k - 3)).alias("month_end"), *[F.col(f"{c}{k}").alias(c) for c in ("sales", "reinvest", "redeem")])
    rows = named.select("ticker", "accession", F.explode(F.array(month(1), month(2), month(3))).alias("m")).select("ticker", "accession", "m.*")
    some = F.coalesce("sales", "reinvest", "redeem").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    net = rows.where(some).withColumn("net", zero("sales") + zero("reinvest") - zero("redeem"))
    return net.groupBy("ticker", "month_end").agg(F.max_by("net", "accession").alias("net"))


def parse_fund_report(docs: DataFrame) -> DataFrame:
    """Series, period, net assets and three monthly returns of a fund's report (xml).

    One path asks for all fields, so that a document is parsed once; a character that XML doesn't allow stands between them.
    """
    paths = ["//*[local-name()='seriesId']", "//*[local-name()='repPdDate']", "//*[local-name()='netAssets']", *[f"//*[local-name()='monthlyTotReturn']/@rtn{k}" for k in (1, 2, 3)]]
    every = F.split(text_at(F.col("xml"), "concat(" + ", '\u0001', ".join(paths) + ")"), "\u0001")
    d = docs.select("id", every.alias("all"))
    at = lambda k: F.nullif(F.get("all", F.lit(k)), F.lit(""))
    return d.select("id", at(0).alias("series_id"), F.try_to_date(at(1)).alias("period"), at(2).try_cast("double").alias("net_assets"), F.array(*[at(k).try_cast("double") for k in (3, 4, 5)]).alias("returns"))


def parse_issuer_history(docs: DataFrame) -> DataFrame:
    """(ticker, date, nav, shares) of a worksheet's rows (text): only those with both above zero."""
    row = r'<Row>\s*<Cell>([A-Z][a-z]{2} \d{1,2}, \d{4})</Cell>\s*<Cell>([0-9.,]+)</Cell>\s*<Cell>([0-9.,]+)</Cell>'
    every = lambda k: F.regexp_extract_all("text", F.lit(row), F.lit(k))
    z = docs.select("ticker", F.explode(F.arrays_zip(every(1).alias("d"), every(2).alias("n"), every(3).alias("s"))).alias("r"))
    number = lambda c: F.translate(F.col(c), ",", "").try_cast("double")
    return z.select("ticker", F.try_to_date("r.d", "MMM d, yyyy").alias("date"), number("r.n").alias("nav"), number("r.s").alias("shares")).where("nav > 0 AND shares > 0")


def parse_daily_index(lines: DataFrame) -> DataFrame:
    """(form_type, company, cik, filed, file) of an index's lines of form 4 after its rule; fields are two blanks apart."""
    f = F.split(F.rtrim("line"), r"\s{2,}", 5)
    body = lines.where(F.col("line").rlike(r"^4(/A)?\s"))
    return body.select(f[0].alias("form_type"), f[1].alias("company"), cik10(f[2]).alias("cik"), F.coalesce(F.try_to_date(f[3], "yyyyMMdd"), F.try_to_date(f[3])).alias("filed"), f[4].alias("file"))


def parse_stake(docs: DataFrame) -> DataFrame:
    """Issuer, security, percent and event date of a stake's filing (doc), structured or else by its text; the date falls back to the filing's."""
    at = lambda n: F.nullif(F.trim(F.when(F.col("doc").startswith("<?xml"), text_at(F.col("doc"), f"//*[local-name()='{n}']"))), F.lit(""))
    text = F.regexp_replace(F.regexp_replace("doc", "<[^>]*>", " "), r"\s+", " ")
    found = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    subtype = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    event = F.coalesce(at("dateOfEvent"), found(r"(\d{1,2}/\d{1,2}/\d{4})"))
    return docs.select(
        "filing_id", F.element_at(subtype, F.upper("form_type")).alias("subtype"), F.upper(F.coalesce(at("issuerCUSIP"), found(r"(?i)CUSIP\s*(?:No\.?|Number)?:?\s*([0-9A-Z]{6,12})"))).alias("cusip"),
        F.coalesce(at("issuerName"), found(r"(?i)Name of Issuer:?\s*([A-Za-z0-9 &.,]+?)\s*(?:\(|CUSIP|$)")).alias("issuer"), F.coalesce(at("classPercent"), found(r"(?i)Percent of class[^0-9]*([0-9]+(?:\.[0-9]+)?)")).try_cast("double").alias("percent_owned"),
        F.coalesce(F.try_to_date(event, "M/d/yyyy"), F.try_to_date(event), F.col("filed")).alias("event_date"))


def load_bars(bars: DataFrame, benchmark: str, final: date) -> DataFrame:
    """Bars on the benchmark's trading days up to the last final close."""
    days = bars.where((F.col("ticker") == benchmark) & (F.col("date") <= F.lit(final))).select("date").distinct()
    return bars.join(F.broadcast(days), "date", "left_semi")

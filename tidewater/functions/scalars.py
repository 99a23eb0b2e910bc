"""Scalar rules on names, codes, dates and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from issuers' names.
LEGAL_WORDS = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "HOLDINGS", "HLDGS", "GROUP", "GRP",
    "LLC", "LP", "TRUST", "N V", "NV", "SA", "AG", "TR", "CL A", "CL B", "CLASS A", "CLASS B", "COM", "ORD", "ORDINARY", "SHARES",
)
LEGAL = r"\b(?:" + "|".join(LEGAL_WORDS) + r")\b"

#: Labels of reported event items, and those shown first.
ITEMS = {
    "1.01": "Material agreement (M&A, partnership, etc.)",
    "1.02": "Termination of material agreement",
    "2.01": "Acquisition completed",
    "2.02": "Earnings results",
    "5.02": "Officer / director change (CEO, CFO, board)",
    "5.07": "Shareholder vote results",
    "7.01": "Reg FD disclosure",
    "8.01": "Other material event",
    "9.01": "Exhibits (supporting documents)",
}
PRIORITY_ITEMS = ("1.01", "2.01", "5.02", "8.01")


def cik10(x: Column) -> Column:
    return F.lpad(x.cast("bigint").cast("string"), 10, "0")


def normalize_name(s: Column) -> Column:
    """Upper case without punctuation and legal words; '' for null."""
    blank = F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), r"[.,&/\-()']", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(blank, LEGAL, " "), r"\s+", " "))


def truncated(name: Column) -> Column:
    """A normalised name without a trailing word of one or two letters."""
    return F.regexp_replace(name, r"\s[A-Z]{1,2}$", "")


def symbol(s: Column) -> Column:
    return F.upper(F.trim(F.translate(s, "/.", "--")))


def figi_id_type(cusip: Column) -> Column:
    return F.when(cusip.rlike("^[A-Za-z]"), "ID_CINS").otherwise("ID_CUSIP")


def tri_state(s: Column) -> Column:
    """true, false or null for what wasn't reported."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("1", "true", "y"), True).when(low.isin("0", "false", "n"), False)


def has_role(roles: Column, role: str) -> Column:
    return F.coalesce(F.array_contains(F.transform(F.split(F.lower(roles), ","), lambda r: F.trim(r)), role), F.lit(False))


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2))


def latest_quarter_end(d: Column) -> Column:
    """The latest quarter end not after d."""
    q = quarter_end(d)
    return F.when(q == d, q).otherwise(F.last_day(F.add_months(q, -3)))


def reporting_quarter(d: Column, days: int = 45) -> Column:
    """The latest quarter whose deadline is strictly past on d."""
    q = latest_quarter_end(d)
    return F.when(F.date_add(q, days) >= d, F.last_day(F.add_months(q, -3))).otherwise(q)


def season(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def month_end(d: Column, k: int) -> Column:
    return F.last_day(F.add_months(d, k))


def session(ts: Column) -> Column:
    """Of a report at a UTC time: before the market, after it, within it; midnight is unknown."""
    t = F.from_utc_timestamp(ts, "America/New_York")
    minute = F.hour(t) * 60 + F.minute(t)
    return F.when(minute == 0, "unknown").when(minute < 570, "bmo").when(minute >= 960, "amc").otherwise("intraday")


def html_to_text(html: Column, n: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")), 1, n)


def item_labels(items: Column) -> Column:
    """Number and label of each of a comma list's items; an unknown item keeps its number, empty ones are left out."""
    known = F.create_map(*[F.lit(x) for k, v in ITEMS.items() for x in (k, f"{k} — {v}")])
    named = F.filter(F.transform(F.split(items, ","), lambda i: F.trim(i)), lambda i: i != "")
    return F.transform(named, lambda i: F.coalesce(F.try_element_at(known, i), i))


def priority_items(items: Column) -> Column:
    return F.exists(F.split(items, ","), lambda i: F.trim(i).isin(*PRIORITY_ITEMS))


#: Labels of forms, as they are and amended, and of insider trades by direction.
FORM_LABELS = {
    "13D": ("Activist stake", "Activist stake — updated"),
    "13G": ("Passive 5%+ stake", "Passive 5%+ — updated"),
    "13F": ("Quarterly portfolio", "Portfolio — amended"),
}
TRADE_LABELS = {"BUY": "Insider buy", "SELL": "Insider sell", "MIXED": "Insider buy + sell"}


def filing_label(form: Column, direction: Column) -> Column:
    """A form's label; insider trades by direction (BUY, SELL, MIXED or null), any other form is its own."""
    name = F.upper(form)
    trade = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRADE_LABELS.items() for x in kv]), direction), F.lit("Insider trade"))
    out = F.when(name.startswith("4"), trade)
    for code, (own, amended) in FORM_LABELS.items():
        out = out.when(name.contains(code), F.when(name.contains("/A"), amended).otherwise(own))
    return out.when(name.startswith("8-K"), "Corporate event").otherwise(form)


def universe_class(cap: Column, adv20: Column, ret_6m: Column) -> Column:
    return (
        F.when(cap.isNull() | ret_6m.isNull(), "untracked").when((cap < 3e8) | (F.coalesce(adv20, F.lit(0.0)) < 5e6), "too_illiquid")
        .when(ret_6m > 0.6, "late_stage").otherwise("tradeable")
    )

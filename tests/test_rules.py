"""Rules on hand-made rows with worked answers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import events as V
from tidewater.operators import holdings as H
from tidewater.operators import rotation as R
from tidewater.operators import scan as C
from tidewater.sources import filings as X
from tidewater.sources.sinks import Table, append_frozen, replace_run, upsert

Q = date(2001, 3, 31)
FILINGS = "filing_id string, accession string, cik string, period date, form_type string, amendment_type string, filed date"
HOLDINGS = "filing_id string, cik string, period date, cusip string, ticker string, issuer_name string, shares long, value_usd double, put_call string, sh_type string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def filing(i, kind=None, day=10):
    return (i, i, "1", Q, "13F-HR" if kind is None else "13F-HR/A", kind, date(2001, 5, day))


def lots(i, cusips, shares=10, put=None, sh="SH"):
    return [(i, "1", Q, c, None, c, shares, 1.0, put, sh) for c in cusips]


def effective(spark, filings, rows):
    f, h = spark.createDataFrame(filings, FILINGS), spark.createDataFrame(rows, HOLDINGS)
    got = H.effective_holdings(H.classified(f, h), h).collect()
    return sorted((r["filing_id"], r["cusip"]) for r in got)


@pytest.mark.parametrize(
    "filings, rows, want",
    [
        ([filing("a"), filing("b", "RESTATEMENT", 20)], lots("a", "XY") + lots("b", "Z"), [("b", "Z")]),
        ([filing("a"), filing("b", "RESTATEMENT", 20)], lots("a", "XY"), [("a", "X"), ("a", "Y")]),
        ([filing("a"), filing("b", "NEW HOLDINGS", 20)], lots("a", "X") + lots("b", "Y"), [("a", "X"), ("b", "Y")]),
        ([filing("a"), filing("b", "NEW HOLDINGS", 20)], lots("a", "X") + lots("b", "X"), [("a", "X")]),
        ([filing("a"), filing("b", "NEW HOLDINGS", 20)], lots("a", "X") + lots("b", "X", 11), [("a", "X"), ("b", "X")]),
        ([filing("a"), filing("b", "NEW HOLDINGS", 20)], lots("a", "ABCDE") + lots("b", "ABCDEF", 9), [("b", c) for c in "ABCDEF"]),
        ([filing("a", day=20), filing("b", "NEW HOLDINGS", 10)], lots("a", "X") + lots("b", "Y"), [("a", "X")]),
        ([filing("b", "NEW HOLDINGS", 10)], lots("b", "Y"), [("b", "Y")]),
        ([filing("a")], lots("a", "X") + lots("a", "Y", put="Call") + lots("a", "Z", sh="PRN"), [("a", "X")]),
        ([filing("a", "RESTATEMENT"), filing("b")], lots("a", "X") + lots("b", "Y"), [("a", "X")]),
    ],
)
def test_effective_holdings(spark, filings, rows, want):
    assert effective(spark, filings, rows) == want


@pytest.mark.parametrize("prev, cur, factor, want", [(0, 5, 1.0, "opened"), (5, None, 1.0, "exited"), (100, 110, 1.0, "added"), (100, 109, 1.0, None), (100, 90, 1.0, "trimmed"), (100, 200, 2.0, None), (100, 100, 2.0, "trimmed")])
def test_classify_change(spark, prev, cur, factor, want):
    assert one(spark, H.classify_change(F.lit(prev).cast("long"), F.lit(cur).cast("long"), F.lit(factor))) == want


def test_split_factor_is_half_open(spark):
    splits = spark.createDataFrame([("T", date(2001, 1, 1), 2.0), ("T", date(2001, 3, 31), 3.0)], "ticker string, split_date date, ratio double")
    rows = spark.createDataFrame([("T", date(2001, 1, 1), Q), ("T", date(2000, 12, 31), date(2001, 3, 30)), ("U", date(2000, 1, 1), Q)], "ticker string, a date, b date")
    assert [r["factor"] for r in H.with_split_factor(rows, splits, "a", "b").orderBy("ticker", "a").collect()] == [2.0, 3.0, 1.0]


def test_split_factors_are_of_every_pair_and_security(spark):
    from tidewater.plans import fund_queries as Fund
    from tidewater.sources.bridge import table

    sf = "/root/testdata/sf0.001"
    pairs = H.filing_pairs(Fund.snapshots(spark, sf)).select("period", "prev_period").distinct().count()
    assert Fund.QUERIES["hld_05_split_factor"](spark, sf).count() == pairs * table(spark, sf, "securities").count()


def test_reporting_quarter_needs_a_past_deadline(spark):
    assert one(spark, S.reporting_quarter(F.lit(date(2001, 5, 15)))) == date(2000, 12, 31)
    assert one(spark, S.reporting_quarter(F.lit(date(2001, 5, 16)))) == date(2001, 3, 31)


def test_names(spark):
    assert one(spark, S.normalize_name(F.lit("Acme & Co., Inc. (Class A)"))) == "ACME"
    assert one(spark, S.normalize_name(F.lit(None).cast("string"))) == ""
    assert one(spark, S.truncated(F.lit("ACME HOLD CO"))) == "ACME HOLD"


@pytest.mark.parametrize("n", [25, 26, 31, 99])
def test_quantile_groups_are_those_of_equal_width_ranks(spark, n):
    pd = pytest.importorskip("pandas")
    got = [r["g"] for r in spark.range(1, n + 1).select(V.quantile_group(F.col("id"), F.lit(n)).alias("g"), "id").orderBy("id").collect()]
    assert got == (pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1).tolist()


def test_reports_are_folded_by_the_last_kept(spark):
    days = [date(2001, 1, 1), date(2001, 1, 20), date(2001, 2, 5), date(2001, 2, 20), date(2001, 3, 20)]
    df = spark.createDataFrame([("T", d, "bmo", 1.0) for d in days], "ticker string, date date, session string, surprise double")
    assert [r["date"] for r in V.dedupe_reports(df, date(2001, 3, 1)).orderBy("date").collect()] == [days[0], days[2]]


def test_average_cost_by_hand(spark):
    rows = [(1, 1, "T", date(2001, 1, 1), "sell", 5, 9.0), (2, 1, "T", date(2001, 1, 2), "buy", 10, 10.0), (3, 1, "T", date(2001, 1, 2), "buy", 10, 20.0), (4, 1, "T", date(2001, 1, 3), "sell", 15, 20.0), (5, 1, "T", date(2001, 1, 4), "sell", 15, 5.0), (6, 1, "T", date(2001, 1, 5), "buy", 2, 7.0)]
    df = spark.createDataFrame(rows, "id long, account long, ticker string, date date, side string, qty long, price double")
    got = R.average_cost(df).orderBy("id", "closes").collect()
    assert [(r["id"], r["sold"], r["realized"]) for r in got if not r["closes"]] == [(4, 15.0, 75.0), (5, 5.0, 25.0)]
    end = next(r for r in got if r["closes"])
    assert (end["qty"], end["avg"], end["realized"]) == (2.0, 7.0, 25.0)


def test_shapes(spark):
    def of(*v):
        return one(spark, V.shapes(F.array(*[F.lit(x).cast("double") for x in v])))

    assert of(0.01, 0.01, 0.012, 0.04) == ["up_days", "jump_last"]
    assert of(-0.02, -0.02, 0.03, 0.02) == ["dip_recover"]
    assert of(0.001, -0.001, 0.001) == ["quiet"] and of(0.01, None) == []


def test_discovery_rates_by_hand(spark):
    df = spark.createDataFrame([("a", "o", 0.01), ("b", "o", 0.04), ("c", "o", 0.03), ("d", "o", 0.5)], "cut string, outcome string, p double")
    got = {r["cut"]: round(r["q"], 6) for r in C.discovery_rates(df).collect()}
    assert got == {"a": 0.04, "c": 0.053333, "b": 0.053333, "d": 0.5}


def test_planted_effect_is_confirmed_and_noise_is_not(spark):
    from datetime import timedelta

    import numpy as np

    rng, rows = np.random.default_rng(0), []
    for i in range(3000):
        day = date(1996, 1, 1) + timedelta(days=int(rng.integers(0, 1500)))
        high = bool(rng.random() < 0.4)
        rows.append((f"T{i}", day, day - timedelta(days=day.weekday()), ["vol_high"] if high else ["vol_low"], float(rng.normal(0.02 if high else -0.02, 0.05)), float(rng.normal(0, 0.05))))
    df = spark.createDataFrame(rows, "ticker string, rdate date, week_id date, names array<string>, react double, noise double")
    cut = df.select("ticker", "rdate", "week_id", "react", "noise", F.explode("names").alias("cut"), F.array(F.lit("volume")).alias("families"))
    got = {(r["cut"], r["outcome"]): r["verdict"] for r in C.verdicts(C.cut_effects(cut, ["react", "noise"], date(1998, 1, 1))).collect()}
    assert got[("vol_high", "react")] == "confirmed" and not any(v == "confirmed" for (c, o), v in got.items() if o == "noise")


def test_parsers_on_odd_texts(spark):
    docs = spark.createDataFrame([("a", "<infoTable>"), ("b", None), ("c", '<x:informationTable xmlns:x="u"><x:infoTable><x:nameOfIssuer>A</x:nameOfIssuer><x:cusip>1</x:cusip><x:value>z</x:value></x:infoTable></x:informationTable>')], "filing_id string, xml string")
    got = X.parse_info_table(docs).collect()
    assert [(r["filing_id"], r["issuer_name"], r["value_usd"], r["shares"]) for r in got] == [("c", "A", None, None)]
    assert one(spark, X.amendment_type(F.lit("<a><amendmentType>new holdings</amendmentType></a>"))) == "NEW HOLDINGS"
    assert one(spark, X.amendment_type(F.lit("<a/>"))) is None


def test_sinks_are_idempotent(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, v long, x string")
    for _ in range(2):
        upsert(t, batch, ["k"], "v")
        assert sorted(map(tuple, t.read().collect())) == [(1, 2, "b"), (2, 1, "c")]
    with pytest.raises(ValueError):
        replace_run(t, batch.where("k > 5"), "r")
    f = Table(spark, str(tmp_path / "f"))
    row = lambda *r: spark.createDataFrame([r], "k long, x string, action string")
    append_frozen(f, row(1, "a", None), ["k"])
    append_frozen(f, row(1, "b", "buy"), ["k"])
    append_frozen(f, row(1, "c", "sell"), ["k"])
    assert [tuple(r) for r in f.read().collect()] == [(1, "a", "buy")]


def test_covers_and_numbers_of_filings(spark):
    cover = "<a><x>1</x><amendmentType>New\n   Holdings</amendmentType></a>"
    assert one(spark, X.amendment_type(F.lit(cover))) == "NEW HOLDINGS"
    for broken in ("<a><amendmentType>RESTATEMENT</amendmentType>", "<a><b></a>", "", "no xml"):
        assert one(spark, X.amendment_type(F.lit(broken))) is None
    row = lambda v, n, t: f"<infoTable><nameOfIssuer>A</nameOfIssuer><cusip>1</cusip><value>{v}</value><shrsOrPrnAmt><sshPrnamt>{n}</sshPrnamt><sshPrnamtType>{t}</sshPrnamtType></shrsOrPrnAmt></infoTable>"
    xml = "<t>" + row("1,000", "1,000", "prn") + row("12.5", "7", "SH") + row("3", "7.0", "") + "</t>"
    got = X.parse_info_table(spark.createDataFrame([("f", xml), ("g", "<t><infoTable>")], "filing_id string, xml string")).collect()
    assert sorted(((r["value_usd"], r["shares"], r["sh_type"]) for r in got), key=str) == [(12.5, 7, "SH"), (3.0, None, None), (None, None, "PRN")]


def test_labels(spark):
    label = lambda form, way=None: one(spark, S.filing_label(F.lit(form), F.lit(way).cast("string")))
    assert label("SC 13D") == "Activist stake" and label("SCHEDULE 13D/A") == "Activist stake — updated" and label("4/A", "MIXED") == "Insider buy + sell"
    assert label("4") == "Insider trade" and label("13F-HR/A") == "Portfolio — amended" and label("10-Q") == "10-Q"
    assert one(spark, S.item_labels(F.lit("5.07, 3.03,"))) == ["5.07 — Shareholder vote results", "3.03"]


def test_sink_rewrites_touched_buckets_only(spark, tmp_path):
    import os

    t = Table(spark, str(tmp_path / "b"), buckets=4)
    upsert(t, spark.createDataFrame([(k, 1, "a") for k in range(40)], "key long, version int, v string"), ["key"], "version")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "b") for f in names if f.endswith(".parquet")}
    before = files()
    upsert(t, spark.createDataFrame([(3, 2, "b"), (3, 0, "old"), (3, 2, "a")], "key long, version int, v string"), ["key"], "version")
    assert len(before & files()) >= 3 and {r["key"]: r["v"] for r in t.read().collect()}[3] == "b" and t.read().count() == 40


def test_flow_filters_and_order(spark):
    rows = [("A", 3, 2e9, "Tech", 5e6, 0.2, "Strong", 2.0), ("B", 1, None, None, None, None, "Weak", 5.0), ("C", 3, 1e9, "Tech", 9e6, -0.1, "Weak", 7.0), ("D", 0, 5e9, "Oil", 1e6, 0.9, None, None)]
    df = spark.createDataFrame(rows, "ticker string, net int, market_cap double, industry string, adv20 double, ret_6m double, label string, conviction_sum double")
    names = lambda x: [r["ticker"] for r in x.collect()]
    assert names(H.sort_flows(df, "label")) == ["A", "C", "B", "D"] and names(H.sort_flows(df, "market_cap", False)) == ["C", "A", "D", "B"]
    assert names(H.filter_flows(df, industry="Unclassified")) == ["B"] and names(H.filter_flows(df, no_label=True)) == ["D"]
    assert names(H.filter_flows(df, min_adv=4e6, max_ret=0.5)) == ["A", "C"]
    assert names(H.filter_flows(df, watchlist=spark.createDataFrame([("C",), ("C",)], "ticker string"))) == ["C"]


def test_running_totals_and_extremes_over_ranges(spark):
    import random

    from tidewater.operators.running import average_ranks, running

    random.seed(4)
    rows = [(i, random.choice([None, *range(12)]), random.random()) for i in range(500)] + [(500 + i, 3, 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, v double").repartition(7)
    got = {r["id"]: r for r in running(df, [F.col("k").asc_nulls_last(), F.col("id")], {"total": (F.sum, "v"), "low": (F.min, "v"), "high": (F.max, "v")}).collect()}
    order, total, seen = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])), 0.0, []
    for i, _, v in order:
        total, seen = total + v, [*seen, v]
        assert abs(got[i]["total"] - total) < 1e-9 and got[i]["low"] == min(seen) and got[i]["high"] == max(seen)
    together = running(df, [F.col("k").asc_nulls_last()], {"total": (F.sum, "v")}, peers=True)
    assert together.where("k = 3").select(F.round("total", 9)).distinct().count() == 1
    ranks = {r["k"]: r["rank"] for r in average_ranks(df, "k", [], "rank").collect()}
    values = sorted(r[1] for r in rows if r[1] is not None)
    assert ranks == {k: sum(i for i, v in enumerate(values, 1) if v == k) / values.count(k) for k in set(values)}
    assert running(df.where("id < 0"), [F.col("id")], {"total": (F.sum, "v")}).collect() == []


def test_ranks_and_rates_have_no_task_of_all_rows(spark):
    """Single partitions are met only by a row for each range."""
    from tidewater.operators import explore as X

    tests = spark.createDataFrame([(f"c{i}", "react", (i * 37 % 100) / 100 + 0.001) for i in range(100)], "cut string, outcome string, p double")
    plan = C.discovery_rates(tests)._jdf.queryExecution().executedPlan().toString()
    moves = spark.createDataFrame([(f"t{i}", Q, i % 7 / 7, i % 5 / 5) for i in range(40)], "ticker string, rdate date, x double, y double")
    plan += X.grouped(moves, 3, False)._jdf.queryExecution().executedPlan().toString()
    for at in [i for i in range(len(plan)) if plan.startswith("Exchange SinglePartition", i)]:
        below = plan[at : at + 400]
        assert "HashAggregate" in below or "range" in below
    got = {r["cut"]: r["q"] for r in C.discovery_rates(tests).collect()}
    p = sorted((r["p"], r["cut"]) for r in tests.collect())
    least = 1.0
    for k in range(100, 0, -1):
        least = min(least, p[k - 1][0] * 100 / k)
        assert abs(got[p[k - 1][1]] - least) < 1e-12


def test_a_replaced_table_can_be_upserted(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", 4)
    rows = lambda ids, version: spark.createDataFrame([(i, version) for i in ids], "key int, version int")
    t.replace(rows(range(6), 1))
    upsert(t, rows(range(3, 9), 2), ["key"], "version")
    assert sorted(map(tuple, t.read().collect())) == [(i, 1 if i < 3 else 2) for i in range(9)]
    upsert(Table(spark, f"{tmp_path}/t", 7), rows([0, 8], 3), ["key"], "version")
    assert sorted(map(tuple, t.read().collect())) == [(i, 3 if i in (0, 8) else 1 if i < 3 else 2) for i in range(9)]
    upsert(t, rows([1], 0), ["key"], "version")
    assert t.read().where("key = 1").first()["version"] == 1


def test_repeated_bars_are_one_bar(spark):
    days = [date(2001, 1, d) for d in range(1, 11)]
    bars = [("A", d, 1.0, 2.0, 0.5, float(i + 1), 100) for i, d in enumerate(days)]
    again = [("A", days[4], 9.0, 9.0, 9.0, 9.0, 50), ("A", days[5], 1.0, 2.0, 0.5, 60.0, 500), bars[7]]
    schema = "ticker string, date date, open double, high double, low double, close double, volume long"
    bench = spark.createDataFrame([(d, 1.0 + i) for i, d in enumerate(days)] + [(days[3], 4.0)], "date date, close double")
    cal = V.calendar(bench)
    assert cal.count() == 10
    indexed = V.indexed_bars(spark.createDataFrame(bars + again, schema), cal)
    assert [(r["idx"], r["close"]) for r in indexed.orderBy("idx").collect()] == [(i, 60.0 if i == 6 else float(i)) for i in range(1, 11)]
    reports = spark.createDataFrame([("A", days[6], "bmo", 1.0, 7)], "ticker string, date date, session string, surprise double, ridx int")
    assert V.windows(reports, indexed).count() == 1
    assert C.marks(bench, cal).count() == 10


def test_an_accounts_trades_are_folded_across_batches(spark):
    n = 40_000
    rows = [(1, "A", date(2001, 1, 1), i, "sell" if i % 3 == 2 else "buy", 1.0 + i % 5, 10.0 + i % 7) for i in range(n)]
    rows += [(1, "B", date(2001, 1, 1), 1, "sell", 5.0, 9.0), (2, "A", date(2001, 1, 1), 1, "buy", 2.0, 9.0), (2, "A", date(2001, 1, 2), 2, "sell", None, 9.0), (2, "A", date(2001, 1, 3), 3, "sell", 3.0, 10.0), (None, "A", date(2001, 1, 1), 1, "buy", 0.0, 9.0)]
    ledger = spark.createDataFrame(rows, "account long, ticker string, date date, id long, side string, qty double, price double")
    got = R.average_cost(ledger)
    held = avg = realized = 0.0
    for _, _, _, _, side, qty, price in rows[:n]:
        if side == "buy":
            held, avg = held + qty, (held * avg + qty * price) / (held + qty)
        elif held > 0:
            sold = min(qty, held)
            realized, held = realized + sold * (price - avg), held - sold
    last = got.where("account = 1 AND ticker = 'A' AND closes").first()
    assert (last["qty"], last["avg"], last["realized"]) == (held, avg, realized)
    assert got.where("account = 1 AND ticker = 'A' AND NOT closes").count() == n // 3
    assert [tuple(r)[4:] for r in got.where("account = 2").orderBy("closes").collect()] == [(0.0, 9.0, 2.0, 2.0, False), (0.0, 0.0, 2.0, 0.0, True)]
    assert got.where("account IS NULL").first()["closes"] and got.where("ticker = 'B'").count() == 1


def test_days_meet_spans_once(spark):
    from tidewater.operators.intervals import within

    spans = [("A", i, date.fromordinal(730000 + 3 * i), date.fromordinal(730000 + 3 * i + k)) for i, k in enumerate([0, 1, 5, 40, 90, 91, 92, 93, 400])]
    days = [("A", date.fromordinal(729990 + i)) for i in range(450)]
    got = within(spark.createDataFrame([*spans, ("A", 99, None, Q)], "t string, s int, a date, z date"), spark.createDataFrame(days, "t string, d date"), ["t"], "a", "z", "d", 92)
    assert sorted((r["s"], r["d"]) for r in got.collect()) == [(s, d) for _, s, a, z in spans for _, d in days if a < d <= z]


def test_rows_of_a_large_file_are_read_by_their_tag(spark, tmp_path):
    """A file of many rows is split, and gives what the whole document gives."""
    one = "<{0}infoTable>\n <{0}nameOfIssuer>N {1} &amp; Co</{0}nameOfIssuer><{0}cusip>C{1}</{0}cusip><{0}value>{1}</{0}value><{0}shrsOrPrnAmt><{0}sshPrnamt>{1}</{0}sshPrnamt><{0}sshPrnamtType>sh</{0}sshPrnamtType></{0}shrsOrPrnAmt></{0}infoTable>\n"
    whole = []
    for name, prefix, n in (("a", "", 300), ("b", "ns1:", 20_000), ("c", "n:", 0)):
        head = f'<?xml version="1.0"?>\n<{prefix}informationTable xmlns{":" + prefix[:-1] if prefix else ""}="urn:t">\n'
        text = head + "".join(one.format(prefix, i) for i in range(n)) + f"</{prefix}informationTable>\n"
        (tmp_path / f"{name}.xml").write_text(text)
        whole.append((name, text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    got = X.read_info_tables(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 3
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = X.parse_info_table(spark.createDataFrame(whole, "filing_id string, xml string"))
    assert got.count() == 20_300 and got.exceptAll(want).isEmpty()


def test_rows_of_files_are_parsed_once(spark, tmp_path, capsys):
    (tmp_path / "a.xml").write_text("<t><infoTable><nameOfIssuer>N</nameOfIssuer><cusip>C</cusip></infoTable></t>")
    got = X.read_info_tables(spark, str(tmp_path))
    got.explain("extended")
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("from_xml(") == 1
    assert [(r["filing_id"], r["issuer_name"], r["cusip"]) for r in got.collect()] == [("a", "N", "C")]


def test_an_idle_keys_state_goes(spark, tmp_path):
    from tidewater.streaming import jobs as J

    def at(day):
        return f"2001-{1 + day // 28:02d}-{1 + day % 28:02d} 00:00:00"

    rows = [[("1", 0, 10.0), ("2", 0, 5.0)], [("1", 10, 11.0)], [("1", 60, 12.0)], [("1", 61, 13.0)], [("1", 62, 14.0), ("2", 62, 6.0)]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame([(int(k), at(d), v) for k, d, v in part], "key long, time string, value double")
        df.select("key", F.col("time").cast("timestamp").alias("time"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = J.landing(spark, f"{tmp_path}/in", "key long, time timestamp, value double", files=1)
    out = J.drain(J.deltas(stream, "1 day", 30), spark, f"{tmp_path}/work")
    got = sorted((r["key"], r["value"], None if r["delta"] != r["delta"] or r["delta"] is None else r["delta"]) for r in out.collect())
    assert (2, 6.0, None) in got and (1, 11.0, 1.0) in got and (1, 13.0, 1.0) in got and (1, 14.0, 1.0) in got and (1, 12.0, None) in got
    kept = spark.read.format("statestore").option("stateStoreName", "default").load(f"{tmp_path}/work/state")
    assert kept.count() == 2  # of both keys the newest; with nothing after day 20 the second one's would be gone
    for i, day in enumerate((63, 95, 96, 97)):
        spark.createDataFrame([(1, at(day), 20.0 + i)], "key long, time string, value double").select("key", F.col("time").cast("timestamp").alias("time"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    J.drain(J.deltas(stream, "1 day", 30), spark, f"{tmp_path}/work")
    assert spark.read.format("statestore").load(f"{tmp_path}/work/state").count() == 1  # the second key's is gone


def test_a_scores_own_order_is_held_against_shuffled_ones(spark):
    rows = [(Q, f"T{i}", date.fromordinal(730000 + w), float(i), i * 0.01 + (i * 7919 + w * 31) % 13 / 1000) for w in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "week_id date, ticker string, rdate date, s double, y double").withColumn("week_id", F.date_trunc("week", "rdate").cast("date"))
    assert C.placebo_test(df, "s", "y", 50).first()["p"] < 0.03
    none = C.placebo_test(df.withColumn("s", F.xxhash64("ticker", "rdate").cast("double")), "s", "y", 50).first()
    assert none["p"] > 0.03 and none["n"] == 240
    assert C.placebo_test(df.where("s < 0"), "s", "y", 5).collect() == []


def test_a_reports_list_of_actions_has_an_entry_a_day(spark):
    from tidewater.operators import events as V

    days = [date.fromordinal(730000 + k) for k in range(80)]
    cal = spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "date date, idx int")
    reports = spark.createDataFrame([("T", days[70], 71)], "ticker string, date date, ridx int")
    rows = spark.range(20_000).select(
        F.lit("T").alias("ticker"), F.lit(days[0]).alias("d"), F.expr("cast(id % 80 AS int)").alias("k"), F.element_at(F.array(F.lit("up"), F.lit("down"), F.lit("init"), F.lit("main")), F.expr("cast(id % 4 + 1 AS int)")).alias("code"), ((F.col("id") % 7 - 3) / 16).alias("pt"))
    acts = rows.select("ticker", F.date_add("d", F.col("k")).cast("timestamp").alias("ts"), "code", "pt")
    found = V.analyst_days(reports, acts, cal)
    assert found.select(F.size("actions")).first()[0] == 63
    got = found.select(C.analyst_signals(F.col("actions"), -1).alias("a")).select("a.*").first()
    near = [(k, c, p / 16) for k, c, p in ((i % 80, i % 4, i % 7 - 3) for i in range(20_000)) if 71 - 21 <= k + 1 < 71]
    points = [p for _, _, p in near if p]
    assert tuple(got) == (len(near), *[sum(c == x for _, c, _ in near) for x in (0, 1, 2)], sum(p > 0 for p in points) - sum(p < 0 for p in points), sum(points) / len(points))


def test_deltas_dont_depend_on_the_order_of_arrival(spark, tmp_path):
    from tidewater.streaming import jobs as J

    rows = [(k, f"2001-01-{d:02d} 00:00:00", float(v)) for k, d, v in ((1, 1, 10), (1, 5, 13), (1, 9, 11), (1, 9, 11), (1, 3, 12), (2, 8, 5), (2, 2, 7))]
    for part in (rows[1:3], rows[3:6], rows[:1] + rows[6:]):
        spark.createDataFrame(part, "key long, time string, value double").select("key", F.col("time").cast("timestamp").alias("time"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = J.landing(spark, f"{tmp_path}/in", "key long, time timestamp, value double", files=1)
    out = J.latest_deltas(J.drain(J.deltas(stream, "40 days", 400), spark, f"{tmp_path}/work"))
    got = sorted((r["key"], r["time"].day, r["value"], None if r["delta"] is None or r["delta"] != r["delta"] else r["delta"]) for r in out.collect())
    assert got[:2] == [(1, 1, 10.0, None), (1, 3, 12.0, 2.0)] and got[2] == (1, 5, 13.0, 1.0) and sorted(g[3] for g in got[3:5]) == [-2.0, 0.0] and got[5:] == [(2, 2, 7.0, None), (2, 8, 5.0, -2.0)]


def test_deltas_of_many_keys_are_few_calls(spark, tmp_path):
    """Keys share rows of the state, and each snapshot's change is as in a plain version, whatever its order of arrival."""
    from tidewater.streaming import jobs as J

    keep, n = 3 * 86_400_000_000, 3_000
    rows = [(None if k % 1000 == 7 else (k << 50) + k, None if (k + i) % 97 == 0 and i else 1_700_000_000_000_000 + (k * 31 + i * i * 17) % 12 * 86_400_000_000, float((k * 7 + i * 5) % 9) if (k + i) % 101 else None) for i in range(6) for k in range(n)]
    rows += [(-1, 1_004_247_000_000_000 + h * 3_600_000_000, v) for h, v in ((0, 5.0), (1, 2.0))]  # 01:30 twice in New York
    rows += [(-2, 1_004_247_000_000_000, v) for v in (1.0, 1.0, 4.0)]
    rows = [r for p in range(4) for r in rows[p::4]]
    for p in range(3):
        spark.createDataFrame(rows[p * 7000 : p * 7000 + 7000], "key long, at long, value double").select("key", F.timestamp_micros("at").alias("time"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = J.landing(spark, f"{tmp_path}/in", "key long, time timestamp, value double", files=1)
        told = J.drain(J.deltas(stream, "10000 days", 3), spark, f"{tmp_path}/work")
        got = [tuple(r) for r in J.latest_deltas(told).select("key", F.unix_micros("time"), "value", F.nanvl("delta", F.lit(None))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    last, want, by_key = float("inf"), [], {}
    for k, at, v in rows:
        by_key.setdefault(k, []).append((last if at is None else at, last if v is None else v))
    for k, held in by_key.items():
        held.sort()
        for (b, w), (at, v) in zip([(None, last), *held], held):
            near = b is not None and (at == last or at - b <= keep)
            want.append((k, None if at == last else at, None if v == last else v, v - w if near and last not in (v, w) else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert spark.read.format("statestore").load(f"{tmp_path}/work/state").count() <= 513 < n


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_few_names_are_not_shuffled_by_them(spark):
    holdings = spark.createDataFrame([("f", "N INC", "C1", None)] * 1000, "filing_id string, issuer_name string, cusip string, ticker string")
    securities = spark.createDataFrame([("N", "T1")], "name string, ticker string")
    mapped = spark.createDataFrame([("C1", "T1")], "cusip string, ticker string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        names = H.name_map(securities, mapped)
        for df, least in ((H.resolve_tickers(holdings, mapped, securities), 3), (H.backfill_tickers(holdings, names), 1)):
            assert _plan(df).count("BroadcastHashJoin") >= least
            assert df.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_fund_report_is_parsed_once(spark):
    from tidewater.sources import filings as X

    docs = spark.createDataFrame([(1, '<a><seriesId>S1</seriesId><repPdDate>2001-03-31</repPdDate><netAssets>5.5</netAssets><monthlyTotReturn rtn1="1.5" rtn2="N/A"/></a>'), (2, "<a><b></a>"), (3, None), (4, "<a/>")], "id int, xml string")
    df = X.parse_fund_report(docs)
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert got == [(1, "S1", date(2001, 3, 31), 5.5, [1.5, None, None])] + [(k, None, None, None, [None, None, None]) for k in (2, 3, 4)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("XPathStringEvaluator") == 1

"""The point-in-time library on small rows and, through the catalogue, against DuckDB."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from knowntime.functions import scalars as S
from knowntime.operators import factors, market, pit, portfolio, quality, ranking, statements
from knowntime.plans import catalogue
from knowntime.sources import documents, sinks

SF = "/root/testdata/sf0.001"
#: Views of the same backtests: a run takes half a minute, and small tables leave some runs without names.
SLOW = ("factor_backtests", "factor_backtest_equity", "factor_backtest_moves", "factor_backtest_rebalances", "stored_backtests", "backtest_outcomes")
FACT = "cik string, taxonomy string, concept string, unit string, value double, start_date date, end_date date, filing_date date, acceptance_datetime timestamp, available_at timestamp, accession_number string, form string, fiscal_year int, fiscal_period string, frame string, fact_id string"


def d(text):
    return dt.date.fromisoformat(text)


def fact(concept, value, end, known, period="FY", year=2020, start=None, form="10-K", acc="a1", unit="USD", cik="1"):
    at = dt.datetime.fromisoformat(known + "T12:00:00")
    return (cik, "us-gaap", concept, unit, float(value), d(start) if start else None, d(end), d(known), None, at, acc, form, year, period, None, f"{concept}-{end}-{known}-{acc}-{value}")


def snap(spark, rows, as_of="2024-01-01 00:00:00", period="FY", year=2020):
    req = spark.createDataFrame([("1", year, period, as_of)], "cik string, fiscal_year int, fiscal_period string, as_of string")
    return {r.concept: r for r in statements.snapshots(spark.createDataFrame(rows, FACT), req).collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.normalize_cik(lit("CIK 320193"))) == "0000320193" and one(spark, S.normalize_cik(lit("none"))) is None
    stamp = lambda t: str(one(spark, F.date_format(S.acceptance_instant(lit(t)), "yyyy-MM-dd HH:mm:ss")))
    assert stamp("2023-02-03T06:01:36.000Z") == "2023-02-03 06:01:36"
    assert stamp("2023-02-03T06:01:36") == "2023-02-03 11:01:36" and stamp("20230703060136") == "2023-07-03 10:01:36"
    assert stamp("2023-02-03") == "None" and stamp("soon") == "None"
    end = F.date_format(S.filing_available_at(lit(None).cast("timestamp"), lit("2023-07-03").cast("date")), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, end) == "2023-07-04 03:59:59"
    for text, want in (("FY2023", (2023, "FY")), ("fy-2023", (2023, "FY")), ("Q3 2023", (2023, "Q3")), ("2023q3", (2023, "Q3")), ("Q5-2023", None), ("", None)):
        got = one(spark, S.parse_period(lit(text)))
        assert (got and (got.fiscal_year, got.fiscal_period)) == want
    assert one(spark, S.ohlcv_faults(*[lit(float(x)) for x in (10, 9, 8, 10, -1)])) == ["negative_volume", "high_below_open_or_close"]
    assert one(spark, S.canonical_universe(F.array(lit(" a "), lit("B"), lit("A"), lit("")))) == ["A", "B"]
    assert one(spark, S.lenient_number(lit("1,234.5"))) == 1234.5 and one(spark, S.lenient_bool(lit(" Yes "))) is True


def test_visibility_and_restatement(spark):
    rows = [fact("Assets", 100, "2020-12-31", "2021-02-01"), fact("Assets", 120, "2020-12-31", "2021-06-01", form="10-K/A", acc="a2"), fact("Assets", 999, "2020-12-31", "2021-02-01", unit="EUR")]
    assert snap(spark, rows, "2021-01-31 00:00:00")["total_assets"].value is None
    assert snap(spark, rows, "2021-03-01 00:00:00")["total_assets"].value == 100
    late = snap(spark, rows)["total_assets"]
    assert late.value == 120 and late.is_restated and "restated_value" in late.warnings


def test_conflict_is_deterministic(spark):
    rows = [fact("Assets", 100, "2020-12-31", "2021-02-01", acc="a1"), fact("Assets", 101, "2020-12-31", "2021-02-01", acc="a2")]
    for order in (rows, rows[::-1]):
        got = snap(spark, order)["total_assets"]
        assert got.value == 101 and "conflicting_concepts" in got.warnings


def test_quarters_are_derived(spark):
    rows = [
        fact("Revenues", 10, "2020-03-31", "2020-05-01", "Q1", start="2020-01-01", form="10-Q"), fact("Revenues", 25, "2020-06-30", "2020-08-01", "Q2", start="2020-01-01", form="10-Q"), fact("Revenues", 45, "2020-09-30", "2020-11-01", "Q3", start="2020-01-01", form="10-Q"),
        fact("NetIncomeLoss", 3, "2020-03-31", "2020-05-01", "Q1", start="2020-01-01", form="10-Q"), fact("NetIncomeLoss", 9, "2020-06-30", "2020-08-01", "Q2", start="2020-01-10", form="10-Q"),
    ]
    q2, q3 = snap(spark, rows, period="Q2"), snap(spark, rows, period="Q3")
    assert q2["revenue"].value == 15 and q2["revenue"].derivation == "Q2_YTD - Q1" and q3["revenue"].value == 20
    assert q2["net_income"].value is None and "ytd_start_mismatch" in q2["net_income"].warnings
    assert snap(spark, rows, period="Q1")["revenue"].value == 10


def test_components_and_derived(spark):
    i = lambda c, v: fact(c, v, "2020-12-31", "2021-02-01")
    f = lambda c, v: fact(c, v, "2020-12-31", "2021-02-01", start="2020-01-01")
    rows = [i("CommercialPaper", 5), i("ShortTermBorrowings", 7), i("LongTermDebtCurrent", 2), i("LongTermDebtNoncurrent", 30), i("Cash", 4), f("Revenues", 100), f("CostOfRevenue", 60), f("OperatingIncomeLoss", 20), f("IncomeTaxExpenseBenefit", 5), f("Depreciation", -3),
            f("NetCashProvidedByUsedInOperatingActivities", 18), f("PaymentsToAcquirePropertyPlantAndEquipment", -6), i("StockholdersEquity", 50)]
    s = snap(spark, rows)
    want = {"short_term_debt": 9, "total_debt": 39, "gross_profit": 40, "net_debt": 35, "free_cash_flow": 12, "ebitda": 23, "nopat": 15, "invested_capital": 85, "capital_expenditures": 6}
    assert {k: s[k].value for k in want} == want and s["working_capital"].value is None


def test_future_facts_change_nothing(spark):
    rows = [fact("NetIncomeLoss", 7, "2020-12-31", "2021-02-01", start="2020-01-01"), fact("Assets", 70, "2020-12-31", "2021-02-01")]
    more = rows + [fact("Assets", 1, "2020-12-31", "2022-02-01", acc="z"), fact("NetIncomeLoss", 1, "2020-12-31", "2022-02-01", start="2020-01-01", acc="z")]
    assert snap(spark, rows, "2021-12-31 00:00:00") == snap(spark, more, "2021-12-31 00:00:00")


def test_factor_reasons(spark):
    rows = [fact("Revenues", 0, "2019-12-31", "2020-02-01", year=2019, start="2019-01-01"), fact("Revenues", 10, "2020-12-31", "2021-02-01", start="2020-01-01"), fact("NetIncomeLoss", -2, "2020-12-31", "2021-02-01", start="2020-01-01"), fact("Assets", 50, "2020-12-31", "2021-02-01")]
    req = spark.createDataFrame([("1", 2020, "FY", "2022-01-01 00:00:00")], "cik string, fiscal_year int, fiscal_period string, as_of string")
    got = {r.factor: r for r in factors.factor_results(spark.createDataFrame(rows, FACT), req).collect()}
    assert got["revenue_growth"].reason == "prior_revenue_zero" and got["revenue_growth"].warnings == ["zero_denominator"]
    assert got["roa"].value == -0.04 and got["roa"].warnings == ["roa_fallback_ending_assets"]
    assert got["price_to_earnings"].reason == "net_income_not_positive" and got["price_to_sales"].reason == "market_cap_unavailable" and got["price_to_sales"].warnings == ["market_cap_missing"]
    assert got["basic_quality_score"].value == 0.0 and len(got) == 11


def test_ranks_and_exact_top(spark):
    rows = [("g", t, v, v is not None, True, 2020) for t, v in (("a", 3.0), ("b", 5.0), ("c", 3.0), ("d", None))] + [("h", "z", 1.0, True, False, 2020)]
    df = spark.createDataFrame(rows, "g string, ticker string, value double, valid boolean, higher_is_better boolean, fiscal_year int").withColumn("reason", F.lit(None).cast("string"))
    got = {r.ticker: (r.rank, r.percentile, r.position) for r in ranking.rank_results(df, ["g"]).collect()}
    assert got == {"b": (1, 100.0, 1), "a": (2, 50.0, 2), "c": (2, 50.0, 3), "z": (1, 100.0, 1)}
    assert sorted(r.ticker for r in ranking.exact_top_n(df, ["g"], 2).collect()) == ["a", "b"]
    gone = ranking.exclusions(df, spark.createDataFrame([("g", "a"), ("g", "q")], "g string, ticker string"), ["g"]).collect()
    assert {(r.ticker, r.reason) for r in gone} == {("d", "invalid"), ("q", "unresolved")}


def walk(spark, n=300):
    rows, day = [], d("2000-01-03")
    for i in range(n):
        for s, k in (("A", 1.0), ("B", 7.5), ("M", 2.0)):
            price = 100 * (1 + 0.1 * ((i * 37) % 11 - 5) / 10) * (1 if s != "M" else 1 + 0.02 * ((i * 13) % 7)) * k
            at = dt.datetime.combine(day, dt.time(21, 15))
            rows.append((f"i{s}", s, day, price, at, at))
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "instrument_id string, symbol string, trading_date date, close double, available_at timestamp, fetched_at timestamp"), day


def test_metrics_ignore_scale_and_the_future(spark):
    bars, last = walk(spark)
    req = spark.createDataFrame([(s, "M", dt.datetime.combine(last, dt.time(0))) for s in "AB"], "symbol string, benchmark string, as_of timestamp")
    got = {(r.symbol, r.metric): r for r in market.all_metrics(bars, req).collect()}
    for m in ("momentum_12_1", "volatility_1y", "max_drawdown_1y", "beta_1y"):
        assert got["A", m].valid and abs(got["A", m].value - got["B", m].value) < 1e-9
    assert got["A", "max_drawdown_1y"].value <= 0 <= got["A", "volatility_1y"].value
    early = req.withColumn("as_of", F.lit("2000-06-01 00:00:00").cast("timestamp"))
    assert {r.reason for r in market.all_metrics(bars, early).collect()} == {"insufficient_history"}


def test_as_of_join_sides_agree(spark):
    rows = spark.createDataFrame([("k", d("2020-01-0%d" % i), float(i), dt.datetime(2020, 1, i, 21)) for i in (1, 3, 5)], "k string, t date, v double, available_at timestamp")
    asked = spark.createDataFrame([("k", d("2020-01-0%d" % i)) for i in range(1, 8)] + [("x", d("2020-01-04"))], "k string, at date")
    a = pit.latest_on_or_before(asked, rows, ["k"], "at", "t", ["v"]).collect()
    b = pit.latest_on_or_before(asked.withColumn("known", F.lit("2099-01-01").cast("timestamp")), rows, ["k"], "at", "t", ["v"], known_at="known").collect()
    assert {(r.k, r.at, r.bar_v) for r in a} == {(r.k, r.at, r.bar_v) for r in b}


def test_window_gaps_pairs_nothing(spark):
    """Windows that overlap, share ends with bars, are reversed, empty or of no series; no join, so nothing to broadcast."""
    days = ((1, 3), (3, 5), (4, 4), (6, 9), (8, 12), (9, 7))
    windows = spark.createDataFrame([(s, d("2020-01-%02d" % a), d("2020-01-%02d" % b)) for s in ("a", "b", None) for a, b in (*days, (1, 3))], "symbol string, window_start date, window_end date")
    held = {"a": (3, 3, 9, 20), "b": (), None: (4,)}
    bars = spark.createDataFrame([(s, d("2020-01-%02d" % x)) for s, all_ in held.items() for x in all_] + [("a", None)], "symbol string, trading_date date")
    found = quality.window_gaps(windows, bars)
    got = {(r.symbol, r.window_start.day, r.window_end.day): (r.bars, r.gap) for r in found.collect()}
    assert got == {(s, a, b): (0 if s is None else sum(a <= x <= b for x in held[s]), {(4, 4): "interior"}.get((a, b)) if s == "a" else None) for s in held for a, b in days}
    assert found.count() == 18 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nation_bars_round_ties_like_sql(spark, tmp_path):
    """Means of eight orders often end in half a millionth, where the shortest text of a double and its scaled value part."""
    from decimal import ROUND_HALF_UP, Decimal
    from math import floor

    import duckdb

    from knowntime.plans import adapters as A

    text = lambda x: int(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP) * 1_000_000)
    odd = [n for n in range(10_000_001, 20_000_001, 4) if text(n / 8 / 10000) != floor(n / 8 / 10000 * 1e6 + 0.5)][:20]
    assert len(odd) == 20
    rows = [(i * 8 + j, 1, n / 100 if j == 0 else 0.0, dt.datetime(1999, 1, 1) + dt.timedelta(i)) for i, n in enumerate(odd) for j in range(8)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, "here")], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = dict(con.execute(f"WITH {A.NATION_BARS_SQL} SELECT trading_date, close FROM nation_bars").fetchall())
    assert {r.trading_date: r.close for r in A.nation_bars(spark, str(tmp_path)).collect()} == want


def test_payloads_are_parsed_once(spark):
    """The filter on a payload's faults is not pushed below the parsing of its text."""
    text = json.dumps({"meta": {"currency": "USD", "timezone": "UTC"}, "values": [{"datetime": "2020-01-02", "open": "1", "high": "1", "low": "1", "close": "1", "volume": "1"}]})
    docs = spark.createDataFrame([("a", "all", text), ("b", "all", '{"status": "error"}')], "symbol string, adjustment_mode string, text string").repartition(2)
    good, bad = documents.bar_payloads(docs.select("symbol", "adjustment_mode", F.from_json("text", documents.PAYLOAD).alias("doc")))
    assert [r.symbol for r in good.collect()] == ["a"] and [(r.symbol, r.faults) for r in bad.collect()] == [("b", ["provider_error"])]
    assert good._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json(") + good._jdf.queryExecution().optimizedPlan().toString().lower().count("jsontostructs(") == 1


def test_duplicate_bars_and_upserts(spark):
    key = ("i", "p", d("2020-01-01"), "all")
    schema = "instrument_id string, provider string, trading_date date, adjustment_mode string, close double, fetched_at string"
    rows = [(*key, 1.0, "x"), (*key, 1.0, "x"), (*key[:2], d("2020-01-02"), "all", 1.0, "x"), (*key[:2], d("2020-01-02"), "all", 2.0, "x")]
    kept, counts = quality.dedup_bars(spark.createDataFrame(rows, schema), quality.BAR_KEY)
    assert kept.count() == 1 and counts.first().duplicates == 1 and counts.first().conflicting == 2
    base = spark.createDataFrame([(*key, 1.0, "old")], schema)
    new = spark.createDataFrame([(*key, 1.0, "new"), (*key[:2], d("2020-01-03"), "all", 3.0, "new")], schema)
    merged, changes = sinks.classify_bars(base, new)
    assert {r.change: r.rows for r in changes.collect()} == {"unchanged": 1, "inserted": 1}
    assert {r.close: r.fetched_at for r in merged.collect()} == {1.0: "old", 3.0: "new"}


def test_duplicate_bars_are_dealt_by_rows(spark):
    schema = "symbol string, adjustment_mode string, trading_date date, close double, volume long, currency string, fetched_at string"
    rows = [(f"s{i % 20}", "all", d("2020-01-01") + dt.timedelta(i % 60), 1.0 if i % 60 < 40 else float(i), None, (None, "")[i % 2], f"{i:03d}") for i in range(300)]
    rows += [("odd", "all", d("2020-01-01"), None, 1, "USD", "a"), ("odd", "all", d("2020-01-01"), None, None, "USD", "b"), ("nan", "all", d("2020-01-01"), float("nan"), 1, "USD", "b"), ("nan", "all", d("2020-01-01"), float("nan"), 1, "USD", "a")]
    kept, counts = quality.dedup_bars(spark.createDataFrame(rows, schema), tasks=7)
    assert kept.rdd.getNumPartitions() == 7 and "distinct" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()
    days = {}
    for r in rows:
        days.setdefault(r[:3], []).append(r)
    same = {k: v for k, v in days.items() if len({(str(r[3]), r[4], r[5] or "") for r in v}) == 1}
    assert len(same) == 41 and {tuple(r)[:3]: r.fetched_at for r in kept.collect()} == {k: min(v, key=lambda r: (r[5] or "", r[6]) if any(x[5] is None for x in v) else r[6])[6] for k, v in same.items()}
    said = {r.symbol: (r.accepted, r.duplicates, r.conflicting) for r in counts.collect()}
    assert [quality.tasks_for(n, 10) for n in (0, 99, 1990, 7999, 8000, 80_000)] == [1, 10, 200, 200, 201, 2001]
    assert said["odd"] == (0, 0, 2) and said["nan"] == (1, 1, 0) and sum(map(sum, said.values())) == len(rows)


def test_mapping_rules(spark):
    schema = "mapping_id string, instrument_id string, provider string, provider_symbol string, valid_from date, valid_to date, is_primary boolean"
    rows = [("m1", "i1", "p", "S", None, d("2019-12-31"), True), ("m2", "i1", "p", "S", d("2020-01-05"), None, True), ("m3", "i2", "p", "S", d("2021-01-01"), None, True), ("m4", "i3", "p", "T", d("2020-02-01"), d("2020-01-01"), True)]
    maps = spark.createDataFrame(rows, schema)
    assert {(r.mapping_id, r.violation) for r in quality.mapping_violations(maps).collect()} == {("m2", "symbol_reused"), ("m3", "symbol_reused"), ("m4", "validity_reversed")}
    own = spark.createDataFrame([("a", "i1", "p", "S", d("2020-01-01"), d("2020-06-01"), False), ("b", "i1", "p", "S", d("2020-03-01"), None, False), ("c", "i2", "p", "S", None, d("2019-12-31"), False)], schema)
    assert quality.mapping_violations(own).isEmpty()  # own intervals may overlap, others touch no day
    stored = spark.createDataFrame([("old", "i2", "p", "S", d("2020-01-01"), None, True)], schema)
    new = spark.createDataFrame([("new", "i1", "p", "S", d("2019-01-01"), None, True), ("fine", "i1", "p", "S", d("2018-01-01"), d("2018-12-31"), True), ("late", "i2", "p", "S", d("2020-06-01"), None, True)], schema)
    kept, bad = sinks.upsert_mappings(stored, new)
    assert {r.mapping_id for r in kept.collect()} == {"old", "fine"}
    assert {(r.mapping_id, r.violation) for r in bad.collect()} == {("new", "symbol_reused"), ("late", "two_primaries"), ("late", "symbol_reused")}
    asked = spark.createDataFrame([("i1", "p", d("2019-01-01"), d("2019-06-01")), ("i1", "p", d("2019-12-01"), d("2020-02-01")), ("i9", "p", d("2019-12-01"), d("2020-02-01"))], "instrument_id string, provider string, start_date date, end_date date")
    assert sorted((r.instrument_id, r.provider_symbol or r.reason) for r in quality.mapping_coverage(asked, maps).collect()) == [("i1", "S"), ("i1", "coverage_gap"), ("i9", "no_mapping")]


def test_overlaps_equal_the_theta_join(spark):
    import random

    rng, rows = random.Random(4), []
    for i in range(300):
        start = d("2020-01-01") + dt.timedelta(rng.randrange(400))
        rows.append((f"m{i}", f"i{rng.randrange(4)}", "p", f"S{rng.randrange(5)}", rng.choice([start, start, start, None]), rng.choice([start + dt.timedelta(rng.randrange(-1, 9)), start, None if i % 40 == 0 else start]), True))
    maps = spark.createDataFrame(rows, "mapping_id string, instrument_id string, provider string, provider_symbol string, valid_from date, valid_to date, is_primary boolean")
    span = [(m, i, s, a or d("0001-01-01"), b or d("9999-12-31")) for m, i, _, s, a, b, _ in rows]
    want = {}
    for m, i, s, a, b in span:
        days = [max(a, c) for _, j, t, c, e in span if j != i and t == s and a <= e and c <= b and c <= e]
        if days and a <= b:
            want[m] = min(days)
    assert {r.mapping_id: r.shared_from for r in pit.overlapping_mappings(maps).collect()} == want and 20 < len(want) < 300


def test_dominated_maxima_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(300)]), i) for i in range(900)]
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(45)]), rng.choice([None, *range(-5, 320)]), i % 50) for i in range(400)]
    got = pit.dominated_maxima(
        spark.createDataFrame(asked, "k string, t int, known int, x int"), spark.createDataFrame(rows, "k string, day int, at int, v int"), ["k"], "t", "known", "day", {"best": F.struct("day", "v"), "least": -F.col("v")}, "at"
    ).collect()
    want = []
    for k, t, known, x in asked:
        hit = [(d_, v) for key, d_, at, v in rows if None not in (k, key, t, known, d_, at) and key == k and d_ <= t and at <= known]
        want.append((k, t, known, x, max(hit, default=None), max([-v for _, v in hit], default=None)))
    assert sorted(((*r[:4], r.best and tuple(r.best), r.least) for r in got), key=str) == sorted(want, key=str)


def test_bands_hold_their_points(spark):
    bands = spark.createDataFrame([("a", d("2020-01-01"), d("2020-03-01")), ("a", d("2020-02-10"), d("2020-02-10")), ("a", d("2020-05-01"), d("2020-04-01")), ("b", d("1969-12-30"), d("1970-01-02"))], "k string, f date, t date")
    points = spark.createDataFrame([("a", d("2020-01-01")), ("a", d("2020-02-10")), ("a", d("2020-03-02")), ("b", d("1969-12-31")), ("b", d("1970-01-02")), ("a", None)], "k string, p date")
    found = pit.in_bands(bands, points, ["k"], "f", "t", "p", 7)
    assert sorted((r.k, str(r.f), str(r.p)) for r in found.collect()) == [("a", "2020-01-01", "2020-01-01"), ("a", "2020-01-01", "2020-02-10"), ("a", "2020-02-10", "2020-02-10"), ("b", "1969-12-30", "1969-12-31"), ("b", "1969-12-30", "1970-01-02")]


def test_factor_store_forgets_invalid_values(spark, tmp_path):
    schema = "cik string, factor string, fiscal_year int, fiscal_period string, as_of timestamp, value double, valid boolean, reason string"
    at = dt.datetime(2024, 1, 1)
    run = lambda value: spark.createDataFrame([("1", "roa", 2020, "FY", at, value, value is not None, None)], schema)
    asked = run(1.0).select(*sinks.FACTOR_VALUE_KEY)
    found = lambda: [r.value for r in sinks.lookup_factor_values(sinks.read_factor_values(spark, str(tmp_path)), asked).collect()]
    for n, (value, want) in enumerate([(0.1, [0.1]), (None, []), (0.3, [0.3])]):
        sinks.append_factor_results(str(tmp_path), run(value), f"r{n}", f"2024-02-0{n + 1} 00:00:00")
        assert found() == want
    sinks.append_factor_results(str(tmp_path), run(None), "r2", "2024-02-03 00:00:00")  # the run again, otherwise
    assert found() == [] and sorted((r.run_id, r.status) for r in sinks.read_factor_runs(spark, str(tmp_path)).collect()) == [("r0", "success"), ("r1", "unavailable"), ("r2", "unavailable")]
    sinks.compact_factor_values(spark, str(tmp_path), f"{tmp_path}-compact")
    assert spark.read.parquet(f"{tmp_path}-compact/values").count() == 1


def test_long_only_minimum():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
        cov = np.cov(x.T)
        w = portfolio.long_only_minimum(cov)
        assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()
        tries = rng.dirichlet(np.ones(5) * 0.4, 3000)
        assert w @ cov @ w <= (tries @ cov * tries).sum(1).min() + 1e-12


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_minimum_variance_of_all_nations_is_optimal(spark):
    import numpy as np

    rows = catalogue.nation_returns(spark, SF).toPandas()
    x = rows.pivot(index="d", columns="symbol", values="ret")
    weights = {r.symbol: r.weight for r in portfolio.minimum_variance_weights(spark.createDataFrame(rows)).collect()}
    cov, w = np.cov(x.to_numpy().T), np.array([weights[s] for s in x.columns])
    slope = cov @ w
    assert len(w) == 25 and abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and len(x) == 119
    assert (slope >= w @ slope * (1 - 1e-7)).all() and np.allclose(slope[w > 1e-9], w @ slope, rtol=1e-7)


def test_runs_share_windows(spark):
    rows = [(run, d("2020-01-31"), dt.datetime(2020, 1, 31, 21), s) for run, names in (("a", "XY"), ("b", "YX"), ("c", "XZ")) for s in names]
    groups, members = portfolio.shared_windows(spark.createDataFrame(rows, "run_id string, decision_date date, decision_at timestamp, symbol string"))
    assert groups.count() == 4 and {r.run_id: r.group for r in members.collect()}["a"] == {r.run_id: r.group for r in members.collect()}["b"]


def test_backtests_are_stored_whole_or_not_at_all(spark, tmp_path):
    def result(nav, runs):
        child = lambda schema, *values: spark.createDataFrame([(r, *values) for r in runs], schema)
        return {
            "runs": child("run_id string, nav double", nav), "equity": child("run_id string, trading_date date, nav double", d("2020-01-01"), nav),
            "transitions": child("run_id string, decision_date date, symbol string, nav double", d("2020-01-01"), "A", nav), "rebalances": child("run_id string, decision_date date, nav double", d("2020-01-01"), nav),
        }

    path = str(tmp_path / "store")
    found = lambda: {r.run_id: (r.nav, r.equity[0].nav, r.transitions[0].nav, r.rebalances[0].nav) for r in sinks.read_backtest(spark, path).collect()}
    sinks.write_backtest(result(1.0, ["a", "b"]), path)
    broken = result(2.0, ["a"])
    broken["rebalances"] = broken["rebalances"].select("run_id", F.expr("raise_error('disk full')").alias("nav"))
    with pytest.raises(Exception, match="disk full"):
        sinks.write_backtest(broken, path)
    assert found() == {"a": (1.0,) * 4, "b": (1.0,) * 4}
    sinks.write_backtest(result(3.0, ["a"]), path)
    assert found() == {"a": (3.0,) * 4, "b": (1.0,) * 4}
    sinks.write_backtest(result(4.0, ["a"]), path)
    sinks.vacuum_backtests(spark, path)
    assert found() == {"a": (4.0,) * 4, "b": (1.0,) * 4} and len(os.listdir(f"{path}/equity")) == 2


def test_exports_are_deterministic(spark, tmp_path):
    rows = spark.range(50).selectExpr("(id * 7) % 50 AS k", "CAST(id AS DOUBLE) / 3 AS b", "IF(id % 2 = 0, NULL, 'x') AS a")
    for n in range(2):
        sinks.export_json(rows.repartition(5 - n), str(tmp_path / str(n)), ["k"])
    lines = [[x for f in sorted(os.listdir(tmp_path / str(n))) if f.startswith("part") for x in open(tmp_path / str(n) / f).read().splitlines()] for n in range(2)]
    assert lines[0] == lines[1] and [json.loads(x)["k"] for x in lines[0]] == list(range(50)) and list(json.loads(lines[0][7])) == ["a", "b", "k"]


def test_backtest_equals_a_session_loop(spark):
    days = [d("2021-01-01") + dt.timedelta(days=i) for i in range(150)]
    price = {s: [50.0 + k * 3 + ((i * (k + 3)) % 17) for i in range(150)] for k, s in enumerate("ABCM")}
    at = lambda day: dt.datetime.combine(day, dt.time(21, 15))
    bars = spark.createDataFrame([(s, day, price[s][i], at(day)) for s in "ABCM" for i, day in enumerate(days)], "symbol string, trading_date date, close double, available_at timestamp")
    rows = []
    for k, s in enumerate("ABC"):
        rows += [fact("NetIncomeLoss", 10 + k, "2020-12-31", "2021-01-15", start="2020-01-01", cik=s), fact("Assets", 100, "2020-12-31", "2021-01-15", cik=s)]
    rows += [fact("Assets", 20, "2020-12-31", "2021-03-10", acc="b", cik="A")]  # a restatement that lifts A
    securities = spark.createDataFrame([(s, s, True) for s in "ABC"], "ticker string, cik string, is_primary boolean")
    instruments = spark.createDataFrame([(f"i{s}", s, s) for s in "ABC"], "instrument_id string, canonical_symbol string, issuer_cik string")
    schema = "run_id string, tickers array<string>, factor string, top_n int, baseline string, start_date date, end_date date, schedule string, explicit_dates array<date>, calendar_symbol string, benchmark_symbol string, cost_bps double, initial_nav double"
    base = (["a", "B", "c"], "roa", 2, "equal_weight", days[0], days[140], "monthly", None, "m", "M", 20.0, 1000.0)
    requests = spark.createDataFrame([("r1", *base), ("r2", base[0], "roa", 5, *base[3:]), ("r3", ["A", "Q"], *base[1:]), ("r4", *base[:6], "explicit", [days[20], days[60]], *base[8:])], schema)
    out = portfolio.run_backtests(requests, bars, spark.createDataFrame(rows, FACT), securities, instruments)
    runs = {r.run_id: r for r in out["runs"].collect()}
    assert runs["r1"].status == "success" and runs["r1"].leakage_violations == 0
    assert (runs["r2"].status, runs["r2"].reason) == ("unavailable", "factor_universe_too_small")
    assert (runs["r3"].status, runs["r3"].reason) == ("unavailable", "issuer_identity_unavailable")

    nav, weights, navs, turnover_sum, peak, worst = 1000.0, {}, [], 0.0, 1000.0, 0.0
    for i, day in enumerate(days[:141]):
        if i:
            growth = sum(w * price[s][i] / price[s][i - 1] for s, w in weights.items()) if weights else 1.0
            weights = {s: w * price[s][i] / price[s][i - 1] / growth for s, w in weights.items()}
            nav *= growth
            peak = max(peak, nav)
            worst = min(worst, nav / peak - 1)
            decision = days[i - 1]
            if decision.month != day.month:
                target = {"B", "C"} if decision < d("2021-03-10") else {"A", "C"}
                goal = {s: 0.5 for s in target}
                turnover = sum(abs(goal.get(s, 0) - weights.get(s, 0)) for s in set(goal) | set(weights))
                nav *= 1 - turnover * 0.002
                weights, turnover_sum = goal, turnover_sum + turnover
                worst = min(worst, nav / peak - 1)
        navs.append(nav)
    equity = out["equity"].where("run_id = 'r1'").orderBy("trading_date").collect()
    assert len(equity) == 141 and max(abs(r.nav - n) for r, n in zip(equity, navs)) < 1e-8
    assert abs(equity[-1].benchmark_nav - 1000 * price["M"][140] / price["M"][0]) < 1e-8
    assert abs(runs["r1"].gross_turnover - turnover_sum) < 1e-9 and abs(runs["r1"].total_return - (navs[-1] / 1000 - 1)) < 1e-12 and abs(runs["r1"].max_drawdown - worst) < 1e-9
    moves = out["transitions"].where("run_id = 'r1'").groupBy("decision_date").agg(F.sum("target_weight_after").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-9 for r in moves) and runs["r4"].successful_rebalance_count == 2


def test_strategy_scan(spark, tmp_path):
    good = {"name": "x", "tickers": ["a", "B", "A"], "factor": "Quality Score", "top_n": 1, "baseline": "equal_weight", "start_date": "2020-01-01", "end_date": "2021-01-01", "schedule": "monthly", "calendar_symbol": "m", "cost_bps": 1.0, "initial_nav": 1.0}
    same = {**good, "name": "y", "tickers": ["b", "a"]}
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(good), json.dumps(same), json.dumps({**good, "odd": 1}), json.dumps({**good, "top_n": 3}), "nonsense"]))
    ok, bad = documents.strategies(spark, str(tmp_path / "s.jsonl"))
    prints = [r.fingerprint for r in ok.collect()]
    assert len(prints) == 2 and prints[0] == prints[1]
    assert sorted(f for r in bad.collect() for f in r.faults if f in ("unknown_field", "top_n_exceeds_universe", "not_an_object")) == ["not_an_object", "top_n_exceeds_universe", "unknown_field"]


def test_streams_are_idempotent(spark, tmp_path):
    from knowntime.streaming import ingest

    schema = "instrument_id string, provider string, trading_date date, adjustment_mode string, open double, high double, low double, close double, volume long, currency string, exchange_timezone string, fetched_at string"
    row = lambda day, close: ("i", "p", d(day), "all", close, close, close, close, 1, "USD", "UTC", "t")
    for k, rows in enumerate(([row("2020-01-01", 1.0), row("2020-01-02", -1.0)], [row("2020-01-01", 2.0), row("2020-01-03", 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.stream_bars(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    stored = ingest.read_bars(spark, f"{tmp_path}/out")
    assert sorted((str(r.trading_date), r.close) for r in stored.collect()) == [("2020-01-01", 2.0), ("2020-01-03", 3.0)]
    assert ingest.manifest(spark, f"{tmp_path}/out", 1)["live"] == {"2020-01": 0}
    ingest.merge_bars(stored.limit(0), 1, f"{tmp_path}/out")  # a replay without rows: what the batch before left
    assert [(str(r.trading_date), r.close) for r in ingest.read_bars(spark, f"{tmp_path}/out").collect()] == [("2020-01-01", 1.0)]
    ingest.merge_bars(spark.createDataFrame([row("2020-01-01", 2.0), row("2020-01-03", 3.0)], schema), 1, f"{tmp_path}/out")
    for k in range(3):  # only the months that a batch touches are rewritten, and what they replace goes
        spark.createDataFrame([row(f"2020-0{2 + k % 2}-01", 5.0 + k)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.stream_bars(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    held = sorted(f"{b}/{p}" for b in os.listdir(f"{tmp_path}/out/rows") if b.startswith("batch") for p in os.listdir(f"{tmp_path}/out/rows/{b}") if p.startswith("part="))
    assert held == ["batch=1/part=2020-01", "batch=2/part=2020-02", "batch=3/part=2020-03", "batch=4/part=2020-02"]
    got = {(str(r.trading_date), r.close) for r in ingest.read_bars(spark, f"{tmp_path}/out").collect()}
    assert got == {("2020-01-01", 2.0), ("2020-01-03", 3.0), ("2020-02-01", 7.0), ("2020-03-01", 6.0)}


def test_merged_months_are_dealt_by_rows(spark, tmp_path):
    from knowntime.streaming import ingest

    schema = "instrument_id string, provider string, trading_date date, adjustment_mode string, close double, currency string, fetched_at string"
    row = lambda i, day, close, money, at: (f"i{i}", "p", d(day), "all", close, money, at)
    first = [row(i, day, 1.0 * i, None, "old") for i in range(150) for day in ("2020-01-01", "2020-01-02", "2020-02-03")]
    second = [row(i, "2020-01-01", 1.0 * i + (i % 3 == 0), None, "new") for i in range(150)] + [row(i, "2020-01-01", 0.5, None, "new") for i in range(0, 150, 5)]
    second += [row(200, "2020-03-01", 2.0, "", "b"), row(200, "2020-03-01", 2.0, None, "a"), row(201, "2020-04-01", 1.0, "USD", "a"), row(201, "2020-04-01", 1.0, "EUR", "a")]
    for n, rows in enumerate((first, second, second)):  # the last again, as a replay
        ingest.merge_bars(spark.createDataFrame(rows, schema), min(n, 1), str(tmp_path), task_rows=60)
    want = {r[0:3:2]: (r[4], r[6]) for r in first}
    want |= {(f"i{i}", d("2020-01-01")): (1.0 * i + 1, "new") for i in range(0, 150, 3) if i % 5} | {("i200", d("2020-03-01")): (2.0, "a")}
    got = ingest.read_bars(spark, str(tmp_path)).withColumn("file", F.input_file_name()).collect()
    assert len(got) == len(want) and {(r.instrument_id, r.trading_date): (r.close, r.fetched_at) for r in got} == want
    assert ingest.manifest(spark, str(tmp_path))["live"] == {"2020-01": 1, "2020-02": 0, "2020-03": 1}  # a month without a bar is no folder
    held = [r.file for r in got if r.trading_date == d("2020-01-01")]
    assert len(set(held)) > 3 and max(map(held.count, held)) <= 60


def test_fact_stream_keeps_the_earliest(spark, tmp_path):
    from knowntime.streaming import ingest

    first, later = fact("Assets", 1, "2020-12-31", "2021-02-01"), fact("Assets", 1, "2020-12-31", "2021-06-01")
    rows = [[first[:-1] + ("x",), later[:-1] + ("y",)], [later[:-1] + ("x",), first[:-1] + ("y",)]]
    for some in rows:
        spark.createDataFrame(some, FACT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.stream_facts(spark, f"{tmp_path}/in", FACT, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.fact_id: r.filing_date for r in ingest.read_facts(spark, f"{tmp_path}/out").collect()} == {"x": d("2021-02-01"), "y": d("2021-02-01")}


def test_fifty_fact_batches(spark, tmp_path):
    from knowntime.streaming import ingest

    def rows(n):
        return spark.createDataFrame([fact("Assets", n, "2020-12-31", "2021-02-01")[:-1] + (f"own{n}",), fact("Assets", n, "2020-12-31", f"20{70 - n}-02-01")[:-1] + ("same",)], FACT).coalesce(1)

    for n in range(50):
        ingest.append_facts(rows(n), n, str(tmp_path))
        live = ingest.manifest(spark, str(tmp_path))["live"]
        assert len(live) <= 2 * ingest.FAN and len(os.listdir(f"{tmp_path}/_manifests")) <= 4  # two, and their checksums
        files = len(os.listdir(f"{tmp_path}/rows"))
        assert files <= 4 * ingest.FAN  # what is live, and what the last batch gave up
    found = sorted(tuple(r) for r in ingest.read_facts(spark, str(tmp_path)).collect())
    assert len(found) == 51 and [r[7] for r in found if r[-1] == "same"] == [d("2021-02-01")]
    for n in (49, 49):  # replayed: the same again
        ingest.append_facts(rows(n), n, str(tmp_path))
    assert sorted(tuple(r) for r in ingest.read_facts(spark, str(tmp_path)).collect()) == found


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_backtests_store_daily_bars_and_annual_periods(spark, monkeypatch):
    from knowntime.plans import adapters

    reads = lambda df: [f for f in df.inputFiles() if "orders" in f]
    assert not reads(catalogue.dense_nation_bars(spark, SF))
    at, seen, real = dt.datetime(2000, 1, 15, 12), [], portfolio.factor_results
    monkeypatch.setattr(portfolio, "factor_results", lambda facts, requests, *more: seen.append(requests) or real(facts, requests, *more))
    pairs = spark.createDataFrame([("r", at.date(), at, None)], "run_id string, decision_date date, decision_at timestamp, reason string")
    names = spark.createDataFrame([("r", "X", "0000000001")], "run_id string, symbol string, cik string")
    portfolio._signals(spark.createDataFrame([("r", "roa", 1)], "run_id string, factor string, top_n int"), pairs, names, adapters.facts(spark, SF), None)
    assert len(seen) == 1 and not reads(seen[0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", [n for n in sorted(catalogue.oracle_sql()) if n not in SLOW])
def test_catalogue_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted(tuple("%.6f" % v if isinstance(v, float) and v == v else str(None if v is None or v != v else v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert text(got) == text(want)


def test_documents_stay_small_when_one_issuer_has_all_facts(spark):
    facts = spark.range(4000).selectExpr(
        "'0000000001' AS cik", "'Assets' AS concept", "1.5D AS value", "DATE '1998-01-01' AS start_date", "DATE '1998-12-31' AS end_date", "DATE '1999-02-01' AS filing_date",
        "CAST(id AS STRING) AS accession_number", "'10-K' AS form", "1998 AS fiscal_year", "'FY' AS fiscal_period",
    )
    (recent, archived), scanned = catalogue._submission_documents(facts, 100), catalogue._fact_documents(facts, 100)
    for made, key in ((scanned, '"accn":"'), (recent, '"10-K"'), (archived, '"10-K"')):
        held = [r.text.count(key) for r in made.collect()]
        assert sum(held) == 4000 and max(held) <= 200

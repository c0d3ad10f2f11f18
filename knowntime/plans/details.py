"""Registered queries of single scans, sinks, keys, look-ups and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.functions import dims
from knowntime.functions import scalars as S
from knowntime.functions.scratch import scratch_path
from knowntime.operators import market, pit, quality
from knowntime.plans import adapters as A
from knowntime.plans.catalogue import AS_OFS, _day, _long, _r, _with, query
from knowntime.sources import documents, sinks
from knowntime.streaming import ingest


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def _mills(c: str) -> Column:
    """Thousandths, cut between prices: engines round the sixth digit of ties differently."""
    return F.floor(F.col(c) * 1000 + 0.7295).alias(c)


# Scans --------------------------------------------------------------------------------------


def _submissions(spark, sf_dir) -> DataFrame:
    """A document per customer: names and states partly blank, tickers in mixed case, archive files in two places."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = lambda t: F.struct(F.concat(F.lit(t), n).alias("name"))
    doc = F.struct(
        n.alias("cik"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("entityType"), F.when(k % 2 == 0, "").otherwise(" 100 ").alias("sic"), F.when(k % 4 == 0, None).otherwise("DE").alias("stateOfIncorporation"), F.lit("Delaware").alias("stateOfIncorporationDescription"),
        F.array(F.concat(F.lit(" t"), n), F.concat(F.lit("T"), n), F.concat(F.lit("u"), n), F.lit(" ")).alias("tickers"), F.array(F.when(k % 5 == 0, None).otherwise("NYSE"), F.lit("OTC"), F.lit("")).alias("exchanges"),
        F.array(name("a-"), name(" c-")).alias("files"), F.struct(F.array(name(" a-"), F.struct(F.lit(" ").alias("name")), name("b-")).alias("files")).alias("filings"),
    )
    return _table(spark, sf_dir, "customer").select(F.from_json(F.to_json(doc), documents.SUBMISSIONS).alias("doc"))


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CAST(unnest([0, 1, 2]) AS BIGINT) AS position, unnest(['a-' || c_custkey, 'b-' || c_custkey, 'c-' || c_custkey]) AS name FROM customer")
def archive_files(spark, sf_dir):
    return documents.archive_manifest(_submissions(spark, sf_dir)).select("cik", _long("position").alias("position"), "name")


@query(
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN c_custkey % 3 = 0 THEN 'CIK ' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE c_name END AS legal_name, c_mktsegment AS entity_type, CASE WHEN c_custkey % 2 = 1 THEN '100' END AS sic,
    CASE WHEN c_custkey % 4 = 0 THEN 'Delaware' ELSE 'DE' END AS state_of_incorporation FROM customer"""
)
def issuer_scan(spark, sf_dir):
    return documents.issuers(_submissions(spark, sf_dir)).select("cik", "legal_name", "entity_type", "sic", "state_of_incorporation")


@query(
    """WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer)
SELECT cik, 'T' || k AS ticker, CASE WHEN k % 5 <> 0 THEN 'NYSE' WHEN k % 2 = 0 THEN 'FILLED' END AS exchange, k % 7 <> 0 AS is_primary FROM c WHERE k % 7 <> 0 UNION ALL
SELECT cik, 'T' || k, CASE WHEN k % 5 <> 0 THEN 'NYSE' END, FALSE FROM c WHERE k % 7 = 0 UNION ALL SELECT cik, 'U' || k, NULL, FALSE FROM c UNION ALL SELECT cik, 'NEW' || k, 'FILLED', TRUE FROM c WHERE k % 7 = 0"""
)
def security_scan(spark, sf_dir):
    """Listed tickers with their exchange; even customers have a resolved one, every seventh a new one."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    resolved = _table(spark, sf_dir, "customer").where((k % 2 == 0) | (k % 7 == 0)).select(n.alias("cik"), F.concat(F.when(k % 7 == 0, "new").otherwise("t"), n).alias("ticker"), F.lit("FILLED").alias("exchange"))
    return documents.securities(_submissions(spark, sf_dir), resolved).select("cik", "ticker", "exchange", "is_primary")


def _payloads(spark, sf_dir) -> DataFrame:
    """Bars as vendor payloads, a month of a supplier each: commas in prices, odd volumes, missing currencies and unknown zones."""
    items = _table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    price = lambda k: F.format_number(F.col("l_extendedprice") + k, 2)
    bar = F.struct(
        F.when(F.col("l_linenumber") == 2, "soon").otherwise(F.concat(F.col("d").cast("string"), F.lit(" 00:00:00"))).alias("datetime"), price(0).alias("open"), price(1).alias("high"), price(-1).alias("low"), price(0).alias("close"),
        F.when(F.col("l_linenumber") == 3, "many").when(F.col("l_linenumber") == 4, "1.5").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"))).alias("volume"),
    )
    k = F.col("l_suppkey")
    docs = items.groupBy("l_suppkey", F.trunc("d", "month").alias("m")).agg(F.collect_list(bar).alias("values"))
    meta = F.struct(k.cast("string").alias("symbol"), F.when(k % 5 == 0, " ").otherwise("USD").alias("currency"), F.when(k % 7 == 0, "Mars/Base").when(k % 3 == 0, "").otherwise("Asia/Tokyo").alias("exchange_timezone"), F.lit("America/New_York").alias("timezone"))
    return docs.select(k.cast("string").alias("symbol"), F.lit("all").alias("adjustment_mode"), F.from_json(F.to_json(F.struct(meta.alias("meta"), "values")), documents.PAYLOAD).alias("doc"))


_PAYLOAD_SQL = """p AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d, round(l_extendedprice, 2) AS close, CAST(l_quantity AS BIGINT) AS volume, list_filter([CASE WHEN l_suppkey % 5 = 0 THEN 'missing_currency' END,
    CASE WHEN l_suppkey % 7 = 0 THEN 'missing_timezone' END, CASE WHEN l_linenumber = 2 THEN 'malformed_date' END, CASE WHEN l_linenumber IN (3, 4) THEN 'malformed_volume' END], lambda x: x IS NOT NULL) AS faults, l_suppkey % 3 = 0 AS west FROM lineitem)"""


#: New York's summer time in the years of these tables: first Sunday of April to last Sunday of October.
_ZONE_SQL = """z AS (SELECT *, d >= make_date(year(d), 4, 1) + CAST((7 - dayofweek(make_date(year(d), 4, 1))) % 7 AS INTEGER) AND d < make_date(year(d), 10, 31) - CAST(dayofweek(make_date(year(d), 10, 31)) AS INTEGER) AS summer FROM p)"""


@query(
    _with(_PAYLOAD_SQL, _ZONE_SQL)
    + """ SELECT symbol, CAST(d AS VARCHAR) AS trading_date, close, volume, CASE WHEN west THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS exchange_timezone,
CAST(d AS VARCHAR) || CASE WHEN NOT west THEN ' 07:15:00' WHEN summer THEN ' 20:15:00' ELSE ' 21:15:00' END AS available_at FROM z WHERE len(faults) = 0"""
)
def payload_bars(spark, sf_dir):
    """Bars of vendor payloads, known a quarter after four of their own zone."""
    rows = documents.bar_payloads(_payloads(spark, sf_dir))[0]
    return rows.select("symbol", _text("trading_date"), F.col("close").cast("double").alias("close"), "volume", "exchange_timezone", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


def _error_payloads(spark, sf_dir) -> DataFrame:
    """A payload of each customer that is no list of bars, in the ways a vendor says so; each eighth is empty but fine."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 8
    code = F.when(k == 0, "401").when(k == 1, "400").when(k == 2, "429").when(k == 3, "503").when(k == 4, "404").when(k == 5, "418")
    message = F.when(k == 1, "Your API key is wrong").when(k == 4, "no such thing").otherwise(F.concat(F.lit("about symbol "), F.col("c_name")))
    status = F.when(k == 5, "ERROR").when(k == 6, "error").when(k == 7, "ok").otherwise("fail")
    values = F.when((k == 7) & (F.col("c_custkey") % 16 == 7), F.array())
    doc = F.struct(F.lit(None).alias("meta"), values.alias("values"), status.alias("status"), code.alias("code"), F.when(k != 5, message).alias("message"))
    return c.select(F.col("c_custkey").cast("string").alias("symbol"), F.lit("all").alias("adjustment_mode"), doc.cast(documents.PAYLOAD).alias("doc"))


_ERROR_SQL = """e AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'auth' WHEN 1 THEN 'auth' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'upstream' WHEN 4 THEN 'symbol' WHEN 5 THEN 'provider_error' WHEN 6 THEN 'symbol'
    ELSE CASE WHEN c_custkey % 16 <> 7 THEN 'no_values' END END AS fault FROM customer)"""


@query(_with(_ERROR_SQL) + " SELECT CAST(k AS VARCHAR) AS symbol, fault, fault IN ('rate_limit', 'upstream') AS retry, CASE k % 8 WHEN 0 THEN '401' WHEN 1 THEN '400' WHEN 2 THEN '429' WHEN 3 THEN '503' WHEN 4 THEN '404' WHEN 5 THEN '418' END AS code FROM e WHERE fault IS NOT NULL")
def payload_errors(spark, sf_dir):
    """Payloads told apart by what went wrong, and whether to ask again."""
    return documents.payload_errors(_error_payloads(spark, sf_dir)).select("symbol", "fault", "retry", F.col("code").cast("string").alias("code"))


@query(_with(_ERROR_SQL) + " SELECT fault, count(*) AS rows FROM e WHERE fault IS NOT NULL GROUP BY 1")
def payload_error_rejects(spark, sf_dir):
    """Error payloads are one rejected row each of the scan."""
    return documents.bar_payloads(_error_payloads(spark, sf_dir))[1].groupBy(F.array_join("faults", ",").alias("fault")).agg(F.count("*").alias("rows"))


@query(
    """SELECT DISTINCT upper(trim(c_mktsegment)) || '-' || (c_nationkey % 7) AS canonical_symbol, 'i' || (c_nationkey % 7) || upper(c_mktsegment) AS instrument_id FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 7 <> 6"""
)
def instruments_by_symbol(spark, sf_dir):
    """Symbols in any case and with blanks, some unknown, looked up among the instruments."""
    c, n = _table(spark, sf_dir, "customer"), (F.col("c_nationkey") % 7).cast("string")
    symbol = F.concat(F.upper("c_mktsegment"), F.lit("-"), n)
    listed = c.where("c_nationkey % 7 <> 6").select(symbol.alias("canonical_symbol"), F.concat(F.lit("i"), n, F.upper("c_mktsegment")).alias("instrument_id")).distinct()
    asked = c.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.lower(symbol))).alias("symbol")).unionByName(c.where("c_custkey % 3 = 0").select(symbol.alias("symbol")))
    return pit.instruments_of_symbols(asked, listed)


@query(
    """WITH r AS (SELECT event_id, ts FROM events WHERE value > 10), l AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS finished_at FROM r ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 12, '0') DESC LIMIT 1)
SELECT 'customer' AS name, CAST(count(*) AS VARCHAR) AS rows, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS finished_at FROM customer UNION ALL SELECT 'orders', CAST(count(*) AS VARCHAR), NULL, NULL FROM orders UNION ALL SELECT 'latest_successful_run', NULL, run_id, finished_at FROM l"""
)
def database_stats(spark, sf_dir):
    """Row counts with the latest successful run."""
    runs = _table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.col("ts").cast("timestamp").alias("finished_at"), F.when(F.col("value") > 10, "success").otherwise("failed").alias("status"))
    out = market.database_stats({n: _table(spark, sf_dir, n) for n in ("customer", "orders")}, runs)
    return out.select(F.col("table").alias("name"), _text("rows"), "run_id", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN 'momentum_12_1' WHEN 1 THEN 'momentum_12_1' WHEN 2 THEN 'volatility_1y' WHEN 3 THEN 'beta_1y' WHEN 4 THEN 'max_drawdown_1y' WHEN 5 THEN 'max_drawdown_1y' WHEN 6 THEN 'volatility_1y' WHEN 7 THEN 'beta_1y' END AS metric FROM customer"""
)
def metric_names(spark, sf_dir):
    """Names of metrics in their shorter and odder spellings."""
    names = ["momentum-12-1", " Momentum ", "volatility", "BETA", "max drawdown", "drawdown", "Volatility-1Y", "beta_1y", "sharpe"]
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, names)), (k % 9 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(k.alias("k"), S.resolve_alias(name, dims.METRIC_ALIASES, dims.METRICS).alias("metric"))


@query(_with(_PAYLOAD_SQL) + " SELECT symbol, array_to_string(faults, ',') AS faults, count(*) AS rows FROM p WHERE len(faults) > 0 GROUP BY 1, 2")
def payload_rejects(spark, sf_dir):
    return documents.bar_payloads(_payloads(spark, sf_dir))[1].groupBy("symbol", F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("rows"))


@query(
    _with(A.bars_sql("l_suppkey"))
    + " SELECT symbol, CAST(trading_date AS VARCHAR) AS trading_date, round(close, 6) AS close FROM bars WHERE symbol = '3' AND trading_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND trading_date < DATE '1999-06-30' ORDER BY trading_date LIMIT 200"
)
def one_instruments_bars(spark, sf_dir):
    """The first bars of an instrument in a range, as known at a time."""
    rows = market.scan_bars(A.bars(spark, sf_dir, "l_suppkey"), "i_3", "1997-01-01", "1999-12-31", "all", "table", "1999-06-30 00:00:00", 200)
    return rows.select("symbol", _text("trading_date"), _r("close").alias("close"))


@query(_with(A.bars_sql("l_suppkey")) + " SELECT symbol, count(*) AS bars, CAST(max(trading_date) AS VARCHAR) AS last_date FROM bars WHERE symbol IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def chosen_instruments_bars(spark, sf_dir):
    rich = _table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("i_"), F.col("s_suppkey").cast("string")).alias("instrument_id"))
    return market.scan_bars_for(A.bars(spark, sf_dir, "l_suppkey"), rich).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("trading_date").cast("string").alias("last_date"))


# Scalars ------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT event_id, ts, CAST(ts AS DATE) AS d FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') END AS accepted,
       CASE WHEN event_id % 5 < 3 THEN strftime(date_trunc('second', ts) + CASE event_id % 5 WHEN 0 THEN INTERVAL (-2) HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') ELSE CASE WHEN event_id % 5 = 3 THEN strftime(d + 1, '%Y-%m-%d') || ' 04:59:59' ELSE '9999-12-31 23:59:59' END END AS available,
       strftime(d, '%Y-%m-%d') || ' 21:15:00' AS bar_available, CASE event_id % 2 WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' 23:59:59' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS as_of FROM t"""
)
def availability_times(spark, sf_dir):
    """Acceptance texts in five shapes, and when filings and bars become known (events lie in winter)."""
    e = _table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    k, stamp = F.col("event_id") % 5, lambda f: F.date_format("ts", f)
    text = F.when(k == 0, F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200"))).when(k == 1, stamp("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, stamp("yyyyMMddHHmmss")).when(k == 3, stamp("yyyy-MM-dd")).otherwise("soon")
    accepted, day = S.acceptance_instant(text), F.to_date("ts")
    known = S.filing_available_at(accepted, F.when(k != 4, day))
    asked = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), stamp("yyyy-MM-dd"))).otherwise(stamp("yyyy-MM-dd HH:mm:ss"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", show(accepted).alias("accepted"), show(known).alias("available"), show(S.bar_available_at(day, F.lit("America/New_York"))).alias("bar_available"), show(S.parse_as_of(asked)).alias("as_of"))


@query(
    _with(A.FACTS_SQL)
    + """ SELECT accession_number, substr(sha256(cik || '|us-gaap|' || concept || '|USD|' || CASE WHEN concept = 'Assets' THEN '' ELSE fiscal_year || '-01-01' END || '|' || fiscal_year || '-12-31|' || CAST(CAST(CAST(value AS DECIMAL(18, 2)) AS DECIMAL(38, 10)) AS VARCHAR) || '|' || accession_number || '|' || form || '|' || fiscal_year || '|FY|'), 1, 32) AS fact_key FROM facts"""
)
def fact_keys(spark, sf_dir):
    return A.facts(spark, sf_dir).select("accession_number", S.fact_key().alias("fact_key"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, 'Q' || quarter(o_orderdate) AS q, o_orderkey % 400 AS days, o_totalprice AS v FROM orders)
SELECT k, y - 1 AS prior_year, CASE q WHEN 'Q2' THEN 'Q1' WHEN 'Q3' THEN 'Q2' WHEN 'Q4' THEN 'Q3' END AS prior_quarter, q || '_YTD' AS ytd, days, q <> 'Q1' AND days > 130 AS is_ytd, round(CASE k % 3 WHEN 0 THEN abs(-v) WHEN 1 THEN v ELSE -v END, 2) AS signed,
       CASE k % 4 WHEN 0 THEN 'price_to_earnings' WHEN 1 THEN 'free_cash_flow' WHEN 2 THEN 'basic_quality_score' END AS factor FROM o"""
)
def period_arithmetic(spark, sf_dir):
    """Neighbouring periods, cumulative durations, signs and names of factors."""
    o = _table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    k, q = F.col("o_orderkey"), F.concat(F.lit("Q"), F.quarter("d").cast("string"))
    days = S.duration_days(F.col("d"), F.date_add("d", (k % 400).cast("int")))
    mode = F.when(k % 3 == 0, "abs").when(k % 3 == 1, "negate").otherwise("identity")
    alias = F.when(k % 4 == 0, " P-E ").when(k % 4 == 1, "Free Cash-Flow").when(k % 4 == 2, "quality").otherwise("luck")
    return o.select(
        k.alias("k"), S.prior_comparable(F.year("d")).cast("long").alias("prior_year"), S.prior_quarter(q).alias("prior_quarter"), S.ytd_label(q).alias("ytd"), days.cast("long").alias("days"), S.looks_ytd(days, q).alias("is_ytd"),
        _r(S.apply_sign(-F.col("o_totalprice"), mode), 2).alias("signed"), S.resolve_alias(alias, dims.FACTOR_ALIASES, dims.FACTORS).alias("factor"),
    )


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'A' || c_custkey || ',B' ELSE 'A' || c_custkey || ',' || upper(c_mktsegment) || ',B' END AS universe, 'one,' || lower(c_mktsegment) || ',two' AS words,
    '{"a":"' || c_custkey || '","name":"' || c_name || '"}' AS metadata FROM customer"""
)
def ordered_lists(spark, sf_dir):
    """Symbols and warnings in first-seen order, and metadata without keys."""
    n, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    symbols = F.array(F.concat(F.lit(" a"), n), F.when(F.col("c_custkey") % 3 != 0, segment), F.lit("b"), F.concat(F.lit("A"), n), F.lit(" "))
    words = S.ordered_unique(F.array(F.lit("one"), F.lower(segment)), F.array(F.lit("two"), F.lit(None).cast("string"), F.lit("one")), F.lit(None).cast("array<string>"))
    meta = S.metadata_json(F.create_map(F.lit("name"), F.col("c_name"), F.lit("api_KEY"), F.lit("x"), F.lit("a"), n))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(S.canonical_universe(symbols), ",").alias("universe"), F.array_join(words, ",").alias("words"), meta.alias("metadata"))


def _strategies(spark, sf_dir) -> DataFrame:
    """A request per customer with one thing wrong in each of twelve, nothing in the rest."""
    k = F.col("c_custkey") % 15
    day = lambda t: F.lit(t).cast("date")
    dates = F.when(k == 9, F.array().cast("array<date>")).when(k == 10, F.array(day("1999-01-05"))).when(k == 11, F.array(day("2005-01-01")))
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.when(k == 0, F.array(F.lit(" "))).otherwise(F.array(F.col("c_mktsegment"), F.lit("b"), F.lit("a"))).alias("tickers"), F.when(k == 3, "luck").otherwise("quality score").alias("factor"), F.when(k <= 1, 0).when(k == 2, 9).otherwise(2).alias("top_n"),
        F.when(k == 4, "guess").otherwise("equal_weight").alias("baseline"), day("1999-01-01").alias("start_date"), F.when(k == 6, day("1998-01-01")).otherwise(day("2001-01-01")).alias("end_date"), F.when(k == 5, "daily").when(k.isin(9, 11), "explicit").otherwise("monthly").alias("schedule"),
        dates.alias("explicit_dates"), F.lit("M").alias("calendar_symbol"), F.when(k == 7, -1.0).otherwise(2.0).alias("cost_bps"), F.when(k == 8, 0.0).otherwise(1.0).alias("initial_nav"),
    )


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 15 WHEN 0 THEN 'empty_universe,top_n_below_one' WHEN 1 THEN 'top_n_below_one' WHEN 2 THEN 'top_n_exceeds_universe' WHEN 3 THEN 'unknown_factor' WHEN 4 THEN 'unknown_baseline' WHEN 5 THEN 'unknown_schedule' WHEN 6 THEN 'dates_not_ordered'
    WHEN 7 THEN 'invalid_cost' WHEN 8 THEN 'invalid_nav' WHEN 9 THEN 'explicit_dates_missing' WHEN 10 THEN 'explicit_dates_unexpected' WHEN 11 THEN 'explicit_date_outside_range' ELSE '' END AS faults FROM customer"""
)
def request_faults(spark, sf_dir):
    return _strategies(spark, sf_dir).select("k", F.array_join(S.request_faults(), ",").alias("faults"))


@query(
    """SELECT faults, count(*) AS lines FROM (SELECT CASE c_custkey % 15 WHEN 0 THEN 'empty_universe,top_n_below_one' WHEN 1 THEN 'top_n_below_one' WHEN 2 THEN 'top_n_exceeds_universe' WHEN 3 THEN 'unknown_factor' WHEN 4 THEN 'unknown_baseline' WHEN 5 THEN 'unknown_schedule' WHEN 6 THEN 'dates_not_ordered'
    WHEN 7 THEN 'invalid_cost' WHEN 8 THEN 'invalid_nav' WHEN 9 THEN 'explicit_dates_missing' WHEN 10 THEN 'explicit_dates_unexpected' WHEN 11 THEN 'explicit_date_outside_range' WHEN 12 THEN 'unknown_field' WHEN 13 THEN 'duplicate_field' END AS faults FROM customer WHERE c_custkey % 15 <> 14)
    GROUP BY 1 UNION ALL SELECT 'good:' || count(*), count(DISTINCT upper(c_mktsegment)) FROM customer WHERE c_custkey % 15 = 14"""
)
def strategy_scan(spark, sf_dir):
    """Requests as lines of JSON, read back: faults of the rejected ones, number and fingerprints of the good."""
    rows, k = _strategies(spark, sf_dir), F.col("k") % 15
    line = F.to_json(F.struct(F.col("k").cast("string").alias("name"), *[c for c in rows.columns if c != "k"]))
    line = F.when(k == 12, F.concat(F.lit('{"odd":1,'), F.substring(line, F.lit(2), F.length(line)))).when(k == 13, F.concat(F.lit('{"name":"x",'), F.substring(line, F.lit(2), F.length(line)))).otherwise(line)
    path = scratch_path(spark)
    rows.select(line.alias("value")).write.text(path)
    good, bad = documents.strategies(spark, path)
    total = good.agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("lines")).select(F.concat(F.lit("good:"), F.col("n").cast("string")).alias("faults"), "lines")
    return bad.groupBy(F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("lines")).unionByName(total)


@query(
    """SELECT c_custkey AS k, sha256('{"cost_bps":2.0,"factor":"basic_quality_score","tickers":["' || array_to_string(list_sort([upper(c_mktsegment), 'A', 'B']), '","') || '"]}') AS fingerprint FROM customer"""
)
def request_fingerprints(spark, sf_dir):
    """Equal requests have equal fingerprints, however their symbols are written."""
    rows = _table(spark, sf_dir, "customer").withColumns({"tickers": F.array(F.lit(" b"), F.lower("c_mktsegment"), F.lit("A"), F.lit("B")), "factor": F.lit("Quality-Score"), "cost_bps": F.lit(2.0)})
    return rows.select(F.col("c_custkey").alias("k"), S.request_fingerprint({c: F.col(c) for c in ("tickers", "factor", "cost_bps")}).alias("fingerprint"))


# Look-ups -----------------------------------------------------------------------------------


@query(
    _with(A.FACTS_SQL)
    + " SELECT accession_number, form, CAST(filing_date AS VARCHAR) AS filing_date FROM facts WHERE cik = '0000000007' AND form = '10-K/A' ORDER BY facts.filing_date DESC, accession_number DESC LIMIT 50"
)
def newest_filings(spark, sf_dir):
    return pit.filings_of(A.facts(spark, sf_dir), A.securities(spark, sf_dir), " nation_7", "10-k/a", 50).select("accession_number", "form", _text("filing_date"))


@query(
    """SELECT upper(c_name) AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'own-' || c_custkey WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 10, '0') END AS cik FROM customer"""
)
def issuers_of_symbols(spark, sf_dir):
    """The instrument's issuer, else the primary security's, else none."""
    rows, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    symbols = rows.select(F.upper("c_name").alias("symbol"))
    instruments = rows.where(k % 3 < 2).select(F.upper("c_name").alias("canonical_symbol"), F.when(k % 3 == 0, F.concat(F.lit("own-"), k.cast("string"))).alias("issuer_cik"))
    listed = rows.where(k % 2 == 0).select(F.concat(F.lit(" "), "c_name").alias("ticker"), F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik"), F.lit(True).alias("is_primary"))
    second = listed.select("ticker", F.lit("0").alias("cik"), F.lit(False).alias("is_primary"))
    return pit.issuers_of_symbols(symbols, instruments, listed.unionByName(second))


def _mappings(spark, sf_dir) -> DataFrame:
    """An order maps its customer to one of 50 symbols for some days, or for ever; some are reversed."""
    o = _table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    until = F.when(F.col("o_orderkey") % 97 != 0, F.date_add("d", (F.col("o_orderkey") % 7 - 1).cast("int")))
    rows = o.select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("instrument_id"), F.lit("table").alias("provider"), F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("provider_symbol"), F.col("d").alias("valid_from"), until.alias("valid_to"), (F.col("o_orderkey") % 2 == 0).alias("is_primary"))
    rows = rows.groupBy("instrument_id", "provider", "provider_symbol", "valid_from", "valid_to").agg(F.bool_or("is_primary").alias("is_primary"))
    return rows.withColumn("mapping_id", S.mapping_id(*[F.col(c) for c in ("instrument_id", "provider", "provider_symbol", "valid_from", "valid_to")]))


_MAPPINGS_SQL = """om AS (SELECT 'i' || o_custkey AS instrument_id, 'S' || (o_custkey % 50) AS provider_symbol, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 - 1 AS INTEGER) END AS valid_to, bool_or(o_orderkey % 2 = 0) AS is_primary FROM orders GROUP BY 1, 2, 3, 4),
mappings AS (SELECT *, 'map_' || substr(sha256(instrument_id || '|table|' || provider_symbol || '|' || valid_from || '|' || coalesce(CAST(valid_to AS VARCHAR), '')), 1, 16) AS mapping_id, coalesce(valid_to, DATE '9999-12-31') AS until FROM om),
pairs AS (SELECT a.mapping_id, a.instrument_id, a.provider_symbol, greatest(a.valid_from, b.valid_from) AS day, 'symbol_reused' AS violation FROM mappings a JOIN mappings b
          ON a.provider_symbol = b.provider_symbol AND a.instrument_id <> b.instrument_id AND a.valid_from <= b.until AND b.valid_from <= a.until WHERE a.valid_from <= a.until AND b.valid_from <= b.until UNION ALL
          SELECT a.mapping_id, a.instrument_id, a.provider_symbol, greatest(a.valid_from, b.valid_from), 'two_primaries' FROM mappings a JOIN mappings b
          ON a.instrument_id = b.instrument_id AND a.mapping_id <> b.mapping_id AND a.valid_from <= b.until AND b.valid_from <= a.until WHERE a.valid_from <= a.until AND b.valid_from <= b.until AND a.is_primary AND b.is_primary),
broken AS (SELECT mapping_id, 'validity_reversed' AS violation FROM mappings WHERE valid_from > valid_to UNION ALL SELECT DISTINCT mapping_id, violation FROM pairs)"""


@query(
    _with(_MAPPINGS_SQL)
    + """, asked AS (SELECT 'i' || c_custkey AS instrument_id, unnest([DATE '1996-06-30', DATE '1999-01-15', DATE '2001-12-31']) AS day FROM customer)
SELECT a.instrument_id, CAST(a.day AS VARCHAR) AS day, m.mapping_id, m.provider_symbol FROM asked a JOIN mappings m ON m.instrument_id = a.instrument_id AND m.valid_from <= a.day AND a.day <= m.until
QUALIFY row_number() OVER (PARTITION BY a.instrument_id, a.day ORDER BY m.valid_from DESC, m.mapping_id DESC) = 1"""
)
def symbols_in_force(spark, sf_dir):
    days = F.explode(F.array(*[F.lit(t).cast("date") for t in ("1996-06-30", "1999-01-15", "2001-12-31")]))
    asked = _table(spark, sf_dir, "customer").select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("instrument_id"), F.lit("table").alias("provider"), days.alias("day"))
    return pit.valid_on(asked, _mappings(spark, sf_dir)).select("instrument_id", _text("day"), "mapping_id", "provider_symbol")


@query(_with(_MAPPINGS_SQL) + " SELECT mapping_id, instrument_id, provider_symbol, CAST(min(day) AS VARCHAR) AS shared_from FROM pairs WHERE violation = 'symbol_reused' GROUP BY 1, 2, 3")
def overlapping_mappings(spark, sf_dir):
    return pit.overlapping_mappings(_mappings(spark, sf_dir)).select("mapping_id", "instrument_id", "provider_symbol", _text("shared_from"))


@query(_with(_MAPPINGS_SQL) + " SELECT * FROM broken")
def mapping_violations(spark, sf_dir):
    return quality.mapping_violations(_mappings(spark, sf_dir))


@query(_with(_MAPPINGS_SQL) + " SELECT mapping_id, is_primary FROM mappings m WHERE substr(mapping_id, 5, 1) > '7' OR NOT EXISTS (SELECT 1 FROM broken b WHERE b.mapping_id = m.mapping_id)")
def mapping_upserts(spark, sf_dir):
    """Half of the mappings are stored; of the others those enter that break nothing."""
    rows, old = _mappings(spark, sf_dir), F.substring("mapping_id", 5, 1) > "7"
    return sinks.upsert_mappings(rows.where(old), rows.where(~old))[0].select("mapping_id", "is_primary")


# Sinks --------------------------------------------------------------------------------------


@query(
    _with(A.FACTS_SQL)
    + " SELECT accession_number, cik, round(CASE WHEN CAST(cik AS INTEGER) % 4 = 0 THEN value * 2 ELSE value END, 2) AS value FROM facts WHERE CAST(cik AS INTEGER) % 4 <> 0 OR fiscal_year >= 1998"
)
def replaced_facts(spark, sf_dir):
    """Every fourth issuer's facts are replaced by those from 1998 on, doubled."""
    rows = A.facts(spark, sf_dir).select("accession_number", "cik", "fiscal_year", "value")
    incoming = rows.where((F.col("cik").cast("int") % 4 == 0) & (F.col("fiscal_year") >= 1998)).withColumn("value", F.col("value") * 2)
    return sinks.replace_by_key(rows, incoming, ["cik"]).select("accession_number", "cik", _r("value", 2).alias("value"))


@query(
    _with(A.bars_sql("l_suppkey"))
    + """, n AS (SELECT symbol, trading_date, CASE WHEN day(trading_date) % 3 = 0 THEN close + 1 ELSE close END AS close FROM bars WHERE trading_date >= DATE '1999-01-01'), o AS (SELECT symbol, trading_date, close FROM bars WHERE trading_date < DATE '2000-06-01')
SELECT coalesce(n.symbol, o.symbol) AS symbol, CAST(coalesce(n.trading_date, o.trading_date) AS VARCHAR) AS trading_date, CAST(floor(coalesce(n.close, o.close) * 1000 + 0.7295) AS BIGINT) AS close, CASE WHEN n.symbol IS NULL OR n.close IS NOT DISTINCT FROM o.close THEN 'old' ELSE 'new' END AS fetched_at
FROM n FULL JOIN o ON n.symbol = o.symbol AND n.trading_date = o.trading_date"""
)
def merged_bars(spark, sf_dir):
    """Bars after an upsert: unchanged ones keep when they were fetched."""
    bars = A.bars(spark, sf_dir, "l_suppkey").select("instrument_id", "provider", "trading_date", "adjustment_mode", "close", F.lit("old").alias("fetched_at"))
    new = bars.where("trading_date >= date'1999-01-01'").withColumn("close", F.when(F.dayofmonth("trading_date") % 3 == 0, F.col("close") + 1).otherwise(F.col("close"))).withColumn("fetched_at", F.lit("new"))
    merged = sinks.classify_bars(bars.where("trading_date < date'2000-06-01'"), new)[0]
    return merged.select(F.expr("substring(instrument_id, 3)").alias("symbol"), _text("trading_date"), _mills("close"), "fetched_at")


def _identities(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    base = rows.where(k % 5 != 0).select(k.alias("k"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"), F.lit("old").alias("note"))
    return base, rows.where(k % 3 == 0).select(k.alias("k"), F.col("c_mktsegment").alias("segment"), F.when(k % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("nation"))


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 7 <> 0) THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation,
    CASE WHEN c_custkey % 5 <> 0 THEN 'old' END AS note FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0"""
)
def enriched_identities(spark, sf_dir):
    return sinks.enrich(*_identities(spark, sf_dir), "k", ["segment", "nation"])[0]


@query("SELECT c_custkey AS k, 'nation' AS conflict FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 7 = 0")
def identity_conflicts(spark, sf_dir):
    return sinks.enrich(*_identities(spark, sf_dir), "k", ["segment", "nation"])[1].select("k", F.array_join("conflict", ",").alias("conflict"))


@query(
    """WITH s AS (SELECT l_suppkey % 10 AS k, count(DISTINCT l_returnflag) AS flags, min(l_returnflag) AS low FROM lineitem WHERE l_suppkey % 10 < 8 AND (l_suppkey % 10 < 6 AND l_returnflag = 'A' OR l_suppkey % 10 >= 6) GROUP BY 1), i AS (SELECT DISTINCT l_suppkey % 10 AS k FROM lineitem)
SELECT 'i' || i.k AS instrument_id, CASE WHEN i.k % 3 = 0 THEN 'A' WHEN s.flags = 1 AND i.k % 3 <> 1 THEN s.low WHEN i.k % 3 = 1 THEN 'B' ELSE '?' END AS currency, i.k % 3 <> 2 OR coalesce(s.flags = 1, FALSE) AS metadata_confirmed FROM i LEFT JOIN s ON s.k = i.k"""
)
def confirmed_metadata(spark, sf_dir):
    """Placeholders are confirmed by the first trusted currency; confirmed ones stay."""
    items = _table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey") % 10)
    name = F.concat(F.lit("i"), F.col("k").cast("string")).alias("instrument_id")
    n = F.col("k") % 3
    known = items.select("k").distinct().select(name, F.when(n == 0, "A").when(n == 1, "B").otherwise("?").alias("currency"), F.lit("UTC").alias("exchange_timezone"), F.when(n < 2, True).alias("metadata_confirmed"))
    seen = items.where((F.col("k") < 8) & ((F.col("l_returnflag") == "A") | (F.col("k") >= 6))).select(name, F.col("l_returnflag").alias("currency"), F.lit("UTC").alias("exchange_timezone"))
    return sinks.confirm_metadata(known, seen)[0].select("instrument_id", "currency", "metadata_confirmed")


def _factor_runs(spark, sf_dir) -> str:
    """A store of three runs over the same keys: events of one to three days each; values of 2 or less are invalid."""
    path = scratch_path(spark)
    events = _table(spark, sf_dir, "events")
    for run in range(3):
        rows = events.where(F.col("event_id") % 3 == run).groupBy("user_id", (F.col("event_id") % 11).alias("p")).agg(F.max_by("value", "event_id").alias("value"))
        ok = F.col("value") > 2
        results = rows.select(F.col("user_id").cast("string").alias("cik"), F.lit("roa").alias("factor"), F.col("p").alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.lit(AS_OFS[0]).alias("as_of"), F.when(ok, _r("value", 4)).alias("value"), ok.alias("valid"), F.when(~ok, "too_small").alias("reason"))
        sinks.append_factor_results(path, results, f"run-{run}", f"2024-01-0{run + 1} 00:00:00")
    return path


_FACTOR_RUNS_SQL = """g AS (SELECT event_id % 3 AS run, user_id AS u, event_id % 11 AS p, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3),
latest AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY u, p ORDER BY run DESC) = 1)"""


@query(_with(_FACTOR_RUNS_SQL) + " SELECT CAST(u AS VARCHAR) AS cik, p AS fiscal_year, round(value, 4) AS value FROM latest WHERE value > 2 AND p % 2 = 0")
def stored_factor_values(spark, sf_dir):
    """Three runs store their results; a look-up finds the latest of each key, if that is valid."""
    values = sinks.read_factor_values(spark, _factor_runs(spark, sf_dir))
    asked = values.where("fiscal_year % 2 = 0").select(*sinks.FACTOR_VALUE_KEY)
    return sinks.lookup_factor_values(values, asked).select("cik", _long("fiscal_year").alias("fiscal_year"), "value")


@query(_with(_FACTOR_RUNS_SQL) + " SELECT 'run-' || run AS run_id, CASE WHEN value > 2 THEN 'success' ELSE 'unavailable' END AS status, count(*) AS rows, CAST(sum(p) AS BIGINT) AS years FROM g GROUP BY 1, 2")
def factor_run_log(spark, sf_dir):
    """The log of the three runs, read back after the store was compacted."""
    path, compact = _factor_runs(spark, sf_dir), scratch_path(spark)
    sinks.compact_factor_values(spark, path, compact)
    return sinks.read_factor_runs(spark, compact).groupBy("run_id", "status").agg(F.count("*").alias("rows"), F.sum("fiscal_year").alias("years"))


@query(
    """SELECT c_custkey AS k, '{"account":' || CASE WHEN c_custkey % 9 = 0 THEN '0' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',"name":"' || c_name || '"' END || '}' AS value FROM customer"""
)
def exported_rows(spark, sf_dir):
    """Rows as JSON, fields in name order, missing ones left out."""
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 2 != 0, F.col("c_name")).alias("name"), F.when(k % 9 == 0, 0).otherwise(F.floor("c_acctbal")).cast("long").alias("account"))
    return _exported(rows)


def _exported(rows: DataFrame) -> DataFrame:
    made = sinks.json_rows(rows)
    return made.select(F.get_json_object("value", "$.k").cast("long").alias("k"), F.regexp_replace("value", ',"k":[0-9]+', "").alias("value"))


# Quality ------------------------------------------------------------------------------------


def _fetched(spark, sf_dir) -> DataFrame:
    """Bars of a supplier fetched in two overlapping windows; some days differ, every ninth supplier changes currency."""
    bars = A.bars(spark, sf_dir, "l_suppkey").select("symbol", "adjustment_mode", "trading_date", "close", "currency", "exchange_timezone")
    one = bars.where("trading_date < date'1998-07-01'").withColumn("window_start", F.lit("a"))
    two = bars.where("trading_date >= date'1998-01-01'").withColumn("close", F.when(F.dayofmonth("trading_date") == 5, F.col("close") + 1).otherwise(F.col("close"))).withColumn("currency", F.when(F.col("symbol").cast("int") % 9 == 0, "EUR").otherwise(F.col("currency"))).withColumn("window_start", F.lit("b"))
    return one.unionByName(two).withColumn("window_end", F.col("window_start"))


@query(
    _with(A.bars_sql("l_suppkey"))
    + " SELECT symbol, CAST(trading_date AS VARCHAR) AS trading_date, CAST(floor(CASE WHEN day(trading_date) = 5 AND trading_date >= DATE '1998-07-01' THEN close + 1 ELSE close END * 1000 + 0.7295) AS BIGINT) AS close FROM bars WHERE CAST(symbol AS INTEGER) % 9 <> 0 AND NOT (day(trading_date) = 5 AND trading_date >= DATE '1998-01-01' AND trading_date < DATE '1998-07-01') "
)
def merged_windows(spark, sf_dir):
    """Overlapping windows as one series: days that differ go, and series that change their currency."""
    return quality.merge_windows(_fetched(spark, sf_dir))[0].select("symbol", _text("trading_date"), _mills("close"))


@query(
    """WITH w AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CAST(unnest(generate_series(DATE '1994-06-01', DATE '2002-06-01', INTERVAL 5 DAY)) AS DATE) AS a FROM supplier), b AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 3),
c AS (SELECT w.symbol, w.a, count(b.d) AS bars FROM w LEFT JOIN b ON b.symbol = w.symbol AND b.d BETWEEN w.a AND w.a + 4 GROUP BY 1, 2),
g AS (SELECT *, coalesce(max(bars) OVER (PARTITION BY symbol ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was, coalesce(max(bars) OVER (PARTITION BY symbol ORDER BY a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS will FROM c)
SELECT symbol, CAST(a AS VARCHAR) AS window_start, bars, CASE WHEN bars = 0 AND will > 0 THEN CASE WHEN was > 0 THEN 'interior' ELSE 'leading' END END AS gap FROM g"""
)
def window_gaps(spark, sf_dir):
    """Five-day windows of each supplier without a bar: before its first one, or between others."""
    start = F.explode(F.sequence(F.lit("1994-06-01").cast("date"), F.lit("2002-06-01").cast("date"), F.expr("interval 5 days")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small file becomes some 600 times its rows
    windows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol")).repartition(parts, "symbol").select("symbol", start.alias("window_start")).withColumn("window_end", F.date_add("window_start", 4))
    bars = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity < 3").select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("trading_date")).distinct()
    return quality.window_gaps(windows, bars).select("symbol", _text("window_start"), "bars", "gap")


_ACCEPT_SQL = """a AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, list_filter([CASE WHEN l_linenumber = 3 THEN 'non_positive_low' END, CASE WHEN l_linenumber = 2 THEN 'negative_volume' END, CASE WHEN l_linenumber = 1 THEN 'high_below_open_or_close' END,
    CASE WHEN CAST(l_shipdate AS DATE) > DATE '2001-06-30' THEN 'future_date' END, CASE WHEN CAST(l_shipdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '2001-01-31' THEN 'outside_request' END], lambda x: x IS NOT NULL) AS reasons FROM lineitem)"""


def _accepted(spark, sf_dir):
    p, n = F.col("l_extendedprice"), F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.lit("all").alias("adjustment_mode"), F.to_date("l_shipdate").alias("trading_date"), p.alias("open"), F.when(n == 1, p - 0.5).otherwise(p + 1).alias("high"), F.when(n == 3, F.lit(0.0)).otherwise(p - 1).alias("low"), p.alias("close"),
        F.when(n == 2, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("volume"),
    )
    return quality.accept_bars(rows, "1996-01-01", "2001-01-31", "2001-06-30")


@query(_with(_ACCEPT_SQL) + " SELECT symbol, count(*) AS rows, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS rejected FROM a GROUP BY 1")
def accepted_bars(spark, sf_dir):
    return _accepted(spark, sf_dir)[2].drop("adjustment_mode")


@query(_with(_ACCEPT_SQL) + " SELECT symbol, array_to_string(reasons, ',') AS reasons, count(*) AS rows FROM a WHERE len(reasons) > 0 GROUP BY 1, 2")
def rejected_bars(spark, sf_dir):
    return _accepted(spark, sf_dir)[1].groupBy("symbol", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("rows"))


@query(
    """WITH r AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1), q AS (SELECT c_custkey AS k, DATE '1995-03-01' + CAST(c_custkey % 900 AS INTEGER) AS s FROM customer)
SELECT 'i' || q.k AS instrument_id, CAST(CASE WHEN b IS NULL OR s < a THEN s ELSE greatest(s, b - 5) END AS VARCHAR) AS fetch_start FROM q LEFT JOIN r USING (k)"""
)
def fetch_starts(spark, sf_dir):
    """Where an incremental fetch begins: five days before the stored end, or at the start when that is earlier than what is stored."""
    name = lambda c: F.concat(F.lit("i"), F.col(c).cast("string")).alias("instrument_id")
    ranges = _table(spark, sf_dir, "orders").where("o_custkey % 4 <> 0").groupBy(name("o_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("first_date"), F.to_date(F.max("o_orderdate")).alias("last_date")).withColumn("adjustment_mode", F.lit("all"))
    asked = _table(spark, sf_dir, "customer").select(name("c_custkey"), F.lit("all").alias("adjustment_mode"), F.date_add(F.lit("1995-03-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("start_date"))
    return quality.fetch_starts(asked, ranges).select("instrument_id", _text("fetch_start"))


@query("SELECT user_id AS run_id, CASE WHEN sum(CASE WHEN user_id % 5 = 0 THEN 0 ELSE CAST(value AS BIGINT) END) = 0 THEN 'failed' WHEN bool_and(user_id % 3 <> 0 OR event_type <> 'error') THEN 'success' ELSE 'partial' END AS status FROM events GROUP BY 1")
def ingest_statuses(spark, sf_dir):
    committed = F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.round("value").cast("long"))
    modes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("mode"), committed.alias("committed"), ((F.col("user_id") % 3 != 0) | (F.col("event_type") != "error")).alias("clean"))
    return quality.ingest_status(modes)


@query("SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").cast("string").alias("d"))
    return quality.duplicate_keys(rows, ["l_suppkey", "d"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_orders(spark, sf_dir):
    paying = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return quality.missing_references(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), paying, ["o_custkey"])


@query("SELECT c_mktsegment || '-' || (c_custkey % 40) AS ticker, count(DISTINCT c_nationkey) AS issuers, array_to_string(list_sort(list_distinct(list(lpad(CAST(c_nationkey AS VARCHAR), 10, '0')))), ',') AS ciks FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def ambiguous_tickers(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("ticker"), F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik"))
    return quality.ambiguous_securities(rows).select("ticker", "issuers", F.array_join("ciks", ",").alias("ciks"))


# Streams ------------------------------------------------------------------------------------


def _in_batches(spark, df: DataFrame, *parts: Column) -> str:
    """``df`` as Parquet files in the shared folder, those of ``parts[i]`` for the i-th batch."""
    path = scratch_path(spark)
    for i, part in enumerate(parts):
        df.where(part).write.parquet(f"{path}/{i}")
    return path


@query(
    """WITH i AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS batch FROM lineitem WHERE l_linenumber <> 7),
g AS (SELECT symbol, d, batch, min(n) AS n FROM i GROUP BY 1, 2, 3 HAVING count(DISTINCT n) = 1) SELECT 'i_' || symbol AS instrument_id, CAST(d AS VARCHAR) AS trading_date, CAST(arg_max(n, batch) AS DOUBLE) AS close FROM g GROUP BY 1, 2"""
)
def streamed_bars(spark, sf_dir):
    """Bars that arrive in two batches: invalid rows and conflicting days of a batch are dropped, later batches win."""
    n = F.col("l_linenumber")
    price = n.cast("double")
    bars = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("i_"), F.col("l_suppkey").cast("string")).alias("instrument_id"), F.lit("table").alias("provider"), F.to_date("l_shipdate").alias("trading_date"), F.lit("all").alias("adjustment_mode"), *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.when(n == 7, -1).otherwise(1).cast("long").alias("volume"), F.lit("USD").alias("currency"), F.lit("UTC").alias("exchange_timezone"), F.lit("t").alias("fetched_at"), (n == 1).alias("late"),
    )
    source, out = _in_batches(spark, bars, ~F.col("late"), F.col("late")), scratch_path(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.drop("late").schema)
    for i in range(2):
        ingest.stream_bars(spark, f"{source}/[0-{i}]", schema, f"{out}/store", f"{out}/checkpoint").awaitTermination()
    return ingest.read_bars(spark, f"{out}/store").select("instrument_id", _text("trading_date"), "close")


@query(
    _with(A.FACTS_SQL)
    + " SELECT cik, concept, fiscal_year, arg_min(accession_number, (available_on, accession_number)) AS accession_number, CAST(min(available_on) AS VARCHAR) AS available_at FROM facts GROUP BY 1, 2, 3"
)
def streamed_facts(spark, sf_dir):
    """Facts that arrive in two batches, the later ones filed first: the earliest known of each id stays."""
    facts = A.facts(spark, sf_dir).withColumn("fact_id", F.concat_ws("|", "cik", "concept", "fiscal_year"))
    late = F.dayofmonth("filing_date") < 15
    source, out = _in_batches(spark, facts, ~late, late), scratch_path(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.schema)
    for i in range(2):
        ingest.stream_facts(spark, f"{source}/[0-{i}]", schema, f"{out}/store", f"{out}/checkpoint").awaitTermination()
    return ingest.read_facts(spark, f"{out}/store").select("cik", "concept", _long("fiscal_year").alias("fiscal_year"), "accession_number", _day("available_at").alias("available_at"))

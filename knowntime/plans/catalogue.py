"""Registered queries over the driver's tables, each with its DuckDB twin where SQL can say it.

Every query reads whole tables; only top-k reports limit their result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowntime.functions import scalars as S
from knowntime.functions.scratch import stored
from knowntime.operators import factors, market, pit, portfolio, quality, ranking, statements
from knowntime.plans import adapters as A
from knowntime.sources import documents, sinks

AS_OFS = ["1998-06-30 12:00:00", "2000-01-15 12:00:00", "2001-12-31 12:00:00"]
_AS_OF_SQL = "as_ofs AS (SELECT unnest([DATE '1998-06-30', DATE '2000-01-15', DATE '2001-12-31']) AS day)"
_REQ_SQL = "req AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, y AS fiscal_year, day FROM nation, (SELECT unnest(range(1995, 2002)) AS y), as_ofs)"
_BEST_SQL = """best AS (
    SELECT f.*, a.day FROM facts f JOIN as_ofs a ON f.available_on <= a.day
    QUALIFY row_number() OVER (PARTITION BY cik, canonical, fiscal_year, a.day ORDER BY form_score DESC, available_on DESC, amended DESC, accession_number DESC) = 1)"""
_PIVOT_SQL = """wide AS (
    SELECT cik, fiscal_year, day, max(value) FILTER (canonical = 'net_income') AS ni, max(value) FILTER (canonical = 'total_assets') AS ta, max(value) FILTER (canonical = 'revenue') AS rev,
           max(value) FILTER (canonical = 'operating_cash_flow') AS ocf, max(value) FILTER (canonical = 'capital_expenditures') AS capex FROM best GROUP BY 1, 2, 3),
pairs AS (SELECT r.cik, r.fiscal_year, r.day, c.ni, c.ta, c.rev, c.ocf, c.capex, p.ta AS pta, p.rev AS prev FROM req r LEFT JOIN wide c USING (cik, fiscal_year, day)
          LEFT JOIN wide p ON p.cik = r.cik AND p.fiscal_year = r.fiscal_year - 1 AND p.day = r.day)"""
_FACTOR_SQL = """vals AS (
    SELECT cik, fiscal_year, day, 'revenue_growth' AS factor, CASE WHEN prev <> 0 THEN rev / prev - 1.0 END AS value FROM pairs UNION ALL
    SELECT cik, fiscal_year, day, 'free_cash_flow', ocf - capex FROM pairs UNION ALL
    SELECT cik, fiscal_year, day, 'roa', ni / coalesce((ta + pta) / 2.0, ta) FROM pairs UNION ALL
    SELECT cik, fiscal_year, day, 'accrual_ratio', (ni - ocf) / coalesce((ta + pta) / 2.0, ta) FROM pairs)"""
FACTORS_SHOWN = ["revenue_growth", "free_cash_flow", "roa", "accrual_ratio"]

_spark: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its twin."""

    def register(f):
        _spark[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def _day(c: str | Column) -> Column:
    return F.to_date(c).cast("string")


def _long(c: str) -> Column:
    return F.col(c).cast("long")


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.issuer_requests(spark, sf_dir, AS_OFS)


# Statements ---------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest annual value per issuer and concept known in January 2000, ranked within the concept."""
    facts = A.facts(spark, sf_dir)
    issuers = facts.select("cik").distinct().withColumn("as_of", F.lit(AS_OFS[1]).cast("timestamp"))
    wanted = pit.latest_annual(facts, issuers).withColumn("fiscal_period", F.lit("FY"))
    values = statements.canonical_values(facts, wanted).where(F.col("v.value").isNotNull())
    rows = values.select("cik", "fiscal_year", "concept", F.col("v.value").alias("value"), F.col("v.accession_number").alias("accession_number"), F.lit(True).alias("valid"), F.lit(True).alias("higher_is_better"))
    ranked = ranking.rank_results(rows, ["concept"], name="cik")
    return ranked.select("concept", "cik", _long("fiscal_year").alias("fiscal_year"), _r("value", 2).alias("value"), "accession_number", _long("rank").alias("rank"), _r("percentile").alias("percentile"))


_spark["pit_annual_ranking"] = flagship
_sql["pit_annual_ranking"] = (
    _with(A.FACTS_SQL, _AS_OF_SQL, _BEST_SQL)
    + """, newest AS (SELECT cik, max(fiscal_year) AS fiscal_year FROM facts WHERE available_on <= DATE '2000-01-15' GROUP BY 1)
SELECT b.canonical AS concept, b.cik, b.fiscal_year, round(b.value, 2) AS value, b.accession_number, rank() OVER w AS rank, round(100.0 * (1 - percent_rank() OVER w), 6) AS percentile
FROM best b JOIN newest n USING (cik, fiscal_year) WHERE b.day = DATE '2000-01-15' WINDOW w AS (PARTITION BY b.canonical ORDER BY b.value DESC)"""
)


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL)
    + """, ties AS (SELECT b.cik, b.canonical, b.fiscal_year, b.day, count(DISTINCT round(f.value, 6)) > 1 AS conflict FROM best b JOIN facts f
        ON f.cik = b.cik AND f.canonical = b.canonical AND f.fiscal_year = b.fiscal_year AND f.form_score = b.form_score AND f.available_on = b.available_on AND f.amended = b.amended GROUP BY 1, 2, 3, 4),
    names AS (SELECT unnest(['net_income', 'total_assets', 'revenue', 'operating_cash_flow', 'capital_expenditures']) AS canonical)
SELECT r.cik, r.fiscal_year, CAST(r.day AS VARCHAR) AS as_of, n.canonical AS concept, round(b.value, 2) AS value, b.accession_number, b.form, coalesce(b.amended = 1, FALSE) AS restated,
       coalesce(t.conflict, FALSE) AS conflict, CASE WHEN b.value IS NULL THEN 'no_fact_known' END AS missing_reason
FROM req r CROSS JOIN names n LEFT JOIN best b ON b.cik = r.cik AND b.fiscal_year = r.fiscal_year AND b.day = r.day AND b.canonical = n.canonical
LEFT JOIN ties t ON t.cik = r.cik AND t.fiscal_year = r.fiscal_year AND t.day = r.day AND t.canonical = n.canonical"""
)
def canonical_versions(spark, sf_dir):
    rows = statements.canonical_values(A.facts(spark, sf_dir), _requests(spark, sf_dir)).where(F.col("concept").isin("net_income", "total_assets", "revenue", "operating_cash_flow", "capital_expenditures"))
    return rows.select(
        "cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), "concept", _r("v.value", 2).alias("value"), "v.accession_number", "v.form", F.col("v.is_restated").alias("restated"),
        F.array_contains("v.warnings", "conflicting_concepts").alias("conflict"), "v.missing_reason",
    )


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL)
    + """, seen AS (SELECT cik, fiscal_year, day, count(*) AS present, max(available_on) AS evidence, string_agg(DISTINCT accession_number, ',' ORDER BY accession_number) AS accessions FROM best GROUP BY 1, 2, 3)
SELECT p.cik, p.fiscal_year, CAST(p.day AS VARCHAR) AS as_of, 43 - coalesce(s.present, 0) - CASE WHEN p.ocf IS NOT NULL AND p.capex IS NOT NULL THEN 1 ELSE 0 END AS n_missing,
       coalesce(s.accessions, '') AS accessions, CAST(s.evidence AS VARCHAR) AS evidence_at
FROM pairs p LEFT JOIN seen s USING (cik, fiscal_year, day)"""
)
def snapshot_summaries(spark, sf_dir):
    rows = statements.snapshot_summary(A.facts(spark, sf_dir), _requests(spark, sf_dir))
    return rows.select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), F.size("missing").cast("long").alias("n_missing"), F.array_join("source_accessions", ",").alias("accessions"), _day("evidence_at").alias("evidence_at"))


#: 240 decision times, a fortnight apart.
_OFTEN = ("1992-12-31", 240, 14)
_OFTEN_SQL = "as_ofs AS (SELECT DATE '1992-12-31' + CAST(14 * i AS INTEGER) AS day FROM range(240) t(i))"


@query(
    _with(A.FACTS_SQL, _OFTEN_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL)
    + """, seen AS (SELECT cik, fiscal_year, day, count(*) AS present, max(available_on) AS evidence FROM best GROUP BY 1, 2, 3)
SELECT p.cik, p.fiscal_year, CAST(p.day AS VARCHAR) AS as_of, 43 - coalesce(s.present, 0) - CASE WHEN p.ocf IS NOT NULL AND p.capex IS NOT NULL THEN 1 ELSE 0 END AS n_missing, CAST(s.evidence AS VARCHAR) AS evidence_at
FROM pairs p LEFT JOIN seen s USING (cik, fiscal_year, day)"""
)
def snapshots_every_fortnight(spark, sf_dir):
    """The snapshot of every issuer and year at 240 decision times."""
    first, times, step = _OFTEN
    day = F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: F.date_add(F.lit(first).cast("date"), i * step)))
    asked = A.issuer_requests(spark, sf_dir, [AS_OFS[0]]).drop("as_of").withColumn("day", day).select("cik", "fiscal_year", "fiscal_period", (F.col("day").cast("timestamp") + F.expr("interval 12 hours")).alias("as_of"))
    rows = statements.snapshot_summary(A.facts(spark, sf_dir), asked)
    return rows.select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), F.size("missing").cast("long").alias("n_missing"), _day("evidence_at").alias("evidence_at"))


_INTERVALS_SQL = """ranked AS (
    SELECT *, row_number() OVER (PARTITION BY cik, canonical, fiscal_year ORDER BY form_score, available_on, amended, accession_number) AS rk FROM facts),
top AS (SELECT cik, canonical, fiscal_year, available_on, max(rk) AS rk FROM ranked GROUP BY 1, 2, 3, 4),
run AS (SELECT *, max(rk) OVER (PARTITION BY cik, canonical, fiscal_year ORDER BY available_on) AS best FROM top),
turns AS (SELECT *, lag(best) OVER (PARTITION BY cik, canonical, fiscal_year ORDER BY available_on) AS was FROM run),
spans AS (SELECT t.cik, t.canonical, t.fiscal_year, t.available_on AS known_from, lead(t.available_on) OVER (PARTITION BY t.cik, t.canonical, t.fiscal_year ORDER BY t.available_on) AS known_to, r.value, r.accession_number
          FROM turns t JOIN ranked r ON r.cik = t.cik AND r.canonical = t.canonical AND r.fiscal_year = t.fiscal_year AND r.rk = t.best WHERE t.was IS NULL OR t.was <> t.best)"""


@query(
    _with(A.FACTS_SQL, _INTERVALS_SQL)
    + " SELECT cik, canonical, fiscal_year, CAST(known_from AS VARCHAR) AS known_from, CAST(known_to AS VARCHAR) AS known_to, round(value, 2) AS value, accession_number FROM spans"
)
def known_intervals(spark, sf_dir):
    rows = statements.known_intervals(A.facts(spark, sf_dir))
    return rows.select("cik", "canonical", _long("fiscal_year").alias("fiscal_year"), _day("known_from").alias("known_from"), _day("known_to").alias("known_to"), _r("value", 2).alias("value"), "accession_number")


@query(
    _with(A.FACTS_SQL, _INTERVALS_SQL)
    + """, months AS (SELECT CAST(unnest(generate_series(DATE '1995-06-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS day), seen AS (SELECT DISTINCT cik, fiscal_year FROM facts)
SELECT s.cik, s.canonical, s.fiscal_year, CAST(m.day AS VARCHAR) AS as_of, round(s.value, 2) AS value, s.accession_number
FROM spans s JOIN seen USING (cik, fiscal_year) JOIN months m ON s.known_from <= m.day AND (s.known_to IS NULL OR m.day < s.known_to)"""
)
def values_every_month(spark, sf_dir):
    facts = A.facts(spark, sf_dir)
    times = F.explode(F.sequence(F.lit("1995-06-01").cast("timestamp"), F.lit("2001-12-01").cast("timestamp"), F.expr("interval 1 month")))
    asked = facts.select("cik", "fiscal_year", "fiscal_period").distinct().withColumn("as_of", times)
    rows = statements.values_at(statements.known_intervals(facts), asked)
    return rows.select("cik", "canonical", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), _r("value", 2).alias("value"), "accession_number")


@query(_with(A.FACTS_SQL, _AS_OF_SQL) + " SELECT DISTINCT cik, CAST(day AS VARCHAR) AS as_of, fiscal_year FROM facts JOIN as_ofs ON available_on <= day")
def annual_periods(spark, sf_dir):
    facts = A.facts(spark, sf_dir)
    asked = facts.select("cik").distinct().withColumn("as_of", F.explode(F.array(*[F.lit(t).cast("timestamp") for t in AS_OFS])))
    return pit.annual_periods(facts, asked).select("cik", _day("as_of").alias("as_of"), _long("fiscal_year").alias("fiscal_year"))


@query(_with(A.FACTS_SQL) + " SELECT cik, count(*) AS facts, round(sum(value), 2) AS total FROM facts WHERE available_on <= DATE '2000-01-15' GROUP BY cik")
def facts_as_of(spark, sf_dir):
    return pit.as_of(A.facts(spark, sf_dir), AS_OFS[1]).groupBy("cik").agg(F.count("*").alias("facts"), _r(F.sum("value"), 2).alias("total"))


@query(
    _with(A.FACTS_SQL)
    + """ SELECT fact_id, concept, CAST(CAST(fiscal_year AS VARCHAR) || '-12-31' AS VARCHAR) AS end_date, CAST(available_on AS VARCHAR) AS available_at FROM facts
WHERE cik = '0000000003' AND lower(concept) LIKE '%income%' ORDER BY fiscal_year DESC, available_on DESC, fact_id LIMIT 25"""
)
def search_facts(spark, sf_dir):
    rows = pit.search_facts(A.facts(spark, sf_dir), A.securities(spark, sf_dir), "nation_3", "INCOME", 25)
    return rows.select("fact_id", "concept", F.col("end_date").cast("string").alias("end_date"), _day("available_at").alias("available_at"))


@query(_with(A.FACTS_SQL) + " SELECT cik, concept, fiscal_year, arg_min(accession_number, (available_on, accession_number)) AS accession_number, CAST(min(available_on) AS VARCHAR) AS available_at FROM facts GROUP BY 1, 2, 3")
def first_known_facts(spark, sf_dir):
    facts = A.facts(spark, sf_dir).withColumn("fact_id", F.concat_ws("|", "cik", "concept", "fiscal_year"))
    return pit.first_known(facts).select("cik", "concept", _long("fiscal_year").alias("fiscal_year"), "accession_number", _day("available_at").alias("available_at"))


# Factors and ranking ------------------------------------------------------------------------


def _factor_rows(spark, sf_dir):
    return factors.factor_results(A.facts(spark, sf_dir), _requests(spark, sf_dir), factors=FACTORS_SHOWN)


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL, _FACTOR_SQL)
    + """ SELECT v.cik, v.fiscal_year, CAST(v.day AS VARCHAR) AS as_of, factor, round(value, 6) AS value, value IS NOT NULL AS valid,
    CASE WHEN value IS NOT NULL THEN NULL WHEN factor = 'revenue_growth' THEN 'missing_revenue' WHEN factor = 'free_cash_flow' THEN 'missing_cash_flow_inputs'
         WHEN factor = 'roa' THEN CASE WHEN p.ni IS NULL THEN 'missing_net_income' ELSE 'missing_total_assets' END
         WHEN p.ni IS NULL OR p.ocf IS NULL THEN 'missing_net_income_or_cash_flow' ELSE 'missing_total_assets' END AS reason
FROM vals v JOIN pairs p USING (cik, fiscal_year, day)"""
)
def factor_values(spark, sf_dir):
    return _factor_rows(spark, sf_dir).select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), "factor", _r("value").alias("value"), "valid", "reason")


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL, _FACTOR_SQL)
    + """, signs AS (SELECT *, CASE WHEN factor = 'accrual_ratio' THEN value ELSE -value END AS k FROM vals WHERE value IS NOT NULL)
SELECT cik, fiscal_year, CAST(day AS VARCHAR) AS as_of, factor, round(value, 6) AS value, rank() OVER w AS rank, round(100.0 * (1 - percent_rank() OVER w), 6) AS percentile,
       row_number() OVER (PARTITION BY day, fiscal_year, factor ORDER BY k, cik) AS position, count(*) OVER (PARTITION BY day, fiscal_year, factor) AS valid_count
FROM signs WINDOW w AS (PARTITION BY day, fiscal_year, factor ORDER BY k)"""
)
def factor_ranking(spark, sf_dir):
    ranked = ranking.rank_results(_factor_rows(spark, sf_dir), ["as_of", "fiscal_year", "factor"], name="cik")
    return ranked.select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), "factor", _r("value").alias("value"), _long("rank").alias("rank"), _r("percentile").alias("percentile"), _long("position").alias("position"), "valid_count")


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL, _FACTOR_SQL)
    + """, newest AS (SELECT cik, day, max(fiscal_year) AS fiscal_year FROM facts JOIN as_ofs ON available_on <= day GROUP BY 1, 2),
chosen AS (SELECT v.* FROM vals v JOIN newest USING (cik, day, fiscal_year) WHERE factor = 'roa' AND value IS NOT NULL)
SELECT CAST(day AS VARCHAR) AS as_of, cik, fiscal_year, round(value, 6) AS value FROM chosen
QUALIFY row_number() OVER (PARTITION BY day ORDER BY value DESC, cik) <= 5 AND count(*) OVER (PARTITION BY day) >= 5"""
)
def top_five_roa(spark, sf_dir):
    facts = A.facts(spark, sf_dir)
    asked = _requests(spark, sf_dir).select("cik", "as_of").distinct()
    rows = factors.factor_results(facts, ranking.latest_year_signals(facts, asked), factors=["roa"])
    return ranking.exact_top_n(rows, ["as_of"], 5, name="cik").select(_day("as_of").alias("as_of"), "cik", _long("fiscal_year").alias("fiscal_year"), _r("value").alias("value"))


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL, _FACTOR_SQL)
    + """ SELECT CAST(day AS VARCHAR) AS as_of, fiscal_year, factor, cik, FALSE AS unresolved FROM vals WHERE value IS NULL UNION ALL
SELECT DISTINCT CAST(day AS VARCHAR), fiscal_year, factor, 'N' || r_regionkey, TRUE FROM vals JOIN region ON TRUE"""
)
def ranking_exclusions(spark, sf_dir):
    """What a ranking leaves out; regions are asked for among the issuers and can't be resolved."""
    rows = _factor_rows(spark, sf_dir)
    universe = rows.select("as_of", "fiscal_year", "factor", "cik").distinct()
    regions = F.array(*[F.lit(f"N{k}") for k in range(5)])
    universe = universe.unionByName(rows.select("as_of", "fiscal_year", "factor").distinct().withColumn("cik", F.explode(regions)))
    out = ranking.exclusions(rows, universe, ["as_of", "fiscal_year", "factor"], name="cik")
    return out.select(_day("as_of").alias("as_of"), _long("fiscal_year").alias("fiscal_year"), "factor", "cik", (F.col("reason") == "unresolved").alias("unresolved"))


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL, _PIVOT_SQL)
    + """, parts AS (SELECT cik, fiscal_year, day, rev / prev - 1.0 AS g, ocf - capex AS f, ni / coalesce((ta + pta) / 2.0, ta) AS r, (ni - ocf) / coalesce((ta + pta) / 2.0, ta) AS a FROM pairs),
marks AS (SELECT *, (g IS NOT NULL)::INT + (f IS NOT NULL)::INT + (r IS NOT NULL)::INT + (a IS NOT NULL)::INT AS n, coalesce((g > 0)::INT, 0) + coalesce((f > 0)::INT, 0) + coalesce((r > 0)::INT, 0) + coalesce((a < 0)::INT, 0) AS hit FROM parts)
SELECT cik, fiscal_year, CAST(day AS VARCHAR) AS as_of, CASE WHEN n > 0 THEN round(CAST(hit AS DOUBLE) / n, 6) END AS value, n > 0 AS valid FROM marks"""
)
def quality_scores(spark, sf_dir):
    rows = factors.factor_results(A.facts(spark, sf_dir), _requests(spark, sf_dir), factors=["basic_quality_score"])
    return rows.select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), _r("value").alias("value"), "valid")


# Market windows -----------------------------------------------------------------------------


def _metric_sql(bars: str, day: str, closes: int) -> str:
    return (
        _with(bars)
        + f""", w AS (SELECT symbol, trading_date, close, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS rn, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS ret
    FROM bars WHERE trading_date <= DATE '{day}' AND trading_date >= DATE '{day}' - 550),
p AS (SELECT *, max(close) FILTER (rn <= {closes}) OVER (PARTITION BY symbol ORDER BY rn DESC) AS peak FROM w),
s AS (SELECT symbol, count(*) AS n, max(close) FILTER (rn = 22) / max(close) FILTER (rn = {closes}) - 1 AS mom, stddev_samp(ret) FILTER (rn < {closes}) * sqrt(252) AS vol, min(close / peak - 1) FILTER (rn <= {closes}) AS dd FROM p GROUP BY symbol),
m AS (SELECT symbol, n, unnest(['momentum_12_1', 'volatility_1y', 'max_drawdown_1y']) AS metric, unnest([mom, vol, dd]) AS value FROM s)"""
    )


def _metric_rows(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", "metric", _r("value").alias("value"), "valid", "reason")


def _metric_requests(bars: DataFrame, day: str) -> DataFrame:
    return bars.select("symbol").distinct().withColumn("as_of", F.lit(f"{day} 23:30:00").cast("timestamp")).withColumn("benchmark", F.lit("MARKET"))


@query(_metric_sql(A.bars_sql(), "2000-12-29", 253) + " SELECT symbol, metric, CASE WHEN n >= 253 THEN round(value, 6) END AS value, n >= 253 AS valid, CASE WHEN n < 253 THEN 'insufficient_history' END AS reason FROM m")
def window_metrics_dense(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    return _metric_rows(market.window_metrics(bars, _metric_requests(bars, "2000-12-29")))


@query(_metric_sql(A.bars_sql("l_suppkey"), "2000-12-29", 30) + " SELECT symbol, metric, CASE WHEN n >= 30 THEN round(value, 6) END AS value, n >= 30 AS valid, CASE WHEN n < 30 THEN 'insufficient_history' END AS reason FROM m")
def window_metrics_wide(spark, sf_dir):
    bars = A.bars(spark, sf_dir, "l_suppkey")
    symbols = pit.as_of(bars, "2000-12-29 23:30:00").where("trading_date >= date'2000-12-29' - interval 550 days")
    return _metric_rows(market.window_metrics(bars, _metric_requests(symbols, "2000-12-29"), closes=30))


@query(
    _metric_sql(A.bars_sql("l_suppkey"), "2000-12-29", 30)
    + """ SELECT symbol, metric, round(value, 6) AS value, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'volatility_1y' THEN value ELSE -value END) AS rank FROM m WHERE n >= 30"""
)
def metric_ranking(spark, sf_dir):
    bars = A.bars(spark, sf_dir, "l_suppkey")
    rows = market.window_metrics(bars, _metric_requests(bars, "2000-12-29"), closes=30)
    return ranking.rank_results(rows, ["metric"], name="symbol").select("symbol", "metric", _r("value").alias("value"), _long("rank").alias("rank"))


@query(
    _with(A.bars_sql(benchmark=True))
    + """, j AS (SELECT a.symbol, a.trading_date, a.close AS ca, b.close AS cb FROM bars a JOIN bars b USING (trading_date) WHERE b.symbol = 'MARKET' AND a.trading_date BETWEEN DATE '2000-12-29' - 550 AND DATE '2000-12-29'),
w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS rn, ca / lag(ca) OVER o - 1 AS ra, cb / lag(cb) OVER o - 1 AS rb FROM j WINDOW o AS (PARTITION BY symbol ORDER BY trading_date)),
s AS (SELECT symbol, count(*) AS n, covar_samp(ra, rb) FILTER (rn < 253) / var_samp(rb) FILTER (rn < 253) AS value FROM w GROUP BY symbol)
SELECT symbol, CASE WHEN n >= 253 THEN round(value, 6) END AS value, n >= 253 AS valid FROM s"""
)
def market_beta(spark, sf_dir):
    bars = A.bars(spark, sf_dir, benchmark=True)
    return market.beta(bars, _metric_requests(bars, "2000-12-29")).select("symbol", _r("value").alias("value"), "valid")


@query(
    """SELECT e.event_id, e.user_id, round(p.value, 6) AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def as_of_event_price(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    known = events.where("event_type = 'click'").select("user_id", "ts", "value", F.col("event_id").alias("seq"))
    rows = pit.latest_on_or_before(asked, known, ["user_id"], "ts", "ts", ["value"], ties=["seq"], prefix="last_")
    return rows.select("event_id", "user_id", _r("last_value").alias("last_value"))


_CAPS_SQL = """priced AS (
    SELECT q.*, b.trading_date AS price_date, b.close FROM asked q LEFT JOIN LATERAL (SELECT trading_date, close FROM nation_bars n WHERE n.symbol = q.ticker AND n.trading_date <= q.market_date ORDER BY trading_date DESC LIMIT 1) b ON TRUE),
capped AS (SELECT p.*, s.shares, s.end_date FROM priced p LEFT JOIN LATERAL (SELECT shares, end_date FROM share_facts f WHERE f.cik = p.cik AND f.end_date <= p.price_date AND f.available_on <= p.price_date ORDER BY end_date DESC LIMIT 1) s ON TRUE),
told AS (SELECT *, CASE WHEN price_date IS NULL THEN 'missing_raw_price' WHEN market_date - price_date > 7 THEN 'price_stale:' || (market_date - price_date) || '_days_exceeds_7' WHEN shares IS NULL THEN 'no_qualifying_shares_outstanding_fact' END AS reason FROM capped)
SELECT ticker, CAST(market_date AS VARCHAR) AS market_date, CASE WHEN reason IS NULL THEN round(CAST(close AS DOUBLE) * shares, 2) END AS market_cap, reason FROM told"""


def _caps(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", F.col("market_date").cast("string").alias("market_date"), _r(F.col("raw_close").cast("double") * F.col("shares").cast("double"), 2).alias("cap"), "reason").select("ticker", "market_date", F.when(F.col("reason").isNull(), F.col("cap")).alias("market_cap"), "reason")


@query(
    _with(
        A.FACTS_SQL, A.SHARES_SQL, A.NATION_BARS_SQL,
        "asked AS (SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS market_date FROM nation)",
    )
    + ", " + _CAPS_SQL
)
def market_caps_monthly(spark, sf_dir):
    days = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month")))
    asked = A.securities(spark, sf_dir).select("ticker", days.alias("market_date"), F.lit(None).cast("timestamp").alias("as_of"))
    return _caps(market.market_caps(asked, A.nation_bars(spark, sf_dir), A.share_facts(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir)))


@query(
    _with(A.FACTS_SQL, A.SHARES_SQL, A.NATION_BARS_SQL, "asked AS (SELECT symbol AS ticker, cik, max(trading_date) AS market_date FROM nation_bars GROUP BY 1, 2, date_trunc('quarter', trading_date))")
    + ", " + _CAPS_SQL
)
def market_cap_quarterly_series(spark, sf_dir):
    return _caps(market.market_cap_series(A.nation_bars(spark, sf_dir), A.share_facts(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir), "quarter_end"))


@query(
    _with(A.FACTS_SQL, A.SHARES_SQL, A.NATION_BARS_SQL, "asked AS (SELECT symbol AS ticker, cik, trading_date AS market_date FROM nation_bars)")
    + ", " + _CAPS_SQL.split("SELECT ticker, CAST(market_date")[0]
    + "SELECT ticker, CAST(market_date AS VARCHAR) AS market_date, CASE WHEN reason IS NULL THEN CAST(close * CAST(shares AS BIGINT) AS VARCHAR) END AS market_cap, reason FROM told"
)
def market_cap_daily_series(spark, sf_dir):
    """A row for every session of every issuer, exact: its price met with the share count known then."""
    rows = market.market_cap_series(A.nation_bars(spark, sf_dir), A.share_facts(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir), "daily")
    return rows.select("ticker", F.col("market_date").cast("string").alias("market_date"), F.col("market_cap").cast("string").alias("market_cap"), "reason")


@query(
    _with(A.FACTS_SQL, A.SHARES_SQL, A.NATION_BARS_SQL, "asked AS (SELECT symbol AS ticker, cik, trading_date AS market_date FROM nation_bars)")
    + """, priced AS (SELECT q.ticker, q.cik, q.market_date, max(b.trading_date) AS price_date FROM asked q LEFT JOIN nation_bars b ON b.symbol = q.ticker AND b.trading_date <= q.market_date AND b.trading_date < q.market_date - 3 GROUP BY ALL),
capped AS (SELECT p.*, max(s.end_date) AS shares_date FROM priced p LEFT JOIN share_facts s ON s.cik = p.cik AND s.end_date <= p.price_date AND s.available_on <= p.market_date - 3 GROUP BY ALL)
SELECT ticker, CAST(market_date AS VARCHAR) AS market_date, CAST(price_date AS VARCHAR) AS price_date, CAST(shares_date AS VARCHAR) AS shares_date FROM capped"""
)
def market_cap_evidence_daily(spark, sf_dir):
    """Every session's cap as it was known three days earlier at midnight UTC: both times bound it."""
    days = A.nation_bars(spark, sf_dir).select(F.col("symbol").alias("ticker"), F.col("trading_date").alias("market_date"))
    asked = days.withColumn("as_of", F.date_sub("market_date", 3).cast("timestamp"))
    rows = market.market_caps(asked, A.nation_bars(spark, sf_dir), A.share_facts(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir))
    return rows.select("ticker", F.col("market_date").cast("string").alias("market_date"), F.col("price_date").cast("string").alias("price_date"), F.col("shares_date").cast("string").alias("shares_date"))


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik, count(DISTINCT upper(c_name)) AS classes FROM customer GROUP BY 1")
def share_classes(spark, sf_dir):
    return market.share_classes(A.securities(spark, sf_dir, many=True))


@query(_with(A.bars_sql("l_suppkey")) + " SELECT 'i_' || symbol AS instrument_id, CAST(min(trading_date) AS VARCHAR) AS first_date, CAST(max(trading_date) AS VARCHAR) AS last_date, count(*) AS bars FROM bars GROUP BY symbol")
def stored_ranges(spark, sf_dir):
    return market.stored_ranges(A.bars(spark, sf_dir, "l_suppkey")).select("instrument_id", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "bars")


@query("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_stats(spark, sf_dir):
    return market.table_stats({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders", "lineitem", "events")})


# Portfolio ----------------------------------------------------------------------------------


def _backtest_requests(spark, sf_dir) -> DataFrame:
    """One run per combination over the nations; monthly and quarterly, three baselines."""
    tickers = A.securities(spark, sf_dir).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    grid = tickers.withColumn("baseline", F.explode(F.array(*map(F.lit, ("equal_weight", "inverse_volatility", "minimum_variance")))))
    grid = grid.withColumn("top_n", F.explode(F.array(F.lit(3), F.lit(8)))).withColumn("schedule", F.explode(F.array(F.lit("monthly"), F.lit("quarterly")))).withColumn("cost_bps", F.explode(F.array(F.lit(0.0), F.lit(25.0))))
    return grid.select(
        F.concat_ws("-", "baseline", "top_n", "schedule", F.col("cost_bps").cast("int")).alias("run_id"), "tickers", F.lit("roa").alias("factor"), "top_n", "baseline", F.lit("1998-01-01").cast("date").alias("start_date"), F.lit("2000-12-31").cast("date").alias("end_date"), "schedule",
        F.lit(None).cast("array<date>").alias("explicit_dates"), F.lit("MARKET").alias("calendar_symbol"), F.lit("MARKET").alias("benchmark_symbol"), "cost_bps", F.lit(1_000_000.0).alias("initial_nav"),
    )


def dense_nation_bars(spark, sf_dir) -> DataFrame:
    """Nation bars on every day of the orders' calendar, carried forward, with MARKET; so small
    tables have complete calendars too. The daily bars are used six times and written once, so that
    orders meet their customers once."""
    raw = stored(A.nation_bars(spark, sf_dir).select("symbol", "trading_date", F.col("close").cast("double").alias("close")))
    market_ = raw.groupBy("trading_date").agg(F.round(F.avg("close"), 6).alias("close")).select(F.lit("MARKET").alias("symbol"), "trading_date", "close")
    everyone = raw.unionByName(market_)
    days = market_.select("trading_date")
    ends = everyone.groupBy("symbol").agg(F.min("trading_date").alias("first")).crossJoin(F.broadcast(days.agg(F.max("trading_date").alias("last"))))  # one row on the right
    grid = ends.select("symbol", F.explode(F.sequence("first", "last")).alias("trading_date")).join(days, "trading_date", "left_semi")
    w = Window.partitionBy("symbol").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(everyone, ["symbol", "trading_date"], "left").withColumn("close", F.last("close", ignorenulls=True).over(w)).where("close is not null")
    return filled.withColumn("available_at", S.bar_available_at(F.col("trading_date"), F.lit("America/New_York")))


def _backtests(spark, sf_dir):
    return portfolio.run_backtests(_backtest_requests(spark, sf_dir), dense_nation_bars(spark, sf_dir), A.facts(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir), closes=120)


@query()
def backtest_runs(spark, sf_dir):
    rows = _backtests(spark, sf_dir)["runs"]
    return rows.select("run_id", "status", "reason", *[_r(c).alias(c) for c in ("total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "gross_turnover")], "successful_rebalance_count", "leakage_violations")


@query()
def backtest_equity(spark, sf_dir):
    rows = _backtests(spark, sf_dir)["equity"]
    return rows.select("run_id", F.col("trading_date").cast("string").alias("trading_date"), _r("nav", 4).alias("nav"), _r("drawdown").alias("drawdown"), _r("benchmark_nav", 4).alias("benchmark_nav"))


_SESSIONS_SQL = _with("s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)", "n AS (SELECT d, lead(d) OVER (ORDER BY d) AS next_d FROM s)")


@query(
    _SESSIONS_SQL
    + """, m AS (SELECT 'monthly' AS schedule, max(d) AS d FROM s WHERE d BETWEEN DATE '1996-02-10' AND DATE '2001-03-31' GROUP BY date_trunc('month', d) UNION ALL
    SELECT 'quarterly', max(d) FROM s WHERE d BETWEEN DATE '1996-02-10' AND DATE '2001-03-31' AND month(d) IN (3, 6, 9, 12) GROUP BY date_trunc('month', d))
SELECT schedule, CAST(m.d AS VARCHAR) AS decision_date, CAST(next_d AS VARCHAR) AS effective_date FROM m JOIN n USING (d) WHERE next_d <= DATE '2001-03-31'"""
)
def rebalance_pairs(spark, sf_dir):
    bars = A.nation_bars(spark, sf_dir).select(F.lit("MARKET").alias("symbol"), "trading_date", "available_at").distinct()
    runs = bars.select("symbol").distinct().withColumn("schedule", F.explode(F.array(F.lit("monthly"), F.lit("quarterly"))))
    runs = runs.select(F.col("schedule").alias("run_id"), "schedule", F.lit("1996-02-10").cast("date").alias("start_date"), F.lit("2001-03-31").cast("date").alias("end_date"), F.lit(None).cast("array<date>").alias("explicit_dates"), F.col("symbol").alias("calendar_symbol"))
    pairs = portfolio.decision_pairs(runs, portfolio.calendar_sessions(bars))
    return pairs.select(F.col("run_id").alias("schedule"), F.col("decision_date").cast("string").alias("decision_date"), F.col("effective_date").cast("string").alias("effective_date"))


def _aligned_sql(key: str) -> str:
    return (
        _with(A.bars_sql(key))
        + """, k AS (SELECT * FROM bars WHERE trading_date BETWEEN DATE '2000-12-29' - 550 AND DATE '2000-12-29'),
d AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) AS rn FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM k)),
r AS (SELECT symbol, trading_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS ret FROM k JOIN d USING (trading_date) WHERE rn <= 253)"""
    )


def _common_returns(spark, sf_dir, key):
    bars = A.bars(spark, sf_dir, key)
    group = bars.select("symbol").distinct().select(F.lit("all").alias("run_id"), F.lit("2000-12-29").cast("date").alias("decision_date"), F.lit("2000-12-29 23:30:00").cast("timestamp").alias("decision_at"), "symbol")
    return portfolio.aligned_returns(group, bars)


@query(_aligned_sql("l_returnflag") + ", v AS (SELECT symbol, 1 / stddev_samp(ret) AS i FROM r GROUP BY 1) SELECT symbol, round(i / sum(i) OVER (), 6) AS weight FROM v")
def inverse_volatility(spark, sf_dir):
    return portfolio.inverse_volatility_weights(_common_returns(spark, sf_dir, "l_returnflag")).select("symbol", _r("weight").alias("weight"))


@query(
    _aligned_sql("l_linestatus")
    + """, c AS (SELECT var_samp(a.ret) AS va, var_samp(b.ret) AS vb, covar_samp(a.ret, b.ret) AS ab FROM r a JOIN r b USING (trading_date) WHERE a.symbol = 'F' AND b.symbol = 'O'),
w AS (SELECT least(greatest((vb - ab) / (va + vb - 2 * ab), 0.0), 1.0) AS a FROM c) SELECT unnest(['F', 'O']) AS symbol, round(unnest([a, 1 - a]), 6) AS weight FROM w"""
)
def minimum_variance(spark, sf_dir):
    """The two line statuses share all items, so SQL has a closed form; tests hold more names to brute force."""
    return portfolio.minimum_variance_weights(_common_returns(spark, sf_dir, "l_linestatus")).select("symbol", _r("weight").alias("weight"))


@query()
def minimum_variance_nations(spark, sf_dir):
    """All nations as one group; tests hold the weights to the optimality conditions."""
    return portfolio.minimum_variance_weights(nation_returns(spark, sf_dir)).select("symbol", _r("weight", 9).alias("weight"))


def nation_returns(spark, sf_dir):
    bars = dense_nation_bars(spark, sf_dir).where("symbol <> 'MARKET'")
    day = F.lit("2000-12-29")
    group = bars.select("symbol").distinct().select(F.lit("all").alias("run_id"), day.cast("date").alias("decision_date"), F.lit("2000-12-30 00:00:00").cast("timestamp").alias("decision_at"), "symbol")
    return portfolio.aligned_returns(group, bars, 120)


# Data quality, sinks and sources ------------------------------------------------------------


def _quoted_items(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_returnflag").alias("adjustment_mode"), F.to_date("l_shipdate").alias("trading_date"), F.col("l_linenumber").cast("double").alias("close"))


@query(
    """WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_returnflag AS adjustment_mode, CAST(l_shipdate AS DATE) AS d, count(*) AS n, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1, 2, 3)
SELECT symbol, adjustment_mode, count(*) FILTER (k = 1) AS accepted, CAST(sum(CASE WHEN k = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS conflicting FROM g GROUP BY 1, 2"""
)
def duplicate_bars(spark, sf_dir):
    items = _quoted_items(spark, sf_dir)
    return quality.dedup_bars(items, tasks=quality.tasks_for(items.count()))[1]


@query(
    _with(A.bars_sql("l_suppkey"))
    + """, n AS (SELECT symbol, trading_date, CASE WHEN day(trading_date) % 3 = 0 THEN close + 1 ELSE close END AS close FROM bars WHERE trading_date >= DATE '1999-01-01'),
o AS (SELECT symbol, trading_date, close FROM bars WHERE trading_date < DATE '2000-06-01')
SELECT CASE WHEN o.symbol IS NULL THEN 'inserted' WHEN n.close IS NOT DISTINCT FROM o.close THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS rows FROM n LEFT JOIN o USING (symbol, trading_date) GROUP BY 1"""
)
def upsert_classes(spark, sf_dir):
    bars = A.bars(spark, sf_dir, "l_suppkey").select("instrument_id", "provider", "trading_date", "adjustment_mode", "close", "fetched_at")
    new = bars.where("trading_date >= date'1999-01-01'").withColumn("close", F.when(F.dayofmonth("trading_date") % 3 == 0, F.col("close") + 1).otherwise(F.col("close"))).withColumn("fetched_at", F.current_timestamp())
    return sinks.classify_bars(bars.where("trading_date < date'2000-06-01'"), new)[1]


@query(
    """WITH b AS (SELECT c_custkey AS k, c_acctbal AS v, 'old' AS tag FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(b.k, n.k) AS k, round(coalesce(n.v, b.v), 2) AS v, b.tag AS created_at FROM b FULL JOIN n ON b.k = n.k"""
)
def keyed_upsert(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    merged = sinks.upsert(rows.where("k % 3 <> 0").withColumn("created_at", F.lit("old")), rows.where("k % 2 = 0").withColumn("v", F.col("v") * 2), ["k"])
    return merged.select("k", _r("v", 2).alias("v"), "created_at")


@query(
    """WITH r AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1),
w AS (SELECT k, s, e, CAST(unnest(generate_series(s, e, INTERVAL 398 DAY)) AS DATE) AS c FROM r)
SELECT k, CAST(c AS VARCHAR) AS window_start, CAST(least(c + 399, e) AS VARCHAR) AS window_end FROM w WHERE c = s OR c + 1 < e"""
)
def fetch_windows(spark, sf_dir):
    ranges = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date"))
    return quality.date_windows(ranges).select("k", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query(
    """SELECT CASE WHEN l_extendedprice < l_quantity * 1500 THEN 'high_below_open_or_close' ELSE 'fine' END AS fault, count(*) AS rows FROM lineitem GROUP BY 1"""
)
def bar_faults(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    low = F.least("l_extendedprice", F.col("l_quantity") * 1500)
    faults = S.ohlcv_faults(F.col("l_quantity") * 1500, F.col("l_extendedprice"), low, low, F.col("l_quantity"))
    return items.select(F.coalesce(F.try_element_at(faults, F.lit(1)), F.lit("fine")).alias("fault")).groupBy("fault").agg(F.count("*").alias("rows"))


@query(
    """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'FY' || year(o_orderdate) WHEN 1 THEN 'q' || quarter(o_orderdate) || '-' || year(o_orderdate) WHEN 2 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate)
    WHEN 3 THEN 'fy-' || year(o_orderdate) ELSE 'H1 ' || year(o_orderdate) END AS p, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders)
SELECT k, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 5 IN (0, 3) THEN 'FY' || y ELSE 'Q' || q || '-' || y END AS label, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 5 IN (0, 3) THEN 'annual' ELSE 'quarterly' END AS kind FROM t"""
)
def parsed_periods(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    year, quarter, kind = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"), F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("FY"), year)).when(kind == 1, F.concat(F.lit("q"), quarter, F.lit("-"), year)).when(kind == 2, F.concat(year, F.lit("Q"), quarter)).when(kind == 3, F.concat(F.lit("fy-"), year)).otherwise(F.concat(F.lit("H1 "), year))
    parsed = orders.select(F.col("o_orderkey").alias("k"), S.parse_period(text).alias("p"))
    return parsed.select("k", S.period_label(F.col("p.fiscal_year"), F.col("p.fiscal_period")).alias("label"), "p.kind")


@query("SELECT c_custkey AS k, 'mkt_' || substr(sha256(upper(trim(c_name))), 1, 16) AS instrument_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def surrogate_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("k"), S.instrument_id(F.col("c_name")).alias("instrument_id"), S.normalize_cik(F.concat(F.lit("CIK"), F.col("c_custkey").cast("string"))).alias("cik"))


@query(
    """WITH m AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN 'T' ELSE 'S' END AS symbol, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + CASE WHEN o_custkey % 5 < 3 THEN 700 ELSE 5 END AS t FROM orders WHERE o_orderkey % 3 > 0),
asked AS (SELECT c_custkey AS k, DATE '1996-01-01' AS a, DATE '1997-06-30' AS b FROM customer), hit AS (SELECT * FROM asked JOIN m USING (k) WHERE f <= b AND t >= a),
days AS (SELECT k, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM asked), holes AS (SELECT DISTINCT k FROM days x WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.k = x.k AND x.d BETWEEN h.f AND h.t)),
told AS (SELECT k, count(h.symbol) AS n, count(DISTINCT h.symbol) AS symbols, min(h.symbol) AS symbol FROM asked LEFT JOIN hit h USING (k) GROUP BY 1),
said AS (SELECT k, symbol, CASE WHEN n = 0 THEN 'no_mapping' WHEN symbols > 1 THEN 'multiple_symbols' WHEN k IN (SELECT k FROM holes) THEN 'coverage_gap' END AS reason FROM told)
SELECT 'i' || k AS instrument_id, CASE WHEN reason IS NULL THEN symbol END AS provider_symbol, reason FROM said"""
)
def mapping_gaps(spark, sf_dir):
    """Orders map their customer to one symbol or, for some, to two, for a week or for two years; every day of a range must have one."""
    k, d = F.col("o_custkey"), F.to_date("o_orderdate")
    name = lambda c: F.concat(F.lit("i"), F.col(c).cast("string")).alias("instrument_id")
    mappings = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 > 0").select(
        name("o_custkey"), F.lit("table").alias("provider"), F.when((k % 4 == 0) & (F.col("o_orderkey") % 2 == 0), "T").otherwise("S").alias("provider_symbol"), d.alias("valid_from"), F.date_add(d, F.when(k % 5 < 3, 700).otherwise(5)).alias("valid_to"), F.lit(True).alias("is_primary")
    )
    day = lambda t: F.lit(t).cast("date")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(name("c_custkey"), F.lit("table").alias("provider"), day("1996-01-01").alias("start_date"), day("1997-06-30").alias("end_date"))
    return quality.mapping_coverage(asked, mappings).select("instrument_id", "provider_symbol", "reason")


@query("SELECT event_type AS ticker, max_by(event_id, (ts, lpad(CAST(event_id AS VARCHAR), 12, '0'))) AS event_id FROM events WHERE value > 10 GROUP BY 1")
def latest_successful_runs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select(F.col("event_type").alias("ticker"), "event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.col("ts").cast("timestamp").alias("finished_at"), F.when(F.col("value") > 10, "success").otherwise("failed").alias("status"))
    return sinks.latest_success(runs).select("ticker", "event_id")


@query(
    """WITH g AS (SELECT user_id, event_id, value > 2 AS ok, sum(CASE WHEN value > 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
SELECT user_id, CAST(s AS BIGINT) AS segment, min(event_id) AS first, max(event_id) AS last, count(*) AS points FROM g WHERE ok GROUP BY 1, 2"""
)
def finite_segments(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.when(F.col("value") > 2, F.col("value")))
    return sinks.finite_segments(events, ["user_id"], "event_id", "value")


@query(
    """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM n WHERE n <= 20 OR i = 0 OR round(i * (19.0::DOUBLE / (n - 1))) > round((i - 1) * (19.0::DOUBLE / (n - 1)))"""
)
def evenly_spaced_points(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return sinks.evenly_spaced(events, ["user_id"], "event_id", 20)


def _dealt(facts, rows):
    """``facts`` with ``chunk``: the number of the document that takes a row, by its accession's hash.

    All rows together give a chunk about ``rows``, so no issuer's document holds more,
    however large its share.
    """
    return facts.withColumn("chunk", F.pmod(F.xxhash64("accession_number"), F.lit(facts.count() // rows + 1)))


def _fact_documents(facts, rows=5000):
    """(text): facts as nested JSON documents of bounded size, several per issuer."""
    obs = F.struct(F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"), F.format_number("value", 2).alias("val"), F.col("accession_number").alias("accn"), F.col("fiscal_year").cast("string").alias("fy"), F.col("fiscal_period").alias("fp"), "form", F.col("filing_date").cast("string").alias("filed"))
    concepts = _dealt(facts, rows).groupBy("cik", "chunk", "concept").agg(F.collect_list(obs).alias("o")).groupBy("cik", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.create_map(F.lit("USD"), "o").alias("units"))))).alias("c"))
    return concepts.select(F.to_json(F.struct("cik", F.create_map(F.lit("us-gaap"), "c").alias("facts"))).alias("text"))


@query(_with(A.FACTS_SQL) + " SELECT cik, concept, fiscal_year, accession_number, round(value, 2) AS value, CAST(filing_date AS VARCHAR) AS filing_date FROM facts")
def company_facts_scan(spark, sf_dir):
    """Facts written as nested documents of bounded size and read back by the scan."""
    facts = A.facts(spark, sf_dir)
    docs = _fact_documents(facts).select(F.from_json("text", documents.COMPANY_FACTS).alias("doc"))
    filed = facts.select("accession_number", "filing_date", "acceptance_datetime", "form")
    rows = documents.company_facts(docs, filed)
    return rows.select("cik", "concept", _long("fiscal_year").alias("fiscal_year"), "accession_number", _r("value", 2).alias("value"), F.col("filing_date").cast("string").alias("filing_date"))


def _submission_documents(facts, rows=5000):
    """(text), (cik, text): recent and archived filings as JSON of bounded size. Both places
    of a filing are in documents of the same number."""
    cols = {"accessionNumber": "accession_number", "filingDate": "filing_date", "form": "form"}
    row = F.struct("accession_number", F.col("filing_date").cast("string").alias("filing_date"), F.when(F.col("form") == "10-K/A", " ").otherwise(F.col("form")).alias("form"))
    old = F.col("fiscal_year") < 1998
    packed = _dealt(facts, rows).groupBy("cik", "chunk").agg(F.array_sort(F.collect_list(F.when(~old, row))).alias("recent"), F.array_sort(F.collect_list(F.when(old | (F.col("fiscal_year") == 1998), row))).alias("archived"))
    arrays = lambda c: F.to_json(F.struct(*[F.col(f"{c}.{v}").alias(k) for k, v in cols.items()]))
    subs = packed.select(F.concat(F.lit('{"cik":"'), "cik", F.lit('","filings":{"recent":'), arrays("recent"), F.lit("}}")).alias("text"))
    return subs, packed.select("cik", arrays("archived").alias("text"))


@query(
    """SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession_number, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN 'UNKNOWN' ELSE '10-Q' END AS form,
CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def submissions_scan(spark, sf_dir):
    """Filings as parallel arrays of bounded size, half of them archived, scanned with repeats removed."""
    recent, archived = _submission_documents(A.facts(spark, sf_dir))
    subs = recent.select(F.from_json("text", documents.SUBMISSIONS).alias("doc"))
    archives = archived.select("cik", F.from_json("text", documents.ARCHIVE).alias("doc"))
    rows = documents.filings(documents.filing_arrays(subs, archives))
    return rows.select("cik", "accession_number", "form", F.col("filing_date").cast("string").alias("filing_date"))


@query("SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, TRUE AS found FROM nation UNION ALL SELECT 'NOBODY', NULL, FALSE")
def resolved_tickers(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    entry = F.struct(F.col("n_nationkey").cast("string").alias("cik_str"), F.col("n_name").alias("ticker"), F.lit("t").alias("title"))
    docs = nations.select(F.create_map(F.col("n_nationkey").cast("string"), entry).alias("m")).select(F.from_json(F.to_json("m"), documents.TICKERS).alias("doc"))
    asked = nations.select(F.lower("n_name").alias("ticker")).union(nations.limit(1).select(F.lit(" nobody ")))
    return documents.resolve_tickers(asked, documents.ticker_entries(docs)).select("ticker", "cik", "found")


def _register() -> None:
    from knowntime.plans import details, figures  # noqa: F401  their queries enter as they are read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register()
    return dict(_spark)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_sql)

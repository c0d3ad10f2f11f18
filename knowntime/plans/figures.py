"""Registered queries of quarters, components, valuations, provenance and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.functions import dims
from knowntime.functions.scratch import scratch_path
from knowntime.operators import factors, market, portfolio, statements
from knowntime.plans import adapters as A
from knowntime.plans.catalogue import _AS_OF_SQL, _BEST_SQL, _REQ_SQL, AS_OFS, _day, _long, _metric_requests, _metric_sql, _r, _requests, _with, dense_nation_bars, query
from knowntime.sources import sinks

_TEXTS = "coalesce(array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ','), '')"


def _joined(c) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


# Quarters -----------------------------------------------------------------------------------

_QUARTER_NAMES = ["net_income", "total_assets", "revenue", "operating_cash_flow", "capital_expenditures"]


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, A.QUARTERS_SQL)
    + f""", req AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, y AS fiscal_year, q, day FROM nation, (SELECT unnest(range(1996, 1999)) AS y), (SELECT unnest(range(1, 5)) AS q), as_ofs),
names AS (SELECT unnest({_QUARTER_NAMES}) AS canonical),
r AS (SELECT r.*, n.canonical, CAST(r.cik AS INTEGER) % 3 = 1 AS alone, CAST(r.cik AS INTEGER) % 5 = 0 AS late, o.v, o.cum, o.end_date, o.available_on, o.accession_number, p.cum AS p_cum, p.end_date AS p_end, p.available_on AS p_on, p.accession_number AS p_acc
      FROM req r CROSS JOIN names n LEFT JOIN quarters o ON o.cik = r.cik AND o.canonical = n.canonical AND o.fiscal_year = r.fiscal_year AND o.q = r.q AND o.available_on <= r.day
      LEFT JOIN quarters p ON p.cik = r.cik AND p.canonical = n.canonical AND p.fiscal_year = r.fiscal_year AND p.q = r.q - 1 AND p.available_on <= r.day),
k AS (SELECT *, CASE WHEN v IS NULL THEN 'none' WHEN alone OR q = 1 OR canonical = 'total_assets' THEN 'own' WHEN q = 4 OR p_cum IS NULL THEN 'cumulative' WHEN late THEN 'starts' ELSE 'made' END AS kind FROM r)
SELECT cik, fiscal_year, 'Q' || q AS fiscal_period, CAST(day AS VARCHAR) AS as_of, canonical AS concept, CASE kind WHEN 'own' THEN round(CASE WHEN alone THEN v ELSE cum END, 2) WHEN 'made' THEN round(cum - p_cum, 2) END AS value,
       CASE WHEN kind = 'made' THEN CASE q WHEN 2 THEN 'Q2_YTD - Q1' ELSE 'Q3_YTD - Q2_YTD' END END AS derivation,
       CASE kind WHEN 'none' THEN 'no_fact_known' WHEN 'cumulative' THEN 'only_cumulative_facts' WHEN 'starts' THEN 'ytd_starts_differ_by_days:9' END AS missing_reason,
       CAST(CASE WHEN kind = 'made' THEN p_end WHEN kind = 'own' AND canonical <> 'total_assets' THEN make_date(fiscal_year, CASE WHEN alone THEN q * 3 - 2 ELSE 1 END, 1) END AS VARCHAR) AS period_start,
       CASE WHEN kind IN ('own', 'made') THEN CAST(end_date AS VARCHAR) END AS period_end, CASE WHEN kind IN ('own', 'made') THEN CAST(CASE WHEN kind = 'made' THEN greatest(available_on, p_on) ELSE available_on END AS VARCHAR) END AS available_at,
       CASE WHEN kind = 'made' THEN accession_number || ',' || p_acc ELSE '' END AS accessions,
       CASE kind WHEN 'none' THEN 'missing_value' WHEN 'cumulative' THEN 'ytd_only,missing_value' WHEN 'starts' THEN 'period_mismatch,ytd_start_mismatch' WHEN 'made' THEN 'derived_quarterly_from_ytd' ELSE '' END AS warnings FROM k"""
)
def quarter_values(spark, sf_dir):
    """Quarters as reported, or derived from cumulative facts, or why not."""
    asked = A.issuer_requests(spark, sf_dir, AS_OFS, 1996, 1998).withColumn("fiscal_period", F.explode(F.array(*map(F.lit, ("Q1", "Q2", "Q3", "Q4")))))
    rows = statements.canonical_values(A.quarter_facts(spark, sf_dir), asked, _QUARTER_NAMES)
    text = lambda c: F.col(f"v.{c}").cast("string").alias(c)
    return rows.select(
        "cik", _long("fiscal_year").alias("fiscal_year"), "fiscal_period", _day("as_of").alias("as_of"), "concept", _r("v.value", 2).alias("value"), "v.derivation", "v.missing_reason", text("period_start"), text("period_end"), _day("v.available_at").alias("available_at"),
        F.array_join("v.derivation_accessions", ",").alias("accessions"), F.array_join("v.warnings", ",").alias("warnings"),
    )


# Components, derived values, bounds ---------------------------------------------------------

_RICH_WIDE_SQL = """known AS (SELECT r.*, a.day FROM rich r JOIN as_ofs a ON r.available_on <= a.day),
one AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY cik, canonical, fiscal_year, day ORDER BY form_score DESC, available_on DESC, amended DESC, accession_number DESC) = 1),
part AS (SELECT * FROM known WHERE canonical = 'short_term_debt' QUALIFY row_number() OVER (PARTITION BY cik, tag, fiscal_year, day ORDER BY available_on DESC, accession_number DESC) = 1),
flat AS (SELECT cik, fiscal_year, day, canonical AS name, value, accession_number FROM one UNION ALL SELECT cik, fiscal_year, day, tag, value, accession_number FROM part),
cols AS (PIVOT flat ON name IN ('net_income', 'total_assets', 'revenue', 'operating_cash_flow', 'capital_expenditures', 'cost_of_revenue', 'operating_income', 'income_tax_expense', 'depreciation_and_amortization',
    'cash_and_equivalents', 'short_term_investments', 'total_current_assets', 'total_current_liabilities', 'stockholders_equity', 'long_term_debt', 'ShortTermBorrowings', 'CommercialPaper', 'LongTermDebtCurrent')
    USING max(value) AS v, max(accession_number) AS a GROUP BY cik, fiscal_year, day),
loans AS (SELECT *, coalesce("ShortTermBorrowings_v", "CommercialPaper_v") AS loan, CASE WHEN "ShortTermBorrowings_v" IS NOT NULL THEN "ShortTermBorrowings_a" ELSE "CommercialPaper_a" END AS loan_a FROM cols),
debts AS (SELECT *, CASE WHEN loan IS NOT NULL OR "LongTermDebtCurrent_v" IS NOT NULL THEN coalesce(loan, 0) + coalesce("LongTermDebtCurrent_v", 0) END AS short, coalesce(loan_a, "LongTermDebtCurrent_a") AS short_a FROM loans),
rw AS (SELECT *, CASE WHEN short IS NOT NULL OR long_term_debt_v IS NOT NULL THEN coalesce(short, 0) + coalesce(long_term_debt_v, 0) END AS debt, CASE WHEN short IS NOT NULL THEN short_a ELSE long_term_debt_a END AS debt_a,
       CASE WHEN cash_and_equivalents_v IS NOT NULL OR short_term_investments_v IS NOT NULL THEN coalesce(cash_and_equivalents_v, 0) + coalesce(short_term_investments_v, 0) END AS liquid, operating_cash_flow_v - capital_expenditures_v AS fcf FROM debts)"""
_DERIVED_SHOWN = ["gross_profit", "short_term_debt", "total_debt", *dims.DERIVED]


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, A.RICH_SQL, _RICH_WIDE_SQL)
    + """, all_ AS (SELECT r.cik, r.fiscal_year, r.day, w.* EXCLUDE (cik, fiscal_year, day) FROM req r LEFT JOIN rw w USING (cik, fiscal_year, day)),
out AS (SELECT cik, fiscal_year, day, unnest(['gross_profit', 'short_term_debt', 'total_debt', 'free_cash_flow', 'net_debt', 'working_capital', 'invested_capital', 'ebitda', 'nopat']) AS concept,
    unnest([revenue_v - cost_of_revenue_v, short, debt, fcf, debt - liquid, total_current_assets_v - total_current_liabilities_v, debt + stockholders_equity_v - coalesce(cash_and_equivalents_v, 0) - coalesce(short_term_investments_v, 0),
            operating_income_v + depreciation_and_amortization_v, CASE WHEN operating_income_v > 0 AND income_tax_expense_v / operating_income_v BETWEEN 0 AND 1 THEN operating_income_v * (1 - income_tax_expense_v / operating_income_v) END]) AS value,
    unnest(['no_fact_known', 'no_fact_known', 'no_fact_known', 'requires_inputs', 'requires_inputs', 'requires_inputs', 'requires_inputs', 'requires_inputs',
            CASE WHEN operating_income_v IS NULL OR income_tax_expense_v IS NULL THEN 'requires_inputs' WHEN operating_income_v <= 0 THEN 'operating_income_not_positive' ELSE 'tax_rate_outside_0_1' END]) AS why FROM all_)
SELECT cik, fiscal_year, CAST(day AS VARCHAR) AS as_of, concept, round(value, 2) AS value, CASE WHEN value IS NULL THEN why END AS missing_reason FROM out"""
)
def derived_statements(spark, sf_dir):
    """Component sums and derived values over facts of many concepts."""
    rows = statements.snapshots(A.rich_facts(spark, sf_dir), _requests(spark, sf_dir)).where(F.col("concept").isin(_DERIVED_SHOWN))
    return rows.select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), "concept", _r("value", 2).alias("value"), "missing_reason")


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, _BEST_SQL)
    + f""", ties AS (SELECT b.cik, b.fiscal_year, b.day, b.concept, b.accession_number, count(DISTINCT round(f.value, 6)) > 1 AS conflict FROM best b JOIN facts f
        ON f.cik = b.cik AND f.canonical = b.canonical AND f.fiscal_year = b.fiscal_year AND f.form_score = b.form_score AND f.available_on = b.available_on AND f.amended = b.amended GROUP BY 1, 2, 3, 4, 5),
said AS (SELECT cik, fiscal_year, day, list('conflict_resolved_deterministically:' || concept || ':' || accession_number) || ['conflicting_concepts'] AS words FROM ties WHERE conflict GROUP BY 1, 2, 3),
seen AS (SELECT cik, fiscal_year, day, list(canonical) AS names, bool_or(amended = 1) AS restated, bool_or(canonical <> 'total_assets') AS flow FROM best GROUP BY 1, 2, 3),
more AS (SELECT *, names || CASE WHEN list_contains(names, 'operating_cash_flow') AND list_contains(names, 'capital_expenditures') THEN ['free_cash_flow'] ELSE [] END AS have FROM seen)
SELECT r.cik, r.fiscal_year, CAST(r.day AS VARCHAR) AS as_of, CASE WHEN m.flow THEN r.fiscal_year || '-01-01' END AS period_start, CASE WHEN m.have IS NOT NULL THEN r.fiscal_year || '-12-31' END AS period_end,
       array_to_string(list_sort(list_filter({[*dims.NAMES, *dims.DERIVED]}, lambda n: NOT list_contains(coalesce(m.have, []), n))), ',') AS missing,
       array_to_string(list_sort(['missing_value'] || CASE WHEN m.restated THEN ['restated_value'] ELSE [] END || coalesce(s.words, [])), ',') AS warnings
FROM req r LEFT JOIN more m USING (cik, fiscal_year, day) LEFT JOIN said s USING (cik, fiscal_year, day)"""
)
def snapshot_bounds(spark, sf_dir):
    """Period bounds, names of missing values and all warnings of each snapshot."""
    rows = statements.snapshot_summary(A.facts(spark, sf_dir), _requests(spark, sf_dir))
    return rows.select(
        "cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), F.array_join("missing", ",").alias("missing"), _joined("warnings").alias("warnings")
    )


# Valuation factors --------------------------------------------------------------------------


def _caps(spark, sf_dir) -> DataFrame:
    """A market cap per nation and decision time: given by hand, stored, in another currency, missing, zero; the last nation has none."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("b"))
    n = F.col("c_nationkey") % 5
    rows = customers.where("c_nationkey < 24").select(
        F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik"), F.when(n == 4, 0.0).when(n != 3, F.abs("b") * 1000 + 1).alias("market_cap"), F.when((n == 0) | (n == 2), "EUR").otherwise("usd").alias("currency"), F.when(n == 3, "missing_raw_price").alias("cap_reason"),
        F.when(n == 1, F.array(F.lit("used_prior_trading_day:1999-01-01"))).alias("cap_warnings"), (n == 0).alias("manual"),
    )
    return rows.withColumn("as_of", F.explode(F.array(*[F.lit(t).cast("timestamp") for t in AS_OFS])))


_VALUED = ["fcf_yield", "price_to_earnings", "price_to_sales", "price_to_book", "debt_change", "operating_margin_change"]


@query(
    _with(A.FACTS_SQL, _AS_OF_SQL, _REQ_SQL, A.RICH_SQL, _RICH_WIDE_SQL)
    + f""", caps AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik, c_nationkey % 5 AS k, abs(round(sum(c_acctbal), 2)) * 1000 + 1 AS b FROM customer WHERE c_nationkey < 24 GROUP BY c_nationkey),
used AS (SELECT *, CASE k WHEN 0 THEN b WHEN 1 THEN b WHEN 4 THEN 0.0 END AS cap, 'market_cap_unavailable' || CASE k WHEN 2 THEN ':currency_mismatch' WHEN 3 THEN ':missing_raw_price' ELSE '' END AS cap_why,
         CASE k WHEN 0 THEN ['manual_market_cap'] WHEN 1 THEN ['used_prior_trading_day:1999-01-01'] WHEN 2 THEN ['currency_mismatch'] ELSE [] END AS cap_words FROM caps),
x AS (SELECT r.cik, r.fiscal_year, r.day, u.k, u.cap, coalesce(u.cap_why, 'market_cap_unavailable') AS cap_why, coalesce(u.cap_words, []) AS cap_words, c.* EXCLUDE (cik, fiscal_year, day), p.debt AS p_debt, p.debt_a AS p_debt_a,
      p.operating_income_v AS p_op, p.revenue_v AS p_rev, p.operating_income_a AS p_op_a, p.revenue_a AS p_rev_a
      FROM req r LEFT JOIN used u USING (cik) LEFT JOIN rw c USING (cik, fiscal_year, day) LEFT JOIN rw p ON p.cik = r.cik AND p.fiscal_year = r.fiscal_year - 1 AND p.day = r.day),
capped AS (SELECT *, CASE WHEN cap IS NULL THEN cap_why WHEN cap <= 0 THEN 'market_cap_not_positive' END AS cap_reason, CASE WHEN cap IS NULL THEN 'market_cap_missing' WHEN cap <= 0 THEN 'invalid_market_cap' END AS cap_word FROM x),
f AS (
 SELECT cik, fiscal_year, day, 'fcf_yield' AS factor, fcf / nullif(cap, 0) AS value, CASE WHEN fcf IS NULL THEN 'free_cash_flow_unavailable' ELSE cap_reason END AS reason, CASE WHEN fcf IS NOT NULL THEN cap_word END AS word, cap_words AS words, [operating_cash_flow_a, capital_expenditures_a] AS filings FROM capped UNION ALL
 SELECT cik, fiscal_year, day, 'price_to_earnings', cap / nullif(net_income_v, 0), CASE WHEN net_income_v IS NULL THEN 'net_income_unavailable' WHEN net_income_v <= 0 THEN 'net_income_not_positive' ELSE cap_reason END,
        CASE WHEN net_income_v <= 0 THEN 'non_positive_earnings' WHEN net_income_v > 0 THEN cap_word END, cap_words, [net_income_a] FROM capped UNION ALL
 SELECT cik, fiscal_year, day, 'price_to_sales', cap / nullif(revenue_v, 0), CASE WHEN revenue_v IS NULL THEN 'revenue_unavailable' WHEN revenue_v <= 0 THEN 'revenue_not_positive' ELSE cap_reason END,
        CASE WHEN revenue_v <= 0 THEN 'non_positive_revenue' WHEN revenue_v > 0 THEN cap_word END, cap_words, [revenue_a] FROM capped UNION ALL
 SELECT cik, fiscal_year, day, 'price_to_book', cap / nullif(stockholders_equity_v, 0), CASE WHEN stockholders_equity_v IS NULL THEN 'stockholders_equity_unavailable' WHEN stockholders_equity_v <= 0 THEN 'stockholders_equity_not_positive' ELSE cap_reason END,
        CASE WHEN stockholders_equity_v <= 0 THEN 'non_positive_equity' WHEN stockholders_equity_v > 0 THEN cap_word END, cap_words, [stockholders_equity_a] FROM capped UNION ALL
 SELECT cik, fiscal_year, day, 'debt_change', debt - p_debt, CASE WHEN debt IS NULL OR p_debt IS NULL THEN 'missing_total_debt' END, NULL, [], [debt_a, p_debt_a] FROM capped UNION ALL
 SELECT cik, fiscal_year, day, 'operating_margin_change', operating_income_v / revenue_v - p_op / p_rev, CASE WHEN operating_income_v / revenue_v IS NULL OR p_op / p_rev IS NULL THEN 'missing_inputs' END,
        CASE WHEN operating_income_v / revenue_v IS NULL OR p_op / p_rev IS NULL THEN 'missing_input' END, [], [operating_income_a, revenue_a, p_op_a, p_rev_a] FROM capped)
SELECT cik, fiscal_year, CAST(day AS VARCHAR) AS as_of, factor, CASE WHEN reason IS NULL THEN round(value, 6) END AS value, reason IS NULL AS valid, reason, {_TEXTS.format('[word] || words')} AS warnings, {_TEXTS.format('filings')} AS source_filings,
       factor IN ('fcf_yield', 'operating_margin_change') AS higher_is_better FROM f"""
)
def valuation_factors(spark, sf_dir):
    """Factors that need a market cap, and those of debt and margin, with reasons and sources."""
    rows = factors.factor_results(A.rich_facts(spark, sf_dir), _requests(spark, sf_dir), _caps(spark, sf_dir), _VALUED)
    return rows.select("cik", _long("fiscal_year").alias("fiscal_year"), _day("as_of").alias("as_of"), "factor", _r("value").alias("value"), "valid", "reason", _joined("warnings").alias("warnings"), _joined("source_filings").alias("source_filings"), "higher_is_better")


# Market evidence ----------------------------------------------------------------------------


@query(
    _metric_sql(A.bars_sql(), "2000-12-29", 253)
    + """, e AS (SELECT symbol, max(trading_date) FILTER (rn = 253) AS d0, max(trading_date) FILTER (rn = 22) AS d1, max(trading_date) FILTER (rn = 1) AS d2, min(trading_date) FILTER (rn <= 253) AS lo, max(trading_date) FILTER (rn <= 253) AS hi FROM p GROUP BY 1)
SELECT symbol, metric, CAST(CASE WHEN n >= 253 THEN d0 END AS VARCHAR) AS window_start, CAST(CASE WHEN n >= 253 THEN CASE metric WHEN 'momentum_12_1' THEN d1 ELSE d2 END END AS VARCHAR) AS window_end, least(n, 253) AS observation_count,
       CAST(lo AS VARCHAR) AS first_date, CAST(hi AS VARCHAR) AS last_date, CAST(hi AS VARCHAR) AS known_on, CAST(lo AS VARCHAR) AS fetched_from, CAST(hi AS VARCHAR) AS fetched_to, 'adjusted_history_may_embed_later_corporate_actions' AS warnings, metric <> 'volatility_1y' AS higher_is_better
FROM m JOIN e USING (symbol)"""
)
def metric_provenance(spark, sf_dir):
    """What each window metric rests on."""
    bars = A.bars(spark, sf_dir)
    rows = market.window_metrics(bars, _metric_requests(bars, "2000-12-29"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return rows.select(
        "symbol", "metric", text("window_start"), text("window_end"), "observation_count", text("first_date"), text("last_date"), _day("available_at").alias("known_on"), _day("fetched_from").alias("fetched_from"), _day("fetched_to").alias("fetched_to"),
        F.array_join("warnings", ",").alias("warnings"), "higher_is_better",
    )


@query(
    _with(A.bars_sql(benchmark=True))
    + """, a AS (SELECT symbol, trading_date, close FROM bars WHERE trading_date BETWEEN DATE '2000-12-29' - 550 AND DATE '2000-12-29'),
w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS rn, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS ret FROM a),
p AS (SELECT *, max(close) FILTER (rn <= 253) OVER (PARTITION BY symbol ORDER BY rn DESC) AS peak FROM w),
s AS (SELECT symbol, count(*) AS n, max(close) FILTER (rn = 22) / max(close) FILTER (rn = 253) - 1 AS mom, stddev_samp(ret) FILTER (rn < 253) * sqrt(252) AS vol, min(close / peak - 1) FILTER (rn <= 253) AS dd FROM p GROUP BY symbol),
j AS (SELECT a.symbol, a.trading_date, a.close AS ca, b.close AS cb FROM a JOIN a b USING (trading_date) WHERE b.symbol = 'MARKET'),
v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS rn, ca / lag(ca) OVER o - 1 AS ra, cb / lag(cb) OVER o - 1 AS rb FROM j WINDOW o AS (PARTITION BY symbol ORDER BY trading_date)),
t AS (SELECT symbol, count(*) AS common, covar_samp(ra, rb) FILTER (rn < 253) / var_samp(rb) FILTER (rn < 253) AS beta FROM v GROUP BY symbol),
o AS (SELECT symbol, n, common, unnest(['momentum_12_1', 'volatility_1y', 'max_drawdown_1y', 'beta_1y']) AS metric, unnest([mom, vol, dd, beta]) AS value FROM s JOIN t USING (symbol))
SELECT symbol, metric, CASE WHEN n >= 253 AND common >= 253 THEN round(value, 6) END AS value, n >= 253 AND common >= 253 AS valid FROM o"""
)
def all_metrics(spark, sf_dir):
    """The four metrics of every symbol in one frame."""
    bars = A.bars(spark, sf_dir, benchmark=True)
    return market.all_metrics(bars, _metric_requests(bars, "2000-12-29")).select("symbol", "metric", _r("value").alias("value"), "valid")


def _share_versions(spark, sf_dir) -> DataFrame:
    """Share counts with conflicts, missing accessions and the second-best concept, by nation."""
    rows, n = A.share_facts(spark, sf_dir), F.col("cik").cast("int") % 4
    rows = rows.withColumn("concept", F.when(n == 2, "CommonStockSharesOutstanding").otherwise(F.col("concept"))).withColumn("accession_number", F.when(n != 1, F.col("accession_number")))
    return rows.unionByName(rows.where(n == 0).withColumn("value", F.col("value") + 1).withColumn("accession_number", F.lit(None).cast("string")))


@query(
    _with(
        A.FACTS_SQL, A.SHARES_SQL, A.NATION_BARS_SQL,
        "asked AS (SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, n_nationkey % 4 AS k, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS market_date FROM nation)",
    )
    + """, priced AS (SELECT q.*, b.trading_date AS price_date FROM asked q LEFT JOIN LATERAL (SELECT trading_date FROM nation_bars n WHERE n.symbol = q.ticker AND n.trading_date <= q.market_date ORDER BY trading_date DESC LIMIT 1) b ON TRUE),
capped AS (SELECT p.*, s.shares, s.end_date FROM priced p LEFT JOIN LATERAL (SELECT shares, end_date FROM share_facts f WHERE f.cik = p.cik AND f.end_date <= p.price_date AND f.available_on <= p.market_date + 10 ORDER BY end_date DESC LIMIT 1) s ON TRUE)
SELECT ticker, CAST(market_date AS VARCHAR) AS market_date, CAST(price_date AS VARCHAR) AS price_date, CAST(CAST(shares AS BIGINT) AS VARCHAR) AS shares, CAST(end_date AS VARCHAR) AS shares_date, CASE WHEN shares IS NOT NULL THEN CASE k WHEN 2 THEN 'CommonStockSharesOutstanding' ELSE 'EntityCommonStockSharesOutstanding' END END AS sec_concept,
       CASE WHEN price_date IS NULL THEN 'missing_raw_price' WHEN market_date - price_date > 7 THEN 'price_stale:' || (market_date - price_date) || '_days_exceeds_7' WHEN shares IS NULL THEN 'no_qualifying_shares_outstanding_fact' END AS reason,
       array_to_string(list_filter([CASE WHEN price_date < market_date THEN 'used_prior_trading_day:' || price_date END, CASE WHEN price_date IS NOT NULL THEN 'later_knowledge_time' END, CASE WHEN k = 0 AND shares IS NOT NULL THEN 'conflicting_equal_priority_shares_facts' END,
           CASE WHEN k = 1 AND shares IS NOT NULL THEN 'missing_accession_provenance' END, CASE WHEN price_date - end_date > 120 THEN 'stale_shares_fact:' || (price_date - end_date) || '_days_old' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM capped"""
)
def market_cap_evidence(spark, sf_dir):
    """Month-start caps as known ten days later: shares, concept, staleness and every warning."""
    days = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month")))
    asked = A.securities(spark, sf_dir).select("ticker", days.alias("market_date")).withColumn("as_of", F.date_add("market_date", 10).cast("timestamp") + F.expr("interval 12 hours"))
    rows = market.market_caps(asked, A.nation_bars(spark, sf_dir), _share_versions(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir))
    text = lambda c: F.col(c).cast("string").alias(c)
    return rows.select("ticker", text("market_date"), text("price_date"), F.col("shares").cast("long").cast("string").alias("shares"), text("shares_date"), "sec_concept", "reason", F.array_join("warnings", ",").alias("warnings"))


# Backtests ----------------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    """Equal and inverse-volatility weights, monthly and quarterly, few names free of cost and more with cost."""
    tickers = A.securities(spark, sf_dir).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    sizes = F.array(F.struct(F.lit(3).alias("top_n"), F.lit(0.0).alias("cost_bps")), F.struct(F.lit(8).alias("top_n"), F.lit(25.0).alias("cost_bps")))
    grid = tickers.withColumn("baseline", F.explode(F.array(F.lit("equal_weight"), F.lit("inverse_volatility")))).withColumn("schedule", F.explode(F.array(F.lit("monthly"), F.lit("quarterly")))).withColumn("s", F.explode(sizes))
    return grid.select(
        F.concat_ws("-", "baseline", "s.top_n", "schedule").alias("run_id"), "tickers", F.lit("ROA").alias("factor"), "s.top_n", "baseline", F.lit("1998-01-01").cast("date").alias("start_date"), F.lit("2000-12-31").cast("date").alias("end_date"), "schedule",
        F.lit(None).cast("array<date>").alias("explicit_dates"), F.lit("market").alias("calendar_symbol"), F.lit("MARKET").alias("benchmark_symbol"), "s.cost_bps", F.lit(1_000_000.0).alias("initial_nav"),
    )


def _log(c: str, name: str) -> Column:
    """Values grow a millionfold on these tables; logarithms compare them at every size."""
    return F.round(F.log1p(c), 6).alias(name)


def _factor_backtests(spark, sf_dir) -> dict[str, DataFrame]:
    return portfolio.run_backtests(_runs(spark, sf_dir), dense_nation_bars(spark, sf_dir), A.facts(spark, sf_dir), A.securities(spark, sf_dir), A.instruments(spark, sf_dir), closes=120)


_BACKTEST_SQL = _with(
    A.FACTS_SQL, A.NATION_BARS_SQL, A.dense_bars_sql(),
    """cal AS (SELECT trading_date AS d, lead(trading_date) OVER (ORDER BY trading_date) AS nd FROM dense WHERE symbol = 'MARKET')""",
    """inside AS (SELECT d FROM cal WHERE d BETWEEN DATE '1998-01-01' AND DATE '2000-12-31')""",
    """last_days AS (SELECT 'monthly' AS schedule, max(d) AS d FROM inside GROUP BY date_trunc('month', d) UNION ALL SELECT 'quarterly', max(d) FROM inside WHERE month(d) IN (3, 6, 9, 12) GROUP BY date_trunc('month', d))""",
    """decs AS (SELECT schedule, d, nd FROM last_days JOIN cal USING (d) WHERE nd <= DATE '2000-12-31')""",
    """dd AS (SELECT DISTINCT d FROM decs)""",
    """newest AS (SELECT cik, d, max(fiscal_year) AS fy FROM facts JOIN dd ON available_on <= d GROUP BY 1, 2)""",
    """chosen AS (SELECT f.*, dd.d FROM facts f JOIN dd ON f.available_on <= dd.d WHERE canonical IN ('net_income', 'total_assets')
        QUALIFY row_number() OVER (PARTITION BY cik, canonical, fiscal_year, dd.d ORDER BY form_score DESC, available_on DESC, amended DESC, accession_number DESC) = 1)""",
    """sig AS (SELECT n.cik, n.d, n.fy, i.value / coalesce((a.value + p.value) / 2.0, a.value) AS value FROM newest n JOIN chosen i ON i.cik = n.cik AND i.d = n.d AND i.fiscal_year = n.fy AND i.canonical = 'net_income'
        JOIN chosen a ON a.cik = n.cik AND a.d = n.d AND a.fiscal_year = n.fy AND a.canonical = 'total_assets' LEFT JOIN chosen p ON p.cik = n.cik AND p.d = n.d AND p.fiscal_year = n.fy - 1 AND p.canonical = 'total_assets')""",
    """pos AS (SELECT upper(n_name) AS symbol, d, fy, value, row_number() OVER (PARTITION BY d ORDER BY value DESC, upper(n_name)) AS p, rank() OVER (PARTITION BY d ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY d) AS n
        FROM sig JOIN nation ON cik = lpad(CAST(n_nationkey AS VARCHAR), 10, '0'))""",
    """runs AS (SELECT baseline || '-' || top_n || '-' || schedule AS run_id, baseline, top_n, schedule, CASE top_n WHEN 3 THEN 0.0 ELSE 0.0025 END AS rate
        FROM (SELECT unnest(['equal_weight', 'inverse_volatility']) AS baseline), (SELECT unnest([3, 8]) AS top_n), (SELECT unnest(['monthly', 'quarterly']) AS schedule))""",
    """sel AS (SELECT r.run_id, r.baseline, d.d, d.nd, pos.symbol, pos.value, pos.r, pos.fy FROM runs r JOIN decs d USING (schedule) JOIN pos ON pos.d = d.d AND p <= top_n AND n >= top_n)""",
    """lately AS (SELECT dd.d, b.symbol, b.close / lag(b.close) OVER (PARTITION BY dd.d, b.symbol ORDER BY b.trading_date) - 1 AS ret, row_number() OVER (PARTITION BY dd.d, b.symbol ORDER BY b.trading_date DESC) AS rn
        FROM dense b JOIN dd ON b.trading_date <= dd.d AND b.trading_date >= dd.d - 550)""",
    """sds AS (SELECT d, symbol, stddev_samp(ret) AS sd FROM lately WHERE rn < 120 GROUP BY 1, 2)""",
    """wts AS (SELECT run_id, d, nd, symbol, value, r, fy, CASE baseline WHEN 'equal_weight' THEN 1.0 / count(*) OVER (PARTITION BY run_id, d) ELSE 1 / sd / sum(1 / sd) OVER (PARTITION BY run_id, d) END AS w FROM sel JOIN sds USING (d, symbol))""",
    """segs AS (SELECT run_id, d, nd AS eff, row_number() OVER (PARTITION BY run_id ORDER BY d) AS k, coalesce(lead(nd) OVER (PARTITION BY run_id ORDER BY d), DATE '2000-12-31') AS until FROM (SELECT DISTINCT run_id, d, nd FROM wts))""",
    """priced AS (SELECT s.run_id, s.k, w.symbol, w.w * b.close / b0.close AS worth, c.d AS day, s.until FROM segs s JOIN wts w USING (run_id, d) JOIN dense b0 ON b0.symbol = w.symbol AND b0.trading_date = s.eff
        JOIN cal c ON c.d > s.eff AND c.d <= s.until JOIN dense b ON b.symbol = w.symbol AND b.trading_date = c.d)""",
    """growth AS (SELECT run_id, k, day, until, sum(worth) AS g FROM priced GROUP BY 1, 2, 3, 4)""",
    """ends AS (SELECT run_id, k, g FROM growth WHERE day = until)""",
    """tops AS (SELECT run_id, max(k) AS top FROM segs GROUP BY 1)""",
    """drift AS (SELECT p.run_id, p.k + 1 AS k, p.symbol, p.worth / e.g AS before FROM priced p JOIN ends e USING (run_id, k) JOIN tops USING (run_id) WHERE p.day = p.until AND p.k < top)""",
    """moves AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.k, b.k) AS k, coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.before, 0.0) AS before, coalesce(a.w, 0.0) AS after
        FROM (SELECT s.run_id, s.k, w.symbol, w.w FROM segs s JOIN wts w USING (run_id, d)) a FULL JOIN drift b ON a.run_id = b.run_id AND a.k = b.k AND a.symbol = b.symbol)""",
    """turns AS (SELECT run_id, k, sum(abs(after - before)) AS turnover FROM moves GROUP BY 1, 2)""",
    """factors AS (SELECT s.run_id, s.k, s.d, s.eff, t.turnover, r.rate, coalesce(e.g, 1.0) AS g, coalesce(e.g, 1.0) * (1 - t.turnover * r.rate) AS f FROM segs s JOIN turns t USING (run_id, k) JOIN runs r USING (run_id) LEFT JOIN ends e ON e.run_id = s.run_id AND e.k = s.k - 1)""",
    """chain AS (SELECT *, 1e6 * product(f) OVER (PARTITION BY run_id ORDER BY k) AS post, 1e6 * coalesce(product(f) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) * g AS pre FROM factors)""",
    """marks AS (SELECT g.run_id, g.day, c.post * g.g AS mark FROM growth g JOIN chain c USING (run_id, k))""",
    """path AS (SELECT r.run_id, i.d, coalesce(m.mark, c.pre, 1e6) AS mark, coalesce(c.post, m.mark, 1e6) AS nav, b.close AS b FROM runs r CROSS JOIN inside i LEFT JOIN marks m ON m.run_id = r.run_id AND m.day = i.d LEFT JOIN chain c ON c.run_id = r.run_id AND c.eff = i.d
        JOIN dense b ON b.symbol = 'MARKET' AND b.trading_date = i.d)""",
    """walk AS (SELECT *, greatest(1e6, max(mark) OVER w) AS peak, greatest(1e6, max(mark) OVER w, max(nav) OVER w) AS event_peak, nav / lag(nav) OVER (PARTITION BY run_id ORDER BY d) - 1 AS ret, first_value(b) OVER w AS b0 FROM path WINDOW w AS (PARTITION BY run_id ORDER BY d))""",
)


@query(
    _BACKTEST_SQL
    + """, stats AS (SELECT run_id, arg_max(nav, d) / 1e6 AS ratio, count(ret) AS n, stddev_samp(ret) AS sd, avg(ret) AS mean, min(least(nav / event_peak - 1, mark / greatest(peak, mark) - 1)) AS dd FROM walk GROUP BY 1),
costs AS (SELECT run_id, sum(turnover) AS turnover, sum(pre * turnover * rate) AS cost, count(*) AS done FROM chain GROUP BY 1),
blend AS (SELECT run_id, max(years) > 1 AS mixed FROM (SELECT run_id, d, count(DISTINCT fy) AS years FROM sel GROUP BY 1, 2) GROUP BY 1)
SELECT run_id, 'adjusted_history_may_embed_later_corporate_actions,universe_may_carry_survivorship_bias' || CASE WHEN mixed THEN ',mixed_fiscal_periods' ELSE '' END AS warnings, 'success' AS status, CAST(NULL AS VARCHAR) AS reason, round(ln(ratio), 6) AS log_return, round(pow(ratio, 252.0 / n) - 1, 6) AS annualized_return, round(sd * sqrt(252), 6) AS annualized_volatility, round(mean / sd * sqrt(252), 6) AS sharpe_ratio, round(dd, 6) AS max_drawdown,
       round(turnover, 6) AS gross_turnover, round(ln(1 + cost), 6) AS log_cost, done AS successful_rebalance_count, n AS interval_count, CAST(0 AS BIGINT) AS leakage_violations FROM stats JOIN costs USING (run_id) JOIN blend USING (run_id)"""
)
def factor_backtests(spark, sf_dir):
    """Figures of each run."""
    rows = _factor_backtests(spark, sf_dir)["runs"]
    return rows.select(
        "run_id", F.array_join("warnings", ",").alias("warnings"), "status", "reason", _log("total_return", "log_return"), *[_r(c).alias(c) for c in ("annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "gross_turnover")], _log("transaction_cost_total", "log_cost"),
        _long("successful_rebalance_count").alias("successful_rebalance_count"), _long("interval_count").alias("interval_count"), _long("leakage_violations").alias("leakage_violations"),
    )


@query(
    _BACKTEST_SQL
    + " SELECT run_id, CAST(d AS VARCHAR) AS trading_date, round(ln(1 + nav), 6) AS log_nav, CASE WHEN d >= (SELECT min(eff) FROM chain c WHERE c.run_id = walk.run_id) THEN 0.0 ELSE 1.0 END AS cash_weight, round(nav / peak - 1, 6) AS drawdown, round(ln(1 + 1e6 * b / b0), 6) AS log_benchmark_nav FROM walk"
)
def factor_backtest_equity(spark, sf_dir):
    """Each run's value, drawdown and benchmark on every session."""
    rows = _factor_backtests(spark, sf_dir)["equity"]
    return rows.select("run_id", F.col("trading_date").cast("string").alias("trading_date"), _log("nav", "log_nav"), "cash_weight", _r("drawdown").alias("drawdown"), _log("benchmark_nav", "log_benchmark_nav"))


@query(
    _BACKTEST_SQL
    + """ SELECT m.run_id, CAST(c.d AS VARCHAR) AS decision_date, CAST(c.eff AS VARCHAR) AS effective_date, m.symbol, round(m.before, 6) AS current_weight_before, round(m.after, 6) AS target_weight_after, round(m.after - m.before, 6) AS delta_weight,
       round(ln(1 + abs(m.after - m.before) * c.pre), 6) AS log_notional, round(ln(1 + CASE WHEN c.turnover > 0 THEN c.pre * c.turnover * c.rate * abs(m.after - m.before) / c.turnover ELSE 0 END), 6) AS log_cost,
       round(w.value, 6) AS signal_value, CAST(w.r AS DOUBLE) AS signal_rank, 'FY' || w.fy AS signal_period FROM moves m JOIN chain c USING (run_id, k) LEFT JOIN wts w ON w.run_id = m.run_id AND w.d = c.d AND w.symbol = m.symbol"""
)
def factor_backtest_moves(spark, sf_dir):
    """Every change of weight with its notional, its share of the cost and its signal."""
    rows = _factor_backtests(spark, sf_dir)["transitions"]
    text = lambda c: F.col(c).cast("string").alias(c)
    return rows.select(
        "run_id", text("decision_date"), text("effective_date"), "symbol", *[_r(c).alias(c) for c in ("current_weight_before", "target_weight_after", "delta_weight")], _log("gross_notional", "log_notional"), _log("allocated_cost", "log_cost"),
        _r("signal_value").alias("signal_value"), F.col("signal_rank").cast("double").alias("signal_rank"), "signal_period",
    )


@query(
    _BACKTEST_SQL
    + """ SELECT r.run_id, CAST(t.d AS VARCHAR) AS decision_date, CAST(t.nd AS VARCHAR) AS effective_date, CASE WHEN c.k IS NULL THEN 'unavailable' ELSE 'success' END AS status, CASE WHEN c.k IS NULL THEN 'factor_universe_too_small' END AS reason,
       round(ln(1 + coalesce(c.pre, p.nav)), 6) AS log_pre_nav, round(ln(1 + coalesce(c.post, p.nav)), 6) AS log_post_nav, round(coalesce(c.turnover, 0), 6) AS gross_turnover, round(ln(1 + coalesce(c.pre * c.turnover * c.rate, 0)), 6) AS log_cost
FROM runs r JOIN decs t USING (schedule) LEFT JOIN chain c ON c.run_id = r.run_id AND c.d = t.d LEFT JOIN path p ON p.run_id = r.run_id AND p.d = t.nd"""
)
def factor_backtest_rebalances(spark, sf_dir):
    """Each attempt to rebalance, with value before and after its cost."""
    rows = _factor_backtests(spark, sf_dir)["rebalances"]
    text = lambda c: F.col(c).cast("string").alias(c)
    return rows.select("run_id", text("decision_date"), text("effective_date"), "status", "reason", _log("pre_cost_nav", "log_pre_nav"), _log("post_cost_nav", "log_post_nav"), _r("gross_turnover").alias("gross_turnover"), _log("cost_amount", "log_cost"))


@query(
    """WITH cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT upper(n_name) AS symbol, n_nationkey AS cik FROM nation),
inside AS (SELECT d, lead(d) OVER (ORDER BY d) AS nd FROM cal WHERE d BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'), decs AS (SELECT max(d) AS d, max_by(nd, d) AS nd FROM inside GROUP BY date_trunc('month', d)),
said AS (SELECT 'nobody' AS run_id, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE symbol = 'NOBODY') THEN 'issuer_identity_unavailable' END AS reason
    UNION ALL SELECT 'too_many', CASE WHEN count(*) + 1 > count(DISTINCT cik) THEN 'factor_universe_too_small' END FROM n
    UNION ALL SELECT 'no_calendar', CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE symbol = 'NOWHERE') THEN 'calendar_missing' END
    UNION ALL SELECT 'dear', CASE WHEN 0.4 * 2 >= 1 THEN 'invalid_post_cost_nav' END UNION ALL SELECT 'too_dear', CASE WHEN 1.0 * 1 >= 1 THEN 'invalid_post_cost_nav' END
    UNION ALL SELECT 'outside', CASE WHEN DATE '1997-01-05' NOT BETWEEN (SELECT min(d) FROM inside) AND (SELECT max(d) FROM inside) THEN 'explicit_date_out_of_range' END
    UNION ALL SELECT 'gap', CASE WHEN EXISTS (SELECT 1 FROM cal WHERE d BETWEEN DATE '1999-06-08' AND DATE '1999-06-12') THEN 'held_return_missing' END
    UNION ALL SELECT 'short_history', CASE WHEN count(*) < 120 THEN 'baseline_unavailable' END FROM cal WHERE d <= (SELECT max(d) FROM cal WHERE d < DATE '1995-03-01')
    UNION ALL SELECT 'same_issuer', CASE WHEN count(DISTINCT cik) < 2 THEN 'same_issuer_universe' END FROM (SELECT cik FROM n WHERE symbol = 'NATION_0' UNION ALL SELECT cik FROM n WHERE symbol = 'NATION_0')
    UNION ALL SELECT 'doubled', CASE WHEN EXISTS (SELECT 1 FROM inside WHERE day(d) = 3) THEN 'calendar_ambiguous' END
    UNION ALL SELECT 'late', CASE WHEN EXISTS (SELECT 1 FROM decs WHERE date_trunc('month', d) = DATE '1999-03-01' AND d + 40 >= nd) THEN 'leakage_detected' END
    UNION ALL SELECT 'fine', NULL)
SELECT run_id, CASE WHEN reason IS NULL THEN 'success' WHEN reason IN ('invalid_post_cost_nav', 'held_return_missing', 'leakage_detected') THEN 'failed' ELSE 'unavailable' END AS status, reason, CASE WHEN run_id = 'late' THEN (SELECT count(*) * 3 FROM decs WHERE date_trunc('month', d) = DATE '1999-03-01' AND d + 40 >= nd) ELSE 0 END AS violations FROM said"""
)
def backtest_outcomes(spark, sf_dir):
    """One run for each way to end: names without issuer, too few names, no calendar, a cost that takes
    everything, a date outside the range, a missing price of a held name, too short a history, two names
    of one issuer, a calendar with doubled days, and one that is known later than what it decides."""
    base = _runs(spark, sf_dir).where("run_id = 'equal_weight-3-monthly'").drop("run_id", "cost_bps")
    nations = A.securities(spark, sf_dir).count()
    odd = {
        "nobody": {"tickers": F.array(F.lit("NOBODY"))}, "too_many": {"top_n": F.lit(nations + 1)}, "no_calendar": {"calendar_symbol": F.lit("NOWHERE")}, "dear": {"cost_bps": F.lit(4000.0)}, "too_dear": {"cost_bps": F.lit(10_000.0)},
        "outside": {"schedule": F.lit("explicit"), "explicit_dates": F.array(F.lit("1997-01-05").cast("date"))}, "gap": {"top_n": F.lit(1), "start_date": F.lit("1999-01-01").cast("date"), "tickers": F.array(F.lit("NATION_0"))},
        "short_history": {"baseline": F.lit("inverse_volatility"), "start_date": F.lit("1995-02-01").cast("date"), "top_n": F.lit(1)}, "fine": {},
        "same_issuer": {"tickers": F.array(F.lit("NATION_0"), F.lit("TWIN")), "top_n": F.lit(1)}, "doubled": {"calendar_symbol": F.lit("DOUBLED")}, "late": {"calendar_symbol": F.lit("LATE")},
    }
    runs = None
    for name, change in odd.items():
        one = base.withColumn("cost_bps", F.lit(1.0)).withColumns(change).withColumn("run_id", F.lit(name))
        runs = one if runs is None else runs.unionByName(one)
    bars = dense_nation_bars(spark, sf_dir).where("not (symbol = 'NATION_0' and trading_date between date'1999-06-08' and date'1999-06-12')")
    market_ = bars.where("symbol = 'MARKET'")
    doubled = market_.withColumn("symbol", F.lit("DOUBLED"))
    late = market_.withColumns({"symbol": F.lit("LATE"), "available_at": F.when(F.trunc("trading_date", "month") == F.lit("1999-03-01").cast("date"), F.col("available_at") + F.expr("interval 40 days")).otherwise(F.col("available_at"))})
    bars = bars.unionByName(doubled).unionByName(doubled.where("day(trading_date) = 3")).unionByName(late)
    listed = A.instruments(spark, sf_dir)
    listed = listed.unionByName(listed.where("canonical_symbol = 'NATION_0'").withColumns({"instrument_id": F.lit("i_TWIN"), "canonical_symbol": F.lit("TWIN")}))
    out = portfolio.run_backtests(runs, bars, A.facts(spark, sf_dir), A.securities(spark, sf_dir), listed, closes=120)
    return out["runs"].select("run_id", "status", "reason", F.col("leakage_violations").cast("long").alias("violations"))


@query(
    _BACKTEST_SQL
    + """, said AS (SELECT *, '{"baseline":"' || baseline || '","benchmark_symbol":"MARKET","calendar_symbol":"market","cost_bps":' || CASE top_n WHEN 3 THEN '0.0' ELSE '25.0' END || ',"end_date":"2000-12-31","factor":"roa","initial_nav":1000000.0,"schedule":"' || schedule
              || '","start_date":"1998-01-01","tickers":["' || (SELECT string_agg(upper(n_name), '","' ORDER BY upper(n_name)) FROM nation) || '"],"top_n":' || top_n || '}' AS request FROM runs)
SELECT run_id, (SELECT count(*) FROM decs WHERE decs.schedule = said.schedule) AS rebalances, (SELECT count(*) FROM moves WHERE moves.run_id = said.run_id) AS transitions, (SELECT count(*) FROM inside) AS equity,
       (SELECT CAST(min(d) AS VARCHAR) FROM inside) AS first_day, (SELECT CAST(max(d) AS VARCHAR) FROM decs WHERE decs.schedule = said.schedule) AS last_decision, CAST(top_n AS VARCHAR) AS top_n, schedule, sha256(request) AS fingerprint FROM said"""
)
def stored_backtests(spark, sf_dir):
    """Runs written twice, a third write cut short, and read back once each with their documents."""
    out, path, asked = _factor_backtests(spark, sf_dir), scratch_path(spark), _runs(spark, sf_dir)
    for _ in range(2):
        sinks.write_backtest(out, path)
    out["equity"].limit(1).write.parquet(f"{path}/equity/generation=0000000002")  # never committed
    sinks.vacuum_backtests(spark, path)
    back = sinks.read_backtest(spark, path)
    paths = {"top_n": "request.top_n", "schedule": "request.schedule", "fingerprint": "fingerprint", "first_day": "equity[0].trading_date"}
    told = sinks.backtest_documents(back, asked).select("run_id", *[F.get_json_object("document", f"$.{p}").alias(n) for n, p in paths.items()])
    sizes = back.select("run_id", *[F.size(c).cast("long").alias(c) for c in ("rebalances", "transitions", "equity")], F.element_at("rebalances", -1)["decision_date"].cast("string").alias("last_decision"))
    return sizes.join(told, "run_id").select("run_id", "rebalances", "transitions", "equity", "first_day", "last_decision", "top_n", "schedule", "fingerprint")

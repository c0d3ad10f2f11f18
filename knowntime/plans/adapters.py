"""Domain views over the driver's generic tables, with the same views as DuckDB SQL.

Orders of a nation stand for reported facts, line items for daily bars, customers
for securities, events for knowledge-time prices.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowntime.functions.scalars import bar_available_at

#: Order priority -> reported concept.
PRIORITY_CONCEPTS = {
    "1-URGENT": "NetIncomeLoss",
    "2-HIGH": "Assets",
    "3-MEDIUM": "Revenues",
    "4-NOT SPECIFIED": "NetCashProvidedByUsedInOperatingActivities",
    "5-LOW": "PaymentsToAcquirePropertyPlantAndEquipment",
}
FORMS = {"F": "10-K", "O": "10-K/A", "P": "10-Q"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, table: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), column)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual facts: an order is one version of its nation's value for the order's year."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = _table(spark, sf_dir, "orders").join(customers, "o_custkey")
    day = F.to_date("o_orderdate")
    concept = _case(F.col("o_orderpriority"), PRIORITY_CONCEPTS)
    year = F.year(day)
    return orders.select(
        F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik"), F.lit("us-gaap").alias("taxonomy"), concept.alias("concept"), F.lit("USD").alias("unit"), F.col("o_totalprice").alias("value"),
        F.when(concept != "Assets", F.make_date(year, F.lit(1), F.lit(1))).alias("start_date"), F.make_date(year, F.lit(12), F.lit(31)).alias("end_date"), day.alias("filing_date"), F.lit(None).cast("timestamp").alias("acceptance_datetime"),
        F.date_add(day, 45).cast("timestamp").alias("available_at"), F.col("o_orderkey").cast("string").alias("accession_number"), _case(F.col("o_orderstatus"), FORMS).alias("form"), year.alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.lit(None).cast("string").alias("frame"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("fact_id"),
    )


FACTS_SQL = """facts AS (
    SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'NetIncomeLoss' WHEN '2-HIGH' THEN 'Assets' WHEN '3-MEDIUM' THEN 'Revenues'
                WHEN '4-NOT SPECIFIED' THEN 'NetCashProvidedByUsedInOperatingActivities' ELSE 'PaymentsToAcquirePropertyPlantAndEquipment' END AS concept,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'net_income' WHEN '2-HIGH' THEN 'total_assets' WHEN '3-MEDIUM' THEN 'revenue'
                WHEN '4-NOT SPECIFIED' THEN 'operating_cash_flow' ELSE 'capital_expenditures' END AS canonical,
           o_totalprice AS value, year(o_orderdate) AS fiscal_year, CAST(o_orderdate AS DATE) AS filing_date,
           CAST(o_orderdate AS DATE) + 45 AS available_on, CAST(o_orderkey AS VARCHAR) AS accession_number,
           CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '10-Q' END AS form,
           CASE o_orderstatus WHEN 'P' THEN 0 ELSE 2 END AS form_score, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS amended,
           'f' || CAST(o_orderkey AS VARCHAR) AS fact_id
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def share_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share counts: number of a nation's orders in a year, known 45 days after the year's last order."""
    rows = facts(spark, sf_dir).groupBy("cik", "fiscal_year").agg(F.count("*").cast("double").alias("value"), F.max("filing_date").alias("end_date"), F.max("available_at").alias("available_at"))
    return rows.select("cik", F.lit("dei").alias("taxonomy"), F.lit("EntityCommonStockSharesOutstanding").alias("concept"), F.lit("shares").alias("unit"), "value", "end_date", "available_at", F.concat(F.lit("s"), F.col("fiscal_year").cast("string")).alias("accession_number"), F.lit("10-K").alias("form"))


SHARES_SQL = """share_facts AS (
    SELECT cik, count(*) AS shares, max(filing_date) AS end_date, max(available_on) AS available_on FROM facts GROUP BY cik, fiscal_year)"""


def bars(spark: SparkSession, sf_dir: str, key: str = "l_returnflag", benchmark: bool = False) -> DataFrame:
    """Daily bars of each ``key`` from line items; ``benchmark`` adds MARKET over all rows."""
    items = _table(spark, sf_dir, "lineitem").select(F.col(key).cast("string").alias("symbol"), F.to_date("l_shipdate").alias("trading_date"), "l_quantity", "l_extendedprice")
    if benchmark:
        items = items.withColumn("symbol", F.explode(F.array("symbol", F.lit("MARKET"))))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    daily = items.groupBy("symbol", "trading_date").agg(
        F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.sum(F.col("l_quantity").cast("long")) / 100, 6).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").cast("long").alias("volume")
    )
    return daily.select(
        F.concat(F.lit("i_"), "symbol").alias("instrument_id"), "symbol", F.lit("table").alias("provider"), "trading_date", F.lit("all").alias("adjustment_mode"), F.col("close").alias("open"), "high", "low", "close", "volume", F.lit("USD").alias("currency"),
        F.lit("America/New_York").alias("exchange_timezone"), bar_available_at(F.col("trading_date"), F.lit("America/New_York")).alias("available_at"), bar_available_at(F.col("trading_date"), F.lit("America/New_York")).alias("fetched_at"),
    )


def bars_sql(key: str = "l_returnflag", benchmark: bool = False) -> str:
    """``bars(symbol, trading_date, close, volume)``; exact integer sums keep both engines alike."""
    source = f"SELECT CAST({key} AS VARCHAR) AS symbol, l_shipdate, l_quantity, l_extendedprice FROM lineitem"
    if benchmark:
        source += " UNION ALL SELECT 'MARKET', l_shipdate, l_quantity, l_extendedprice FROM lineitem"
    return f"""bars AS (
    SELECT symbol, CAST(l_shipdate AS DATE) AS trading_date,
           round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100, 6) AS close,
           CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM ({source}) GROUP BY 1, 2)"""


def securities(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    """One security per nation, or with ``many`` one per customer."""
    if many:
        rows = _table(spark, sf_dir, "customer").select(F.upper("c_name").alias("ticker"), F.col("c_nationkey").alias("n"))
    else:
        rows = _table(spark, sf_dir, "nation").select(F.upper("n_name").alias("ticker"), F.col("n_nationkey").alias("n"))
    return rows.select("ticker", F.lpad(F.col("n").cast("string"), 10, "0").alias("cik"), F.lit(True).alias("is_primary"), F.lit(None).cast("string").alias("exchange"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily raw bars per nation: mean order value of its customers, ticker = nation name."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", F.upper("n_name").alias("symbol"))
    rows = _table(spark, sf_dir, "orders").join(customers, "o_custkey").join(nations, "n_nationkey").groupBy("symbol", F.to_date("o_orderdate").alias("trading_date"))
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / 10000
    # scaled before it is rounded, as in the SQL: a cast rounds the shortest text of the double, and ties part
    close = (F.floor(mean * 1_000_000 + 0.5).cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    daily = rows.agg(close.alias("close"), F.count("*").alias("volume"))
    at = bar_available_at(F.col("trading_date"), F.lit("America/New_York"))
    return daily.select(F.concat(F.lit("i_"), "symbol").alias("instrument_id"), "symbol", F.lit("table").alias("provider"), "trading_date", F.lit("none").alias("adjustment_mode"), "close", "volume", F.lit("USD").alias("currency"), at.alias("available_at"), at.alias("fetched_at"))


NATION_BARS_SQL = """nation_bars AS (
    SELECT upper(n_name) AS symbol, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS trading_date,
           CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS DECIMAL(18, 6)) AS close, count(*) AS volume
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return securities(spark, sf_dir).select(F.concat(F.lit("i_"), "ticker").alias("instrument_id"), F.col("ticker").alias("canonical_symbol"), F.col("cik").alias("issuer_cik"))


def issuer_requests(spark: SparkSession, sf_dir: str, as_ofs: list[str], first_year: int = 1995, last_year: int = 2001) -> DataFrame:
    """Every issuer x fiscal year x decision time."""
    issuers = _table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("cik"))
    times = F.explode(F.array(*[F.lit(t).cast("timestamp") for t in as_ofs]))
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    return issuers.withColumn("fiscal_year", years).withColumn("fiscal_period", F.lit("FY")).withColumn("as_of", times)


#: Reported tag, canonical concept and whether it is an instant, by order key modulo their number.
RICH_CONCEPTS = (
    ("NetIncomeLoss", "net_income", False),
    ("Assets", "total_assets", True),
    ("Revenues", "revenue", False),
    ("NetCashProvidedByUsedInOperatingActivities", "operating_cash_flow", False),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "capital_expenditures", False),
    ("CostOfRevenue", "cost_of_revenue", False),
    ("OperatingIncomeLoss", "operating_income", False),
    ("IncomeTaxExpenseBenefit", "income_tax_expense", False),
    ("DepreciationDepletionAndAmortization", "depreciation_and_amortization", False),
    ("Cash", "cash_and_equivalents", True),
    ("ShortTermInvestments", "short_term_investments", True),
    ("AssetsCurrent", "total_current_assets", True),
    ("LiabilitiesCurrent", "total_current_liabilities", True),
    ("StockholdersEquity", "stockholders_equity", True),
    ("ShortTermBorrowings", "short_term_debt", True),
    ("CommercialPaper", "short_term_debt", True),
    ("LongTermDebtCurrent", "short_term_debt", True),
    ("LongTermDebtNoncurrent", "long_term_debt", True),
)


def rich_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual facts of many concepts, some negative: incomes and equity may fall below zero, tax
    may exceed income, depreciation is reported with a minus sign."""
    rows, n = facts(spark, sf_dir), F.col("accession_number").cast("long") % len(RICH_CONCEPTS)
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in RICH_CONCEPTS]), (n + 1).cast("int"))
    tag, name, instant = pick(0), pick(1), pick(2)
    value = (
        F.when(name.isin("net_income", "operating_income"), F.col("value") - 100_000).when(name == "stockholders_equity", F.col("value") - 200_000)
        .when(name == "income_tax_expense", F.col("value") / 4 - 20_000).when(name == "depreciation_and_amortization", -F.col("value")).otherwise(F.col("value"))
    )
    return rows.withColumns({"concept": tag, "value": value, "start_date": F.when(~instant, F.make_date("fiscal_year", F.lit(1), F.lit(1)))})


_TAG_SQL = "CASE o_orderkey % 18 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _, _) in enumerate(RICH_CONCEPTS)) + " END"
_NAME_SQL = "CASE o_orderkey % 18 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c, _) in enumerate(RICH_CONCEPTS)) + " END"
RICH_SQL = f"""rich AS (
    SELECT f.cik, {_TAG_SQL} AS tag, {_NAME_SQL} AS canonical, f.fiscal_year, f.available_on, f.accession_number, f.form_score, f.amended,
           CASE {_NAME_SQL} WHEN 'net_income' THEN f.value - 100000 WHEN 'operating_income' THEN f.value - 100000 WHEN 'stockholders_equity' THEN f.value - 200000 WHEN 'income_tax_expense' THEN f.value / 4 - 20000 ELSE f.value END AS value
    FROM facts f JOIN orders o ON f.accession_number = CAST(o.o_orderkey AS VARCHAR))"""


def quarter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts: a nation's orders of a concept, summed over the quarter for every third
    nation and from the start of the year for the others; every fifth nation begins the
    half-year's sum nine days late. Known 40 days after the quarter."""
    rows = facts(spark, sf_dir).groupBy("cik", "concept", "fiscal_year", F.quarter("filing_date").alias("q")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("cik", "concept", "fiscal_year").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    number, alone = F.col("cik").cast("int"), F.col("cik").cast("int") % 3 == 1
    first = F.make_date("fiscal_year", F.lit(1), F.lit(1))
    begin = F.make_date("fiscal_year", (F.col("q") * 3 - 2).cast("int"), F.lit(1))
    end = F.last_day(F.add_months(begin, 2))
    start = F.when(F.col("concept") == "Assets", None).when(alone, begin).when((number % 5 == 0) & (F.col("q") == 2), F.date_add(first, 9)).otherwise(first)
    made = rows.withColumn("cum", F.sum("v").over(w)).withColumn("end_date", end).withColumn("start_date", start).withColumn("value", F.when(alone, F.col("v")).otherwise(F.col("cum")))
    return made.select(
        "cik", F.lit("us-gaap").alias("taxonomy"), "concept", F.lit("USD").alias("unit"), "value", "start_date", "end_date", F.date_add("end_date", 30).alias("filing_date"), F.lit(None).cast("timestamp").alias("acceptance_datetime"), F.date_add("end_date", 40).cast("timestamp").alias("available_at"),
        F.concat_ws("-", "cik", "fiscal_year", "q").alias("accession_number"), F.lit("10-Q").alias("form"), "fiscal_year", F.concat(F.lit("Q"), F.col("q").cast("string")).alias("fiscal_period"), F.lit(None).cast("string").alias("frame"), F.concat_ws("-", "cik", "concept", "fiscal_year", "q").alias("fact_id"),
    )


QUARTERS_SQL = """cells AS (
    SELECT cik, canonical, fiscal_year, quarter(filing_date) AS q, sum(value) AS v FROM facts GROUP BY 1, 2, 3, 4),
quarters AS (
    SELECT *, sum(v) OVER (PARTITION BY cik, canonical, fiscal_year ORDER BY q) AS cum, CAST(cik AS INTEGER) % 3 = 1 AS alone, CAST(cik AS INTEGER) % 5 = 0 AS late,
           last_day(make_date(fiscal_year, q * 3, 1)) AS end_date, last_day(make_date(fiscal_year, q * 3, 1)) + 40 AS available_on, cik || '-' || fiscal_year || '-' || q AS accession_number FROM cells)"""


def dense_bars_sql() -> str:
    """``dense(symbol, trading_date, close)``: nation bars carried over the orders' calendar, and MARKET."""
    return """raw AS (SELECT symbol, trading_date, CAST(close AS DOUBLE) AS close FROM nation_bars),
    everyone AS (SELECT * FROM raw UNION ALL SELECT 'MARKET', trading_date, round(avg(close), 6) FROM raw GROUP BY 2),
    days AS (SELECT DISTINCT trading_date FROM raw),
    dense AS (SELECT symbol, trading_date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trading_date) AS close
              FROM (SELECT s.symbol, d.trading_date FROM (SELECT DISTINCT symbol FROM everyone) s, days d) LEFT JOIN everyone USING (symbol, trading_date) QUALIFY close IS NOT NULL OR last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trading_date) IS NOT NULL)"""

"""Fixed dimensions: canonical concepts, factors, metrics. All are small and constant."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Concept(NamedTuple):
    name: str
    statement: str
    period_type: str
    unit: str
    sign_mode: str
    tags: tuple[str, ...]


def _c(name: str, statement: str, tags: tuple[str, ...], period_type: str = "duration", unit: str = "USD", sign_mode: str = "identity") -> Concept:
    return Concept(name, statement, period_type, unit, sign_mode, tags)


#: Canonical concepts and their reporting tags, highest priority first.
CONCEPTS = (
    _c("revenue", "income", ("RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet")),
    _c("cost_of_revenue", "income", ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold", "CostOfServices")),
    _c("gross_profit", "income", ("GrossProfit",)),
    _c("operating_income", "income", ("OperatingIncomeLoss",)),
    _c("net_income", "income", ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic")),
    _c("interest_expense", "income", ("InterestExpense", "InterestExpenseDebt", "InterestAndDebtExpense"), sign_mode="abs"),
    _c("income_tax_expense", "income", ("IncomeTaxExpenseBenefit",)),
    _c("research_and_development", "income", ("ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost")),
    _c("selling_general_and_administrative", "income", ("SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense", "SellingAndMarketingExpense")),
    _c("diluted_eps", "income", ("EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"), unit="USD/shares"),
    _c("diluted_shares", "income", ("WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfShareOutstandingBasicAndDiluted"), unit="shares"),
    _c("cash_and_equivalents", "balance", ("CashAndCashEquivalentsAtCarryingValue", "Cash"), "instant"),
    _c("short_term_investments", "balance", ("ShortTermInvestments", "MarketableSecuritiesCurrent", "AvailableForSaleSecuritiesCurrent"), "instant"),
    _c("total_current_assets", "balance", ("AssetsCurrent",), "instant"),
    _c("total_assets", "balance", ("Assets",), "instant"),
    _c("accounts_receivable", "balance", ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent", "AccountsReceivableNet"), "instant"),
    _c("inventory", "balance", ("InventoryNet", "InventoryFinishedGoodsNetOfReserves"), "instant"),
    _c("ppe", "balance", ("PropertyPlantAndEquipmentNet", "PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization"), "instant"),
    _c("goodwill", "balance", ("Goodwill",), "instant"),
    _c("intangible_assets", "balance", ("IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"), "instant"),
    _c("total_current_liabilities", "balance", ("LiabilitiesCurrent",), "instant"),
    _c("total_liabilities", "balance", ("Liabilities",), "instant"),
    _c("short_term_debt", "balance", ("DebtCurrent", "ShortTermBorrowings", "CommercialPaper", "LongTermDebtCurrent"), "instant"),
    _c("long_term_debt", "balance", ("LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations", "LongTermDebt"), "instant"),
    _c("total_debt", "balance", ("LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities", "DebtAndCapitalLeaseObligations"), "instant"),
    _c("stockholders_equity", "balance", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), "instant"),
    _c("retained_earnings", "balance", ("RetainedEarningsAccumulatedDeficit", "RetainedEarningsAccumulatedDeficitAndOtherComprehensiveIncomeLoss"), "instant"),
    _c("operating_cash_flow", "cash_flow", ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")),
    _c("capital_expenditures", "cash_flow", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"), sign_mode="abs"),
    _c("investing_cash_flow", "cash_flow", ("NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations")),
    _c("financing_cash_flow", "cash_flow", ("NetCashProvidedByUsedInFinancingActivities", "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations")),
    _c("depreciation_and_amortization", "cash_flow", ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "Depreciation"), sign_mode="abs"),
    _c("stock_based_compensation", "cash_flow", ("ShareBasedCompensation", "AllocatedShareBasedCompensationExpense"), sign_mode="abs"),
    _c("dividends_paid", "cash_flow", ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock", "PaymentsOfOrdinaryDividends"), sign_mode="abs"),
    _c("share_repurchases", "cash_flow", ("PaymentsForRepurchaseOfCommonStock", "PaymentsForRepurchaseOfEquity"), sign_mode="abs"),
    _c("debt_issuance", "cash_flow", ("ProceedsFromIssuanceOfLongTermDebt", "ProceedsFromDebtNetOfIssuanceCosts", "ProceedsFromIssuanceOfDebt"), sign_mode="abs"),
    _c("debt_repayment", "cash_flow", ("RepaymentsOfLongTermDebt", "RepaymentsOfDebt", "RepaymentsOfLongTermDebtAndCapitalSecurities"), sign_mode="abs"),
)
NAMES = tuple(c.name for c in CONCEPTS)
TAGS = tuple(t for c in CONCEPTS for t in c.tags)
DERIVED = ("free_cash_flow", "net_debt", "working_capital", "invested_capital", "ebitda", "nopat")
#: Share-count concepts, best first.
SHARE_TAGS = ("EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding")

#: Factors with their ranking direction (true: higher is better).
FACTORS = {
    "revenue_growth": True,
    "operating_margin_change": True,
    "free_cash_flow": True,
    "fcf_yield": True,
    "price_to_earnings": False,
    "price_to_sales": False,
    "price_to_book": False,
    "debt_change": False,
    "roa": True,
    "accrual_ratio": False,
    "basic_quality_score": True,
}
#: Other names that users give factors and market metrics.
FACTOR_ALIASES = {
    "operating_margin": "operating_margin_change",
    "fcf": "free_cash_flow",
    "pe": "price_to_earnings",
    "p_e": "price_to_earnings",
    "ps": "price_to_sales",
    "p_s": "price_to_sales",
    "pb": "price_to_book",
    "p_b": "price_to_book",
    "accruals": "accrual_ratio",
    "quality": "basic_quality_score",
    "quality_score": "basic_quality_score",
}
#: Market metrics; beta has no direction and is never ranked.
METRICS = {"momentum_12_1": True, "volatility_1y": False, "beta_1y": None, "max_drawdown_1y": True}
METRIC_ALIASES = {"momentum": "momentum_12_1", "volatility": "volatility_1y", "beta": "beta_1y", "max_drawdown": "max_drawdown_1y", "drawdown": "max_drawdown_1y"}


def concept_dimension(spark: SparkSession) -> DataFrame:
    """(tag, concept, statement, period_type, expected_unit, sign_mode, priority), a row per tag."""
    rows = [(t, c.name, c.statement, c.period_type, c.unit, c.sign_mode, i) for c in CONCEPTS for i, t in enumerate(c.tags)]
    return spark.createDataFrame(rows, "tag string, canonical string, statement string, period_type string, expected_unit string, sign_mode string, priority int")

"""Fundamental and valuation factors over snapshots: columns first, long rows last.

A factor is a function from a frame of paired snapshots (``cur`` and ``pri``
structs of VALUE_TYPE columns, ``market_cap``, ``cap_reason``) to one result
struct; :data:`REGISTRY` names them, and users may add theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.functions import dims
from knowntime.functions.scratch import stored
from knowntime.operators.statements import KEYS, normalized_requests, snapshot_wide

RESULT = "struct<factor:string,value:double,valid:boolean,reason:string,inputs:map<string,double>,source_filings:array<string>,warnings:array<string>,higher_is_better:boolean>"
QUALITY_WEIGHTS = {"revenue_growth": 1.0, "operating_margin_change": 1.0, "free_cash_flow": 1.0, "debt_change": 1.0, "roa": 1.0, "accrual_ratio": 1.0}
DURATION_WARN_DAYS, DURATION_REJECT_DAYS = 5, 40


def cur(name: str, field: str = "value") -> Column:
    return F.col(f"cur.{name}.{field}")


def pri(name: str, field: str = "value") -> Column:
    return F.col(f"pri.{name}.{field}")


def _filings(*accessions: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*accessions))).cast("array<string>")


def _inputs(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def result(name: str, value: Column, faults: list[tuple[Column, str | Column, str | None]], inputs: Column, filings: Column, warnings: Column | None = None, higher: bool | None = None) -> Column:
    """A RESULT struct: the first fault whose condition holds makes the row invalid with its
    reason and warning; without one the value stands."""
    bad, why, word = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, reason, warning in reversed(faults):
        test = F.coalesce(test, F.lit(False))
        bad = bad | test
        why = F.when(test, F.lit(reason) if isinstance(reason, str) else reason).otherwise(why)
        word = F.when(test, F.lit(warning)).otherwise(word)
    more = warnings if warnings is not None else F.array().cast("array<string>")
    better = dims.FACTORS.get(name) if higher is None else higher
    return F.struct(
        F.lit(name).alias("factor"), F.when(~bad, value).alias("value"), (~bad & value.isNotNull()).alias("valid"), why.alias("reason"), inputs.alias("inputs"), filings.alias("source_filings"),
        F.array_distinct(F.array_compact(F.concat(F.array(word), more))).alias("warnings"), F.lit(better).cast("boolean").alias("higher_is_better"),
    ).cast(RESULT)


def revenue_growth() -> Column:
    now, then = cur("revenue"), pri("revenue")
    days = F.datediff(cur("revenue", "period_end"), cur("revenue", "period_start"))
    before = F.datediff(pri("revenue", "period_end"), pri("revenue", "period_start"))
    gap = F.abs(days - before)
    faults = [
        (now.isNull() | then.isNull(), "missing_revenue", None),
        (then == 0, "prior_revenue_zero", "zero_denominator"),
        (cur("revenue", "unit") != pri("revenue", "unit"), "revenue_units_differ", "unit_mismatch"),
        (gap > DURATION_REJECT_DAYS, F.concat(F.lit("durations_differ_by_days:"), gap.cast("string")), "duration_mismatch"),
    ]
    inputs = _inputs(revenue=now, prior_revenue=then, current_duration_days=days, prior_duration_days=before)
    warn = F.array(F.when(gap > DURATION_WARN_DAYS, F.lit("duration_mismatch_53_week")))
    return result("revenue_growth", F.try_divide(now, then) - 1.0, faults, inputs, _filings(cur("revenue", "accession_number"), pri("revenue", "accession_number")), warn)


def operating_margin_change() -> Column:
    margin, before = F.try_divide(cur("operating_income"), cur("revenue")), F.try_divide(pri("operating_income"), pri("revenue"))
    zero = F.coalesce((cur("revenue") == 0) | (pri("revenue") == 0), F.lit(False))
    faults = [(zero & (margin.isNull() | before.isNull()), "missing_inputs", "zero_denominator"), (margin.isNull() | before.isNull(), "missing_inputs", "missing_input")]
    inputs = _inputs(operating_income=cur("operating_income"), revenue=cur("revenue"), operating_margin=margin, prior_operating_income=pri("operating_income"), prior_revenue=pri("revenue"), prior_operating_margin=before)
    sources = [f(n, "accession_number") for f in (cur, pri) for n in ("operating_income", "revenue")]
    return result("operating_margin_change", margin - before, faults, inputs, _filings(*sources))


def free_cash_flow() -> Column:
    fcf = cur("free_cash_flow")
    inputs = _inputs(operating_cash_flow=cur("operating_cash_flow"), capital_expenditures=cur("capital_expenditures"), free_cash_flow=fcf)
    filings = _filings(cur("operating_cash_flow", "accession_number"), cur("capital_expenditures", "accession_number"))
    return result("free_cash_flow", fcf, [(fcf.isNull(), "missing_cash_flow_inputs", "missing_input")], inputs, filings)


def _cap_faults() -> list[tuple[Column, str | Column, str | None]]:
    cap = F.col("market_cap")
    reason = F.when(F.col("cap_reason").isNotNull(), F.concat(F.lit("market_cap_unavailable:"), F.col("cap_reason"))).otherwise("market_cap_unavailable")
    return [(cap.isNull(), reason, "market_cap_missing"), (F.isnan(cap) | (cap <= 0) | (cap == float("inf")), "market_cap_not_positive", "invalid_market_cap")]


def _ratio(name: str, concept: str, positive: str | None, annual_only: bool) -> Column:
    """market_cap / concept; reasons in order: annual only, missing, not positive, market cap."""
    amount = cur(concept)
    faults = [(F.col("fiscal_period") != "FY", "annual_period_required", "annual_period_required")] if annual_only else []
    faults += [(amount.isNull(), f"{concept}_unavailable", None), (amount <= 0, f"{concept}_not_positive", positive), *_cap_faults()]
    return result(name, F.try_divide(F.col("market_cap"), amount), faults, _inputs(market_cap=F.col("market_cap"), **{concept: amount}), _filings(cur(concept, "accession_number")), F.col("cap_warnings"))


def fcf_yield() -> Column:
    fcf = cur("free_cash_flow")
    filings = _filings(cur("free_cash_flow", "accession_number"), cur("operating_cash_flow", "accession_number"), cur("capital_expenditures", "accession_number"))
    return result("fcf_yield", F.try_divide(fcf, F.col("market_cap")), [(fcf.isNull(), "free_cash_flow_unavailable", None), *_cap_faults()], _inputs(free_cash_flow=fcf, market_cap=F.col("market_cap")), filings, F.col("cap_warnings"))


def price_to_earnings() -> Column:
    return _ratio("price_to_earnings", "net_income", "non_positive_earnings", True)


def price_to_sales() -> Column:
    return _ratio("price_to_sales", "revenue", "non_positive_revenue", True)


def price_to_book() -> Column:
    return _ratio("price_to_book", "stockholders_equity", "non_positive_equity", False)


def debt_change() -> Column:
    now, then = cur("total_debt"), pri("total_debt")
    inputs = _inputs(total_debt=now, prior_total_debt=then, debt_change_pct=F.try_divide(now - then, then))
    return result("debt_change", now - then, [(now.isNull() | then.isNull(), "missing_total_debt", None)], inputs, _filings(cur("total_debt", "accession_number"), pri("total_debt", "accession_number")))


def _over_assets(name: str, amount: Column, missing: Column, reason: str, fallback: str, inputs: dict[str, Column], sources: list[Column]) -> Column:
    end, begin = cur("total_assets"), pri("total_assets")
    average = F.coalesce((end + begin) / 2.0, end)
    faults = [(missing, reason, None), (end.isNull(), "missing_total_assets", None), (average == 0, "average_assets_zero", "zero_denominator")]
    inputs = _inputs(**inputs, ending_total_assets=end, beginning_total_assets=begin, average_total_assets=average)
    warn = F.array(F.when(begin.isNull() & end.isNotNull(), F.lit(fallback)))
    return result(name, F.try_divide(amount, average), faults, inputs, _filings(*sources, cur("total_assets", "accession_number"), pri("total_assets", "accession_number")), warn)


def roa() -> Column:
    ni = cur("net_income")
    return _over_assets("roa", ni, ni.isNull(), "missing_net_income", "roa_fallback_ending_assets", {"net_income": ni}, [cur("net_income", "accession_number")])


def accrual_ratio() -> Column:
    ni, ocf = cur("net_income"), cur("operating_cash_flow")
    return _over_assets(
        "accrual_ratio", ni - ocf, ni.isNull() | ocf.isNull(), "missing_net_income_or_cash_flow", "accrual_fallback_ending_assets", {"net_income": ni, "operating_cash_flow": ocf},
        [cur("net_income", "accession_number"), cur("operating_cash_flow", "accession_number")],
    )


REGISTRY: dict[str, Callable[[], Column]] = {
    f.__name__: f for f in (revenue_growth, operating_margin_change, free_cash_flow, fcf_yield, price_to_earnings, price_to_sales, price_to_book, debt_change, roa, accrual_ratio)
}


def _quality(weights: dict[str, float]) -> Column:
    """Share of the weight of available components that point the right way."""
    total = hits = F.lit(0.0)
    missing, inputs, filings = [], [], []
    for name, weight in weights.items():
        part = F.col(f"f.{name}")
        good = part["value"] > 0 if dims.FACTORS[name] else part["value"] < 0
        total = total + F.when(part["valid"], F.lit(weight)).otherwise(0.0)
        hits = hits + F.when(part["valid"] & good, F.lit(weight)).otherwise(0.0)
        missing.append(F.when(~part["valid"], F.lit(f"quality_missing:{name}")))
        inputs += [F.lit(name), part["value"]]
        filings.append(part["source_filings"])
    inputs += [F.lit("components_available"), total, F.lit("components_hit"), hits]
    return result("basic_quality_score", F.try_divide(hits, total), [(total == 0, "no_quality_components", None)], F.create_map(*inputs), F.array_distinct(F.flatten(F.array(*filings))), F.array(*missing))


_DEBT = ("total_debt", "short_term_debt", "long_term_debt")
_CASH_FLOW = ("operating_cash_flow", "capital_expenditures")
_MARGIN = ("operating_income", "revenue")
_ACCRUALS = ("net_income", "operating_cash_flow", "total_assets")
#: Reported concepts that a factor reads; a factor that is not here reads all.
NEEDS = {
    "revenue_growth": ("revenue",), "operating_margin_change": _MARGIN, "free_cash_flow": _CASH_FLOW, "fcf_yield": _CASH_FLOW, "price_to_earnings": ("net_income",), "price_to_sales": ("revenue",),
    "price_to_book": ("stockholders_equity",), "debt_change": _DEBT, "roa": ("net_income", "total_assets"), "accrual_ratio": _ACCRUALS, "basic_quality_score": (*_MARGIN, *_CASH_FLOW, *_DEBT, *_ACCRUALS),
}


def concepts_of(factors: Iterable[str]) -> list[str]:
    """The reported concepts behind factors, in statement order."""
    read = {c for f in factors for c in NEEDS.get(f, dims.NAMES)}
    return [n for n in dims.NAMES if n in read]


#: Fields of a value that factors read.
READ_FIELDS = ("value", "unit", "period_start", "period_end", "accession_number", "available_at")


def paired_snapshots(facts: DataFrame, requests: DataFrame, concepts: Sequence[str] | None = None) -> DataFrame:
    """KEYS, cur, pri: each request's snapshot and that of the same period a year before,
    from one pass over the facts; written once, as both sides of the pairing read it. With
    ``concepts`` the snapshots hold only those, and free cash flow, with ``READ_FIELDS``."""
    asked = normalized_requests(requests)
    before = asked.withColumn("fiscal_year", F.col("fiscal_year") - 1)
    wide = snapshot_wide(facts, asked.unionByName(before), concepts)
    if concepts is None or len(concepts) == len(dims.NAMES):
        kept = [F.col(c) for c in wide.columns if c not in KEYS and c != "replaced"]
    else:
        kept = [F.struct(*[F.col(f"{c}.{f}").alias(f) for f in READ_FIELDS]).alias(c) for c in (*concepts, "free_cash_flow")]
    packed = stored(wide.select(*KEYS, F.struct(*kept).alias("cur")))
    prior = packed.select("cik", (F.col("fiscal_year") + 1).alias("fiscal_year"), "fiscal_period", "as_of", F.col("cur").alias("pri"))
    return asked.join(packed, KEYS).join(prior, KEYS, "left")


def factor_results(facts: DataFrame, requests: DataFrame, caps: DataFrame | None = None, factors: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """KEYS, RESULT fields and evidence_at (latest availability of the values read, those of the
    year before included): a row per request and factor. Facts of concepts that no factor asked for reads are left in the scan.

    ``caps`` is (cik, as_of, market_cap double, currency, cap_reason, cap_warnings,
    manual boolean): a manual cap is labelled and used as given; a stored one in
    another currency than USD is unusable.
    """
    wanted = factors or [*REGISTRY, "basic_quality_score"]
    weights = weights or QUALITY_WEIGHTS
    concepts = concepts_of([*wanted, *(weights if "basic_quality_score" in wanted else ())])
    pairs = paired_snapshots(facts, requests, concepts)
    if caps is None:
        pairs = pairs.withColumns({"market_cap": F.lit(None).cast("double"), "cap_reason": F.lit(None).cast("string"), "cap_warnings": F.array().cast("array<string>")})
    else:
        foreign = ~F.col("manual") & (F.coalesce(F.upper(F.trim("currency")), F.lit("")) != "") & (F.upper(F.trim("currency")) != "USD")
        usable = caps.select(
            "cik", "as_of", F.when(~foreign, F.col("market_cap")).alias("market_cap"), F.when(foreign, F.lit("currency_mismatch")).otherwise(F.col("cap_reason")).alias("cap_reason"),
            F.array_compact(F.concat(F.coalesce("cap_warnings", F.array().cast("array<string>")), F.array(F.when(F.col("manual"), F.lit("manual_market_cap")), F.when(foreign, F.lit("currency_mismatch"))))).alias("cap_warnings"),
        )
        pairs = pairs.join(usable, ["cik", "as_of"], "left").withColumn("cap_warnings", F.coalesce("cap_warnings", F.array().cast("array<string>")))
    evidence = F.array_max(F.array(*[side(n, "available_at") for side in (cur, pri) for n in concepts]))
    parts = set(weights) if "basic_quality_score" in wanted else set()
    rows = pairs.select(*KEYS, evidence.alias("evidence_at"), F.struct(*[make().alias(name) for name, make in REGISTRY.items() if name in parts or name in wanted]).alias("f"))
    rows = rows.withColumn("q", _quality(weights)) if parts else rows
    picked = [F.col("q") if name == "basic_quality_score" else F.col(f"f.{name}") for name in wanted]
    return rows.select(*KEYS, "evidence_at", F.explode(F.array(*picked)).alias("r")).select(*KEYS, "r.*", "evidence_at")

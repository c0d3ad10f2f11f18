"""Canonical statements: version selection, standalone quarters, components, derived values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowntime.functions import dims
from knowntime.functions.scalars import apply_sign, duration_days, looks_ytd, prior_quarter

KEYS = ["cik", "fiscal_year", "fiscal_period", "as_of"]
#: One value of a snapshot with its provenance.
VALUE_TYPE = (
    "struct<value:double,unit:string,source_concept:string,taxonomy:string,accession_number:string,form:string,"
    "period_start:date,period_end:date,filing_date:date,acceptance_datetime:timestamp,available_at:timestamp,fact_id:string,"
    "mapping_priority:int,is_restated:boolean,reported_value:double,sign_mode:string,normalized_from_sign:boolean,"
    "is_derived:boolean,derivation:string,derivation_accessions:array<string>,missing_reason:string,warnings:array<string>>"
)
_FIELDS = [f.split(":", 1)[0] for f in VALUE_TYPE[len("struct<") : -1].replace("array<string>", "array").split(",")]
_TYPES = [f.split(":", 1)[1] for f in VALUE_TYPE[len("struct<") : -1].split(",")]
FACT_COLUMNS = ["cik", "taxonomy", "concept", "unit", "value", "start_date", "end_date", "filing_date", "acceptance_datetime", "available_at", "accession_number", "form", "fiscal_year", "fiscal_period", "fact_id"]
_COMPONENT_TAGS = ("ShortTermBorrowings", "CommercialPaper", "LongTermDebtCurrent")


_blank: dict[int, dict[str, Column]] = {}


def value_struct(**given: Column) -> Column:
    """A VALUE_TYPE struct; fields not given are null, flags false, warnings empty."""
    known = _blank.setdefault(id(SparkContext._gateway), {})  # literals of one JVM, made once: plans hold dozens of structs
    if not known:
        none = {"is_derived": F.lit(False), "is_restated": F.lit(False), "normalized_from_sign": F.lit(False), "warnings": F.array(), "derivation_accessions": F.array()}
        known |= {n: none.get(n, F.lit(None)).cast(t).alias(n) for n, t in zip(_FIELDS, _TYPES)}
    return F.struct(*[given[n].cast(t).alias(n) if n in given else known[n] for n, t in zip(_FIELDS, _TYPES)])


def _words(*texts: str | Column) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]).cast("array<string>")


def _mapped_facts(facts: DataFrame, names: Sequence[str] = dims.NAMES) -> DataFrame:
    """Facts with a mapped tag and the expected unit, with what scoring needs as columns.

    The tag list is a literal, so it reaches the Parquet scan as a filter.
    """
    tags = [t for c in dims.CONCEPTS if c.name in names for t in c.tags]
    dim = dims.concept_dimension(facts.sparkSession).select(F.col("tag").alias("concept"), "canonical", "period_type", "expected_unit", "sign_mode", "priority")
    period = F.upper(F.trim("fiscal_period"))
    form = F.upper(F.coalesce("form", F.lit("")))
    amended = form.endswith("/A")
    base = F.when(amended, F.expr("substring(upper(form), 1, length(form) - 2)")).otherwise(form)
    days = duration_days(F.col("start_date"), F.col("end_date"))
    annual = period == "FY"
    wanted = F.when(annual, "10-K").otherwise("10-Q")
    span = (
        F.when(F.col("period_type") == "instant", 1)
        .when(days.isNull(), 0)
        .when(annual, F.when(days.between(340, 380), 2).when(days.between(300, 420), 1).otherwise(0))
        .otherwise(F.when(days.between(70, 110), 2).when(days <= 130, 1).otherwise(0))
    )
    return (
        facts.select(*FACT_COLUMNS)
        .where(F.col("concept").isin(*tags))
        .join(F.broadcast(dim.where(F.col("canonical").isin(*names))), "concept")
        .where(F.lower(F.trim("unit")) == F.lower("expected_unit"))
        .withColumn("fiscal_period", period)
        .withColumn("is_ytd", looks_ytd(days, period))
        .withColumn("type_ok", F.when(F.col("period_type") == "instant", F.col("start_date").isNull() | (F.col("start_date") == F.col("end_date"))).otherwise(F.col("end_date").isNotNull()))
        .withColumn("normalized", apply_sign(F.col("value"), F.col("sign_mode")))
        .withColumn("form_score", F.when(base == wanted, 2).when(F.startswith(base, wanted), 1).otherwise(0))
        .withColumn("span_score", span)
        .withColumn("end_key", F.coalesce("end_date", F.lit("0001-01-01").cast("date")))
        .withColumn("amended", amended.cast("int"))
    )


def _score(span: Column) -> Column:
    """What decides between versions, best first; not-YTD is constant within a use."""
    return F.struct("form_score", span.alias("span"), "end_key", "available_at", (-F.col("priority")).alias("p"), "amended")


def _fact() -> Column:
    return F.struct("normalized", "value", "unit", "concept", "taxonomy", "accession_number", "form", "start_date", "end_date", "filing_date", "acceptance_datetime", "available_at", "fact_id", "priority", "sign_mode", "amended")


def _selected(fact: Column, warnings: Column) -> Column:
    changed = fact["normalized"] != fact["value"]
    return value_struct(
        value=fact["normalized"], unit=fact["unit"], source_concept=fact["concept"], taxonomy=fact["taxonomy"], accession_number=fact["accession_number"], form=fact["form"],
        period_start=fact["start_date"], period_end=fact["end_date"], filing_date=fact["filing_date"], acceptance_datetime=fact["acceptance_datetime"], available_at=fact["available_at"],
        fact_id=fact["fact_id"], mapping_priority=fact["priority"], is_restated=fact["amended"] == 1, reported_value=fact["value"], sign_mode=fact["sign_mode"], normalized_from_sign=changed, warnings=warnings,
    )


#: A key's facts are swept in as many parts, so a hot issuer and period is no single task.
SWEEP_PARTS = 8
_PERIOD = ["cik", "fiscal_year", "fiscal_period"]


def _slotted(facts: DataFrame, requests: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mapped facts of the requested periods, each once, with the first ``as_of`` that knows it.

    Facts and decision times of a period lie on one time axis, and the next decision time is
    carried back over the facts before it; facts that no request knows drop out. A fact also
    enters the next quarter (``own`` false) if that quarter may be derived from it.
    """
    rows = _mapped_facts(facts, names).where("available_at is not null").withColumn("alone", F.col("type_ok") & ~F.col("is_ytd"))
    period = F.col("fiscal_period")
    after = F.when((period == "Q1") & F.col("alone"), "Q2").when((period == "Q2") & F.col("is_ytd"), "Q3")
    roles = F.array_compact(F.array(F.struct(period.alias("p"), F.lit(True).alias("own")), F.when(after.isNotNull(), F.struct(after.alias("p"), F.lit(False).alias("own")))))
    rows = rows.withColumn("role", F.explode(roles)).withColumns({"fiscal_period": F.col("role.p"), "own": F.col("role.own")}).drop("role")
    rows = rows.join(requests.select(*_PERIOD).distinct(), _PERIOD, "left_semi")
    part = F.pmod(F.xxhash64("accession_number", "fact_id", "concept"), F.lit(SWEEP_PARTS)).cast("int")
    right = rows.select(*_PERIOD, part.alias("part"), F.col("available_at").alias("time"), F.lit(1).alias("side"), F.lit(None).cast("timestamp").alias("as_of"), F.struct(*[c for c in rows.columns if c not in _PERIOD]).alias("f"))
    left = requests.where("as_of is not null").select(*_PERIOD, F.explode(F.array(*map(F.lit, range(SWEEP_PARTS)))).alias("part"), F.col("as_of").alias("time"), F.lit(0).alias("side"), "as_of", F.lit(None).alias("f"))
    w = Window.partitionBy(*_PERIOD, "part").orderBy(F.desc("time"), "side").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right).withColumn("as_of", F.last("as_of", ignorenulls=True).over(w))
    return swept.where("side = 1 and as_of is not null").select(*KEYS, "f.*")


def _states(facts: DataFrame, requests: DataFrame, names: Sequence[str] = dims.NAMES) -> DataFrame:
    """KEYS, canonical, best, hi, lo, ytd, prior, candidates, part0..2: what each concept's facts
    known by then make, where the ``as_of`` knows more than the one before it.

    All are maxima, so a slot's facts combine before the shuffle, and slots combine by a
    running maximum: a fact is read once, whatever the number of decision times.
    """
    rows = _slotted(facts, requests, names)
    own, alone = F.col("own"), F.col("alone")
    tie = [F.coalesce("accession_number", F.lit("")).alias("a"), F.col("concept").alias("c"), F.coalesce("fact_id", F.lit("")).alias("f")]
    ranked = F.struct(F.struct(_score(F.when(F.col("is_ytd"), 1).otherwise(F.col("span_score"))).alias("s"), *tie).alias("o"), _fact().alias("v"))
    score, rounded = _score(F.col("span_score")), F.round("normalized", 6)
    instant = F.col("start_date").isNull() | (F.col("start_date") == F.col("end_date"))
    newest = F.struct(F.struct("available_at", "end_key", *tie).alias("o"), _fact().alias("v"))
    maxima = {
        "best": F.when(own & alone, ranked), "ytd": F.when(own & F.col("is_ytd"), ranked), "prior": F.when(~own, ranked),
        "hi": F.when(own & alone, F.struct(score.alias("s"), rounded.alias("v"))), "lo": F.when(own & alone, F.struct(score.alias("s"), (-rounded).alias("v"))),
        **{f"part{i}": F.when(own & instant & (F.col("concept") == t), newest) for i, t in enumerate(_COMPONENT_TAGS) if "short_term_debt" in names},
    }
    slots = rows.groupBy(*KEYS, "canonical").agg(*[F.max(c).alias(k) for k, c in maxima.items()], F.count_if(own & F.col("type_ok")).alias("candidates"))
    w = Window.partitionBy(*_PERIOD, "canonical").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    found = slots.withColumns({**{k: F.max(k).over(w) for k in maxima}, "candidates": F.sum("candidates").over(w)})
    facts_of = [F.col(f"{k}.v").alias(k) for k in maxima if k not in ("hi", "lo")]
    none = [F.lit(None).cast(rows.select(_fact().alias("v")).schema["v"].dataType).alias(f"part{i}") for i in range(len(_COMPONENT_TAGS)) if "short_term_debt" not in names]
    return found.select(*KEYS, "canonical", "hi", "lo", "candidates", *facts_of, *none)


def normalized_requests(requests: DataFrame) -> DataFrame:
    return requests.select("cik", "fiscal_year", F.upper(F.trim("fiscal_period")).alias("fiscal_period"), F.col("as_of").cast("timestamp").alias("as_of")).distinct()


def wide_values(facts: DataFrame, requests: DataFrame, names: Sequence[str] = dims.NAMES) -> DataFrame:
    """(cik, fiscal_year, fiscal_period, as_of) -> KEYS, a VALUE_TYPE column per canonical concept of
    ``names``, part0..2: a row for every request.

    Selection takes the best version known; quarters whose only facts are cumulative are
    derived from them (Q2 = six months - Q1, Q3 = nine - six months); what is missing says
    why. A concept's value is worked out where it changes and carried to the decision times
    after it.
    """
    requests = normalized_requests(requests)
    rows = _states(facts, requests, names)
    units = F.create_map(*[F.lit(x) for c in dims.CONCEPTS for x in (c.name, c.unit)])
    flows = [c.name for c in dims.CONCEPTS if c.statement != "balance"]
    best, ytd, prior = F.col("best"), F.col("ytd"), F.col("prior")

    conflict = F.col("hi.v") != -F.col("lo.v")
    changed = (best["normalized"] != best["value"]) & (best["sign_mode"] != "identity")
    warnings = F.array_compact(
        _words(
            F.when(conflict, F.lit("conflicting_concepts")),
            F.when(conflict, F.concat(F.lit("conflict_resolved_deterministically:"), best["concept"], F.lit(":"), F.coalesce(best["accession_number"], F.lit("None")))),
            F.when(best["amended"] == 1, F.lit("restated_value")),
            F.when(changed, F.concat(F.lit("sign_normalized:"), best["sign_mode"])),
        )
    )
    gap = F.abs(F.datediff(ytd["start_date"], prior["start_date"]))
    quarter = F.col("fiscal_period")
    made = value_struct(
        value=ytd["normalized"] - prior["normalized"], unit=ytd["unit"], source_concept=ytd["concept"], taxonomy=ytd["taxonomy"], accession_number=ytd["accession_number"], form=ytd["form"],
        period_start=prior["end_date"], period_end=ytd["end_date"], filing_date=ytd["filing_date"], acceptance_datetime=ytd["acceptance_datetime"], available_at=F.greatest(ytd["available_at"], prior["available_at"]),
        is_derived=F.lit(True), derivation=F.when(quarter == "Q2", "Q2_YTD - Q1").otherwise("Q3_YTD - Q2_YTD"),
        derivation_accessions=F.array_distinct(F.array_compact(_words(ytd["accession_number"], prior["accession_number"]))), warnings=_words("derived_quarterly_from_ytd"),
    )
    unit = F.element_at(units, F.col("canonical"))
    reject = lambda reason, *words: value_struct(missing_reason=F.lit(reason) if isinstance(reason, str) else reason, unit=unit, warnings=_words(*words))
    derived = (
        F.when(ytd["unit"] != prior["unit"], reject("unit_mismatch", "unit_mismatch"))
        .when(prior["end_date"] > ytd["end_date"], reject("period_boundaries_differ", "period_mismatch"))
        .when(gap > 7, reject(F.concat(F.lit("ytd_starts_differ_by_days:"), gap.cast("string")), "period_mismatch", "ytd_start_mismatch"))
        .otherwise(made)
    )
    v = (
        F.when(best.isNotNull(), _selected(best, warnings))
        .when(quarter.isin("Q2", "Q3") & F.col("canonical").isin(*flows) & ytd.isNotNull() & prior.isNotNull(), derived)
        .when(F.coalesce(F.col("candidates"), F.lit(0)) > 0, reject("only_cumulative_facts", "ytd_only", "missing_value"))
        .otherwise(reject("no_fact_known", "missing_value"))
    )
    parts = [f"part{i}" for i in range(len(_COMPONENT_TAGS))]
    made_at = rows.select(*KEYS, "canonical", v.alias("v"), *parts)
    asked = requests.select(*KEYS, *[F.lit(None).cast(made_at.schema[c].dataType).alias(c) for c in ("canonical", "v", *parts)])
    wide = made_at.unionByName(asked).groupBy(*KEYS).agg(
        *[F.first(F.when(F.col("canonical") == n, F.col("v")), ignorenulls=True).alias(n) for n in names],
        *[F.first(F.when(F.col("canonical") == "short_term_debt", F.col(p)), ignorenulls=True).alias(p) for p in parts],
    )
    w = Window.partitionBy(*_PERIOD).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    carried = wide.select(*KEYS, *[F.last(n, ignorenulls=True).over(w).alias(n) for n in (*names, *parts)])
    own_unit = {c.name: c.unit for c in dims.CONCEPTS if c.name in names}
    unknown = {u: value_struct(missing_reason=F.lit("no_fact_known"), unit=F.lit(u), warnings=_words("missing_value")) for u in set(own_unit.values())}
    return carried.withColumns({n: F.coalesce(n, unknown[own_unit[n]]) for n in names})


def canonical_values(facts: DataFrame, requests: DataFrame, names: Sequence[str] = dims.NAMES) -> DataFrame:
    """KEYS, concept, v (VALUE_TYPE): :func:`wide_values` with a row for every request and concept."""
    wide = wide_values(facts, requests, names)
    return wide.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(n).alias("concept"), F.col(n).alias("v")) for n in names])).alias("x")).select(*KEYS, "x.*")


def _sum(*values: Column) -> Column:
    """Sum of the values present; null if none is."""
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)))


def _latest(*values: Column) -> Column:
    return F.greatest(*[v["available_at"] for v in values])


def _or_missing(made: Column, ok: Column, reason: str | Column) -> Column:
    return F.when(ok, made).otherwise(value_struct(missing_reason=F.lit(reason) if isinstance(reason, str) else reason))


def snapshot_wide(facts: DataFrame, requests: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """KEYS and one VALUE_TYPE column per canonical and derived concept, a row per request.
    With ``names`` only those reported concepts are read; the others are null.

    Components fill gross profit, short-term debt (unless the complete tag was
    used) and total debt; ``replaced`` keeps warnings of values they replace.
    """
    read = [n for n in dims.NAMES if names is None or n in names]
    wide = wide_values(facts, requests, read)
    wide = wide.withColumns({n: F.lit(None).cast(VALUE_TYPE) for n in dims.NAMES if n not in read})
    c = F.col
    replaced = F.flatten(F.array(*[c(n)["warnings"] for n in read]))
    rev, cost = c("revenue"), c("cost_of_revenue")
    gross = value_struct(
        value=rev["value"] - cost["value"], unit=rev["unit"], accession_number=rev["accession_number"], period_start=rev["period_start"], period_end=rev["period_end"], available_at=_latest(rev, cost),
        is_derived=F.lit(True), derivation=F.lit("revenue - cost_of_revenue"), derivation_accessions=F.array_distinct(F.array_compact(_words(rev["accession_number"], cost["accession_number"]))), warnings=_words("derived_from_components"),
    )
    loans, ltd = F.coalesce("part0", "part1"), c("part2")
    short = value_struct(
        value=_sum(loans["value"], ltd["value"]), unit=F.lit("USD"), accession_number=F.coalesce(loans["accession_number"], ltd["accession_number"]), period_end=F.coalesce(ltd["end_date"], loans["end_date"]),
        available_at=F.greatest(loans["available_at"], ltd["available_at"]), is_derived=F.lit(True), derivation=F.lit("sum_nonoverlapping_current_debt_components"),
        derivation_accessions=F.array_distinct(F.array_compact(_words(loans["accession_number"], ltd["accession_number"]))), warnings=_words("derived_from_components"),
    )
    wide = (
        wide.withColumn("replaced", replaced)
        .withColumn("gross_profit", F.when(c("gross_profit")["value"].isNull() & rev["value"].isNotNull() & cost["value"].isNotNull() & (rev["unit"] == cost["unit"]), gross).otherwise(c("gross_profit")))
        .withColumn(
            "short_term_debt",
            F.when((c("short_term_debt")["value"].isNull() | (c("short_term_debt")["source_concept"] != "DebtCurrent")) & F.coalesce(loans["value"], ltd["value"]).isNotNull(), short).otherwise(c("short_term_debt")),
        )
    )
    st, lt = c("short_term_debt"), c("long_term_debt")
    total = value_struct(
        value=_sum(st["value"], lt["value"]), unit=F.lit("USD"), accession_number=F.coalesce(F.when(st["value"].isNotNull(), st["accession_number"]), F.when(lt["value"].isNotNull(), lt["accession_number"])), available_at=_latest(st, lt),
        is_derived=F.lit(True), derivation=F.lit("short_term_debt + long_term_debt"), derivation_accessions=F.array_distinct(F.array_compact(_words(st["accession_number"], lt["accession_number"]))), warnings=_words("derived_from_components"),
    )
    wide = wide.withColumn("total_debt", F.when(c("total_debt")["value"].isNull() & F.coalesce(st["value"], lt["value"]).isNotNull(), total).otherwise(c("total_debt")))

    def formula(text: str, value: Column, *inputs: Column, unit: Column | None = None) -> Column:
        return value_struct(
            value=value, unit=unit if unit is not None else F.lit("USD"), available_at=_latest(*inputs), accession_number=inputs[0]["accession_number"], is_derived=F.lit(True), derivation=F.lit(text),
            derivation_accessions=F.array_distinct(F.array_compact(_words(*[i["accession_number"] for i in inputs]))),
        )

    ocf, capex = c("operating_cash_flow"), c("capital_expenditures")
    cash, sti, debt, equity = c("cash_and_equivalents"), c("short_term_investments"), c("total_debt"), c("stockholders_equity")
    ca, cl, op, da, tax = c("total_current_assets"), c("total_current_liabilities"), c("operating_income"), c("depreciation_and_amortization"), c("income_tax_expense")
    liquid = _sum(cash["value"], sti["value"])
    both = lambda a, b: a["value"].isNotNull() & b["value"].isNotNull()
    rate = F.try_divide(tax["value"], op["value"])
    derived = {
        "free_cash_flow": _or_missing(formula("operating_cash_flow - capital_expenditures", ocf["value"] - capex["value"], ocf, capex), both(ocf, capex) & (ocf["unit"] == capex["unit"]), F.when(both(ocf, capex), "unit_mismatch").otherwise("requires_inputs")),
        "net_debt": _or_missing(formula("total_debt - cash_and_equivalents - short_term_investments", debt["value"] - liquid, debt, cash, sti), debt["value"].isNotNull() & liquid.isNotNull(), "requires_inputs"),
        "working_capital": _or_missing(formula("total_current_assets - total_current_liabilities", ca["value"] - cl["value"], ca, cl), both(ca, cl) & (ca["unit"] == cl["unit"]), F.when(both(ca, cl), "unit_mismatch").otherwise("requires_inputs")),
        "invested_capital": _or_missing(formula("total_debt + stockholders_equity - cash - short_term_investments", debt["value"] + equity["value"] - F.coalesce(cash["value"], F.lit(0.0)) - F.coalesce(sti["value"], F.lit(0.0)), debt, equity, cash, sti), both(debt, equity), "requires_inputs"),
        "ebitda": _or_missing(formula("operating_income + depreciation_and_amortization", op["value"] + da["value"], op, da), both(op, da), "requires_inputs"),
        "nopat": _or_missing(
            formula("operating_income * (1 - income_tax_expense/operating_income)", op["value"] * (1 - rate), op, tax),
            both(op, tax) & (op["value"] > 0) & rate.between(0.0, 1.0),
            F.when(~both(op, tax), "requires_inputs").when(op["value"] <= 0, "operating_income_not_positive").otherwise("tax_rate_outside_0_1"),
        ),
    }
    return wide.select(*KEYS, *dims.NAMES, *[v.alias(k) for k, v in derived.items()], "replaced")


def snapshots(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """KEYS, concept and the VALUE_TYPE fields: a row per request and concept, derived ones included."""
    wide = snapshot_wide(facts, requests)
    names = [*dims.NAMES, *dims.DERIVED]
    return wide.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(n).alias("concept"), F.col(n).alias("v")) for n in names])).alias("x")).select(*KEYS, "x.concept", "x.v.*")


def snapshot_summary(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """KEYS, period_start, period_end, source_accessions, missing, warnings, evidence_at."""
    wide = snapshot_wide(facts, requests)
    names = [*dims.NAMES, *dims.DERIVED]
    present = F.filter(F.array(*[F.col(n) for n in names]), lambda v: v["value"].isNotNull())
    days = lambda v: F.datediff(v["period_end"], v["period_start"])
    single = F.filter("__p", lambda v: v["period_end"].isNotNull() & F.coalesce(days(v) <= 420, F.lit(True)))
    pool = F.when(F.size("__s") > 0, F.col("__s")).otherwise(F.col("__p"))
    missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n)["value"].isNull(), F.lit(n)) for n in names])))
    out = wide.withColumn("__p", present).withColumn("__s", single).withColumn("__pool", pool)
    return out.select(
        *KEYS,
        F.array_min(F.transform("__pool", lambda v: v["period_start"])).alias("period_start"),
        F.array_max(F.transform("__pool", lambda v: v["period_end"])).alias("period_end"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("__p", lambda v: v["accession_number"])))).alias("source_accessions"),
        missing.alias("missing"),
        F.array_distinct(F.concat("replaced", F.flatten(F.transform("__p", lambda v: v["warnings"])))).alias("warnings"),
        F.array_max(F.transform("__p", lambda v: v["available_at"])).alias("evidence_at"),
    )


def known_intervals(facts: DataFrame) -> DataFrame:
    """Best standalone version per (cik, concept, fiscal period) as validity intervals.

    (cik, canonical, fiscal_year, fiscal_period, known_from, known_to, value, unit,
    accession_number, form, end_date). ``available_at`` is part of the score, so the running
    maximum at an instant is the selection then, and a lookup at many decision
    times matches one row: known_from <= as_of < known_to (null: open).
    """
    usable = _mapped_facts(facts).where("type_ok and not is_ytd")
    tie = F.struct(_score(F.col("span_score")).alias("s"), F.coalesce("accession_number", F.lit("")).alias("a"), F.col("concept").alias("c"), F.coalesce("fact_id", F.lit("")).alias("f"))
    key = ["cik", "canonical", "fiscal_year", "fiscal_period"]
    at_once = usable.groupBy(*key, "available_at").agg(F.max(F.struct(tie.alias("o"), _fact().alias("v"))).alias("top"))
    w = Window.partitionBy(*key).orderBy("available_at")
    running = at_once.withColumn("best", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changes = running.withColumn("was", F.lag("best.o").over(w)).where("was is null or not (was <=> best.o)")
    return changes.select(
        *key, F.col("available_at").alias("known_from"), F.lead("available_at").over(w).alias("known_to"), F.col("best.v.normalized").alias("value"), F.col("best.v.unit").alias("unit"), F.col("best.v.accession_number").alias("accession_number"), F.col("best.v.form").alias("form"), F.col("best.v.end_date").alias("end_date")
    )


def values_at(intervals: DataFrame, requests: DataFrame) -> DataFrame:
    """(cik, fiscal_year, fiscal_period, as_of) -> the interval rows in force then."""
    keys = ["cik", "fiscal_year", "fiscal_period"]
    open_ = F.col("known_to").isNull() | (F.col("as_of") < F.col("known_to"))
    return normalized_requests(requests).join(intervals, keys).where((F.col("known_from") <= F.col("as_of")) & open_)

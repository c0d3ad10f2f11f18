"""Backtests over a table of requests, as set operations.

Weights change at rebalances only, so between two of them the value of a held
portfolio is a weighted sum of price ratios, drifted weights follow from it, and
the value path is a running product over segments. Nothing loops over sessions,
and thousands of runs are one job keyed by ``run_id``.

Timing: a decision uses what was known when its session's bar became available;
old weights earn up to the next session, which is marked before the transition
and its cost apply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowntime.functions import dims
from knowntime.functions.scalars import canonical_symbol, canonical_universe, period_label, resolve_alias
from knowntime.functions.scratch import stored
from knowntime.operators.factors import factor_results
from knowntime.operators.market import CLOSES, LOOKBACK_DAYS, PER_YEAR
from knowntime.operators.pit import in_bands, issuers_of_symbols, latest_annual
from knowntime.operators.ranking import exact_top_n

TOLERANCE = 1e-8
STANDING_WARNINGS = ("adjusted_history_may_embed_later_corporate_actions", "universe_may_carry_survivorship_bias")


def calendar_sessions(bars: DataFrame) -> DataFrame:
    """(symbol, d, at, next_d, next_at, twice) from a reference symbol's bars."""
    days = bars.groupBy("symbol", F.col("trading_date").alias("d")).agg(F.max("available_at").alias("at"), (F.count("*") > 1).alias("twice"))
    w = Window.partitionBy("symbol").orderBy("d")
    return days.withColumns({"next_d": F.lead("d").over(w), "next_at": F.lead("at").over(w)})


def decision_pairs(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(run_id, decision_date, decision_at, effective_date, effective_at, reason).

    Last session of each month, or of March, June, September and December, with
    its next session; pairs that end after the range are left out. Explicit dates
    each give a row, with a reason where they cannot be executed.
    """
    runs = requests.select("run_id", "schedule", "start_date", "end_date", "explicit_dates", F.col("calendar_symbol").alias("symbol"))
    inside = runs.where("schedule <> 'explicit'").join(sessions, "symbol").where((F.col("d") >= F.col("start_date")) & (F.col("d") <= F.col("end_date")))
    inside = inside.where((F.col("schedule") == "monthly") | F.month("d").isin(3, 6, 9, 12))
    regular = (
        inside.groupBy("run_id", F.trunc("d", "month").alias("bucket"), "end_date").agg(F.max(F.struct("d", "at", "next_d", "next_at")).alias("s"))
        .where(F.col("s.next_d") <= F.col("end_date"))
        .select("run_id", F.col("s.d").alias("decision_date"), F.col("s.at").alias("decision_at"), F.col("s.next_d").alias("effective_date"), F.col("s.next_at").alias("effective_at"), F.lit(None).cast("string").alias("reason"))
    )
    asked = runs.where("schedule = 'explicit'").withColumn("d", F.explode(F.array_distinct("explicit_dates")))
    found = asked.join(sessions, ["symbol", "d"], "left")
    reason = (
        F.when((F.col("d") < F.col("start_date")) | (F.col("d") > F.col("end_date")), "explicit_date_out_of_range").when(F.col("at").isNull() | F.col("next_d").isNull(), "calendar_missing")
        .when(F.col("next_d") > F.col("end_date"), "effective_session_out_of_range")
    )
    return regular.unionByName(found.select("run_id", F.col("d").alias("decision_date"), F.col("at").alias("decision_at"), F.col("next_d").alias("effective_date"), F.col("next_at").alias("effective_at"), reason.alias("reason")))


def aligned_returns(selected: DataFrame, bars: DataFrame, closes: int = CLOSES, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(run_id, decision_date, decision_at, symbol) -> returns over the last ``closes`` common dates.

    (run_id, decision_date, symbol, d, ret, dates, usable, available_at): ``usable`` is false for a group
    with a doubled date or a close that is not positive; ``dates`` counts common ones.
    """
    key = ["run_id", "decision_date"]
    asked = selected.select(*key, "decision_at", "symbol", F.date_sub("decision_date", lookback).alias("__first"))
    closed = bars.select("symbol", F.col("trading_date").alias("d"), F.col("close").cast("double").alias("close"), "available_at")
    known = in_bands(asked, closed, ["symbol"], "__first", "decision_date", "d", max(1, lookback // 2)).where(F.col("available_at") <= F.col("decision_at")).drop("__first")
    names = selected.groupBy(*key).agg(F.count("*").alias("names"))
    dates = known.groupBy(*key, "d").agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("have"), F.bool_and(F.col("close") > 0).alias("fine"))
    dates = dates.join(names, key).withColumn("all", F.col("have") == F.col("names"))
    w = Window.partitionBy(*key)
    dates = dates.withColumn("usable", F.bool_and((F.col("rows") == F.col("have")) & F.col("fine")).over(w)).where("all")
    dates = dates.withColumn("rn", F.row_number().over(w.orderBy(F.desc("d")))).withColumn("dates", F.count("*").over(w)).where(F.col("rn") <= closes)
    rows = known.join(dates.select(*key, "d", "dates", "usable"), [*key, "d"])
    before = F.lag("close").over(Window.partitionBy(*key, "symbol").orderBy("d"))
    return rows.withColumn("ret", F.try_divide(F.col("close"), before) - 1.0).where("ret is not null or not usable").select(*key, "symbol", "d", "ret", "dates", "usable", "available_at")


def equal_weights(selected: DataFrame) -> DataFrame:
    return selected.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("run_id", "decision_date")))


def inverse_volatility_weights(returns: DataFrame) -> DataFrame:
    """(run_id, decision_date, symbol, weight); a zero volatility leaves the whole group null."""
    sd = returns.groupBy("run_id", "decision_date", "symbol").agg(F.stddev_samp("ret").alias("sd"))
    w = Window.partitionBy("run_id", "decision_date")
    ok = F.bool_and(F.col("sd") > 0).over(w)
    inverse = F.try_divide(F.lit(1.0), F.col("sd"))
    return sd.select("run_id", "decision_date", "symbol", F.when(ok, inverse / F.sum(inverse).over(w)).alias("weight"))


def shared_windows(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run_id, decision_date, decision_at, symbol) -> (groups, members): decisions of the same names at
    the same time are one group, whatever runs they belong to.

    groups are rows like ``selected`` with the group's digest as run_id; members (run_id,
    decision_date, group) lead back. The names of a decision meet in one row, top_n of them.
    """
    key = ["run_id", "decision_date", "decision_at"]
    sets = selected.groupBy(*key).agg(F.array_sort(F.collect_set("symbol")).alias("names"))
    sets = sets.withColumn("group", F.sha2(F.to_json(F.struct("decision_date", "decision_at", "names")), 256))
    groups = sets.groupBy("group").agg(F.first(F.struct("decision_date", "decision_at", "names")).alias("s"))
    return groups.select(F.col("group").alias("run_id"), "s.decision_date", "s.decision_at", F.explode("s.names").alias("symbol")), sets.select("run_id", "decision_date", "group")


def packed_returns(returns: DataFrame) -> DataFrame:
    """(run_id, decision_date, names, rets): a group's returns as one array of doubles for each common
    date, in the order of ``names``: closes x names numbers, in place of names x names rows."""
    key = ["run_id", "decision_date"]
    days = returns.groupBy(*key, "d").agg(F.array_sort(F.collect_list(F.struct("symbol", "ret"))).alias("cells"))
    return days.groupBy(*key).agg(F.max(F.transform("cells", lambda c: c["symbol"])).alias("names"), F.collect_list(F.transform("cells", lambda c: c["ret"])).alias("rets"))


def long_only_minimum(cov: np.ndarray) -> np.ndarray | None:
    """Weights >= 0 with sum 1 of least variance, by an active set; None if singular."""
    n = len(cov)
    free = np.ones(n, bool)
    for _ in range(4 * n + 4):
        at = np.flatnonzero(free)
        try:
            x = np.linalg.solve(cov[np.ix_(at, at)], np.ones(len(at)))
        except np.linalg.LinAlgError:
            return None
        if not np.isfinite(x).all() or x.sum() <= 0:
            return None
        w = np.zeros(n)
        w[at] = x / x.sum()
        if (w[at] < -1e-12).any():
            free[at[np.argmin(w[at])]] = False
            continue
        slope = cov @ w
        level = w @ slope
        better = ~free & (slope < level - 1e-12 * max(1.0, abs(level)))
        if not better.any():
            return np.maximum(w, 0) / np.maximum(w, 0).sum()
        free[np.flatnonzero(better)[np.argmin(slope[better])]] = True
    return None


def minimum_variance_weights(returns: DataFrame) -> DataFrame:
    """(run_id, decision_date, symbol, weight): one small quadratic programme per group, on the Gram
    matrix of its packed returns; names are in the hundreds at most."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, day, names, rets in zip(batch["run_id"], batch["decision_date"], batch["names"], batch["rets"]):
                x = np.array([np.asarray(r, np.float64) for r in rets])
                x = x - x.mean(0)
                cov = x.T @ x / (len(x) - 1) if len(x) > 1 else np.full((len(names),) * 2, np.nan)
                w = long_only_minimum(cov) if np.isfinite(cov).all() else None
                yield pd.DataFrame({"run_id": run, "decision_date": day, "symbol": list(names), "weight": [None] * len(names) if w is None else w})

    return sanitized(packed_returns(returns).mapInPandas(solve, "run_id string, decision_date date, symbol string, weight double"))


def sanitized(weights: DataFrame) -> DataFrame:
    """Weights within tolerance of [0, 1] and of sum 1, clamped and rescaled; otherwise the group is null."""
    w = Window.partitionBy("run_id", "decision_date")
    x = F.col("weight")
    fine = F.bool_and(x.isNotNull() & ~F.isnan(x) & (x >= -TOLERANCE) & (x <= 1 + TOLERANCE)).over(w) & (F.abs(F.sum(x).over(w) - 1.0) <= TOLERANCE)
    clamped = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return weights.withColumn("weight", F.when(fine, clamped / F.sum(clamped).over(w)))


def _signals(requests: DataFrame, pairs: DataFrame, universe: DataFrame, facts: DataFrame, caps: DataFrame | None) -> DataFrame:
    """(run_id, decision_date, symbol) with the factor of the newest annual period known, if valid."""
    asked = pairs.where("reason is null").select("run_id", "decision_date", "decision_at").join(universe, "run_id")
    wanted = asked.select("cik", F.col("decision_at").alias("as_of")).distinct()
    annual = stored(latest_annual(facts, wanted).withColumn("fiscal_period", F.lit("FY")))  # used twice, and facts may be a join
    factors = sorted(r["factor"] for r in requests.select("factor").distinct().collect())  # a dozen names at most
    values = factor_results(facts, annual, caps, factors).where("valid")
    named = asked.join(requests.select("run_id", "factor", "top_n"), "run_id")
    return named.join(values.withColumnRenamed("as_of", "decision_at"), ["cik", "decision_at", "factor"])



def form_targets(requests: DataFrame, pairs: DataFrame, universe: DataFrame, facts: DataFrame, bars: DataFrame, caps: DataFrame | None = None, closes: int = CLOSES) -> tuple[DataFrame, DataFrame]:
    """(targets, attempts): target weights per pair with their signals, and each pair with its reason.

    targets: run_id, decision_date, symbol, weight, value, rank, signal_period,
    evidence_at, price_evidence_at, mixed_fiscal_periods. attempts: pairs plus reason (null: executable).
    """
    key = ["run_id", "decision_date"]
    chosen = exact_top_n(_signals(requests, pairs, universe, facts, caps), key, F.col("top_n"), name="symbol")
    chosen = stored(chosen.select(*key, "decision_at", "symbol", "value", "rank", period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("signal_period"), "evidence_at", "mixed_fiscal_periods").join(requests.select("run_id", "baseline"), "run_id"))
    equal = equal_weights(chosen.where("baseline = 'equal_weight'")).select(*key, "symbol", "weight")
    groups, members = shared_windows(chosen.where("baseline <> 'equal_weight'").select(*key, "decision_at", "symbol"))
    members = stored(members.join(requests.select("run_id", "baseline"), "run_id"))
    returns = stored(aligned_returns(groups, bars, closes))
    usable = returns.where((F.col("dates") >= closes) & F.col("usable"))

    def of(baseline: str) -> DataFrame:
        return usable.join(members.where(F.col("baseline") == baseline).select(F.col("group").alias("run_id")).distinct(), "run_id", "left_semi")

    solved = inverse_volatility_weights(of("inverse_volatility")).withColumn("baseline", F.lit("inverse_volatility"))
    solved = solved.unionByName(minimum_variance_weights(of("minimum_variance")).withColumn("baseline", F.lit("minimum_variance")))
    solved = solved.select(F.col("run_id").alias("group"), "baseline", "symbol", "weight").join(members, ["group", "baseline"]).select(*key, "symbol", "weight")
    weights = equal.unionByName(solved)
    evidence = returns.groupBy(F.col("run_id").alias("group")).agg(F.max("available_at").alias("price_evidence_at")).join(members, "group").select(*key, "price_evidence_at")
    targets = stored(chosen.join(weights, [*key, "symbol"], "left").join(evidence, key, "left"))
    on_day = bars.select("symbol", F.col("trading_date").alias("effective_date"), "available_at")
    known = pairs.where("reason is null").select(*key, "effective_date", "effective_at")
    support = (
        targets.select(*key, "symbol", "weight").join(known, key).join(on_day, ["symbol", "effective_date"], "left")
        .groupBy(*key, "symbol", "weight").agg(F.count_if(F.col("available_at") <= F.col("effective_at")).alias("bars"))
        .groupBy(*key).agg(F.bool_and(F.col("weight").isNotNull()).alias("weighted"), F.bool_and((F.coalesce("weight", F.lit(1.0)) <= 0) | (F.col("bars") == 1)).alias("supported"))
    )
    reason = F.coalesce("reason", F.when(F.col("weighted").isNull(), "factor_universe_too_small").when(~F.col("weighted"), "baseline_unavailable").when(~F.col("supported"), "target_support_missing"))
    return targets.where("weight is not null"), pairs.join(support, key, "left").withColumn("reason", reason).drop("weighted", "supported")


def run_backtests(requests: DataFrame, bars: DataFrame, facts: DataFrame, securities: DataFrame, instruments: DataFrame, caps: DataFrame | None = None, closes: int = CLOSES) -> dict[str, DataFrame]:
    """requests -> frames ``runs``, ``rebalances``, ``transitions``, ``equity``, keyed by run_id.

    ``requests`` rows are valid (see ``request_faults``). ``bars`` are adjusted bars of
    one provider with symbol, trading_date, close, available_at; ``caps`` serves
    valuation factors. A run is success, unavailable (its universe, calendar or
    first rebalance cannot be formed) or failed (see :func:`failures`, or evidence is
    later than its decision), with its first reason. Only successful
    runs have metrics and an equity path.
    """
    requests = requests.withColumns({"factor": resolve_alias(F.col("factor"), dims.FACTOR_ALIASES, dims.FACTORS), "calendar_symbol": canonical_symbol(F.col("calendar_symbol")), "benchmark_symbol": canonical_symbol(F.col("benchmark_symbol"))})
    bars = stored(bars.select("symbol", "trading_date", F.col("close").cast("double").alias("close"), "available_at"))
    names = requests.select("run_id", F.explode(canonical_universe(F.col("tickers"))).alias("symbol"))
    universe = stored(names.join(issuers_of_symbols(names.select("symbol").distinct(), instruments, securities), "symbol", "left"))
    guards = universe.groupBy("run_id").agg(F.bool_or(F.col("cik").isNull()).alias("nameless"), (F.count("cik") > F.count_distinct("cik")).alias("shared"))

    calendars = requests.select(F.col("calendar_symbol").alias("symbol")).distinct()
    sessions = stored(calendar_sessions(bars.join(calendars, "symbol", "left_semi")))
    pairs = stored(decision_pairs(requests, sessions))
    targets, attempts = form_targets(requests, pairs, universe.where("cik is not null"), facts, bars, caps, closes)
    by_run = Window.partitionBy("run_id").orderBy("decision_date")
    attempts = attempts.withColumn("n", F.row_number().over(by_run)).withColumn("ok", F.col("reason").isNull())
    attempts = stored(attempts.withColumn("k", F.sum(F.col("ok").cast("int")).over(by_run)))

    done = attempts.where("ok").select("run_id", "k", "decision_date", "decision_at", "effective_date", "effective_at")
    until = F.lead("effective_date").over(Window.partitionBy("run_id").orderBy("k"))
    segments = done.withColumn("until", until).join(requests.select("run_id", "end_date", "cost_bps", "initial_nav", F.col("calendar_symbol").alias("calendar")), "run_id").withColumn("until", F.coalesce("until", "end_date"))
    held = segments.join(targets.select("run_id", "decision_date", "symbol", "weight"), ["run_id", "decision_date"]).where("weight > 0")
    start = held.join(bars.select("symbol", F.col("trading_date").alias("effective_date"), F.col("close").alias("p0"), F.col("available_at").alias("a0")), ["symbol", "effective_date"]).where("a0 <= effective_at").select("run_id", "k", "symbol", "weight", "p0", "effective_date", "until", "calendar")
    steps = start.join(sessions.select(F.col("symbol").alias("calendar"), "d", "at"), "calendar").where((F.col("d") > F.col("effective_date")) & (F.col("d") <= F.col("until")))
    priced = stored(
        steps.join(bars.withColumnRenamed("trading_date", "d"), ["symbol", "d"], "left").groupBy("run_id", "k", "symbol", "weight", "p0", "d", "until")
        .agg(F.count_if(F.col("available_at") <= F.col("at")).alias("bars"), F.max(F.when(F.col("available_at") <= F.col("at"), F.col("close"))).alias("p"))
        .withColumn("ok", (F.col("bars") == 1) & (F.col("p") > 0) & (F.col("p0") > 0))
        .withColumn("worth", F.col("weight") * F.try_divide(F.col("p"), F.col("p0")))
    )
    growth = stored(priced.groupBy("run_id", "k", "d", "until").agg(F.sum("worth").alias("growth"), F.bool_and("ok").alias("ok")))
    ends = growth.where("d = until").select("run_id", "k", F.col("growth").alias("growth_end"))

    drifted = priced.where("d = until").join(ends, ["run_id", "k"]).select("run_id", (F.col("k") + 1).alias("k"), "symbol", (F.col("worth") / F.col("growth_end")).alias("before"))
    after = held.select("run_id", "k", "symbol", F.col("weight").alias("after"))
    last = done.groupBy("run_id").agg(F.max("k").alias("top"))
    drifted = drifted.join(last, "run_id").where("k <= top").drop("top")
    moves = stored(after.join(drifted, ["run_id", "k", "symbol"], "full_outer").select("run_id", "k", "symbol", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after")))
    turnover = moves.groupBy("run_id", "k").agg(F.sum(F.abs(F.col("after") - F.col("before"))).alias("turnover"))

    chain = segments.join(turnover, ["run_id", "k"]).join(ends.withColumn("k", F.col("k") + 1), ["run_id", "k"], "left")
    so_far = Window.partitionBy("run_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("cost_bps") / 10_000.0
    chain = chain.withColumn("factor_", F.coalesce("growth_end", F.lit(1.0)) * (1.0 - F.col("turnover") * rate))
    earlier = Window.partitionBy("run_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.product("factor_").over(earlier), F.lit(1.0))
    chain = chain.withColumn("pre_nav", F.col("initial_nav") * before * F.coalesce("growth_end", F.lit(1.0))).withColumn("cost", F.col("pre_nav") * F.col("turnover") * rate).withColumn("post_nav", F.col("initial_nav") * F.product("factor_").over(so_far))
    chain = stored(chain)

    window = requests.select("run_id", "start_date", "end_date", "initial_nav", F.col("calendar_symbol").alias("symbol"), "benchmark_symbol").join(sessions.select("symbol", "d", "at", "twice"), "symbol").where((F.col("d") >= F.col("start_date")) & (F.col("d") <= F.col("end_date")))
    path = (
        window.join(growth.join(chain.select("run_id", "k", "post_nav"), ["run_id", "k"]).select("run_id", "d", "ok", (F.col("post_nav") * F.col("growth")).alias("mark")), ["run_id", "d"], "left")
        .join(chain.select("run_id", F.col("effective_date").alias("d"), F.col("post_nav").alias("posted"), F.col("pre_nav").alias("pre")), ["run_id", "d"], "left")
        .withColumn("mark", F.coalesce("mark", "pre", "initial_nav")).withColumn("nav", F.coalesce("posted", "mark"))
    )
    past = Window.partitionBy("run_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    bench = bars.select(F.col("symbol").alias("benchmark_symbol"), F.col("trading_date").alias("d"), F.col("close").alias("b"), F.col("available_at").alias("b_at"))
    marks = path.select("run_id", "benchmark_symbol", "d", "at").join(bench, ["benchmark_symbol", "d"]).where("b_at <= at").groupBy("run_id", "d").agg(F.count("*").alias("b_n"), F.max("b").alias("b"))
    path = path.join(marks, ["run_id", "d"], "left").withColumn("b_ok", F.coalesce((F.col("b_n") == 1) & (F.col("b") > 0), F.lit(False)))
    path = path.withColumn("b_all", F.min("b_ok").over(past)).withColumn("b0", F.first("b").over(past)).withColumn("s", F.row_number().over(Window.partitionBy("run_id").orderBy("d")))
    benchmark = F.when(F.col("benchmark_symbol").isNull(), None).when(F.col("s") == 1, F.col("initial_nav")).when(F.col("b_all"), F.col("initial_nav") * F.try_divide(F.col("b"), F.col("b0")))
    path = path.withColumn("peak", F.greatest("initial_nav", F.max("mark").over(past))).withColumn("event_peak", F.greatest("peak", F.coalesce(F.max("nav").over(past), F.lit(0.0))))
    path = path.withColumn("ret", F.try_divide(F.col("nav"), F.lag("nav").over(Window.partitionBy("run_id").orderBy("d"))) - 1.0).withColumn("k1", F.max("posted").over(past).isNotNull())
    path = stored(path)
    equity = path.select("run_id", F.col("d").alias("trading_date"), F.col("at").alias("valuation_at"), "nav", F.when(F.col("k1"), 0.0).otherwise(1.0).alias("cash_weight"), (F.col("nav") / F.col("peak") - 1.0).alias("drawdown"), benchmark.alias("benchmark_nav"))

    rebalances = attempts.join(chain.select("run_id", "decision_date", "pre_nav", "post_nav", "turnover", "cost"), ["run_id", "decision_date"], "left").join(path.select("run_id", F.col("d").alias("effective_date"), "nav"), ["run_id", "effective_date"], "left")
    rebalances = stored(rebalances.select(
        "run_id", "decision_date", "decision_at", "effective_date", "effective_at", F.when(F.col("ok"), "success").otherwise("unavailable").alias("status"), "reason", F.coalesce("pre_nav", "nav").alias("pre_cost_nav"), F.coalesce("post_nav", "nav").alias("post_cost_nav"),
        F.coalesce("turnover", F.lit(0.0)).alias("gross_turnover"), F.coalesce("cost", F.lit(0.0)).alias("cost_amount"),
    ))
    signal = targets.select("run_id", "decision_date", "symbol", F.col("value").alias("signal_value"), F.col("rank").alias("signal_rank"), "signal_period")
    delta = F.col("after") - F.col("before")
    transitions = moves.join(chain.select("run_id", "k", "decision_date", "effective_date", "pre_nav", "turnover", "cost"), ["run_id", "k"]).join(signal, ["run_id", "decision_date", "symbol"], "left").select(
        "run_id", "decision_date", "effective_date", "symbol", F.col("before").alias("current_weight_before"), F.col("after").alias("target_weight_after"), delta.alias("delta_weight"), (F.abs(delta) * F.col("pre_nav")).alias("gross_notional"),
        F.coalesce(F.col("cost") * F.try_divide(F.abs(delta), F.col("turnover")), F.lit(0.0)).alias("allocated_cost"), "signal_value", "signal_rank", "signal_period",
    )

    audit = leakage_audit(attempts, targets)
    bad = failures(growth, chain)
    first = attempts.where("n = 1").select("run_id", F.col("reason").alias("first_reason"))
    explicit = attempts.where(F.col("reason").isin("explicit_date_out_of_range", "calendar_missing", "effective_session_out_of_range")).groupBy("run_id").agg(F.min_by("reason", "decision_date").alias("calendar_reason"))
    in_window = window.groupBy("run_id").agg(F.bool_or("twice").alias("twice"))
    metrics = performance(path, rebalances)
    unsound = weight_faults(targets).select("run_id").distinct().withColumn("unsound", F.lit(True))
    joined = requests.select("run_id").join(unsound, "run_id", "left").join(guards, "run_id", "left").join(in_window, "run_id", "left").join(first, "run_id", "left").join(explicit, "run_id", "left").join(bad, "run_id", "left").join(audit, "run_id", "left").join(metrics, "run_id", "left")
    unavailable = (
        F.when(F.col("nameless").isNull(), "factor_universe_too_small").when(F.col("nameless"), "issuer_identity_unavailable").when(F.col("shared"), "same_issuer_universe").when(F.col("twice"), "calendar_ambiguous")
        .when(F.col("twice").isNull(), "calendar_missing").when(F.col("calendar_reason").isNotNull(), F.col("calendar_reason")).when(F.col("n_attempts").isNull(), "calendar_missing").when(F.col("first_reason").isNotNull(), F.col("first_reason"))
    )
    counts = attempts.groupBy("run_id").agg(F.count("*").alias("n_attempts"))
    joined = joined.join(counts, "run_id", "left")
    failed = F.coalesce("failure", F.when(F.col("unsound"), "non_finite_weights"), F.when(F.col("violations") > 0, "leakage_detected"))
    status = F.when(unavailable.isNotNull(), "unavailable").when(failed.isNotNull(), "failed").otherwise("success")
    measures = ["total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "gross_turnover", "transaction_cost_total", "successful_rebalance_count", "interval_count"]
    warnings = F.array_compact(F.array(*map(F.lit, STANDING_WARNINGS), F.when(F.col("mixed"), F.lit("mixed_fiscal_periods")), F.when(F.col("benchmark_gap"), F.lit("benchmark_unavailable"))))
    runs = stored(joined.select("run_id", status.alias("status"), F.coalesce(unavailable, failed).alias("reason"), *[F.when(status == "success", F.col(m)).alias(m) for m in measures], F.coalesce("violations", F.lit(0)).alias("leakage_violations"), warnings.alias("warnings")))
    good = runs.where("status = 'success'").select("run_id")
    return {"runs": runs, **{n: d.join(good, "run_id", "left_semi") for n, d in (("rebalances", rebalances), ("transitions", transitions), ("equity", equity))}}


def failures(growth: DataFrame, chain: DataFrame) -> DataFrame:
    """(run_id, failure): what stops a run first: a held return that is missing, value that is
    gone, and on the day of a rebalance after them a cost that is no cost or takes everything."""
    interval = F.when(~F.col("ok"), F.struct(F.lit(1).alias("n"), F.lit("held_return_missing").alias("reason"))).when(~F.coalesce(F.col("growth") > 0, F.lit(False)), F.struct(F.lit(2).alias("n"), F.lit("non_positive_growth").alias("reason")))
    endless = F.isnan("cost") | (F.col("cost") == float("inf"))
    change = F.when(F.coalesce(endless | (F.col("cost") < 0), F.lit(False)), F.struct(F.lit(3).alias("n"), F.lit("invalid_cost").alias("reason"))).when(~F.coalesce(F.col("post_nav") > 0, F.lit(False)), F.struct(F.lit(4).alias("n"), F.lit("invalid_post_cost_nav").alias("reason")))
    found = growth.select("run_id", "d", interval.alias("f")).unionByName(chain.select("run_id", F.col("effective_date").alias("d"), change.alias("f"))).where("f is not null")
    return found.groupBy("run_id").agg(F.min(F.struct("d", "f.n", "f.reason")).alias("first")).select("run_id", F.col("first.reason").alias("failure"))


def performance(path: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Return, risk and cost figures per run; the maximum drawdown runs over marks and post-cost values."""
    stats = path.groupBy("run_id").agg(
        F.max_by("nav", "d").alias("last"), F.first("initial_nav").alias("nav0"), F.count("ret").alias("n"), F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("mean"),
        F.min(F.least(F.col("nav") / F.col("event_peak") - 1.0, F.col("mark") / F.greatest("peak", F.col("mark")) - 1.0)).alias("max_drawdown"),
        F.bool_or(F.col("benchmark_symbol").isNotNull() & ~F.col("b_all") & (F.col("s") > 1)).alias("benchmark_gap"),
    )
    done = rebalances.where("status = 'success'").groupBy("run_id").agg(F.sum("gross_turnover").alias("gross_turnover"), F.sum("cost_amount").alias("transaction_cost_total"), F.count("*").alias("successful_rebalance_count"))
    year = F.sqrt(F.lit(float(PER_YEAR)))
    ratio = F.try_divide(F.col("last"), F.col("nav0"))
    return stats.join(done, "run_id", "left").select(
        "run_id", (ratio - 1.0).alias("total_return"), F.when(F.col("n") > 0, F.pow(ratio, F.try_divide(F.lit(float(PER_YEAR)), F.col("n"))) - 1.0).alias("annualized_return"), F.when(F.col("n") >= 2, F.col("sd") * year).alias("annualized_volatility"),
        F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.try_divide(F.col("mean"), F.col("sd")) * year).alias("sharpe_ratio"), "max_drawdown", "gross_turnover", "transaction_cost_total", "successful_rebalance_count", F.col("n").alias("interval_count"), "benchmark_gap",
    )


def leakage_audit(attempts: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, violations, mixed): decisions not before their effect, and evidence known later than its decision."""
    rows = attempts.where("ok").join(targets.select("run_id", "decision_date", "symbol", "evidence_at", "price_evidence_at", "mixed_fiscal_periods"), ["run_id", "decision_date"])
    late = (F.col("decision_at") >= F.col("effective_at")) | F.coalesce(F.col("evidence_at") > F.col("decision_at"), F.lit(False)) | F.coalesce(F.col("price_evidence_at") > F.col("decision_at"), F.lit(False))
    return rows.groupBy("run_id").agg(F.count_if(late).alias("violations"), F.bool_or("mixed_fiscal_periods").alias("mixed"))


def weight_faults(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose weights do not sum to 1, or hold a negative or non-finite one."""
    return weights.groupBy("run_id", "decision_date").agg(F.sum("weight").alias("total"), F.bool_and(F.col("weight") >= 0).alias("fine")).where((F.abs(F.col("total") - 1.0) > tolerance) | ~F.coalesce("fine", F.lit(False)) | F.isnan("total"))

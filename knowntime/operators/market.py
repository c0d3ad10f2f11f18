"""Market operators: window metrics, point-in-time market cap, series dates, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowntime.functions import dims
from knowntime.functions.scalars import resolve_alias
from knowntime.operators.pit import dominated_maxima, latest_on_or_before, primary_securities

CLOSES, LOOKBACK_DAYS, SKIP, PER_YEAR = 253, 550, 21, 252
STALE_PRICE_DAYS, STALE_SHARES_DAYS = 7, 120
ADJUSTED_WARNING = "adjusted_history_may_embed_later_corporate_actions"


def scan_bars(bars: DataFrame, instrument_id: str | None = None, start: str | None = None, end: str | None = None, mode: str | None = None, provider: str | None = None, as_of: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars of an instrument in date order; every condition reaches the scan."""
    out = bars
    for column, value in (("instrument_id", instrument_id), ("adjustment_mode", mode), ("provider", provider)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if start is None else out.where(F.col("trading_date") >= F.lit(start).cast("date"))
    out = out if end is None else out.where(F.col("trading_date") <= F.lit(end).cast("date"))
    out = out if as_of is None else out.where(F.col("available_at") <= F.lit(as_of).cast("timestamp"))
    out = out.orderBy("trading_date", "instrument_id")
    return out if limit is None else out.limit(limit)


def scan_bars_for(bars: DataFrame, ids: DataFrame) -> DataFrame:
    """Bars of the instruments in ``ids``."""
    return bars.join(ids.select("instrument_id").distinct(), "instrument_id", "left_semi")


def _window(bars: DataFrame, requests: DataFrame, closes: int, lookback: int) -> DataFrame:
    """Known bars of each request's last ``lookback`` days, numbered from the newest (rn = 1)."""
    day = F.to_date("as_of")
    bucket = lambda c: F.floor(F.unix_date(c) / lookback)  # noqa: E731  a window meets two buckets, not the whole history
    asked = requests.select("symbol", "as_of").distinct().withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.date_sub(day, lookback)), bucket(day)))))
    known = bars.select("symbol", "trading_date", F.col("close").cast("double").alias("close"), "available_at", "fetched_at", bucket(F.col("trading_date")).alias("__b"))
    joined = (
        asked.join(known, ["symbol", "__b"]).drop("__b")
        .where((F.col("available_at") <= F.col("as_of")) & (F.col("trading_date") <= day) & (F.col("trading_date") >= F.date_sub(day, lookback)))
    )
    newest = Window.partitionBy("symbol", "as_of").orderBy(F.desc("trading_date"))
    oldest = Window.partitionBy("symbol", "as_of").orderBy("trading_date")
    return (
        joined.withColumn("rn", F.row_number().over(newest))
        .withColumn("twice", (F.lag("trading_date").over(oldest) == F.col("trading_date")).cast("int"))
        .withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(oldest)) - 1.0)
    )


def window_metrics(bars: DataFrame, requests: DataFrame, closes: int = CLOSES, lookback: int = LOOKBACK_DAYS, skip: int = SKIP) -> DataFrame:
    """Momentum, volatility and drawdown of each (symbol, as_of): a row per request and metric.

    ``bars`` holds adjusted bars with symbol, trading_date, close, available_at and
    fetched_at. One aggregation yields the three metrics and their provenance:
    symbol, as_of, metric, value, valid, reason, higher_is_better, window_start, window_end,
    observation_count, first_date, last_date, available_at, fetched_from, fetched_to, warnings.
    """
    w = _window(bars, requests, closes, lookback)
    inside = F.col("rn") <= closes
    peaks = Window.partitionBy("symbol", "as_of").orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("peak", F.max(F.when(inside, F.col("close"))).over(peaks))
    pick = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    stats = w.groupBy("symbol", "as_of").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"),
        pick(closes, "close").alias("p0"), pick(skip + 1, "close").alias("p1"), pick(closes, "trading_date").alias("d0"), pick(skip + 1, "trading_date").alias("d1"), pick(1, "trading_date").alias("d2"),
        F.bool_and(F.when(inside, F.col("close") > 0)).alias("positive"),
        F.stddev_samp(F.when(F.col("rn") < closes, F.col("ret"))).alias("sd"),
        F.min(F.when(inside, F.try_divide(F.col("close"), F.col("peak")) - 1.0)).alias("dd"),
        F.min(F.when(inside, F.col("trading_date"))).alias("first_date"), F.max(F.when(inside, F.col("trading_date"))).alias("last_date"),
        F.max(F.when(inside, F.col("available_at"))).alias("available_at"), F.min(F.when(inside, F.col("fetched_at"))).alias("fetched_from"), F.max(F.when(inside, F.col("fetched_at"))).alias("fetched_to"),
    )
    rows = requests.select("symbol", "as_of").distinct().join(stats, ["symbol", "as_of"], "left")
    short = F.when(F.col("n").isNull(), "insufficient_history").when(F.col("twice") > 0, "ambiguous_provider_history").when(F.col("n") < closes, "insufficient_history")
    ok = F.coalesce("positive", F.lit(False))
    metric = lambda name, value, reason, end: F.struct(F.lit(name).alias("metric"), value.alias("value"), F.coalesce(short, reason).alias("reason"), F.lit(dims.METRICS[name]).cast("boolean").alias("higher_is_better"), F.col(end).alias("window_end"))
    all_ = F.array(
        metric("momentum_12_1", F.try_divide(F.col("p1"), F.col("p0")) - 1.0, F.when(~F.coalesce(F.col("p0") > 0, F.lit(False)), "start_close_non_positive").when(~F.coalesce(F.col("p1") > 0, F.lit(False)), "end_close_non_positive"), "d1"),
        metric("volatility_1y", F.col("sd") * F.sqrt(F.lit(float(PER_YEAR))), F.when(~ok, "non_positive_close"), "d2"),
        metric("max_drawdown_1y", F.col("dd"), F.when(~ok, "non_positive_close"), "d2"),
    )
    out = rows.select("symbol", "as_of", F.col("d0").alias("window_start"), "n", "first_date", "last_date", "available_at", "fetched_from", "fetched_to", F.explode(all_).alias("m"))
    valid = F.col("m.reason").isNull()
    return out.select(
        "symbol", "as_of", "m.metric", F.when(valid, F.col("m.value")).alias("value"), valid.alias("valid"), "m.reason", "m.higher_is_better", F.when(valid, F.col("window_start")).alias("window_start"), F.when(valid, F.col("m.window_end")).alias("window_end"),
        F.when(valid, F.lit(closes)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("observation_count"), "first_date", "last_date", "available_at", "fetched_from", "fetched_to", F.array(F.lit(ADJUSTED_WARNING)).alias("warnings"),
    )


def beta(bars: DataFrame, requests: DataFrame, closes: int = CLOSES, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(symbol, benchmark, as_of) -> beta of returns over the last ``closes`` common dates.

    Dates are intersected before returns, so gaps are never filled. Same columns
    as :func:`window_metrics` up to window_end, with benchmark.
    """
    asked = requests.select("symbol", "benchmark", "as_of").distinct()
    sides = _window(bars, asked.select("symbol", "as_of").union(asked.select("benchmark", "as_of")), closes, lookback)
    per = sides.groupBy("symbol", "as_of").agg(F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"), F.count("*").alias("n"))
    a = sides.select("symbol", "as_of", "trading_date", F.col("close").alias("ca"))
    b = sides.select(F.col("symbol").alias("benchmark"), "as_of", "trading_date", F.col("close").alias("cb"))
    both = asked.join(a, ["symbol", "as_of"]).join(b, ["benchmark", "as_of", "trading_date"])
    key = ["symbol", "benchmark", "as_of"]
    newest, oldest = Window.partitionBy(*key).orderBy(F.desc("trading_date")), Window.partitionBy(*key).orderBy("trading_date")
    both = both.withColumn("rn", F.row_number().over(newest))
    for c in ("ca", "cb"):
        both = both.withColumn(f"r{c}", F.try_divide(F.col(c), F.lag(c).over(oldest)) - 1.0)
    in_ = F.col("rn") < closes
    stats = both.groupBy(*key).agg(
        F.count("*").alias("common"), F.bool_and(F.when(F.col("rn") <= closes, (F.col("ca") > 0) & (F.col("cb") > 0))).alias("positive"), F.covar_samp(F.when(in_, F.col("rca")), F.when(in_, F.col("rcb"))).alias("cov"), F.var_samp(F.when(in_, F.col("rcb"))).alias("var"),
        F.max(F.when(F.col("rn") == closes, F.col("trading_date"))).alias("window_start"), F.max("trading_date").alias("window_end"),
    )
    own = per.select("symbol", "as_of", F.col("twice").alias("ta"), F.col("n").alias("na"))
    other = per.select(F.col("symbol").alias("benchmark"), "as_of", F.col("twice").alias("tb"), F.col("n").alias("nb"))
    rows = asked.join(own, ["symbol", "as_of"], "left").join(other, ["benchmark", "as_of"], "left").join(stats, key, "left")
    reason = (
        F.when(F.col("ta") > 0, "ambiguous_provider_history").when(F.coalesce("na", F.lit(0)) < closes, "insufficient_history")
        .when(F.col("tb") > 0, "ambiguous_benchmark_history").when(F.coalesce("nb", F.lit(0)) < closes, "benchmark_insufficient_history")
        .when(F.coalesce("common", F.lit(0)) < closes, "insufficient_overlap").when(~F.coalesce("positive", F.lit(False)), "non_positive_close").when(F.coalesce("var", F.lit(0.0)) == 0, "zero_benchmark_variance")
    )
    return rows.select(*key, F.lit("beta_1y").alias("metric"), F.when(reason.isNull(), F.try_divide(F.col("cov"), F.col("var"))).alias("value"), reason.isNull().alias("valid"), reason.alias("reason"), F.lit(None).cast("boolean").alias("higher_is_better"), "window_start", "window_end")


def all_metrics(bars: DataFrame, requests: DataFrame, closes: int = CLOSES, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """The four metrics of (symbol, benchmark, as_of) requests in one long frame."""
    shared = ["symbol", "as_of", "metric", "value", "valid", "reason", "higher_is_better", "window_start", "window_end"]
    return window_metrics(bars, requests, closes, lookback).select(*shared).unionByName(beta(bars, requests, closes, lookback).select(*shared))


def share_classes(securities: DataFrame) -> DataFrame:
    """(cik, classes): number of distinct tickers per issuer."""
    return securities.groupBy("cik").agg(F.count_distinct("ticker").alias("classes"))


def shares_outstanding(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(cik, market_date, knowledge_time, ...) -> requests and shares, shares_date, shares_at, accession, form,
    concept, shares_warnings, shares_reason.

    The best positive share count dated on or before the market day and known by
    the knowledge time: latest date, better concept, latest availability, accession.
    """
    tags = F.create_map(*[F.lit(x) for i, t in enumerate(dims.SHARE_TAGS) for x in (t, i)])
    counts = facts.where(F.col("concept").isin(*dims.SHARE_TAGS) & (F.lower("unit") == "shares") & (F.col("value") > 0) & F.col("end_date").isNotNull()).select(
        "cik", F.col("value").cast("decimal(38,6)").alias("shares"), F.col("end_date").alias("shares_date"), F.col("available_at").alias("shares_at"), "accession_number", "form", "concept", F.element_at(tags, F.col("concept")).alias("priority")
    )
    asked = ["cik", "market_date", "knowledge_time"]
    level = F.struct("shares_date", (-F.col("priority")).alias("p"))
    order = F.struct("shares_date", (-F.col("priority")).alias("p"), "shares_at", F.coalesce("accession_number", F.lit("")).alias("a"), "shares")
    maxima = {
        "top": F.struct(order.alias("o"), F.struct("shares", "shares_date", "shares_at", "accession_number", "form", "concept").alias("s")),
        "hi": F.struct(level.alias("l"), F.col("shares").alias("v")), "lo": F.struct(level.alias("l"), (-F.col("shares")).alias("v")),
    }
    best = dominated_maxima(requests.select(*asked).distinct(), counts, ["cik"], "market_date", "knowledge_time", "shares_date", maxima, "shares_at")
    best = best.select(*asked, F.col("top.s").alias("s"), "hi", "lo")
    age = F.datediff("market_date", "s.shares_date")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("hi.v") != -F.col("lo.v"), F.lit("conflicting_equal_priority_shares_facts")),
            F.when(F.col("s").isNotNull() & F.col("s.accession_number").isNull(), F.lit("missing_accession_provenance")),
            F.when(age > STALE_SHARES_DAYS, F.concat(F.lit("stale_shares_fact:"), age.cast("string"), F.lit("_days_old"))),
        )
    )
    return requests.join(best, asked, "left").select(*requests.columns, "s.*", warnings.alias("shares_warnings"), F.when(F.col("s").isNull(), F.lit("no_qualifying_shares_outstanding_fact")).alias("shares_reason"))


def market_caps(requests: DataFrame, bars: DataFrame, facts: DataFrame, securities: DataFrame, instruments: DataFrame, stale_days: int = STALE_PRICE_DAYS) -> DataFrame:
    """(ticker, market_date, as_of) -> point-in-time market cap, decimal, with provenance and reason.

    ``bars`` are raw (unadjusted) with instrument_id; a null ``as_of`` means the
    price's own availability is the knowledge time. Issuers with several share
    classes, stale prices and missing parts give a reason instead of a value.
    """
    symbols = instruments.select(F.col("canonical_symbol").alias("ticker"), "instrument_id", "issuer_cik")
    primary = primary_securities(securities).withColumnRenamed("cik", "__sec_cik")
    asked = (
        requests.select(F.upper(F.trim("ticker")).alias("ticker"), "market_date", F.col("as_of").cast("timestamp").alias("as_of")).distinct()
        .join(symbols, "ticker", "left").join(primary, "ticker", "left").withColumn("cik", F.coalesce("issuer_cik", "__sec_cik"))
        .join(share_classes(securities), "cik", "left")
        .withColumn("known_by", F.coalesce("as_of", F.lit("9999-12-31").cast("timestamp")))
    )
    asked = asked.select("ticker", "market_date", "as_of", "instrument_id", "cik", "classes", "known_by")
    payload = ["trading_date", "close", "currency", "provider", "available_at", "fetched_at"]
    swept = latest_on_or_before(asked.where("as_of is null"), bars, ["instrument_id"], "market_date", "trading_date", payload, ties=["available_at"])
    priced = swept.unionByName(latest_on_or_before(asked.where("as_of is not null"), bars, ["instrument_id"], "market_date", "trading_date", payload, known_at="known_by", ties=["available_at"]))
    priced = priced.withColumn("price_date", F.col("bar_trading_date")).withColumn("knowledge_time", F.coalesce("as_of", "bar_available_at"))
    with_shares = shares_outstanding(priced.withColumnRenamed("market_date", "asked_date").withColumn("market_date", F.col("price_date")), facts)
    age = F.datediff("asked_date", "price_date")
    reason = (
        F.when(F.col("instrument_id").isNull(), "instrument_not_found").when(F.col("classes") > 1, "multi_class_issuer_ambiguous").when(F.col("price_date").isNull(), "missing_raw_price")
        .when(age > stale_days, F.concat(F.lit("price_stale:"), age.cast("string"), F.lit(f"_days_exceeds_{stale_days}"))).when(F.col("cik").isNull(), "no_sec_security_for_ticker").when(F.col("shares_reason").isNotNull(), F.col("shares_reason"))
    )
    warnings = F.array_compact(F.concat(F.array(F.when(age > 0, F.concat(F.lit("used_prior_trading_day:"), F.col("price_date").cast("string"))), F.when(F.col("as_of") > F.col("bar_available_at"), F.lit("later_knowledge_time"))), "shares_warnings"))
    cap = F.col("bar_close").cast("decimal(18,6)") * F.col("shares").cast("decimal(20,0)")
    fine = reason.isNull()
    return with_shares.select(
        "ticker", "cik", F.col("asked_date").alias("market_date"), "as_of", F.when(fine, cap.cast("decimal(38,6)")).alias("market_cap"), "price_date", "knowledge_time", F.col("bar_close").alias("raw_close"), F.col("bar_currency").alias("currency"),
        F.col("bar_provider").alias("provider"), F.col("bar_fetched_at").alias("fetched_at"), "shares", "shares_date", "shares_at", F.col("concept").alias("sec_concept"), F.col("accession_number").alias("sec_accession"), F.col("form").alias("sec_form"), fine.alias("valid"), reason.alias("reason"), warnings.alias("warnings"),
    )


def series_dates(bars: DataFrame, frequency: str = "daily") -> DataFrame:
    """(instrument_id, trading_date): all dates, or the last stored one of each month or quarter."""
    days = bars.select("instrument_id", "trading_date").distinct()
    if frequency == "daily":
        return days
    unit = {"month_end": "month", "quarter_end": "quarter"}[frequency]
    return days.groupBy("instrument_id", F.trunc("trading_date", unit).alias("bucket")).agg(F.max("trading_date").alias("trading_date")).select("instrument_id", "trading_date")


def market_cap_series(bars: DataFrame, facts: DataFrame, securities: DataFrame, instruments: DataFrame, frequency: str = "month_end", start: str | None = None, end: str | None = None) -> DataFrame:
    """Market caps on each series date of every instrument."""
    raw = scan_bars(bars, start=start, end=end)
    days = series_dates(raw, frequency).join(instruments.select("instrument_id", F.col("canonical_symbol").alias("ticker")), "instrument_id")
    return market_caps(days.select("ticker", F.col("trading_date").alias("market_date"), F.lit(None).cast("timestamp").alias("as_of")), bars, facts, securities, instruments)


def stored_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument_id", "provider", "adjustment_mode").agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count("*").alias("bars"))


def named_metrics(bars: DataFrame, requests: DataFrame, closes: int = CLOSES, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(symbol, benchmark, as_of, name) -> requests with metric, value, valid, reason, higher_is_better; names
    may be aliases, and an unknown one says so."""
    asked = requests.withColumn("metric", resolve_alias(F.col("name"), dims.METRIC_ALIASES, dims.METRICS))
    known = asked.where("metric is not null").select("symbol", "benchmark", "as_of").distinct()
    found = all_metrics(bars, known, closes, lookback).select("symbol", "as_of", "metric", "value", "valid", "reason", "higher_is_better")
    out = asked.join(found, ["symbol", "as_of", "metric"], "left")
    unknown = F.col("metric").isNull()
    return out.withColumns({"valid": F.coalesce("valid", F.lit(False)), "reason": F.when(unknown, "unknown_metric").otherwise(F.col("reason"))})


def database_stats(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """(table, rows, run_id, finished_at): row counts, and a row of their own for the latest successful run of
    ``runs`` (run_id string, finished_at, status), if there is one."""
    last = runs.where("status = 'success'").agg(F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", "run_id")).alias("r")).where("r is not null")
    counts = table_stats(tables).select("table", "rows", F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("timestamp").alias("finished_at"))
    return counts.unionByName(last.select(F.lit("latest_successful_run").alias("table"), F.lit(None).cast("long").alias("rows"), "r.run_id", F.col("r.finished_at").cast("timestamp").alias("finished_at")))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for each named frame."""
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    assert out is not None, "no tables"
    return out


"""Scalar column functions: identifiers, dates, periods, validation. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
NEVER = "9999-12-31 23:59:59"


def normalize_cik(value: Column) -> Column:
    """Digits left-padded to ten (longer runs stay whole); null without a digit."""
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    return F.when(digits == "", None).when(F.length(digits) > 10, digits).otherwise(F.lpad(digits, 10, "0"))


def canonical_symbol(value: Column) -> Column:
    """Upper case without surrounding blanks; blank becomes null."""
    return F.nullif(F.upper(F.trim(value)), F.lit(""))


def canonical_universe(values: Column) -> Column:
    """Symbols of an array, canonical, first occurrence kept."""
    return F.array_distinct(F.array_compact(F.transform(values, canonical_symbol)))


def fact_id(*parts: Column) -> Column:
    """First 32 hex digits of SHA-256 over the parts' texts joined by ``|``; null is empty.

    Doubles enter as decimal(38,10) text, which is this library's own canonical form.
    """
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 32)


def fact_key(prefix: str = "") -> Column:
    """:func:`fact_id` over the identifying columns of a facts frame."""
    c = lambda n: F.col(prefix + n)
    return fact_id(
        c("cik"), c("taxonomy"), c("concept"), c("unit"), c("start_date"), c("end_date"), c("value").cast("decimal(38,10)"), c("accession_number"), c("form"), F.nullif(c("fiscal_year"), F.lit(0)), c("fiscal_period"), c("frame")
    )


def instrument_id(symbol: Column) -> Column:
    return F.concat(F.lit("mkt_"), F.substring(F.sha2(F.upper(F.trim(symbol)).cast("binary"), 256), 1, 16))


def mapping_id(instrument: Column, provider: Column, provider_symbol: Column, valid_from: Column, valid_to: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (instrument, F.lower(F.trim(provider)), F.upper(F.trim(provider_symbol)), valid_from, valid_to)])
    return F.concat(F.lit("map_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def acceptance_instant(value: Column) -> Column:
    """Filing acceptance text as an instant.

    An explicit zone is honoured; naive ISO or ``yyyyMMddHHmmss`` is US Eastern
    wall time; a date alone, or anything else, is null.
    """
    v = F.trim(value)
    zoned = v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})$")
    iso = v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    compact = v.rlike(r"^\d{14}$")
    with_zone = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, r"(?i)\s*z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return (
        F.when(zoned, with_zone)
        .when(iso, F.to_utc_timestamp(F.try_to_timestamp(v), EASTERN))
        .when(compact, F.to_utc_timestamp(F.try_to_timestamp(v, F.lit("yyyyMMddHHmmss")), EASTERN))
    )


def filing_available_at(acceptance: Column, filing_date: Column) -> Column:
    """Acceptance, else the end of the filing day in US Eastern time, else far in the future."""
    end_of_day = F.to_utc_timestamp(filing_date.cast("timestamp") + F.expr("interval '23:59:59' hour to second"), EASTERN)
    return F.coalesce(acceptance, end_of_day, F.lit(NEVER).cast("timestamp"))


def bar_available_at(trading_date: Column, zone: Column) -> Column:
    """16:15 of the trading day in the exchange's zone, as an instant.

    ``zone`` must be null or a zone that Spark knows (see
    :func:`knowntime.operators.quality.with_known_zone`); null gives null.
    """
    return F.to_utc_timestamp(trading_date.cast("timestamp") + F.expr("interval '16:15' hour to minute"), zone)


def lenient_date(value: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(value.cast("string")), 1, 10))


def lenient_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def lenient_number(value: Column) -> Column:
    """Number text with thousands commas; booleans, blanks and non-finite values are null."""
    number = F.regexp_replace(F.trim(value.cast("string")), ",", "").try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def lenient_bool(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true", "yes", "y", "t"), True).when(text.isin("0", "false", "no", "n", "f"), False)


def parse_period(text: Column) -> Column:
    """``FY2023``, ``FY-2023``, ``Q3-2023``, ``Q3 2023``, ``2023Q3`` -> struct<year, period, kind>;
    anything else is null."""
    t = F.upper(F.trim(text))
    annual = F.regexp_extract(t, r"^FY[-\s]?(\d{4})$", 1)
    q_first = r"^(Q[1-4])[-\s]?(\d{4})$"
    y_first = r"^(\d{4})[-\s]?(Q[1-4])$"
    year = F.coalesce(F.nullif(annual, F.lit("")), F.nullif(F.regexp_extract(t, q_first, 2), F.lit("")), F.nullif(F.regexp_extract(t, y_first, 1), F.lit("")))
    quarter = F.coalesce(F.nullif(F.regexp_extract(t, q_first, 1), F.lit("")), F.nullif(F.regexp_extract(t, y_first, 2), F.lit("")))
    period = F.when(annual != "", "FY").otherwise(quarter)
    made = F.struct(year.cast("int").alias("fiscal_year"), period.alias("fiscal_period"), F.when(period == "FY", "annual").otherwise("quarterly").alias("kind"))
    return F.when(year.isNotNull() & period.isNotNull(), made)


def prior_comparable(year: Column) -> Column:
    return year - 1


def prior_quarter(period: Column) -> Column:
    """Q2 -> Q1, Q3 -> Q2, Q4 -> Q3 of the same year; others null."""
    return F.when(period.isin("Q2", "Q3", "Q4"), F.concat(F.lit("Q"), (F.substring(period, 2, 1).cast("int") - 1).cast("string")))


def period_label(year: Column, period: Column) -> Column:
    return F.when(period == "FY", F.concat(F.lit("FY"), year.cast("string"))).otherwise(F.concat(period, F.lit("-"), year.cast("string")))


def ytd_label(period: Column) -> Column:
    return F.concat(period, F.lit("_YTD"))


def duration_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def looks_ytd(days: Column, period: Column) -> Column:
    """A quarter after the first whose fact spans over 130 days."""
    return F.coalesce(F.upper(period).isin("Q2", "Q3", "Q4") & (days > 130), F.lit(False))


def apply_sign(value: Column, mode: Column) -> Column:
    return F.when(mode == "abs", F.abs(value)).when(mode == "negate", -value).otherwise(value)


def resolve_alias(name: Column, aliases: dict[str, str], known: dict) -> Column:
    """Canonical name of a factor or metric: case, hyphens and blanks do not matter; unknown is null."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")
    table = F.create_map(*[F.lit(x) for pair in ({k: k for k in known} | aliases).items() for x in pair])
    return F.try_element_at(table, key)


def ohlcv_faults(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    """array<string> of what is wrong with a bar, empty when nothing is."""
    prices = {"open": open_, "high": high, "low": low, "close": close}
    checks = []
    for name, p in prices.items():
        number = p.cast("double")
        checks += [F.when(p.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(f"non_finite_{name}")), F.when(number <= 0, F.lit(f"non_positive_{name}"))]
    checks += [
        F.when(volume < 0, F.lit("negative_volume")),
        F.when(high < F.greatest(open_, close), F.lit("high_below_open_or_close")),
        F.when(low > F.least(open_, close), F.lit("low_above_open_or_close")),
        F.when(high < low, F.lit("high_below_low")),
    ]
    return F.array_compact(F.array(*checks))


def parse_as_of(text: Column) -> Column:
    """Decision time: a date alone means the end of that UTC day; naive times are UTC."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit(" 23:59:59")))).otherwise(F.try_to_timestamp(F.regexp_replace(t, r"(?i)z$", "+00:00")))


def ordered_unique(*arrays: Column) -> Column:
    """Concatenated arrays, first occurrences kept, nulls dropped."""
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


def metadata_json(entries: Column) -> Column:
    """JSON of a map without keys that contain ``key``, in key order."""
    kept = F.map_filter(entries, lambda k, v: ~F.lower(k).contains("key"))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def request_fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 of the economic fields as JSON in name order; names and notes stay out.

    ``tickers`` enter canonical, sorted and unique; ``factor`` by its canonical name.
    """
    made = dict(columns)
    made["tickers"] = F.array_sort(canonical_universe(columns["tickers"]))
    from knowntime.functions.dims import FACTOR_ALIASES, FACTORS

    made["factor"] = resolve_alias(columns["factor"], FACTOR_ALIASES, FACTORS)
    return F.sha2(F.to_json(F.struct(*[made[k].alias(k) for k in sorted(made)])).cast("binary"), 256)


def request_faults() -> Column:
    """array<string> of what is wrong with a backtest request row."""
    from knowntime.functions.dims import FACTOR_ALIASES, FACTORS

    universe = F.size(canonical_universe(F.col("tickers")))
    cost, nav = F.col("cost_bps"), F.col("initial_nav")
    dates = F.coalesce(F.col("explicit_dates"), F.array().cast("array<date>"))
    outside = F.exists(dates, lambda d: (d < F.col("start_date")) | (d > F.col("end_date")))
    checks = [
        F.when(F.coalesce(universe, F.lit(0)) < 1, F.lit("empty_universe")),
        F.when(F.coalesce(F.col("top_n"), F.lit(0)) < 1, F.lit("top_n_below_one")),
        F.when(F.col("top_n") > universe, F.lit("top_n_exceeds_universe")),
        F.when(resolve_alias(F.col("factor"), FACTOR_ALIASES, FACTORS).isNull(), F.lit("unknown_factor")),
        F.when(~F.coalesce(F.col("baseline").isin("equal_weight", "inverse_volatility", "minimum_variance"), F.lit(False)), F.lit("unknown_baseline")),
        F.when(~F.coalesce(F.col("schedule").isin("monthly", "quarterly", "explicit"), F.lit(False)), F.lit("unknown_schedule")),
        F.when(F.col("start_date").isNull() | F.col("end_date").isNull() | (F.col("start_date") > F.col("end_date")), F.lit("dates_not_ordered")),
        F.when(cost.isNull() | F.isnan(cost) | (cost < 0) | (cost == float("inf")), F.lit("invalid_cost")),
        F.when(nav.isNull() | F.isnan(nav) | (nav <= 0) | (nav == float("inf")), F.lit("invalid_nav")),
        F.when((F.col("schedule") == "explicit") & (F.size(dates) == 0), F.lit("explicit_dates_missing")),
        F.when((F.col("schedule") != "explicit") & (F.size(dates) > 0), F.lit("explicit_dates_unexpected")),
        F.when(outside, F.lit("explicit_date_outside_range")),
    ]
    return F.array_compact(F.array(*checks))

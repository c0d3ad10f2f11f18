"""Point-in-time access: as-of filters and joins, validity intervals, fact versions.

Nothing known after the decision time reaches a result. Request frames are the
unit of work: every operator answers all rows of one at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, when: Column | str, available: str = "available_at") -> DataFrame:
    """Rows known at one instant; the comparison is pushed to the scan."""
    return df.where(F.col(available) <= (F.lit(when).cast("timestamp") if isinstance(when, str) else when))


def as_of_requests(df: DataFrame, requests: DataFrame, keys: Sequence[str] = ("cik",), available: str = "available_at") -> DataFrame:
    """Rows known at each request's ``as_of``: an equi join on ``keys`` with an inequality."""
    return requests.join(df, list(keys)).where(F.col(available) <= F.col("as_of"))


def first_known(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """One row per key: the earliest available, then the smallest rest of the row."""
    rest = [c for c in facts.columns if c != key]
    order = F.struct(F.col("available_at").alias("__a"), F.coalesce("filing_date", F.lit("9999-12-31").cast("date")).alias("__f"), F.coalesce("accession_number", F.lit("")).alias("__n"), F.struct(*rest).alias("__rest"))
    return facts.groupBy(key).agg(F.min(order).alias("best")).select(key, "best.__rest.*").select(facts.columns)


def latest_on_or_before(
    requests: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, time: str, payload: Sequence[str], known_at: str | None = None, ties: Sequence[str] = (), prefix: str = "bar_"
) -> DataFrame:
    """As-of join: each request gets the row of its keys with the latest ``time`` <= ``at``.

    Requests and rows are merged on one time axis and the last row seen is carried
    forward, so the cost is one sort per key, whatever the number of requests.
    With ``known_at`` (a request column) rows must also be available by then
    (:func:`dominated_maxima`). ``ties`` order rows of equal time. Requests without a match
    keep nulls.
    """
    out = [F.col(f"__r.{c}").alias(f"{prefix}{c}") for c in payload]
    if known_at is not None:
        best = F.struct(F.struct(F.col(time), *[F.col(t) for t in ties]).alias("o"), F.struct(*payload).alias("p"))
        found = dominated_maxima(requests, rows, keys, at, known_at, time, {"__r": best})
        return found.select(*requests.columns, *[F.col(f"__r.p.{c}").alias(f"{prefix}{c}") for c in payload])
    left = requests.select(*[F.col(k) for k in keys], F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*requests.columns).alias("__q"), F.lit(None).alias("__row"), F.lit(None).alias("__tie"))
    tie = F.struct(*[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)]) if ties else F.lit(None).cast("int")
    right = rows.select(*[F.col(k) for k in keys], F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__q"), F.struct(*rows.columns).alias("__row"), tie.alias("__tie"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    merged = right.unionByName(left).withColumn("__r", F.last("__row", ignorenulls=True).over(w)).where("__side = 1")
    return merged.select("__q.*", "__r").select(*requests.columns, *out)


def dominated_maxima(requests: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, known_at: str, time: str, maxima: dict[str, Column], available: str = "available_at") -> DataFrame:
    """Requests with the maximum of each expression over the rows of their keys that have
    ``time`` <= the request's ``at`` and ``available`` <= its ``known_at``; null without any.

    Rows are numbered by availability within their keys; what a request knows is the first r
    of them, and r in octal cuts that prefix into at most seven runs of each power of eight. A
    row enters one run for each power below its key's count, and within a run ``at`` decides
    alone: one sweep on ``time`` with running maxima. So rows and requests are copied a
    logarithmic number of times, and never paired.
    """
    named = {f"__m{i}": k for i, k in enumerate(maxima)}
    good = rows.where(F.col(time).isNotNull() & F.col(available).isNotNull())
    for k in keys:
        good = good.where(F.col(k).isNotNull())
    right = good.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(available).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__q"), F.col(time).alias("__t"), *[c.alias(n) for n, c in zip(named, maxima.values())])
    nothing = [F.lit(None).cast(right.schema[n].dataType).alias(n) for n in named]
    left = requests.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(known_at).alias("__at"), F.lit(1).alias("__side"), F.struct(F.monotonically_increasing_id().alias("id"), F.struct(*requests.columns).alias("row")).alias("__q"), F.col(at).cast(right.schema["__t"].dataType).alias("__t"), *nothing)
    by = [f"__k{i}" for i in range(len(keys))]
    w = Window.partitionBy(*by)
    number = F.count(F.when(F.col("__side") == 0, 1))
    ranked = right.unionByName(left).withColumns({"__r": number.over(w.orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)), "__n": number.over(w)})
    powers = "sequence(0, length(conv(cast(__n as string), 10, 8)) - 1)"
    runs = f"flatten(transform({powers}, l -> transform(filter(sequence(0L, 6L), i -> i < shiftright(__r, cast(3 * l as int)) % 8), i -> struct(l as l, shiftright(__r, cast(3 * l + 3 as int)) * 8 + i as b))))"
    none = "array(struct(-1 as l, 0L as b))"  # keeps requests that know nothing
    placed = ranked.withColumn("__p", F.explode(F.expr(f"if(__side = 0, transform({powers}, l -> struct(l as l, shiftright(__r - 1, cast(3 * l as int)) as b)), concat({none}, {runs}))")))
    placed = placed.select(*by, F.col("__p.l").alias("__l"), F.col("__p.b").alias("__b"), "__t", "__side", "__q", *named)
    sweep = Window.partitionBy(*by, "__l", "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumns({n: F.max(n).over(sweep) for n in named}).where("__side = 1")
    best = swept.groupBy(F.col("__q.id").alias("__id")).agg(F.first("__q.row").alias("__q"), *[F.max(n).alias(n) for n in named])
    return best.select(*[F.col(f"__q.{c}").alias(c) for c in requests.columns], *[F.col(n).alias(k) for n, k in named.items()])


def in_bands(bands: DataFrame, points: DataFrame, by: Sequence[str], start: str, end: str, point: str, days: int) -> DataFrame:
    """Bands (start and end dates) joined with the points of their keys that lie within them.

    Both sides meet in buckets of ``days``: a band enters each bucket that it touches, a point
    its own, so a point meets only the bands of its bucket. Bands far longer than ``days`` cost
    their buckets; choose ``days`` near the usual length.
    """
    origin = F.lit("1970-01-01").cast("date")
    bucket = lambda c: F.floor(F.datediff(F.col(c), origin) / F.lit(days))
    left = bands.where(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return left.join(points.withColumn("__bucket", bucket(point)), [*by, "__bucket"]).where(F.col(point).between(F.col(start), F.col(end))).drop("__bucket")


def valid_on(requests: DataFrame, mappings: DataFrame, day: str = "day") -> DataFrame:
    """Symbol mappings in force on each request's day; open ends count as unbounded.
    The latest ``valid_from``, then mapping_id, wins per request."""
    start = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    hits = requests.withColumn("__id", F.monotonically_increasing_id()).join(mappings, ["instrument_id", "provider"]).where((start <= F.col(day)) & (end >= F.col(day)))
    rest = [c for c in mappings.columns if c not in ("instrument_id", "provider")]
    best = F.max_by(F.struct(*rest), F.struct(start, F.col("mapping_id")))
    return hits.groupBy("__id", *requests.columns).agg(best.alias("m")).select(*requests.columns, "m.*")


def _best_of_others(value: Column, owner: Column, w: Window) -> tuple[Column, Column]:
    """(top, runner-up part) of a running maximum by owner over the rows before this one: see
    :func:`first_shared_days`."""
    top = F.max(F.struct(value.alias("v"), owner.alias("o"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return top, F.when(top["o"] != owner, F.least(value, top["v"]))


def first_shared_days(rows: DataFrame, by: Sequence[str], owner: str) -> DataFrame:
    """``rows`` (valid_from, valid_to, mapping_id, ...) with ``shared_from``: the first day that an
    interval shares with one of another ``owner`` in the same group, null without any.

    Both sides of an overlap are told, an owner's own intervals never. One sweep per group and
    direction keeps the top two of the latest ends (earliest starts) by different owners: the
    runner-up is the maximum of what the top displaced or turned away. Open ends are unbounded; a
    reversed interval holds no day and is left out.
    """
    start, end = F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    zero = F.lit("0001-01-01").cast("date")
    rows = rows.withColumns({"__s": F.datediff(start, zero), "__e": F.datediff(end, zero)}).where("__s <= __e")
    forth = Window.partitionBy(*by).orderBy("__s", "mapping_id")
    back = Window.partitionBy(*by).orderBy(F.desc("__s"), F.desc("mapping_id"))
    own = F.col(owner)
    for name, value, w in (("e", F.col("__e"), forth), ("s", -F.col("__s"), back)):
        top, second = _best_of_others(value, own, w)
        rows = rows.withColumns({f"__top_{name}": top, f"__second_{name}": second})
        other = F.when(F.col(f"__top_{name}.o") != own, F.col(f"__top_{name}.v")).otherwise(F.max(f"__second_{name}").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn(f"__other_{name}", other)
    later = -F.col("__other_s")
    day = F.when(F.col("__s") <= F.col("__other_e"), start).when(later <= F.col("__e"), F.date_add(zero, later))
    return rows.withColumn("shared_from", day).drop(*[c for c in rows.columns if c.startswith("__")])


def overlapping_mappings(mappings: DataFrame) -> DataFrame:
    """(provider, provider_symbol, mapping_id, instrument_id, shared_from): every mapping of a provider
    symbol that is in force on a day when another instrument has the symbol too."""
    shared = first_shared_days(mappings, ["provider", "provider_symbol"], "instrument_id")
    return shared.where("shared_from is not null").select("provider", "provider_symbol", "mapping_id", "instrument_id", "shared_from")


def instruments_of_symbols(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """(symbol) -> the instruments of the symbols asked for, trimmed and in capitals, once each;
    blank and unknown symbols have none."""
    asked = symbols.select(F.upper(F.trim("symbol")).alias("canonical_symbol")).where("canonical_symbol <> ''").distinct()
    return asked.join(instruments, "canonical_symbol")


def issuers_of_symbols(symbols: DataFrame, instruments: DataFrame, securities: DataFrame) -> DataFrame:
    """(symbol) -> (symbol, cik): the instrument's issuer, else the primary security's."""
    primary = primary_securities(securities)
    return (
        symbols.join(instruments.select(F.col("canonical_symbol").alias("symbol"), "issuer_cik"), "symbol", "left")
        .join(primary.select(F.col("ticker").alias("symbol"), F.col("cik").alias("__primary")), "symbol", "left")
        .select("symbol", F.coalesce("issuer_cik", "__primary").alias("cik"))
    )


def primary_securities(securities: DataFrame) -> DataFrame:
    """One (ticker, cik) per ticker: primary ones first, then the smallest cik."""
    rank = F.struct((~F.coalesce("is_primary", F.lit(False))).alias("p"), F.col("cik"))
    return securities.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.min_by("cik", rank).alias("cik"))


def search_facts(facts: DataFrame, securities: DataFrame, ticker: str, concept: str | None = None, limit: int = 50) -> DataFrame:
    """A ticker's facts, concept matched as a case-insensitive substring (% and _ are
    wildcards), newest period first."""
    own = primary_securities(securities).where(F.col("ticker") == F.upper(F.trim(F.lit(ticker))))
    found = facts.join(F.broadcast(own.select("cik", "ticker")), "cik")
    if concept:
        found = found.where(F.lower("concept").like(f"%{concept.lower()}%"))
    return found.orderBy(F.desc_nulls_last("end_date"), F.desc("available_at"), "fact_id").limit(limit)


def filings_of(filings: DataFrame, securities: DataFrame, ticker: str, form: str | None = None, limit: int = 50) -> DataFrame:
    """A ticker's filings, newest first, of one form if given."""
    own = primary_securities(securities).where(F.col("ticker") == F.upper(F.trim(F.lit(ticker))))
    found = filings.join(F.broadcast(own.select("cik")), "cik", "left_semi")
    if form:
        found = found.where(F.upper("form") == form.upper())
    return found.orderBy(F.desc("filing_date"), F.desc_nulls_last("acceptance_datetime"), F.desc("accession_number")).limit(limit)


def annual_periods(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(cik, as_of) -> (cik, as_of, fiscal_year): fiscal years with a known annual fact."""
    annual = facts.where((F.upper("fiscal_period") == "FY") & F.col("fiscal_year").isNotNull()).groupBy("cik", "fiscal_year").agg(F.min("available_at").alias("__first"))
    return requests.select("cik", "as_of").distinct().join(annual, "cik").where(F.col("__first") <= F.col("as_of")).select("cik", "as_of", "fiscal_year")


def latest_annual(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(cik, as_of) -> newest fiscal year known then; requests without one drop out."""
    return annual_periods(facts, requests).groupBy("cik", "as_of").agg(F.max("fiscal_year").alias("fiscal_year"))

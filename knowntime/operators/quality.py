"""Data quality: duplicates, validation, coverage, keys and references. Frames of findings, never exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowntime.functions.scalars import ohlcv_faults
from knowntime.operators.pit import first_shared_days, overlapping_mappings

BAR_VALUES = ("open", "high", "low", "close", "volume", "currency", "exchange_timezone")
BAR_KEY = ("instrument_id", "provider", "trading_date", "adjustment_mode")
WINDOW_DAYS, OVERLAP_DAYS = 400, 2
TASK_ROWS = 500_000  # of a merge: some 100 MB to sort


def tasks_for(rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks of ``task_rows`` rows each. Up to 200 tasks (``spark.shuffle.sort.bypassMergeThreshold``) a shuffle
    is written without holding its rows, so there are no more until a task has four times as many."""
    return 1 + max(min(rows // task_rows, 199), rows // (4 * task_rows))


def agreed(bars: DataFrame, values: Sequence[str], held: Column) -> tuple[Column, Column]:
    """Aggregates over the rows that ``held`` names: whether their bar values are all the same (no text is
    as an empty one), and the least row, null for none.

    Least and greatest values tell the first, so one sort serves and no row is copied to count distinct ones."""
    types = dict(bars.dtypes)
    same = F.when(held, F.struct(*[F.coalesce(c, F.lit("")).alias(c) if types[c] == "string" else F.col(c) for c in BAR_VALUES if c in values]))
    return F.min(same).eqNullSafe(F.max(same)), F.min(F.when(held, F.struct(*values)))


def dedup_bars(bars: DataFrame, by: Sequence[str] = ("symbol", "adjustment_mode", "trading_date"), tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, counts): identical repeats of a date keep one; a date whose values conflict goes entirely.

    ``counts`` holds accepted, duplicate and conflicting rows per (symbol, adjustment_mode). Rows are
    dealt by date before they are grouped, so only ``tasks`` (see :func:`tasks_for`) decides what a task holds.
    """
    values = [c for c in bars.columns if c not in by]
    alike, row = agreed(bars, values, F.lit(True))
    grouped = bars.repartition(*([tasks] if tasks else []), *by).groupBy(*by).agg(F.count("*").alias("__n"), row.alias("__row"), alike.alias("__alike"))
    kept = grouped.where("__alike").select(*by, "__row.*").select(bars.columns)
    counts = grouped.groupBy(*[c for c in by if c != "trading_date"]).agg(
        F.count_if("__alike").alias("accepted"), F.sum(F.when(F.col("__alike"), F.col("__n") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(~F.col("__alike"), F.col("__n")).otherwise(0)).alias("conflicting")
    )
    return kept, counts


def merge_windows(windows: DataFrame, by: Sequence[str] = ("symbol", "adjustment_mode", "trading_date")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlapping fetch windows -> (bars, counts, series whose currency or zone changes)."""
    kept, counts = dedup_bars(windows.drop("window_start", "window_end"), by)
    series = [c for c in by if c != "trading_date"]
    changed = windows.groupBy(*series).agg(F.count_distinct("currency").alias("currencies"), F.count_distinct("exchange_timezone").alias("zones")).where("currencies > 1 or zones > 1")
    return kept.join(changed.select(*series), series, "left_anti"), counts, changed


def date_windows(requests: DataFrame, days: int = WINDOW_DAYS, overlap: int = OVERLAP_DAYS) -> DataFrame:
    """(…, start_date, end_date) -> rows with window_start, window_end covering the range with overlap."""
    starts = F.sequence("start_date", "end_date", F.make_dt_interval(F.lit(days - overlap)))
    rows = requests.where("start_date <= end_date").withColumn("window_start", F.explode(starts))
    rows = rows.where((F.col("window_start") == F.col("start_date")) | (F.date_add("window_start", overlap - 1) < F.col("end_date")))
    return rows.withColumn("window_end", F.least(F.date_add("window_start", days - 1), F.col("end_date")))


def window_gaps(windows: DataFrame, bars: DataFrame, series: Sequence[str] = ("symbol",)) -> DataFrame:
    """Windows with bar counts and ``gap``: interior (empty between filled ones), leading, or null.

    Bars and both ends of the windows lie on one time axis; a window holds the bars counted up to
    its end less those before its start. One shuffle by series serves all steps, nothing is paired."""
    key = [*series, "window_start", "window_end"]
    at = lambda c, side: F.unix_date(F.col(c).cast("date")).cast("long") * 3 + side  # noqa: E731  start, bar, end of a day
    asked = windows.select(*key, F.explode(F.array(at("window_start", 0), at("window_end", 2))).alias("__at"))
    held = bars.dropna(subset=[*series, "trading_date"]).select(*series, at("trading_date", 1).alias("__at"))
    axis = Window.partitionBy(*series).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    side = F.pmod("__at", F.lit(3))
    seen = asked.unionByName(held, allowMissingColumns=True).withColumn("__seen", F.count_if(side == 1).over(axis)).where((side != 1) | side.isNull())
    inside = F.max(F.when(side == 2, F.col("__seen"))) - F.max(F.when(side == 0, F.col("__seen")))
    counted = seen.groupBy(*key).agg(inside.alias("bars")).withColumn("bars", F.when(F.col("window_start") <= F.col("window_end"), F.col("bars")).otherwise(F.lit(0)))
    w = Window.partitionBy(*series)
    before = F.max("bars").over(w.orderBy("window_start", "window_end").rowsBetween(Window.unboundedPreceding, -1))
    # backwards, as a running maximum: a frame up to the last row would be read again for each row
    after = F.max("bars").over(w.orderBy(F.desc("window_start"), F.desc("window_end")).rowsBetween(Window.unboundedPreceding, -1))
    empty, filled = F.col("bars") == 0, F.coalesce(after, F.lit(0)) > 0
    return counted.withColumn("gap", F.when(empty & filled & (F.coalesce(before, F.lit(0)) > 0), "interior").when(empty & filled, "leading"))


def known_zones(spark: SparkSession) -> DataFrame:
    """(zone): time zones that Spark's functions take; some hundreds."""
    return spark.createDataFrame([(z,) for z in sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())], "zone string")


def with_known_zone(df: DataFrame, zones: DataFrame, column: str = "exchange_timezone") -> DataFrame:
    """``column`` nulled where it is not in ``zones(zone)``; an unknown zone would stop the job."""
    known = F.broadcast(zones.select(F.col("zone").alias("__zone")).distinct())
    return df.join(known, df[column] == F.col("__zone"), "left").withColumn(column, F.col("__zone")).drop("__zone")


def accept_bars(bars: DataFrame, start: str, end: str, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected with reasons, counts per symbol and mode)."""
    day = F.col("trading_date")
    more = F.array_compact(F.array(F.when(day > F.lit(today).cast("date"), F.lit("future_date")), F.when((day < F.lit(start).cast("date")) | (day > F.lit(end).cast("date")), F.lit("outside_request"))))
    marked = bars.withColumn("reasons", F.concat(ohlcv_faults(*[F.col(c) for c in ("open", "high", "low", "close", "volume")]), more))
    counts = marked.groupBy("symbol", "adjustment_mode").agg(F.count("*").alias("rows"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected"))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0), counts


def fetch_starts(requests: DataFrame, ranges: DataFrame, overlap: int = 5) -> DataFrame:
    """Incremental start: the stored end less ``overlap`` days, or the full range when it begins earlier."""
    joined = requests.join(ranges.select("instrument_id", "adjustment_mode", "first_date", "last_date"), ["instrument_id", "adjustment_mode"], "left")
    full = F.col("last_date").isNull() | (F.col("start_date") < F.col("first_date"))
    return joined.withColumn("fetch_start", F.when(full, F.col("start_date")).otherwise(F.greatest("start_date", F.date_sub("last_date", overlap))))


def ingest_status(modes: DataFrame) -> DataFrame:
    """(run_id, mode, committed, clean) -> (run_id, status)."""
    return modes.groupBy("run_id").agg(F.sum("committed").alias("rows"), F.bool_and("clean").alias("clean")).select("run_id", F.when(F.coalesce("rows", F.lit(0)) == 0, "failed").when(F.col("clean"), "success").otherwise("partial").alias("status"))


def mapping_coverage(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """(instrument_id, provider, start_date, end_date) -> provider_symbol and reason.

    Primary mappings that touch the range must name one symbol and leave no day
    out: no_mapping, multiple_symbols or coverage_gap otherwise.
    """
    own = mappings.where("is_primary").select("instrument_id", "provider", "provider_symbol", F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("f"), F.coalesce("valid_to", F.lit("9999-12-30").cast("date")).alias("t"))
    hit = requests.join(own, ["instrument_id", "provider"]).where((F.col("f") <= F.col("end_date")) & (F.col("t") >= F.col("start_date")))
    key = ["instrument_id", "provider", "start_date", "end_date"]
    w = Window.partitionBy(*key).orderBy("f", "t").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("reach", F.coalesce(F.max("t").over(w), F.date_sub("start_date", 1)))
    found = hit.groupBy(*key).agg(F.count_distinct("provider_symbol").alias("symbols"), F.min("provider_symbol").alias("provider_symbol"), F.bool_or(F.col("f") > F.date_add("reach", 1)).alias("hole"), F.max("t").alias("last"))
    reason = F.when(F.col("symbols").isNull(), "no_mapping").when(F.col("symbols") > 1, "multiple_symbols").when(F.col("hole") | (F.col("last") < F.col("end_date")), "coverage_gap")
    return requests.join(found, key, "left").select(*key, F.when(reason.isNull(), F.col("provider_symbol")).alias("provider_symbol"), reason.alias("reason"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_references(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def mapping_violations(mappings: DataFrame) -> DataFrame:
    """(mapping_id, violation): reversed validity, symbol reuse across instruments, two primaries of
    an instrument at once; both sides of an overlap are told."""
    reverse = mappings.where("valid_from > valid_to").select("mapping_id", F.lit("validity_reversed").alias("violation"))
    reuse = overlapping_mappings(mappings).select("mapping_id", F.lit("symbol_reused").alias("violation"))
    twice = first_shared_days(mappings.where("is_primary"), ["instrument_id", "provider"], "mapping_id").where("shared_from is not null")
    return reverse.unionByName(reuse).unionByName(twice.select("mapping_id", F.lit("two_primaries").alias("violation")))


def ambiguous_securities(securities: DataFrame) -> DataFrame:
    return securities.groupBy("ticker").agg(F.count_distinct("cik").alias("issuers"), F.array_sort(F.collect_set("cik")).alias("ciks")).where("issuers > 1")

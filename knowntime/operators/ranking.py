"""Cross-sectional ranking: competition ranks, percentiles, exact top-N, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowntime.operators.pit import latest_annual


def _signed(value: Column, higher: Column) -> Column:
    """Ascending in display order, whatever the direction."""
    return F.when(higher, -value).otherwise(value)


def rank_results(results: DataFrame, by: Sequence[str], value: str = "value", name: str = "ticker", higher: str = "higher_is_better") -> DataFrame:
    """Valid rows of each ``by`` group with rank, percentile, position and valid_count.

    Ties share a rank; percentile is 100 for the best and 0 for the last, 100 for a
    single row; position orders ties by name. A group without direction is refused.
    """
    key = _signed(F.col(value), F.col(higher))
    ranks = Window.partitionBy(*by).orderBy(key)
    order = Window.partitionBy(*by).orderBy(key, F.col(name))
    return (
        results.where(F.col("valid") & F.col(value).isNotNull() & F.col(higher).isNotNull())
        .withColumn("rank", F.rank().over(ranks))
        .withColumn("percentile", 100.0 * (1.0 - F.percent_rank().over(ranks)))
        .withColumn("position", F.row_number().over(order))
        .withColumn("valid_count", F.count("*").over(Window.partitionBy(*by)))
    )


def exclusions(results: DataFrame, universe: DataFrame, by: Sequence[str], name: str = "ticker") -> DataFrame:
    """(by, name, reason): what a ranking leaves out: invalid rows, names without any row,
    and groups whose measure has no direction."""
    bad = results.where(~F.col("valid") | F.col("value").isNull()).select(*by, name, F.coalesce("reason", F.lit("invalid")).alias("reason"))
    blind = results.where(F.col("valid") & F.col("higher_is_better").isNull()).select(*by, name, F.lit("no_ranking_direction").alias("reason"))
    gone = universe.join(results.select(*by, name).distinct(), [*by, name], "left_anti").select(*by, name, F.lit("unresolved").alias("reason"))
    return bad.unionByName(blind).unionByName(gone)


def exact_top_n(results: DataFrame, by: Sequence[str], n: Column | int, name: str = "ticker", year: str = "fiscal_year") -> DataFrame:
    """The first ``n`` positions of each group, never more on ties; groups with fewer valid
    rows have none. ``mixed_fiscal_periods`` tells whether their years differ."""
    limit = F.lit(n) if isinstance(n, int) else n
    top = rank_results(results, by, name=name).where((F.col("valid_count") >= limit) & (F.col("position") <= limit))
    return top.withColumn("mixed_fiscal_periods", F.size(F.collect_set(year).over(Window.partitionBy(*by))) > 1)


def latest_year_signals(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(cik, as_of) -> factor requests for the newest annual period known then, no fallback."""
    return latest_annual(facts, requests).withColumn("fiscal_period", F.lit("FY"))

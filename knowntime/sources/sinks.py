"""Sinks: replacement and upsert by key, change classes, run logs, results, exports.

A Parquet path cannot be overwritten while it is read, so merges return frames. Stores of
several tables are written under a new generation, which one small file commits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowntime.functions.scalars import request_fingerprint
from knowntime.functions.scratch import Folder
from knowntime.operators.quality import BAR_KEY, mapping_violations


def replace_by_key(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the incoming keys replaced, others kept."""
    return base.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Insert new keys, update the others' columns; ``keep`` columns stay as first stored.

    Null keys are equal to each other. Of several incoming rows of a key the greatest counts.
    """
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row")).select(*keys, *([f"__row.{c}" for c in rest]))
    old, new = base.alias("o"), one.withColumn("__there", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    there = F.col("n.__there").isNotNull()
    out = []
    for c in base.columns:
        if c in keys or c in keep:
            out.append(F.coalesce(f"o.{c}", f"n.{c}" if c in incoming.columns else f"o.{c}").alias(c))
        elif c in incoming.columns:
            out.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def classify_bars(base: DataFrame, incoming: DataFrame, keys: Sequence[str] = BAR_KEY, ignore: Sequence[str] = ("fetched_at",)) -> tuple[DataFrame, DataFrame]:
    """(merged, counts): each incoming bar is inserted, updated or unchanged; ``ignore`` columns do not make a change."""
    values = [c for c in base.columns if c not in keys]
    same = F.lit(True)
    for c in values:
        if c not in ignore:
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    marked = incoming.alias("n").join(base.withColumn("__old", F.lit(True)).alias("o"), list(keys), "left").select(
        *keys, *[F.col(f"n.{c}").alias(c) for c in values], F.when(F.col("o.__old").isNull(), "inserted").when(same, "unchanged").otherwise("updated").alias("change"),
        F.struct(*[F.col(f"o.{c}").alias(c) for c in values]).alias("old"),
    )
    kept = F.col("change") == "unchanged"
    fresh = marked.select(*keys, *[F.when(kept, F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in values])
    return replace_by_key(base, fresh.select(base.columns), keys), marked.groupBy("change").agg(F.count("*").alias("rows"))


def enrich(base: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): null identity fields are filled, missing keys created; a field that
    differs from what is stored is a conflict row and changes nothing."""
    joined = base.alias("o").join(incoming.select(key, *fields).alias("n"), key, "full_outer")
    clash = F.array_compact(F.array(*[F.when(F.col(f"o.{f}") != F.col(f"n.{f}"), F.lit(f)) for f in fields]))
    marked = joined.withColumn("conflict", clash)
    others = [F.col(f"o.{c}") for c in base.columns if c != key and c not in fields]
    fill = [F.when(F.size("conflict") == 0, F.coalesce(f"o.{f}", f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields]
    return marked.select(key, *fill, *others).select(base.columns), marked.where(F.size("conflict") > 0).select(key, "conflict")


def confirm_metadata(instruments: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruments, conflicts): the first trusted currency and zone replace placeholders and
    confirm the row; later ones must agree."""
    seen = observed.groupBy("instrument_id").agg(F.min("currency").alias("__c"), F.min("exchange_timezone").alias("__z"), F.count_distinct("currency", "exchange_timezone").alias("__k"))
    joined = instruments.join(seen, "instrument_id", "left")
    done = F.coalesce("metadata_confirmed", F.lit(False))
    clash = F.coalesce((F.col("__k") > 1) | (done & ((F.col("__c") != F.col("currency")) | (F.col("__z") != F.col("exchange_timezone")))), F.lit(False))
    take = ~done & ~clash & F.col("__c").isNotNull()
    new = {"currency": F.when(take, F.col("__c")).otherwise(F.col("currency")), "exchange_timezone": F.when(take, F.col("__z")).otherwise(F.col("exchange_timezone")), "metadata_confirmed": done | take}
    marked = joined.withColumn("__clash", clash)
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in instruments.columns]), marked.where("__clash").select("instrument_id", F.col("__c").alias("currency"), F.col("__z").alias("exchange_timezone"))


FACTOR_VALUE_KEY = ("cik", "factor", "fiscal_year", "fiscal_period", "as_of")
FACTOR_VALUES = "cik string, factor string, fiscal_year int, fiscal_period string, as_of timestamp, value double, valid boolean, reason string, run_id string, updated_at timestamp"
FACTOR_RUNS = "run_id string, cik string, factor string, fiscal_year int, fiscal_period string, as_of timestamp, status string, created_at timestamp"


def append_factor_results(path: str, results: DataFrame, run_id: str, at: str) -> None:
    """One run's results (FACTOR_VALUE_KEY, value, valid, reason) as a new version of their keys,
    valid or not, and its run log rows; a run written again under its id replaces itself.

    The store is a log partitioned by run: nothing is read or rewritten, the latest version of
    a key counts (:func:`read_factor_values`).
    """
    stamped = results.withColumns({"run_id": F.lit(run_id), "updated_at": F.lit(at).cast("timestamp")})
    types = {x.split(" ")[0]: x.split(" ")[1] for x in FACTOR_VALUES.split(", ")}
    values = stamped.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    log = values.select("run_id", *FACTOR_VALUE_KEY, F.when(F.coalesce("valid", F.lit(False)), "success").otherwise("unavailable").alias("status"), F.col("updated_at").alias("created_at"))
    for name, frame in (("values", values), ("runs", log)):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def latest_factor_values(versions: DataFrame) -> DataFrame:
    """The version that counts of each key: the latest update, ties to the greatest run id."""
    rest = [c for c in versions.columns if c not in FACTOR_VALUE_KEY]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "run_id", F.coalesce("valid", F.lit(False)).alias("ok"), "value"))
    return versions.groupBy(*FACTOR_VALUE_KEY).agg(newest.alias("r")).select(*FACTOR_VALUE_KEY, *[f"r.{c}" for c in rest])


def read_factor_values(spark: SparkSession, path: str) -> DataFrame:
    return latest_factor_values(spark.read.schema(FACTOR_VALUES).parquet(f"{path}/values"))


def read_factor_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTOR_RUNS).parquet(f"{path}/runs")


def compact_factor_values(spark: SparkSession, path: str, to: str) -> None:
    """The store with superseded versions left out, under a new path; versions keep their run."""
    read_factor_values(spark, path).write.partitionBy("run_id").parquet(f"{to}/values")
    read_factor_runs(spark, path).write.partitionBy("run_id").parquet(f"{to}/runs")


def lookup_factor_values(values: DataFrame, requests: DataFrame) -> DataFrame:
    """(FACTOR_VALUE_KEY) -> the requests whose current version is valid, with its value; a key
    whose latest run was not valid has none, whatever was stored before."""
    return requests.join(values.where(F.col("valid") & F.col("value").isNotNull()), list(FACTOR_VALUE_KEY))


def upsert_mappings(base: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, violations): symbol mappings upserted by mapping_id, unless the outcome would
    break an invariant: incoming rows on either side of a violation stay out, what is stored
    stays. Of incoming rows that break one with each other none enters."""
    tried = upsert(base, incoming, ["mapping_id"], keep=())
    bad = mapping_violations(tried).join(incoming.select("mapping_id").distinct(), "mapping_id", "left_semi")
    fine = incoming.join(bad.select("mapping_id").distinct(), "mapping_id", "left_anti")
    return upsert(base, fine, ["mapping_id"], keep=()), bad


def latest_success(runs: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    rest = [c for c in runs.columns if c not in by]
    return runs.where("status = 'success'").groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("finished_at", "run_id")).alias("r")).select(*by, "r.*")


CHILDREN = ("equity", "transitions", "rebalances")


def _generations(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in Folder(spark, path).names("_commits") if n.isdigit())


def write_backtest(result: dict[str, DataFrame], path: str) -> str:
    """All frames of the runs under a new generation, then its commit; returns the generation.

    The commit is one small file moved into place, so a write that fails on the way leaves
    nothing that a reader sees, and a run written again is replaced whole. One writer at a time.
    """
    spark = result["runs"].sparkSession
    folder, done = Folder(spark, path), _generations(spark, path)
    number = f"{int(done[-1]) + 1 if done else 0:010d}"
    for name in (*CHILDREN, "runs"):
        result[name].write.mode("overwrite").parquet(f"{path}/{name}/generation={number}")
    folder.put(f"_commits/{number}", "")
    return number


def _committed(spark: SparkSession, path: str, name: str, generations: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/generation={g}" for g in generations])
    return rows.withColumn("generation", F.lpad(F.col("generation").cast("string"), 10, "0"))


def read_backtest(spark: SparkSession, path: str, run_ids: Sequence[str] | None = None) -> DataFrame:
    """One row per stored run, of its last committed generation, with its ordered children as arrays."""
    generations = _generations(spark, path)
    if not generations:
        raise FileNotFoundError(f"no run was committed to {path}")
    runs = _committed(spark, path, "runs", generations)
    runs = runs if run_ids is None else runs.where(F.col("run_id").isin(*run_ids))
    last = runs.groupBy("run_id").agg(F.max("generation").alias("generation"))
    runs = runs.join(last, ["run_id", "generation"], "left_semi")
    for name in reversed(CHILDREN):
        rows = _committed(spark, path, name, generations).join(last, ["run_id", "generation"], "left_semi")
        cols = [c for c in rows.columns if c not in ("run_id", "generation")]
        first = [c for c in ("decision_date", "symbol", "trading_date") if c in cols]
        runs = runs.join(rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*first, *[c for c in cols if c not in first]))).alias(name)), "run_id", "left")
    return runs.drop("generation")


def vacuum_backtests(spark: SparkSession, path: str) -> None:
    """Delete generations that no run needs any more, and what failed writes have left."""
    generations, folder = _generations(spark, path), Folder(spark, path)
    if not generations:
        return
    runs = _committed(spark, path, "runs", generations).groupBy("run_id").agg(F.max("generation").alias("generation"))
    needed = {r["generation"] for r in runs.select("generation").distinct().collect()}  # generations, not runs
    for number in set(generations) - needed:
        folder.delete(f"_commits/{number}")
    for name in (*CHILDREN, "runs"):
        for entry in folder.names(name):
            if entry.startswith("generation=") and entry.split("=")[1] not in needed:
                folder.delete(f"{name}/{entry}")


def json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, fields in name order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def export_json(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One JSON object per row, fields in name order, rows in key order."""
    json_rows(df.orderBy(*keys)).write.text(path)


def backtest_documents(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """(run_id, document): a stored run with its request, the request's fingerprint and its
    children as one JSON object; figures that don't exist are left out."""
    fields = [c for c in requests.columns if c != "run_id"]
    economic = {c: F.col(c) for c in fields if c not in ("name", "description")}
    asked = requests.select("run_id", F.struct(*fields).alias("request"), request_fingerprint(economic).alias("fingerprint"))
    both = stored.join(asked, "run_id")
    return both.select("run_id", F.to_json(F.struct(*sorted(both.columns))).alias("document"))


def evenly_spaced(points: DataFrame, by: Sequence[str], order: str, limit: int = 2000) -> DataFrame:
    """At most ``limit`` points of each series, both ends kept, spaced evenly by position."""
    w = Window.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    slot = lambda k: F.round(k * (F.lit(limit - 1) / (F.col("__n") - 1)))
    rows = points.withColumn("__i", i).withColumn("__n", n)
    chosen = (F.col("__n") <= limit) | (F.col("__i") == 0) | (slot(F.col("__i")) > slot(F.col("__i") - 1))
    return rows.where(chosen).drop("__i", "__n")


def finite_segments(points: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of consecutive finite values: (by, segment, first, last, points)."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    rows = points.withColumn("__gap", gap).withColumn("segment", F.sum(F.col("__gap").cast("int")).over(w)).where(~F.col("__gap"))
    return rows.groupBy(*by, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("points"))

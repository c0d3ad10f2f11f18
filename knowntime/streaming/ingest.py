"""Incremental ingest with Structured Streaming: bars and facts from files, merged batch by batch.

A store is a folder of row files and a manifest, a small text file that names what is live.
A batch writes its rows under its own number, then moves one new manifest into place, so
readers see a batch whole or not at all. A replayed batch starts from the manifest before
it and writes the same again. What a manifest no longer names is listed in it (its
tombstones) and deleted by the batch after it; only the last two manifests stay. So what the
driver reads follows the live store, never the number of batches.

Bars live in months: a batch rewrites the months that it touches. Facts are a log: a batch
appends what it brings, and ``FAN`` segments of a level merge into one of the next, so a fact
is written again a logarithmic number of times; of equal ids the first known counts at reading
as at merging. No watermark is set on ``available_at``: backfilled filings arrive years after it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knowntime.functions.scalars import ohlcv_faults
from knowntime.functions.scratch import Folder
from knowntime.operators.pit import first_known
from knowntime.operators.quality import BAR_KEY, TASK_ROWS, agreed, tasks_for

FAN = 8


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict:
    """What the last batch (below ``before``) left live, {} before the first."""
    folder = Folder(spark, path)
    numbers = [int(n) for n in folder.names("_manifests") if n.isdigit() and (before is None or int(n) < before)]
    return json.loads(folder.get(f"_manifests/{max(numbers):010d}")) if numbers else {}


def _commit(spark: SparkSession, path: str, number: int, old: dict, live: dict, gone: list[str]) -> None:
    """The manifest of batch ``number``; what its predecessor had given up is deleted."""
    folder = Folder(spark, path)
    folder.put(f"_manifests/{number:010d}", json.dumps({"live": live, "gone": gone}))
    for name in old.get("gone", []):
        folder.delete(f"rows/{name}")
    for name in folder.names("_manifests"):
        if name.isdigit() and int(name) < number - 1:
            folder.delete(f"_manifests/{name}")


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    """The rows of files or folders under ``rows``; None for none."""
    if not names:
        return None
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{n}" for n in names]).drop("batch", "part")


def _bars_of(spark: SparkSession, path: str, live: dict) -> DataFrame | None:
    return _rows(spark, path, [f"batch={b}/part={p}" for p, b in sorted(live.items())])


def read_bars(spark: SparkSession, path: str) -> DataFrame | None:
    """The bars of a store; None before its first."""
    return _bars_of(spark, path, manifest(spark, path).get("live", {}))


def read_facts(spark: SparkSession, path: str) -> DataFrame | None:
    """The facts of a store, the first known of each id; None before its first."""
    rows = _rows(spark, path, sorted(manifest(spark, path).get("live", {})))
    return None if rows is None else first_known(rows)


def _months(bars: DataFrame) -> dict[str, int]:
    """Rows by month; the driver holds months, not bars."""
    return {r["part"]: r["count"] for r in bars.groupBy(F.date_format("trading_date", "yyyy-MM").alias("part")).count().collect()}


def merge_bars(batch: DataFrame, number: int, path: str, task_rows: int = TASK_ROWS) -> None:
    """Rewrite the months that ``batch`` touches with its bars merged in. A day on which the batch
    contradicts itself leaves what is stored, as does a bar that only ``fetched_at`` parts from it.

    Stored and new rows meet in one shuffle and one sort, by pieces of months. Pieces and tasks
    grow with the rows, so a task sorts about ``task_rows`` of them, however large the batch."""
    spark = batch.sparkSession
    old = manifest(spark, path, number)
    live = dict(old.get("live", {}))
    sizes = _months(batch)
    if not sizes:
        return _commit(spark, path, number, old, live, [])
    rows = batch.withColumn("__new", F.lit(True))
    stored = _bars_of(spark, path, {p: live[p] for p in sizes if p in live})
    if stored is not None:
        rows = rows.unionByName(stored.select(batch.columns).withColumn("__new", F.lit(False)))
        sizes = {p: sizes[p] + n for p, n in (dict.fromkeys(sizes, 0) | _months(stored)).items()}
    tasks, pieces = tasks_for(sum(sizes.values()), task_rows), 1 + 4 * max(sizes.values()) // task_rows
    placed = rows.withColumns({"part": F.date_format("trading_date", "yyyy-MM"), "piece": F.pmod(F.xxhash64(*BAR_KEY), F.lit(pieces))}).repartition(tasks, "part", "piece")
    values = [c for c in batch.columns if c not in BAR_KEY]
    alike, new = agreed(batch, values, F.col("__new"))
    # grouped by the place too, so that neither the groups nor the files by month need another shuffle
    both = placed.groupBy("part", "piece", *BAR_KEY).agg(alike.alias("alike"), new.alias("n"), F.max(F.when(~F.col("__new"), F.struct(*values))).alias("o"))
    same = F.col("o").isNotNull()
    for c in values:
        if c != "fetched_at":
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    row = F.when(F.col("alike") & F.col("n").isNotNull() & ~same, F.col("n")).otherwise(F.col("o"))
    merged = both.select("part", *BAR_KEY, row.alias("row")).where("row is not null").select("part", *BAR_KEY, "row.*")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{path}/rows/batch={number}")
    names = set(Folder(spark, path).names(f"rows/batch={number}"))
    written = [p for p in sorted(sizes) if f"part={p}" in names]
    gone = [f"batch={live[p]}/part={p}" for p in written if p in live]
    _commit(spark, path, number, old, live | {p: number for p in written}, gone)


def append_facts(batch: DataFrame, number: int, path: str) -> None:
    """Append ``batch`` to the log; a level that is full becomes one segment of the next."""
    spark = batch.sparkSession
    old = manifest(spark, path, number)
    live, gone = dict(old.get("live", {})), []
    first_known(batch).write.mode("overwrite").parquet(f"{path}/rows/{number:010d}-0")
    live[f"{number:010d}-0"] = 0
    level = 0
    while len(full := sorted(n for n, k in live.items() if k == level)) >= FAN:
        name = f"{number:010d}-{level + 1}"
        first_known(_rows(spark, path, full)).write.mode("overwrite").parquet(f"{path}/rows/{name}")
        live = {n: k for n, k in live.items() if k != level} | {name: level + 1}
        gone += full
        level += 1
    _commit(spark, path, number, old, live, gone)


def _start(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()


def stream_bars(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Bars from new Parquet files (``files`` a batch at most): invalid rows and conflicting dates
    are dropped, the rest upserted."""

    def merge(batch: DataFrame, number: int) -> None:
        valid = batch.where(F.size(ohlcv_faults(*[F.col(c) for c in ("open", "high", "low", "close", "volume")])) == 0)
        merge_bars(valid, number, path)

    return _start(_source(spark, source, schema, files), checkpoint, merge)


def stream_facts(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Facts from new Parquet files; of equal fact_ids the earliest availability stays."""
    return _start(_source(spark, source, schema, files), checkpoint, lambda batch, number: append_facts(batch, number, path))


def _source(spark: SparkSession, source: str, schema: str, files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source)

"""Helpers shared by the text operators: scratch tables, components, frequent keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent and the whole of Spark is one process (unit tests), one
    temporary folder per application is used instead; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_scratch:
            _own_scratch[app] = tempfile.mkdtemp(prefix="knowntime-")
        base = _own_scratch[app]
    return f"{base.rstrip('/')}/knowntime-{uuid.uuid4().hex}"


def stash(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs a re-read of Parquet, never a recomputation.
    """
    path = scratch(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._knowntime_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stash`; it must not be read again."""
    path = getattr(df, "_knowntime_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after bounding the rows that Python workers of its session hold at a time.

    Texts can be long; workers share an executor's memory outside the heap. The session keeps
    the setting, as plans are run later than they are made.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_part(doc_id, folds: int, held_out: int):
    """True where crc32 of the id's text is not ``held_out`` modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out, F.lit(True))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, component), component = smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edge set is a forest of stars. Each step is a minimum per node (summed on
    the map side) and a join back (split by AQE when a hub is hot); only a count
    and two checksums of the edges reach the driver. Nodes without links do not
    appear. Null ids and self links are ignored.
    """
    e = stash(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = stash(small)
        now = new.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("u", "v")).alias("x"),
            F.bit_xor(F.xxhash64("v", "u")).alias("y"),
        ).first()
        release(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def frequent(counts: DataFrame, most: int) -> tuple[int, DataFrame]:
    """(t, keys with n >= t) of a (key, n) table, for the least t on a grid that leaves
    ``most`` keys or fewer: a head of proven size, however keys are distributed.

    The grid is an eighth of an octave wide, so a few hundred counts reach the driver.
    """
    grid = counts.groupBy(F.floor(F.log2("n") * 8).alias("g")).agg(F.count("*").alias("keys"), F.min("n").alias("n")).collect()
    least, total = None, 0
    for row in sorted(grid, key=lambda r: -r["g"]):
        total += row["keys"]
        if total > most:
            break
        least = row["n"]
    least = least if least is not None else (1 << 62)
    return least, counts.where(F.col("n") >= F.lit(least))

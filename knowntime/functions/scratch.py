"""Intermediate tables in the cluster's shared folder, and small files beside tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Without the setting, and with all of Spark in one process (unit tests), one
    temporary folder per application serves; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="knowntime-")
    return f"{base.rstrip('/')}/knowntime-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a new scratch path and read it back.

    Cuts the lineage of frames that several later steps use; a lost executor costs a
    re-read.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Files of one folder through Hadoop's file system, local or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._type = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._type(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._type(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def names(self, name: str) -> list[str]:
        there = self.at(name)
        return [f.getPath().getName() for f in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def put(self, name: str, text: str) -> None:
        """Write ``text`` beside its place and move it there."""
        hidden = self.at(name + ".new")
        out = self._fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self.at(name), False)
        self._fs.rename(hidden, self.at(name))

    def get(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

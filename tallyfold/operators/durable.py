"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where none is set and everything runs on one machine, a folder of its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Tables:
    """Tables of one computation; a table that a later one replaces can be dropped, the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self._delete, self.base)

    def _delete(self, path: str) -> None:
        try:
            jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder is scratch space
            pass

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n:03d}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, table: DataFrame) -> None:
        path = self.paths.pop(id(table), None)
        if path:
            self._delete(path)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, read from a written table."""
    return Tables(df.sparkSession, name).save(df)

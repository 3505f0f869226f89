"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it: space and 0x09-0x0D.
WS_CLASS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session when it is set.  Only where it is
    unset (tests, local mode) a folder of this process is made and set.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Written tables of one operator run under the shared folder.

    ``save`` cuts lineage with a Parquet table, so a lost executor costs a
    re-read and not a recomputation of every earlier round.  ``drop`` removes a
    table that a later round has replaced; what is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit; the folder is scratch space
            pass

    def save(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{self.base}/{self.n:03d}-{name}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str | None) -> None:
        if path:
            self._delete(path)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.base)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, or names like them that the table has no column of, for columns that are dropped again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def settle(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; later filters on ``names`` stay above their computation.

    Catalyst would copy a costly expression into every filter that it pushes
    down, and into each lambda that mentions it.  It pushes nothing through a
    generator, so the columns pass one as a single struct.
    """
    return df.select(*[F.col(c) for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def join_hot(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has a key once.

    Keys that hold more than 1/``share`` of the left rows are at most ``share``;
    their right rows are broadcast, so no key gathers in one task.  All other
    keys are shuffled.  ``left`` should be a written table: it is read three times.
    """
    total = left.count()
    many = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > total / share).filter(F.col("_n") > 1).select(key)
    hot = F.broadcast(right.join(F.broadcast(many), key))
    cold = left.join(F.broadcast(many), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(right, key))


def hand_back() -> None:
    """Gives the memory that a Python worker has freed back to the machine: workers outlive their tasks, and the next stage needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def volume(docs: DataFrame, text: str = "text") -> int:
    """Bytes of a text column, from one native scan."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5).cast("int")


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file; ``folder`` overrides where the files lie."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

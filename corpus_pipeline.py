"""A corpus pipeline: quality rules, near dedup, substring dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept, and returns the columns of ``documents`` (the last one:
packed pieces).  Between stages rows are written as Parquet in the shared
folder and read again, so a lost executor costs a stage's own work only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from tallyfold.llm.common import Scratch, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    rules = quality_rules.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c != "text"]
    judged = quality_rules.quality_rules(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_in"), "text"), rules)
    return judged.filter("kept").select(*["text" if c == "text" else F.col(f"_in.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id.

    Groups are 3-bit copies; the README gives the share of pairs at Jaccard 0.8 that they hold.
    """
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings are cut; ``n_chars`` follows the text.

    A character of which a cut took only some bytes goes as a whole.  A document
    of which the cuts leave nothing but white space goes.
    """
    out = suffix_dedup.suffix_dedup(docs, carry=True).withColumn("cut", F.size("spans") > 0)

    def decode(batches):
        for b in batches:
            text = pa.array([k.decode("utf-8", "ignore") for k in b.column("kept").to_pylist()], pa.string())
            yield pa.record_batch([text if n == "kept" else b.column(n) for n in b.schema.names], names=b.schema.names)

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    slim = out.select("doc_id", "kept", "cut", *(["carry"] if others else []))
    text = slim.mapInArrow(decode, "doc_id long, kept string, cut boolean" + (f", carry {slim.schema['carry'].dataType.simpleString()}" if others else ""))
    left = text.filter(~F.col("cut") | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[(made[c] if c in made else F.col(f"carry.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("suffix_dedup", substrings), ("decontaminate", benchmark), ("best_fit_packing", pack)]

#: SQL can't express the learned rules, the fingerprints or the packing; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

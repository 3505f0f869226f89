"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``keys`` and a column for each of ``wanted``: name -> ('cont' or 'disc', share); null values don't count.

    No buffer holds a group: rows are range-sorted by key and value, ranked inside
    their range, and a range's rows begin behind those of the same group in the
    ranges before, which are only counted.  A group that holds a third of all rows
    is spread over a third of the ranges.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ranged = durable(rows.repartitionByRange(n, *keys, "_v").withColumn("_p", F.spark_partition_id()), "quantiles")
    counts = ranged.groupBy("_p", *keys).agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("_p", *keys, before.alias("_before"), F.sum("_n").over(by_group).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_p", *keys).orderBy("_v"))
    ranked = ranged.withColumn("_i", local).join(spans, ["_p", *keys]).withColumn("_i", F.col("_i") + F.col("_before") - 1)
    spots = {}
    for name, (kind, q) in wanted.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low = F.floor(at) if kind == "cont" else F.greatest(F.ceil(F.col("_total") * F.lit(float(q))) - 1, F.lit(0))
        spots[name] = (low.cast("long"), (F.ceil(at) if kind == "cont" else low).cast("long"), at - F.floor(at) if kind == "cont" else F.lit(0.0))
    hit = None
    for low, high, _ in spots.values():
        one = (F.col("_i") == low) | (F.col("_i") == high)
        hit = one if hit is None else hit | one
    picked = ranked.filter(hit)
    aggs = []
    for name, (low, high, part) in spots.items():
        a, b = F.max(F.when(F.col("_i") == low, F.col("_v"))), F.max(F.when(F.col("_i") == high, F.col("_v")))
        aggs.append((a * (1 - F.max(part)) + b * F.max(part)).alias(name))
    return picked.groupBy(*keys).agg(*aggs)

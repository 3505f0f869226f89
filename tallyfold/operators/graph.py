"""Connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import Tables
from .relational import join_hot


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of the pairs ``u, v``: the smallest node it reaches.

    Each round a node takes its neighbours' smallest root and then that root's
    own, so the rounds grow with the logarithm of a chain's length.  A node with
    very many edges meets its root by broadcast, not in one task.
    """
    tables = Tables(pairs.sparkSession, "components")
    both = tables.save(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = tables.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = join_hot(both, now.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("r")).withColumnRenamed("u", "node")
        met = now.join(near, "node").select("node", F.least("root", "r").alias("root"))
        jump = met.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = tables.save(met.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        if not after.join(now, ["node", "root"], "left_anti").limit(1).count():
            return after
        tables.drop(now)
        now = after

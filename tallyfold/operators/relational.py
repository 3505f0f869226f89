"""Relational building blocks that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in a total order."""
    return top_per_key(df, keys, 1, *order).drop("rank")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """First k rows of each key with their ``rank``; Spark prunes per task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order with their ``rank``; cut before they are numbered, so the window sees k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys go."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for c in keys:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    return left.join(other, on, how).select(*[c for c in left.columns], *([] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]))


def join_hot(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of a written table with ``right``, which has a key once.

    Keys that hold more than 1/``share`` of the left rows are at most ``share``;
    their right rows are broadcast, so no key gathers in one task.
    """
    total = left.count()
    many = left.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > total / share) & (F.col("_n") > 1)).select(key)
    hot = F.broadcast(right.join(F.broadcast(many), key))
    cold = left.join(F.broadcast(many), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(right, key))


def single_or_null(value: str) -> Column:
    """The value of a group if it has just one, else null."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The page behind ``after`` in a total ascending order; the comparison can be pushed down."""
    if after is not None:
        df = df.filter(F.struct(*order) > F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after)]))
    return df.orderBy(*order).limit(size)


def keyset_page_before(df: DataFrame, order: list[str], before: tuple, size: int) -> DataFrame:
    """The page before a row, its rows in any order."""
    rows = df.filter(F.struct(*order) < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, before)]))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(size)


def positional_sample(df: DataFrame, key: str, size: int, ranges: int = 64) -> DataFrame:
    """``pos, key, within`` of ``size`` evenly spread positions among the rows in the order of an integer ``key``.

    Counts by key are cut into ranges of the key; running counts are made inside
    a range and begin at the sum of the ranges before it, of which there are few.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    lo, hi, total = counts.agg(F.min(key), F.max(key), F.sum("n")).first()
    if not total:
        return counts.select(F.col("n").alias("pos"), key, F.col("n").alias("within"))
    part = F.floor((F.col(key) - F.lit(lo)) * ranges / F.lit(hi - lo + 1)).cast("int")
    counts = counts.withColumn("_r", part)
    sums = {r["_r"]: r.n for r in counts.groupBy("_r").agg(F.sum("n").alias("n")).collect()}  # a row a range
    at, before = 0, []
    for r in range(ranges):
        before += [(r, at)]
        at += sums.get(r, 0)
    spark = df.sparkSession
    counts = counts.join(F.broadcast(spark.createDataFrame(before, "_r int, _at long")), "_r")
    running = counts.withColumn("_hi", F.col("_at") + F.sum("n").over(Window.partitionBy("_r").orderBy(key)))
    spots = spark.range(size).select(F.floor(F.col("id") * F.lit(total) / F.lit(size)).cast("long").alias("pos"))
    bounds = spark.createDataFrame([(r, a, a + sums.get(r, 0)) for r, a in before], "_r int, _from long, _to long")
    spots = spots.join(F.broadcast(bounds), (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))).select("pos", "_r")
    found = running.join(F.broadcast(spots), "_r").filter((F.col("pos") >= F.col("_hi") - F.col("n")) & (F.col("pos") < F.col("_hi")))
    return found.select("pos", key, (F.col("pos") - F.col("_hi") + F.col("n")).alias("within"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], fill_only: bool = False, owned: Column | None = None) -> DataFrame:
    """Rows of both by key.  New values win, or with ``fill_only`` fill nulls only; rows that ``owned`` denies stay as they are."""
    cols = [c for c in target.columns if c not in keys]
    new = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    change = F.col("_new") & (F.col("_old").isNull() | (F.lit(True) if owned is None else owned))
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if fill_only else F.col(f"_{c}")
    return both.select(*keys, *[F.when(F.coalesce(change, F.lit(False)), pick(c)).otherwise(F.col(c)).alias(c) for c in cols])


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_snapshot(old: DataFrame, new: DataFrame, least_share: float = 0.9) -> DataFrame:
    """The new snapshot, unless it shrank below the share of the old one."""
    n, m = old.count(), new.count()
    if m < least_share * n:
        raise ValueError(f"the new snapshot has {m} rows, the old one {n}")
    return new


def supersede(filings: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds ``superseded_by``: the greatest key of the group, null for that row itself."""
    top = F.max(key).over(Window.partitionBy(*group))
    return filings.withColumn("superseded_by", F.when(F.col(key) < top, top))


def zero_fill_days(counts: DataFrame, day: str, first: str, last: str, value: str) -> DataFrame:
    days = counts.sparkSession.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS {day}")
    return days.join(counts, day, "left").select(day, F.coalesce(value, F.lit(0).cast("long")).alias(value))

"""Set-similarity join by prefix filtering, and Jaro-Winkler."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _exploded(df: DataFrame, key: str, tokens: str, by: list[str]) -> DataFrame:
    return df.select(*by, key, tokens, F.size(tokens).alias("n"), F.explode(tokens).alias("_t"))


def _counts(df: DataFrame, key: str, tokens: str, by: list[str]) -> DataFrame:
    return _exploded(df, key, tokens, by).groupBy(*by, "_t").agg(F.count("*").alias("_df"))


def _rarest(df: DataFrame, counts: DataFrame, key: str, tokens: str, by: list[str], share: tuple[int, int]) -> DataFrame:
    """As many of each set's rarest tokens by ``counts`` as a partner must share one of; a token that is not counted comes first."""
    p, q = share
    t = _exploded(df, key, tokens, by).drop(tokens).join(counts, [*by, "_t"], "left").withColumn("_df", F.coalesce("_df", F.lit(0)).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy("_df", "_t"))
    return t.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1).drop("_rank")


def rare_tokens(left: DataFrame, right: DataFrame, key: str, tokens: str, by: list[str], share: tuple[int, int]) -> DataFrame:
    """The left side's rarest tokens, as many as a partner must share one of, with ``_df``: how many right rows have each (0: none)."""
    return _rarest(left, _counts(right, key, tokens, by), key, tokens, by, share)


def set_similarity_join(left: DataFrame, right: DataFrame, key: str, tokens: str, by: list[str], share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Pairs whose token sets share at least ``share`` of their union, within equal ``by`` columns.

    Exact: a pair above the threshold shares one of both sides' rarest tokens in one
    order, ``n - ceil(share * n) + 1`` of each set, so only those meet.
    Rarity is counted per ``by`` group; sizes prune before sets are compared, and
    the comparison uses whole numbers.  Candidates meet as keys only; the sets are
    joined to distinct candidates.  A key has one row within its ``by`` group.
    """
    p, q = share
    counts = _counts(right, key, tokens, by)
    lt = _rarest(left, counts, key, tokens, by, share).filter("_df > 0").select(*by, key, "n", "_t")
    rt = _rarest(right, counts, key, tokens, by, share).select(*by, F.col(key).alias("_rk"), F.col("n").alias("_rn"), "_t")
    fits = (F.col("n") * q >= F.col("_rn") * p) & (F.col("_rn") * q >= F.col("n") * p)
    met = lt.join(rt, [*by, "_t"]).filter(fits).select(*by, key, "_rk").distinct()
    common = F.size(F.array_intersect(tokens, "_rt"))
    union = F.size(tokens) + F.size("_rt") - common
    both = met.join(left.select(*by, key, tokens), [*by, key]).join(right.select(*by, F.col(key).alias("_rk"), F.col(tokens).alias("_rt")), [*by, "_rk"])
    return both.filter(common * q >= union * p).select(*by, key, F.col("_rk").alias(f"{key}_right"), (common / union).alias("similarity"))


def similar_classes(df: DataFrame, key: str, tokens: str, by: list[str], share: tuple[int, int] = (4, 5)) -> DataFrame:
    """All links of a table with itself: ``kind`` 'pair' between representatives and 'member' from a representative to each other row of its class.

    A class holds the rows of equal token sets within equal ``by`` columns, and its smallest key
    stands for it, so equal rows never make pairs among each other.  Rows without tokens have no links.
    Exact: two sets above the threshold share a token of both prefixes in one order of rarity.
    Candidates meet as keys only; the sets are joined to distinct candidates.
    """
    p, q = share
    rows = df.filter(F.size(tokens) > 0).select(*by, key, F.array_sort(tokens).alias("_s"))
    classes = rows.groupBy(*by, "_s").agg(F.min(key).alias("_rep"), F.collect_list(key).alias("_keys"))
    members = classes.select(*by, F.col("_rep").alias(key), F.explode("_keys").alias(f"{key}_right")).filter(F.col(key) != F.col(f"{key}_right"))
    sets = classes.select(*by, F.col("_rep").alias(key), "_s", F.size("_s").alias("n"))
    each = sets.select(*by, key, "n", F.explode("_s").alias("_t"))
    rare = each.groupBy(*by, "_t").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy("_df", "_t"))
    first = each.join(rare, [*by, "_t"]).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1)
    a = first.select(*by, "_t", key, "n")
    b = first.select(*by, "_t", F.col(key).alias("_rk"), F.col("n").alias("_rn"))
    fits = (F.col("n") * q >= F.col("_rn") * p) & (F.col("_rn") * q >= F.col("n") * p)
    met = a.join(b, [*by, "_t"]).filter((F.col(key) < F.col("_rk")) & fits).select(*by, key, "_rk").distinct()
    left = sets.select(*by, key, "_s")
    right = sets.select(*by, F.col(key).alias("_rk"), F.col("_s").alias("_rs"))
    common = F.size(F.array_intersect("_s", "_rs"))
    union = F.size("_s") + F.size("_rs") - common
    both = met.join(left, [*by, key]).join(right, [*by, "_rk"]).filter(common * q >= union * p)
    pairs = both.select(*by, key, F.col("_rk").alias(f"{key}_right"), F.lit("pair").alias("kind"), (common / union).alias("similarity"))
    return pairs.unionByName(members.withColumns({"kind": F.lit("member"), "similarity": F.lit(1.0)}))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    hit, used = [], [False] * m
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit.append(c)
                break
    k = len(hit)
    if not k:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(hit, other)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    same = 0
    while same < min(4, n, m) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


@pandas_udf(DoubleType())
def _jw(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Arrow-batched: Spark has no built-in for it."""
    return _jw(a, b)

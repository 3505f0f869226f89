"""Work that goes on where it stopped: due times, cursors, gated states, token buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.events import bucket_fold


def due(last: Column, hours: Column, now: str) -> Column:
    """Whether ``hours`` have passed since ``last``; what was never done is due."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return last.isNull() | (micros(last) < micros(F.lit(now)) - hours.cast("long") * 3_600_000_000)


def after_cursor(rows: DataFrame, cursors: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key behind its cursor; a key without one has not begun."""
    return rows.join(cursors, key).filter(F.col(order) > F.col("cursor")).drop("cursor")


def advance(cursors: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The cursors after those rows; they never go back."""
    new = rows.groupBy(key).agg(F.max(order).alias("_new"))
    return cursors.join(new, key, "full_outer").select(key, F.greatest("cursor", "_new").alias("cursor"))


def gated_status(asks: DataFrame, key: str, order: str, ask: str, opens: str = "candidate", closes: tuple[str, ...] = ("published", "rejected")) -> DataFrame:
    """``key, status``: the first decision behind the first opening; later ones and decisions on nothing don't count."""
    opened = asks.groupBy(key).agg(F.min(F.when(F.col(ask) == opens, F.col(order))).alias("_o"))
    first = asks.join(opened, key).filter(F.col(ask).isin(*closes) & (F.col(order) > F.col("_o"))).groupBy(key).agg(F.min_by(ask, order).alias("_s"))
    return opened.join(first, key, "left").select(key, F.when(F.col("_o").isNull(), "none").otherwise(F.coalesce("_s", F.lit(opens))).alias("status"))


def token_bucket(events: DataFrame, user: str, event: str, at: str, capacity: float, rate: float) -> DataFrame:
    """``user, event, granted``: a native fold over each user's events in order; the stream's operator keeps the same two numbers as state."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    seen = events.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(micros.alias("t"), F.col(event).alias("e")))).alias("es"))
    start = F.struct(F.lit(float(capacity)).alias("tokens"), F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<e:bigint,granted:boolean>>").alias("out"))

    def step(acc, x):
        filled = F.least(F.lit(float(capacity)), acc["tokens"] + F.coalesce((x["t"] - acc["last"]) / 1e6, F.lit(0.0)) * rate)
        ok = filled >= 1
        return F.struct(F.when(ok, filled - 1).otherwise(filled).alias("tokens"), x["t"].alias("last"), F.concat(acc["out"], F.array(F.struct(x["e"].alias("e"), ok.alias("granted")))).alias("out"))

    folded = seen.select(user, F.explode(F.aggregate("es", start, step, lambda acc: acc["out"])).alias("x"))
    return folded.select(user, F.col("x.e").alias(event), "x.granted")


__all__ = ["advance", "after_cursor", "bucket_fold", "due", "gated_status", "token_bucket"]

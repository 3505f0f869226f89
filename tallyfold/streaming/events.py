"""Structured Streaming over an event folder, with the batch twins of its aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone: the session's


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; the same call serves a batch and a stream with a watermark."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def tumbling_stream(events: DataFrame, lateness: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Late rows up to ``lateness`` count; a window is emitted once, when the watermark has passed it."""
    return tumbling(events.withWatermark("ts", lateness), width)


def distinct_stream(events: DataFrame, key: str = "event_id", lateness: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def enrich_stream(events: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    return events.join(dimension, on, "left")


def bucket_fold(rows: list[tuple[float, int]], tokens: float, last: float | None, capacity: float, rate: float):
    """Takes one token per event where there is one: (granted flags, tokens, last time)."""
    granted = []
    for at, _ in rows:
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, at - last) * rate)
        last = at if last is None else max(last, at)
        ok = tokens >= 1
        tokens -= 1 if ok else 0
        granted.append(ok)
    return granted, tokens, last


def token_bucket(events: DataFrame, capacity: float = 5.0, rate: float = 1 / 3600) -> DataFrame:
    """Rate limiting with keyed state: ``user_id, event_id, granted``.  State is two numbers per user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        at = rows["ts"].astype("int64") / (1e9 if str(rows["ts"].dtype).endswith("[ns]") else 1e6)
        granted, tokens, last = bucket_fold(list(zip(at, rows["event_id"])), tokens, last, capacity, rate)
        state.update((tokens, last))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].values, "granted": granted})

    out = "user_id long, event_id long, granted boolean"
    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, out, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)

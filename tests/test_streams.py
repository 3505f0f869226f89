"""Streams over files against their batch twins, late rows among them."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import incremental as I
from tallyfold.operators.quantiles import quantiles
from tallyfold.streaming import events as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture
def folder(spark, batch, tmp_path):
    day = F.dayofmonth("ts")
    for first, last in ((1, 8), (9, 16), (17, 24), (25, 31)):  # one after the other, as files arrive
        batch.filter(day.between(first, last)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_closed_windows_and_late_rows(spark, batch, folder, tmp_path):
    late = batch.filter("event_id = 0").withColumn("event_id", F.lit(-1).cast("long"))
    first = run(spark, E.tumbling_stream(E.read_events(spark, folder, batch.schema, 1)), tmp_path, "tumbled")
    want = {(r.start, r.event_type): (r.n, r.total) for r in E.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = {(r.start, r.event_type): (r.n, r.total) for r in first}
    assert got and all(want[k] == v for k, v in got.items())  # a window comes once, when it is closed
    top = max(k[0] for k in want)
    assert all((top - k[0]).total_seconds() < 4 * 3600 for k in set(want) - set(got))  # only those at the watermark are missing
    late.write.mode("append").parquet(folder)
    again = run(spark, E.tumbling_stream(E.read_events(spark, folder, batch.schema, 1)), tmp_path, "tumbled_late")
    assert sum(r.n for r in again) <= sum(v[0] for v in want.values()) + 1


def test_distinct(spark, batch, tmp_path):
    twice = batch.unionByName(batch.filter("event_id % 10 = 0")).orderBy("ts")
    twice.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "d"))
    got = run(spark, E.distinct_stream(E.read_events(spark, str(tmp_path / "d"), batch.schema)).select("event_id"), tmp_path, "distinct_ids")
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in batch.select("event_id").collect())


def test_enriched(spark, batch, folder, tmp_path):
    dim = spark.createDataFrame([("view", 1), ("click", 2)], "event_type string, weight int")
    got = run(spark, E.enrich_stream(E.read_events(spark, folder, batch.schema), dim, "event_type").select("event_id", "weight"), tmp_path, "enriched")
    want = {r.event_id: r.weight for r in batch.join(dim, "event_type", "left").collect()}
    assert {r.event_id: r.weight for r in got} == want


def test_token_bucket(spark, batch, tmp_path):
    batch.coalesce(1).write.parquet(str(tmp_path / "b"))
    got = run(spark, E.token_bucket(E.read_events(spark, str(tmp_path / "b"), batch.schema), 5.0, 1 / 36000.0), tmp_path, "bucket")
    want = {r.event_id: r.granted for r in I.token_bucket(batch, "user_id", "event_id", "ts", 5.0, 1 / 36000.0).collect()}
    assert {r.event_id: r.granted for r in got} == want and 0 < sum(want.values()) < len(want)


def test_cursors_never_go_back(spark):
    c = spark.createDataFrame([(1, 5), (2, 9)], "k int, cursor int")
    rows = spark.createDataFrame([(1, 7), (1, 3), (2, 4), (3, 1)], "k int, id int")
    assert sorted(map(tuple, I.after_cursor(rows, c, "k", "id").collect())) == [(1, 7)]
    assert sorted(map(tuple, I.advance(c, rows, "k", "id").collect())) == [(1, 7), (2, 9), (3, 1)]


def test_quantiles_of_one_large_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 613).cast("double")).alias("x"))
    got = {r.g: (r.a, r.b, r.c) for r in quantiles(df, ["g"], "x", {"a": ("cont", 0.5), "b": ("cont", 0.9), "c": ("disc", 0.99)}).collect()}
    want = df.groupBy("g").agg(F.percentile("x", 0.5), F.percentile("x", 0.9), F.expr("percentile_disc(0.99) within group (order by x)")).collect()
    assert got.keys() == {r[0] for r in want} and all(got[r[0]] == pytest.approx(tuple(r[1:]), rel=1e-12) for r in want)
    assert quantiles(df.limit(0), ["g"], "x", {"a": ("cont", 0.5)}).collect() == []

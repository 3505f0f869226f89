"""The SQL guard, streaming against batch, similarity against brute force, relational helpers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.operators import relational as R
from tallyfold.operators.search import WebQuery
from tallyfold.operators.similarity import _jaro_winkler, set_similarity_join
from tallyfold.plans.sql_guard import Guard, Refused
from tallyfold.streaming import events as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sql", ["SELECT count(*) FROM supplier", "WITH x AS (SELECT * FROM supplier) SELECT * FROM x WHERE s_suppkey IN (SELECT o_custkey FROM orders)", "SELECT 'drop table x; --' AS s FROM supplier", "SELECT upper(s_name) FROM supplier UNION SELECT 'a'"])
def test_guard_accepts(spark, sql):
    guard = Guard(frozenset({"supplier", "orders"}), frozenset({"count", "upper"}))
    guard.check(spark, sql)


@pytest.mark.parametrize("sql", ["", "DROP TABLE supplier", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT lower(s_name) FROM supplier", "SELECT * FROM supplier WHERE EXISTS (SELECT 1 FROM secrets)", "INSERT INTO supplier SELECT * FROM supplier", "WITH x AS (SELECT * FROM secrets) SELECT * FROM x", "SET a=b", "nonsense"])
def test_guard_refuses(spark, sql):
    guard = Guard(frozenset({"supplier", "orders"}), frozenset({"count", "upper"}))
    with pytest.raises(Refused):
        guard.check(spark, sql)


def test_guard_caps_rows(spark):
    spark.range(2000).createOrReplaceTempView("many")
    assert Guard(frozenset({"many"})).run(spark, "SELECT * FROM many").count() == 500


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    batch.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"), batch.schema)
    q = E.tumbling(stream.withWatermark("ts", "400 days")).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(100)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, E.tumbling(batch).collect()))


def test_token_bucket_fold():
    granted, tokens, last = E.bucket_fold([(0, 1), (0, 2), (0, 3), (5, 4)], 2.0, None, 2.0, 0.2)
    assert granted == [True, True, False, True] and tokens == 0 and last == 5


@pytest.mark.parametrize("share", [(4, 5), (1, 2)])
def test_similarity_join(spark, share):
    rnd = random.Random(9)
    sets = {(k, g): sorted({f"t{rnd.randint(0, 14)}" for _ in range(rnd.randint(1, 12))}) for k in range(40) for g in "ab"}
    left = spark.createDataFrame([(g, k, t) for (k, g), t in sets.items() if k % 2], "g string, k int, t array<string>")
    right = spark.createDataFrame([(g, k, t) for (k, g), t in sets.items()], "g string, k int, t array<string>")
    got = {(r.g, r.k, r.k_right) for r in set_similarity_join(left, right, "k", "t", ["g"], share).collect()}
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(g, k, j) for (k, g), t in sets.items() if k % 2 for j in range(40) if jac(t, sets[j, g]) >= share[0] / share[1]}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_winkler(a, b):
    import duckdb

    want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    if a and b:
        assert abs(_jaro_winkler(a, b) - want) < 1e-9


def test_web_query(spark):
    df = spark.createDataFrame([(1, "The quick-brown fox"), (2, "brown quick"), (3, "lazy dog"), (4, "fox news")], "k int, t string")
    ask = lambda q: sorted(r.k for r in df.filter(WebQuery.parse(q).matches(F.col("t"))).collect())
    assert ask('"quick brown"') == [1] and ask("quick brown") == [1, 2] and ask("fox -news or dog") == [1, 3] and ask("") == []


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, 5)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "b", 6), (3, "c", None)], "k int, x string, y int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.upsert(old, new, ["k"])) == [(1, "a", None), (2, "b", 6), (3, "c", None)]
    assert rows(R.upsert(old, new, ["k"], fill_only=True)) == [(1, "a", None), (2, "b", 5), (3, "c", None)]
    assert rows(R.upsert(old, new, ["k"], owned=F.col("y") == 0)) == [(1, "a", None), (2, None, 5), (3, "c", None)]
    assert rows(R.insert_missing(old, new, ["k"])) == [(1, "a", None), (2, None, 5), (3, "c", None)]
    with pytest.raises(ValueError):
        R.replace_snapshot(old, new.limit(1))

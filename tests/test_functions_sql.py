"""SQL functions against the Column functions that they stand for, and vectors of pending documents."""

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import register as G
from tallyfold.functions import text as T
from tallyfold.operators import search as S
from tallyfold.plans.sql_guard import Guard


@pytest.fixture(scope="module")
def names(spark):
    G.register(spark)
    rows = ["The A & B Co., Inc.", "SEE ATTACHED", "N/A", None, "  x\ty ", "É. Müller-Smith", "VARIOUS", "UNDER 5 000", "grants@x.org", "jane.smith+1@ex.org", "info@x.org", "no mail", "(212) 555-1234", "112 555 1234", "Funds by invitation only", "We do  not\nsolicit; does not  solicit"]
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k int, x string")


def test_same_as_columns(spark, names):
    x = F.col("x")
    pairs = {
        "norm_name(x)": T.norm_name(x), "is_placeholder_recipient(norm_name(x))": T.is_placeholder(T.norm_name(x)), "email_local_flat(x)": T.email_local(x), "is_role_based_email(x, 'Jane Smith')": T.is_role_email(x, F.lit("Jane Smith")),
        "nanp_e164(x)": T.phone(x), "restrictive_phrase(x)": T.restrictive_phrase(x), "is_entity_name(norm_name(x))": T.is_entity(T.norm_name(x)), "similarity(x, 'a and b')": T.similarity(T.trigrams(x), T.trigrams(F.lit("a and b"))),
    }
    for sql, col in pairs.items():
        differ = names.filter(~F.coalesce(F.expr(sql).eqNullSafe(col), F.lit(False))).collect()
        assert all(r.x is None for r in differ), (sql, differ)


def test_other_names(spark, names):
    got = spark.sql("""SELECT strpos('abc', 'c') AS a, starts_with('abc', 'ab') AS b, string_to_array('a.b', '.') AS c, array_to_string(array('a', 'b'), '-') AS d, array_length(array('a'), 1) AS e, array_replace(array('a', 'b'), 'a', 'z') AS f, array_positions(array('a', 'b', 'a'), 'a') AS g,
    regexp_match('ab12', '[0-9]+') AS h, jsonb_array_length('[1, 2]') AS i, jsonb_extract_path_text('{"k": "v"}', 'k') AS j, jsonb_typeof(' {"a": 1}') AS k, num_nulls2(NULL, 'x') AS l, date_bin_days(7, DATE '2024-01-10', DATE '2024-01-01') AS m, show_trgm('ab') AS n""").first()
    assert (got.a, got.b, list(got.c), got.d, got.e, list(got.f), list(got.g)) == (3, True, ["a", "b"], "a-b", 1, ["z", "b"], [1, 3])
    assert (list(got.h), got.i, got.j, got.k, got.l, str(got.m), list(got.n)) == (["12"], 2, "v", "object", 1, "2024-01-08", ["  a", " ab", "ab "])


def test_guarded_functions(spark, names):
    names.createOrReplaceTempView("named")
    assert Guard(frozenset({"named"})).run(spark, "select norm_name(x) n from named where similarity(x, 'grants') > 0.2").count() >= 1


def test_own_aggregate(spark):
    G.register_aggregate(spark, "spread", lambda x: float(x.max() - x.min()), "double")
    got = {r.g: r.s for r in spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "g string, v double").groupBy("g").agg(F.expr("spread(v)").alias("s")).collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_pending_vectors(spark):
    docs = spark.createDataFrame([(1, "red ring", "h1"), (2, "blue gear", "h2"), (3, "", "h3")], "k int, t string, doc_hash string")
    have = spark.createDataFrame([(1, "h1"), (2, "old")], "k int, doc_hash string")
    todo = S.pending(docs, have, "k")
    assert sorted(r.k for r in todo.collect()) == [2, 3]
    v = {r.k: r.embedding for r in S.hashed_vectors(docs, "k", "t", dim=16, batch=2).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-6 and sum(abs(x) for x in v[3]) == 0

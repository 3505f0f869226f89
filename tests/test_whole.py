"""Queries over whole tables: what they must return besides equalling their SQL."""

from pyspark.sql import functions as F

from tallyfold.operators.similarity import similar_classes
from tallyfold.plans import catalog

SF = "/root/testdata/sf0.001"


def got(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_ranges_hold_rows(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    ordering = read("customer").join(read("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")
    paired = ordering.join(read("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    segments = {(r.c_mktsegment, r.n_name) for r in paired.select("c_mktsegment", "n_name").distinct().collect()}
    assert {(r.name, r.state) for r in got(spark, "er_alias_consensus")} == segments
    assert 0 < len(got(spark, "flt_relative_window")) < read("events").count()
    assert all(r.n_30 and r.n_prev and r.n_30 + r.n_prev == r.n_all for r in got(spark, "ws_momentum"))
    shares = got(spark, "agg_share_guarded")
    assert shares and all(r.pct is not None for r in shares)


def test_token_index_meets_every_part(spark):
    words = {r.p_partkey: set(r.p_name.lower().split(" ")) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {(a, b): len(words[a] & words[b]) for a in words if a % 20 == 0 for b in words if a != b and len(words[a] & words[b]) >= 2}
    assert {(r.a, r.b): r.shared for r in got(spark, "jn_token_index")} == want
    assert any(b % 20 for _, b in want)


def test_components_of_every_order(spark):
    keys = {r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()}
    root = {n: n for k in keys for n in (k, k // 7 * 7)}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k in keys:
        a, b = sorted((find(k), find(k // 7 * 7)))
        root[b] = a
    assert {(r.node, r.root) for r in got(spark, "er_components")} == {(n, find(n)) for n in root}


def test_similarity_join_loses_no_link(spark):
    sets = {1: "abcd", 2: "dcba", 3: "abce", 4: "abcdefgh", 5: "xyz", 7: "wxyz", 8: "", 9: None, 21: "abcd", 22: "abq"}
    df = spark.createDataFrame([("b", k, None if v is None else list(v)) for k, v in sets.items()] + [("c", 30, list("abcd"))], "brand string, k long, g array<string>")
    links = {(r.kind, r.k, r.k_right): r.similarity for r in similar_classes(df, "k", "g", ["brand"], (1, 2)).collect()}
    classes = {}
    for k in sorted(sets):
        if sets[k]:
            classes.setdefault(frozenset(sets[k]), []).append(k)
    want = {("member", c[0], k): 1.0 for c in classes.values() for k in c[1:]}
    for a, x in classes.items():
        for b, y in classes.items():
            if x[0] < y[0] and 2 * len(a & b) >= len(a | b):
                want["pair", x[0], y[0]] = len(a & b) / len(a | b)
    assert links == want and ("member", 1, 21) in links


def test_similarity_queries_take_every_row(spark):
    assert any(r.k % 20 and r.k_right % 20 for r in got(spark, "sim_prefix_join"))
    assert {r.k for r in got(spark, "sim_jaro_winkler")} == {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}


def test_index_keeps_rare_terms(spark):
    terms = {r.term: r.df for r in got(spark, "fts_index_stats")}
    assert min(terms.values()) == 1

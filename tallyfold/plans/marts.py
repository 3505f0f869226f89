"""License-filtered views, rollup marts, supersession and posture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..operators import relational as R
from ..operators.quantiles import quantiles
from ..sources.tables import GRANTS_SQL as G
from ..sources.tables import grants, table
from .registry import query


def publishable(df, files, file_key: str):
    """Rows whose source file has a republishable license: a broadcastable semi join, so a fact table isn't shuffled."""
    return df.join(files.filter("republishable").select(F.col("file_id").alias("_f")), F.col(file_key) == F.col("_f"), "left_semi")


def _files(spark, d):
    """A registry of source files: nations stand for files, regions for licenses."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("file_id"), (F.col("r_name") != "ASIA").alias("republishable"))


@query("SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def view_publishable(spark, d):
    """FLT-17, JN-01; the public views themselves are in ``filings``."""
    return publishable(table(spark, d, "supplier"), _files(spark, d), "s_nationkey").select("s_suppkey", "s_name")


@query(G + """SELECT funder_id, s_name AS funder, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM grants JOIN supplier ON funder_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA' GROUP BY 1, 2 ORDER BY sum(amount) DESC, funder_id LIMIT 200""")
def mart_top_funders(spark, d):
    """MART-06: the flagship; facts are summed before they meet the names, and ties end in the key."""
    g = grants(spark, d).groupBy("funder_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    named = publishable(table(spark, d, "supplier"), _files(spark, d), "s_nationkey").select(F.col("s_suppkey").alias("funder_id"), F.col("s_name").alias("funder"))
    return g.join(named, "funder_id").orderBy(F.desc("total"), "funder_id").limit(200).select("funder_id", "funder", "n", F.col("total").cast("double").alias("total"))


@query("SELECT c_mktsegment AS org_type, count(*) AS n FROM customer GROUP BY 1")
def mart_org_type_counts(spark, d):
    """MART-02."""
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("org_type")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS state, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def mart_org_state_counts(spark, d):
    """MART-03: counted by key first, so the join sees one row per state."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(G + "SELECT flag AS event_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM grants GROUP BY 1")
def mart_event_type_totals(spark, d):
    """MART-04."""
    return grants(spark, d).groupBy(F.col("flag").alias("event_type")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(G + "SELECT coalesce(CASE WHEN status <> 'P' THEN fy END, CAST(year(event_date) AS INT)) AS fy, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM grants GROUP BY 1")
def mart_events_by_year(spark, d):
    """MART-05: a missing fiscal year falls back to the date's."""
    fy = F.coalesce(F.when(F.col("status") != "P", F.col("fy")), F.year("event_date"))
    return grants(spark, d).groupBy(fy.alias("fy")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


_STATS = "count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, min(fy) AS first_fy, max(fy) AS last_fy, count(DISTINCT {other}) AS n_other"


def _stats(g, key, other):
    return g.groupBy(key).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.min("fy").alias("first_fy"), F.max("fy").alias("last_fy"), F.count_distinct(other).alias("n_other"))


@query(G + f"SELECT funder_id, {_STATS.format(other='recipient_id')} FROM grants GROUP BY 1")
def mart_funder_event_stats(spark, d):
    """MART-08."""
    return _stats(grants(spark, d), "funder_id", "recipient_id")


@query(G + f"SELECT recipient_id, {_STATS.format(other='funder_id')} FROM grants GROUP BY 1")
def mart_recipient_event_stats(spark, d):
    """MART-09, WS-05."""
    return _stats(grants(spark, d), "recipient_id", "funder_id")


@query("""SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def mart_latest_financials(spark, d):
    """MART-10, VIEW-19: latest parsed, not latest."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return o.select("o_custkey", "o_orderkey", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("rn")).filter("rn = 1").drop("rn")


_POSTURE = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'preselected_only' ELSE 'unknown' END"


@query(f"""WITH p AS (SELECT o_custkey, {_POSTURE} AS posture, o_orderdate, o_orderkey FROM orders),
l AS (SELECT DISTINCT ON (o_custkey) o_custkey, posture FROM p ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC),
o AS (SELECT DISTINCT ON (p.o_custkey) p.o_custkey, p.posture AS other, p.o_orderkey AS other_key FROM p JOIN l ON p.o_custkey = l.o_custkey AND p.posture <> l.posture ORDER BY p.o_custkey, p.o_orderdate DESC, p.o_orderkey DESC)
SELECT l.o_custkey, l.posture, count(*) FILTER (p.posture = 'open') AS n_open, count(*) FILTER (p.posture = 'preselected_only') AS n_pre, any_value(o.other) AS other, any_value(o.other_key) AS other_key
FROM l JOIN p ON l.o_custkey = p.o_custkey LEFT JOIN o ON l.o_custkey = o.o_custkey GROUP BY 1, 2""")
def mart_posture_history(spark, d):
    """MART-11, MART-12, PRJ-01: the latest answer, counts, and the latest other answer, in one pass over a key's rows."""
    s = F.col("o_orderstatus")
    p = table(spark, d, "orders").select("o_custkey", F.when(s == "O", "open").when(s == "F", "preselected_only").otherwise("unknown").alias("posture"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    by = p.groupBy("o_custkey", "posture").agg(F.max("at").alias("at"), F.count("*").alias("k")).groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "posture", "k")))).alias("h"))
    n = lambda v: F.coalesce(F.get(F.filter("h", lambda x: x["posture"] == v), F.lit(0))["k"], F.lit(0)).cast("long")
    return by.select("o_custkey", F.get("h", F.lit(0))["posture"].alias("posture"), n("open").alias("n_open"), n("preselected_only").alias("n_pre"), F.get("h", F.lit(1))["posture"].alias("other"), F.get("h", F.lit(1))["at"]["o_orderkey"].alias("other_key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < max(o_orderkey) OVER w THEN max(o_orderkey) OVER w END AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate))")
def drv_supersession(spark, d):
    """DRV-04, AGG-17, STM-08: the greatest key of a group wins."""
    return R.supersede(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "y"], "o_orderkey").select("o_orderkey", "superseded_by")


@query(G + """, s AS (SELECT o_orderkey FROM (SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS m FROM orders) WHERE o_orderkey < m)
SELECT funder_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM grants WHERE filing_id NOT IN (SELECT o_orderkey FROM s) GROUP BY 1""")
def flt_live_grants(spark, d):
    """FLT-13, SNK-14: facts of superseded filings go."""
    dead = R.supersede(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "y"], "o_orderkey").filter("superseded_by is not null").select(F.col("o_orderkey").alias("filing_id"))
    return grants(spark, d).join(dead, "filing_id", "left_anti").groupBy("funder_id").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(G + """SELECT funder_id, n_name AS state, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM grants JOIN customer ON recipient_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def mart_giving_by_state(spark, d):
    """MART-14, WS-03, WS-04."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return grants(spark, d).join(c, F.col("recipient_id") == F.col("c_custkey")).groupBy("funder_id", "c_nationkey").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("funder_id", F.col("n_name").alias("state"), "n", "total")


@query(G + "SELECT funder_id, c_mktsegment AS cause, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM grants JOIN customer ON recipient_id = c_custkey GROUP BY 1, 2")
def mart_giving_by_cause(spark, d):
    """MART-15."""
    return grants(spark, d).join(table(spark, d, "customer"), F.col("recipient_id") == F.col("c_custkey")).groupBy("funder_id", F.col("c_mktsegment").alias("cause")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(G + """SELECT funder_id, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(amount AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST(amount AS DOUBLE), 0.75), 4) AS p75, count(DISTINCT fy) AS n_years FROM grants GROUP BY 1""")
def mart_grant_profile(spark, d):
    """MART-16."""
    g = grants(spark, d).select("funder_id", "fy", "amount")
    q = quantiles(g, ["funder_id"], "amount", {"median": ("cont", 0.5), "p25": ("cont", 0.25), "p75": ("cont", 0.75)})
    years = g.groupBy("funder_id").agg(F.count_distinct("fy").alias("n_years"))
    return years.join(q, "funder_id").select("funder_id", *[F.round(c, 4).alias(c) for c in ("median", "p25", "p75")], "n_years")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'revoked' WHEN n_open > 0 THEN 'listed' WHEN n > 0 THEN 'filing' ELSE 'unlisted' END AS standing, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def view_standing(spark, d):
    """VIEW-16: standing from ordered evidence."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    s = F.when(F.col("c_acctbal") < 0, "revoked").when(F.col("n_open") > 0, "listed").when(F.col("n") > 0, "filing").otherwise("unlisted")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", s.alias("standing"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT c_custkey, coalesce(a.x, b.x, c.x) AS value, CASE WHEN a.x IS NOT NULL THEN 'confirmed' WHEN b.x IS NOT NULL THEN 'filing' WHEN c.x IS NOT NULL THEN 'registry' END AS basis FROM customer
LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS x FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a ON c_custkey = a.k LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS x FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1) b ON c_custkey = b.k
LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS x FROM orders GROUP BY 1) c ON c_custkey = c.k""")
def drv_precedence(spark, d):
    """DRV-11, PRJ-02: the first source that has a value, and which it was; one scan serves all sources."""
    pri = F.col("o_orderpriority")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(pri == "1-URGENT", F.col("o_orderkey"))).alias("a"), F.max(F.when(pri == "2-HIGH", F.col("o_orderkey"))).alias("b"), F.max("o_orderkey").alias("c"))
    basis = F.when(F.col("a").isNotNull(), "confirmed").when(F.col("b").isNotNull(), "filing").when(F.col("c").isNotNull(), "registry")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("a", "b", "c").alias("value"), basis.alias("basis"))


@query("""WITH old AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, s_nationkey AS state FROM supplier WHERE s_suppkey % 4 <> 0),
new AS (SELECT s_suppkey AS k, upper(s_name) AS name, s_nationkey + 1 AS state FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(old.k, new.k) AS k, coalesce(old.name, new.name) AS name, coalesce(old.state, new.state) AS state FROM old FULL JOIN new ON old.k = new.k""")
def snk_upsert_fill(spark, d):
    """SNK-01..05: an upsert that fills nulls and adds rows."""
    s = table(spark, d, "supplier")
    old = s.filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("state"))
    new = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.upper("s_name").alias("name"), (F.col("s_nationkey") + 1).alias("state"))
    return R.upsert(old, new, ["k"], fill_only=True)


@query("SELECT trim(regexp_replace(regexp_replace(upper(p_name || CASE p_partkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' & Co' ELSE '  (new)' END), '[^A-Z0-9_ &-]', ' ', 'g'), ' +', ' ', 'g')) AS name, count(*) AS n FROM part GROUP BY 1")
def fn_norm_name_groups(spark, d):
    """STR-01 as a grouping key."""
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, ", Inc.").when(k % 3 == 1, " & Co").otherwise("  (new)")
    return table(spark, d, "part").groupBy(norm_name(F.concat("p_name", tail)).alias("name")).agg(F.count("*").alias("n"))

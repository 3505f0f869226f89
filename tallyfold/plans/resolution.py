"""Entity resolution, consensus aliases and recipient turnover."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators.similarity import jaro_winkler, similar_classes
from ..sources.tables import GRANTS_SQL as G
from ..sources.tables import grants, table
from .registry import query

# Organisations: parts by name and brand ("state"); recipients: the same names, noisier, from every third part.
_ER = """WITH org AS (SELECT p_partkey AS org_id, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' ' || (p_partkey * 7919 % 397) AS nn, left(p_brand, 7) AS state FROM part),
rec AS (SELECT p_partkey AS rid, CASE p_partkey % 7 WHEN 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' ' || (p_partkey * 7919 % 397) END AS nn, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE left(p_brand, 7) END AS state FROM part WHERE p_partkey % 3 = 0)
"""


def _orgs(spark, d):
    w = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    no = (F.col("p_partkey") * 7919 % 397).cast("string")
    p = table(spark, d, "part")
    org = p.select(F.col("p_partkey").alias("org_id"), F.concat_ws(" ", w(1), w(2), no).alias("nn"), F.left("p_brand", F.lit(7)).alias("state"))
    k = F.col("p_partkey")
    rec = p.filter("p_partkey % 3 = 0").select(k.alias("rid"), F.when(k % 7 == 0, w(1)).otherwise(F.concat_ws(" ", w(1), w(2), no)).alias("nn"), F.when(k % 5 != 0, F.left("p_brand", F.lit(7))).alias("state"))
    return org, rec


@query(_ER + """, u AS (SELECT nn, state, min(org_id) AS org_id FROM org GROUP BY 1, 2 HAVING count(*) = 1), n AS (SELECT nn, min(org_id) AS org_id, min(state) AS state FROM org GROUP BY 1 HAVING count(*) = 1)
SELECT rid, coalesce(u.org_id, n.org_id) AS org_id, CASE WHEN u.org_id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM rec LEFT JOIN u ON rec.nn = u.nn AND rec.state = u.state LEFT JOIN n ON rec.nn = n.nn AND (rec.state IS NULL OR rec.state = n.state)
WHERE u.org_id IS NOT NULL OR n.org_id IS NOT NULL""")
def er_tiers(spark, d):
    """ER-01, ER-02, JN-15, ER-18: unique or nothing; the candidates are counted once per name, not joined in full."""
    org, rec = _orgs(spark, d)
    u = org.groupBy("nn", "state").agg(F.count("*").alias("c"), F.min("org_id").alias("u_org")).filter("c = 1").drop("c")
    n = org.groupBy("nn").agg(F.count("*").alias("c"), F.min("org_id").alias("n_org"), F.min("state").alias("n_state")).filter("c = 1").drop("c")
    m = rec.join(u, ["nn", "state"], "left").join(n, "nn", "left")
    ok = F.when(F.col("state").isNull() | (F.col("state") == F.col("n_state")), F.col("n_org"))
    return m.select("rid", F.coalesce("u_org", ok).alias("org_id"), F.when(F.col("u_org").isNotNull(), 1).otherwise(2).alias("tier")).filter("org_id is not null")


def _consensus(spark, d, g):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    w = g.join(c, F.col("recipient_id") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    w = w.select(F.col("c_mktsegment").alias("name"), F.col("n_name").alias("state"), (F.col("funder_id") % 10).alias("org"), "funder_id")
    o = w.groupBy("name", "state", "org").agg(F.count_distinct("funder_id").alias("filers"), F.count("*").alias("rows_n"))
    k = w.groupBy("name", "state").agg(F.count_distinct("funder_id").alias("all_filers"), F.count_distinct("org").alias("orgs"))
    t = R.latest_per_key(o, ["name", "state"], F.desc("filers"), F.desc("rows_n"), F.asc("org"))
    s = F.when(F.col("orgs") == 1, "unanimous").when((F.col("filers") >= 5) & (F.col("filers") * 100 >= F.col("all_filers") * 95), "dominant").otherwise("contested")
    return t.join(k, ["name", "state"]).select("name", "state", "org", "filers", "all_filers", s.alias("status"))


@query(G + """, w AS (SELECT c_mktsegment AS name, n_name AS state, funder_id % 10 AS org, recipient_id, funder_id FROM grants JOIN customer ON recipient_id = c_custkey JOIN nation ON c_nationkey = n_nationkey ),
o AS (SELECT name, state, org, count(DISTINCT funder_id) AS filers, count(*) AS rows_n FROM w GROUP BY 1, 2, 3), k AS (SELECT name, state, count(DISTINCT funder_id) AS all_filers, count(DISTINCT org) AS orgs FROM w GROUP BY 1, 2),
t AS (SELECT DISTINCT ON (name, state) * FROM o ORDER BY name, state, filers DESC, rows_n DESC, org)
SELECT t.name, t.state, t.org, filers, all_filers, CASE WHEN orgs = 1 THEN 'unanimous' WHEN filers >= 5 AND filers * 100 >= all_filers * 95 THEN 'dominant' ELSE 'contested' END AS status FROM t JOIN k ON t.name = k.name AND t.state = k.state""")
def er_alias_consensus(spark, d):
    """SRT-09, ALS-02, ALS-03, ALS-06: the organisation that most filers name, with a whole-number test of dominance; er_aliases has every rule."""
    return _consensus(spark, d, grants(spark, d))


@query("""WITH n AS (SELECT s_suppkey AS k, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT DISTINCT n_name AS other FROM nation)
SELECT k, other, round(jaro_winkler_similarity(name, other), 6) AS jw FROM n JOIN m ON left(name, 1) = left(other, 1)""")
def sim_jaro_winkler(spark, d):
    """STR-21, JN-16: blocked by the first letter; a name is compared once for each nation, not once for each supplier."""
    n = table(spark, d, "nation")
    m = n.select(F.col("n_name").alias("other"))
    pairs = n.select("n_nationkey", F.col("n_name").alias("name")).join(m, F.left("name", F.lit(1)) == F.left("other", F.lit(1)))
    jw = pairs.select("n_nationkey", "other", F.round(jaro_winkler(F.col("name"), F.col("other")), 6).alias("jw"))
    return table(spark, d, "supplier").join(jw, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), "other", "jw")


_TRI = """tri AS (SELECT p_partkey AS k, p_brand AS brand, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''),
lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM part)"""


@query("WITH " + _TRI + """, c AS (SELECT brand, k, list_sort(g) AS g, min(k) OVER (PARTITION BY brand, list_sort(g)) AS rep FROM tri WHERE len(g) > 0), r AS (SELECT brand, k, g FROM c WHERE k = rep)
SELECT a.brand, a.k, b.k AS k_right, 'pair' AS kind, round(len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE), 6) AS similarity FROM r a JOIN r b ON a.brand = b.brand AND a.k < b.k WHERE 2 * len(list_intersect(a.g, b.g)) >= len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))
UNION ALL SELECT brand, rep, k, 'member', 1.0 FROM c WHERE k <> rep""")
def sim_prefix_join(spark, d):
    """DRV-02, STR-20, TRN-11..15, WIN-08: all links of a half or more among the parts of a brand, as pairs of class representatives and members."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), T.trigrams(F.col("p_name")).alias("g"))
    return similar_classes(p, "k", "g", ["brand"], (1, 2)).withColumn("similarity", F.round("similarity", 6))


@query(G + """, u AS (SELECT funder_id, fy, recipient_id, sum(amount) AS amount, count(*) AS n FROM grants GROUP BY 1, 2, 3), y AS (SELECT DISTINCT funder_id, fy FROM grants),
ok AS (SELECT a.funder_id, a.fy FROM y a WHERE (SELECT count(*) FROM y b WHERE b.funder_id = a.funder_id AND b.fy BETWEEN a.fy - 3 AND a.fy - 1) = 3)
SELECT u.funder_id, u.fy, count(*) AS n_recipients, count(*) FILTER (p.r IS NULL) AS n_new, CAST(sum(u.amount) AS DOUBLE) AS amount, CAST(coalesce(sum(u.amount) FILTER (p.r IS NULL), 0) AS DOUBLE) AS amount_new
FROM u JOIN ok ON u.funder_id = ok.funder_id AND u.fy = ok.fy LEFT JOIN (SELECT DISTINCT c.funder_id AS f, c.fy AS y, c.recipient_id AS r FROM u c JOIN u q ON c.funder_id = q.funder_id AND c.recipient_id = q.recipient_id AND q.fy BETWEEN c.fy - 3 AND c.fy - 1) p
ON p.f = u.funder_id AND p.y = u.fy AND p.r = u.recipient_id GROUP BY 1, 2""")
def turnover(spark, d):
    """TRN-03, TRN-04, TRN-10: recipients of a year that none of the three years before had, for funders present in all four.

    The year before comes from a window over (funder, recipient), so no self join is needed.
    """
    g = grants(spark, d)
    u = g.groupBy("funder_id", "fy", "recipient_id").agg(F.sum("amount").alias("amount"))
    before = F.lag("fy").over(Window.partitionBy("funder_id", "recipient_id").orderBy("fy"))
    u = u.withColumn("new", F.coalesce(before < F.col("fy") - 3, F.lit(True)))
    per = u.groupBy("funder_id", "fy").agg(F.count("*").alias("n_recipients"), F.count_if("new").alias("n_new"), F.sum("amount").cast("double").alias("amount"), F.coalesce(F.sum(F.when(F.col("new"), F.col("amount"))), F.lit(0)).cast("double").alias("amount_new"))
    back = F.lag("fy", 3).over(Window.partitionBy("funder_id").orderBy("fy"))
    return per.withColumn("back", back).filter("back = fy - 3").drop("back")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN least(c_custkey - 1, c_custkey) ELSE c_custkey END AS canonical_id, n FROM customer JOIN (SELECT CASE WHEN o_custkey % 4 = 0 THEN o_custkey - 1 ELSE o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = CASE WHEN c_custkey % 4 = 0 THEN c_custkey - 1 ELSE c_custkey END""")
def er_canonical_route(spark, d):
    """ER-17: facts of aliases count for the canonical row."""
    route = lambda c: F.when(F.col(c) % 4 == 0, F.col(c) - 1).otherwise(F.col(c))
    n = table(spark, d, "orders").groupBy(route("o_custkey").alias("canonical_id")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey", route("c_custkey").alias("canonical_id")).join(n, "canonical_id").select("c_custkey", "canonical_id", "n")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, o_custkey // 7 * 7 AS v FROM orders), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(n, m) AS (SELECT u, u FROM b UNION SELECT b.v, r.m FROM r JOIN b ON r.n = b.u) SELECT n AS node, min(m) AS root FROM r GROUP BY 1""")
def er_components(spark, d):
    """ER-13: connected components of match pairs."""
    from ..operators.graph import components

    e = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), (F.floor(F.col("o_custkey") / 7) * 7).cast("long").alias("v")).distinct()
    return components(e)

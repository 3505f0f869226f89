"""Recipient turnover: of a year's named recipients, how many were on none of the funder's three lists before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators.durable import Tables, durable
from ..operators.quantiles import quantiles
from ..operators.similarity import rare_tokens, set_similarity_join
from ..sources.standin import cte, rel
from . import filings
from .registry import query

WINDOW = 3
#: Trigrams of a name, about.
GRAMS = 20
#: How filers mark a person in the box for a recipient's status.
INDIVIDUAL, INDIVIDUAL_WORD, NEGATION = r"^(I|IND\.?|STUDENTS?)$", r"\bINDIV", r"\b(NO|NOT|NON)\b"

_NORM = "trim(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9_ &-]', ' ', 'g'), ' +', ' ', 'g'))"
_LIVE = "lf AS (SELECT *, CASE WHEN object_id < max(object_id) OVER w THEN max(object_id) OVER w END AS superseded_by FROM filings WINDOW w AS (PARTITION BY ein, return_type, tax_period))"
_OF = ("funding_events", "filings")
_ROWS = f""", {_LIVE}, r0 AS (SELECT event_id, funder_org_id AS f, fy, split_part(source_record_key, ':', 2) AS oid, recipient_org_id AS rorg, amount, upper(trim(coalesce(foundation_status, ''))) AS fs, {_NORM.format('recipient_name')} AS nn
FROM funding_events WHERE event_type = 'grant' AND source_record_key LIKE 'irs990pf:%' AND fy IS NOT NULL),
r1 AS (SELECT *, nn IS NULL OR length(nn) < 4 OR nn LIKE 'SEE ATTACH%' AS unnamed, rorg IS NULL AND fs IN ('I', 'IND', 'IND.', 'STUDENT', 'STUDENTS') AS indiv, trim(regexp_replace(regexp_replace(nn, '^THE +', ''), ' +(INC|INCORPORATED|LLC|L L C|CORP|CORPORATION|CO|LTD|LP|LLP|PC|PA)$', '')) AS cn FROM r0),
rows_ AS (SELECT r1.*, coalesce(nullif(regexp_replace(cn, '[^A-Z0-9]+', '', 'g'), ''), cn) AS sq, lf.tax_period FROM r1 LEFT JOIN lf ON lf.object_id = r1.oid WHERE lf.superseded_by IS NULL),
fy_ AS (SELECT f, fy, count(*) AS n_rows, count(*) FILTER (unnamed) AS n_unnamed, count(*) FILTER (NOT unnamed AND indiv) AS n_indiv, count(*) FILTER (NOT unnamed AND NOT indiv) AS n_named, sum(amount) FILTER (NOT unnamed AND NOT indiv) AS amount_named FROM rows_ GROUP BY 1, 2),
ta AS (SELECT t.*, p1.n_unnamed + p2.n_unnamed + p3.n_unnamed AS window_unnamed, t.n_indiv + p1.n_indiv + p2.n_indiv + p3.n_indiv AS indiv_rows, CASE WHEN t.n_indiv > t.n_named OR t.n_indiv + p1.n_indiv + p2.n_indiv + p3.n_indiv > t.n_named + p1.n_named + p2.n_named + p3.n_named THEN 'mostly_individuals' WHEN least(t.n_named, p1.n_named, p2.n_named, p3.n_named) < 1 THEN 'year_of_individuals_only' END AS left_out
FROM fy_ t JOIN fy_ p1 ON p1.f = t.f AND p1.fy = t.fy - 1 JOIN fy_ p2 ON p2.f = t.f AND p2.fy = t.fy - 2 JOIN fy_ p3 ON p3.f = t.f AND p3.fy = t.fy - 3 WHERE least(t.n_named + t.n_indiv, p1.n_named + p1.n_indiv, p2.n_named + p2.n_indiv, p3.n_named + p3.n_indiv) >= 1)"""


def rows(spark, d):
    """TRN-01, TRN-02: grant rows of filings that stand, with cleaned and squeezed names and what kind of row each is."""
    e = rel(spark, d, "funding_events").filter("event_type = 'grant' and source_record_key like 'irs990pf:%' and fy is not null")
    f = filings.live(spark, d).select(F.col("object_id").alias("oid"), "tax_period", "superseded_by")
    fs = F.upper(F.trim(F.coalesce("foundation_status", F.lit(""))))
    indiv = F.col("recipient_org_id").isNull() & (fs.rlike(INDIVIDUAL) | (fs.rlike(INDIVIDUAL_WORD) & ~fs.rlike(NEGATION)))
    r = e.select("event_id", F.col("funder_org_id").alias("f"), "fy", F.split_part("source_record_key", F.lit(":"), F.lit(2)).alias("oid"), F.col("recipient_org_id").alias("rorg"), "amount", T.norm_name(F.col("recipient_name")).alias("nn"), indiv.alias("indiv"), T.clean_name(F.col("recipient_name")).alias("cn"))
    r = r.withColumns({"unnamed": T.is_placeholder(F.col("nn")), "sq": T.squeeze(F.col("cn"))}).select("event_id", "f", "fy", "oid", "rorg", "amount", "unnamed", "indiv", "cn", "sq")
    return r.join(f, "oid", "left").filter("superseded_by is null").drop("superseded_by")


def years(r):
    """TRN-03: a funder's rows of a year by kind."""
    named = ~F.col("unnamed") & ~F.col("indiv")
    return r.groupBy("f", "fy").agg(F.count("*").alias("n_rows"), F.count_if("unnamed").alias("n_unnamed"), F.count_if(~F.col("unnamed") & F.col("indiv")).alias("n_indiv"), F.count_if(named).alias("n_named"), F.sum(F.when(named, F.col("amount"))).alias("amount_named"))


def targets(r):
    """TRN-04, TRN-05, JN-12: years with three listed years before them, and why one is left out; one window instead of three self joins."""
    w = Window.partitionBy("f").orderBy("fy")
    y = years(r).filter(F.col("n_named") + F.col("n_indiv") >= 1)
    back = lambda c, k: F.lag(c, k).over(w)
    span = w.rowsBetween(-WINDOW, 0)
    t = y.withColumns({"back": back("fy", WINDOW), "indiv_rows": F.sum("n_indiv").over(span), "named_rows": F.sum("n_named").over(span), "least": F.min("n_named").over(span), "window_unnamed": F.sum("n_unnamed").over(span) - F.col("n_unnamed")}).filter(F.col("back") == F.col("fy") - WINDOW)
    out = F.when((F.col("n_indiv") > F.col("n_named")) | (F.col("indiv_rows") > F.col("named_rows")), "mostly_individuals").when(F.col("least") < 1, "year_of_individuals_only")
    return t.withColumn("left_out", out).drop("back", "named_rows", "least")


@query(cte(*_OF) + _ROWS + " SELECT f, fy, n_rows, n_unnamed, n_indiv, n_named, CAST(amount_named AS DOUBLE) AS amount_named, CAST(window_unnamed AS BIGINT) AS window_unnamed, CAST(indiv_rows AS BIGINT) AS indiv_rows, left_out FROM ta")
def turnover_targets(spark, d):
    """TRN-01..05."""
    return targets(rows(spark, d)).select("f", "fy", "n_rows", "n_unnamed", "n_indiv", "n_named", F.col("amount_named").cast("double").alias("amount_named"), "window_unnamed", "indiv_rows", "left_out")


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SEEN = _ROWS + f""", tg AS (SELECT * FROM ta WHERE left_out IS NULL), cur AS (SELECT r.f, r.fy, cn, sq, rorg, sum(amount) AS amount FROM rows_ r JOIN tg ON tg.f = r.f AND tg.fy = r.fy WHERE NOT unnamed AND NOT indiv GROUP BY ALL),
prior AS (SELECT DISTINCT f, fy, cn, sq, rorg FROM rows_ WHERE f IN (SELECT f FROM tg) AND NOT unnamed AND NOT indiv), name_ AS (SELECT f, fy, sq, coalesce('o:' || min(rorg)::VARCHAR, 'n:' || sq) AS ukey, sum(amount) AS amount FROM cur GROUP BY 1, 2, 3),
seen AS (SELECT DISTINCT c.f, c.fy, c.sq FROM name_ c JOIN prior p ON p.f = c.f AND p.sq = c.sq AND p.fy BETWEEN c.fy - 3 AND c.fy - 1 UNION SELECT DISTINCT c.f, c.fy, c.sq FROM cur c JOIN prior p ON p.f = c.f AND p.rorg = c.rorg AND p.fy BETWEEN c.fy - 3 AND c.fy - 1),
useen AS (SELECT DISTINCT n.f, n.fy, n.ukey FROM name_ n JOIN seen s ON s.f = n.f AND s.fy = n.fy AND s.sq = n.sq), cand AS (SELECT DISTINCT c.f, c.fy, c.cn, c.sq FROM cur c JOIN name_ n ON n.f = c.f AND n.fy = c.fy AND n.sq = c.sq LEFT JOIN useen u ON u.f = n.f AND u.fy = n.fy AND u.ukey = n.ukey WHERE u.ukey IS NULL),
ptok AS (SELECT f, cn, len(g) AS n, unnest(g) AS tok FROM (SELECT f, cn, {_TRI.format('cn')} AS g FROM (SELECT DISTINCT f, cn FROM prior WHERE f IN (SELECT f FROM cand)))), ctok AS (SELECT f, cn, len(g) AS n, unnest(g) AS tok FROM (SELECT f, cn, {_TRI.format('cn')} AS g FROM (SELECT DISTINCT f, cn FROM cand)))"""


def seen(spark, d):
    """TRN-06..11: a year's recipients, earlier lists, and the recipients that neither name nor organisation shows before."""
    tables = Tables(spark, "turnover")  # each is read several times
    r = tables.save(rows(spark, d))
    ta = tables.save(targets(r).filter("left_out is null"))
    tg = ta.select("f", "fy")
    named = r.filter("not unnamed and not indiv")
    cur = named.join(tg, ["f", "fy"], "left_semi").groupBy("f", "fy", "cn", "sq", "rorg").agg(F.sum("amount").alias("amount"))
    cur, prior = tables.save(cur), tables.save(named.join(tg.select("f").distinct(), "f", "left_semi").select("f", F.col("fy").alias("p_fy"), "cn", "sq", "rorg").distinct())
    name = tables.save(cur.groupBy("f", "fy", "sq").agg(F.coalesce(F.concat(F.lit("o:"), F.min("rorg").cast("string")), F.concat(F.lit("n:"), F.first("sq"))).alias("ukey"), F.sum("amount").alias("amount")))
    before = (F.col("p_fy") >= F.col("fy") - WINDOW) & (F.col("p_fy") < F.col("fy"))
    by_name = name.join(prior.select("f", "sq", "p_fy").distinct(), ["f", "sq"]).filter(before).select("f", "fy", "sq").distinct()
    by_org = cur.filter("rorg is not null").join(prior.filter("rorg is not null").select("f", "rorg", "p_fy").distinct(), ["f", "rorg"]).filter(before).select("f", "fy", "sq").distinct()
    shown = tables.save(by_name.unionByName(by_org).distinct())
    useen = name.join(shown, ["f", "fy", "sq"], "left_semi").select("f", "fy", "ukey").distinct()
    fresh = name.join(useen, ["f", "fy", "ukey"], "left_anti")
    cand = tables.save(cur.select("f", "fy", "cn", "sq").distinct().join(fresh.select("f", "fy", "sq"), ["f", "fy", "sq"], "left_semi"))
    return r, ta, prior, name, shown, cand


@query(cte(*_OF) + _SEEN + """, df AS (SELECT f, tok, count(*) AS df FROM ptok GROUP BY 1, 2), rk AS (SELECT c.*, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY c.f, c.cn ORDER BY coalesce(df, 0), c.tok) AS rk FROM ctok c LEFT JOIN df ON df.f = c.f AND df.tok = c.tok)
SELECT f, count(*) AS tokens, CAST(sum(df) AS BIGINT) AS comparisons, sum(df) > 8600 AS over FROM rk WHERE rk <= n // 5 + 1 AND df > 0 GROUP BY 1""")
def turnover_budget(spark, d):
    """TRN-12, TRN-13, TRN-14, WIN-08, AGG-04: comparisons that a funder's similar names would need, known before any is made (here against a budget of 8,600)."""
    _, _, prior, _, _, cand = seen(spark, d)
    return budget(prior, cand, 8_600)


def budget(prior, cand, most: int):
    grams = lambda df: df.select("f", "cn").distinct().withColumn("g", T.trigrams(F.col("cn")))
    k = rare_tokens(grams(cand), grams(prior), "cn", "g", ["f"], (4, 5))
    return k.filter("_df > 0").groupBy("f").agg(F.count("*").alias("tokens"), F.sum("_df").alias("comparisons"), (F.sum("_df") > most).alias("over"))


_FINAL = _SEEN + """, pr AS (SELECT c.f, c.cn, p.cn AS pcn FROM ctok c JOIN ptok p ON p.f = c.f AND p.tok = c.tok GROUP BY c.f, c.cn, p.cn, c.n, p.n HAVING count(*) * 5 >= (c.n + p.n - count(*)) * 4),
sim AS (SELECT DISTINCT k.f, k.fy, k.sq FROM cand k JOIN pr ON pr.f = k.f AND pr.cn = k.cn JOIN prior p ON p.f = k.f AND p.cn = pr.pcn AND p.fy BETWEEN k.fy - 3 AND k.fy - 1),
unit AS (SELECT n.f, n.fy, ukey, sum(n.amount) AS amount, bool_or(s.sq IS NOT NULL) AS exact, bool_or(m.sq IS NOT NULL) AS alike FROM name_ n LEFT JOIN seen s ON s.f = n.f AND s.fy = n.fy AND s.sq = n.sq LEFT JOIN sim m ON m.f = n.f AND m.fy = n.fy AND m.sq = n.sq GROUP BY 1, 2, 3),
obj AS (SELECT DISTINCT ON (f, fy) f, fy, oid FROM rows_ WHERE tax_period IS NOT NULL ORDER BY f, fy, tax_period DESC, oid DESC),
final AS (SELECT tg.f, tg.fy, count(*) AS n_recipients, count(*) FILTER (NOT exact AND NOT alike) AS n_new, count(*) FILTER (NOT exact AND alike) AS n_seen_similar, tg.n_rows, tg.n_unnamed, CAST(tg.window_unnamed AS BIGINT) AS window_unnamed, CAST(tg.amount_named AS DOUBLE) AS amount_total,
CASE WHEN count(*) FILTER (NOT exact AND NOT alike) = 0 THEN 0 ELSE CAST(sum(unit.amount) FILTER (NOT exact AND NOT alike) AS DOUBLE) END AS amount_new, any_value(obj.oid) AS object_id FROM tg JOIN unit ON unit.f = tg.f AND unit.fy = tg.fy LEFT JOIN obj ON obj.f = tg.f AND obj.fy = tg.fy GROUP BY ALL)"""


def alike(cand, prior, once: bool | None = None):
    """TRN-15: ``f, cn, pcn``: candidates and similar earlier names of the same funder, all of them.

    ``once``: a name on many lists meets the others once for all funders; else names meet within
    each funder.  Both give the same rows.  Names meet once where that takes no more comparisons
    than the funders' lists have trigrams, about ``GRAMS`` a name.
    """
    tables = Tables(cand.sparkSession, "grams")
    grams = lambda df: df.withColumn("g", T.trigrams(F.col("cn")))
    ids = lambda df, by: tables.save(df.select(*by, "cn").distinct().withColumn("id", F.monotonically_increasing_id()))
    right = lambda df, by: df.select(*by, F.col("id").alias("id_right"), F.col("cn").alias("pcn"))  # noqa: E731  a number stands for a name; trigrams are made where they are read
    lists = tables.save(prior.join(cand.select("f").distinct(), "f", "left_semi").select("f", "cn").distinct())
    cands = tables.save(cand.select("f", "cn").distinct())
    mine, theirs = ids(cands, []), ids(lists, [])
    if once is None:
        most = GRAMS * (cands.count() + lists.count())
        once = (rare_tokens(grams(mine), grams(theirs), "id", "g", [], (4, 5)).agg(F.sum("_df")).first()[0] or 0) <= most
    by = [] if once else ["f"]
    if by:
        mine, theirs = ids(cands, by), ids(lists, by)
    near = set_similarity_join(grams(mine), grams(theirs), "id", "g", by, (4, 5)).join(mine, [*by, "id"]).join(right(theirs, by), [*by, "id_right"]).select(*by, "cn", "pcn")
    near = tables.save(near)
    return near if by else cands.join(near, "cn").join(lists.withColumnRenamed("cn", "pcn"), ["f", "pcn"]).select("f", "cn", "pcn")


def final(spark, d):
    tables = Tables(spark, "final")  # short plans: a long one is described anew to the driver with each of its stages
    r, tg, prior, name, shown, cand = seen(spark, d)
    by_year = prior.select("f", F.col("cn").alias("pcn"), "p_fy").distinct()
    similar = tables.save(cand.join(alike(cand, prior), ["f", "cn"]).join(by_year, ["f", "pcn"]).filter((F.col("p_fy") >= F.col("fy") - WINDOW) & (F.col("p_fy") < F.col("fy"))).select("f", "fy", "sq").distinct())
    flag = lambda df, c: df.withColumn(c, F.lit(True))
    unit = name.join(flag(shown, "x"), ["f", "fy", "sq"], "left").join(flag(similar, "y"), ["f", "fy", "sq"], "left").groupBy("f", "fy", "ukey").agg(F.sum("amount").alias("amount"), F.coalesce(F.bool_or("x"), F.lit(False)).alias("exact"), F.coalesce(F.bool_or("y"), F.lit(False)).alias("similar"))
    new = ~F.col("exact") & ~F.col("similar")
    sums = tables.save(unit.groupBy("f", "fy").agg(F.count("*").alias("n_recipients"), F.count_if(new).alias("n_new"), F.count_if(~F.col("exact") & F.col("similar")).alias("n_seen_similar"), F.sum(F.when(new, F.col("amount"))).cast("double").alias("amount_new")))
    seal = tables.save(R.latest_per_key(r.filter("tax_period is not null").select("f", "fy", "oid", "tax_period").distinct(), ["f", "fy"], F.desc("tax_period"), F.desc("oid")).select("f", "fy", F.col("oid").alias("object_id")))
    out = tg.join(sums, ["f", "fy"]).join(seal, ["f", "fy"], "left")
    return out.select("f", "fy", "n_recipients", "n_new", "n_seen_similar", "n_rows", "n_unnamed", "window_unnamed", F.col("amount_named").cast("double").alias("amount_total"), F.when(F.col("n_new") == 0, F.lit(0.0)).otherwise(F.col("amount_new")).alias("amount_new"), "object_id")


@query(cte(*_OF) + _FINAL + " SELECT * FROM final")
def turnover_full(spark, d):
    """DRV-01, DRV-02, TRN-06..18, INV-TV: seen by name, by organisation, or by a similar name; no new recipient is a zero, new ones without amounts are unknown."""
    return final(spark, d)


@query(cte(*_OF) + _FINAL + " SELECT fy, count(*) AS n, CAST(sum(n_recipients) AS BIGINT) AS n_recipients, CAST(sum(n_new) AS BIGINT) AS n_new, CAST(sum(n_seen_similar) AS BIGINT) AS n_seen_similar, count(*) FILTER (n_new = 0) AS none, count(*) FILTER (n_new >= 3) AS three, count(*) FILTER (window_unnamed > 0) AS with_unnamed, count(*) FILTER (object_id IS NULL) AS unsealed FROM final GROUP BY 1")
def turnover_summary(spark, d):
    """TRN-19."""
    return final(spark, d).groupBy("fy").agg(F.count("*").alias("n"), F.sum("n_recipients").alias("n_recipients"), F.sum("n_new").alias("n_new"), F.sum("n_seen_similar").alias("n_seen_similar"), F.count_if(F.col("n_new") == 0).alias("none"), F.count_if(F.col("n_new") >= 3).alias("three"), F.count_if(F.col("window_unnamed") > 0).alias("with_unnamed"), F.count_if(F.col("object_id").isNull()).alias("unsealed"))


@query(cte(*_OF, "filing_financials", "application_info") + _FINAL + """, h AS (SELECT DISTINCT ON (org_id) org_id, CASE WHEN a.object_id IS NULL THEN 'unknown' WHEN only_preselected THEN 'preselected_only' ELSE 'open' END AS posture FROM lf JOIN filing_financials ff ON ff.object_id = lf.object_id LEFT JOIN application_info a ON a.object_id = lf.object_id
WHERE superseded_by IS NULL AND return_type = '990PF' ORDER BY org_id, tax_period DESC, lf.object_id DESC) SELECT fy, coalesce(posture, 'no posture row') AS posture, count(*) AS foundations, round(100.0 * count(*) FILTER (n_new = 0) / count(*), 4) AS pct_none, round(100.0 * count(*) FILTER (n_new >= 3) / count(*), 4) AS pct_three, round(quantile_cont(n_new / n_recipients, 0.5), 6) AS median_share FROM final LEFT JOIN h ON h.org_id = f GROUP BY 1, 2""")
def turnover_report(spark, d):
    """TRN-20, AGG-09: shares of foundations by year and posture, and the median share of new recipients."""
    h = filings.mart_application_posture(spark, d).select(F.col("org_id").alias("f"), "posture")
    t = final(spark, d).join(h, "f", "left").withColumn("posture", F.coalesce("posture", F.lit("no posture row")))
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    t = durable(t.select("fy", "posture", "n_new", (F.col("n_new") / F.col("n_recipients")).alias("share")))
    n = t.groupBy("fy", "posture").agg(F.count("*").alias("foundations"), pct(F.col("n_new") == 0).alias("pct_none"), pct(F.col("n_new") >= 3).alias("pct_three"))
    return n.join(quantiles(t, ["fy", "posture"], "share", {"median_share": ("cont", 0.5)}), ["fy", "posture"]).withColumn("median_share", F.round("median_share", 6))

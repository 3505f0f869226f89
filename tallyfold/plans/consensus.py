"""Recipient resolution by tiers and by what filers agree on, with ledgers that can be undone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..sources.standin import cte, rel
from .registry import query

#: Types of organisations that a grant may be matched to; funds and advisers are none.
TYPES = ("company", "private_foundation", "public_charity", "gov_agency", "other")
MIN_FILERS, MIN_NAME, DOMINANT_FILERS, DOMINANT_PERCENT = 3, 6, 5, 95

_NORM = "trim(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9_ &-]', ' ', 'g'), ' +', ' ', 'g'))"
_FORM = "' +(INC|INCORPORATED|LLC|L L C|CORP|CORPORATION|CO|LTD|LP|LLP|PC|PA)$'"
_OF = ("funding_events", "organizations")
_TIERS = f""", recips AS (SELECT DISTINCT {_NORM.format('recipient_name')} AS nn, nullif(trim(recipient_state), '') AS st FROM funding_events WHERE event_type = 'grant' AND recipient_org_id IS NULL AND recipient_name IS NOT NULL AND NOT {_NORM.format('recipient_name')} LIKE 'SEE ATTACH%'),
cands AS (SELECT org_id, {_NORM.format('name')} AS nn, state AS st FROM organizations WHERE org_type IN ('company', 'private_foundation', 'public_charity', 'gov_agency', 'other')),
t1 AS (SELECT r.nn, r.st, c.org_id FROM recips r JOIN cands c ON c.nn = r.nn AND c.st = r.st WHERE (SELECT count(*) FROM cands x WHERE x.nn = r.nn AND x.st = r.st) = 1),
r2 AS (SELECT r.* FROM recips r LEFT JOIN t1 ON t1.nn = r.nn AND t1.st IS NOT DISTINCT FROM r.st WHERE t1.nn IS NULL),
t2 AS (SELECT r.nn, r.st, c.org_id FROM r2 r JOIN cands c ON c.nn = r.nn WHERE (SELECT count(*) FROM cands x WHERE x.nn = r.nn) = 1 AND (r.st IS NULL OR c.st IS NULL OR c.st = r.st)),
r3 AS (SELECT r.nn, r.st, trim(regexp_replace(r.nn, {_FORM}, '')) AS base FROM r2 r LEFT JOIN t2 ON t2.nn = r.nn AND t2.st IS NOT DISTINCT FROM r.st WHERE t2.nn IS NULL),
sc AS (SELECT org_id, st, trim(regexp_replace(nn, {_FORM}, '')) AS base FROM cands), t3 AS (SELECT r.nn, r.st, s.org_id FROM r3 r JOIN sc s ON s.base = r.base AND s.st = r.st WHERE length(r.base) >= 6 AND (SELECT count(*) FROM sc x WHERE x.base = r.base AND x.st = r.st) = 1),
m AS (SELECT nn, st, org_id, 'tier1' AS method, 0.98::DOUBLE AS confidence FROM t1 UNION ALL SELECT nn, st, org_id, 'tier2', 0.93 FROM t2 UNION ALL SELECT nn, st, org_id, 'tier3', 0.90 FROM t3)"""


def _unique(cands, by: list[str], name: str):
    """The one candidate of each key; keys with several have none."""
    one = cands.filter(" and ".join(f"{k} is not null" for k in by)).groupBy(*by).agg(F.count("*").alias("_n"), F.min("org_id").alias(name), F.min("st").alias(f"{name}_st"))
    return one.filter("_n = 1").drop("_n")


def matches(spark, d):
    """``nn, st, org_id, method, confidence``: exact name in the state, exact name alone, name without its legal form in the state; unique or nothing."""
    e = rel(spark, d, "funding_events").filter("event_type = 'grant' and recipient_org_id is null")
    recips = e.select(T.norm_name(F.col("recipient_name")).alias("nn"), F.nullif(F.trim("recipient_state"), F.lit("")).alias("st")).distinct().filter(~T.is_placeholder(F.col("nn")))
    cands = rel(spark, d, "organizations").filter(F.col("org_type").isin(*TYPES)).select("org_id", T.norm_name(F.col("name")).alias("nn"), F.col("state").alias("st"))
    base = T.strip_suffix(F.col("nn"))
    m = recips.withColumn("base", base).join(_unique(cands, ["nn", "st"], "a").drop("a_st"), ["nn", "st"], "left")
    m = m.join(_unique(cands, ["nn"], "b"), "nn", "left").join(_unique(cands.withColumn("base", base), ["base", "st"], "c").drop("c_st"), ["base", "st"], "left")
    two = F.when(F.col("st").isNull() | F.col("b_st").isNull() | (F.col("st") == F.col("b_st")), F.col("b"))
    three = F.when(F.length("base") >= MIN_NAME, F.col("c"))
    m = m.select("nn", "st", F.col("a").alias("one"), two.alias("two"), three.alias("three"))
    pick = lambda x, y, z: F.when(F.col("one").isNotNull(), x).when(F.col("two").isNotNull(), y).when(F.col("three").isNotNull(), z)
    return m.select("nn", "st", F.coalesce("one", "two", "three").alias("org_id"), pick("tier1", "tier2", "tier3").alias("method"), pick(0.98, 0.93, 0.90).alias("confidence")).filter("org_id is not null")


@query(cte(*_OF) + _TIERS + " SELECT nn, st, org_id, method, confidence FROM m")
def er_recipient_tiers(spark, d):
    """ER-01, ER-02, ER-03, STR-03, JN-06, JN-15: three tiers, each for what the one before left."""
    return matches(spark, d)


_KEPT = """, old AS (SELECT nn, st, org_id + 1 AS org_id, 'manual' AS method, 1.0::DOUBLE AS confidence, CASE WHEN length(nn) % 2 = 0 THEN 'accepted' ELSE 'auto' END AS status FROM m WHERE length(nn) % 5 = 0),
kept AS (SELECT coalesce(o.nn, m.nn) AS nn, coalesce(o.st, m.st) AS st, CASE WHEN o.status <> 'auto' OR m.nn IS NULL THEN o.org_id ELSE m.org_id END AS org_id, CASE WHEN o.status <> 'auto' OR m.nn IS NULL THEN o.method ELSE m.method END AS method, CASE WHEN o.status <> 'auto' OR m.nn IS NULL THEN o.confidence ELSE m.confidence END AS confidence, coalesce(o.status, 'auto') AS status
FROM old o FULL JOIN m ON o.nn = m.nn AND o.st IS NOT DISTINCT FROM m.st)"""


def kept_matches(spark, d):
    """Stored matches after a run: a row that a person decided stays as it is."""
    m = matches(spark, d)
    old = m.filter(F.length("nn") % 5 == 0).select(F.col("nn").alias("o_nn"), F.col("st").alias("o_st"), (F.col("org_id") + 1).alias("o_org"), F.when(F.length("nn") % 2 == 0, "accepted").otherwise("auto").alias("o_status"))
    j = old.join(m, (F.col("nn") == F.col("o_nn")) & F.col("st").eqNullSafe(F.col("o_st")), "full_outer")
    frozen = F.coalesce(F.col("o_status") != "auto", F.lit(False)) | F.col("nn").isNull()
    return j.select(F.coalesce("o_nn", "nn").alias("nn"), F.coalesce("o_st", "st").alias("st"), F.when(frozen, F.col("o_org")).otherwise(F.col("org_id")).alias("org_id"), F.when(frozen, "manual").otherwise(F.col("method")).alias("method"), F.when(frozen, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("o_status", F.lit("auto")).alias("status"))


@query(cte(*_OF) + _TIERS + _KEPT + " SELECT * FROM kept")
def er_persist(spark, d):
    """ER-04, SNK-05: an upsert that a human decision freezes."""
    return kept_matches(spark, d)


@query(cte(*_OF) + _TIERS + _KEPT + f""", hit AS (SELECT e.event_id, k.org_id, k.method, e.amount FROM funding_events e JOIN kept k ON {_NORM.format('e.recipient_name')} = k.nn AND nullif(trim(e.recipient_state), '') IS NOT DISTINCT FROM k.st WHERE e.event_type = 'grant' AND e.recipient_org_id IS NULL AND k.status IN ('auto', 'accepted') AND k.confidence > 0.90)
SELECT method, count(*) AS n_linked, count(DISTINCT org_id) AS n_orgs, CAST(sum(amount) AS DOUBLE) AS amount FROM hit GROUP BY 1""")
def er_apply(spark, d):
    """ER-04, JN-07, SNK-14: facts take the organisation of their match; the third tier only when asked for."""
    return apply_matches(spark, d).groupBy("method").agg(F.count("*").alias("n_linked"), F.count_distinct("new_org").alias("n_orgs"), F.sum("amount").cast("double").alias("amount"))


def apply_matches(spark, d, tier3: bool = False):
    k = kept_matches(spark, d).filter(F.col("status").isin("auto", "accepted") & ((F.col("confidence") > 0.90) | (F.lit(tier3) & (F.col("confidence") == 0.90))))
    e = rel(spark, d, "funding_events").filter("event_type = 'grant' and recipient_org_id is null")
    e = e.withColumns({"nn_": T.norm_name(F.col("recipient_name")), "st_": F.nullif(F.trim("recipient_state"), F.lit(""))})
    return e.join(k, (F.col("nn_") == F.col("nn")) & F.col("st_").eqNullSafe(F.col("st"))).select("event_id", "nn", "st", F.col("org_id").alias("new_org"), "method", "amount")


# --- what filers agree on

_RAW = f""", raw AS (SELECT CASE WHEN source_record_key LIKE 'irs990:%' AND recipient_org_id IS NOT NULL THEN 'W' WHEN source_record_key LIKE 'irs990:%' THEN 'U' WHEN recipient_org_id IS NULL THEN 'T' END AS kind, event_id,
{_NORM.format('recipient_name')} AS nn, nullif(trim(recipient_state), '') AS st, {_NORM.format('recipient_city')} AS city, recipient_org_id AS org_id, funder_org_id, amount, fy FROM funding_events WHERE event_type = 'grant' AND recipient_name IS NOT NULL AND nullif(trim(recipient_state), '') IS NOT NULL),
w AS (SELECT nn, st, org_id, count(DISTINCT funder_org_id) AS n_filers, count(*) AS n_rows, list(DISTINCT city) AS cities, min(fy) AS first_fy, max(fy) AS last_fy FROM raw WHERE kind = 'W' GROUP BY 1, 2, 3),
k AS (SELECT nn, st, count(DISTINCT funder_org_id) AS all_filers, count(DISTINCT org_id) AS n_orgs FROM raw WHERE kind = 'W' GROUP BY 1, 2), u AS (SELECT nn, st, count(DISTINCT funder_org_id) AS n_unlinked FROM raw WHERE kind = 'U' GROUP BY 1, 2),
t AS (SELECT DISTINCT ON (nn, st) * FROM w ORDER BY nn, st, n_filers DESC, n_rows DESC, org_id), al AS (SELECT t.*, all_filers, n_orgs, coalesce(n_unlinked, 0) AS n_unlinked FROM t JOIN k USING (nn, st) LEFT JOIN u USING (nn, st))"""
_ALIAS = _TIERS + _RAW + f""", keep AS (SELECT al.*, list_sort(list_distinct(list_append(cities, {_NORM.format('o.city')}))) AS witness, CASE WHEN n_unlinked * 2 >= n_filers THEN 'contested' WHEN n_orgs = 1 THEN 'unanimous' WHEN n_filers >= 5 AND n_filers * 100 >= all_filers * 95 THEN 'dominant' ELSE 'contested' END AS status
FROM al JOIN organizations o ON o.org_id = al.org_id WHERE all_filers >= 2 AND o.org_type IN ('company', 'private_foundation', 'public_charity', 'gov_agency', 'other') AND length(al.nn) >= 6 AND NOT al.nn LIKE 'SEE ATTACH%' AND NOT EXISTS (SELECT 1 FROM m WHERE m.nn = al.nn AND m.st = al.st)),
tg AS (SELECT keep.nn, keep.st, count(*) AS target_rows, count(*) FILTER (list_contains(witness, raw.city)) AS rows_city_ok, sum(amount) FILTER (list_contains(witness, raw.city)) AS amount_city_ok FROM keep JOIN raw ON raw.nn = keep.nn AND raw.st = keep.st AND kind = 'T' GROUP BY 1, 2),
fin AS (SELECT keep.*, coalesce(target_rows, 0) AS target_rows, coalesce(rows_city_ok, 0) AS rows_city_ok, CASE WHEN coalesce(rows_city_ok, 0) = 0 THEN 0 ELSE CAST(amount_city_ok AS DOUBLE) END AS amount_city_ok FROM keep LEFT JOIN tg USING (nn, st))"""


def alias_rows(spark, d):
    """Grant rows as witnesses (an organisation was filed), unlinked rows of the same form, and targets."""
    e = rel(spark, d, "funding_events").filter("event_type = 'grant' and recipient_name is not null")
    named = F.col("source_record_key").startswith("irs990:")
    kind = F.when(named & F.col("recipient_org_id").isNotNull(), "W").when(named, "U").when(F.col("source_record_key").startswith("irs990pf:") & F.col("recipient_org_id").isNull(), "T")
    return e.select(kind.alias("kind"), "event_id", T.norm_name(F.col("recipient_name")).alias("nn"), F.nullif(F.trim("recipient_state"), F.lit("")).alias("st"), T.norm_name(F.col("recipient_city")).alias("city"), F.col("recipient_org_id").alias("org_id"), "funder_org_id", "amount", "fy").filter("kind is not null and st is not null")


def witnesses(raw):
    """Every witness key with its top organisation: most filers, then most rows, then the smallest id."""
    w = raw.filter("kind = 'W'")
    by_org = w.groupBy("nn", "st", "org_id").agg(F.count_distinct("funder_org_id").alias("n_filers"), F.count("*").alias("n_rows"), F.collect_set("city").alias("cities"), F.min("fy").alias("first_fy"), F.max("fy").alias("last_fy"))
    top = R.latest_per_key(by_org, ["nn", "st"], F.desc("n_filers"), F.desc("n_rows"), F.asc("org_id"))
    every = w.groupBy("nn", "st").agg(F.count_distinct("funder_org_id").alias("all_filers"), F.count_distinct("org_id").alias("n_orgs"))
    u = raw.filter("kind = 'U'").groupBy("nn", "st").agg(F.count_distinct("funder_org_id").alias("n_unlinked"))
    return top.join(every, ["nn", "st"]).join(u, ["nn", "st"], "left").withColumn("n_unlinked", F.coalesce("n_unlinked", F.lit(0)).cast("long"))


def aliases(spark, d):
    raw = alias_rows(spark, d)
    o = rel(spark, d, "organizations").filter(F.col("org_type").isin(*TYPES)).select("org_id", T.norm_name(F.col("city")).alias("org_city"))
    m = matches(spark, d).filter("st is not null").select("nn", "st")
    c = witnesses(raw).filter("all_filers >= 2").filter((F.length("nn") >= MIN_NAME) & ~T.is_placeholder(F.col("nn"))).join(o, "org_id").join(m, ["nn", "st"], "left_anti")
    cities = F.array_sort(F.filter(F.array_distinct(F.array_append("cities", F.col("org_city"))), lambda x: x.isNotNull() & (x != "")))
    f, a = F.col("n_filers"), F.col("all_filers")
    status = F.when(F.col("n_unlinked") * 2 >= f, "contested").when(F.col("n_orgs") == 1, "unanimous").when((f >= DOMINANT_FILERS) & (f * 100 >= a * DOMINANT_PERCENT), "dominant").otherwise("contested")
    keep = c.withColumns({"witness": cities, "status": status})
    by_city = raw.filter("kind = 'T'").groupBy("nn", "st", "city").agg(F.count("*").alias("n"), F.sum("amount").alias("amt"))
    ok = F.array_contains("witness", F.col("city"))
    tg = keep.select("nn", "st", "witness").join(by_city, ["nn", "st"]).groupBy("nn", "st").agg(F.sum("n").alias("target_rows"), F.sum(F.when(ok, F.col("n"))).alias("rows_city_ok"), F.sum(F.when(ok, F.col("amt"))).alias("amt_ok"))
    j = keep.join(tg, ["nn", "st"], "left").withColumns({"target_rows": F.coalesce("target_rows", F.lit(0)).cast("long"), "rows_city_ok": F.coalesce("rows_city_ok", F.lit(0)).cast("long")})
    return j.withColumn("amount_city_ok", F.when(F.col("rows_city_ok") == 0, F.lit(0.0)).otherwise(F.col("amt_ok").cast("double")))


@query(cte(*_OF) + _ALIAS + " SELECT nn, st, org_id, n_filers, n_rows, n_orgs, n_unlinked, array_to_string(witness, ',') AS cities, first_fy, last_fy, status, target_rows, rows_city_ok, amount_city_ok FROM fin")
def er_aliases(spark, d):
    """ER-05, ALS-01..09, JN-18, AGG-07, SRT-09: what filers agree that a name stands for, by whole-number shares, and the rows it would reach."""
    return aliases(spark, d).select("nn", "st", "org_id", "n_filers", "n_rows", "n_orgs", "n_unlinked", F.array_join("witness", ",").alias("cities"), "first_fy", "last_fy", "status", "target_rows", "rows_city_ok", "amount_city_ok")


@query(cte(*_OF) + _ALIAS + " SELECT event_id, fin.nn, fin.st, fin.org_id FROM fin JOIN raw ON raw.nn = fin.nn AND raw.st = fin.st AND kind = 'T' AND list_contains(witness, raw.city) WHERE status = 'unanimous' AND n_filers >= 3")
def er_alias_links(spark, d):
    """ER-06, JN-18: the ledger of a strict apply: unanimous, three filers or more, the row's city among the witnesses'."""
    return alias_links(spark, d)


def alias_links(spark, d):
    a = aliases(spark, d).filter((F.col("status") == "unanimous") & (F.col("n_filers") >= MIN_FILERS)).select("nn", "st", "org_id", "witness")
    t = alias_rows(spark, d).filter("kind = 'T'").select("event_id", "nn", "st", "city")
    return t.join(a, ["nn", "st"]).filter(F.array_contains("witness", F.col("city"))).select("event_id", "nn", "st", "org_id")


_LINKS = ", links AS (SELECT event_id, fin.nn, fin.st, fin.org_id, fin.org_id % 25 AS file_id FROM fin JOIN raw ON raw.nn = fin.nn AND raw.st = fin.st AND kind = 'T' AND list_contains(witness, raw.city) WHERE status = 'unanimous' AND n_filers >= 3)"


@query(cte(*_OF, "raw_files", "licensing_map") + _ALIAS + _LINKS + ", ok AS (SELECT file_id FROM raw_files f JOIN licensing_map l ON l.license_code = f.license_code WHERE republishable) SELECT event_id, nn, org_id FROM links l WHERE file_id IN (SELECT file_id FROM ok) AND EXISTS (SELECT 1 FROM funding_events e WHERE e.event_id = l.event_id AND e.recipient_org_id IS NULL AND e.file_id IN (SELECT file_id FROM ok))")
def view_alias_links(spark, d):
    """VIEW-15: links whose two files may both be shown and whose row no one else has linked since."""
    files = rel(spark, d, "raw_files").join(rel(spark, d, "licensing_map").filter("republishable"), "license_code").select("file_id")
    e = rel(spark, d, "funding_events").filter("recipient_org_id is null").join(files, "file_id", "left_semi").select("event_id")
    links = alias_links(spark, d).withColumn("file_id", F.col("org_id") % 25).join(files, "file_id", "left_semi")
    return links.join(e, "event_id", "left_semi").select("event_id", "nn", "org_id")


@query(cte(*_OF) + _ALIAS + """, d AS (SELECT nn, st, org_id AS d_org, witness AS old_witness FROM fin WHERE length(nn) % 3 <> 0 UNION ALL SELECT nn, st, org_id + 1, cities FROM al WHERE length(nn) % 7 = 0 AND (nn, st) NOT IN (SELECT nn, st FROM fin WHERE length(nn) % 3 <> 0))
SELECT d.nn, d.st, d_org, f.nn IS NOT NULL AS derived, coalesce(f.org_id = d_org, false) AS same_org, CASE WHEN f.org_id = d_org THEN f.status ELSE 'contested' END AS status, CASE WHEN f.org_id = d_org THEN f.n_filers ELSE coalesce(w.n_filers, 0) END AS n_filers, CASE WHEN f.org_id = d_org THEN f.n_orgs ELSE coalesce(k.n_orgs, 0) END AS n_orgs
FROM d LEFT JOIN fin f ON f.nn = d.nn AND f.st = d.st LEFT JOIN w ON w.nn = d.nn AND w.st = d.st AND w.org_id = d_org LEFT JOIN k ON k.nn = d.nn AND k.st = d.st""")
def er_relink(spark, d):
    """ER-07: linked names under new evidence; one that the evidence no longer gives, or gives another organisation, becomes contested."""
    raw = alias_rows(spark, d)
    f = aliases(spark, d)
    linked = f.filter(F.length("nn") % 3 != 0).select("nn", "st", F.col("org_id").alias("d_org"))
    gone = witnesses(raw).filter(F.length("nn") % 7 == 0).select("nn", "st", (F.col("org_id") + 1).alias("d_org")).join(linked, ["nn", "st"], "left_anti")
    w = raw.filter("kind = 'W'")
    by_org = w.groupBy("nn", "st", F.col("org_id").alias("d_org")).agg(F.count_distinct("funder_org_id").alias("w_filers"))
    every = w.groupBy("nn", "st").agg(F.count_distinct("org_id").alias("k_orgs"))
    j = linked.unionByName(gone).join(f.select("nn", "st", "org_id", "status", "n_filers", "n_orgs", F.lit(True).alias("has")), ["nn", "st"], "left").join(by_org, ["nn", "st", "d_org"], "left").join(every, ["nn", "st"], "left")
    same = F.coalesce(F.col("org_id") == F.col("d_org"), F.lit(False))
    return j.select("nn", "st", "d_org", F.coalesce("has", F.lit(False)).alias("derived"), same.alias("same_org"), F.when(same, F.col("status")).otherwise("contested").alias("status"), F.when(same, F.col("n_filers")).otherwise(F.coalesce("w_filers", F.lit(0))).cast("long").alias("n_filers"), F.when(same, F.col("n_orgs")).otherwise(F.coalesce("k_orgs", F.lit(0))).cast("long").alias("n_orgs"))


@query(cte(*_OF) + _TIERS + _RAW + """ SELECT method, count(*) AS keys, count(al.nn) AS with_witness, count(*) FILTER (al.org_id = m.org_id) AS agree, count(*) FILTER (n_orgs = 1 AND n_filers >= 3 AND n_unlinked * 2 < n_filers) AS strict, count(*) FILTER (n_orgs = 1 AND n_filers >= 3 AND n_unlinked * 2 < n_filers AND al.org_id = m.org_id) AS strict_agree
FROM m LEFT JOIN al ON al.nn = m.nn AND al.st = m.st GROUP BY 1""")
def er_tier_agreement(spark, d):
    """ER-08: how the tiers agree with what filers wrote."""
    a = witnesses(alias_rows(spark, d)).select("nn", "st", F.col("org_id").alias("a_org"), "n_orgs", "n_filers", "n_unlinked", F.lit(1).alias("has"))
    j = matches(spark, d).join(a, ["nn", "st"], "left")
    strict = (F.col("n_orgs") == 1) & (F.col("n_filers") >= MIN_FILERS) & (F.col("n_unlinked") * 2 < F.col("n_filers"))
    agree = F.col("a_org") == F.col("org_id")
    return j.groupBy("method").agg(F.count("*").alias("keys"), F.count("has").alias("with_witness"), F.count_if(agree).alias("agree"), F.count_if(strict).alias("strict"), F.count_if(strict & agree).alias("strict_agree"))


@query(cte(*_OF) + _ALIAS + " SELECT status, n_filers >= 3 AS enough, count(*) AS keys, count(*) FILTER (rows_city_ok > 0) AS keys_with_rows, CAST(sum(target_rows) AS BIGINT) AS target_rows, CAST(sum(rows_city_ok) AS BIGINT) AS rows_city_ok, round(sum(amount_city_ok), 2) AS amount FROM fin GROUP BY 1, 2")
def er_alias_summary(spark, d):
    """ALS-11: keys and reached rows by status and number of filers."""
    a = aliases(spark, d)
    return a.groupBy("status", (F.col("n_filers") >= MIN_FILERS).alias("enough")).agg(F.count("*").alias("keys"), F.count_if(F.col("rows_city_ok") > 0).alias("keys_with_rows"), F.sum("target_rows").alias("target_rows"), F.sum("rows_city_ok").alias("rows_city_ok"), F.round(F.sum("amount_city_ok"), 2).alias("amount"))


@query(cte(*_OF) + _ALIAS + """, old AS (SELECT nn, st, org_id + 1 AS org_id, length(nn) % 2 = 0 AS linked FROM fin WHERE length(nn) % 3 = 0 UNION ALL SELECT 'OLD NAME ' || n_filers, st, min(org_id), n_filers % 2 = 0 FROM fin GROUP BY 1, 2, 4)
SELECT coalesce(o.nn, f.nn) AS nn, coalesce(o.st, f.st) AS st, CASE WHEN o.linked THEN o.org_id ELSE f.org_id END AS org_id, coalesce(o.linked, false) AS linked FROM old o FULL JOIN fin f ON f.nn = o.nn AND f.st = o.st WHERE o.linked OR f.nn IS NOT NULL""")
def er_alias_store(spark, d):
    """ALS-10, SNK-04, SNK-06: a linked row stays, another is written anew, and a stale one without links goes."""
    f = aliases(spark, d).select("nn", "st", "org_id", "n_filers")
    was = f.filter(F.length("nn") % 3 == 0).select("nn", "st", (F.col("org_id") + 1).alias("o_org"), (F.length("nn") % 2 == 0).alias("linked"))
    gone = f.groupBy(F.concat(F.lit("OLD NAME "), F.col("n_filers").cast("string")).alias("nn"), "st", (F.col("n_filers") % 2 == 0).alias("linked")).agg(F.min("org_id").alias("o_org")).select("nn", "st", "o_org", "linked")
    j = was.unionByName(gone).join(f.withColumn("has", F.lit(True)), ["nn", "st"], "full_outer")
    linked = F.coalesce("linked", F.lit(False))
    return j.filter(linked | F.col("has")).select("nn", "st", F.when(linked, F.col("o_org")).otherwise(F.col("org_id")).alias("org_id"), linked.alias("linked"))


@query(cte("organizations", "org_identifiers") + f""", n AS (SELECT min(org_id) AS org_id, {_NORM.format('name')} AS nn FROM organizations GROUP BY 2 HAVING count(*) = 1), c AS (SELECT {_NORM.format('name')} AS nn, count(*) AS k FROM organizations GROUP BY 1),
q AS (SELECT org_id AS row_id, CASE org_id % 3 WHEN 0 THEN lpad(CAST(org_id * 37 % 1000000000 AS VARCHAR), 9, '0') WHEN 1 THEN '999' END AS ein, name || CASE WHEN org_id % 4 = 3 THEN ' X' ELSE '' END AS name FROM organizations)
SELECT row_id, CASE WHEN i.org_id IS NOT NULL THEN 'matched_ein' WHEN n.org_id IS NOT NULL THEN 'matched_name' WHEN c.k > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, coalesce(i.org_id, n.org_id) AS org_id FROM q LEFT JOIN org_identifiers i ON id_type = 'ein' AND id_value = lpad(q.ein, 9, '0') LEFT JOIN n ON n.nn = {_NORM.format('q.name')} LEFT JOIN c ON c.nn = {_NORM.format('q.name')}""")
def er_import_match(spark, d):
    """ER-18, ER-19: an imported row by its number, else by a name that only one organisation has; several are ambiguous, never a guess."""
    o = rel(spark, d, "organizations")
    k = F.col("org_id")
    q = o.select(k.alias("row_id"), F.when(k % 3 == 0, F.lpad((k * 37 % 1000000000).cast("string"), 9, "0")).when(k % 3 == 1, "999").alias("ein"), T.norm_name(F.concat("name", F.when(k % 4 == 3, " X").otherwise(""))).alias("nn"))
    by_name = o.groupBy(T.norm_name(F.col("name")).alias("nn")).agg(F.count("*").alias("k"), F.min("org_id").alias("n_org"))
    i = rel(spark, d, "org_identifiers").filter("id_type = 'ein'").select(F.col("org_id").alias("e_org"), F.col("id_value").alias("ein9"))
    j = q.join(i, T.ein(F.col("ein")) == F.col("ein9"), "left").join(by_name, "nn", "left")
    one = F.when(F.col("k") == 1, F.col("n_org"))
    return j.select("row_id", F.when(F.col("e_org").isNotNull(), "matched_ein").when(one.isNotNull(), "matched_name").when(F.col("k") > 1, "ambiguous").otherwise("unmatched").alias("outcome"), F.coalesce("e_org", one).alias("org_id"))

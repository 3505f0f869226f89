"""Search documents of funders, and the pools that find and rank them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import search as S
from ..operators.durable import durable
from ..operators.understand import LEG_LIMITS, WEIGHTS
from ..sources.standin import cte, rel
from ..sources.tables import table
from . import filings
from .registry import query

CAP = 4000
_OF = ("organizations", "funding_events", "filings", "filing_financials", "application_info")
_LIVE = "lf AS (SELECT *, CASE WHEN object_id < max(object_id) OVER w THEN max(object_id) OVER w END AS superseded_by FROM filings WINDOW w AS (PARTITION BY ein, return_type, tax_period))"


def _list(key, n, sep, order="total DESC NULLS LAST", shown="k"):
    return f"(SELECT f, string_agg({shown}, '{sep}' ORDER BY rn) AS txt FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY {order}, k) AS rn FROM (SELECT funder_org_id AS f, {key} AS k, count(*) AS n, sum(amount) AS total FROM funding_events WHERE event_type = 'grant' AND {key} IS NOT NULL GROUP BY 1, 2)) WHERE rn <= {n} GROUP BY 1)"


_DOC = f""", {_LIVE}, pf AS (SELECT DISTINCT ON (org_id) lf.org_id, lf.object_id, return_type, distributions FROM lf JOIN filing_financials ff ON ff.object_id = lf.object_id WHERE superseded_by IS NULL ORDER BY org_id, tax_period DESC, lf.object_id DESC),
po AS (SELECT pf.org_id, CASE WHEN a.object_id IS NULL THEN 'unknown' WHEN only_preselected THEN 'preselected_only' ELSE 'open' END AS posture, deadlines_txt FROM pf LEFT JOIN application_info a ON a.object_id = pf.object_id WHERE return_type = '990PF'),
st AS (SELECT funder_org_id AS f, count(*) AS n, sum(amount) AS total, min(fy) AS a, max(fy) AS b FROM funding_events WHERE event_type = 'grant' GROUP BY 1),
doc AS (SELECT o.org_id, o.name, o.state, o.org_type, coalesce(po.posture, 'unknown') AS posture, round(CAST(coalesce(distributions, CAST(total AS DOUBLE) / nullif(b - a + 1, 0)) AS DOUBLE), 2) AS yearly, b AS last_fy, left(o.name || ' - ' || CASE WHEN org_type = 'public_charity' THEN 'grantmaking public charity' ELSE 'private foundation' END || ' in ' || coalesce(city || ', ', '') || coalesce(o.state, 'US') || '. '
|| coalesce('Assets $' || assets || '. ', '') || CASE po.posture WHEN 'open' THEN 'Accepts unsolicited grant applications. ' WHEN 'preselected_only' THEN 'Does not accept unsolicited applications. ' ELSE '' END || n || ' grants on file, FY' || coalesce(a::VARCHAR, '?') || '-' || coalesce(b::VARCHAR, '?') || '. '
|| coalesce('Grant purposes: ' || p.txt || '. ', '') || coalesce('Grantees: ' || r.txt || '. ', '') || coalesce('Grant geography: ' || g.txt || '.', '') || coalesce(' Application deadlines: ' || left(deadlines_txt, 240) || '.', ''), 4000) AS doc_text
FROM organizations o JOIN st ON st.f = o.org_id LEFT JOIN pf ON pf.org_id = o.org_id LEFT JOIN po ON po.org_id = o.org_id LEFT JOIN {_list('upper(purpose)', 8, '; ', shown="k || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END")} p ON p.f = o.org_id LEFT JOIN {_list('upper(recipient_name)', 4, '; ')} r ON r.f = o.org_id LEFT JOIN {_list('recipient_state', 5, ', ', 'n DESC')} g ON g.f = o.org_id)"""


def _top(g, key, n, sep, by_count=False, counted=False):
    """The first ``n`` values of each funder as one text."""
    e = g.filter(F.col(key).isNotNull()).groupBy(F.col("funder_org_id").alias("org_id"), F.col(key).alias("k")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    top = R.top_per_key(e, ["org_id"], n, F.desc("n") if by_count else F.col("total").desc_nulls_last(), F.asc("k"))
    shown = F.concat("k", F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise("")) if counted else F.col("k")
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s")))), lambda x: x["s"])
    return top.groupBy("org_id").agg(F.array_join(items, sep).alias(f"{key}_txt"))


def documents(spark, d):
    """One text for each funder that gave: who, where, whether it takes requests, and what it gave for, to whom and where; at most ``CAP`` characters."""
    g = rel(spark, d, "funding_events").filter("event_type = 'grant'").withColumns({"purpose": F.upper("purpose"), "recipient_name": F.upper("recipient_name")})
    st = g.groupBy(F.col("funder_org_id").alias("org_id")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.min("fy").alias("a"), F.max("fy").alias("b"))
    p = filings.parsed(spark, d)
    newest = R.latest_per_key(p, ["org_id"], F.desc("tax_period"), F.desc("object_id")).select("org_id", "object_id", "return_type", "distributions")
    a = rel(spark, d, "application_info").select("object_id", "only_preselected", "deadlines_txt", F.lit(True).alias("has"))
    newest = newest.join(a, "object_id", "left").withColumn("answer", F.when(F.col("return_type") == "990PF", filings.posture(F.coalesce("has", F.lit(False)), F.col("only_preselected"))))
    j = rel(spark, d, "organizations").join(st, "org_id").join(newest, "org_id", "left")
    for key, n, sep, by_count, counted in (("purpose", 8, "; ", False, True), ("recipient_name", 4, "; ", False, False), ("recipient_state", 5, ", ", True, False)):
        j = j.join(_top(g, key, n, sep, by_count, counted), "org_id", "left")
    opt = lambda *parts: F.coalesce(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]), F.lit(""))
    c = F.col
    says = F.when(c("answer") == "open", "Accepts unsolicited grant applications. ").when(c("answer") == "preselected_only", "Does not accept unsolicited applications. ").otherwise("")
    year = lambda x: F.coalesce(c(x).cast("string"), F.lit("?"))
    deadline = F.when(c("return_type") == "990PF", c("deadlines_txt"))
    text = F.concat(
        c("name"), F.lit(" - "), F.when(c("org_type") == "public_charity", "grantmaking public charity").otherwise("private foundation"), F.lit(" in "), opt(c("city"), ", "), F.coalesce("state", F.lit("US")), F.lit(". "),
        opt("Assets $", c("assets").cast("string"), ". "), says, c("n").cast("string"), F.lit(" grants on file, FY"), year("a"), F.lit("-"), year("b"), F.lit(". "),
        opt("Grant purposes: ", c("purpose_txt"), ". "), opt("Grantees: ", c("recipient_name_txt"), ". "), opt("Grant geography: ", c("recipient_state_txt"), "."), opt(" Application deadlines: ", F.left(deadline, F.lit(240)), "."),
    )
    yearly = F.coalesce(c("distributions").cast("double"), F.try_divide(c("total"), c("b") - c("a") + 1))
    return j.select("org_id", "name", "state", "org_type", F.coalesce("answer", F.lit("unknown")).alias("posture"), F.round(yearly, 2).alias("yearly"), c("b").alias("last_fy"), F.left(text, F.lit(CAP)).alias("doc_text"))


@query(cte(*_OF) + _DOC + " SELECT org_id, posture, yearly, doc_text, sha256(doc_text || '|v1') AS doc_hash FROM doc")
def doc_foundations(spark, d):
    """DOC-01, HSH-01, AGG-05, WIN-02, WIN-07, PRJ-03."""
    return documents(spark, d).select("org_id", "posture", "yearly", "doc_text", F.sha2(F.concat("doc_text", F.lit("|v1")).cast("binary"), 256).alias("doc_hash"))


@query(cte(*_OF) + _DOC + """, was AS (SELECT org_id, sha256(doc_text || CASE WHEN org_id % 3 = 0 THEN '|v0' ELSE '|v1' END) AS h FROM doc WHERE org_id % 4 <> 1 UNION ALL SELECT -1 - org_id, 'gone' FROM doc WHERE org_id % 50 = 0)
SELECT coalesce(d.org_id, w.org_id) AS org_id, CASE WHEN w.org_id IS NULL THEN 'insert' WHEN d.org_id IS NULL THEN 'prune' WHEN w.h <> sha256(doc_text || '|v1') THEN 'update' ELSE 'keep' END AS step FROM doc d FULL JOIN was w ON w.org_id = d.org_id""")
def doc_refresh(spark, d):
    """DOC-02: what a rebuild does to each stored document; a changed hash resets its embedding."""
    now = doc_foundations(spark, d).select("org_id", "doc_hash", "doc_text")
    v0 = F.sha2(F.concat("doc_text", F.when(F.col("org_id") % 3 == 0, "|v0").otherwise("|v1")).cast("binary"), 256)
    was = now.filter("org_id % 4 <> 1").select("org_id", v0.alias("h")).unionByName(now.filter("org_id % 50 = 0").select((-1 - F.col("org_id")).alias("org_id"), F.lit("gone").alias("h")))
    return S.refresh_steps(now.select("org_id", "doc_hash"), was, "org_id")


_TOK = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
_COS = "round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12)"
_POOL = _DOC + f""", legs AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY {_COS}, v.vec_id) AS r, 1 AS leg FROM embeddings v JOIN doc ON doc.org_id = v.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 3) q QUALIFY r <= 60
UNION ALL SELECT org_id, row_number() OVER (ORDER BY yearly DESC NULLS LAST, org_id), 2 FROM doc WHERE list_has_all({_TOK.format('doc_text')}, ['youth', 'ring']) QUALIFY row_number() OVER (ORDER BY yearly DESC NULLS LAST, org_id) <= 30
UNION ALL SELECT org_id, row_number() OVER (ORDER BY yearly DESC NULLS LAST, org_id), 3 FROM doc WHERE state = 'NATION_4' QUALIFY row_number() OVER (ORDER BY yearly DESC NULLS LAST, org_id) <= 15
UNION ALL SELECT funder_org_id, row_number() OVER (ORDER BY count(*) DESC, funder_org_id), 4 FROM funding_events WHERE event_type = 'grant' AND recipient_state = 'NATION_4' AND fy BETWEEN 1997 AND 2001 GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, funder_org_id) <= 30),
cand AS (SELECT id, min(r) FILTER (leg = 1) AS sem, min(r) FILTER (leg = 2) AS kw, min(r) FILTER (leg = 3) AS loc, min(r) FILTER (leg = 4) AS giv FROM legs GROUP BY 1),
sc AS (SELECT doc.*, 30.5 * (coalesce(1.0::DOUBLE / (60 + sem), 0) + 0.8 * coalesce(1.0::DOUBLE / (60 + kw), 0) + coalesce(1.0::DOUBLE / (60 + loc), 0) + coalesce(1.0::DOUBLE / (60 + giv), 0)) AS rel FROM cand JOIN doc ON doc.org_id = id WHERE org_id NOT IN (SELECT org_id FROM organizations WHERE canonical_id IS NOT NULL) ORDER BY round(rel, 10) DESC, org_id LIMIT 40),
ft AS (SELECT sc.*, coalesce(gs.n, 0) AS in_state, CASE WHEN regexp_matches(doc_text, 'Grantees: .*?[.] Grant geography:') THEN len(string_split(regexp_extract(doc_text, 'Grantees: (.*?)[.] Grant geography:', 1), '; ')) END AS n_grantees FROM sc LEFT JOIN (SELECT funder_org_id, count(*) AS n FROM funding_events WHERE event_type = 'grant' AND recipient_state = 'NATION_4' AND fy BETWEEN 1997 AND 2001 GROUP BY 1) gs ON gs.funder_org_id = sc.org_id)"""


def giving_in(spark, d, state: str):
    g = rel(spark, d, "funding_events").filter(f"event_type = 'grant' and fy between 1997 and 2001 and recipient_state = '{state}'")
    return g.groupBy(F.col("funder_org_id").alias("org_id")).agg(F.count("*").alias("in_state"))


def topic_pool(spark, d, words: str, state: str, vec_id: int, limits=LEG_LIMITS, weights=WEIGHTS):
    """Up to four ranked legs, each cut before it is numbered, merged by weighted reciprocal ranks; the best keep on to their features and fit."""
    doc = durable(documents(spark, d), "documents")  # read by each leg
    order = (F.col("yearly").desc_nulls_last(), F.asc("org_id"))
    leg = lambda df, n, k, *by: R.ranked(df, n, *by).select("org_id", F.col("rank").alias("r"), F.lit(k).alias("leg"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("org_id"), "embedding").join(doc.select("org_id"), "org_id", "left_semi")
    mean = S.vector_leg(vectors, "org_id", "embedding", S.seed_vector(table(spark, d, "embeddings"), "vec_id", vec_id), limits["meaning"])
    giving = giving_in(spark, d, state)
    legs = mean.select("org_id", F.col("vec_rank").alias("r"), F.lit(1).alias("leg"))
    legs = legs.unionByName(leg(doc.filter(S.WebQuery.parse(words).matches(F.col("doc_text"))), limits["keywords"], 2, *order))
    legs = legs.unionByName(leg(doc.filter(F.col("state") == state), limits["local"], 3, *order)).unionByName(leg(giving, limits["givers"], 4, F.desc("in_state"), F.asc("org_id")))
    cand = legs.groupBy("org_id").agg(*[F.min(F.when(F.col("leg") == k, F.col("r"))).alias(c) for k, c in ((1, "sem"), (2, "kw"), (3, "loc"), (4, "giv"))])
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    score = 30.5 * (part("sem") + weights["keyword_leg"] * part("kw") + weights["local_leg"] * part("loc") + weights["local_leg"] * part("giv"))
    main = rel(spark, d, "organizations").filter("canonical_id is null").select("org_id")
    best = cand.withColumn("rel", score).join(doc, "org_id").join(main, "org_id", "left_semi").orderBy(F.round("rel", 10).desc(), "org_id").limit(limits["features"])
    feat = best.join(giving, "org_id", "left").withColumn("in_state", F.coalesce("in_state", F.lit(0)).cast("long"))
    listed = F.nullif(F.regexp_extract("doc_text", r"Grantees: (.*?)[.] Grant geography:", 1), F.lit(""))
    return feat.withColumn("n_grantees", F.size(F.split(listed, "; ")).cast("long")).withColumn("n_grantees", F.when(listed.isNotNull(), F.col("n_grantees")))


def fit(state: str, max_fy: int, weights=WEIGHTS):
    """What a searcher's place and a funder's habits add to relevance."""
    geo = F.when(F.col("in_state") > 0, weights["geo"] * F.least(F.lit(1.0), F.ln(1.0 + F.col("in_state")) / F.ln(F.lit(21.0)))).otherwise(0.0)
    few = F.when(F.col("n_grantees") == 1, -weights["few_grantees"]).when(F.col("n_grantees") == 2, -weights["few_grantees"] * 0.75).when(F.col("n_grantees") == 3, -weights["few_grantees"] * 0.3).otherwise(0.0)
    says = F.when(F.col("posture") == "open", weights["open"]).when(F.col("posture") == "preselected_only", -weights["preselected"]).otherwise(0.0)
    return F.col("rel") + geo + F.when(F.col("state") == state, weights["located"]).otherwise(0.0) + says + F.when(F.col("last_fy") < max_fy - 3, -weights["stale"]).otherwise(0.0) + few


@query(cte(*_OF) + _POOL + """ SELECT org_id, in_state, n_grantees, round(rel + CASE WHEN in_state > 0 THEN 0.45 * least(1.0, ln(1 + in_state) / ln(21)) ELSE 0 END + CASE WHEN state = 'NATION_4' THEN 0.15 ELSE 0 END + CASE posture WHEN 'open' THEN 0.05 WHEN 'preselected_only' THEN -0.12 ELSE 0 END
+ CASE WHEN last_fy < 1998 THEN -0.2 ELSE 0 END + CASE n_grantees WHEN 1 THEN -0.2 WHEN 2 THEN -0.15 WHEN 3 THEN -0.06 ELSE 0 END, 8) AS rank, left(doc_text, 240) AS snippet FROM ft""")
def hyb_topic_pool(spark, d):
    """HYB-02, HYB-04, HYB-05, HYB-06, SET-01, AGG-22: the topic pool with its fit score."""
    pool = topic_pool(spark, d, "youth ring", "NATION_4", 3)
    return pool.select("org_id", "in_state", "n_grantees", F.round(fit("NATION_4", 2001), 8).alias("rank"), F.left("doc_text", F.lit(240)).alias("snippet"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(cte(*_OF) + _DOC + f""", n AS (SELECT o.org_id, trim(regexp_replace(upper(o.name), '[^A-Z0-9_ &-]+', ' ', 'g')) AS nn, {_TRI.format('o.name')} AS g, {_TRI.format("'Red Ring'")} AS q, greatest(coalesce(yearly, 0), coalesce(assets, 0) * 0.05, 0) AS giving FROM organizations o LEFT JOIN doc ON doc.org_id = o.org_id)
SELECT org_id, round(CASE WHEN nn = 'RED RING' THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(nn, '\\bRED RING\\b') THEN 1 ELSE 0 END + CASE WHEN nn LIKE 'RED RING%' THEN 0.5 ELSE 0 END + len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q)))::DOUBLE + 0.35 * log10(1 + giving), 8) AS rank FROM n WHERE contains(nn, 'RED RING') ORDER BY 2 DESC, 1 LIMIT 200""")
def hyb_name_pool(spark, d):
    """HYB-07, FTS-03, STR-20, MTH-02: the exact name, the name as a phrase, its beginning, likeness, and how much the funder gives."""
    return name_pool(spark, d, "Red Ring").orderBy(F.desc("rank"), "org_id").limit(200)


def name_pool(spark, d, name: str):
    from ..operators.understand import normal_name

    nn, want = T.norm_name(F.col("name")), normal_name(name)
    o = rel(spark, d, "organizations").filter(F.contains(nn, F.lit(want)))
    j = o.join(documents(spark, d).select("org_id", "yearly"), "org_id", "left")
    giving = F.greatest(F.coalesce("yearly", F.lit(0.0)), F.coalesce(F.col("assets") * 0.05, F.lit(0.0)), F.lit(0.0))
    like = T.similarity(T.trigrams(F.col("name")), T.trigrams(F.lit(name)))
    score = F.when(nn == want, 1.5).otherwise(0.0) + F.when(nn.rlike(rf"\b{want}\b"), 1.0).otherwise(0.0) + F.when(nn.startswith(want), 0.5).otherwise(0.0) + like + 0.35 * F.log10(1 + giving)
    return j.select("org_id", F.round(score, 8).alias("rank"))


@query(cte("organizations", "org_identifiers", *_OF[1:]) + _DOC + """, pools AS (SELECT 'ein' AS pool, o.org_id, 1.0::DOUBLE AS rank FROM organizations o JOIN org_identifiers i ON i.org_id = o.org_id AND id_type = 'ein' AND id_value = lpad('74', 9, '0')
UNION ALL SELECT 'browse', org_id, yearly FROM (SELECT org_id, yearly FROM doc WHERE yearly IS NOT NULL ORDER BY yearly DESC, org_id LIMIT 20) UNION ALL SELECT 'giving', org_id, n FROM (SELECT funder_org_id AS org_id, count(*)::DOUBLE AS n FROM funding_events WHERE event_type = 'grant' AND recipient_state = 'NATION_2' AND fy BETWEEN 1997 AND 2001 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)) SELECT * FROM pools""")
def hyb_other_pools(spark, d):
    """HYB-08, HYB-09: by number, by size of giving, and by giving to a place."""
    i = rel(spark, d, "org_identifiers").filter((F.col("id_type") == "ein") & (F.col("id_value") == T.ein(F.lit("74"))))
    by_number = i.select(F.lit("ein").alias("pool"), "org_id", F.lit(1.0).alias("rank"))
    browse = documents(spark, d).filter("yearly is not null").orderBy(F.desc("yearly"), "org_id").limit(20).select(F.lit("browse").alias("pool"), "org_id", F.col("yearly").alias("rank"))
    giving = giving_in(spark, d, "NATION_2").orderBy(F.desc("in_state"), "org_id").limit(20).select(F.lit("giving").alias("pool"), "org_id", F.col("in_state").cast("double").alias("rank"))
    return by_number.unionByName(browse).unionByName(giving)


@query(cte(*_OF) + _DOC + f", n AS (SELECT doc.org_id, doc.name, yearly FROM doc WHERE list_has_all({_TOK.format('name')}, ['blue', 'ring'])) SELECT org_id, yearly FROM n ORDER BY yearly DESC NULLS LAST, org_id LIMIT 3")
def hyb_named_funders(spark, d):
    """HYB-13: funders whose name holds the words nearly whole, the biggest givers first, above a topic's results."""
    near = T.word_similarity(F.lit("blue ring"), F.col("name")) >= 0.8
    return documents(spark, d).filter(near).orderBy(F.col("yearly").desc_nulls_last(), "org_id").limit(3).select("org_id", "yearly")


@query(cte("funding_events") + f"""SELECT funder_org_id, count(*) AS hits, CAST(sum(amount) AS DOUBLE) AS total, max(recipient_name) AS sample FROM (SELECT *, ' ' || array_to_string({_TOK.format("coalesce(recipient_name, '') || ' ' || purpose")}, ' ') || ' ' AS j FROM funding_events) WHERE event_type = 'grant' AND contains(j, ' food bank ') GROUP BY 1 ORDER BY total DESC NULLS LAST, 1 LIMIT 100""")
def hyb_giving_to(spark, d):
    """HYB-15, STR-23, FTS-05: several words are a phrase; hits, sum and a sample for each funder, the largest sum first."""
    from ..operators.understand import phrase_query

    q = S.WebQuery.parse(phrase_query("food bank"))
    e = rel(spark, d, "funding_events").filter("event_type = 'grant'").filter(q.matches(F.concat_ws(" ", F.coalesce("recipient_name", F.lit("")), "purpose")))
    g = e.groupBy("funder_org_id").agg(F.count("*").alias("hits"), F.sum("amount").cast("double").alias("total"), F.max("recipient_name").alias("sample"))
    return g.orderBy(F.col("total").desc_nulls_last(), "funder_org_id").limit(100)


@query(cte("organizations") + f"""SELECT org_id, 'text' AS found_by FROM organizations WHERE list_has_all({_TOK.format('name')}, ['hot', 'gear', 'school']) UNION ALL SELECT org_id, 'likeness' FROM (SELECT org_id, {_TRI.format('name')} AS g, {_TRI.format("'hot gear schol'")} AS q FROM organizations) WHERE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q)))::DOUBLE >= 0.6
AND (SELECT count(*) FROM organizations WHERE list_has_all({_TOK.format('name')}, ['hot', 'gear', 'schol'])) < 3""")
def fts_with_fallback(spark, d):
    """FTS-06, HYB-12: words first; likeness where they find fewer than three."""
    o = rel(spark, d, "organizations").select("org_id", "name")
    near = lambda q: T.similarity(T.trigrams(F.col("name")), T.trigrams(F.lit(q))) >= 0.6
    exact = S.with_fallback(o, "org_id", "name", "hot gear school", near("hot gear school"), least=0)
    return exact.unionByName(S.with_fallback(o, "org_id", "name", "hot gear schol", near("hot gear schol"), least=3))


_COVER = f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents), p AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM d), h AS (SELECT doc_id, t, i FROM p WHERE t IN ('license', 'version')),
w AS (SELECT *, max(CASE WHEN t = 'license' THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS a, max(CASE WHEN t = 'version' THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM h)"""


@query(_COVER + ", c AS (SELECT doc_id, i AS hi, least(a, b) AS lo FROM w WHERE a IS NOT NULL AND b IS NOT NULL), x AS (SELECT doc_id, lo, min(hi) AS hi FROM c GROUP BY 1, 2) SELECT doc_id, count(*) AS covers, round(sum(2.0 / (hi - lo + 1)), 8) AS rank FROM x GROUP BY 1")
def fts_cover_rank(spark, d):
    """FTS-04: cover density: each shortest stretch that holds every word counts by the inverse of its length."""
    return S.cover_rank(table(spark, d, "documents"), "doc_id", "text", ["license", "version"])


@query(f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents) SELECT doc_id, CAST(len(list_filter(ts[1:8], lambda t: t = 'licensed')) * 4 + len(list_filter(ts, lambda t: t IN ('license', 'licensed', 'licenses', 'licensing'))) AS BIGINT) AS weight FROM d WHERE len(list_filter(ts, lambda t: t IN ('license', 'licensed', 'licenses', 'licensing'))) > 0""")
def fts_weighted(spark, d):
    """FTS-01: stems of words with the weight of the part that they stand in: the first eight words count four times more."""
    stems = F.transform(S.tokens(F.col("text")), lambda t: F.when(t.isin("license", "licensed", "licenses", "licensing"), F.lit("licens")).otherwise(t))
    df = table(spark, d, "documents").select("doc_id", S.tokens(F.col("text")).alias("ts"), stems.alias("ss"))
    hit = lambda c, w: F.size(F.filter(c, lambda t: t == w))
    return df.select("doc_id", (hit(F.slice("ts", 1, 8), "licensed") * 4 + hit(F.col("ss"), "licens")).cast("long").alias("weight")).filter("weight > 0")


@query()
def vec_approximate(spark, d):
    """VEC-02, HYB-03: neighbours by random hyperplanes, for the vectors whose id 20 divides, against all; recall is tested against the exact search."""
    hits = S.approximate_neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", "vec_id % 20 = 0", 10)
    return hits.select("seed", "vec_id", F.round("sim", 6).alias("sim"))

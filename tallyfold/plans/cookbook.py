"""Benchmark and cookbook questions, and the small predicates, projections and orderings that they are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import classes as C
from ..operators import relational as R
from ..operators.durable import Tables
from ..operators.search import WebQuery
from ..sources.standin import cte, rel
from ..sources.tables import table
from . import filings
from .registry import query

_LIVE = "lf AS (SELECT *, CASE WHEN object_id < max(object_id) OVER w THEN max(object_id) OVER w END AS superseded_by FROM filings WINDOW w AS (PARTITION BY ein, return_type, tax_period))"
_NEWEST = f"""{_LIVE}, pf AS (SELECT DISTINCT ON (org_id) lf.org_id, lf.object_id, CAST(left(tax_period, 4) AS INT) AS year, assets, distributions FROM lf JOIN filing_financials ff ON ff.object_id = lf.object_id WHERE superseded_by IS NULL ORDER BY org_id, tax_period DESC, lf.object_id DESC)"""
_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


def topic(text, words: str):
    return WebQuery.parse(words).matches(text)


@query(cte("funding_programs") + f"SELECT program_id, agency, name FROM funding_programs WHERE non_dilutive AND (list_has_any({_WORDS.format('description')}, ['widget', 'economy']) OR list_has_any({_WORDS.format('agency')}, ['7']))")
def q_b1_programs(spark, d):
    """Q-B1: non-dilutive programs that match a topic in their own or their agency's text."""
    p = rel(spark, d, "funding_programs").filter("non_dilutive")
    return p.filter(topic(F.col("description"), "widget or economy") | topic(F.col("agency"), "7")).select("program_id", "agency", "name")


@query(cte("funding_programs") + "SELECT DISTINCT agency, name AS program FROM funding_programs WHERE program_type IN ('ECONOMY', 'SMALL')")
def q_b2_agencies(spark, d):
    """Q-B2, SET-05."""
    return rel(spark, d, "funding_programs").filter(F.col("program_type").isin("ECONOMY", "SMALL")).select("agency", F.col("name").alias("program")).distinct()


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(cte("organizations", "org_identifiers") + f"""SELECT o.org_id, o.name, id_value FROM (SELECT *, {_TRI.format('name')} AS g FROM organizations) o LEFT JOIN org_identifiers i ON i.org_id = o.org_id AND id_type = 'uei',
(SELECT {_TRI.format("'RED RING LIBRARY'")} AS q) x WHERE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q)))::DOUBLE >= 0.6 OR name ILIKE '%hot ring%'""")
def q_b3_names(spark, d):
    """Q-B3, FLT-03, FLT-06: names near a given one or holding a part, with their identifier where there is one."""
    o = rel(spark, d, "organizations")
    near = T.similarity(T.trigrams(F.col("name")), T.trigrams(F.lit("RED RING LIBRARY"))) >= 0.6
    i = rel(spark, d, "org_identifiers").filter("id_type = 'uei'").select("org_id", "id_value")
    return o.filter(near | F.col("name").ilike("%hot ring%")).join(i, "org_id", "left").select("org_id", "name", "id_value")


@query(cte("organizations", "org_identifiers") + f"SELECT o.org_id, o.name, assets, id_value AS ein FROM organizations o JOIN org_identifiers i ON i.org_id = o.org_id AND id_type = 'ein' WHERE org_type = 'private_foundation' AND (name ILIKE '%red%' OR name ILIKE '%hot%') ORDER BY assets DESC NULLS LAST, o.org_id LIMIT 25")
def q_b5_foundations(spark, d):
    """Q-B4, Q-B5, SRT-01: named foundations by assets, the unknown ones last."""
    o = rel(spark, d, "organizations").filter(F.col("org_type") == "private_foundation").filter(F.col("name").ilike("%red%") | F.col("name").ilike("%hot%"))
    i = rel(spark, d, "org_identifiers").filter("id_type = 'ein'").select("org_id", F.col("id_value").alias("ein"))
    return o.join(i, "org_id").orderBy(F.col("assets").desc_nulls_last(), "org_id").limit(25).select("org_id", "name", "assets", "ein")


@query(cte("organizations") + f"SELECT org_id, name, state, assets, ntee FROM organizations WHERE org_type = 'private_foundation' AND assets > 1000000 AND (list_has_any({_WORDS.format('name')}, ['ring', 'widget']) OR ntee LIKE 'C%') AND state <> 'NATION_3' ORDER BY assets DESC, org_id LIMIT 50")
def q_b7_topic_or_code(spark, d):
    """Q-B6, Q-B7, FLT-02, FLT-04: words or a code's beginning, above a size; filters that aren't asked for add nothing."""
    return ask(rel(spark, d, "organizations"), words="ring or widget", code="C", least=1_000_000, not_state="NATION_3").orderBy(F.desc("assets"), "org_id").limit(50).select("org_id", "name", "state", "assets", "ntee")


def ask(orgs, words: str | None = None, code: str | None = None, least: int | None = None, state: str | None = None, not_state: str | None = None):
    """Foundations by optional filters; one that is None isn't part of the plan."""
    out = orgs.filter("org_type = 'private_foundation'")
    match = [c for c in (topic(F.col("name"), words) if words else None, F.col("ntee").startswith(code) if code else None) if c is not None]
    if match:
        out = out.filter(match[0] if len(match) == 1 else match[0] | match[1])
    for given, c in ((least, F.col("assets") > F.lit(least)), (state, F.col("state") == F.lit(state)), (not_state, F.col("state") != F.lit(not_state))):
        if given is not None:
            out = out.filter(c)
    return out


@query(cte("funding_events", "organizations") + f"""SELECT event_id, o.name AS foundation, recipient_name, CAST(amount AS DOUBLE) AS amount, purpose FROM (SELECT *, ' ' || array_to_string({_WORDS.format("purpose || ' ' || coalesce(recipient_name, '')")}, ' ') || ' ' AS j FROM funding_events) e JOIN organizations o ON o.org_id = funder_org_id
WHERE event_type = 'grant' AND (contains(j, ' youth ') OR contains(j, ' hot ring ')) ORDER BY amount DESC NULLS LAST, event_id LIMIT 50""")
def q_b8_grants(spark, d):
    """Q-B8, FTS-05: grants that match a word or a quoted phrase in purpose or recipient, by amount."""
    e = rel(spark, d, "funding_events").filter("event_type = 'grant'").filter(topic(F.concat_ws(" ", "purpose", "recipient_name"), 'youth or "hot ring"'))
    top = e.orderBy(F.col("amount").desc_nulls_last(), "event_id").limit(50)
    o = rel(spark, d, "organizations").select(F.col("org_id").alias("funder_org_id"), F.col("name").alias("foundation"))
    return top.join(o, "funder_org_id").select("event_id", "foundation", "recipient_name", F.col("amount").cast("double").alias("amount"), "purpose")


@query(cte("funding_events") + "SELECT event_id, event_date FROM funding_events WHERE event_type = 'commitment' AND event_date > DATE '2001-06-01' - INTERVAL 12 MONTH AND event_date <= DATE '2001-06-01' ORDER BY event_date DESC, event_id LIMIT 50")
def q_b9_recent(spark, d):
    """Q-B9, FLT-14: a year back from a given day."""
    day = F.lit("2001-06-01").cast("date")
    return rel(spark, d, "funding_events").filter((F.col("event_type") == "commitment") & (F.col("event_date") > F.add_months(day, -12)) & (F.col("event_date") <= day)).orderBy(F.desc("event_date"), "event_id").limit(50).select("event_id", "event_date")


@query(cte("organizations", "raw_files", "licensing_map") + "SELECT count(*) AS total, count(*) FILTER (f.file_id IS NULL OR l.license_code IS NULL) AS orphans FROM organizations o LEFT JOIN (SELECT * FROM raw_files WHERE file_id <> 7) f ON f.file_id = o.file_id LEFT JOIN (SELECT * FROM licensing_map WHERE license_code <> 'EUROPE') l ON l.license_code = f.license_code")
def q_b10_orphans(spark, d):
    """Q-B10, DQ-04: rows whose file or license is missing (here one file and one license are)."""
    f = rel(spark, d, "raw_files").filter("file_id <> 7").join(rel(spark, d, "licensing_map").filter("license_code <> 'EUROPE'"), "license_code").select("file_id", F.lit(1).alias("sealed"))
    return rel(spark, d, "organizations").join(f, "file_id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("sealed").isNull()).alias("orphans"))


@query(cte("filings", "filing_financials", "application_info", "organizations") + f", {_NEWEST} SELECT o.org_id, o.name, o.state, distributions, year FROM pf JOIN organizations o ON o.org_id = pf.org_id LEFT JOIN application_info a ON a.object_id = pf.object_id WHERE org_type = 'private_foundation' AND a.object_id IS NOT NULL AND NOT only_preselected AND distributions >= 200000")
def q_c1_open(spark, d):
    """Q-C1: open to applications, with money paid out."""
    p = filings.mart_application_posture(spark, d).filter("posture = 'open'").select("org_id", "object_id", "year")
    m = filings.parsed(spark, d).select("object_id", "distributions").filter("distributions >= 200000")
    o = rel(spark, d, "organizations").select("org_id", "name", "state")
    return p.join(m, "object_id").join(o, "org_id").select("org_id", "name", "state", "distributions", "year")


@query(cte("funding_events", "organizations") + """, g AS (SELECT funder_org_id, recipient_state AS st, left(r.ntee, 1) AS cause FROM funding_events e LEFT JOIN organizations r ON r.org_id = e.recipient_org_id WHERE event_type = 'grant' AND fy BETWEEN 1997 AND 2001),
a AS (SELECT funder_org_id, count(*) AS in_state FROM g WHERE st = 'NATION_4' GROUP BY 1), b AS (SELECT funder_org_id, count(*) AS to_field FROM g WHERE cause = 'P' GROUP BY 1) SELECT a.funder_org_id AS org_id, name, in_state, to_field FROM a JOIN b ON a.funder_org_id = b.funder_org_id JOIN organizations o ON o.org_id = a.funder_org_id ORDER BY to_field DESC, in_state DESC, 1 LIMIT 50""")
def q_c2_field_and_state(spark, d):
    """Q-C2, MART-14, MART-15: who funds a field, and in a state, over five years; both counts from one pass."""
    r = rel(spark, d, "organizations").select(F.col("org_id").alias("recipient_org_id"), F.left("ntee", F.lit(1)).alias("cause"))
    g = rel(spark, d, "funding_events").filter("event_type = 'grant' and fy between 1997 and 2001").join(r, "recipient_org_id", "left")
    n = g.groupBy(F.col("funder_org_id").alias("org_id")).agg(F.count_if(F.col("recipient_state") == "NATION_4").alias("in_state"), F.count_if(F.col("cause") == "P").alias("to_field")).filter("in_state > 0 and to_field > 0")
    o = rel(spark, d, "organizations").select("org_id", "name")
    return n.join(o, "org_id").orderBy(F.desc("to_field"), F.desc("in_state"), "org_id").limit(50).select("org_id", "name", "in_state", "to_field")


@query(cte("funding_events") + "SELECT event_id, recipient_name, recipient_city, CAST(amount AS DOUBLE) AS amount, purpose, fy FROM funding_events WHERE funder_org_id = 4 AND event_type = 'grant' AND recipient_state = 'NATION_4' ORDER BY fy DESC, amount DESC NULLS LAST, event_id LIMIT 50")
def q_c3_one_funder(spark, d):
    """Q-C3, WS-02: one funder's grants in a state."""
    e = rel(spark, d, "funding_events").filter("funder_org_id = 4 and event_type = 'grant' and recipient_state = 'NATION_4'")
    return e.orderBy(F.desc("fy"), F.col("amount").desc_nulls_last(), "event_id").limit(50).select("event_id", "recipient_name", "recipient_city", F.col("amount").cast("double").alias("amount"), "purpose", "fy")


@query(cte("funding_events", "organizations") + "SELECT event_id, o.name AS funder, CAST(amount AS DOUBLE) AS amount FROM funding_events e JOIN organizations o ON o.org_id = funder_org_id WHERE event_type = 'grant' AND purpose ILIKE '%youth%' AND recipient_state = 'NATION_2' ORDER BY amount DESC NULLS LAST, event_id LIMIT 50")
def q_c4_evidence(spark, d):
    """Q-C4: grants whose purpose holds a word, in a state."""
    e = rel(spark, d, "funding_events").filter("event_type = 'grant' and recipient_state = 'NATION_2'").filter(F.col("purpose").ilike("%youth%"))
    o = rel(spark, d, "organizations").select(F.col("org_id").alias("funder_org_id"), F.col("name").alias("funder"))
    return e.orderBy(F.col("amount").desc_nulls_last(), "event_id").limit(50).join(o, "funder_org_id").select("event_id", "funder", F.col("amount").cast("double").alias("amount"))


@query(cte("funding_events") + "SELECT funder_org_id, fy, count(*) AS grants, CAST(sum(amount) AS DOUBLE) AS total FROM funding_events WHERE event_type = 'grant' GROUP BY 1, 2")
def q_c5_history(spark, d):
    """Q-C5, WS-09: giving by year, of every funder."""
    return rel(spark, d, "funding_events").filter("event_type = 'grant'").groupBy("funder_org_id", "fy").agg(F.count("*").alias("grants"), F.sum("amount").cast("double").alias("total"))


@query(cte("funding_events", "organizations") + "SELECT recipient_org_id, coalesce(canonical_id, org_id) AS funder, min(name) AS name, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, min(fy) AS first_fy, max(fy) AS last_fy FROM funding_events JOIN organizations ON org_id = funder_org_id WHERE event_type = 'grant' AND recipient_org_id IS NOT NULL GROUP BY 1, 2")
def q_c6_who_funds(spark, d):
    """Q-C6, ER-17, WS-05, INV-F7: funders of each recipient, aliases counted for their canonical row; a commitment is no payment."""
    o = rel(spark, d, "organizations").select(F.col("org_id").alias("funder_org_id"), F.coalesce("canonical_id", "org_id").alias("funder"), "name")
    e = rel(spark, d, "funding_events").filter("event_type = 'grant' and recipient_org_id is not null")
    return e.join(o, "funder_org_id").groupBy("recipient_org_id", "funder").agg(F.min("name").alias("name"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.min("fy").alias("first_fy"), F.max("fy").alias("last_fy"))


# --- projections and predicates

@query(cte("organizations", "funding_events", "contact_channels") + """, g AS (SELECT funder_org_id, sum(amount) AS total, min(fy) AS a, max(fy) AS b FROM funding_events WHERE event_type = 'grant' GROUP BY 1)
SELECT o.org_id, round(CAST(coalesce(assets / 20.0, CASE WHEN o.org_id % 3 = 0 THEN 1000.0 END, CAST(total AS DOUBLE) / nullif(b - a + 1, 0)) AS DOUBLE), 4) AS yearly, CASE WHEN publishability = 'public' THEN value END AS shown, left(o.name, 6) AS snippet, (o.state IS NULL) = (assets IS NULL) AS same_gap,
CAST((assets IS NOT NULL)::INT + (website IS NOT NULL)::INT AS INT) = 1 AS exactly_one FROM organizations o LEFT JOIN g ON g.funder_org_id = o.org_id LEFT JOIN contact_channels c ON c.org_id = o.org_id AND channel_type = 'email'""")
def prj_profile(spark, d):
    """PRJ-03, PRJ-04, PRJ-10, PRJ-11, FLT-10, JN-02: fallbacks down to a yearly rate, masked values, snippets, and gaps compared."""
    o = rel(spark, d, "organizations")
    g = rel(spark, d, "funding_events").filter("event_type = 'grant'").groupBy(F.col("funder_org_id").alias("org_id")).agg(F.sum("amount").cast("double").alias("total"), (F.max("fy") - F.min("fy") + 1).alias("years"))
    c = rel(spark, d, "contact_channels").filter("channel_type = 'email'").select("org_id", "value", "publishability")
    j = o.join(g, "org_id", "left").join(c, "org_id", "left")
    yearly = F.coalesce(F.col("assets") / 20.0, F.when(F.col("org_id") % 3 == 0, F.lit(1000.0)), F.try_divide("total", "years"))
    one = F.col("assets").isNotNull().cast("int") + F.col("website").isNotNull().cast("int") == 1
    return j.select("org_id", F.round(yearly, 4).alias("yearly"), F.when(F.col("publishability") == "public", F.col("value")).alias("shown"), F.left("name", F.lit(6)).alias("snippet"), (F.col("state").isNull() == F.col("assets").isNull()).alias("same_gap"), one.alias("exactly_one"))


@query(cte("organizations") + """SELECT org_id, '{"name":"' || name || '"' || CASE WHEN state IS NOT NULL THEN ',"state":"' || state || '"' ELSE '' END || CASE WHEN assets IS NOT NULL THEN ',"assets":' || assets ELSE '' END || '}' AS doc,
CAST(2 + (state IS NOT NULL)::INT AS INT) AS n_reasons, '[' || array_to_string(list_filter(['"a"', CASE WHEN org_id % 2 = 0 THEN '"b"' END, CASE WHEN org_id % 5 = 0 THEN '"c"' END], lambda x: x IS NOT NULL), ',') || ']' AS reasons FROM organizations""")
def prj_json(spark, d):
    """PRJ-08, JSN-01: objects without their nulls, and lists without them."""
    k = F.col("org_id")
    reasons = F.filter(F.array(F.lit("a"), F.when(k % 2 == 0, "b"), F.when(k % 5 == 0, "c")), lambda x: x.isNotNull())
    return rel(spark, d, "organizations").select("org_id", F.to_json(F.struct("name", "state", "assets")).alias("doc"), (F.lit(2) + F.col("state").isNotNull().cast("int")).alias("n_reasons"), F.to_json(reasons).alias("reasons"))


@query(cte("organizations") + "SELECT org_id, regexp_replace(name, '([^ ]) +(C/O *|% *|IN CARE OF +)[^ ].*$', '\\1', 'i') AS cut, name <> regexp_replace(name, '([^ ]) +(C/O *|% *|IN CARE OF +)[^ ].*$', '\\1', 'i') AS is_cut FROM organizations")
def fn_care_of(spark, d):
    """PRJ-12."""
    cut = T.cut_care_of(F.col("name"))
    return rel(spark, d, "organizations").select("org_id", cut.alias("cut"), (cut != F.col("name")).alias("is_cut"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'TX' WHEN 1 THEN 'WV' WHEN 2 THEN 'zz' WHEN 3 THEN NULL WHEN 4 THEN 'DC' ELSE NULL END AS raw_code,
CASE c_custkey % 6 WHEN 0 THEN 'TX' WHEN 1 THEN 'WV' WHEN 2 THEN 'ZZ' WHEN 4 THEN 'DC' END AS code FROM customer""")
def fn_state_code(spark, d):
    """STR-08."""
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, " Texas ").when(k % 6 == 1, "west virginia").when(k % 6 == 2, "zz").when(k % 6 == 3, "Atlantis").when(k % 6 == 4, "District of Columbia")
    code = T.state_code(raw)
    return table(spark, d, "customer").select(k.alias("k"), F.when(code == "ZZ", "zz").otherwise(code).alias("raw_code"), code.alias("code"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://www.a-' || page_id || '.org/about' WHEN 1 THEN 'http://x' || page_id || '.com' WHEN 2 THEN 'https://y.z' || page_id || '.museum/p/q' END AS url FROM pages""")
def fn_website(spark, d):
    """STR-14."""
    k = F.col("page_id")
    n = k.cast("string")
    raw = F.when(k % 8 == 0, F.concat(F.lit(" WWW.A-"), n, F.lit(".ORG/About/,"))).when(k % 8 == 1, F.concat(F.lit("HTTP://x"), n, F.lit(".com./"))).when(k % 8 == 2, F.concat(F.lit("//y.z"), n, F.lit(".museum/p/q//")))
    raw = raw.when(k % 8 == 3, "N/A.").when(k % 8 == 4, "me@x.org").when(k % 8 == 5, "x.org:80").when(k % 8 == 6, "see schedule").otherwise("localhost")
    return table(spark, d, "pages").select("page_id", T.website(raw).alias("url"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) END AS irs, CASE WHEN o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderkey % 3 <> 2 THEN date_trunc('month', o_orderdate)::DATE END AS month, CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderdate AS DATE) END AS published,
CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1998-04-01' AND DATE '1998-07-14' THEN DATE '2020-07-15' ELSE CAST(o_orderdate AS DATE) + (DATE '2020-04-01' - DATE '1998-04-01')::INT END AS effective FROM orders""")
def fn_more_dates(spark, d):
    """DT-02, DT-03, DT-05, DT-06, DT-08: dates in the notations of their sources; what is no such date is null."""
    k, o = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    f = lambda p: F.date_format(o, p)
    irs = F.when(k % 3 == 0, F.upper(f("dd-MMM-yyyy"))).when(k % 3 == 1, f("yyyy-MM-dd")).otherwise("31-FOO-2001")
    month = F.when(k % 3 == 0, f("yyyy-MM")).when(k % 3 == 1, f("yyyy-MM-dd")).otherwise("1998")
    pub = F.when(k % 7 == 0, f("MMMM d, yyyy")).when(k % 7 == 1, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 7 == 2, F.concat(f("MMM d"), F.lit("th, "), f("yyyy"))).when(k % 7 == 3, f("M/d/yyyy")).when(k % 7 == 4, f("EEE, d MMM yyyy HH:mm:ss '+0000'")).when(k % 7 == 5, f("yyyy/MM/dd")).otherwise("soon")
    moved = F.date_add(o, F.date_diff(F.lit("2020-04-01").cast("date"), F.lit("1998-04-01").cast("date")))
    return table(spark, d, "orders").select(k.alias("k"), N.irs_date(irs).alias("irs"), N.month_of(month, F.lit("1998-06-30").cast("date")).alias("month"), N.publication_date(pub).alias("published"), N.effective_date(moved).alias("effective"))


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 130 - 10 AS a, c_custkey % 90 AS b, (c_custkey * 7) % 101 AS c FROM customer), t AS (SELECT *, CAST(floor((25 * greatest(0, least(100, a)) + 25 * b + 25 * c + 1750) / 100::DOUBLE + 0.5) AS INT) AS score FROM s)
SELECT k, score, CASE WHEN score >= 85 THEN 'very_high' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'very_low' END AS rating FROM t""")
def fn_fit_score(spark, d):
    """MTH-02, MTH-03: a weighted score held between 0 and 100, and its band."""
    k = F.col("c_custkey")
    a, b, c = k % 130 - 10, k % 90, (k * 7) % 101
    score = N.composite({"mission_alignment": a, "geography": b, "grant_size_fit": c, "applicant_eligibility": F.lit(50), "recency": b, "capacity": c, "openness": F.lit(100)})
    return table(spark, d, "customer").select(k.alias("k"), score.alias("score"), N.rating(score).alias("rating"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'valley and hill foundation' WHEN 1 THEN 'ecole muller' WHEN 2 THEN 'x' || c_custkey END AS key, CASE c_custkey % 4 WHEN 0 THEN 'O''Neil-Smith' ELSE 'Ann B' END AS title FROM customer""")
def fn_import_key(spark, d):
    """STR-19, STR-24."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "The Valley & Hill Foundation, Inc.").when(k % 4 == 1, "École Müller Ltd").when(k % 4 == 2, F.concat(F.lit("X"), k.cast("string"), F.lit(" LLC"))).otherwise("The Inc.")
    return table(spark, d, "customer").select(k.alias("k"), T.import_key(raw).alias("key"), T.title_case(F.when(k % 4 == 0, "O'NEIL-SMITH").otherwise("ann b")).alias("title"))


# --- joins, windows and orderings

@query(cte("relationships", "organizations") + "SELECT DISTINCT r.person_id, coalesce(canonical_id, o.org_id) AS org_id, 'direct' AS hop FROM relationships r JOIN organizations o ON o.org_id = r.org_id WHERE r.person_id % 10 = 3 UNION SELECT DISTINCT a.person_id, b.org_id, 'two' FROM relationships a JOIN relationships b ON b.person_id = a.org_id WHERE a.person_id % 10 = 3")
def jn_two_hops(spark, d):
    """JN-17, SET-02: a person's organisations, and those of the person who stands behind them; persons of the same organisations go the way together."""
    r, o = rel(spark, d, "relationships"), rel(spark, d, "organizations").select("org_id", F.coalesce("canonical_id", "org_id").alias("c"))
    mine = r.filter("person_id % 10 = 3").select("person_id", "org_id")
    who, first = C.equal_sets(mine, "person_id", "org_id")
    direct = first.join(o, "org_id").select("cls", F.col("c").alias("org_id"), F.lit("direct").alias("hop"))
    via = first.select("cls", F.col("org_id").alias("person_id"))
    whom, second = C.equal_sets(r.join(via.select("person_id").distinct(), "person_id", "left_semi"), "person_id", "org_id")
    steps = via.join(whom.withColumnRenamed("cls", "by"), "person_id").select("cls", "by").distinct()
    two = steps.join(second.withColumnRenamed("cls", "by"), "by").select("cls", "org_id", F.lit("two").alias("hop"))
    found = Tables(spark, "hops").save(direct.unionByName(two).distinct())
    return C.products(found.select("cls", "hop").distinct(), who, found, ["cls"], ["cls", "hop"], "person_id", "org_id").select("person_id", "org_id", "hop")


@query(cte("relationships", "organizations", "people") + """, r AS (SELECT person_id, coalesce(canonical_id, o.org_id) AS org_id, rel_type, row_number() OVER (PARTITION BY coalesce(canonical_id, o.org_id), person_id ORDER BY CASE rel_type WHEN 'trustee' THEN 0 WHEN 'director' THEN 1 WHEN 'officer' THEN 2 ELSE 3 END, o.org_id) AS k FROM relationships x JOIN organizations o ON o.org_id = x.org_id)
SELECT org_id, r.person_id, full_name, rel_type FROM r JOIN people p ON p.person_id = r.person_id WHERE k = 1""")
def ws_affiliations(spark, d):
    """WS-07, AGG-16, SRT-08: one role of each person at each canonical organisation, by precedence."""
    o = rel(spark, d, "organizations").select("org_id", F.coalesce("canonical_id", "org_id").alias("c"))
    rank = F.when(F.col("rel_type") == "trustee", 0).when(F.col("rel_type") == "director", 1).when(F.col("rel_type") == "officer", 2).otherwise(3)
    one = R.latest_per_key(rel(spark, d, "relationships").drop("file_id").join(o, "org_id"), ["c", "person_id"], rank.asc(), F.asc("org_id"))
    return one.join(rel(spark, d, "people").select("person_id", "full_name"), "person_id").select(F.col("c").alias("org_id"), "person_id", "full_name", "rel_type")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, s_acctbal, count(*) OVER () AS total FROM supplier WHERE s_acctbal > 0) SELECT s_suppkey, total FROM p ORDER BY (s_nationkey % 2 = 0) DESC, s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 20""")
def srt_pool_page(spark, d):
    """WIN-05, SRT-03, SRT-11: the pool's size beside its second page, the public ones first; the size is a count of its own, not a window over everything."""
    pool = table(spark, d, "supplier").filter("s_acctbal > 0")
    page = pool.orderBy((F.col("s_nationkey") % 2 == 0).desc(), F.desc("s_acctbal"), "s_suppkey").offset(20).limit(20)
    return page.crossJoin(pool.agg(F.count("*").alias("total"))).select("s_suppkey", "total")  # one row


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey) < (12, 50) ORDER BY 1 DESC, 2 DESC LIMIT 15)""")
def srt_keyset_back(spark, d):
    """SRT-04: the page before a row."""
    return R.keyset_page_before(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey", "s_suppkey"], (12, 50), 15)


@query("""WITH c AS (SELECT o_custkey, n, sum(n) OVER (ORDER BY o_custkey) AS hi FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)), t AS (SELECT sum(n) AS total FROM c), q AS (SELECT CAST(floor(i * total / 40) AS BIGINT) AS pos FROM t, (SELECT unnest(range(40)) AS i))
SELECT pos, o_custkey, CAST(pos - (hi - n) AS BIGINT) AS within FROM q JOIN c ON pos >= hi - n AND pos < hi""")
def srt_positional_sample(spark, d):
    """SRT-12: evenly spread positions among all rows, found by running counts; ranges of keys are counted first, so no window spans the table."""
    return R.positional_sample(table(spark, d, "orders"), "o_custkey", 40)


@query("SELECT c_custkey % 16 AS slice, count(*) AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1")
def flt_key_slices(spark, d):
    """FLT-15, SNK-07: a table in slices of its key."""
    return table(spark, d, "customer").groupBy((F.col("c_custkey") % 16).alias("slice")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda t: t ILIKE 'r%')) > 0 AND list_has_all(['red', 'ring', 'hot', 'widget', 'blue', 'gear'], string_split(p_name, ' '))")
def flt_tags(spark, d):
    """FLT-11, FLT-18: a tag that begins so, among tags that are all allowed."""
    tags = F.split("p_name", " ")
    allowed = F.array(*[F.lit(x) for x in ("red", "ring", "hot", "widget", "blue", "gear")])
    return table(spark, d, "part").filter(F.exists(tags, lambda t: t.ilike("r%")) & (F.size(F.array_except(tags, allowed)) == 0)).select("p_partkey")


@query("""WITH a AS (SELECT c_custkey % 30 AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS st FROM customer), b AS (SELECT s_suppkey % 30 AS k, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS st FROM supplier)
SELECT DISTINCT k, st FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.st IS NOT DISTINCT FROM a.st)""")
def jn_anti_null_safe(spark, d):
    """JN-06: what has no partner, where null is partner of null; NOT IN would lose every row beside a null."""
    a = table(spark, d, "customer").select((F.col("c_custkey") % 30).alias("k"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("st")).distinct()
    b = table(spark, d, "supplier").select((F.col("s_suppkey") % 30).alias("k"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")).alias("st")).distinct()
    return R.null_safe_join(a, b, ["k", "st"], "left_anti")


@query("SELECT 'left_only' AS side, count(*) AS n FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_custkey < 60) UNION ALL SELECT 'right_only', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_custkey < 60 EXCEPT ALL SELECT s_nationkey FROM supplier)")
def set_equality(spark, d):
    """SET-06: two tables are equal when nothing is left on either side, repeats counted."""
    a, b = table(spark, d, "supplier").select("s_nationkey"), table(spark, d, "customer").filter("c_custkey < 60").select("c_nationkey")
    n = lambda x, y, side: x.exceptAll(y).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a, b, "left_only").unionByName(n(b, a, "right_only"))


@query("""SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS low, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders""")
def win_frames(spark, d):
    """WIN-09: a frame of groups, as a range over the dense rank; and the nth value of a whole partition."""
    p = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").withColumn("g", F.dense_rank().over(p.orderBy(F.col("o_orderdate").cast("date"))).cast("long"))
    every = p.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return o.select("o_orderkey", F.min("o_totalprice").over(p.orderBy("g").rangeBetween(-1, 0)).alias("low"), F.nth_value("o_orderkey", 2).over(every).alias("second"))


@query("""WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part) SELECT a.p_partkey, CAST(a.pos AS INT) AS pos, a.tok, n FROM p a JOIN (SELECT tok, count(*) AS n FROM p GROUP BY 1) b ON a.tok = b.tok""")
def jn_ordinality(spark, d):
    """JN-23, ARR-01: elements with their places."""
    p = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "tok"))
    return p.join(p.groupBy("tok").agg(F.count("*").alias("n")), "tok").select("p_partkey", "pos", "tok", "n")


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, year(o_orderdate) AS y FROM orders GROUP BY ALL) SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS DOUBLE) AS total, count(DISTINCT o_orderstatus) AS kinds FROM o GROUP BY 1""")
def agg_partial_merge(spark, d):
    """AGG-12: slices are summed, then their sums; as one aggregate, since Spark sums per task before it shuffles."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count_distinct("o_orderstatus").alias("kinds"))


@query(cte("funding_events") + f"""SELECT funder_org_id, count(DISTINCT coalesce('o' || recipient_org_id, upper(trim(recipient_name)))) AS n_recipients, count(DISTINCT recipient_org_id) AS n_linked, round(100.0 * count(recipient_org_id) / nullif(count(*), 0), 4) AS pct_linked FROM funding_events GROUP BY 1""")
def agg_null_able_key(spark, d):
    """AGG-03, AGG-14, AGG-15: recipients by organisation, or by name where there is none."""
    key = F.coalesce(F.concat(F.lit("o"), F.col("recipient_org_id").cast("string")), F.upper(F.trim("recipient_name")))
    return rel(spark, d, "funding_events").groupBy("funder_org_id").agg(F.count_distinct(key).alias("n_recipients"), F.count_distinct("recipient_org_id").alias("n_linked"), F.round(100.0 * F.count("recipient_org_id") / F.count("*"), 4).alias("pct_linked"))

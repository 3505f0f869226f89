"""Scalar functions, each over a whole table of values derived from the shared ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..sources.tables import GRANTS_SQL as G
from ..sources.tables import grants, table
from .registry import query

# Noisy names: part names with punctuation, articles and legal forms by key.
_NAME_SQL = """WITH names AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'The ' ELSE '' END || p_name || CASE p_partkey % 6 WHEN 0 THEN ', Inc' WHEN 1 THEN ' Trust' WHEN 2 THEN '.  L.L.C.' WHEN 3 THEN ' Foundation' WHEN 4 THEN ' GP, LP' ELSE '' END AS name FROM part),
norm AS (SELECT k, trim(regexp_replace(regexp_replace(upper(name), '[^A-Z0-9_ &-]', ' ', 'g'), ' +', ' ', 'g')) AS nn FROM names)
"""
_FORMS = "INC|INCORPORATED|LLC|L L C|CORP|CORPORATION|CO|LTD|LP|LLP|PC|PA"
_ENTITY = "LLC|L L C|LTD|INC|CORP|GP|LP|L P|LLP|FUND|FUNDS|GROUP|PARTNERS|CAPITAL|MANAGEMENT|HOLDINGS|ADVISORS|ADVISERS|COMPANY|TRUST"


def names(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 6 == 0, ", Inc").when(k % 6 == 1, " Trust").when(k % 6 == 2, ".  L.L.C.").when(k % 6 == 3, " Foundation").when(k % 6 == 4, " GP, LP").otherwise("")
    return table(spark, d, "part").select(k.alias("k"), F.concat(F.when(k % 5 == 0, "The ").otherwise(""), F.col("p_name"), tail).alias("name"))


@query(_NAME_SQL + f"""SELECT k, nn, trim(regexp_replace(regexp_replace(nn, '^THE +', ''), ' +({_FORMS})$', '')) AS clean,
regexp_replace(trim(regexp_replace(regexp_replace(nn, '^THE +', ''), ' +({_FORMS})$', '')), '[^A-Z0-9]+', '', 'g') AS squeezed, regexp_matches(nn, '\\b({_ENTITY})\\b') AS entity FROM norm""")
def fn_names(spark, d):
    """STR-01..04, STR-18."""
    n = T.norm_name(F.col("name"))
    return names(spark, d).select("k", n.alias("nn"), T.clean_name(F.col("name")).alias("clean"), T.squeeze(T.clean_name(F.col("name"))).alias("squeezed"), T.is_entity(n).alias("entity"))


@query(_NAME_SQL + "SELECT k, array_to_string(list_sort(string_split(nn, ' ')), ' ') AS person FROM norm")
def fn_person_key(spark, d):
    """STR-17."""
    return names(spark, d).select("k", T.person_key(F.col("name")).alias("person"))


_OPENINGS = r"""SEE (ATTACH|STATEMENT|STMT|STMNT|SCHEDULE|LIST|SUPPLEMENT|ADDITIONAL (DATA|INFO|SCHEDULE|STATEMENT|LIST|PAGE))|(AS )?PER (ATTACH|SCHEDULE|LIST|STATEMENT|STMT)|VARIOUS|MISC(ELLANEOUS)?( |$)|N A$|NA$|NONE$|OTHER$|GENERAL$|ALL OTHERS?$|UNKNOWN$|NOT APPLICABLE$|CASH GRANTS?$|SCHEDULE( |$)|ATTACH(ED|MENT)?$|ATTACHED (LIST|SCH|STATEMENT|SUPPLEMENT)|ATTACHMENT ([A-Z]|\d+)( |$)|STATEMENT( \d|$)|ANONYMOUS( DONOR)?$|INDIVIDUALS?$|SCHOLARSHIPS?$|SUNDRY|MULTIPLE (RECIPIENT|GRANT|CHARIT|ORGANIZATION)|AVAILABLE (UPON|ON) REQUEST|UNDER (\d{3,}|\d+ ?K|\d{1,3} \d{3})( |$)|(GRANTS|GIFTS|DONATIONS|CONTRIBUTIONS|AMOUNTS) (OF )?(UNDER|LESS THAN|BELOW) (\d{3,}|\d+ ?K|\d{1,3} \d{3})( |$)"""
_FILLER = "['SEE ATTACHED', 'VARIOUS', 'N A', 'NONE', 'UNDER 5 000', 'GRANTS UNDER 500', 'MISC', 'MISCELLANY', 'SCHEDULE B', 'STATEMENT 7', 'ABC', 'UNDERWOOD']"


@query(f"""WITH v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN {_FILLER}[CAST(p_partkey % 12 + 1 AS INT)] ELSE upper(p_name) END AS nn FROM part)
SELECT k, nn IS NULL OR length(nn) < 4 OR regexp_matches(nn, '^({_OPENINGS})') AS filler FROM v""")
def fn_placeholder(spark, d):
    """STR-05, FLT-16."""
    k = F.col("p_partkey")
    filler = F.array(*[F.lit(x) for x in ("SEE ATTACHED", "VARIOUS", "N A", "NONE", "UNDER 5 000", "GRANTS UNDER 500", "MISC", "MISCELLANY", "SCHEDULE B", "STATEMENT 7", "ABC", "UNDERWOOD")])
    v = F.when(k % 3 == 0, F.get(filler, (k % 12).cast("int"))).otherwise(F.upper("p_name"))
    return table(spark, d, "part").select(k.alias("k"), T.is_placeholder(v).alias("filler"))


@query("""WITH v AS (SELECT c_custkey AS k, 'EIN ' || CAST(c_custkey * 7919 AS VARCHAR) AS raw, lpad(CAST(c_custkey * 104729 % 10000000000 AS VARCHAR), 10, '2') AS tel FROM customer),
x AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS dg FROM v)
SELECT k, CASE WHEN length(dg) BETWEEN 1 AND 9 THEN lpad(dg, 9, '0') END AS ein, nullif(regexp_replace(dg, '^0+', ''), '') AS cik, nullif(dg, '') AS crd,
CASE WHEN length(dg) = 5 THEN dg WHEN length(dg) = 9 THEN left(dg, 5) || '-' || right(dg, 4) END AS zip, CASE WHEN regexp_matches(tel, '^[2-9][0-9]{2}[2-9][0-9]{6}$') THEN '+1' || tel END AS phone FROM x""")
def fn_identifiers(spark, d):
    """STR-06, STR-07, STR-10, STR-13."""
    k = F.col("c_custkey")
    v = table(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("EIN "), (k * 7919).cast("string")).alias("raw"), F.lpad((k * 104729 % 10000000000).cast("string"), 10, "2").alias("tel"))
    r = F.col("raw")
    return v.select("k", T.ein(r).alias("ein"), T.cik(r).alias("cik"), T.crd(r).alias("crd"), T.zip_code(r).alias("zip"), T.phone(F.col("tel")).alias("phone"))


@query("""WITH v AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '$' || CAST(c_acctbal AS VARCHAR) WHEN 1 THEN '-' WHEN 2 THEN 'n/a' ELSE '1,2' || CAST(c_custkey AS VARCHAR) || '.99' END AS raw FROM customer)
SELECT k, CASE WHEN trim(replace(replace(raw, ',', ''), '$', '')) NOT IN ('', '-') THEN CAST(trunc(TRY_CAST(trim(replace(replace(raw, ',', ''), '$', '')) AS DOUBLE)) AS BIGINT) END AS amount FROM v""")
def fn_parse_amount(spark, d):
    """STR-09."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("$"), F.col("c_acctbal").cast("string"))).when(k % 4 == 1, "-").when(k % 4 == 2, "n/a").otherwise(F.concat(F.lit("1,2"), k.cast("string"), F.lit(".99")))
    return table(spark, d, "customer").select(k.alias("k"), T.amount(raw).alias("amount"))


@query("""WITH v AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ' Ann.Lee+x' || CAST(c_custkey AS VARCHAR) || '@Mail.Example.ORG ' WHEN 1 THEN 'grants_' || CAST(c_custkey AS VARCHAR) || '@ex.org' ELSE 'no address' END AS a FROM customer)
SELECT k, CASE WHEN regexp_matches(lower(trim(a)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$') THEN regexp_replace(regexp_replace(lower(split_part(trim(a), '@', 1)), '\\+.*$', ''), '[._-]', '', 'g') END AS local FROM v""")
def fn_email_local(spark, d):
    """STR-11."""
    k = F.col("c_custkey").cast("string")
    a = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" Ann.Lee+x"), k, F.lit("@Mail.Example.ORG "))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("grants_"), k, F.lit("@ex.org"))).otherwise("no address")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), T.email_local(a).alias("local"))


@query("""WITH v AS (SELECT page_id, regexp_replace(url || CASE page_id % 5 WHEN 0 THEN '/?utm_source=x&id=7&a=1?b=2#top' WHEN 1 THEN '/' WHEN 2 THEN '?ref=n&Source=m&mc_eid=1' WHEN 3 THEN '//' ELSE '?gclid=1&q' END, '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, split_part(u, '?', 1) AS h, CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS q FROM v), w AS (SELECT page_id, regexp_extract(h, '^([a-zA-Z]+)://', 1) AS s, regexp_extract(h, '^[a-zA-Z]+://([^/]*)', 1) AS host, regexp_extract(h, '^[a-zA-Z]+://[^/]*(.*)$', 1) AS path,
array_to_string(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_full_match(lower(split_part(x, '=', 1)), 'utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|source')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS kept FROM p)
SELECT page_id, lower(s) || '://' || lower(host) || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM w""")
def fn_canonical_url(spark, d):
    """STR-15."""
    k = F.col("page_id")
    u = F.concat("url", F.when(k % 5 == 0, "/?utm_source=x&id=7&a=1?b=2#top").when(k % 5 == 1, "/").when(k % 5 == 2, "?ref=n&Source=m&mc_eid=1").when(k % 5 == 3, "//").otherwise("?gclid=1&q"))
    return table(spark, d, "pages").select("page_id", T.canonical_url(u).alias("url"))


_PHRASE = r"(?i)\b(no\s+unsolicited|not\s+accept(?:ing)?\s+(?:unsolicited|applications|requests|proposals)|does\s+not\s+solicit|by\s+invitation|no\s+applications|pre[- ]?selected)"
_NOTES = "['Does  not Solicit', 'Grants by\ninvitation only', 'open to all', 'Pre-Selected charities', 'We are not accepting requests']"


@query(f"""SELECT o_orderkey, nullif(lower(regexp_replace(regexp_extract({_NOTES}[CAST(o_orderkey % 5 + 1 AS INT)], '{_PHRASE}', 1), '\\s+', ' ', 'g')), '') AS phrase FROM orders""")
def fn_restrictive_phrase(spark, d):
    """STR-16."""
    notes = F.array(*[F.lit(x) for x in ("Does  not Solicit", "Grants by\ninvitation only", "open to all", "Pre-Selected charities", "We are not accepting requests")])
    return table(spark, d, "orders").select("o_orderkey", T.restrictive_phrase(F.get(notes, (F.col("o_orderkey") % 5).cast("int"))).alias("phrase"))


@query("""WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '=' || p_name WHEN 1 THEN p_name || ', "x"' WHEN 2 THEN '-1' ELSE p_name END AS c FROM part),
s AS (SELECT k, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN '''' || c ELSE c END AS c FROM v)
SELECT k, CASE WHEN regexp_matches(c, '[",\\n\\r]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS cell FROM s""")
def fn_csv_cell(spark, d):
    """SNK-11, WS-28."""
    k = F.col("p_partkey")
    c = F.when(k % 4 == 0, F.concat(F.lit("="), "p_name")).when(k % 4 == 1, F.concat("p_name", F.lit(', "x"'))).when(k % 4 == 2, "-1").otherwise(F.col("p_name"))
    return table(spark, d, "part").select(k.alias("k"), T.csv_cell(c).alias("cell"))


@query("""WITH v AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y%m') AS period FROM orders)
SELECT k, CASE k % 3 WHEN 0 THEN date_trunc('month', day) WHEN 1 THEN date_trunc('year', day) ELSE day END::DATE AS ruling, last_day(day) AS period_end, CAST(left(period, 4) AS INT) AS fy,
CASE WHEN make_date(year(day), month(day), least(31 - CAST(k % 5 AS INT), day(last_day(day)))) <= day THEN make_date(year(day), month(day), least(31 - CAST(k % 5 AS INT), day(last_day(day))))
ELSE make_date(year(day - INTERVAL 1 MONTH), month(day - INTERVAL 1 MONTH), least(31 - CAST(k % 5 AS INT), day(last_day((day - INTERVAL 1 MONTH)::DATE)))) END AS bill_start FROM v""")
def fn_dates(spark, d):
    """DT-01, DT-04, PRJ-06, PRJ-07."""
    k, o = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 3 == 0, F.date_format(o, "yyyyMM")).when(k % 3 == 1, F.date_format(o, "yyyy")).otherwise(F.date_format(o, "yyyyMMdd"))
    period, day = F.date_format(o, "yyyyMM"), o.cast("date")
    return table(spark, d, "orders").select(k.alias("k"), N.ruling_date(raw).alias("ruling"), N.month_end(period).alias("period_end"), N.fiscal_year(period).alias("fy"), N.billing_start(day, (31 - k % 5).cast("int")).alias("bill_start"))


@query(G + """, x AS (SELECT funder_id, count(*) FILTER (flag = 'R') AS c, count(*) AS n FROM grants GROUP BY 1)
SELECT funder_id, round((c / n + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(c / n * (1 - c / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 8) AS low, n >= 100 AND (c / n + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(c / n * (1 - c / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) > 0.3 AS passed FROM x""")
def fn_wilson_gate(spark, d):
    """MTH-01, ER-15."""
    x = grants(spark, d).groupBy("funder_id").agg(F.count_if(F.col("flag") == "R").alias("c"), F.count("*").alias("n"))
    low = N.wilson_low(F.col("c"), F.col("n"))
    return x.select("funder_id", F.round(low, 8).alias("low"), ((F.col("n") >= 100) & (low > 0.3)).alias("passed"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, md5(event_type || '|' || CAST(user_id AS VARCHAR)) AS h, sha256(event_type || '|' || CAST(event_id AS VARCHAR)) AS doc_hash FROM events""")
def fn_json_and_hash(spark, d):
    """JSN-01, PRJ-09, HSH-01."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).cast("binary")).alias("h"), F.sha2(F.concat_ws("|", "event_type", F.col("event_id").cast("string")).cast("binary"), 256).alias("doc_hash"))


@query("""WITH a AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS ws FROM part)
SELECT k, CAST(len(ws) AS INT) AS n, CAST(list_position(ws, 'ring') AS INT) AS at, array_to_string(list_slice(ws, 1, 2), '+') AS head, len(list_intersect(ws, ['gear', 'red', 'blue'])) > 0 AS any_of, ws[-1] AS last FROM a""")
def fn_arrays(spark, d):
    """ARR-01..03, FLT-11; a missing element has a null position."""
    ws = F.split("p_name", " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.size(ws).alias("n"), F.nullif(F.array_position(ws, "ring"), F.lit(0)).cast("int").alias("at"), F.array_join(F.slice(ws, 1, 2), "+").alias("head"), F.arrays_overlap(ws, F.array(F.lit("gear"), F.lit("red"), F.lit("blue"))).alias("any_of"), F.element_at(ws, -1).alias("last"))

"""Public views, filing marts, standing, the open list and its gates, over filings-shaped relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import relational as R
from ..sources.standin import cte, rel
from .registry import query

_FILES = "pub AS (SELECT file_id, dataset_name AS source_dataset, source_url, raw_files.license_code, license_name FROM raw_files JOIN licensing_map ON raw_files.license_code = licensing_map.license_code WHERE republishable)"


def public_files(spark, d):
    """Files whose license lets their rows be shown, with what a row's seal says about its file."""
    f = rel(spark, d, "raw_files").join(rel(spark, d, "licensing_map").filter("republishable"), "license_code")
    return f.select("file_id", F.col("dataset_name").alias("source_dataset"), "source_url", "license_code", "license_name")


def public(spark, d, df):
    """Rows of republishable files with their seal; files are few, so Spark broadcasts them by their size."""
    return df.join(public_files(spark, d), "file_id").drop("file_id")


_SEAL = "source_dataset, source_url, license_code, license_name"


def _view(name: str, relation: str, columns: str, where: str = "true", doc: str = ""):
    """One public view: columns that may be shown, rows that may be shown."""
    cols = [c.strip() for c in columns.split(",")]

    def fn(spark, d):
        return public(spark, d, rel(spark, d, relation).filter(where).select(*cols, "file_id"))

    fn.__name__, fn.__doc__ = f"view_{name}", doc
    query(cte(relation, "raw_files", "licensing_map") + f", {_FILES} SELECT {columns}, {_SEAL} FROM {relation} t JOIN pub ON t.file_id = pub.file_id WHERE {where}")(fn)


_view("organizations", "organizations", "org_id, name, org_type, state, city, zip, assets, ntee, ruling_date", doc="VIEW-01.")
_view("org_identifiers", "org_identifiers", "org_id, id_type, id_value", doc="VIEW-02.")
_view("people", "people", "person_id, full_name", doc="VIEW-03.")
_view("funding_programs", "funding_programs", "program_id, agency, name, program_type, description, non_dilutive, award_ceiling", doc="VIEW-04.")
_view("relationships", "relationships", "person_id, org_id, rel_type", doc="VIEW-06.")
_view("contact_channels", "contact_channels", "org_id, channel_type, value", "publishability = 'public' AND tier <> 'red'", doc="VIEW-07, FLT-17: affirmatively public, not red, republishable.")
_view("irs_revocations", "irs_revocations", "ein, revocation_date, posting_date, reinstatement_date", doc="VIEW-18.")
_view("irs_pub78", "irs_pub78", "ein, codes", doc="VIEW-18.")


@query(cte("funding_events", "raw_files", "licensing_map") + f", {_FILES} SELECT event_id, funder_org_id, recipient_org_id, event_type, CAST(amount AS DOUBLE) AS amount, fy, nullif(split_part(source_record_key, ':', 2), '') AS filing_object_id, {_SEAL} FROM funding_events t JOIN pub ON t.file_id = pub.file_id")
def view_funding_events(spark, d):
    """VIEW-05, STR-22: the filing's id is read from the record key."""
    e = rel(spark, d, "funding_events")
    oid = F.nullif(F.split_part("source_record_key", F.lit(":"), F.lit(2)), F.lit(""))
    return public(spark, d, e.select("event_id", "funder_org_id", "recipient_org_id", "event_type", F.col("amount").cast("double").alias("amount"), "fy", oid.alias("filing_object_id"), "file_id"))


@query(cte("filings", "raw_files", "licensing_map") + f""", {_FILES} SELECT object_id, ein, return_type, tax_period, amended, object_id || '_public.xml' AS member,
'https://files.example.org/' || substr(batch_id, 1, 4) || '/' || upper(batch_id) || '.zip' AS zip_url, {_SEAL} FROM filings t JOIN pub ON t.file_id = pub.file_id""")
def view_filings(spark, d):
    """VIEW-08, PRJ-05: where a filing's file and its archive lie."""
    url = F.concat(F.lit("https://files.example.org/"), F.left("batch_id", F.lit(4)), F.lit("/"), F.upper("batch_id"), F.lit(".zip"))
    f = rel(spark, d, "filings").select("object_id", "ein", "return_type", "tax_period", "amended", F.concat("object_id", F.lit("_public.xml")).alias("member"), url.alias("zip_url"), "file_id")
    return public(spark, d, f)


def _detail(name, relation, columns, doc):
    """A detail table of filings: its rows carry their filing's seal."""
    cols = [c.strip() for c in columns.split(",")]

    def fn(spark, d):
        return public(spark, d, rel(spark, d, relation).join(rel(spark, d, "filings").select("object_id", "file_id"), "object_id").select("object_id", *cols, "file_id"))

    fn.__name__, fn.__doc__ = f"view_{name}", doc
    query(cte(relation, "filings", "raw_files", "licensing_map") + f", {_FILES} SELECT t.object_id, {columns}, {_SEAL} FROM {relation} t JOIN filings f ON t.object_id = f.object_id JOIN pub ON f.file_id = pub.file_id")(fn)


_detail("filing_financials", "filing_financials", "assets, revenue, distributions, grants_paid", "VIEW-09.")
_detail("filing_officers", "officers", "seq, person_name, business_name, title, compensation", "VIEW-10.")
_detail("filing_contributors", "contributors", "seq, name, city, is_person, amount", "VIEW-11: the street is withheld.")
_detail("filing_application_info", "application_info", "only_preselected, contact_name, form_txt, deadlines_txt, restrictions_txt", "VIEW-12: mail and phone are withheld.")


def live(spark, d):
    """Filings with ``superseded_by``: of one filer, return type and period the greatest id wins."""
    return R.supersede(rel(spark, d, "filings"), ["ein", "return_type", "tax_period"], "object_id")


_LIVE = "lf AS (SELECT *, CASE WHEN object_id < max(object_id) OVER w THEN max(object_id) OVER w END AS superseded_by FROM filings WINDOW w AS (PARTITION BY ein, return_type, tax_period))"


@query(cte("filings", "funding_events") + f""", {_LIVE}, g AS (SELECT funder_org_id, split_part(source_record_key, ':', 2) AS oid, amount FROM funding_events)
SELECT org_id, count(*) AS n_filings, count(superseded_by) AS n_superseded, any_value(n_kept) AS n_kept, any_value(n_dropped) AS n_dropped FROM lf LEFT JOIN
(SELECT funder_org_id, count(*) FILTER (oid NOT IN (SELECT object_id FROM lf WHERE superseded_by IS NOT NULL)) AS n_kept, count(*) FILTER (oid IN (SELECT object_id FROM lf WHERE superseded_by IS NOT NULL)) AS n_dropped FROM g GROUP BY 1) k ON funder_org_id = org_id GROUP BY org_id""")
def drv_reconcile(spark, d):
    """DRV-04: superseded filings point to their winner and lose their fact rows."""
    f = live(spark, d)
    oid = F.split_part("source_record_key", F.lit(":"), F.lit(2))
    dead = f.filter("superseded_by is not null").select(F.col("object_id").alias("oid"), F.lit(True).alias("dead"))
    g = rel(spark, d, "funding_events").select("funder_org_id", oid.alias("oid")).join(dead, "oid", "left")
    k = g.groupBy(F.col("funder_org_id").alias("org_id")).agg(F.count_if(F.col("dead").isNull()).alias("n_kept"), F.count("dead").alias("n_dropped"))
    return f.groupBy("org_id").agg(F.count("*").alias("n_filings"), F.count("superseded_by").alias("n_superseded")).join(k, "org_id", "left")


@query(cte("filings", "filing_financials", "raw_files", "licensing_map") + f""", {_FILES}, {_LIVE} SELECT org_id, lf.object_id, CAST(nullif(left(tax_period, 4), '') AS INT) AS fy, assets, revenue, distributions FROM lf JOIN filing_financials ff ON lf.object_id = ff.object_id JOIN pub ON lf.file_id = pub.file_id WHERE superseded_by IS NULL""")
def view_org_financial_series(spark, d):
    """VIEW-13, WS-02, Q-C7, PRJ-06: live filings only, the year read from the period."""
    f = live(spark, d).filter("superseded_by is null").join(rel(spark, d, "filing_financials"), "object_id")
    return public(spark, d, f.select("org_id", "object_id", N.fiscal_year(F.col("tax_period")).alias("fy"), "assets", "revenue", "distributions", "file_id")).select("org_id", "object_id", "fy", "assets", "revenue", "distributions")


_PARSED = f"""{_LIVE}, pf AS (SELECT lf.*, CAST(left(tax_period, 4) AS INT) AS year, ff.assets, ff.revenue, ff.distributions, ff.grants_paid, row_number() OVER (PARTITION BY org_id ORDER BY tax_period DESC, lf.object_id DESC) AS rn, count(*) OVER (PARTITION BY org_id) AS n_filings
FROM lf JOIN filing_financials ff ON lf.object_id = ff.object_id WHERE superseded_by IS NULL)"""


def parsed(spark, d):
    """Live filings that were parsed, with their financials."""
    f = live(spark, d).filter("superseded_by is null").join(rel(spark, d, "filing_financials"), "object_id")
    return f.withColumn("year", N.fiscal_year(F.col("tax_period")))


def _newest(df):
    return R.latest_per_key(df, ["org_id"], F.desc("tax_period"), F.desc("object_id"))


@query(cte("filings", "filing_financials") + f", {_PARSED} SELECT org_id, object_id, year, assets, revenue, grants_paid, n_filings FROM pf WHERE rn = 1")
def mart_org_latest_financials(spark, d):
    """MART-10, WIN-01, WIN-04: the newest filing that was parsed, and how many there are."""
    p = parsed(spark, d)
    n = p.groupBy("org_id").agg(F.count("*").alias("n_filings"))
    return _newest(p).join(n, "org_id").select("org_id", "object_id", "year", "assets", "revenue", "grants_paid", "n_filings")


# an address: what may stand on both sides of the sign, and then the tag and the separators of the local part go
_LOCAL = r"CASE WHEN regexp_matches(lower(trim(email)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$') THEN regexp_replace(regexp_replace(split_part(lower(trim(email)), '@', 1), '\+.*$', ''), '[._-]', '', 'g') END"


@query(cte("filings", "filing_financials", "application_info") + f""", {_PARSED} SELECT org_id, pf.object_id, year, a.object_id IS NOT NULL AS has_part, only_preselected, CASE WHEN a.object_id IS NULL THEN 'unknown' WHEN only_preselected THEN 'preselected_only' ELSE 'open' END AS posture,
{_LOCAL} IS NOT NULL AS has_email, coalesce(regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'), false) AS has_phone,
CAST((contact_name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (form_txt IS NOT NULL)::INT + (deadlines_txt IS NOT NULL)::INT + (restrictions_txt IS NOT NULL)::INT AS INT) AS n_actionable
FROM pf LEFT JOIN application_info a ON pf.object_id = a.object_id WHERE return_type = '990PF' AND rn = 1""")
def mart_application_posture(spark, d):
    """MART-11, VIEW-14, PRJ-01, FLT-10: what the newest parsed return says about applying; silence is unknown, not closed."""
    a = rel(spark, d, "application_info").withColumn("has_part", F.lit(True))
    j = _newest(parsed(spark, d).filter("return_type = '990PF'")).join(a, "object_id", "left")
    stated = sum(F.col(c).isNotNull().cast("int") for c in ("contact_name", "email", "phone", "form_txt", "deadlines_txt", "restrictions_txt"))
    has = F.coalesce("has_part", F.lit(False))
    return j.select("org_id", "object_id", "year", has.alias("has_part"), "only_preselected", posture(has, F.col("only_preselected")).alias("posture"), T.email_local(F.col("email")).isNotNull().alias("has_email"), T.phone(F.col("phone")).isNotNull().alias("has_phone"), stated.alias("n_actionable"))


def posture(has_part, only_preselected):
    return F.when(~has_part, "unknown").when(only_preselected, "preselected_only").otherwise("open")


@query(cte("filings", "filing_financials", "application_info") + f""", {_PARSED}, p AS (SELECT pf.*, form_txt, restrictions_txt, CASE WHEN a.object_id IS NULL THEN 'unknown' WHEN only_preselected THEN 'preselected_only' ELSE 'open' END AS posture,
row_number() OVER (PARTITION BY org_id ORDER BY tax_period DESC, pf.object_id DESC) AS k FROM pf LEFT JOIN application_info a ON pf.object_id = a.object_id WHERE return_type = '990PF'),
o AS (SELECT DISTINCT ON (p.org_id) p.org_id, p.posture, p.year, p.object_id FROM p JOIN p l ON l.org_id = p.org_id AND l.k = 1 WHERE p.posture <> l.posture AND p.posture <> 'unknown' ORDER BY p.org_id, p.tax_period DESC, p.object_id DESC)
SELECT l.org_id, n_returns, n_open, n_preselected, n_not_stated, first_fy, last_fy, l.posture, l.object_id, o.posture AS other_posture, o.year AS other_fy, o.object_id AS other_object_id,
CASE WHEN l.posture = 'open' THEN CASE WHEN contains(form_txt, 'does') THEN 'does not solicit' WHEN contains(restrictions_txt, 'invitation') THEN 'by invitation' END END AS phrase
FROM p l JOIN (SELECT org_id, count(*) AS n_returns, count(*) FILTER (posture = 'open') AS n_open, count(*) FILTER (posture = 'preselected_only') AS n_preselected, count(*) FILTER (posture = 'unknown') AS n_not_stated, min(year) AS first_fy, max(year) AS last_fy FROM p GROUP BY 1) n ON l.org_id = n.org_id LEFT JOIN o ON o.org_id = l.org_id WHERE l.k = 1""")
def mart_application_history(spark, d):
    """MART-12, WS-25, STR-16: counts of answers, the newest, and the newest other one that was stated; one pass over a filer's returns."""
    a = rel(spark, d, "application_info").withColumn("has_part", F.lit(True))
    j = parsed(spark, d).filter("return_type = '990PF'").join(a, "object_id", "left")
    p = j.withColumn("posture", posture(F.coalesce("has_part", F.lit(False)), F.col("only_preselected")))
    row = F.struct("tax_period", "object_id", "posture", "year", "form_txt", "restrictions_txt")
    is_ = lambda v: F.count_if(F.col("posture") == v)
    g = p.groupBy("org_id").agg(F.count("*").alias("n_returns"), is_("open").alias("n_open"), is_("preselected_only").alias("n_preselected"), is_("unknown").alias("n_not_stated"), F.min("year").alias("first_fy"), F.max("year").alias("last_fy"), F.max(row).alias("l"), *[F.max(F.when(F.col("posture") == v, row)).alias(v) for v in ("open", "preselected_only")])
    differs = lambda v: F.when(F.col("l.posture") != v, F.col(v))
    other = F.greatest(differs("open"), differs("preselected_only"))
    phrase = F.when(F.col("l.posture") == "open", F.coalesce(T.restrictive_phrase(F.col("l.form_txt")), T.restrictive_phrase(F.col("l.restrictions_txt"))))
    g = g.withColumn("o", other)
    return g.select("org_id", "n_returns", "n_open", "n_preselected", "n_not_stated", "first_fy", "last_fy", "l.posture", "l.object_id", F.col("o.posture").alias("other_posture"), F.col("o.year").alias("other_fy"), F.col("o.object_id").alias("other_object_id"), phrase.alias("phrase"))


_STAND = """, x AS (SELECT o.org_id, o.name, i.id_value AS ein, rf.dataset_name = 'eo_bmf' AS in_bmf, coalesce(rf.modified_on, rf.fetched_on) AS bmf_date, o.ruling_date, p.ein IS NOT NULL AS on_pub78, p.codes, r.revocation_date, r.posting_date, r.reinstatement_date,
CASE WHEN r.revocation_date BETWEEN DATE '2020-04-01' AND DATE '2020-07-14' THEN DATE '2020-07-15' ELSE r.revocation_date END AS effective, r.revocation_date IS NOT NULL AS has_rev, coalesce(r.reinstatement_date >= r.revocation_date, false) AS reinstated, o.file_id
FROM organizations o JOIN org_identifiers i ON i.org_id = o.org_id AND id_type = 'ein' JOIN raw_files rf ON rf.file_id = o.file_id LEFT JOIN (SELECT DISTINCT ON (ein) * FROM irs_revocations ORDER BY ein, revocation_date DESC) r ON r.ein = i.id_value LEFT JOIN irs_pub78 p ON p.ein = i.id_value WHERE o.org_type IN ('private_foundation', 'public_charity')),
s AS (SELECT *, CASE WHEN NOT has_rev AND (in_bmf OR on_pub78) THEN 'listed' WHEN NOT has_rev THEN 'not_listed' WHEN NOT reinstated AND NOT (in_bmf OR on_pub78) THEN 'revoked' WHEN (in_bmf OR on_pub78) AND (reinstated OR coalesce(ruling_date > effective, false)) THEN 'revoked_then_relisted'
WHEN in_bmf AND NOT on_pub78 AND coalesce(posting_date > bmf_date, false) THEN 'revoked' WHEN in_bmf OR on_pub78 THEN 'lists_disagree' ELSE 'not_listed' END AS standing FROM x)"""
_STAND_OF = ("organizations", "org_identifiers", "raw_files", "licensing_map", "irs_revocations", "irs_pub78", "filings")


@query(cte(*_STAND_OF) + f"{_STAND}, {_FILES}, {_LIVE}" + """, fl AS (SELECT ein, tax_period, last_day(make_date(CAST(left(tax_period, 4) AS INT), CAST(substr(tax_period, 5, 2) AS INT), 1)) AS ends FROM lf JOIN pub ON lf.file_id = pub.file_id WHERE superseded_by IS NULL) SELECT org_id, ein, standing, effective, CASE WHEN has_rev THEN 10 WHEN in_bmf THEN file_id ELSE 15 END AS deciding_file,
CASE WHEN has_rev THEN EXISTS (SELECT 1 FROM fl WHERE fl.ein = s.ein AND fl.ends > s.effective + INTERVAL 1 YEAR) END AS filed_after, (SELECT max(tax_period) FROM fl WHERE fl.ein = s.ein) AS latest_period FROM s""")
def view_irs_standing(spark, d):
    """VIEW-16, JN-09, JN-11, DT-03, HYB-14: five standings from three lists, the file that decides, and whether a return followed a revocation."""
    return standing(spark, d).select("org_id", "ein", "standing", "effective", "deciding_file", "filed_after", "latest_period")


def standing(spark, d):
    o = rel(spark, d, "organizations").filter(F.col("org_type").isin("private_foundation", "public_charity"))
    i = rel(spark, d, "org_identifiers").filter("id_type = 'ein'").select("org_id", F.col("id_value").alias("ein"))
    files = rel(spark, d, "raw_files").select("file_id", (F.col("dataset_name") == "eo_bmf").alias("in_bmf"), F.coalesce("modified_on", "fetched_on").alias("bmf_date"))
    r = R.latest_per_key(rel(spark, d, "irs_revocations"), ["ein"], F.desc("revocation_date")).drop("file_id")
    p = rel(spark, d, "irs_pub78").select("ein", "codes", F.lit(True).alias("p"))
    x = o.join(i, "org_id").join(files, "file_id").join(r, "ein", "left").join(p, "ein", "left")
    x = x.withColumns({"on_pub78": F.coalesce("p", F.lit(False)), "has_rev": F.col("revocation_date").isNotNull(), "reinstated": F.coalesce(F.col("reinstatement_date") >= F.col("revocation_date"), F.lit(False)), "effective": N.effective_date(F.col("revocation_date"))})
    on_list = F.col("in_bmf") | F.col("on_pub78")
    relisted = F.col("reinstated") | F.coalesce(F.col("ruling_date") > F.col("effective"), F.lit(False))
    stale = F.col("in_bmf") & ~F.col("on_pub78") & F.coalesce(F.col("posting_date") > F.col("bmf_date"), F.lit(False))
    s = F.when(~F.col("has_rev"), F.when(on_list, "listed").otherwise("not_listed")).when(~on_list, F.when(F.col("reinstated"), "not_listed").otherwise("revoked")).when(relisted, "revoked_then_relisted").when(stale, "revoked").otherwise("lists_disagree")
    file = F.when(F.col("has_rev"), F.lit(10)).when(F.col("in_bmf"), F.col("file_id")).otherwise(F.lit(15)).cast("long")
    ends = public(spark, d, live(spark, d).filter("superseded_by is null")).groupBy("ein").agg(F.max("tax_period").alias("latest_period"))
    x = x.withColumns({"standing": s, "deciding_file": file}).join(ends, "ein", "left")
    after = F.coalesce(N.month_end(F.col("latest_period")) > F.add_months("effective", 12), F.lit(False))  # if any return followed, the latest did
    return x.withColumn("filed_after", F.when(F.col("has_rev"), after))


@query(cte("raw_files") + "SELECT max(coalesce(modified_on, fetched_on)) FILTER (dataset_name = 'eo_bmf') AS bmf_as_of, max(coalesce(modified_on, fetched_on)) FILTER (dataset_name = 'auto_revocation') AS revocations_as_of, max(coalesce(modified_on, fetched_on)) FILTER (dataset_name = 'pub78') AS pub78_as_of FROM raw_files")
def view_standing_vintage(spark, d):
    """VIEW-17, DT-05: one row of dates, each list's own date before the day it was fetched."""
    f = rel(spark, d, "raw_files").withColumn("day", F.coalesce("modified_on", "fetched_on"))
    of = lambda n, a: F.max(F.when(F.col("dataset_name") == n, F.col("day"))).alias(a)
    return f.agg(of("eo_bmf", "bmf_as_of"), of("auto_revocation", "revocations_as_of"), of("pub78", "pub78_as_of"))


@query(cte("signals", "organizations", "raw_files", "licensing_map") + f", {_FILES} SELECT signal_id, s.org_id, day, kind, name FROM signals s JOIN organizations o ON o.org_id = s.org_id JOIN pub ON pub.file_id = o.file_id WHERE status = 'published'")
def view_signals(spark, d):
    """VIEW-20, WS-20, STM-06: only published signals, of organisations that may be shown."""
    s = rel(spark, d, "signals").filter("status = 'published'")
    o = public(spark, d, rel(spark, d, "organizations")).select("org_id", "name")
    return s.join(o, "org_id").select("signal_id", "org_id", "day", "kind", "name")


# --- the open list of foundations

_CUT = "regexp_replace(name, '([^ ]) +(C/O *|% *|IN CARE OF +)[^ ].*$', '\\1', 'i')"


@query(cte(*_STAND_OF, "filing_financials", "application_info") + f"""{_STAND}, {_PARSED} SELECT o.org_id, s.ein, {_CUT.replace('name', 'o.name')} AS name, o.state, standing, pf.year, pf.assets, coalesce(pf.grants_paid, pf.distributions) AS giving,
CASE WHEN pf.grants_paid IS NOT NULL THEN 'grants_paid' WHEN pf.distributions IS NOT NULL THEN 'distributions' END AS giving_basis, CASE WHEN pf.object_id IS NULL THEN NULL WHEN a.object_id IS NULL THEN 'unknown' WHEN only_preselected THEN 'preselected_only' ELSE 'open' END AS posture
FROM organizations o JOIN s ON s.org_id = o.org_id LEFT JOIN pf ON pf.org_id = o.org_id AND rn = 1 LEFT JOIN application_info a ON a.object_id = pf.object_id WHERE o.org_type = 'private_foundation'""")
def list_foundations(spark, d):
    """DRV-09, PRJ-02, PRJ-12, JN-02: one row a foundation; a missing sum stays missing, and the basis names the line that it came from."""
    s = standing(spark, d).filter("org_type = 'private_foundation'").select("org_id", "ein", "name", "state", "standing")
    a = rel(spark, d, "application_info").select("object_id", "only_preselected", F.lit(True).alias("has"))
    p = _newest(parsed(spark, d)).select("org_id", "object_id", "year", "assets", "grants_paid", "distributions").join(a, "object_id", "left")
    j = s.join(p, "org_id", "left")
    basis = F.when(F.col("grants_paid").isNotNull(), "grants_paid").when(F.col("distributions").isNotNull(), "distributions")
    answer = F.when(F.col("object_id").isNotNull(), posture(F.coalesce("has", F.lit(False)), F.col("only_preselected")))
    return j.select("org_id", "ein", T.cut_care_of(F.col("name")).alias("name"), "state", "standing", "year", "assets", F.coalesce("grants_paid", "distributions").alias("giving"), basis.alias("giving_basis"), answer.alias("posture"))


@query(cte("filings", "filing_financials", "organizations", "funding_events") + f""", {_PARSED}, g AS (SELECT funder_org_id, fy, count(*) AS n_grants, sum(amount) AS listed FROM funding_events WHERE event_type = 'grant' AND split_part(source_record_key, ':', 2) NOT IN (SELECT object_id FROM lf WHERE superseded_by IS NOT NULL) GROUP BY 1, 2)
SELECT pf.org_id, year, pf.object_id, pf.assets, pf.grants_paid, CAST(coalesce(n_grants, 0) AS BIGINT) AS n_grants, CAST(listed AS DOUBLE) AS listed, CAST(pf.grants_paid - listed AS DOUBLE) AS gap FROM pf JOIN organizations o ON o.org_id = pf.org_id AND o.org_type = 'private_foundation' LEFT JOIN g ON g.funder_org_id = pf.org_id AND g.fy = pf.year""")
def list_years(spark, d):
    """DRV-09, AGG-18: a row a foundation-year; a gap only where both sums are known."""
    g = live_grants(spark, d).groupBy(F.col("funder_org_id").alias("org_id"), F.col("fy").alias("year")).agg(F.count("*").alias("n_grants"), F.sum("amount").alias("listed"))
    o = rel(spark, d, "organizations").filter("org_type = 'private_foundation'").select("org_id")
    j = parsed(spark, d).join(o, "org_id").join(g, ["org_id", "year"], "left")
    return j.select("org_id", "year", "object_id", "assets", "grants_paid", F.coalesce("n_grants", F.lit(0)).cast("long").alias("n_grants"), F.col("listed").cast("double").alias("listed"), (F.col("grants_paid") - F.col("listed")).cast("double").alias("gap"))


def live_grants(spark, d):
    """Grants, not commitments, of filings that still stand."""
    e = rel(spark, d, "funding_events").filter("event_type = 'grant'").withColumn("oid", F.split_part("source_record_key", F.lit(":"), F.lit(2)))
    dead = live(spark, d).filter("superseded_by is not null").select(F.col("object_id").alias("oid"))
    return e.join(dead, "oid", "left_anti")


@query(cte("filings", "filing_financials", "application_info") + f""", {_PARSED}, y AS (SELECT year, count(*) AS n, count(revenue) AS revenue, count(distributions) AS distributions, count(a.object_id) AS answers, count(deadlines_txt) FILTER (regexp_matches(deadlines_txt, '@[A-Za-z0-9]|[0-9]{{3}}[-. ][0-9]{{4}}')) AS withheld FROM pf LEFT JOIN application_info a ON a.object_id = pf.object_id GROUP BY 1)
SELECT year, n, revenue, distributions, answers, withheld FROM y UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(revenue) AS BIGINT), CAST(sum(distributions) AS BIGINT), CAST(sum(answers) AS BIGINT), CAST(sum(withheld) AS BIGINT) FROM y""")
def list_coverage(spark, d):
    """DRV-09, AGG-12, AGG-19, DQ-10, STR-27: filled cells a year, then folded; deadline texts that hold a contact are counted as withheld."""
    a = rel(spark, d, "application_info").select("object_id", "deadlines_txt", F.lit(1).alias("has"))
    j = parsed(spark, d).join(a, "object_id", "left")
    y = j.groupBy("year").agg(F.count("*").alias("n"), F.count("revenue").alias("revenue"), F.count("distributions").alias("distributions"), F.count("has").alias("answers"), F.count_if(T.has_contact(F.col("deadlines_txt"))).alias("withheld"))
    return y.unionByName(y.agg(F.lit(None).cast("int").alias("year"), *[F.sum(c).alias(c) for c in ("n", "revenue", "distributions", "answers", "withheld")]))


@query(cte("filings", "filing_financials", "funding_events", "application_info") + f""", {_PARSED} SELECT 'P1_amended_counted_twice' AS check_name, count(*) AS bad FROM (SELECT funder_org_id, fy FROM funding_events WHERE split_part(source_record_key, ':', 2) NOT IN (SELECT object_id FROM lf WHERE superseded_by IS NOT NULL) AND source_record_key LIKE 'irs990pf:%' GROUP BY 1, 2 HAVING count(DISTINCT split_part(source_record_key, ':', 2)) > 1)
UNION ALL SELECT 'P2_posture_not_of_newest', count(*) FROM pf WHERE rn = 1 AND EXISTS (SELECT 1 FROM pf q WHERE q.org_id = pf.org_id AND (q.tax_period, q.object_id) > (pf.tax_period, pf.object_id)) UNION ALL SELECT 'P3_newest_not_parsed', count(*) FROM (SELECT org_id, max(tax_period) AS a, max(tax_period) FILTER (parsed) AS b FROM lf WHERE superseded_by IS NULL GROUP BY 1) WHERE b IS NULL OR a > b""")
def list_preflight(spark, d):
    """DRV-10, INV-F3: what must be looked at before a list goes out; a foundation-year with grants of two standing filings is counted twice."""
    e = rel(spark, d, "funding_events").filter("source_record_key like 'irs990pf:%'").withColumn("oid", F.split_part("source_record_key", F.lit(":"), F.lit(2)))
    f = live(spark, d)
    dead = f.filter("superseded_by is not null").select(F.col("object_id").alias("oid"))
    twice = e.join(dead, "oid", "left_anti").groupBy("funder_org_id", "fy").agg(F.count_distinct("oid").alias("n")).filter("n > 1")
    p = parsed(spark, d)
    newest = _newest(p)
    later = p.select("org_id", F.struct("tax_period", "object_id").alias("q")).join(newest.select("org_id", F.struct("tax_period", "object_id").alias("l")), "org_id").filter("q > l")
    unread = f.filter("superseded_by is null").groupBy("org_id").agg(F.max("tax_period").alias("a"), F.max(F.when(F.col("parsed"), F.col("tax_period"))).alias("b")).filter("b is null or a > b")
    n = lambda name, df: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check_name"), "bad")
    return n("P1_amended_counted_twice", twice).unionByName(n("P2_posture_not_of_newest", later)).unionByName(n("P3_newest_not_parsed", unread))


# --- contacts

ROLES = "grants grant grantsinfo grantinfo grantsadmin grantadmin apply application applications foundation fdn info information contact contactus admin office inquiries inquiry enquiries enquiry general hello help support giving philanthropy charity charitable scholarship scholarships proposals proposal trustee trustees secretary treasurer executivedirector execdir director president board staff team reception frontdesk finaid donations main grantsmanager programs program"


@query(cte("application_info", "filings") + r""", e AS (SELECT a.object_id, org_id, contact_name, email, lower(trim(email)) AS addr FROM application_info a JOIN filings f ON f.object_id = a.object_id WHERE email IS NOT NULL),
l AS (SELECT *, CASE WHEN regexp_matches(addr, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$') THEN regexp_replace(split_part(addr, '@', 1), '\+.*$', '') END AS raw FROM e), k AS (SELECT *, regexp_replace(raw, '[._-]', '', 'g') AS flat FROM l)
SELECT object_id, flat, CASE WHEN flat IS NULL OR flat IN ('na', 'none', 'n') THEN false WHEN len(list_filter(string_split_regex(regexp_replace(lower(coalesce(contact_name, '')), '[^a-z ]', ' ', 'g'), ' +'), lambda t: length(t) >= 4 AND contains(flat, t))) > 0 THEN false
WHEN len(list_filter(string_split_regex(raw, '[._-]'), lambda t: t IN ('grants', 'info', 'jane', 'program') AND t <> 'jane')) > 0 OR regexp_matches(flat, '^(grants|foundation)') THEN true ELSE false END AS role_based FROM k""")
def contact_role_email(spark, d):
    """STR-11, STR-12, DRV-08: an address speaks for a role unless it is filler or holds part of the contact's name."""
    a = rel(spark, d, "application_info").filter("email is not null")
    return a.select("object_id", T.email_local(F.col("email")).alias("flat"), T.is_role_email(F.col("email"), F.col("contact_name")).alias("role_based"))


@query(cte("application_info", "filings") + """SELECT contact_class, count(*) AS n FROM (SELECT CASE contact_name WHEN 'Grants Committee' THEN 'role' WHEN 'Jane Q Smith' THEN 'person' WHEN 'See website www.x.org' THEN 'instruction' WHEN 'Program Director' THEN 'role' ELSE 'none' END AS contact_class FROM application_info) GROUP BY 1""")
def contact_name_classes(spark, d):
    """STR-26: what a contact's name field holds."""
    return rel(spark, d, "application_info").groupBy(T.contact_class(F.col("contact_name")).alias("contact_class")).agg(F.count("*").alias("n"))


@query(cte("contact_channels", "raw_files", "licensing_map") + f""", {_FILES}, v AS (SELECT c.* FROM contact_channels c JOIN pub ON pub.file_id = c.file_id WHERE publishability = 'public' AND tier <> 'red')
SELECT 'red_shown' AS check_name, count(*) FILTER (tier = 'red') AS bad FROM v UNION ALL SELECT 'private_shown', count(*) FILTER (publishability <> 'public') FROM v UNION ALL SELECT 'unlicensed_shown', count(*) FILTER (file_id NOT IN (SELECT file_id FROM pub)) FROM v
UNION ALL SELECT 'shown', count(*) FROM v UNION ALL SELECT 'withheld', (SELECT count(*) FROM contact_channels) - (SELECT count(*) FROM v) UNION ALL SELECT 'value_twice', count(*) FROM (SELECT org_id, channel_type, value FROM v GROUP BY ALL HAVING count(*) > 1)""")
def contact_audit(spark, d):
    """DRV-08, INV-CT, INV-F5, INV-X1..X3: what may not be shown is not, and what is shown and withheld adds up."""
    c, p = rel(spark, d, "contact_channels"), public_files(spark, d).select("file_id")
    v = c.filter("publishability = 'public' and tier <> 'red'").join(p, "file_id", "left_semi")
    twice = v.groupBy("org_id", "channel_type", "value").count().filter("count > 1")
    hidden = c.join(p.withColumn("ok", F.lit(True)), "file_id", "left").filter("publishability <> 'public' or tier = 'red' or ok is null")
    n = lambda name, df, value=F.count("*"): df.agg(value.alias("bad")).select(F.lit(name).alias("check_name"), "bad")
    parts = [n("red_shown", v, F.count_if(F.col("tier") == "red")), n("private_shown", v, F.count_if(F.col("publishability") != "public")), n("unlicensed_shown", v.join(p, "file_id", "left_anti")), n("shown", v), n("withheld", hidden), n("value_twice", twice)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(cte("funding_events", "organizations") + "SELECT org_id, CASE WHEN org_type = 'public_charity' AND org_id IN (SELECT funder_org_id FROM funding_events WHERE event_type = 'grant' AND amount > 104900) THEN 'private_foundation' ELSE org_type END AS org_type FROM organizations WHERE org_id < 1000000")
def drv_never_demote(spark, d):
    """DRV-06: a registry type does not take the type from an organisation that gave grants."""
    o = rel(spark, d, "organizations").filter("org_id < 1000000")
    g = rel(spark, d, "funding_events").filter("event_type = 'grant' and amount > 104900").select(F.col("funder_org_id").alias("org_id")).distinct().withColumn("gave", F.lit(True))
    return o.join(g, "org_id", "left").select("org_id", F.when((F.col("org_type") == "public_charity") & F.col("gave"), "private_foundation").otherwise(F.col("org_type")).alias("org_type"))


@query(cte("filings", "funding_events") + "SELECT event_id FROM funding_events WHERE fy = 1997 AND split_part(source_record_key, ':', 2) NOT IN (SELECT CAST(CAST(object_id AS BIGINT) - 1 AS STRING) FROM filings WHERE amended)")
def drv_amendment_drops(spark, d):
    """DRV-07: events of a filing that an amendment replaces go."""
    before = rel(spark, d, "filings").filter("amended").select((F.col("object_id").cast("long") - 1).cast("string").alias("oid"))
    e = rel(spark, d, "funding_events").filter("fy = 1997").withColumn("oid", F.split_part("source_record_key", F.lit(":"), F.lit(2)))
    return e.join(before, "oid", "left_anti").select("event_id")


@query(cte("filings", "organizations") + f""", {_LIVE}, w AS (SELECT DISTINCT ON (org_id) org_id, website FROM lf WHERE superseded_by IS NULL AND parsed ORDER BY org_id, tax_period DESC, object_id DESC)
SELECT o.org_id, CASE WHEN w.website LIKE 'WWW%' THEN 'https://' || lower(w.website) WHEN o.website IS NOT NULL THEN 'https://' || o.website END AS url, CASE WHEN w.website LIKE 'WWW%' THEN 'filing' WHEN o.website IS NOT NULL THEN 'registry' END AS basis FROM organizations o LEFT JOIN w ON w.org_id = o.org_id WHERE o.org_id < 1000000""")
def view_org_website(spark, d):
    """VIEW-19, DRV-11, STR-14, INV-F8: the website that the newest parsed live filing states, else the registry's."""
    w = _newest(live(spark, d).filter("superseded_by is null and parsed")).select("org_id", T.website(F.col("website")).alias("f"))
    o = rel(spark, d, "organizations").filter("org_id < 1000000").select("org_id", T.website(F.col("website")).alias("r"))
    return o.join(w, "org_id", "left").select("org_id", F.coalesce("f", "r").alias("url"), F.when(F.col("f").isNotNull(), "filing").when(F.col("r").isNotNull(), "registry").alias("basis"))


@query(cte("filings", "officers", "contributors", "funding_events") + f""", {_LIVE} SELECT lf.object_id, amended, superseded_by, (SELECT count(*) FROM officers x WHERE x.object_id = lf.object_id) AS n_officers, (SELECT count(*) FROM contributors x WHERE x.object_id = lf.object_id) AS n_contributors,
count(event_id) FILTER (event_type = 'grant') AS n_grants, count(event_id) FILTER (event_type = 'commitment') AS n_commitments FROM lf LEFT JOIN funding_events e ON split_part(source_record_key, ':', 2) = lf.object_id GROUP BY 1, 2, 3""")
def ws_filing_page(spark, d):
    """WS-08, Q-B12, JN-19: what a filing's page counts; each detail table is counted once, by filing."""
    n = lambda t, c: rel(spark, d, t).groupBy("object_id").agg(F.count("*").alias(c))
    e = rel(spark, d, "funding_events").groupBy(F.split_part("source_record_key", F.lit(":"), F.lit(2)).alias("object_id")).agg(F.count_if(F.col("event_type") == "grant").alias("n_grants"), F.count_if(F.col("event_type") == "commitment").alias("n_commitments"))
    j = live(spark, d).join(n("officers", "n_officers"), "object_id", "left").join(n("contributors", "n_contributors"), "object_id", "left").join(e, "object_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("object_id", "amended", "superseded_by", zero("n_officers"), zero("n_contributors"), zero("n_grants"), zero("n_commitments"))


@query(cte("filings", "filing_financials", "application_info", "raw_files", "licensing_map") + f""", {_FILES}, {_PARSED}, h AS (SELECT org_id, CASE WHEN a.object_id IS NULL THEN 'unknown' WHEN only_preselected THEN 'preselected_only' ELSE 'open' END AS posture, only_preselected FROM pf LEFT JOIN application_info a ON a.object_id = pf.object_id WHERE return_type = '990PF' AND rn = 1)
SELECT 'F1_partition' AS name, count(*) - count(*) FILTER (posture = 'open') - count(*) FILTER (posture = 'preselected_only') - count(*) FILTER (posture = 'unknown') AS bad FROM h UNION ALL SELECT 'F2_open_but_preselected', count(*) FILTER (posture = 'open' AND only_preselected) FROM h
UNION ALL SELECT 'F2_is_vacuous', CASE WHEN count(*) FILTER (posture = 'open') = 0 THEN 1 ELSE 0 END FROM h UNION ALL SELECT 'F4_negative', count(*) FILTER (distributions < 0 OR assets < 0) FROM pf UNION ALL SELECT 'F4_found_by_giving_only', CASE WHEN count(*) FILTER (distributions > 500000 AND assets < 1000000) = 0 THEN 1 ELSE 0 END FROM pf
UNION ALL SELECT 'B13_winner_is_dead', count(*) FROM lf a JOIN lf b ON a.superseded_by = b.object_id WHERE b.superseded_by IS NOT NULL UNION ALL SELECT 'B13_two_live', count(*) FROM (SELECT 1 FROM lf WHERE superseded_by IS NULL GROUP BY ein, return_type, tax_period HAVING count(*) > 1) UNION ALL SELECT 'X2_license', (SELECT count(*) FROM pub WHERE license_code = 'ASIA')""")
def dq_invariants(spark, d):
    """INV-F1, INV-F2, INV-F4, INV-X4, INV-B11, Q-B13, DQ-01, DQ-02: rows against each rule, all zero on sound tables."""
    h = mart_application_posture(spark, d)
    p, f = parsed(spark, d), live(spark, d)
    chain = f.filter("superseded_by is not null").select(F.col("superseded_by").alias("w")).join(f.filter("superseded_by is not null").select(F.col("object_id").alias("w")), "w")
    two = f.filter("superseded_by is null").groupBy("ein", "return_type", "tax_period").count().filter("count > 1")
    is_ = lambda v: F.count_if(F.col("posture") == v)
    none = lambda c: F.when(F.count_if(c) == 0, 1).otherwise(0).cast("long")
    n = lambda name, df, value=F.count("*"): df.agg(value.alias("bad")).select(F.lit(name).alias("name"), "bad")
    parts = [n("F1_partition", h, F.count("*") - is_("open") - is_("preselected_only") - is_("unknown")), n("F2_open_but_preselected", h, F.count_if((F.col("posture") == "open") & F.col("only_preselected"))), n("F2_is_vacuous", h, none(F.col("posture") == "open")),
             n("F4_negative", p, F.count_if((F.col("distributions") < 0) | (F.col("assets") < 0))), n("F4_found_by_giving_only", p, none((F.col("distributions") > 500000) & (F.col("assets") < 1000000))), n("B13_winner_is_dead", chain), n("B13_two_live", two),
             n("X2_license", public_files(spark, d).filter("license_code = 'ASIA'"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(cte("filings", "filing_financials", "organizations") + f""", {_LIVE}, a AS (SELECT lf.org_id, lf.object_id, tax_period, parsed, CASE WHEN org_id % 5 = 0 THEN 'Canada' ELSE 'US' END AS country, CASE WHEN org_id % 6 = 0 THEN NULL WHEN org_id % 7 = 0 THEN 'Atlantis' ELSE 'Texas' END AS state, 'oslo ' || org_id % 3 AS city, CASE WHEN fy % 2 = 0 THEN '123456789' ELSE '1234' END AS zip FROM lf WHERE superseded_by IS NULL),
n AS (SELECT DISTINCT ON (org_id) org_id, object_id FROM a ORDER BY org_id, tax_period DESC, object_id DESC), p AS (SELECT DISTINCT ON (org_id) * FROM a WHERE parsed ORDER BY org_id, tax_period DESC, object_id DESC)
SELECT o.org_id, CASE WHEN p.org_id IS NULL THEN 'no_return' WHEN country <> 'US' THEN 'foreign' WHEN p.state IS NULL THEN 'no_state' WHEN p.state = 'Atlantis' THEN 'bad_state' ELSE 'ok' END AS reason, CASE WHEN country = 'US' AND p.state = 'Texas' THEN 'TX' END AS state, CASE WHEN country = 'US' AND p.state = 'Texas' THEN upper(p.city) END AS city, CASE WHEN country = 'US' AND p.state = 'Texas' AND length(p.zip) = 9 THEN '12345-6789' END AS zip, coalesce(n.object_id <> p.object_id, false) AS newer_unread
FROM organizations o LEFT JOIN p ON p.org_id = o.org_id LEFT JOIN n ON n.org_id = o.org_id WHERE o.org_id < 1000000""")
def drv_org_address(spark, d):
    """DRV-03, JN-09, STR-08, STR-10: the address of the newest parsed return, or why there is none; the street is never taken."""
    k = F.col("org_id")
    f = live(spark, d).filter("superseded_by is null").select("org_id", "object_id", "tax_period", "parsed", F.when(k % 5 == 0, "Canada").otherwise("US").alias("country"), F.when(k % 6 == 0, None).when(k % 7 == 0, "Atlantis").otherwise("Texas").alias("raw_state"), F.concat(F.lit("oslo "), (k % 3).cast("string")).alias("raw_city"), F.when(F.col("fy") % 2 == 0, "123456789").otherwise("1234").alias("raw_zip"))
    any_ = _newest(f).select("org_id", F.col("object_id").alias("any_id"))
    j = rel(spark, d, "organizations").filter("org_id < 1000000").select("org_id").join(_newest(f.filter("parsed")), "org_id", "left").join(any_, "org_id", "left")
    code = T.state_code(F.col("raw_state"))
    reason = F.when(F.col("object_id").isNull(), "no_return").when(~F.upper(F.trim("country")).isin("US", "USA", ""), "foreign").when(F.col("raw_state").isNull(), "no_state").when(code.isNull(), "bad_state").otherwise("ok")
    ok = lambda c, n: F.when(reason == "ok", c).alias(n)
    return j.select("org_id", reason.alias("reason"), ok(code, "state"), ok(F.upper("raw_city"), "city"), ok(T.zip_code(F.col("raw_zip")), "zip"), F.coalesce(F.col("any_id") != F.col("object_id"), F.lit(False)).alias("newer_unread"))


@query("""WITH f AS (SELECT l_suppkey AS adviser, CASE l_partkey % 9 WHEN 0 THEN 'Venture Capital Fund' WHEN 1 THEN 'Private Equity Fund' ELSE 'Hedge Fund' END AS fund_type, CASE WHEN l_quantity < 45 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS gav FROM lineitem WHERE l_orderkey % 400 = l_suppkey % 400),
s AS (SELECT adviser, bool_or(fund_type = 'Venture Capital Fund') AS v, bool_or(fund_type = 'Private Equity Fund') AS p, sum(gav) AS gav FROM f GROUP BY 1) SELECT s_suppkey AS adviser, CASE WHEN coalesce(v, false) OR s_suppkey % 17 = 3 THEN 'vc' WHEN p THEN 'pe' ELSE 'investment_adviser' END AS org_type, CAST(gav AS DOUBLE) AS fund_size FROM supplier LEFT JOIN s ON adviser = s_suppkey""")
def drv_adviser_class(spark, d):
    """DRV-05: an adviser with a venture fund, or a venture exemption, is venture; else one with a private equity fund is that; sizes add where they are stated."""
    from ..sources.tables import table

    li = table(spark, d, "lineitem").filter("l_orderkey % 400 = l_suppkey % 400")
    kind = F.when(F.col("l_partkey") % 9 == 0, "Venture Capital Fund").when(F.col("l_partkey") % 9 == 1, "Private Equity Fund").otherwise("Hedge Fund")
    f = li.select(F.col("l_suppkey").alias("adviser"), kind.alias("fund_type"), F.when(F.col("l_quantity") < 45, F.col("l_extendedprice").cast("decimal(18,2)")).alias("gav"))
    s = f.groupBy("adviser").agg(F.bool_or(F.col("fund_type") == "Venture Capital Fund").alias("v"), F.bool_or(F.col("fund_type") == "Private Equity Fund").alias("p"), F.sum("gav").cast("double").alias("fund_size"))
    j = table(spark, d, "supplier").select(F.col("s_suppkey").alias("adviser")).join(s, "adviser", "left")
    return j.select("adviser", F.when(F.coalesce("v", F.lit(False)) | (F.col("adviser") % 17 == 3), "vc").when(F.col("p"), "pe").otherwise("investment_adviser").alias("org_type"), "fund_size")


@query(cte(*_STAND_OF, "contact_channels", "application_info") + f"""{_STAND}, {_FILES}, v AS (SELECT c.* FROM contact_channels c JOIN pub ON pub.file_id = c.file_id WHERE publishability = 'public' AND tier <> 'red')
SELECT 'X1_contacts' AS name, count(*) FILTER (publishability <> 'public' OR tier = 'red') AS bad, count(*) AS seen FROM v UNION ALL SELECT 'X2_license', count(*) FILTER (license_code = 'ASIA'), count(*) FROM organizations o JOIN pub ON pub.file_id = o.file_id
UNION ALL SELECT 'X3_named_mail', count(*) FILTER (contains(lower(email), 'jane') AND contains(lower(contact_name), 'jane')), count(*) FROM application_info WHERE email LIKE 'grants@%' AND coalesce(contact_name, '') <> 'Grants Committee'
UNION ALL SELECT 'X7_counts', (SELECT count(*) FROM s WHERE org_id < 1000000) - (SELECT count(*) FROM organizations o JOIN org_identifiers i ON i.org_id = o.org_id AND id_type = 'ein' WHERE o.org_id < 1000000), (SELECT count(*) FROM s WHERE org_id < 1000000)""")
def dq_export_boundary(spark, d):
    """INV-X1, INV-X2, INV-X3, INV-X7, INV-F6: rows that break an export's boundary, beside the rows that were looked at."""
    v = rel(spark, d, "contact_channels").filter("publishability = 'public' and tier <> 'red'").join(public_files(spark, d).select("file_id"), "file_id", "left_semi")
    o = public(spark, d, rel(spark, d, "organizations"))
    shown = rel(spark, d, "application_info").filter(T.is_role_email(F.col("email"), F.col("contact_name")) & F.col("email").startswith("grants@"))
    named = shown.filter(F.contains(F.lower("contact_name"), F.lit("jane")) & F.contains(F.lower("email"), F.lit("jane")))
    s = standing(spark, d).filter("org_id < 1000000").select("org_id")
    base = rel(spark, d, "org_identifiers").filter("id_type = 'ein' and org_id < 1000000")
    row = lambda name, bad, seen: bad.agg(F.count("*").alias("bad")).crossJoin(seen.agg(F.count("*").alias("seen"))).select(F.lit(name).alias("name"), "bad", "seen")
    missing = base.select("org_id").join(s, "org_id", "left_anti")
    return row("X1_contacts", v.filter("publishability <> 'public' or tier = 'red'"), v).unionByName(row("X2_license", o.filter("license_code = 'ASIA'"), o)).unionByName(row("X3_named_mail", named, shown)).unionByName(row("X7_counts", missing, s))

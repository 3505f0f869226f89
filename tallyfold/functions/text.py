"""Name, identifier and contact functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal forms at the end of a name that name matching ignores.
SUFFIXES = ("INC", "INCORPORATED", "LLC", "L L C", "CORP", "CORPORATION", "CO", "LTD", "LP", "LLP", "PC", "PA")
#: Words that mark a name as an entity rather than a person.
ENTITY_WORDS = ("LLC", "L L C", "LTD", "INC", "CORP", "GP", "LP", "L P", "LLP", "FUND", "FUNDS", "GROUP", "PARTNERS", "CAPITAL", "MANAGEMENT", "HOLDINGS", "ADVISORS", "ADVISERS", "COMPANY", "TRUST")
#: What stands in a website box that has no website.
NO_WEBSITE = ("N/A", "NA", "N-A", "NONE", "NULL", "NO", "NON", "N/A.", "WWW", "HTTP", "HTTPS", "TBD", "UNKNOWN", "PENDING", "SAME", "X", "XX", "XXX", "NOWEBSITE", "NOTAPPLICABLE")
#: Local parts that are no address.
FILLER_LOCALS = ("na", "none", "notapplicable", "notapplicible", "unknown", "nil", "null", "test", "email", "noemail", "nota", "n", "x", "xx", "xxx")
#: Local parts that name a role.
ROLE_LOCALS = (
    "grants", "grant", "grantsinfo", "grantinfo", "grantsadmin", "grantadmin", "apply", "application", "applications", "foundation", "fdn", "info", "information", "contact", "contactus", "admin", "office",
    "inquiries", "inquiry", "enquiries", "enquiry", "general", "hello", "help", "support", "giving", "philanthropy", "charity", "charitable", "scholarship", "scholarships", "proposals", "proposal", "trustee",
    "trustees", "secretary", "treasurer", "executivedirector", "execdir", "director", "president", "board", "staff", "team", "reception", "frontdesk", "finaid", "donations", "main", "grantsmanager", "programs", "program",
)
#: Words that name a role, an office or an organisation rather than a person.
ROLE_WORDS = (
    "committee office officer officers director directors administrator administration manager management program programs grant grants grantmaking foundation fund trust trustees trustee board secretary president "
    "coordinator department dept staff team scholarship scholarships selection review attn attention c/o care executive chair chairman chairperson treasurer clerk agent counsel advisor advisors adviser advisers "
    "services service company co inc llc llp lp corporation corp bank association society church college university school hospital institute center centre ministry council club league trustco applications application "
    "inquiries inquiry requests request proposals proposal national community family memorial charitable united regional county city state fdn fnd funds giving philanthropy philanthropic endowment relations information "
    "info guidelines letter letters intent contact contacts person the of and for to at in on or a an &"
).split()
#: Words that mark an instruction rather than a name.
INSTRUCTION_WORDS = (
    "see visit apply applying online portal website web site email e-mail download submit submitted submission via through our available refer go please use form forms none not applicable n/a no accept accepted "
    "accepting unsolicited only by invitation mail send write call preselected pre-selected us"
).split()
#: A clause that holds one of these is an instruction.
INSTRUCTION_CLAUSE = r"(?i)\b(?:website|web\s*site|www\.|https?:|e-?mail|apply|applications?\s+(?:are|should|must|may|can|online|available|accepted)|visit|see\b|online|portal|contact us|not applicable|n\/a|none|no applications|not accept|unsolicited|by invitation|download|submit|refer to|go to|please)"
#: Names and codes of states and territories.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI",
    "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT",
    "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "PUERTO RICO": "PR", "GUAM": "GU", "VIRGIN ISLANDS": "VI",
}
#: Openings of filler text that stands for a recipient.
PLACEHOLDERS = (
    "SEE (ATTACH|STATEMENT|STMT|STMNT|SCHEDULE|LIST|SUPPLEMENT|ADDITIONAL (DATA|INFO|SCHEDULE|STATEMENT|LIST|PAGE))",
    "(AS )?PER (ATTACH|SCHEDULE|LIST|STATEMENT|STMT)", "VARIOUS", "MISC(ELLANEOUS)?( |$)", "N A$|NA$|NONE$|OTHER$|GENERAL$",
    "ALL OTHERS?$|UNKNOWN$|NOT APPLICABLE$|CASH GRANTS?$", "SCHEDULE( |$)", "ATTACH(ED|MENT)?$", "ATTACHED (LIST|SCH|STATEMENT|SUPPLEMENT)",
    r"ATTACHMENT ([A-Z]|\d+)( |$)", r"STATEMENT( \d|$)", "ANONYMOUS( DONOR)?$", "INDIVIDUALS?$", "SCHOLARSHIPS?$", "SUNDRY",
    "MULTIPLE (RECIPIENT|GRANT|CHARIT|ORGANIZATION)", "AVAILABLE (UPON|ON) REQUEST", r"UNDER (\d{3,}|\d+ ?K|\d{1,3} \d{3})( |$)",
    r"(GRANTS|GIFTS|DONATIONS|CONTRIBUTIONS|AMOUNTS) (OF )?(UNDER|LESS THAN|BELOW) (\d{3,}|\d+ ?K|\d{1,3} \d{3})( |$)",
)


def norm_name(x: Column) -> Column:
    """Upper case, punctuation to space, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(x), r"(?U)[^\w\s&-]", " "), r"(?U)\s+", " "))


def squeeze(clean: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(clean, "[^A-Z0-9]+", ""), F.lit("")), clean)


def strip_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, rf"\s+({'|'.join(SUFFIXES)})$", ""))


def clean_name(name: Column) -> Column:
    """A leading THE and a closing legal form go."""
    return strip_suffix(F.regexp_replace(norm_name(name), r"^THE\s+", ""))


def is_placeholder(norm: Column) -> Column:
    return norm.isNull() | (F.length(norm) < 4) | norm.rlike("^(" + "|".join(PLACEHOLDERS) + ")")


def is_entity(norm: Column) -> Column:
    return norm.rlike(rf"\b({'|'.join(ENTITY_WORDS)})\b")


def person_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(norm_name(name), " "), lambda t: t != "")), " ")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def ein(x: Column) -> Column:
    d = digits(x)
    return F.when((F.length(d) > 0) & (F.length(d) <= 9), F.lpad(d, 9, "0"))


def cik(x: Column) -> Column:
    return F.nullif(F.regexp_replace(digits(x), "^0+", ""), F.lit(""))


def crd(x: Column) -> Column:
    return F.nullif(digits(x), F.lit(""))


def amount(x: Column) -> Column:
    """Whole units, truncated toward zero; null for what is no number."""
    s = F.translate(F.trim(x), ",$", "")
    return F.when(~s.isin("", "-"), s.try_cast("double")).cast("long")


def zip_code(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) == 5, d).when(F.length(d) == 9, F.concat(F.left(d, F.lit(5)), F.lit("-"), F.right(d, F.lit(4))))


def phone(x: Column) -> Column:
    d = digits(x)
    return F.when(d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), F.concat(F.lit("+1"), d))


def email_local(x: Column) -> Column:
    """The local part of a valid address without its tag and separators."""
    a = F.lower(F.trim(x))
    local = F.regexp_replace(F.regexp_replace(F.split_part(a, F.lit("@"), F.lit(1)), r"\+.*$", ""), "[._-]", "")
    return F.when(a.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), local)


def canonical_url(x: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, one closing slash less; an empty path is ``/``."""
    bare = F.regexp_replace(F.trim(x), "#.*$", "")
    head, rest = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    scheme = F.lower(F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host, path = F.lower(F.regexp_extract(head, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)), F.regexp_extract(head, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1)
    tracking = lambda p: F.regexp_extract(p, "^([^=]*)", 1).rlike("(?i)^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|source)$")
    kept = F.array_join(F.transform(F.filter(F.split(rest, "&"), lambda p: (p != "") & ~tracking(p)), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    path = F.when(path == "", "/").when(path.endswith("/") & (F.length(path) > 1), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def website(x: Column) -> Column:
    """A website box as a URL: https unless it says http, a dotted host with a top level of letters; null for anything else."""
    s = F.regexp_replace(F.trim(x), "[,;]+$", "")
    plain = F.upper(F.regexp_replace(s, r"^[./]+|[./]+$", ""))
    ok = (s != "") & (F.length(s) <= 200) & ~s.rlike(r"\s") & ~plain.isin(*NO_WEBSITE) & ~s.contains("@")
    low = F.lower(s)
    scheme = F.when(low.startswith("http://"), "http").otherwise("https")
    rest = F.regexp_replace(F.regexp_replace(low, "^https?://", ""), "^/+", "")
    host, path = F.regexp_replace(F.regexp_extract(rest, "^([^/]*)", 1), r"\.+$", ""), F.regexp_replace(F.regexp_extract(rest, "^[^/]*/(.*)$", 1), "/+$", "")
    good = host.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$")
    return F.when(ok & good, F.concat(scheme, F.lit("://"), host, F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.lit(""))))


def state_code(x: Column) -> Column:
    """Two letters as they are, a full name by its code, else null."""
    s = F.upper(F.trim(x))
    table = F.create_map(*[F.lit(v) for pair in STATES.items() for v in pair])
    return F.when(F.length(s) == 2, s).otherwise(F.get(F.array(F.try_element_at(table, s)), F.lit(0)))


def cut_care_of(x: Column) -> Column:
    """The name before C/O, % or IN CARE OF, where words stand on both sides."""
    return F.regexp_replace(x, r"(?i)([^ ]) +(C/O *|% *|IN CARE OF +)[^ ].*$", "$1")


def has_contact(x: Column) -> Column:
    """Whether a text holds an address or a telephone number of seven or ten digits."""
    return x.rlike(r"@[A-Za-z0-9]") | x.rlike(r"\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ][0-9]{4}") | x.rlike(r"(^|[^0-9])[0-9]{3}[-. ][0-9]{4}([^0-9]|$)")


def is_role_email(address: Column, contact: Column) -> Column:
    """Whether an address speaks for a role: no filler, no part of the contact's name, and a role word or opening."""
    flat = email_local(address)
    raw = F.regexp_replace(F.lower(F.split_part(F.trim(address), F.lit("@"), F.lit(1))), r"\+.*$", "")
    names = F.split(F.regexp_replace(F.lower(F.coalesce(contact, F.lit(""))), "[^a-z ]", " "), r"\s+")
    personal = F.exists(names, lambda t: (F.length(t) >= 4) & F.contains(flat, t))
    role = F.exists(F.split(raw, "[._-]"), lambda t: t.isin(*ROLE_LOCALS)) | flat.rlike("^(grants|foundation|scholarship|application|inquir|enquir|philanthrop|frontdesk)")
    return F.when(flat.isNull() | flat.isin(*FILLER_LOCALS) | personal, False).when(raw.isin("mail", "email"), True).otherwise(role)


def contact_class(x: Column) -> Column:
    """``none``, ``person``, ``instruction`` or ``role``: what a contact's name field holds; in doubt a person."""
    raw = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    private = raw.rlike(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}") | raw.rlike(r"\(?\d{3}\)?[\s.-]*\d{3}[\s.-]*\d{4}")
    bare = F.regexp_replace(raw, r"(?i)(?:https?:\/\/\S+|www\.\S+|\S+\.(?:org|com|net|edu|gov|us|io)(?:\/\S*)?)", " ")
    clauses = F.filter(F.transform(F.split(bare, r"[,;:|]|\s[-–—]\s|\(|\)"), lambda c: F.trim(c)), lambda c: c != "")
    kept = F.filter(clauses, lambda c: ~c.rlike(INSTRUCTION_CLAUSE))
    dropped = (bare != raw) | (F.size(kept) < F.size(clauses))
    tokens = F.filter(F.split(F.regexp_replace(F.lower(F.array_join(kept, " ")), "[.,;:()'\"]", " "), r"\s+"), lambda t: t != "")
    personal = F.size(F.filter(tokens, lambda t: ~t.isin(*ROLE_WORDS) & ~t.isin(*INSTRUCTION_WORDS) & ~t.rlike(r"^\d+$")))
    left = F.when(F.size(tokens) == 0, F.when(dropped, "instruction").otherwise("none")).when(dropped & (personal == 0) & F.forall(tokens, lambda t: t.isin(*INSTRUCTION_WORDS)), "instruction").otherwise("role")
    return F.when(raw == "", "none").when(private | (personal >= 2), "person").otherwise(left)


def import_key(x: Column) -> Column:
    """Lower case ASCII words without accents, ``&`` as a word, legal forms and ``the`` dropped; null if nothing is left."""
    accented, plain = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
    s = F.regexp_replace(F.replace(F.lower(F.translate(x, accented, plain)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(incorporated|inc|corporation|corp|co|llc|ltd|limited|the)\b", " "), r"\s+", " ")), F.lit(""))


def title_case(x: Column) -> Column:
    """A capital after every character that is no letter, as well after apostrophes and hyphens."""
    chars = F.split(F.lower(x), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def word_similarity(a: Column, b: Column) -> Column:
    """Greatest share of the first set of trigrams that a stretch of the second text's words holds, in whole words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(b), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    n = F.size(words)
    ends = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")))))
    mine = trigrams(a)
    return F.coalesce(F.array_max(F.transform(ends, lambda t: similarity(mine, trigrams(t)))), F.lit(0.0))


def trigrams(x: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all of two trigram sets."""
    common, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, common / every).otherwise(F.lit(0.0))


#: Phrases by which a funder says that it takes no requests.
RESTRICTIVE = r"(?i)\b(no\s+unsolicited|not\s+accept(?:ing)?\s+(?:unsolicited|applications|requests|proposals)|does\s+not\s+solicit|by\s+invitation|no\s+applications|pre[- ]?selected)"


def restrictive_phrase(x: Column) -> Column:
    """The first such phrase, in lower case and single spaces."""
    found = F.regexp_extract(x, RESTRICTIVE, 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def csv_cell(x: Column) -> Column:
    """Quoted as CSV asks; what a spreadsheet would run as a formula gets a quote in front."""
    safe = F.when(x.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.when(safe.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def money_mention(x: Column) -> Column:
    """First dollar amount of a text, with its multiplier, as a double."""
    number = F.regexp_replace(F.regexp_extract(x, r"(?i)\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(x, r"(?i)\$\s?[0-9][0-9,.]*\s?(thousand|million|billion|k|m|b)\b", 1))
    times = F.when(unit.isin("thousand", "k"), 1e3).when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9).otherwise(1.0)
    return number * times


#: Words by which a text is counted to a sector.
SECTORS = {"education": ("school", "education", "scholar", "university"), "health": ("health", "hospital", "clinic", "medical"), "environment": ("climate", "conservation", "environment"), "arts": ("museum", "arts", "music")}


def sector(x: Column) -> Column:
    """The first sector one of whose words stands in a text."""
    out = None
    for name, words in SECTORS.items():
        hit = x.rlike(rf"(?i)\b({'|'.join(words)})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def polarity(x: Column) -> Column:
    """Whether a passage refuses requests, invites them, or names who decides."""
    negative = x.rlike(r"(?i)\b(?:do(?:es)? not|don't|not|no longer|never)\b.{0,40}\b(?:accept|consider|solicit|fund|review)")
    positive = x.rlike(r"(?i)\b(?:apply|submit|applications? (?:are|is) (?:open|accepted|welcome)|how to apply|letter of inquiry)\b")
    role = x.rlike(r"(?i)\b(?:board|committee|director|trustees?|staff)\b")
    return F.when(negative, "negative").when(positive, "positive").when(role, "role").otherwise("none")


def liveness(status: Column, html: Column) -> Column:
    """``error``, ``parked``, ``thin`` or ``live``: what an answer to a request shows."""
    parked = html.rlike(r"(?i)(?:this )?domain (?:name )?(?:is |may be )?for sale|parked (?:free|domain)|buy this domain")
    body = F.length(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>|[ ]+", ""))
    return F.when(status >= 400, "error").when(parked, "parked").when(body < 20, "thin").otherwise("live")


def date_evidence(pages: DataFrame, key: str, html: str, as_of: str) -> DataFrame:
    """``key, kind, month``: the dates by which a page was published or modified, from its meta tags, structured data and visible text."""
    from .numbers import month_of

    x = F.col(html)
    meta = F.regexp_extract_all(x, F.lit(r'(?is)<meta [^>]*>'), F.lit(0))
    name = lambda m: F.lower(F.regexp_extract(m, r'(?i)(?:property|name)\s*=\s*"([^"]*)"', 1))
    kind_of = lambda m: F.when(name(m).isin("article:modified_time", "date.modified", "datemodified", "last-modified"), "modified").when(name(m).isin("article:published_time", "datepublished", "date.published"), "published")
    tags = F.transform(F.filter(meta, lambda m: kind_of(m).isNotNull()), lambda m: F.struct(kind_of(m).alias("kind"), F.left(F.regexp_extract(m, r'(?i)content\s*=\s*"([^"]*)"', 1), F.lit(10)).alias("day")))
    data = F.array_join(F.regexp_extract_all(x, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>.*?</script>'), F.lit(0)), " ")
    stated = lambda word, kind: F.transform(F.regexp_extract_all(data, F.lit(rf'"{word}"\s*:\s*"(\d{{4}}-\d{{2}}(?:-\d{{2}})?)'), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("day")))
    plain = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    shown = F.transform(F.regexp_extract_all(plain, F.lit(r"(?i)(?:last )?(?:updated|modified|revised)(?: on)?:? +(\d{4}-\d{2}(?:-\d{2})?)"), F.lit(1)), lambda v: F.struct(F.lit("modified").alias("kind"), v.alias("day")))
    found = pages.select(key, F.explode(F.concat(tags, stated("dateModified", "modified"), stated("datePublished", "published"), shown)).alias("e"))
    month = month_of(F.col("e.day"), F.lit(as_of).cast("date"))
    return found.select(key, F.col("e.kind").alias("kind"), month.alias("month")).filter("month is not null").distinct()

"""Registry files, indexes, award lists and pipe-delimited lists as DataFrames, whatever their vintage calls the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import relational as R

#: Registry columns and the headers that vintages give them.
REGISTRY = {
    "ein": ("EIN",), "name": ("NAME",), "street": ("STREET",), "city": ("CITY",), "state": ("STATE",), "zip": ("ZIP",), "subsection": ("SUBSECTION",), "foundation": ("FOUNDATION",), "ruling": ("RULING",),
    "ntee": ("NTEE_CD", "NTEE_CODE", "NTEE"), "asset_amt": ("ASSET_AMT",), "income_amt": ("INCOME_AMT",), "revenue_amt": ("REVENUE_AMT",),
}
#: Foundation codes of private foundations, and what an index calls the two forms.
FOUNDATION_CODES = ("02", "03", "04")
FORMS = {"990PF": "990PF", "990": "990"}


class LayoutError(ValueError):
    """A file does not look as it must; nothing of it is loaded."""


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01: The columns by their own names, from the first header that is there; a missing one is null, a missing required one an error."""
    have = {c.upper().strip(): c for c in df.columns}
    found = {k: next((have[a.upper()] for a in names if a.upper() in have), None) for k, names in aliases.items()}
    if missing := [k for k in required if found[k] is None]:
        raise LayoutError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)


def registry(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """SRC-01: Organisations of a registry file: private foundations, or with ``every`` all, the others as public charities."""
    r = aliased(csv(spark, path), REGISTRY, ("ein", "name", "foundation"))
    code = F.lpad("foundation", 2, "0")
    out = r.select(
        T.ein(F.col("ein")).alias("ein"), "name", T.norm_name(F.col("name")).alias("name_normalized"), F.when(code.isin(*FOUNDATION_CODES), "private_foundation").otherwise("public_charity").alias("org_type"), "city", T.state_code(F.col("state")).alias("state"), "zip",
        N.ruling_date(F.col("ruling")).alias("ruling_date"), "ntee", T.amount(F.col("asset_amt")).alias("assets"), T.amount(F.col("income_amt")).alias("income"), T.amount(F.col("revenue_amt")).alias("revenue"),
    ).filter("ein is not null and name is not null")
    return out if every else out.filter("org_type = 'private_foundation'")


def index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: The spine of an index file: one row for each return's id, of the two forms that are read."""
    names = {c: (c.upper(),) for c in ("object_id", "ein", "return_type", "tax_period", "taxpayer_name", "dln", "sub_date", "xml_batch_id")}
    r = aliased(csv(spark, path), names, ("object_id", "ein"))
    form = F.regexp_replace(F.upper("return_type"), "[^0-9A-Z]", "")
    out = r.withColumns({"return_type": F.when(form.isin(*FORMS), form), "ein": T.ein(F.col("ein"))}).filter("return_type is not null and ein is not null and object_id is not null")
    return R.latest_per_key(out, ["object_id"], F.desc_nulls_last("sub_date"), F.desc_nulls_last("dln"))


def awards(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11, HSH-01: Awards with a key over what tells one from another; equal rows are one award."""
    names = {"company": ("COMPANY", "COMPANY NAME"), "agency": ("AGENCY",), "title": ("AWARD TITLE", "TITLE"), "contract": ("CONTRACT", "AGENCY TRACKING NUMBER"), "year": ("AWARD YEAR", "YEAR"), "amount": ("AWARD AMOUNT", "AMOUNT")}
    a = aliased(csv(spark, path), names, ("company",))
    key = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("agency", "contract", "company", "title", "year", "amount")]).cast("binary"), 256)
    return a.select(F.concat(F.lit("award:"), key).alias("record_key"), "company", "agency", "title", F.col("year").try_cast("int").alias("year"), T.amount(F.col("amount")).alias("amount")).dropDuplicates(["record_key"])


def _pipe(spark: SparkSession, path: str, fields: int, check) -> tuple[DataFrame, DataFrame]:
    """(lines cut at pipes, counts by what a line is); the first three data lines must pass ``check``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    f = F.split("line", r"\|")
    cut = lines.select(f.alias("f"), F.when(F.trim("line") == "", "blank").when(~F.trim(F.get(f, F.lit(0))).rlike("^[0-9]+$"), "not_data").when(F.size(f) != fields, "bad_fields").otherwise("data").alias("kind"))
    head = cut.filter(F.col("kind").isin("data", "bad_fields")).limit(3).collect()  # three lines
    if not head:
        raise LayoutError(f"{path}: no data line")
    for n, r in enumerate(head, 1):
        if r.kind != "data" or len(r.f[0].strip()) != 9 or not check(r.f):
            raise LayoutError(f"{path}: data line {n} is not laid out as expected")
    return cut.filter("kind = 'data'").select("f"), cut.groupBy(F.col("kind").alias("reason")).agg(F.count("*").alias("n")).filter("reason <> 'data'")


def _rejected(rows: DataFrame, reason) -> DataFrame:
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).filter("reason is not null")


def revocations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-12: (ein, revocation, name, kind, posting and reinstatement dates of loadable rows; lines left out, by reason)."""
    import re

    rows, out = _pipe(spark, path, 12, lambda f: re.fullmatch(r"\d{1,2}-[A-Za-z]{3}-\d{4}", f[9].strip()))
    at = lambda i: F.trim(F.get("f", F.lit(i)))
    r = rows.select(at(0).alias("ein"), N.irs_date(at(9)).alias("revocation_date"), F.nullif(at(1), F.lit("")).alias("legal_name"), F.nullif(at(8), F.lit("")).alias("exemption_type"), N.irs_date(at(10)).alias("posting_date"), N.irs_date(at(11)).alias("reinstatement_date"))
    reason = F.when(F.length("ein") != 9, "bad_ein").when(F.col("revocation_date").isNull(), "no_revocation_date")
    good = r.filter(reason.isNull())
    one = R.latest_per_key(good, ["ein", "revocation_date"], F.desc_nulls_last("posting_date"), F.desc_nulls_last("reinstatement_date"), F.asc("legal_name"))
    twice = good.groupBy("ein", "revocation_date").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("reason"), "n").filter("n > 0")
    odd = good.agg(F.count_if(F.col("reinstatement_date") < F.col("revocation_date")).alias("n")).select(F.lit("reinstated_before_revoked").alias("reason"), "n").filter("n > 0")
    return one, out.unionByName(_rejected(r, reason)).unionByName(twice).unionByName(odd)


def deductible(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-12: (ein and its codes of loadable rows; lines left out, by reason)."""
    rows, out = _pipe(spark, path, 6, lambda f: f[5].strip())
    codes = F.filter(F.transform(F.split(F.get("f", F.lit(5)), ","), lambda c: F.upper(F.trim(c))), lambda c: c != "")
    r = rows.select(F.trim(F.get("f", F.lit(0))).alias("ein"), codes.alias("codes"))
    reason = F.when(F.length("ein") != 9, "bad_ein").when(F.size("codes") == 0, "no_codes")
    good = r.filter(reason.isNull())
    one = good.groupBy("ein").agg(F.min("codes").alias("codes"), F.count("*").alias("_n"))
    twice = one.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("reason"), "n").filter("n > 0")
    return one.drop("_n"), out.unionByName(_rejected(r, reason)).unionByName(twice)


def firms(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: Advisers of a firm file, the first record of each number."""
    df = spark.read.format("xml").option("rowTag", "Firm").schema("Info struct<_FirmCrdNb:string,_BusNm:string>, MainAddr struct<_State:string>, FormInfo struct<Part1A:struct<Item5F:struct<_Q5F2C:string>>>").load(path)
    f = df.select(T.crd(F.col("Info._FirmCrdNb")).alias("crd"), F.col("Info._BusNm").alias("name"), T.state_code(F.col("MainAddr._State")).alias("state"), T.amount(F.col("FormInfo.Part1A.Item5F._Q5F2C")).alias("aum")).filter("crd is not null")
    return R.latest_per_key(f, ["crd"], F.asc("name"), F.desc_nulls_last("aum"))


def latest_filing_rows(base: DataFrame, detail: DataFrame, key: str = "crd", filing: str = "filing_id", day: str = "filed_on") -> DataFrame:
    """SRC-09: Detail rows of each key's latest filing: the winners are found on the slim table first, then the details are read against them."""
    win = R.latest_per_key(base.select(key, filing, day), [key], F.desc(day), F.desc(filing)).select(key, filing)
    return detail.join(win, filing, "left_semi" if key in detail.columns else "inner")


def offerings(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10, DRV-07: Offerings of a quarter: submissions, issuers and terms by their accession number; an amendment takes its predecessor's place."""
    read = lambda n: csv(spark, f"{folder}/{n}.tsv", "\t")
    s, i, o = read("FORMDSUBMISSION"), read("ISSUERS"), read("OFFERING")
    j = s.join(i.filter("upper(IS_PRIMARYISSUER_FLAG) = 'YES'"), "ACCESSIONNUMBER").join(o, "ACCESSIONNUMBER", "left")
    e = j.select(F.col("ACCESSIONNUMBER").alias("accession"), T.cik(F.col("CIK")).alias("cik"), F.col("ENTITYNAME").alias("name"), T.state_code(F.col("STATEORCOUNTRY")).alias("state"), F.coalesce(F.try_to_date("FILING_DATE", "dd-MMM-yyyy"), F.try_to_date("FILING_DATE", "yyyy-MM-dd")).alias("day"), T.amount(F.col("TOTALAMOUNTSOLD")).alias("sold"), F.nullif(F.col("PREVIOUSACCESSIONNUMBER"), F.lit("")).alias("replaces"))
    gone = e.filter("replaces is not null").select(F.col("replaces").alias("accession"))
    return e.join(gone, "accession", "left_anti")


#: What headers of imported tables mean, the first that fits.
IMPORT_HEADERS = ((r"(?i)^(ein|tax\s*id|fein|employer\s*id)", "ein"), (r"(?i)^(org|organization|organisation|foundation|funder|company|name)$", "name"), (r"(?i)name", "name"), (r"(?i)^(notes?|comments?)", "notes"), (r"(?i)^(stage|status)", "stage"))


def guess_columns(headers: list[str]) -> dict[str, str]:
    """SRC-18: Field -> header for an imported table."""
    import re

    out: dict[str, str] = {}
    for pattern, fieldname in IMPORT_HEADERS:
        for h in headers:
            if fieldname not in out and h not in out.values() and re.search(pattern, h.strip()):
                out[fieldname] = h
    return out


def imported(df: DataFrame) -> DataFrame:
    """SRC-18: Rows of a user's table with a number and a name, either of which may be missing."""
    found = guess_columns(df.columns)
    c = lambda k: F.nullif(F.trim(F.col(f"`{found[k]}`")), F.lit("")) if k in found else F.lit(None).cast("string")
    ein = T.ein(c("ein"))
    return df.select(F.when(ein != "000000000", ein).alias("ein"), c("name").alias("name"), T.import_key(c("name")).alias("key"), c("notes").alias("notes")).filter("ein is not null or name is not null")


def seeds(spark: SparkSession, path: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """SRC-13: A seed table, its list columns cut at semicolons."""
    df = csv(spark, path)
    return df.select(*[F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "").alias(c) if c in lists else F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in df.columns])


def keyset_shards(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """Ranges [from, to) that a keyset read walks, one a task."""
    cut = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:]) if a < b]


def read_shards(spark: SparkSession, fetch, lo: int, hi: int, n: int, schema: str, page: int = 1000) -> DataFrame:
    """SRC-16: Rows of a paged source: ``fetch(after, to, page)`` gives rows of ascending first column; each shard is a task and starts again alone if it is lost."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for a, b in zip(f["a"], f["b"]):
                after = a - 1
                while rows := fetch(after, b, page):
                    yield pd.DataFrame(rows, columns=names)
                    after = rows[-1][0]

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    shards = spark.createDataFrame(keyset_shards(lo, hi, n) or [(0, 0)], "a long, b long").repartition(n)
    return shards.mapInPandas(run, schema)

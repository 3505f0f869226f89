"""Statistics, dates and scores as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_low(correct: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval; 0 without trials."""
    p = correct / n
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    return F.when(n > 0, (p + z * z / (2.0 * n) - margin) / (1 + z * z / n)).otherwise(F.lit(0.0))


#: Weights of the seven scores of a fit, in hundredths.
FIT_WEIGHTS = {"mission_alignment": 25, "geography": 15, "grant_size_fit": 15, "applicant_eligibility": 15, "recency": 10, "capacity": 10, "openness": 10}


def composite(scores: dict[str, Column], weights: dict[str, int] = FIT_WEIGHTS) -> Column:
    """Weighted mean of scores that are held between 0 and 100, rounded to a whole number."""
    held = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    return F.floor(sum(held(scores[k]) * w for k, w in weights.items()) / sum(weights.values()) + 0.5).cast("int")


def rating(score: Column) -> Column:
    return F.when(score >= 85, "very_high").when(score >= 70, "high").when(score >= 50, "medium").when(score >= 30, "low").otherwise("very_low")


def effective_date(revoked: Column) -> Column:
    """Revocations whose date fell into the extended filing season of 2020 took effect at its end."""
    day = lambda v: F.lit(v).cast("date")
    return F.when(revoked.between(day("2020-04-01"), day("2020-07-14")), day("2020-07-15")).otherwise(revoked)


def irs_date(x: Column) -> Column:
    """``15-NOV-2017`` as a date; anything else is null."""
    s = F.upper(F.trim(x))
    return F.when(s.rlike(r"^\d{1,2}-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-\d{4}$"), F.try_to_date(F.initcap(F.lpad(s, 11, "0")), "dd-MMM-yyyy"))


def month_of(x: Column, as_of: Column) -> Column:
    """The first of the month of YYYY-MM or YYYY-MM-DD; null for a month behind ``as_of`` or anything else."""
    first = F.when(x.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.try_to_date(F.concat(F.left(x, F.lit(7)), F.lit("-01")), "yyyy-MM-dd"))
    return F.when(first <= as_of, first)


def publication_date(x: Column) -> Column:
    """The day of a date in one of the usual notations; null rather than a guess."""
    v = F.regexp_replace(F.trim(x), r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    day = lambda c, f: F.try_to_date(c, f)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), day(F.left(v, F.lit(10)), "yyyy-MM-dd"))
    mail = F.regexp_extract(v, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4}) ", 1)
    named = [(r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$", "d MMMM yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d")]
    return F.coalesce(iso, F.when(mail != "", day(mail, "d MMM yyyy")), *[F.when(v.rlike(p), day(v, f)) for p, f in named])


def billing_end(start: Column, anchor: Column) -> Column:
    """Day on which the next period starts, for the period that starts on ``start``."""
    m = F.add_months(F.trunc(start, "month"), 1)
    return F.date_add(m, F.least(anchor, F.dayofmonth(F.last_day(m))) - 1)


def ruling_date(x: Column) -> Column:
    """YYYYMM, YYYY or YYYYMMDD; month and day 00 count as 01; null for anything else."""
    d = F.regexp_replace(x, "[^0-9]", "")
    part = lambda a, n: F.greatest(F.substring(d, a, n).try_cast("int"), F.lit(1))
    text = F.when(F.length(d) == 4, F.concat(d, F.lit("0101"))).when(F.length(d) == 6, F.concat(F.left(d, F.lit(4)), F.lpad(part(5, 2).cast("string"), 2, "0"), F.lit("01")))
    text = text.when(F.length(d) == 8, F.concat(F.left(d, F.lit(4)), F.lpad(part(5, 2).cast("string"), 2, "0"), F.lpad(part(7, 2).cast("string"), 2, "0")))
    return F.try_to_date(text, "yyyyMMdd")


def month_end(period: Column) -> Column:
    return F.when(period.rlike(r"^\d{6}$"), F.last_day(F.try_to_date(F.concat(period, F.lit("01")), "yyyyMMdd")))


def fiscal_year(period: Column) -> Column:
    return F.nullif(F.left(period, F.lit(4)), F.lit("")).try_cast("int")


def billing_start(day: Column, anchor: Column) -> Column:
    """Start of the billing period that holds a day, for an anchor day of month clamped to the month's length."""
    first = F.trunc(day, "month")
    clamp = lambda m: F.date_add(m, F.least(anchor, F.dayofmonth(F.last_day(m))) - 1)
    return F.when(clamp(first) <= day, clamp(first)).otherwise(clamp(F.add_months(first, -1)))


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    return sum((F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

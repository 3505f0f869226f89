"""SQL functions for the guarded surface: the name and contact rules, trigram likeness, and names that other dialects use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ENTITY_WORDS, FILLER_LOCALS, PLACEHOLDERS, RESTRICTIVE, ROLE_LOCALS


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words) -> str:
    return "array(" + ", ".join(_q(w) for w in words) + ")"


_FLAT = r"regexp_replace(regexp_replace(split_part(lower(trim(a)), '@', 1), '\\+.*$', ''), '[._-]', '')"
_VALID = r"lower(trim(a)) rlike '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$'"
_GRAMS = "array_distinct(flatten(transform(filter(split(regexp_replace(lower({0}), '[^a-z0-9]+', ' '), ' '), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substr('  ' || w || ' ', i, 3)))))"

#: Name -> (parameters, result type, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "norm_name": ("x STRING", "STRING", r"trim(regexp_replace(regexp_replace(upper(x), '(?U)[^\\w\\s&-]', ' '), '(?U)\\s+', ' '))"),
    "is_placeholder_recipient": ("x STRING", "BOOLEAN", f"x IS NULL OR length(x) < 4 OR x rlike {_q('^(' + '|'.join(PLACEHOLDERS) + ')')}"),
    "is_entity_name": ("x STRING", "BOOLEAN", "x rlike " + _q(r"\b(" + "|".join(ENTITY_WORDS) + r")\b")),
    "email_local_flat": ("a STRING", "STRING", f"CASE WHEN {_VALID} THEN {_FLAT} END"),
    "is_role_based_email": (
        "a STRING, contact STRING", "BOOLEAN",
        f"CASE WHEN NOT coalesce({_VALID}, false) THEN false WHEN array_contains({_list(FILLER_LOCALS)}, {_FLAT}) THEN false "
        + r"WHEN exists(split(regexp_replace(lower(coalesce(contact, '')), '[^a-z ]', ' '), '\\s+'), t -> length(t) >= 4 AND contains(" + _FLAT + ", t)) THEN false "
        + r"WHEN regexp_replace(split_part(lower(trim(a)), '@', 1), '\\+.*$', '') IN ('mail', 'email') THEN true "
        + r"ELSE exists(split(regexp_replace(split_part(lower(trim(a)), '@', 1), '\\+.*$', ''), '[._-]'), t -> array_contains(" + _list(ROLE_LOCALS) + ", t)) "
        + f"OR {_FLAT} rlike '^(grants|foundation|scholarship|application|inquir|enquir|philanthrop|frontdesk)' END",
    ),
    "nanp_e164": ("x STRING", "STRING", "CASE WHEN regexp_replace(x, '[^0-9]', '') rlike '^[2-9][0-9]{2}[2-9][0-9]{6}$' THEN '+1' || regexp_replace(x, '[^0-9]', '') END"),
    "restrictive_phrase": ("x STRING", "STRING", f"nullif(lower(regexp_replace(regexp_extract(x, {_q(RESTRICTIVE)}, 1), '\\\\s+', ' ')), '')"),
    "show_trgm": ("x STRING", "ARRAY<STRING>", _GRAMS.format("x")),
    "similarity": ("x STRING, y STRING", "DOUBLE", f"coalesce(try_divide(size(array_intersect({_GRAMS.format('x')}, {_GRAMS.format('y')})), size(array_union({_GRAMS.format('x')}, {_GRAMS.format('y')}))), 0.0D)"),
    "strpos": ("x STRING, y STRING", "INT", "instr(x, y)"),
    "starts_with": ("x STRING, y STRING", "BOOLEAN", "startswith(x, y)"),
    "string_to_array": ("x STRING, y STRING", "ARRAY<STRING>", r"split(x, '\\Q' || y || '\\E')"),
    "array_to_string": ("x ARRAY<STRING>, y STRING", "STRING", "array_join(x, y)"),
    "array_length": ("x ARRAY<STRING>, y INT", "INT", "CASE WHEN y = 1 AND size(x) > 0 THEN size(x) END"),
    "array_cat": ("x ARRAY<STRING>, y ARRAY<STRING>", "ARRAY<STRING>", "concat(x, y)"),
    "array_replace": ("x ARRAY<STRING>, a STRING, b STRING", "ARRAY<STRING>", "transform(x, v -> CASE WHEN v <=> a THEN b ELSE v END)"),
    "array_positions": ("x ARRAY<STRING>, a STRING", "ARRAY<INT>", "transform(filter(sequence(1, size(x)), i -> x[i - 1] <=> a), i -> i)"),
    "regexp_match": ("x STRING, p STRING", "ARRAY<STRING>", "CASE WHEN x rlike p THEN array(regexp_extract(x, p, 0)) END"),
    "regexp_split_to_array": ("x STRING, p STRING", "ARRAY<STRING>", "split(x, p)"),
    "jsonb_array_length": ("x STRING", "INT", "json_array_length(x)"),
    "jsonb_extract_path_text": ("x STRING, k STRING", "STRING", "get_json_object(x, '$.' || k)"),
    "jsonb_typeof": ("x STRING", "STRING", "CASE WHEN x rlike '^\\\\s*\\\\{' THEN 'object' WHEN x rlike '^\\\\s*\\\\[' THEN 'array' WHEN x rlike '^\\\\s*\"' THEN 'string' WHEN trim(x) IN ('true', 'false') THEN 'boolean' WHEN trim(x) = 'null' THEN 'null' ELSE 'number' END"),
    "num_nulls2": ("a STRING, b STRING", "INT", "cast(a IS NULL AS INT) + cast(b IS NULL AS INT)"),
    "num_nonnulls2": ("a STRING, b STRING", "INT", "cast(a IS NOT NULL AS INT) + cast(b IS NOT NULL AS INT)"),
    "date_bin_days": ("n INT, d DATE, origin DATE", "DATE", "date_add(origin, cast(floor(datediff(d, origin) / n) AS INT) * n)"),
    "age_days": ("a DATE, b DATE", "INT", "datediff(a, b)"),
    "isfinite": ("d DATE", "BOOLEAN", "d IS NOT NULL"),
    "log_ten": ("x DOUBLE", "DOUBLE", "log10(x)"),
}


def register(spark: SparkSession) -> list[str]:
    """UDF-01, SQL-FN: Makes the functions of this session; they are expressions, so the optimiser sees through them."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)


def register_aggregate(spark: SparkSession, name: str, fold, kind: str) -> None:
    """UDF-04: A grouped aggregate of one's own: ``fold`` takes a pandas series and gives a value; Arrow-batched by group."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(x: pd.Series) -> object:
        return fold(x)

    run.__annotations__ = {"x": pd.Series, "return": float if kind in ("double", "float") else int if kind in ("long", "int", "bigint") else str}
    spark.udf.register(name, pandas_udf(run, kind))

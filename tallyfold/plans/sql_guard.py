"""A read-only SQL surface: one query, known plan nodes, known relations, known functions, a row cap, a time limit."""

from __future__ import annotations

import datetime
import decimal
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ROW_CAP = 500
SECONDS = 15.0
#: Functions that a statement may call.
FUNCTIONS = frozenset(
    """count sum avg mean min max stddev stddev_pop stddev_samp variance var_pop var_samp bool_and bool_or every some any_value array_agg collect_list collect_set string_agg listagg
    percentile percentile_cont percentile_disc percentile_approx median mode corr covar_pop covar_samp count_if first last grouping grouping_id
    row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value
    abs ceil ceiling floor round bround trunc sign signum sqrt cbrt power pow exp ln log log10 log2 mod div pi rand width_bucket greatest least try_divide try_cast
    lower upper initcap length char_length character_length octet_length substring substr left right trim ltrim rtrim btrim lpad rpad replace regexp_replace regexp_extract regexp_extract_all regexp_like rlike
    regexp_count regexp_substr regexp_instr split split_part position locate instr concat concat_ws repeat reverse translate startswith endswith contains overlay to_char to_number format_string format_number levenshtein
    similarity show_trgm word_similarity norm_name is_placeholder_recipient email_local_flat is_role_based_email nanp_e164 restrictive_phrase
    now current_timestamp current_date date_trunc date_part extract year quarter month day dayofmonth dayofweek dayofyear hour minute second make_date make_timestamp to_date to_timestamp date_add date_sub datediff
    date_diff months_between add_months last_day date_format trunc
    coalesce nullif nvl ifnull if iff isnull isnotnull equal_null cast struct named_struct array map
    size cardinality array_join array_position array_remove array_append array_prepend array_contains array_distinct array_sort sort_array slice element_at explode posexplode sequence flatten arrays_overlap
    array_intersect array_union array_except array_max array_min transform filter exists forall aggregate
    to_json from_json get_json_object json_array_length json_object_keys md5 sha2""".split()
)
#: Plan nodes of a query; whatever else a statement parses to is refused.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit LimitAll Offset Distinct Union Intersect Except Join SubqueryAlias OneRowRelation UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable
    WithWindowDefinition UnresolvedSubqueryColumnAliases UnresolvedOrdinal Pivot Unpivot Generate LateralJoin LocalRelation""".split()
)


class Refused(ValueError):
    pass


@dataclass
class Guard:
    """What a statement may read and call."""

    relations: frozenset[str]
    functions: frozenset[str] = FUNCTIONS
    row_cap: int = ROW_CAP
    seen: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.functions is None:
            raise ValueError("a guard needs the functions that it lets through")

    def check(self, spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
        """SQL-01..04: (relations, functions) of a statement that passes; raises :class:`Refused` otherwise.

        Spark's own parser reads the text, so strings, comments and quoting
        need no rules of ours; the unresolved plan is then walked.
        """
        if not sql or not sql.strip():
            raise Refused("no statement")
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            raise Refused(f"not one parsable statement: {str(e).splitlines()[0]}") from None
        rel, fun, ctes, nodes = set(), set(), set(), []
        self._walk(plan, rel, fun, ctes, nodes)
        if bad := [n for n in nodes if n not in NODES]:
            raise Refused(f"only queries are allowed: {bad[0]}")
        rel -= ctes
        if unknown := sorted(rel - self.relations):
            raise Refused(f"unknown relation: {unknown[0]}")
        if unknown := sorted(fun - self.functions):
            raise Refused(f"function not allowed: {unknown[0]}")
        return rel, fun

    def _walk(self, node, rel: set, fun: set, ctes: set, nodes: list) -> None:
        name = node.getClass().getSimpleName()
        nodes.append(name)
        if name == "UnresolvedRelation":
            rel.add(node.name().lower().replace("`", ""))
        elif name == "UnresolvedWith":
            pairs = node.cteRelations()
            for i in range(pairs.size()):
                pair = pairs.apply(i)
                ctes.add(pair.productElement(0).lower())
                self._walk(pair.productElement(1), rel, fun, ctes, nodes)
        elif name == "UnresolvedTableValuedFunction":
            fun.add(str(node.name().last()).lower())
        for kind in ("expressions", "children"):
            items = getattr(node, kind)()
            for i in range(items.size()):
                child = items.apply(i)
                (self._expr if kind == "expressions" else self._walk)(child, rel, fun, ctes, nodes)

    def _expr(self, e, rel: set, fun: set, ctes: set, nodes: list) -> None:
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction":
            fun.add(str(e.nameParts().last()).lower())
        if name == "UnresolvedGenerator":
            fun.add(str(e.name().funcName()).lower())
        if name in ("UnresolvedTableValuedFunction", "ScriptTransformation", "CallMethodViaReflection"):
            raise Refused(f"not allowed: {name}")
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self._walk(e.plan(), rel, fun, ctes, nodes)
        kids = e.children()
        for i in range(kids.size()):
            self._expr(kids.apply(i), rel, fun, ctes, nodes)

    def run(self, spark: SparkSession, sql: str) -> DataFrame:
        self.check(spark, sql)
        return spark.sql(sql).limit(self.row_cap)

    def rows(self, spark: SparkSession, sql: str, seconds: float = SECONDS) -> list:
        """SQL-05, SRT-07: The statement's rows, at most ``row_cap``; its jobs are cancelled after ``seconds``."""
        df = self.run(spark, sql)
        sc, group, late = spark.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

        def stop():
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        sc.setJobGroup(group, "guarded query", True)
        timer.start()
        try:
            return df.collect()
        except Exception:
            if late.is_set():
                raise Refused(f"the query took longer than {seconds:g} seconds") from None
            raise
        finally:
            timer.cancel()
            sc._jsc.clearJobGroup()


def plain(value):
    """SQL-06: A result's value as JSON can hold it."""
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def text_table(columns: list[str], rows: list, most: int = 60) -> str:
    """SQL-06: The first rows as lines of cells, and how many there are in all."""
    cell = lambda v: "" if v is None else str(plain(v)).replace("|", "/").replace("\n", " ")
    lines = [" | ".join(columns), *[" | ".join(map(cell, r)) for r in rows[:most]]]
    return "\n".join([*lines, f"({len(rows)} rows)" if len(rows) <= most else f"(first {most} of {len(rows)} rows)"])

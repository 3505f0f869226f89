"""What the SQL surface lets through, and what it refuses."""

import pytest

from tallyfold.plans.sql_guard import Guard, Refused, plain, text_table

GUARD = Guard(frozenset({"organizations", "funding_events", "public.organizations", "internal.mv_latest"}))


@pytest.mark.parametrize("sql", [
    "select 1", "WITH x AS (SELECT 1 AS n) SELECT n FROM x", "select 'insert into x; drop table y' as text_only", "select * from public.organizations", "select * from organizations limit 1", "select * from internal.mv_latest",
    "select count(*), sum(amount) from funding_events group by org_id having count(*) > 1", "select * from organizations o join funding_events e on o.id = e.org_id", "select org_id, row_number() over (partition by org_id order by amount) from funding_events",
    "select * from organizations where id in (select org_id from funding_events)", "select a from organizations union select b from funding_events", "select case when a is null then 0 else 1 end from organizations", "select explode(array(1, 2))",
    "select cast(a as decimal(12, 2)) from organizations", "select a from organizations order by a desc nulls last limit 5 offset 5", "select a, b, count(*) from organizations group by rollup (a, b)", "select * from values (1), (2) as t(a)",
])
def test_accepts(spark, sql):
    GUARD.check(spark, sql)


@pytest.mark.parametrize("sql", [
    "", "   ", "explain select 1", "update organizations set name = 'x'", "table secrets", "select 1; drop table x", "drop table organizations", "insert into organizations values (1)", "select * from contact_channels",
    "select * from organizations o, contact_channels c", "select * from organizations o join raw_files r on true", "select * from organizations o cross join org_web_facts w", "select * from organizations where id in (select org_id from contact_channels)",
    "select (select count(*) from filing_application_info)", "with c as (select * from contact_channels) select * from c", "select * from ((contact_channels))", "select * from parquet.`/etc/passwd`", "select * from mv_latest", "select * from information_schema.tables",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM organizations", "FROM organizations SELECT TRANSFORM(id) USING 'sh -c id' AS (x)", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select java_method('java.lang.System', 'exit', 0)",
    "select * from range(10)", "select input_file_name() from organizations", "select secret('a')", "select * from organizations tablesample (10 percent)", "select exists(select 1 from secrets)", "select * from organizations lateral view java_method('a', 'b') t as x",
    "create table x as select 1", "cache table organizations", "set a = b", "describe organizations", "show tables", "select version()", "select current_user()", "select session_user()", "select load_file('/etc/passwd')", "merge into organizations using x on a = b when matched then delete",
    "select try_reflect('java.lang.System', 'getenv', 'PATH')", "select /*+ REPARTITION(100000) */ * from organizations",
])
def test_refuses(spark, sql):
    with pytest.raises(Refused):
        GUARD.check(spark, sql)


def test_functions_are_never_left_out():
    with pytest.raises(ValueError):
        Guard(frozenset(), None)


def test_rows_and_time(spark):
    spark.range(2000).createOrReplaceTempView("plenty")
    g = Guard(frozenset({"plenty"}))
    assert len(g.rows(spark, "select id from plenty order by id")) == 500
    spark.range(40_000_000).createOrReplaceTempView("plenty")
    with pytest.raises(Refused):
        g.rows(spark, "select count(*) from plenty a join plenty b on a.id % 1000 = b.id % 1000 and a.id <> b.id", seconds=1.0)


def test_text_table():
    import datetime
    import decimal

    rows = [(1, None, "a|b\nc"), (2, decimal.Decimal("3.50"), datetime.date(2024, 1, 2))]
    assert text_table(["x", "y", "z"], rows) == "x | y | z\n1 |  | a/b c\n2 | 3.5 | 2024-01-02\n(2 rows)"
    assert text_table(["x"], [(i,) for i in range(70)]).endswith("(first 60 of 70 rows)")
    assert plain([decimal.Decimal("2.00"), (1,)]) == [2, [1]]

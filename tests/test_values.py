"""An oracle that returns nothing, or one value in a column, proves nothing: none may, but where one value is the point."""

import pytest

from tallyfold.plans import catalog

SF = "/root/testdata/sf0.01"

#: Columns that hold one value on these tables for the reason given.
ONE_VALUE = {
    "view_irs_revocations": {"source_dataset", "source_url", "license_code", "license_name"},  # one file
    "view_irs_pub78": {"source_dataset", "source_url", "license_code", "license_name"},  # one file
    "view_filing_contributors": {"city"},  # a withheld street's city, the same in the stand-in
    "dq_export_boundary": {"bad"}, "dq_invariants": {"bad"},  # zero on sound tables
    "srt_pool_page": {"total"},  # the pool's size beside each row
    "hyb_topic_pool": {"n_grantees"},  # every document lists four
    "fts_cover_rank": {"covers", "rank"},  # the two words always stand together, once
    "mart_funder_event_stats": {"first_fy", "last_fy"}, "mart_grant_profile": {"n_years"},  # all give in all years
    "jn_token_index": {"shared"}, "fn_arrays": {"n"},  # names have two words
    "agg_conditional": {"any_large", "all_large"},  # true of any large table
    "srt_precedence_top": {"o_orderpriority"},  # the first in the order fill the report
    "er_alias_consensus": {"status"},  # every segment has many organisations
    "turnover_summary": {"n", "none", "three", "with_unnamed", "unsealed"}, "turnover_report": {"pct_none", "pct_three"},  # random recipients are mostly new
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from .test_queries import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle_tells_something(duck, name):
    cur = duck.execute(catalog.oracle_sql()[name])
    rows, names = cur.fetchall(), [c[0] for c in cur.description]
    assert rows
    if len(rows) == 1:
        assert None not in rows[0]
        return
    single = {n for i, n in enumerate(names) if len({str(r[i]) for r in rows}) == 1}
    assert single <= ONE_VALUE.get(name, set()), single

"""Recipient turnover: no funder is set aside, and names meet alike whether once for all funders or within each."""

import random

import pytest

from tallyfold.plans import catalog, turnover

SF = "/root/testdata/sf0.001"


def test_no_limit_sets_a_funder_aside(spark, monkeypatch):
    # whatever limit it has by default is nought here: it once dropped funders that needed more comparisons
    monkeypatch.setattr(turnover.final, "__defaults__", tuple(0 for _ in turnover.final.__defaults__ or ()))
    got = {(r.f, r.fy): r.n_seen_similar for r in turnover.final(spark, SF).collect()}
    want = {(r.f, r.fy) for r in catalog.queries()["turnover_targets"](spark, SF).filter("left_out is null").collect()}
    assert want and set(got) == want and any(got.values())


def grams(x):
    words = ["  " + w + " " for w in "".join(c if c.isalnum() else " " for c in x.lower()).split()]
    return {w[i : i + 3] for w in words for i in range(len(w) - 2)}


@pytest.mark.parametrize("once", [True, False, None])
def test_names_alike_within_a_funder(spark, once):
    rnd = random.Random(4)
    words = ["NORTH", "RIVER", "SCHOOL", "SCHOOLS", "CLINIC", "ARTS", "ART", "FOOD", "BANK"]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    cand = [(f, 2000, name(), "x") for f in range(6) for _ in range(25)] + [(0, 2000, "&", "x"), (9, 2000, "NO LIST", "x")]
    prior = [(f, y, name(), "x", 1) for f in range(7) for y in (1998, 1999) for _ in range(20)] + [(0, 1999, "&", "x", 1)]
    a = spark.createDataFrame(cand, "f long, fy int, cn string, sq string")
    b = spark.createDataFrame(prior, "f long, p_fy int, cn string, sq string, rorg long")
    got = [(r.f, r.cn, r.pcn) for r in turnover.alike(a, b, once).collect()]
    share = lambda x, y: 5 * len(x & y) >= 4 * len(x | y) and x & y
    want = {(f, cn, pcn) for f, _, cn, _ in cand for g, _, pcn, _, _ in prior if f == g and share(grams(cn), grams(pcn))}
    assert sorted(got) == sorted(want) and any(c != p for _, c, p in want)


def test_last_plan_only_meets_written_tables(spark):
    plan = turnover.final(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Aggregate" not in plan and "Window" not in plan

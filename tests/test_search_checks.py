"""What searches must hold: filters respected, the named thing first, nothing for nonsense; and one known profile."""

from pyspark.sql import functions as F

from tallyfold.operators import search as S
from tallyfold.plans import catalog, finding
from tallyfold.sources.standin import rel
from tallyfold.sources.tables import table

SF = "/root/testdata/sf0.001"
Q = catalog.queries()


def test_filters_are_respected(spark):
    kept = {r.vec_id for r in table(spark, SF, "embeddings").filter("label <> 0").collect()}
    assert {r.vec_id for r in Q["vec_topk"](spark, SF).collect()} <= kept
    aliases = {r.org_id for r in rel(spark, SF, "organizations").filter("canonical_id is not null").collect()}
    pool = Q["hyb_topic_pool"](spark, SF).collect()
    assert pool and not {r.org_id for r in pool} & aliases and len(pool) <= 40


def test_neighbours(spark):
    by = {}
    for r in Q["similar_items"](spark, SF).collect():
        by.setdefault(r.seed, []).append((r.vec_id, r.sim))
    sizes = {r.label: r.n for r in table(spark, SF, "embeddings").groupBy("label").agg(F.count("*").alias("n")).collect()}
    label = {r.vec_id: r.label for r in table(spark, SF, "embeddings").collect()}
    for seed, found in by.items():
        assert len(found) == min(12, sizes[label[seed]] - 1) and seed not in dict(found) and all(-1 < s < 1 for _, s in found)


def test_a_name_finds_itself(spark):
    orgs = rel(spark, SF, "organizations").filter("org_id < 1000000").orderBy("org_id").limit(3).collect()
    for o in orgs:
        top = finding.name_pool(spark, SF, o.name).orderBy(F.desc("rank"), "org_id").first()
        same = {r.org_id for r in rel(spark, SF, "organizations").filter(F.col("name") == o.name).collect()}
        assert top.org_id in same


def test_negative_control(spark):
    docs = table(spark, SF, "documents")
    assert docs.filter(S.WebQuery.parse("zzqqxx").matches(F.col("text"))).count() == 0
    assert S.keyword_leg(docs, "doc_id", "text", "zzqqxx", 10).count() == 0
    assert finding.name_pool(spark, SF, "Zzqqxx Nobody").count() == 0


def test_words_that_stand_apart_rank_lower(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, "red and so on ring"), (3, "red red"), (4, "ring x red ring")], "k int, t string")
    got = {r.k: (r.covers, r.rank) for r in S.cover_rank(df, "k", "t", ["red", "ring"]).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.4), 4: (2, round(2 / 3 + 1, 8))}


def test_known_profile(spark):
    (r,) = Q["ws_funder_header"](spark, SF).filter("org_id = 6").collect()
    base = rel(spark, SF, "organizations").filter("org_id = 6").first()
    filings = [f for f in rel(spark, SF, "filings").filter("org_id = 6").collect()]
    winners = {}
    for f in filings:
        winners[f.tax_period] = max(winners.get(f.tax_period, ""), f.object_id)
    live = [f for f in filings if winners[f.tax_period] == f.object_id and f.parsed]
    newest = max(live, key=lambda f: (f.tax_period, f.object_id))
    assert (r.name, r.year, r.assets) == (base.name, newest.fy, 6 * 7919 % 50000 * 1000 + newest.fy)
    assert r.ein == f"{6 * 37:09d}" and r.canonical_name is None


def test_empty_tables(spark):
    e = table(spark, SF, "embeddings").limit(0)
    assert S.seed_vector(e, "vec_id", 3) == [] and S.vector_leg(e, "vec_id", "embedding", [], 5).count() == 0

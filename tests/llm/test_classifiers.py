"""Language ID, quality score and toxicity: held-out accuracy on documents that no learning saw, and odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import language_id, quality_classifier, toxicity

SF = "/root/testdata/sf0.1"  # sf0.01 has six held-out toxic rows: too few to measure on
OPS = {"quality": quality_classifier, "toxic": toxicity}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(pairs):
    """Share of (1, 0) pairs that the scores put in order; ties count half."""
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language_held_out(tables):
    docs, _ = tables
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.query(docs).collect()]
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(judged) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.95 * len(judged)


@pytest.mark.parametrize("column, least", [("quality", 0.9), ("toxic", 0.9)])
def test_scores_held_out(tables, column, least):
    docs, labels = tables
    truth = {r.doc_id: r[column] for r in labels.collect()}
    got = OPS[column].query(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= OPS[column].THRESHOLD) for r in got)
    assert auc([(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]) >= least


@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_scores_ignore_labels_of_the_held_out_fold(tables, column):
    docs, labels = tables
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    turned = labels.withColumn(column, F.when(fold == 0, 1 - F.col(column)).otherwise(F.col(column)))
    one, two = ({r.doc_id: r.score for r in OPS[column].query(docs, x).collect()} for x in (labels, turned))
    assert one == two


def odd_rows(spark):
    texts = ["plain words of a text " * 5, None, "", " \n\t", "12 34 ?!", "é ü 漢字", "plain words of a text " * 5, "long " * 200_000]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, "no id at all", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "held_out": F.lit(1), "y": F.lit(0)})


def test_odd_rows(spark, tables):
    df, (docs, labels) = odd_rows(spark), tables
    models = {"quality": quality_classifier.learn(docs, labels), "toxic": toxicity.learn(docs, labels)}
    scored = {"quality": quality_classifier.quality_score(df, models["quality"]), "toxic": toxicity.toxicity(df, models["toxic"])}
    for column, out in scored.items():
        got = out.collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got), column
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert by[0] == by[6] and by[1] == by[2] and len(by[0]) == 1  # repeated texts and empty ones score alike
        assert [r.held_out for r in got if r.doc_id is None] == [None]
    found = language_id.language_id(df, language_id.learn(docs)).collect()
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3, 4} and len(found) == 10
    assert all(r.score == 0 for r in found if r.lang_pred == "und")


def test_empty_tables_and_nothing_to_learn(spark, tables):
    docs, labels = tables
    for op in OPS.values():
        assert op.query(docs.limit(0), labels.limit(0)).collect() == []
        assert len({r.score for r in op.query(docs.limit(20), labels.limit(0)).collect()}) == 1
    assert language_id.query(docs.limit(0)).collect() == []
    untold = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.query(untold).collect()} == {"und"}
    single = language_id.query(docs.limit(20).withColumn("lang", F.lit("xx"))).collect()
    assert {r.lang_pred for r in single} <= {"xx", "und"}


def test_codewords():
    for n in (2, 3, 4, 7, 12, 40):
        m = language_id.code_matrix(n)
        assert len({tuple(r) for r in m}) == n and (abs(m.sum(axis=0)) < n).all()

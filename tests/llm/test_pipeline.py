"""Every stage against brute force on its own input, then odd rows through all of them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import decontaminate as dc
from tallyfold.llm.common import Scratch

from .test_decontaminate import edit
from .test_native import stats
from .test_simhash import brute as groups
from .test_substring import as_bytes

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    scratch, out = Scratch(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = scratch.save(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, good, one, cut, clean, packed = stages(spark, docs)
    for df in (good, one, cut, clean):
        assert df.schema.simpleString() == docs.schema.simpleString()
    first, good, one, cut, clean = map(rows, (first, good, one, cut, clean))
    failed = {d for d, r in first.items() if stats(r.text)[5]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert failed and not failed & set(good) and all(good[d].text == first[d].text for d in good)
    fine = [d for d in first if d not in failed and labels.get(d) == 1]
    assert sum(d in good for d in fine) >= 0.95 * len(fine)
    assert set(one) == {c for _, _, c in groups([(d, r.text) for d, r in good.items()])}
    want = {d: (n, gone) for d, n, gone, *_ in as_bytes([(d, r.text) for d, r in one.items()])}
    assert all(len(cut[d].text.encode()) <= want[d][0] - want[d][1] for d in cut) and {d for d, (n, gone) in want.items() if gone < n} >= set(cut)
    assert all(cut[d].text == one[d].text for d in cut if not want[d][1]) and all(r.n_chars == len(r.text) for r in cut.values())
    items = [dc.fold_text(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d, r in cut.items() if any(i in dc.fold_text(r.text) for i in items)}
    gone = set(cut) - set(clean)
    assert exact <= gone and all(any(edit(i, dc.fold_text(cut[d].text)) <= dc.budget(len(i)) for i in items) for d in gone)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(clean)
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rnd = random.Random(6)
    long = " ".join(f"w{rnd.randint(0, 10**5)}" for _ in range(30_000))
    texts = [(i, " ".join(f"v{rnd.randint(0, 10**4)}" for _ in range(60))) for i in range(10)]
    data = [*texts, (3, texts[3][1]), (20, texts[4][1]), (30, None), (31, ""), (32, " \n"), (33, long), (None, long + " end"), (None, texts[5][1] + " more words"), (None, "é " + " ".join(f"u{i}" for i in range(40)))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "carry": F.lit(1), "n_words": F.lit(2.5), "_in": F.lit("x")})
    out = stages(spark, df.limit(0) if empty else df)
    assert all(x.columns == df.columns for x in out[:-1])
    if not empty:
        left = [r.doc_id for r in out[-2].select("doc_id").collect()]
        assert {0, 1, 2, 3, 4, 5} <= set(left) and not {20, 30, 31, 32} & set(left)

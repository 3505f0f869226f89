"""Packing: ids against the public tokenizer, placement against its rules and a plain best fit."""

import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import packing
from tallyfold.llm.common import tokenizer_file

SF = "/root/testdata/sf0.01"


def brute_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(brute_ids, "t"):
        brute_ids.t = Tokenizer.from_file(tokenizer_file(packing.VOCABULARY))
        brute_ids.t.encode_special_tokens = True
    return brute_ids.t.encode(text or "", add_special_tokens=False).ids + [0]


def want(rows, capacity):
    out = []
    for doc, text in rows:
        ids = brute_ids(text)
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((doc, k, s, len(part), zlib.crc32(array("I", part).tobytes())))
    return sorted(out, key=str)


def best_fit_decreasing(lengths, capacity):
    """Sequences that a plain best fit uses."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def check(df, capacity):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = packing.best_fit_packing(df, capacity).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == want(rows, capacity)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == best_fit_decreasing([r.length for r in got], capacity)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_table(spark, capacity):
    check(spark.read.parquet(f"{SF}/documents.parquet"), capacity)


def test_odd_rows(spark):
    rnd = random.Random(5)
    alphabet = "abcXYZ019 .,'-_#\n\tÉéßİıſ…“漢字́​\x00\x7f <|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts += [None, "", " \n", "<|endoftext|> we'll they're it's", "word " * 30_000, "x" * 5000, "same text", "same text"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("clash"), "piece": F.lit(1), "part": F.lit(2)})
    check(df, 2048)
    check(df, 64)
    assert packing.best_fit_packing(df.limit(0)).collect() == []

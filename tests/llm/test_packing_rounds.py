"""Packing in many small ranges: every piece has its place, and the sequences are close to those of a plain best fit."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import packing

from .test_packing import best_fit_decreasing


def placed(spark, lengths, capacity, sweep_rows):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(df, capacity, sweep_rows=sweep_rows).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def shapes():
    rnd = random.Random(11)
    yield "even", [rnd.randint(1, 200) for _ in range(1500)], 200
    yield "short", [min(200, int(rnd.expovariate(1 / 20)) + 1) for _ in range(2000)], 200
    yield "hot", [67] * 600 + [rnd.randint(1, 199) for _ in range(900)] + [1] * 500, 200
    yield "large", [rnd.randint(90, 199) for _ in range(800)], 200


@pytest.mark.parametrize("name, lengths, capacity", list(shapes()), ids=[s[0] for s in shapes()])
def test_ranges(spark, name, lengths, capacity):
    best = best_fit_decreasing(lengths, capacity)
    assert placed(spark, lengths, capacity, 10**6) == best
    least = -(-sum(lengths) // capacity)
    many = placed(spark, lengths, capacity, 150)
    assert least <= many <= 1.03 * best + 2


def test_by_rank():
    counts = [(0, 0, 5), (1, 3, 1), (2, 4, 0), (3, 2, 9), (4, 1, 0)]
    got = packing.by_rank(counts)
    assert got == [(1, 0, 0, 0, 3), (2, 0, 1, 0, 1), (2, 1, 0, 3, 2), (4, 0, 3, 0, 1)]


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, length long")
    assert packing.pack(df, 10).collect() == []
    full = spark.createDataFrame([(1, 10), (2, 10)], "doc_id long, length long").withColumn("offset_of", F.lit("x"))
    assert len({r.sequence_id for r in packing.pack(full, 10).collect()}) == 2

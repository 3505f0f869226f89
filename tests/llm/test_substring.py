"""Both substring dedups against a brute-force version."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import automaton_dedup, suffix_dedup
from tallyfold.llm import windows as W

SF = "/root/testdata/sf0.001"


def brute(rows, tokens, join, win=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        x = tokens(t)
        for i in range(len(x) - win + 1):
            first.setdefault(tuple(x[i : i + win]), d)
    out = []
    for d, t in rows:
        x = tokens(t)
        cut = [False] * len(x)
        for i in range(len(x) - win + 1):
            f = first[tuple(x[i : i + win])]
            if f is not None and (d is None or f < d):
                cut[i : i + win] = [True] * win
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((d, len(x), sum(cut), spans, hashlib.sha256(join([w for w, c in zip(x, cut) if not c])).hexdigest()))
    return sorted(out, key=str)


def as_bytes(rows, win=50):
    return brute(rows, lambda t: list((t or "").encode()), bytes, win)


def as_words(rows, win=50):
    return brute(rows, lambda t: (t or "").encode().split(), b" ".join, win)


def digest(out, n):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    cols = out.select("doc_id", n, removed, F.size("spans").cast("long"), F.sha2(F.col("kept").cast("binary"), 256))
    return sorted((tuple(r) for r in cols.collect()), key=str)


def odd_rows():
    rnd = random.Random(5)
    line = " ".join(f"w{rnd.randint(0, 99)}" for _ in range(70))
    rows = [(i, f"{'é' * rnd.randint(0, 9)} {line[rnd.randint(0, 40):]} x{i}") for i in range(40)]
    long = " ".join(str(rnd.randint(0, 10**6)) for _ in range(120_000))
    rows += [(100, long), (101, "start " + long[:5000]), (102, long[300_000:]), (103, None), (104, ""), (105, " \n\t"), (7, rows[7][1]), (7, rows[3][1]), (None, line), (None, line), (106, "a" * 500), (107, "a" * 300), (108, "ab \n" * 300), (109, "ab \n" * 200)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("kept", F.lit("x"))


def test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert digest(suffix_dedup.suffix_dedup(df), "n_bytes") == as_bytes(rows)
    assert digest(automaton_dedup.automaton_dedup(df), "n_words") == as_words(rows)


@pytest.mark.parametrize("sizes", [{}, {"hot": 1, "batch_bytes": 1 << 16, "bucket_bytes": 1 << 16}, {"hot_runs": 2, "batch_bytes": 1 << 16}])
def test_odd_rows(odd, sizes):
    assert digest(suffix_dedup.suffix_dedup(odd, **sizes), "n_bytes") == as_bytes(odd_rows())
    assert digest(automaton_dedup.automaton_dedup(odd, **sizes), "n_words") == as_words(odd_rows())


def test_other_window(odd):
    assert digest(suffix_dedup.suffix_dedup(odd, 7), "n_bytes") == as_bytes(odd_rows(), 7)
    assert digest(automaton_dedup.automaton_dedup(odd, 5), "n_words") == as_words(odd_rows(), 5)


@pytest.mark.parametrize("win", [100, 150, 300])
def test_wide_windows(odd, win):
    assert digest(suffix_dedup.suffix_dedup(odd, win), "n_bytes") == as_bytes(odd_rows(), win)


@pytest.mark.parametrize("win", [1, 80, 150])
def test_wide_word_windows(odd, win):
    assert digest(automaton_dedup.automaton_dedup(odd, win), "n_words") == as_words(odd_rows(), win)


def test_collisions_are_told_apart(monkeypatch):
    class Weak(W.RangeHash):
        """Hashes of a few values, until the batch is hashed anew."""

        made = 0

        def __init__(self, symbols):
            super().__init__(symbols)
            Weak.made += 1
            self.weak = Weak.made <= 2

        def __call__(self, start, end):
            h = super().__call__(start, end)
            return h & W.U(7) if self.weak else h

    monkeypatch.setattr(W, "RangeHash", Weak)
    rnd = random.Random(2)
    t = pa.table({"doc_id": [1, 2], "text": ["".join(rnd.choice("abcdefgh") for _ in range(400)) for _ in range(2)]})
    b = W.batch_of(suffix_dedup._METHOD, t, W.Plan(50, 25, 4, 256), np.zeros(0, dtype=np.uint64))
    assert Weak.made > 1 and len(set(b.key.tolist())) == len(b.key)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.query(none).collect() == [] and automaton_dedup.query(none).collect() == []


def test_columns_spooled_or_not():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (300, 12)).astype(np.uint8)
    for spool in (False, True):
        for j, order, lcp in suffix_dedup.insert_columns(12, lambda j: x[:, j], 300, spool):
            s = [bytes(x[i, j:]) for i in order]
            assert s == sorted(s)
            for a, b, n in zip(s, s[1:], lcp[1:]):
                assert a[:n] == b[:n] and (a == b or a[n] != b[n])

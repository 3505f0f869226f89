"""License scan and quality rules against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import license_scan, quality_rules

SF = "/root/testdata/sf0.001"
PHRASES = {"mit": "the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def odd_texts():
    rnd = random.Random(4)
    lines = [" ".join(rnd.choice(["a", "bb", "É", "x#y", "|", "The", "MIT", "License"]) for _ in range(rnd.randint(0, 12))) for _ in range(8)]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    texts += [None, "", " \n\t\r\x0b\f", "one", "a b c d e f g h", "a b c d e f g h " * 3, "\n\n x \n x \n\n", "\x00 the\x01MIT-license\x7f", "ſ K the mit licenſe", "the mit license the mit license", "CC BY-NC cc_by_nc_sa xcc by nc", "z " * 40_000]
    texts += ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-or-later", "released under the MIT License", "see https://opensource.org/licenses/MIT for more", "Apache license version 2 and apache license version 20"]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    return df.unionByName(df.filter("doc_id < 3")).withColumns({"labels": F.lit(1), "n_words": F.lit("clash"), "_words": F.lit(0)})


def scan(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    starts, found = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                found.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def check_scan(df):
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = license_scan.query(df).collect()
    key = lambda x: str(x)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(d, *scan(t)) for d, t in texts], key=key)
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    return {r.doc_id: r for r in got}


def test_license_table(spark):
    check_scan(spark.read.parquet(f"{SF}/documents.parquet"))


def test_license_odd(odd):
    n = len(odd_texts())
    got = check_scan(odd)
    assert [got[n - k].labels for k in (5, 4, 3, 2)] == ["apache-2", "gpl-3", "mit", "mit"]
    assert license_scan.query(odd.limit(0)).collect() == []
    assert set(odd.columns) <= set(license_scan.license_scan(odd).columns)
    clash = odd.select("doc_id", "text").withColumns({c: F.lit(c) for c in ("low", "norm", "hits", "base", "stand", "_low")})
    out = license_scan.license_scan(clash)
    assert [r[c] for r in out.limit(3).collect() for c in clash.columns[2:]] == clash.columns[2:] * 3


def test_rules_keep_clashing_columns(odd):
    clash = odd.select("doc_id", "text").withColumns({c: F.lit(c) for c in ("words", "lines", "windows", "again", "placed", "at", "_words", "_again")})
    out = quality_rules.quality_rules(clash, quality_rules.DecisionList())
    assert [r[c] for r in out.limit(3).collect() for c in clash.columns[2:]] == clash.columns[2:] * 3


def stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, cover = Counter(wins), set()
    for i, k in enumerate(wins):
        if c[k] > 1:
            cover.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


def test_rules_odd(odd, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id long, quality int")
    got = quality_rules.query(odd, labels).collect()
    want = [(r.doc_id, *stats(r.text)) for r in odd.select("doc_id", "text").collect()]
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    none = quality_rules.query(odd.limit(0), labels.limit(0)).collect()
    assert none == []


def test_rules_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.query(docs, labels).join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and not base_failed")
    right, n = out.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).first()
    assert n > 30 and right / n >= 0.95

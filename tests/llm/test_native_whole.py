"""License labels and learned verdicts against plain Python over every document."""

import re

import numpy as np

from tallyfold.llm import license_scan as ls
from tallyfold.llm import quality_rules as qr

from .test_native import SF, odd_texts, stats

COMPILED = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in ls.RULES]


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    norm = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)) + " "
    hits = []
    for r, pattern in COMPILED:
        if f" {r.keyword}" in norm:
            for m in pattern.finditer(norm):
                start = norm[: m.start()].count(" ") - 1
                hits.append((start, -(start + m[0].count(" ") + 1), r.priority, r.number, r.label, r.weight))
    ends, kept = [-1] * ls.PRIORITIES, []
    for h in sorted(hits):
        if not any(e >= -h[1] for e in ends[: h[2] + 1]):
            kept.append(h)
        ends[h[2]] = max(ends[h[2]], -h[1])
    labels = {h[4] for h in kept} | {h[4] for h in hits if h[2] == 0}
    return ",".join(sorted(labels)), max((h[5] for h in kept), default=0.0)


def test_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    both = docs.unionByName(odd)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = {r.doc_id: (r.labels, r.score) for r in ls.query(both).collect()}
    assert got == {d: plain_scan(t) for d, t in texts.items()}
    assert sum(bool(x) for x, _ in got.values()) > 10


def features(text):
    n, chars, symbols, dup, repeat, _ = stats(text)
    t = text or ""
    share = lambda a, b: a / b if b else 0.0
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [n, share(chars, n), share(symbols, chars), share(dup, t.count("\n") + 1), share(repeat, n), share(len(re.findall("[A-Z]", t)), chars), share(len(re.findall("[!?;:]", t)), chars), share(len(set(words)), n)]


def test_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = qr.learn(docs, labels)
    some = qr.DecisionList((*rules.rules, (qr.Test("mean_word", False, 4.0), qr.Test("distinct_share", True, 0.5))))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for which in (rules, some):
        got = {r.doc_id: (r.rule, r.kept) for r in qr.quality_rules(docs.select("doc_id", "text"), which).collect()}
        for doc, text in texts.items():
            x, want = np.array([features(text)]), None
            for k, rule in enumerate(which.rules, 1):
                if all(t.holds(x)[0] for t in rule):
                    want = k
                    break
            assert got[doc] == (want, want is None and not stats(text)[5]), doc


def test_learning_is_the_same_every_time(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert str(qr.learn(docs, labels)) == str(qr.learn(docs.repartition(7), labels.repartition(3)))

"""Edit matching against dynamic programming over every document and item."""

import random

from pyspark.sql import functions as F

from tallyfold.llm import decontaminate as dc


def edit(pattern, text):
    """Smallest distance of the pattern to any substring."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def data():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 30)))) for i in range(12)] + [(12, None), (13, ""), (14, "?!"), (15, "abc")]
    docs = []
    for i in range(60):
        t = [word() for _ in range(rnd.randint(0, 60))]
        if i % 2:
            x = list(items[i % 12][1])
            for _ in range(rnd.randint(0, 7)):
                k = rnd.randrange(len(x))
                x[k : k + 1] = rnd.choice(["", "Z", x[k] + "q", x[k].upper()])
            t.insert(len(t) // 2, "".join(x).replace(" ", rnd.choice([" ", ", ", "\n"])))
        docs.append((i, " ".join(t)))
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[1][1]), (63, "é" * 100_000)]
    return docs, items


def want(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            p, s = dc.fold_text(x), dc.fold_text(t)
            if p and s and len(s) < 10_000:
                n = edit(p, s)
                if n <= dc.budget(len(p)) and (dc.budget(len(p)) or f" {p} " in f" {s} "):
                    out.append((d, i, n))
    return sorted(out, key=str)


def test_matches_and_filter(spark):
    docs, items = data()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("end", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    w = want(docs, items)
    assert len(w) > 15 and any(n for *_, n in w)
    for size in (dc.BLOCK_BYTES, 150):
        found = dc.matches(df, bench, block_bytes=size).select("doc_id", "item_id", "distance").collect()
        assert sorted(map(tuple, found), key=str) == w
        kept = dc.decontaminate(df, bench, block_bytes=size)
        assert kept.columns == df.columns
        gone = {d for d, *_ in w}
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in gone), key=str)


def test_short_items_stand_as_words():
    items = [(1, "yes"), (2, "in or out")]
    found = lambda t: [i for i, *_ in dc.Matcher(items).find(dc.fold_text(t))]
    assert found("yesterday") == [] and found("Yes!") == [1] and found("he said yes, in or out") == [1, 2] and found("in or outer") == []


def test_empty(spark):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert dc.matches(df.limit(0), bench).collect() == [] and dc.matches(df, bench.limit(0)).collect() == []
    assert dc.decontaminate(df, bench.limit(0)).count() == len(docs)

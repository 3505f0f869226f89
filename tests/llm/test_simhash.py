"""SimHash groups against brute force over all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import simhash
from tallyfold.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, mark=fp):
    f = [mark(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        name[r] = min((x for x in (name.get(r), d) if x is not None), default=None)
    return sorted([(d, f"{f[i]:016x}", name[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def got(df):
    return sorted([tuple(r) for r in simhash.query(df).collect()], key=str)


def test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(spark):
    rnd = random.Random(3)
    base = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(400))
    rows = [(i, base[: -rnd.randint(1, 40)] + f" x{i}") for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "one"), (54, "One two"), (55, "a b c d"), (5, rows[5][1]), (None, base), (None, "quite alone here"), (60, "É é" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_tiles_and_chains(spark):
    rnd = random.Random(1)
    seen = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):  # chains: each three bits from the one before, at most
            x ^= 1 << rnd.randint(0, 63) | 1 << rnd.randint(0, 63)
            seen.add(x)
    ids = sorted(seen)
    df = spark.createDataFrame([(i - (1 << 64) if i >> 63 else i,) for i in ids], "fp long")
    for rekey_rows in (6, simhash.REKEY_ROWS):
        check_links(spark, df, ids, rekey_rows)


def check_links(spark, df, ids, rekey_rows):
    edges = simhash.links(df, shard_rows=4, rekey_rows=rekey_rows)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges, Scratch(spark, "t")).collect()}
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids:
            if (i ^ j).bit_count() <= 3:
                group[find(i)] = find(j)
    classes = {}
    for i in ids:
        classes.setdefault(find(i), set()).add(i)
    mine = {}
    for i in ids:
        mine.setdefault(roots.get(i, i), set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))

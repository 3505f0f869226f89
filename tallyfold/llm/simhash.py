"""SimHash near-duplicates: fingerprints, BK-trees of their shards, components.

Fingerprints: 64-bit majority of the XXH64 hashes of a text's word shingles.

Search: two fingerprints that differ in at most ``radius`` bits agree in at
least two of ``radius + 2`` blocks, so each distinct fingerprint goes to the
shard of every pair of blocks and meets all its partners there.  A shard's
fingerprints form a BK-tree (children keyed by their Hamming distance to the
parent), and a search follows only edges within the radius.  Trees of all shards
together grow with the corpus, so they aren't broadcast: the tree is built where
a shard's fingerprints meet.  A shard above ``REKEY_ROWS`` is dealt anew by a part
of its other bits: cut into ``radius + 1`` parts, two partners agree in one of
them.  What is still above ``SHARD_ROWS`` is dealt as tiles of a triangle, so a
task holds two slices of it at most, however many near copies share its blocks.

Links stay inside the shards: each tile passes on a spanning forest of its
links (never all pairs of a group), and components of the whole come from
rounds of smallest-neighbour contraction over written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, hand_back, join_hot, n_partitions, unused

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints that one slice of a shard holds.
SHARD_ROWS = 512
#: Fingerprints of a shard above which a further part of the bits joins its key.
REKEY_ROWS = 4096
U = np.uint64


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    n, counts = 0, np.zeros(64, dtype=np.int64)
    h = _shingle_hashes(text, shingle)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo : lo + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255  # so many ones fit in a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long ``fp``."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) if t else 0 for t in texts], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        hand_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKForest:
    """One BK-tree for each shard, over distinct integers; levels are built and searched for many at once.

    ``tree`` is the ascending tree number of each value; a tree's first value is its root.
    """

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        n = len(values)
        self.trees, self.roots = np.unique(tree, return_index=True)
        parents, keys, nodes = [], [], []
        rest = np.setdiff1d(np.arange(n), self.roots)
        at = self.roots[np.searchsorted(self.trees, tree[rest])]
        while len(rest):  # the first to reach an empty edge becomes its child, the others go down
            d = distance(values[rest], values[at]).astype(np.int64)
            _, first, where = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            parents.append(at[first])
            keys.append(d[first])
            nodes.append(rest[first])
            below = rest[first][where]
            down = np.ones(len(rest), dtype=bool)
            down[first] = False
            rest, at = rest[down], below[down]
        parent, key, node = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (parents, keys, nodes))
        order = np.argsort(parent, kind="stable")
        self.key, self.node = key[order], node[order]
        self.first = np.searchsorted(parent[order], np.arange(n + 1))

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int):
        """Yields arrays (query index, value index) of the pairs within the radius; a query searches its own tree."""
        at = np.searchsorted(self.trees, tree)
        q = np.flatnonzero(self.trees[np.minimum(at, len(self.trees) - 1)] == tree) if len(self.trees) else np.zeros(0, dtype=np.int64)
        at = self.roots[at[q]]
        while len(q):
            d = distance(queries[q], self.values[at]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], at[hit]
            n = self.first[at + 1] - self.first[at]
            up = np.repeat(np.arange(len(q)), n)
            edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
            follow = np.abs(self.key[edge] - d[up]) <= radius
            q, at = q[up[follow]], self.node[edge[follow]]


class _Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def spanning(fp: np.ndarray, tree: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows that ask and rows in the tree of the same number: (value, smaller value)."""
    values, at = np.unique(fp, return_inverse=True)
    held = np.flatnonzero(in_tree)
    held = held[np.argsort(tree[held], kind="stable")]
    trees, forest = BKForest(fp[held], tree[held]), _Forest(len(values))
    asking = np.flatnonzero(asks)
    for lo in range(0, len(asking), block):
        part = asking[lo : lo + block]
        for q, v in trees.within(fp[part], tree[part], radius):
            forest.link(at[part[q]], at[held[v]])
    moved = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[moved], values[forest.root[moved]]


def _blocks(count: int) -> list[tuple[int, int]]:
    cut = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:])]


def _sized(dealt: DataFrame) -> DataFrame:
    """The rows of shards with two fingerprints at least, and how many theirs has."""
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return dealt.join(sizes, "key")  # a fingerprint alone in its shard has no partner there


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, bucket_rows: int = 40_000, rekey_rows: int = REKEY_ROWS) -> DataFrame:
    """Spanning links ``a > b`` (as signed longs) between the distinct values of ``fp``."""
    parts = _blocks(radius + 2)
    mask = lambda i: ((1 << parts[i][1]) - 1) << parts[i][0]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pairs = list(combinations(range(radius + 2), 2))
    own_bits = [mask(i) | mask(j) for i, j in pairs]
    keys = [F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for k, m in enumerate(own_bits)]
    dealt = _sized(fps.select("fp", F.explode(F.array(*keys)).alias("key")))
    finer = []
    for m in own_bits:  # the other bits in radius + 1 parts, each joined to the shard's own
        rest = [b for b in range(64) if not m >> b & 1]
        cut = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
        finer.append(F.array(*[F.lit(signed(m | sum(1 << b for b in rest[x:y]))) for x, y in zip(cut[:-1], cut[1:])]))
    masks = F.get(F.array(*finer), F.col("key.pair"))
    again = F.transform(masks, lambda m, i: F.struct((F.col("key.pair") + len(pairs) * (i + 1)).alias("pair"), F.col("fp").bitwiseAND(m).alias("bits")))
    hot = dealt.filter(F.col("n") > rekey_rows).select("fp", F.explode(again).alias("key"))
    met = dealt.filter(F.col("n") <= rekey_rows).unionByName(_sized(hot))
    slices = F.ceil(F.col("n") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.least(s, F.col("own")).alias("lo"), F.greatest(s, F.col("own")).alias("hi")))
    tiled = met.withColumns({"slices": slices, "own": own}).select("fp", "own", "key", F.explode(tiles).alias("tile"))
    buckets = max(n_partitions(fps.sparkSession), fps.count() * len(pairs) // bucket_rows + 1)
    shard = F.xxhash64("key", "tile")
    placed = tiled.select("fp", shard.alias("shard"), (F.col("own") == F.col("tile.lo")).alias("held"), (F.col("own") == F.col("tile.hi")).alias("asks"), F.pmod(shard, F.lit(buckets)).alias("bucket"))

    def run(t: pa.Table) -> pa.Table:
        fp, shard, held, asks = (t[c].to_numpy() for c in ("fp", "shard", "held", "asks"))
        a, b = spanning(fp.view(np.uint64), shard, held, asks, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return placed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root``: the smallest node that each node reaches; nodes without edges aren't listed.

    Rounds of large-star and small-star contraction over written tables; their
    number grows with the logarithm of the longest chain.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, path = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(now)
    while before[0]:
        # large star: a node's larger neighbours go to the least one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("m", "u").alias("m"))
        large, large_path = scratch.save(join_hot(now, least, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours go to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after, new_path = scratch.save(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        for old in (path, large_path):
            scratch.drop(old)
        now, path, was = after, new_path, before
        before = state(now)
        if before == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(docs: DataFrame, shingle: int, radius: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, fp) of each row, and (fp, component_id) of each distinct fingerprint."""
    marked, _ = scratch.save(fingerprints(docs, shingle), "fingerprints")
    distinct, _ = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, radius), scratch)
    rooted, _ = scratch.save(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = scratch.save(join_hot(rooted, names, "root").select("fp", "component_id"), "named")
    return marked, named


def simhash_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    Rows link when their fingerprints differ in at most ``radius`` bits; the
    component is named by its smallest ``doc_id``.  Null, empty and white texts
    have fingerprint zero and link like any other.  Rows with equal ids or texts
    all stay.  A row without an id takes part in links and is never the name,
    unless its whole component has no id (then the name is null).  Texts are read
    whole, however long.  An empty table gives no rows.
    """
    marked, named = _classes(docs, shingle, radius, scratch or Scratch(docs.sparkSession, "simhash"))
    return join_hot(marked, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """The documents, with all their columns, that name their component: one of each near-duplicate group.

    Rows with the same id are one document and stay or go together.  Rows
    without an id go if their component has an id, and all stay if it has none.
    """
    _, named = _classes(docs, shingle, radius, scratch or Scratch(docs.sparkSession, "simhash"))
    return _kept(docs, named, shingle)


def _kept(docs: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    (at,) = unused(docs, "fp")
    chosen = named.filter("component_id is not null").select(F.col("component_id").alias(at)).distinct()
    kept = docs.join(chosen, docs["doc_id"].cast("long") == chosen[at], "left_semi")
    free = named.filter("component_id is null")
    if not free.limit(1).count():
        return kept
    loose = docs.filter("doc_id is null")
    schema = StructType([*docs.schema.fields, StructField(at, LongType())])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, at])

    marked = loose.mapInArrow(run, schema)
    return kept.unionByName(marked.join(free.select(F.col("fp").alias(at)), at, "left_semi").drop(at))


def query(docs: DataFrame) -> DataFrame:
    return simhash_near_duplicates(docs)

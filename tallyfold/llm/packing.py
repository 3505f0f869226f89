"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokens: a public byte-pair vocabulary with word ends.  A BPE result depends only
on the word, so a task encodes each distinct white-space-delimited chunk once
and keeps its ids as bytes.  The merges are run by the rank-based encoder over
the same vocabulary (the end-of-word mark becomes one byte that text can't hold);
``_ranks`` keeps just the tokens that the merge list itself can reach, which makes
both encoders agree; chunks with letters outside Latin go to the original one.

Packing: bulk-synchronous best fit over written tables.  Lengths are taken in
bands, the longest first, so that residual gaps of one band serve the next.  A
round sorts the band's pieces and the open gaps that can hold one of them by size
into ranges; in each range a sweep from the largest size down gives every piece
its successor, the smallest gap that still holds it, and the gap shrinks.  What a
range leaves over is matched across ranges by rank: the gaps left in higher
ranges and the pieces left in lower ones pair up as brackets do, and a piece or a
gap knows its partner from its own rank and the two counts of each range.  Pieces
that lost go to the next round with the gaps as they are then; when a round
places next to none of them, they open sequences range by range.  A range holds a
bounded number of rows, and counts per range are all that the driver sees.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from bisect import insort
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hand_back, tokenizer_file

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct chunks that a task keeps the ids of, about 150 MB.
CACHE_CHUNKS = 500_000
END = b"\xff"
#: Rows (pieces and gaps) that one range of a sweep holds, about.
SWEEP_ROWS = 1 << 15
#: A round that places less than this share of its pieces is the band's last.
PROGRESS = 1 / 16


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as is, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = _byte_alphabet(), model["vocab"]

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        body = token[:-4] if end else token
        return bytes(alphabet[c] for c in body) + END * end

    ranks = {raw(t): vocab[t] for t in vocab if len(t.removesuffix("</w>")) == 1}
    # a merge counts where the lower merges really leave its two sides; else its token is never made
    made = {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    for a, b in pairs:
        x, y = raw(a), raw(b)
        if x in ranks and y in ranks and _split(x + y, ranks) == (x, y):
            ranks[x + y] = vocab[a + b]
            made[x + y] = True
    return ranks


def _split(word: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """Merges by lowest rank until none applies."""
    parts = [bytes([b]) for b in word]
    if parts[-1] == END:
        parts[-2:] = [parts[-2] + END]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        rank = parts[best] + parts[best + 1]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] + parts[i + 1] == rank:
                out.append(rank)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return tuple(parts)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        ranks = dict(ranks or _ranks(path))
        missing = {bytes([b]) for b in range(256)} - set(ranks)
        top = max(ranks.values()) + 1
        ranks |= {b: top + i for i, b in enumerate(sorted(missing))}
        ids = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.word = ids._core_bpe.encode_single_piece
        self.pieces = regex.compile(PIECE).findall
        self.latin = regex.compile(r"[\x21-\x7E¡-ÿŒœŸ–—‘-”…€]+").fullmatch
        self.cache: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not (text.isascii() or self.latin(text)):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()  # composed already: normalisation only lowers the case
        if text.isalpha():
            return self.ids(text)
        return b"".join(map(self.ids, self.pieces(text)))

    def ids(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            found = self.words[piece] = array("I", self.word(piece.encode() + END)).tobytes()
        return found

    def __call__(self, text: str) -> bytes:
        cache, chunks = self.cache, text.encode().split()
        get = cache.get
        found = [get(c) for c in chunks]
        if None in found:
            if len(cache) > CACHE_CHUNKS:
                cache.clear()
                self.words.clear()
            for i, x in enumerate(found):
                if x is None:
                    c = chunks[i]
                    found[i] = x = get(c) or self.chunk(c)
                    cache[c] = x
        return b"".join(found)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``; a document is its ids and a closing 0."""
    path = tokenizer_file(VOCABULARY, tokenizer)
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(path))  # the vocabulary: a fixed file, 1 MB

    def run(batches):
        encode = Encoder(path, ranks.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        body = memoryview(ids)[4 * s : 4 * (s + capacity)]
                        for c, v in zip(cols, (doc, k, s, len(body) // 4, zlib.crc32(body))):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del encode
        hand_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def band_edges(capacity: int) -> list[int]:
    """Descending bounds: band k holds lengths up to edge k - 1 and above edge k; sequences of one band hold few kinds of it."""
    edges = {0, capacity // 2, capacity // 3}
    e = capacity // 4
    while e:
        edges.add(e)
        e //= 2
    return sorted(edges, reverse=True)


#: What a row of a sweep's result is.
PLACED, GAP, LEFT, SHUT = 0, 1, 2, 3


def _sweep(kind, size, sequence, used, capacity: int, first: int | None):
    """Best fit of rows in descending order of size, gaps before pieces of their size.

    ``first``: number of the first sequence that may be opened; None if pieces that
    find no gap are left over.  Returns (rows placed, their sequences, their
    offsets), (sequences, sizes, used) of all gaps afterwards, and the rows left.
    """
    least = int(size[kind == LEFT].min()) if (kind == LEFT).any() else 0
    gaps: list[list[int]] = []  # [sequence, size, used]
    open_: list[tuple[int, int]] = []  # (-size, gap): the smallest is last
    later: list[tuple[int, int]] = []  # residual gaps that only smaller pieces can use: the largest is first
    placed, left, opened = [], [], 0
    rows = zip(kind.tolist(), size.tolist(), sequence.tolist(), used.tolist())
    for i, (k, n, s, u) in enumerate(rows):
        if k == GAP:
            open_.append((-n, len(gaps)))
            gaps.append([s, n, u])
            continue
        while later and -later[0][0] >= n:
            insort(open_, heapq.heappop(later))
        if open_:
            g = open_.pop()[1]
        elif first is not None:
            g = len(gaps)
            gaps.append([first + opened, capacity, 0])
            opened += 1
        else:
            left.append(i)
            continue
        gap = gaps[g]
        placed.append((i, gap[0], gap[2]))
        gap[1] -= n
        gap[2] += n
        if gap[1] >= n:
            open_.append((-gap[1], g))
        elif gap[1] >= least:
            heapq.heappush(later, (-gap[1], g))
    return placed, gaps, left


_STATE = "kind int, pid int, pos long, units long, size long, sequence_id long, used long, tie long"


def _swept(capacity: int, first: int | None, most: int, item_type: pa.DataType):
    """A task that sweeps its sorted range; see ``_STATE`` for what comes out.

    Pieces left over have their place among those of the range as ``pos``.  Gaps
    that no piece of the range or a higher one has taken and that hold any piece of
    a lower range are GAP: they count ``units`` pieces of the band's longest length
    ``most``, and ``pos`` is the number of units before, from the smallest gap up.
    Other gaps are SHUT for the round.
    """

    def run(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        if not t.num_rows:
            return
        pid = TaskContext.get().partitionId()
        kind, size = t["kind"].to_numpy(), t["size"].to_numpy()
        start = None if first is None else first + (pid << 24)
        placed, gaps, left = _sweep(kind, size, t["sequence_id"].to_numpy(), t["used"].to_numpy(), capacity, start)
        floor = int(size[-1])
        gaps = sorted((g for g in gaps if g[1]), key=lambda g: (g[1], g[0]))
        out = [(PLACED, pid, 0, 0, int(size[i]), s, u, i) for i, s, u in placed] + [(LEFT, pid, k, 1, int(size[i]), 0, 0, i) for k, i in enumerate(left)]
        pos = 0
        for s, n, u in gaps:
            units = max(1, n // most) if n >= floor else 0
            out.append((GAP if units else SHUT, pid, pos, units, n, s, u, -1))
            pos += units
        cols = [np.array(c, dtype=np.int64) for c in zip(*out)]
        row = cols[7]
        items = t["item"].combine_chunks()
        items = items.take(pa.array(np.maximum(row, 0))) if not isinstance(items, pa.ChunkedArray) else pa.concat_arrays(items.chunks).take(pa.array(np.maximum(row, 0)))
        items = pa.array([None] * len(row), items.type) if not (row >= 0).any() else _mask(items, row < 0)
        tie = np.where(row >= 0, t["tie"].to_numpy()[np.maximum(row, 0)], cols[5])
        yield pa.record_batch(
            [pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), *[pa.array(c) for c in cols[2:7]], pa.array(tie), items],
            names=["kind", "pid", "pos", "units", "size", "sequence_id", "used", "tie", "item"],
        )
        del out, cols, items, placed, gaps, t, got
        hand_back()

    return run


def _mask(items: pa.Array, empty: np.ndarray) -> pa.Array:
    """The structs with nulls where ``empty``."""
    return pa.StructArray.from_arrays(items.flatten(), fields=list(items.type), mask=pa.array(empty))


def by_rank(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Pairs the pieces left in each range with gap units left in higher ranges, the nearest first, as brackets pair up.

    ``counts``: (range, pieces, units), the highest range first.  Returns
    (range of pieces, first piece, range of gaps, first unit, number).
    """
    out, stack = [], []
    for pid, pieces_left, units in counts:
        at = 0
        while at < pieces_left and stack:
            gap_pid, unit, n = stack.pop()
            take = min(n, pieces_left - at)
            out.append((pid, at, gap_pid, unit, take))
            at += take
            if take < n:
                stack.append((gap_pid, unit + take, n - take))
        if units:
            stack.append((pid, 0, units))
    return out


class _Packer:
    def __init__(self, spark, scratch: Scratch, capacity: int, sweep_rows: int, schema: str):
        self.spark, self.scratch, self.capacity, self.sweep_rows, self.schema = spark, scratch, capacity, sweep_rows, f"{_STATE}, item {schema}"
        self.placed: list[DataFrame] = []
        self.rounds = 0

    def number(self) -> int:
        """First of the sequence numbers that a round's tasks may use."""
        self.rounds += 1
        return self.rounds << 44

    def sorted(self, rows: DataFrame, n: int) -> DataFrame:
        order = [F.desc("size"), F.col("kind"), F.col("tie")]
        ranged = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, *order)
        return ranged.sortWithinPartitions(*order)

    def sweep(self, rows: DataFrame, n: int, first: int | None, most: int, name: str) -> DataFrame:
        kind = rows.schema["item"].dataType
        out = self.sorted(rows, n).mapInArrow(_swept(self.capacity, first, most, kind), self.schema)
        return self.scratch.save(out, name)[0]

    def keep(self, table: DataFrame) -> DataFrame:
        self.placed.append(table.filter(F.col("kind") == PLACED).select("item.*", "sequence_id", F.col("used").alias("offset")))
        return table.filter(F.col("kind").isin(GAP, SHUT)).withColumn("kind", F.lit(GAP))

    def band(self, rows: DataFrame, n_rows: int, least: int, most: int) -> DataFrame:
        """Packs pieces among ``rows`` into the gaps among them; returns the gaps afterwards."""
        if n_rows <= self.sweep_rows:
            return self.keep(self.sweep(rows, 1, self.number(), most, "sweep"))
        spare = []
        while True:
            swept = self.sweep(rows, n_rows // self.sweep_rows + 1, None, most, "sweep")
            gaps = self.keep(swept)
            is_left, is_gap = F.col("kind") == LEFT, F.col("kind") == GAP
            tally = swept.groupBy("pid").agg(F.count_if(is_left).alias("n"), F.sum(F.when(is_gap, F.col("units")).otherwise(0)).alias("units"), F.count_if(F.col("kind") == PLACED).alias("done"))
            counts = [(r.pid, r.n, r.units or 0, r.done) for r in tally.orderBy("pid").collect()]  # three numbers for each range
            total, done = sum(c[1] for c in counts), sum(c[3] for c in counts)
            if not total:
                return reduce(DataFrame.unionByName, [*spare, gaps])
            pairs = by_rank([c[:3] for c in counts])
            met = sum(p[4] for p in pairs)
            if met:
                gaps, left = self.across(swept, pairs)
            else:
                left = swept.filter(is_left)
            total -= met
            if total and done + met < PROGRESS * (total + done + met):  # the rest opens sequences, each range on its own
                spare += [gaps, self.fresh(left, most)]
                return reduce(DataFrame.unionByName, spare)
            if not total:
                return reduce(DataFrame.unionByName, [*spare, gaps])
            useful = F.col("size") >= least
            spare.append(gaps.filter(~useful))
            rows = left.withColumn("kind", F.lit(LEFT)).unionByName(gaps.filter(useful))
            rows, _ = self.scratch.save(rows, "round")
            n_rows = rows.count()

    def across(self, swept: DataFrame, pairs) -> tuple[DataFrame, DataFrame]:
        """Places the paired pieces; (all gaps, pieces still left)."""
        plan = F.broadcast(self.spark.createDataFrame(pairs, "item_pid int, item_from long, gap_pid int, unit_from long, n long"))  # two rows a range at most
        tops: dict[int, int] = {}
        for _, _, g, unit, n in pairs:
            tops[g] = max(tops.get(g, 0), unit + n)
        taken = F.broadcast(self.spark.createDataFrame(sorted(tops.items()), "gap_pid int, top long"))
        left = swept.filter(F.col("kind") == LEFT)
        inside = (F.col("pid") == F.col("item_pid")) & (F.col("pos") >= F.col("item_from")) & (F.col("pos") < F.col("item_from") + F.col("n"))
        asks = left.join(plan, inside).select("gap_pid", (F.col("unit_from") + F.col("pos") - F.col("item_from")).alias("unit"), F.col("size").alias("length"), "tie", "item")
        offers = swept.filter(F.col("kind") == GAP).join(taken, F.col("pid") == F.col("gap_pid")).filter(F.col("pos") < F.col("top"))
        units = F.explode(F.sequence(F.col("pos"), F.least(F.col("pos") + F.col("units"), F.col("top")) - 1))
        offers = offers.select("gap_pid", units.alias("unit"), "sequence_id", F.col("used").alias("base"), F.col("size").alias("gap"))
        met, _ = self.scratch.save(asks.join(offers, ["gap_pid", "unit"]), "met")
        before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("unit")) - F.col("length")
        self.placed.append(met.withColumn("offset", F.col("base") + before).select("item.*", "sequence_id", "offset"))
        shrunk = met.groupBy("sequence_id").agg(F.sum("length").alias("cut"))
        gaps = swept.filter(F.col("kind").isin(GAP, SHUT)).join(shrunk, "sequence_id", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
        gaps = gaps.withColumns({"kind": F.lit(GAP), "size": F.col("size") - F.col("cut"), "used": F.col("used") + F.col("cut")}).filter("size > 0").drop("cut")
        whole = left.join(plan, inside, "left_anti")
        return self.scratch.save(gaps, "gaps")[0].select(*swept.columns), whole

    def fresh(self, left: DataFrame, most: int) -> DataFrame:
        """Opens sequences for pieces that no gap holds, range by range; returns their gaps."""
        first, capacity = self.number(), self.capacity
        out_type = left.schema

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("size", "descending"), ("tie", "ascending")])
            size = t["size"].to_numpy()
            none = np.zeros(len(size), dtype=np.int64)
            placed, gaps, _ = _sweep(np.full(len(size), LEFT), size, none, none, capacity, first + (int(t["pid"][0].as_py()) << 24))
            gaps = [g for g in gaps if g[1]]
            row = np.array([p[0] for p in placed], dtype=np.int64)
            done = t.take(pa.array(row))
            done = done.set_column(0, "kind", pa.array(np.full(len(row), PLACED, dtype=np.int32)))
            done = done.set_column(5, "sequence_id", pa.array([p[1] for p in placed], pa.int64())).set_column(6, "used", pa.array([p[2] for p in placed], pa.int64()))
            m = len(gaps)
            rest = {"kind": np.full(m, GAP, dtype=np.int32), "pid": np.zeros(m, dtype=np.int32), "pos": np.zeros(m, dtype=np.int64), "units": np.zeros(m, dtype=np.int64)}
            rest |= {"size": np.array([g[1] for g in gaps], dtype=np.int64), "sequence_id": np.array([g[0] for g in gaps], dtype=np.int64), "used": np.array([g[2] for g in gaps], dtype=np.int64)}
            more = pa.table([*[pa.array(v) for v in rest.values()], pa.array(rest["sequence_id"]), pa.nulls(m, t.schema.field("item").type)], names=t.column_names)
            return pa.concat_tables([done, more.cast(done.schema)])

        cols = [c.strip().split(" ")[0] for c in _STATE.split(",")] + ["item"]
        opened = left.select(*cols).groupBy("pid").applyInArrow(run, out_type)
        return self.keep(self.scratch.save(opened, "fresh")[0])


def pack(items: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    Bands that fit into one range together are swept together.
    """
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    saved, _ = scratch.save(items, "pieces")
    whole = saved.filter(F.col("length") == capacity).select(*items.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    edges = band_edges(capacity)
    in_band = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col(c)))
    rest = saved.filter(F.col("length") < capacity)
    counts = {r.band: r.n for r in rest.groupBy(in_band("length").alias("band")).agg(F.count("*").alias("n")).collect()}  # a row a band
    item = F.struct(*[F.col(c) for c in items.columns])
    zero = F.lit(0).cast("long")
    state = rest.select(F.lit(LEFT).alias("kind"), F.lit(0).alias("pid"), zero.alias("pos"), zero.alias("units"), F.col("length").alias("size"), zero.alias("sequence_id"), zero.alias("used"), F.xxhash64(*items.columns).alias("tie"), item.alias("item"))
    total = sum(counts.values())
    if total > sweep_rows:  # by length once, so that a band reads its own files only
        state, _ = scratch.save(state.repartitionByRange(total // sweep_rows + 1, F.desc("size"), "tie").sortWithinPartitions(F.desc("size"), "tie"), "ranged")
    packer = _Packer(spark, scratch, capacity, sweep_rows, state.schema["item"].dataType.simpleString())
    gaps: list[tuple[DataFrame, dict[int, int]]] = []  # written gaps, and how many of each band's size
    bands = sorted(counts)
    while bands:
        n_gaps = lambda k: sum(n for _, by in gaps for b, n in by.items() if b <= k)
        group, n = [bands[0]], counts[bands[0]]
        while len(group) < len(bands) and n + counts[bands[len(group)]] + n_gaps(bands[len(group)]) <= sweep_rows:
            n += counts[bands[len(group)]]
            group.append(bands[len(group)])
        bands = bands[len(group) :]
        most, least = (edges[group[0] - 1] if group[0] else capacity - 1), edges[group[-1]] + 1
        rows = state.filter((F.col("size") >= least) & (F.col("size") <= most))
        held = [g.filter(F.col("size") >= least) for g, _ in gaps]
        after = packer.band(reduce(DataFrame.unionByName, [rows, *held]), n + n_gaps(group[-1]), least, most)
        if bands:
            by = {r.band: r.n for r in after.groupBy(in_band("size").alias("band")).agg(F.count("*").alias("n")).collect()}
            gaps = [(g.filter(F.col("size") < least), {b: m for b, m in old.items() if b > group[-1]}) for g, old in gaps] + [(after, by)]
    return reduce(DataFrame.unionByName, [p.select(*items.columns, "sequence_id", "offset") for p in packer.placed], whole)


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, **sizes) -> DataFrame:
    """Packs every document's tokens into sequences of at most ``capacity``.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.  Documents longer than ``capacity`` are cut, none else.

    A null or empty text is the one id 0.  A text of any length is encoded whole.
    Rows with the same id or text are separate documents with places of their own;
    a null id is kept as it is.  An empty table gives no rows.
    """
    return pack(pieces(docs, capacity, tokenizer), capacity, **sizes)


def query(docs: DataFrame) -> DataFrame:
    return best_fit_packing(docs)

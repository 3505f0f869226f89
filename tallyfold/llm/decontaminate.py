"""Benchmark decontamination by pigeonhole edit matching.

Method: an item within ``k`` edits of a passage leaves one of its ``k + 1``
pieces unchanged.  The pieces of a block of items go into one Aho-Corasick
automaton, documents are scanned for exact piece hits, and each hit's
neighbourhood is verified with Myers' bit-parallel distance, which gives the
smallest edit distance between the item and any substring of the document.

Items and documents are compared in a folded form: ASCII letters lower-cased,
runs of other ASCII characters than letters and digits replaced by one space.

The benchmark is read in blocks of at most ``block_bytes`` of item text (one pass
over the documents for each), so what is broadcast has a bound whatever the
benchmark's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back

#: Edits allowed for each 100 characters of a folded item.
EDIT_PERCENT = 5
#: Folded items shorter than this have too little text to tell a leak from chance; they match only as a whole.
MIN_PIECE = 8
BLOCK_BYTES = 4 << 20

_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def fold_text(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_FOLD).split()).decode()


def budget(length: int, percent: int = EDIT_PERCENT) -> int:
    """Edits allowed for an item: as many as ``percent`` says, while its pieces keep ``MIN_PIECE`` characters."""
    return max(0, min(length * percent // 100, length // MIN_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(smallest distance of the pattern to a substring of the text, first end of such a substring) if it is at most k."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return (best, end) if best <= k else None


class Matcher:
    """Finds the items of a block in folded texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int = EDIT_PERCENT):
        import ahocorasick

        self.items, self.budget = [], []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text), percent)
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text))
            self.budget.append(k)
        self.automaton = ahocorasick.Automaton() if where else None
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the folded text) for each item within its budget; the best place of each."""
        if self.automaton is None:
            return []
        spots: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for item, at in uses:
                spots.setdefault(item, set()).add(end + 1 - size - at)
        out = []
        for item, starts in spots.items():
            (item_id, pattern), k = self.items[item], self.budget[item]
            best = None
            # without an edit to spare an item counts as words: "yes" is not in "yesterday"
            whole = text.find(pattern) if k else f" {text} ".find(f" {pattern} ")
            if not k and whole < 0:
                continue
            if whole >= 0:
                best = (0, whole + len(pattern))
            else:
                lo = hi = -1
                for s in [*sorted(starts), None]:
                    # neighbouring hits share one stretch of text
                    if s is not None and lo >= 0 and s - k <= hi:
                        hi = s + len(pattern) + k
                        continue
                    if lo >= 0:
                        a = max(0, lo)
                        found = myers(pattern, text[a:hi], k)
                        if found and (best is None or found[0] < best[0]):
                            best = (found[0], a + found[1])
                    if s is not None:
                        lo, hi = max(0, s - k), s + len(pattern) + k
            if best:
                out.append((item_id, *best))
        return sorted(out)


def _blocks(items: list[tuple[int, str]], block_bytes: int):
    block, size = [], 0
    for item in items:
        n = len(item[1].encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    if block:
        yield block


def _item_blocks(benchmark: DataFrame, block_bytes: int):
    """Blocks of (item_id, folded text); one block at a time is on the driver."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") > 0)
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for i in range(n):
        rows = [(r.item_id, fold_text(r.text)) for r in (sized if n == 1 else sized.filter(part == i)).collect()]
        yield from _blocks(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), block_bytes)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents and the benchmark items that they hold: ``doc_id, item_id, distance, end, n_edits_allowed``.

    ``docs``: ``doc_id`` (integer), ``text``; ``benchmark``: ``item_id``
    (integer), ``text``; other columns are ignored.  One row per document and
    item with its smallest distance; ``end`` is where that passage ends in the
    folded text.  Null and empty texts, and items without a letter or digit,
    match nothing.  An item of less than two pieces' length must stand as whole
    words.  Items with equal texts each match; rows of a repeated document are
    judged each on its own; of places with the same distance the first is given.
    Texts of any length are searched whole.  An empty table of either kind gives
    no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, end long, n_edits_allowed int"
    out = None
    for block in _item_blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(block)  # at most block_bytes of text
        part = src.mapInArrow(_scanner(held, percent), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _scanner(held, percent: int):
    def run(batches):
        matcher = Matcher(held.value, percent)
        allowed: dict = {}
        for (item_id, _), k in zip(matcher.items, matcher.budget):
            allowed[item_id] = max(k, allowed.get(item_id, 0))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        for batch in batches:
            rows = [(doc, item, d, end, allowed[item]) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if text for item, d, end in matcher.find(fold_text(text))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "distance", "end", "n_edits_allowed"])
        del matcher
        hand_back()

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item within its budget.

    A document goes as a whole.  Judged row by row in the scan itself: no join,
    so repeated and null ids need no care.
    """
    spark = docs.sparkSession
    out = docs
    for block in _item_blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            matcher = Matcher(held.value, percent)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array([not (t and matcher.find(fold_text(t))) for t in texts], pa.bool_()))
            del matcher
            hand_back()

        out = out.mapInArrow(run, out.schema)
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)

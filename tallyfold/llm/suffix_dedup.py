"""Exact substring dedup by a column-wise suffix order of the whole collection.

Method: multi-document construction of the Burrows-Wheeler transform.  One
symbol of every record is inserted each round, from the right.  A round reads the
inserted column in the order of the records' suffixes: that is the collection's
transform of the round, and it is appended to the transform file.  The file, read
back, gives the next order (a stable distribution by symbol), and the common
prefix of neighbours is one more than the least one between them in the prefix
file of the round before, which the new one replaces.  The transform of the whole
collection is the concatenation of the rounds' segments, one for each column.

Records are aligned at an anchor that equal windows share (``windows``), so
suffixes that start at different distances from it never meet and each round
needs only the order of its own column.  The rounds are bounded by the record
width (75 bytes for 50-byte strings), not by the longest document, and every
bucket is a task of its own with sequential files of its own.  They are held by
the task, compressed where the bucket is large, and never on a machine's disk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

#: Records above which a bucket's transform and prefix files are compressed.
SPOOL_RECORDS = 1 << 18
ANCHOR_BYTES = 25
#: Fills a record outside its windows; no window that is judged has it.
PAD = 0xFF


class SequentialFile:
    """Arrays written and read whole, one after the other."""

    def __init__(self, spool: bool):
        self.zip, self.segments = (zstandard.ZstdCompressor(level=1), {}) if spool else (None, {})

    def write(self, number: int, a: np.ndarray) -> None:
        self.segments[number] = a if self.zip is None else (a.dtype, self.zip.compress(np.ascontiguousarray(a)))

    def read(self, number: int) -> np.ndarray:
        found = self.segments[number]
        return found if self.zip is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(found[1]), dtype=found[0])

    def drop(self, number: int) -> None:
        self.segments.pop(number, None)


def insert_columns(width: int, column, n: int, spool: bool = False, transform: SequentialFile | None = None):
    """Yields (column number, suffix order, common prefix with the predecessor), right to left.

    ``column(j)`` is the symbol of each record at column ``j``.  The transform's
    segments go to ``transform``, by column.
    """
    most = np.iinfo(kind := np.uint8 if width < 255 else np.uint16).max
    transform, prefixes = transform or SequentialFile(spool), SequentialFile(spool)
    prefixes.write(width, np.zeros(n + 1, dtype=kind))
    order = np.arange(n)
    for j in range(width - 1, -1, -1):
        transform.write(j, column(j)[order])
        bwt = transform.read(j)
        pile = np.argsort(bwt, kind="stable")  # by symbol, in suffix order within
        before = np.minimum.reduceat(prefixes.read(j + 1), pile + 1)  # least prefix up to the pile's next record
        symbol = bwt[pile]
        lcp = np.zeros(n + 1, dtype=kind)
        same = symbol[1:] == symbol[:-1]
        lcp[1:n][same] = np.minimum(before[:-1][same], most - 1) + 1
        prefixes.write(j, lcp)
        prefixes.drop(j + 1)
        order = order[pile]
        yield j, order, lcp[:n]


def _mark(bodies, d0, d1, ids, anchors, plan: W.Plan) -> np.ndarray:
    """One bit for each window of each record: a smaller id has the same window."""
    n = len(ids)
    flat = np.ascontiguousarray(np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(m, plan.width) for m, b in bodies]).T)
    mask = np.zeros((n, plan.words), dtype=np.uint64)
    for j, order, lcp in insert_columns(plan.width, flat.__getitem__, n, n > SPOOL_RECORDS):
        if j > plan.left:
            continue
        valid = (d0[order] <= j) & (j <= d1[order])
        who = np.where(valid, ids[order], W.NO_ID)
        group = np.flatnonzero(lcp < plan.win)  # neighbours with a common prefix of a whole window are one group
        least = np.repeat(np.minimum.reduceat(who, group), np.diff(np.append(group, n)))
        mask[order[valid & (who > least)], j >> 6] |= W.U(1 << (j & 63))
    return mask


def _pack(b: W.Batch, pick, d0, d1, plan: W.Plan) -> bytes:
    col = np.arange(plan.width)
    at = b.pos[pick][:, None] - plan.left + col
    inside = (col >= d0[:, None]) & (col < (d1 + plan.win)[:, None])
    return np.where(inside, b.tokens[np.clip(at, 0, len(b.tokens) - 1)], np.uint8(PAD)).tobytes()


def _text_bytes(t: pa.Table) -> list[np.ndarray]:
    col = t["text"].combine_chunks().cast(pa.large_binary()).fill_null(b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _tokens(t: pa.Table):
    texts = _text_bytes(t)
    for i in W.by_id(t):
        if len(texts[i]):
            yield int(i), texts[i]


def _finish(t: pa.Table, starts: dict[int, np.ndarray], plan: W.Plan) -> pa.Table:
    size, spans, kept = [], [], []
    for i, b in enumerate(_text_bytes(t)):
        size.append(len(b))
        cut = W.covered(starts[i], plan.win) if i in starts else np.zeros((0, 2), dtype=np.int64)
        spans.append([{"start": int(a), "end": int(e)} for a, e in cut])
        if len(cut):
            keep = np.ones(len(b), dtype=bool)
            for a, e in cut:
                keep[a:e] = False
            b = b[keep]
        kept.append(b.tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": t["doc_id"], "n_bytes": pa.array(size, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


_METHOD = W.Method(_tokens, W.byte_symbols, _pack, _mark, _finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def suffix_dedup(docs: DataFrame, min_bytes: int = 50, **sizes) -> DataFrame:
    """Removes every byte covered by a ``min_bytes`` string that also starts in a document with a smaller id.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    Returns one row per input row: ``doc_id``, ``n_bytes``, ``spans`` (maximal
    removed ranges in the input), ``kept`` (remaining bytes; a cut may fall
    inside a multi-byte character).

    Null and empty texts give zero bytes and no spans.  Rows with the same id
    count as one document, so they take nothing from each other.  A row
    without an id loses what any document with an id has, and is never the reason
    for a removal.  Texts shorter than ``min_bytes`` are left as they are; longer
    ones are taken whole, whatever their length.  An empty table gives no rows.
    """
    k = min(ANCHOR_BYTES, max(1, min_bytes // 2))
    return W.repeated_windows(docs, _METHOD, min_bytes, k, **sizes)


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract over :func:`suffix_dedup`."""
    out = suffix_dedup(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Distributed exchange of repeated windows, shared by the two substring dedups.

The question is always the same: which ``win``-token windows of a document also
start in a document with a smaller id?  Bringing every window together would
ship the corpus ``win`` times, so the exchange works on *anchored runs*:

* every window picks its anchor, the ``k``-gram with the smallest hash inside
  it (leftmost on ties).  Equal windows pick the same anchor at the same offset,
  and consecutive windows mostly pick the same one, so a run of windows is one
  record: an anchor position and the first and last window offset ``d0..d1``;
* pass A sends each batch's distinct anchor hashes (4 bytes each, one per batch
  however many copies it holds) to hash buckets, which answer with the hashes
  that occur in two documents at least;
* pass B sends the text around shared anchors to buckets keyed by the anchor.
  Equal runs of a batch travel once, with the smallest id.  A kernel (the
  operator's own method) answers with one bit per window: a smaller id has it;
* pass C folds the answers and the batch's own copies into covered tokens.

Documents are dealt by a hash of their id into batches of about 8 MB, so no
source, key or group of copies lands in one task.  An anchor found in more than
``hot`` batches, or with more than ``hot_runs`` different runs, is dealt window by
window instead, keyed by the whole window: a line that a third of all documents
share is then one row per batch, and its unique surroundings spread over all
buckets.  Nothing is capped or sampled.  Batches and buckets are tasks of their
own, as many as the text asks for.

Runs of one batch are grouped by a 64-bit hash and then compared token by token
(``_verified``); windows of different batches are compared by the kernel itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, n_partitions, volume

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_POS_BITS = 20
CHUNK = 1 << 19
NO_ID = np.iinfo(np.int64).max
_SYM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWS.get("p", ())) < n:
        size = max(n, CHUNK + 4096)
        for key, base in (("p", _R), ("i", _RINV)):
            a = np.full(size, U(base), dtype=np.uint64)
            a[0] = 1
            _POWS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWS["p"], _POWS["i"]


class RangeHash:
    """Hash of any range of a symbol array, equal for equal contents."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self.inv = _powers(n + 1)
        self.pre = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * p[:n], out=self.pre[1:], dtype=np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.pre[end] - self.pre[start]) * self.inv[start]
        return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        h = self.pre[k:] - self.pre[:-k]
        h *= self.inv[: len(h)]
        return mix(h)


def byte_symbols(b: np.ndarray) -> np.ndarray:
    return _SYM[b]


def slide_min(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


@dataclass(frozen=True)
class Plan:
    """Geometry of the windows and the sizes of the exchange."""

    win: int
    k: int
    buckets: int
    hot: int
    hot_runs: int = 1 << 16

    @property
    def left(self) -> int:
        return self.win - self.k

    @property
    def width(self) -> int:
        return 2 * self.win - self.k

    @property
    def words(self) -> int:
        """64-bit words of a record's mask: a bit for each window offset."""
        return self.left // 64 + 1


@dataclass
class Runs:
    """Anchored runs of one chunk; positions are in the chunk."""

    doc: np.ndarray  # index of the document in its batch
    pos: np.ndarray  # anchor
    d0: np.ndarray  # first and last window: start = pos - left + d
    d1: np.ndarray
    anchor: np.ndarray  # hash of the anchor's k-gram
    hash: RangeHash
    tokens: np.ndarray
    base: np.ndarray  # document position of chunk position 0, per run


def chunks(token_lists: Iterator[tuple[int, np.ndarray]], win: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, document indices, their starts in the chunk, their offsets in the document).

    Documents longer than a chunk are cut with ``win - 1`` tokens of overlap, so
    each window lies in one piece whole, and no text is too long.
    """
    parts, idx, off, size = [], [], [], 0
    for i, t in token_lists:
        for s in range(0, max(1, len(t) - win + 1), CHUNK):
            piece = t[s : s + CHUNK + win - 1]
            if len(piece) < win:
                continue
            if size and size + len(piece) > CHUNK:
                yield _chunk(parts, idx, off)
                parts, idx, off, size = [], [], [], 0
            parts.append(piece)
            idx.append(i)
            off.append(s)
            size += len(piece)
    if parts:
        yield _chunk(parts, idx, off)


def _chunk(parts, idx, off):
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.concatenate(parts), np.array(idx), starts, np.array(off, dtype=np.int64)


def runs_of(tokens, idx, starts, off, symbols: Callable, plan: Plan) -> Runs:
    h = RangeHash(symbols(tokens))
    g = h.grams(plan.k)
    key = (g & ~U((1 << _POS_BITS) - 1)) | np.arange(len(g), dtype=np.uint64)
    best = slide_min(key, plan.win - plan.k + 1)  # one for each window start
    ok = np.ones(len(best), dtype=bool)
    for e in starts[1:-1]:  # windows that cross into the next document
        ok[max(0, e - plan.win + 1) : e] = False
    s = np.flatnonzero(ok)
    at = (best[s] & U((1 << _POS_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])) if len(s) else np.zeros(0, dtype=np.int64)
    last = np.append(new[1:], len(s)) - 1 if len(new) else new
    pos = at[new]
    d0, d1 = s[new] - pos + plan.left, s[last] - pos + plan.left
    part = np.searchsorted(starts, pos, "right") - 1
    return Runs(idx[part], pos, d0, d1, g[pos], h, tokens, off[part] - starts[part])


def run_key(r: Runs, plan: Plan, pick=slice(None)) -> np.ndarray:
    """Equal for runs of equal text and equal window offsets."""
    s = r.pos[pick] - plan.left + r.d0[pick]
    e = r.pos[pick] - plan.left + r.d1[pick] + plan.win
    return mix(r.hash(s, e) ^ (r.d0[pick].astype(np.uint64) << U(32)) ^ (r.d1[pick].astype(np.uint64) << U(48)))


def windows_of(r: Runs, plan: Plan, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of the picked runs: its run, its offset d, its key."""
    n = (r.d1[pick] - r.d0[pick] + 1).astype(np.int64)
    run = np.repeat(pick, n)
    d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + r.d0[run]
    s = r.pos[run] - plan.left + d
    return run, d, mix(r.hash(s, s + plan.win) ^ (d.astype(np.uint64) << U(32)) ^ U(1))


#: Bits 0 to k - 1, for k up to 64.
_LOW = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)


def span_masks(d0: np.ndarray, d1: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` mask words for each pair of first and last offset."""
    at = 64 * np.arange(words)
    low = lambda d: _LOW[np.clip(d[:, None] - at, 0, 64)]
    return low(d1 + 1) & ~low(d0)


@dataclass
class Batch:
    """The runs of a batch, those of hot anchors window by window; positions are in ``tokens``."""

    tokens: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    base: np.ndarray  # document position of position 0 of ``tokens``, per row
    d0: np.ndarray
    d1: np.ndarray
    anchor: np.ndarray
    signed: np.ndarray  # what pass A knows the anchor by
    key: np.ndarray  # equal for rows of equal text and offsets, and for no others
    route: np.ndarray  # what the bucket is chosen by


def batch_of(method: Method, t: pa.Table, plan: Plan, hots: np.ndarray) -> Batch | None:
    """None if no document has a window."""
    salt = 0
    while True:
        parts, texts, size = [], [], 0
        for c in chunks(method.tokens(t), plan.win):
            r = runs_of(*c, method.symbols, plan)
            if salt:  # anchors stay as they are
                r.hash = RangeHash(mix(method.symbols(r.tokens) + U(salt)))
            signed = sign(r.anchor, plan.buckets)
            is_hot = np.isin(signed, hots) if len(hots) else np.zeros(len(r.pos), dtype=bool)
            cold = np.flatnonzero(~is_hot)
            run, d, wkey = windows_of(r, plan, np.flatnonzero(is_hot))
            pick = np.concatenate([cold, run])
            key = np.concatenate([run_key(r, plan, cold), wkey])
            route = np.concatenate([r.anchor[cold], wkey])
            parts.append((r.doc[pick], r.pos[pick] + size, r.base[pick] - size, np.concatenate([r.d0[cold], d]), np.concatenate([r.d1[cold], d]), r.anchor[pick], signed[pick], key, route))
            texts.append(r.tokens)
            size += len(r.tokens)
        if not parts:
            return None
        b = Batch(np.concatenate(texts), *[np.concatenate(c) for c in zip(*parts)])
        if _verified(b, plan):
            return b
        salt += 1  # two different texts met in 64 bits: hash the batch anew; passes B and C come to the same salt


def _verified(b: Batch, plan: Plan, block: int = 1 << 15) -> bool:
    """Whether rows of equal keys are equal token by token."""
    order = np.argsort(b.key, kind="stable")
    k = b.key[order]
    again = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.zeros(0, dtype=bool)
    head = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(k))))][again]
    row = order[again]
    if (b.d0[row] != b.d0[head]).any() or (b.d1[row] != b.d1[head]).any():
        return False
    col = np.arange(plan.width)
    for lo in range(0, len(row), block):
        x, y = row[lo : lo + block], head[lo : lo + block]
        inside = (col >= b.d0[x][:, None]) & (col < (b.d1[x] + plan.win)[:, None])
        at = lambda i: np.clip(b.pos[i][:, None] - plan.left + col, 0, len(b.tokens) - 1)
        if ((b.tokens[at(x)] != b.tokens[at(y)]) & inside).any():
            return False
    return True


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def sign(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 31 more bits of a hash, lowest bit set: what pass A tells anchors apart by.

    Two anchors of a bucket that agree in it only cost records that pass B finds unequal.
    """
    return (bucket_of(h, n).astype(np.uint64) << U(32)) | (h & U(0xFFFFFFFE)) | U(1)


def _first(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the index of a row with the smallest id of each, the smallest id for each row."""
    order = np.lexsort((ids, keys))
    k = keys[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    least = np.empty(len(ids), dtype=np.int64)
    least[order] = np.repeat(ids[order][new], np.diff(np.append(new, len(k))))
    return k[new], order[new], least


def _ids(t: pa.Table) -> np.ndarray:
    return t["doc_id"].cast(pa.int64()).fill_null(NO_ID).to_numpy()


def by_id(t: pa.Table) -> np.ndarray:
    """Rows in ascending order of id; rows without one come last."""
    return np.argsort(_ids(t), kind="stable")


def _blob(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)


ANCHORS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("data", pa.binary()), ("n", pa.int64())])
ANSWERS = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
RECORDS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
DDL = {"anchors": "bucket long, batch long, data binary, n long", "answers": "batch long, kind int, data binary", "records": "bucket long, batch long, kind int, n long, data binary"}


@dataclass(frozen=True)
class Method:
    """What an operator brings: its tokens, its record bodies, its kernel, its output."""

    tokens: Callable  # (pa.Table) -> iterator of (row, token array), by ascending id
    symbols: Callable  # token array -> uint64 symbols
    pack: Callable  # (Batch, picked rows, d0, d1, Plan) -> bytes of a slice of the records
    kernel: Callable  # (list of (n, body), d0, d1, ids, anchors, Plan) -> masks, a row of Plan.words each
    finish: Callable  # (pa.Table, {document index: covered window starts}, Plan) -> pa.Table
    schema: str
    anchored: bool = False  # whether the kernel wants the anchors' hashes


def _anchors(method: Method, plan: Plan):
    def fn(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _blob([], ANCHORS)
        ids, found, docs, keys = _ids(t), [], [], []
        for c in chunks(method.tokens(t), plan.win):
            r = runs_of(*c, method.symbols, plan)
            found.append(sign(r.anchor, plan.buckets))
            docs.append(ids[r.doc])
            keys.append(run_key(r, plan))
        if not found:
            return _blob([], ANCHORS)
        a, d, k = np.concatenate(found), np.concatenate(docs), np.concatenate(keys)
        order = np.lexsort((k, a))
        a, d, k = a[order], d[order], k[order]
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        differ = np.concatenate([[True], (a[1:] != a[:-1]) | (k[1:] != k[:-1])])
        runs = np.minimum(np.add.reduceat(differ.astype(np.int64), new), 0xFFFF)  # an upper limit needs no exact count
        one = np.minimum.reduceat(d, new) == np.maximum.reduceat(d, new)
        a = a[new] - one.astype(np.uint64)  # lowest bit: two documents of this batch have it
        b = (a >> U(32)).astype(np.int64)
        cut = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b))
        batch, a, runs = t["batch"][0].as_py(), a.astype(np.uint32), runs.astype(np.uint16)
        zip_ = zstandard.ZstdCompressor(level=1)
        return _blob([(int(b[i]), batch, a[i:j].tobytes() + zip_.compress(runs[i:j].tobytes()), int(j - i)) for i, j in zip(cut[:-1], cut[1:])], ANCHORS)

    return fn


def _shared(plan: Plan):
    def fn(t: pa.Table) -> pa.Table:
        unzip, data, sizes = zstandard.ZstdDecompressor(), t["data"].to_pylist(), t["n"].to_pylist()
        batch, bucket = np.repeat(t["batch"].to_numpy(), sizes), t["bucket"][0].as_py()
        a = np.concatenate([np.frombuffer(x, dtype=np.uint32, count=m) for x, m in zip(data, sizes)])
        runs = np.concatenate([np.frombuffer(unzip.decompress(memoryview(x)[4 * m :]), dtype=np.uint16) for x, m in zip(data, sizes)])
        key = a | np.uint32(1)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.append(new, len(k)))
        many = np.maximum.reduceat((a[order] & np.uint32(1)).astype(np.uint8), new)
        wide = np.add.reduceat(runs[order].astype(np.int64), new) > plan.hot_runs
        out = np.repeat((n > 1) | (many > 0), n)
        word = k - np.repeat((n <= plan.hot) & ~wide, n).astype(np.uint32)  # lowest bit: dealt by window
        word, where = word[out], batch[order][out]
        by = np.argsort(where, kind="stable")
        word, where = word[by], where[by]
        if not len(word):
            return _blob([], ANSWERS)
        cut = np.append(np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])), len(where))
        return _blob([(int(where[i]), bucket, word[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])], ANSWERS)

    return fn


_HEAD = (("key", np.uint64), ("id", np.int64), ("d0", np.uint16), ("d1", np.uint16), ("anchor", np.uint64))


def _planes(a: np.ndarray) -> bytes:
    """The numbers byte by byte, so that bytes of like rank stand together and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(data, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(width, n).T).view(dtype).reshape(n)


def _head(method: Method):
    return _HEAD if method.anchored else _HEAD[:-1]


def _records(method: Method, plan: Plan):
    head = _head(method)

    def fn(docs: pa.Table, right: pa.Table) -> pa.Table:
        if not docs.num_rows or not right.num_rows:
            return _blob([], RECORDS)
        words = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint32) | U(b << 32) for b, x in zip(right["kind"].to_pylist(), right["data"].to_pylist())]))
        known, hots = words | U(1), words[(words & U(1)).astype(bool)]
        ids, batch, rows = _ids(docs), docs["batch"][0].as_py(), []
        zip_ = zstandard.ZstdCompressor(level=3)
        b = batch_of(method, docs, plan, hots)
        if b is None:
            return _blob([], RECORDS)
        at = np.minimum(np.searchsorted(known, b.signed), len(known) - 1)
        mine = np.flatnonzero(known[at] == b.signed)
        uniq, first, _ = _first(b.key[mine], ids[b.doc[mine]])
        pick = mine[first]
        place = bucket_of(b.route[pick], plan.buckets)
        order = np.argsort(place, kind="stable")
        place, pick, uniq = place[order], pick[order], uniq[order]
        cols = {"key": uniq, "id": ids[b.doc[pick]], "d0": b.d0[pick].astype(np.uint16), "d1": b.d1[pick].astype(np.uint16), "anchor": b.anchor[pick]}
        cut = np.append(np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), len(place)) if len(place) else [0]
        for i, j in zip(cut[:-1], cut[1:]):
            body = method.pack(b, pick[i:j], b.d0[pick[i:j]], b.d1[pick[i:j]], plan)
            rows.append((int(place[i]), batch, 0, int(j - i), zip_.compress(b"".join(_planes(cols[c][i:j].astype(kind)) for c, kind in head) + body)))
        if len(hots):  # pass C must know which anchors went window by window
            rows.append((batch % plan.buckets, batch, 1, len(hots), hots.tobytes()))
        return _blob(rows, RECORDS)

    return fn


def _answers(method: Method, plan: Plan):
    head = _head(method)

    def fn(t: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        out, bodies, batches = [], [], []
        found: dict[str, list] = {c: [] for c, _ in head}
        for batch, kind, n, data in zip(t["batch"].to_pylist(), t["kind"].to_pylist(), t["n"].to_pylist(), t["data"].to_pylist()):
            if kind:
                out.append((batch, 2, data))
                continue
            data, at = memoryview(unzip.decompress(data)), 0
            for c, dtype in head:
                found[c].append(_unplanes(data[at:], dtype, n))
                at += n * np.dtype(dtype).itemsize
            bodies.append((n, data[at:]))
            batches.append(np.full(n, batch))
        if bodies:
            rec, batch = {c: np.concatenate(x) for c, x in found.items()}, np.concatenate(batches)
            mask = method.kernel(bodies, rec["d0"].astype(np.int64), rec["d1"].astype(np.int64), rec["id"], rec.get("anchor"), plan)
            keep = np.flatnonzero(mask.any(axis=1))
            keep = keep[np.argsort(batch[keep], kind="stable")]
            if len(keep):
                where = batch[keep]
                cut = np.append(np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])), len(where))
                both = np.column_stack([rec["key"][keep], mask[keep]])
                out += [(int(where[i]), 1, both[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
        return _blob(out, ANSWERS)

    return fn


def _apply(method: Method, plan: Plan):
    def fn(docs: pa.Table, right: pa.Table) -> pa.Table:
        hots, found = [np.zeros(0, dtype=np.uint64)], [np.zeros((0, 1 + plan.words), dtype=np.uint64)]
        for kind, data in zip(right["kind"].to_pylist(), right["data"].to_pylist()):
            a = np.frombuffer(data, dtype=np.uint64)
            if kind == 2:
                hots.append(a)
            else:
                found.append(a.reshape(-1, 1 + plan.words))
        both = np.concatenate(found)
        both = both[np.argsort(both[:, 0], kind="stable")]
        keys, masks = both[:, 0], both[:, 1:]
        ids, starts = _ids(docs), {}
        b = batch_of(method, docs, plan, np.concatenate(hots)) if docs.num_rows else None
        if b is not None:
            mine = ids[b.doc]
            _, _, least = _first(b.key, mine)
            mask = span_masks(b.d0, b.d1, plan.words)
            answer = np.zeros_like(mask)
            if len(keys):
                j = np.minimum(np.searchsorted(keys, b.key), len(keys) - 1)
                answer = np.where((keys[j] == b.key)[:, None], masks[j], U(0))
            mask &= np.where((mine > least)[:, None], ~U(0), answer)
            hit = np.flatnonzero(mask.any(axis=1))
            if len(hit):
                bits = np.unpackbits(mask[hit].astype("<u8").view(np.uint8), axis=1, bitorder="little")
                row, d = np.nonzero(bits)
                row = hit[row]
                who, s = b.doc[row], b.pos[row] - plan.left + b.base[row] + d
                order = np.lexsort((s, who))
                who, s = who[order], s[order]
                cut = np.append(np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])), len(who))
                starts = {int(who[i]): s[i:j] for i, j in zip(cut[:-1], cut[1:])}
        out = method.finish(docs, starts, plan)
        return out.append_column("carry", docs["carry"]) if "carry" in docs.column_names else out

    return fn


def _tidy(fn: Callable) -> Callable:
    """The function, with the memory of a group given back before the next one comes; it takes one table or two."""

    def one(t: pa.Table) -> pa.Table:
        out = fn(t)
        hand_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        hand_back()
        return out

    return one if fn.__code__.co_argcount == 1 else two


def covered(starts: np.ndarray, win: int) -> np.ndarray:
    """Maximal covered ranges [start, end) of windows that begin at the sorted ``starts``."""
    s = np.unique(starts)
    new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + win]))
    return np.stack([s[new], s[np.append(new[1:], len(s)) - 1] + win], axis=1)


def repeated_windows(
    docs: DataFrame, method: Method, win: int, k: int, *, batch_bytes: int = 8 << 20, bucket_bytes: int = 4 << 20, hot: int = 256, hot_runs: int = 1 << 16, carry: bool = False
) -> DataFrame:
    """Runs the exchange; ``docs`` has ``doc_id`` (long) and ``text`` (string).

    With ``carry`` each row's other columns come along as the struct ``carry``.
    """
    if not 1 <= win < 1 << 14:
        raise ValueError(f"a window has 1 to {(1 << 14) - 1} tokens, not {win}")
    spark = docs.sparkSession
    size = volume(docs)
    n = max(n_partitions(spark), size // batch_bytes + 1)
    plan = Plan(win, k, max(n_partitions(spark), size // bucket_bytes + 1), hot, hot_runs)
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("carry")] if others else []
    schema = method.schema + (f", carry {docs.select(*rest).schema[0].dataType.simpleString()}" if others else "")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest).withColumn(
        "batch", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(n))
    ).repartition(n, "batch")
    by_batch = lambda df: df.repartition(n, "batch").groupBy("batch")
    by_bucket = lambda df: df.repartition(plan.buckets, "bucket").groupBy("bucket")
    anchors = dealt.groupBy("batch").applyInArrow(_tidy(_anchors(method, plan)), DDL["anchors"])
    shared = by_bucket(anchors).applyInArrow(_tidy(_shared(plan)), DDL["answers"])
    records = dealt.groupBy("batch").cogroup(by_batch(shared)).applyInArrow(_tidy(_records(method, plan)), DDL["records"])
    answers = by_bucket(records).applyInArrow(_tidy(_answers(method, plan)), DDL["answers"])
    return dealt.groupBy("batch").cogroup(by_batch(answers)).applyInArrow(_tidy(_apply(method, plan)), schema)

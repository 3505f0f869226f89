"""Repeated word passages, found with suffix automata of reference shards.

Method: the passages that anchors say may repeat (``windows``) are cut into
reference shards.  A shard's distinct passages go into one suffix automaton
whose states carry the smallest document id of their occurrences; the passages
of the documents are then streamed through it, and wherever the matching
statistic reaches the threshold, the state for the last ``win`` words says
whether a smaller id has them.

The shards' automata together grow with the corpus, so they have no proven size
bound and are not broadcast to every executor: a passage is dealt to the one
shard that can hold its matches, and the automaton is built where they meet.
Shards hold at most ``SHARD_SYMBOLS`` symbols (one anchor's passages stay
together), so an automaton fits in a task whatever the corpus size: an anchor with
more than ``HOT_RUNS`` different passages is dealt window by window instead.

Words are compared by a 64-bit hash, passages by all their words' hashes, so two
passages are taken for one only if they differ in words whose hashes collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

ANCHOR_WORDS = 16
#: Symbols of one automaton, about 60 MB of it.
SHARD_SYMBOLS = 1 << 17
#: Different passages around one anchor above which they are dealt by window.
HOT_RUNS = 1 << 11
#: Before and after a passage's words in a record; no word hashes to it (hashes are odd).
PAD = 0


class SuffixAutomaton:
    """Of a set of strings; each state has the smallest id among its occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [W.NO_ID]

    def add(self, string, doc_id: int) -> None:
        nxt, link, length, least = self.next, self.link, self.len, self.least
        last = 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self._clone(last, c, q)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(W.NO_ID)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            if doc_id < least[last]:
                least[last] = doc_id

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.least.append(W.NO_ID)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def seal(self) -> None:
        """Passes ids up the suffix links: a state then knows the smallest id of all its occurrences."""
        link, least = self.link, self.least
        for s in sorted(range(1, len(link)), key=self.len.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def stream(self, string, threshold: int):
        """For each position with a match of ``threshold`` symbols or more: (position, smallest id that has the last ``threshold``)."""
        nxt, link, length, least = self.next, self.link, self.len, self.least
        state = matched = 0
        for i, c in enumerate(string):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= threshold:
                while length[link[state]] >= threshold:
                    state = link[state]
                    matched = length[state]
                yield i, least[state]


def _mark(bodies, d0, d1, ids, anchors, plan: W.Plan) -> np.ndarray:
    """One bit for each window of each record: a smaller id has the same window."""
    width = plan.width - plan.k + 1  # the anchor's words are one symbol
    rows = np.concatenate([_unpack(n, b, width) for n, b in bodies])
    # equal records of several batches meet here; the automaton takes each once, with its smallest id
    key = _classes(rows)
    uniq, first, least = W._first(key, ids)
    mask = np.where((ids > least)[:, None], W.span_masks(d0, d1, plan.words), W.U(0))
    first = first[np.argsort(anchors[first], kind="stable")]
    found = np.zeros((len(first), plan.words), dtype=np.uint64)
    size = (d1 - d0)[first] + plan.win - plan.k + 1
    lo = 0
    while lo < len(first):
        hi, total = lo, 0
        while hi < len(first) and (total < SHARD_SYMBOLS or anchors[first[hi]] == anchors[first[hi - 1]]):
            total += int(size[hi])
            hi += 1
        found[lo:hi] = _shard(rows, first[lo:hi], d0, size[lo:hi], ids, plan)
        lo = hi
    answer = np.zeros((len(uniq), plan.words), dtype=np.uint64)
    answer[np.searchsorted(uniq, key[first])] = found
    return mask | answer[np.searchsorted(uniq, key)]


def _classes(rows: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows and for no others."""
    key = W.mix((rows * W._powers(rows.shape[1])[0][: rows.shape[1]]).sum(axis=1, dtype=np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    if (rows[order[again]] != rows[order[again - 1]]).any():  # different rows met in 64 bits
        key = np.unique(np.ascontiguousarray(rows).view(f"V{rows.dtype.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1].astype(np.uint64)
    return key


def _shard(rows, pick, d0, size, ids, plan: W.Plan) -> np.ndarray:
    out = np.zeros((len(pick), plan.words), dtype=np.uint64)
    strings = [rows[i, a : a + n].tolist() for i, a, n in zip(pick, d0[pick], size)]
    sam = SuffixAutomaton()
    for i, s in zip(pick, strings):
        sam.add(s, int(ids[i]))
    sam.seal()
    need = plan.win - plan.k + 1
    for j, (i, s) in enumerate(zip(pick, strings)):
        bits, mine, shift = 0, int(ids[i]), int(d0[i]) - need + 1
        for end, least in sam.stream(s, need):
            if least < mine:
                bits |= 1 << (end + shift)
        out[j] = [bits >> 64 * w & 0xFFFFFFFFFFFFFFFF for w in range(plan.words)]
    return out


def _pack(r: W.Batch, pick, d0, d1, plan: W.Plan) -> bytes:
    """Word hashes with the anchor as one symbol, as a dictionary of the slice and indices into it."""
    right = np.arange(plan.k, plan.k + plan.left)
    at = r.pos[pick][:, None] + np.concatenate([np.arange(-plan.left, 1), right])
    rows = r.tokens[np.clip(at, 0, len(r.tokens) - 1)]
    col = at - r.pos[pick][:, None] + plan.left
    rows[(col < d0[:, None]) | (col >= (d1 + plan.win)[:, None])] = PAD
    rows[:, plan.left] = r.anchor[pick] | W.U(1)
    words, index = np.unique(rows, return_inverse=True)
    small = len(words) < 1 << 16
    return np.array([len(words)], dtype=np.int64).tobytes() + words.tobytes() + index.astype(np.uint16 if small else np.uint32).tobytes()


def _unpack(n: int, body, width: int) -> np.ndarray:
    m = int(np.frombuffer(body, dtype=np.int64, count=1)[0])
    words = np.frombuffer(body, dtype=np.uint64, offset=8, count=m)
    index = np.frombuffer(body, dtype=np.uint16 if m < 1 << 16 else np.uint32, offset=8 + 8 * m)
    return words[index].reshape(n, width)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes (odd) of the words between ASCII white space."""
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    parts = []
    for lo, hi in _pieces(b):
        x = b[lo:hi]
        gap = np.concatenate([[True], _SPACE[x], [True]])
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])
        parts.append(W.RangeHash(W.byte_symbols(x))(start, end) | W.U(1))
    return np.concatenate(parts)


def _pieces(b: np.ndarray, size: int = 1 << 20):
    """Ranges of about ``size`` bytes that end at white space; a longer word stays whole."""
    lo = 0
    while lo < len(b):
        hi = min(len(b), lo + size)
        while hi < len(b) and not _SPACE[b[hi]]:
            hi += 1
        yield lo, hi
        lo = hi


def _bytes(t: pa.Table):
    from .suffix_dedup import _text_bytes

    return _text_bytes(t)


def _tokens(t: pa.Table):
    texts = _bytes(t)
    for i in W.by_id(t):
        h = word_hashes(texts[i])
        if len(h):
            yield int(i), h


def _finish(t: pa.Table, starts: dict[int, np.ndarray], plan: W.Plan) -> pa.Table:
    n_words, spans, kept = [], [], []
    for i, b in enumerate(_bytes(t)):
        words = b.tobytes().split()
        n_words.append(len(words))
        cut = W.covered(starts[i], plan.win) if i in starts else np.zeros((0, 2), dtype=np.int64)
        spans.append([{"start": int(a), "end": int(e)} for a, e in cut])
        for a, e in cut[::-1]:
            del words[a:e]
        kept.append(b" ".join(words))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": t["doc_id"], "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


_METHOD = W.Method(_tokens, lambda h: h, _pack, _mark, _finish, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string", anchored=True)


def automaton_dedup(docs: DataFrame, min_words: int = 50, **sizes) -> DataFrame:
    """Removes every word covered by a ``min_words`` passage that also starts in a document with a smaller id.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    Words are runs of characters other than ASCII white space, unchanged, and
    are compared by a 64-bit hash.  Returns one row per input row: ``doc_id``,
    ``n_words``, ``spans`` (maximal removed word ranges), ``kept`` (remaining
    words, joined by one space).

    Null, empty and white texts have no words and an empty ``kept``.  Rows with
    the same id count as one document.  A row without an id loses what any
    document with an id has and is never the reason for a removal.  Texts of any
    length are taken whole.  An empty table gives no rows.
    """
    k = min(ANCHOR_WORDS, max(1, min_words // 2))
    return W.repeated_windows(docs, _METHOD, min_words, k, **{"hot_runs": HOT_RUNS, **sizes})


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract over :func:`automaton_dedup`."""
    out = automaton_dedup(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

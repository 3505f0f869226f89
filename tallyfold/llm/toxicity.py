"""Toxicity by compression distance of windows.

Method: two zstandard dictionaries are trained, one on toxic and one on ordinary
text.  A text's running words are cut into short windows, each window is
compressed under both, and the difference of the two lengths says which kind of
text it is closer to.  Every window is followed by the same run of ``PAD``, which
compresses to nothing and keeps the coder from storing a short window raw, so
that savings of a few bytes show.  The excess of the differences over a
threshold, their largest, and the number and share of windows past it go through
a logistic calibration.

Labels mark whole documents, most of whose windows are ordinary.  The toxic
dictionary is therefore trained on the windows of toxic documents that hold a
substring which toxic documents have far more often (a likelihood-ratio test);
the ordinary one on windows of ordinary documents.  The calibration and its
threshold come from rows that their dictionaries haven't seen: each half of the
sample is judged by dictionaries of the other half.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .compression import SAMPLE_ROWS, Coder, fit_logistic, labelled_sample, logistic, one_of_each_copy

#: Bytes of running words in a window, about; a longer word is a window of its own.
SPAN = 8
#: Bytes of the overlapping windows of a word without end, as in scripts without spaces.
WINDOW = 64
PAD = b"\n" * 64
GRAM = 6
#: Evidence that a substring must have, as twice its log likelihood ratio, and times its share in ordinary text.
EVIDENCE, TIMES = 24.0, 3.0
#: Sizes of the two dictionaries, and the bytes of ordinary windows that theirs is trained on, at most.
TOXIC_BYTES, ORDINARY_BYTES, TRAINING_BYTES = 8 << 10, 110 << 10, 4 << 20
#: Windows joined to one training sample, and the segment and probe lengths of the trainer.
JOINED, SEGMENT, PROBE = 8, 48, 6
LEVEL = 7
#: Windows that a task remembers the difference of.
CACHE_WINDOWS = 600_000
THRESHOLDS = (1, 2, 3, 4, 5, 6)
THRESHOLD = 0.5
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def pieces(word: bytes) -> list[bytes]:
    """A word shorter than a window, or the overlapping windows of a longer one."""
    if len(word) < WINDOW:
        return [word]
    last = len(word) - WINDOW
    return [word[i : i + WINDOW] for i in sorted({*range(0, last, WINDOW // 2), last})]


def units(text: bytes) -> list[bytes]:
    words = words_of(text)
    if not words or max(map(len, words)) < WINDOW:
        return words
    return [p for w in words for p in pieces(w)]


def windows(text: bytes) -> list[bytes]:
    """The text's words in order, as many to a window as ``SPAN`` holds and one at least, with a space before and after."""
    out, now, size = [], [], 0
    for w in units(text):
        if len(w) >= WINDOW:
            if now:
                out.append(b" " + b" ".join(now) + b" ")
                now, size = [], 0
            out.append(w)
            continue
        if now and size + 1 + len(w) > SPAN:
            out.append(b" " + b" ".join(now) + b" ")
            now, size = [], 0
        now.append(w)
        size += 1 + len(w)
    if now:
        out.append(b" " + b" ".join(now) + b" ")
    return out


def _marked(window: bytes, marks: set[bytes]) -> set[bytes]:
    """The stretches of a window of a long word that the marks cover."""
    out, start, end = set(), 0, 0
    for i in range(len(window) - GRAM + 1):
        if window[i : i + GRAM] in marks:
            if i > end:
                out.add(window[start:end])
                start = i
            elif end == 0:
                start = i
            end = i + GRAM
    return (out | {window[start:end]}) - {b""}


def _grams(word: bytes) -> set[bytes]:
    """Substrings of a word with its ends; a short word is one of its own, and a window of a long word has no ends."""
    w = word if len(word) >= WINDOW else (b" " + word + b" ").ljust(GRAM)
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def _ratio(a: int, b: int, n: int, m: int) -> float:
    """Twice the log likelihood ratio of a of n against b of m."""
    k, t = a + b, n + m
    part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
    return 2 * (part(a, k * n / t) + part(b, k * m / t) + part(n - a, (t - k) * n / t) + part(m - b, (t - k) * m / t))


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: int = 2
    calibration: tuple | None = None
    prior: float = 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; what it remembers of windows only saves time and changes no result."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.coders = tuple(Coder(d, LEVEL, raw=not d.startswith(_MAGIC), thorough=True) for d in (model.ordinary, model.toxic)) if model.toxic else None

    def differences(self, text: bytes) -> np.ndarray:
        """Bytes that each window costs more under the ordinary dictionary than under the toxic one."""
        parts = windows(text)
        if not self.coders:
            return np.zeros(len(parts), dtype=np.int64)
        seen, (ordinary, toxic) = self.seen, self.coders
        if len(seen) >= CACHE_WINDOWS:
            seen.clear()
        out = np.empty(len(parts), dtype=np.int64)
        for i, w in enumerate(parts):
            d = seen.get(w)
            if d is None:
                d = seen[w] = ordinary(w + PAD) - toxic(w + PAD)
            out[i] = d
        return out

    def score(self, text: bytes) -> float:
        return self.judge(text)[0]

    def judge(self, text: bytes) -> tuple[float, int]:
        """(score, windows past the threshold)."""
        d = self.differences(text)
        hits = int((d > self.model.threshold).sum())
        if self.model.calibration is None:
            return self.model.prior, hits
        return float(logistic(np.array([features(d, self.model.threshold)]), self.model.calibration)[0]), hits


def features(d: np.ndarray, threshold: int) -> tuple[float, float, float, float]:
    over = d[d > threshold]
    if not len(over):
        return 0.0, 0.0, 0.0, 0.0
    return math.log1p(int((over - threshold).sum())), float(over.max()), math.sqrt(len(over) / len(d)), math.log1p(len(over))


_MAGIC = b"\x37\xa4\x30\xec"
_SCORERS: dict[bytes, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer for each Python worker, so that its tasks share what it remembers of windows."""
    key = hashlib.sha256(pickle.dumps(model)).digest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = model.scorer()
    return _SCORERS[key]


def _train(parts: list[bytes], size: int) -> bytes:
    """A dictionary trained on windows; with too few to train on, the windows themselves."""
    joined = [b"".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]
    try:
        return zstandard.train_dictionary(size, joined, k=SEGMENT, d=PROBE, f=20, accel=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(joined)[-size:]


def _marks(texts: list[Counter], y: np.ndarray) -> set[bytes]:
    """Substrings that toxic documents have far more often."""
    n, m = int(y.sum()), int((1 - y).sum())
    df: Counter = Counter()
    for c, v in zip(texts, y):
        if v:
            df.update(set().union(*map(_grams, c)) if c else ())
    df = Counter({g: k for g, k in df.items() if k >= 3})
    other: Counter = Counter()
    for c, v in zip(texts, y):
        if not v:
            other.update({g for w in c for g in _grams(w) if g in df})
    return {g for g, k in df.items() if k * m > TIMES * other[g] * n and _ratio(k, other[g], n, m) > EVIDENCE}


def _dictionaries(texts: list[bytes], y: np.ndarray) -> tuple[bytes, bytes]:
    """(toxic, ordinary), trained on these rows; empty where no substring tells toxic rows."""
    marks = _marks([Counter(units(t)) for t in texts], y)
    toxic, ordinary = [], []
    for t, v in zip(texts, y):
        if not v:
            ordinary += windows(t)
            continue
        for w in windows(t):
            if len(w) >= WINDOW and not w.startswith(b" "):
                toxic += sorted(_marked(w, marks))
            elif any(w[i : i + GRAM] in marks for i in range(len(w) - GRAM + 1)) or (len(w) < GRAM and w.ljust(GRAM) in marks):
                toxic.append(w)
    if not toxic or not ordinary:
        return b"", b""
    step = max(1, sum(map(len, ordinary)) // TRAINING_BYTES)
    return _train(toxic, TOXIC_BYTES), _train(ordinary[::step], ORDINARY_BYTES)


def fit(sample: list[tuple[bytes, int]]) -> Model:
    """Without rows of both labels the model gives each text the share of toxic rows."""
    sample = one_of_each_copy(sample, words_of)
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], dtype=np.float64)
    n = int(y.sum())
    if not n or n == len(y):
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    model = Model(*_dictionaries(texts, y), prior=n / len(y))
    if not model.toxic:
        return model
    half = np.zeros(len(y), dtype=bool)
    for v in (0, 1):
        half[np.flatnonzero(y == v)[::2]] = True
    found: list = [None] * len(y)
    for own in (half, ~half):  # dictionaries of one half judge the other
        scorer = Scorer(Model(*_dictionaries([t for t, k in zip(texts, own) if k], y[own])))
        for i in np.flatnonzero(~own):
            found[i] = scorer.differences(texts[i])
    best = None
    for threshold in THRESHOLDS:  # the one that tells the sample's documents apart best
        x = np.array([features(d, threshold) for d in found])
        cal = fit_logistic(x, y)
        p = np.clip(logistic(x, cal), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = (loss, threshold, cal)
    model.threshold, model.calibration = best[1], best[2]
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", rows))


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` for each row.

    ``n_hits`` is the number of windows past the model's threshold.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    A score depends on the text alone, so repeated rows have equal scores; null,
    empty and white texts have the score of a text without a toxic window.  Long
    texts are scored whole, window by window.  A null id is no learning row and
    has a null ``held_out``.  An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of TOXIC_BYTES and ORDINARY_BYTES

    def run(batches):
        scorer = _scorer(held.value)
        for batch in batches:
            got = [scorer.judge((text or "").encode()) for text in batch.column("text").to_pylist()]
            scores, hits = zip(*got) if got else ((), ())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "held_out", "score", "n_hits"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, held_out boolean, score double, n_hits long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, learn(docs, labels))

"""Language identification by error-correcting output codes.

Method: each language has a codeword; a binary classifier for every bit, linear in
the hashed byte trigrams of a text, says which half of the languages a text
belongs to.  Decoding sums the classifiers' losses, each weighted by its accuracy
on held-back rows, and takes the codeword with the least loss; a small gap to the
second flags the text as ambiguous.

Few languages get the exhaustive code (every split of them is a bit), many get
the random dense code with the largest distance between codewords of a number
of seeded draws.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

DIMENSIONS = 1 << 12
#: Documents that are learned from: of each language at most, and of all languages at most where there are many.
ROWS_PER_LANGUAGE = 500
SAMPLE_ROWS = 8_000
EXHAUSTIVE = 7
AMBIGUOUS = 0.6
UNDETERMINED = "und"
_CHUNK = 1 << 20
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def code_matrix(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of n languages as rows of +1 and -1; no bit is the same for all, or another's complement."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = [[1, *(1 if k >> i & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=np.float64).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(100):
        m = rng.choice([-1.0, 1.0], size=(n, math.ceil(10 * math.log2(n))))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        near = (m @ m.T - 2 * m.shape[1] * np.eye(n)).max()
        if best is None or near / m.shape[1] < best[0]:
            best = (near / m.shape[1], m)
    return best[1]


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed trigrams over the whole text."""
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    b = np.frombuffer(text, dtype=np.uint8)
    for lo in range(0, max(1, len(b) - 2), _CHUNK):
        x = _LOWER[b[lo : lo + _CHUNK + 2]].astype(np.uint32)
        if len(x) > 2:
            code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
            counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    n = counts.sum()
    return np.sqrt(counts / n).astype(np.float32) if n else np.zeros(DIMENSIONS, dtype=np.float32)


def has_letter(text: str) -> bool:
    if text.isascii():
        return any(map(str.isalpha, text))
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    codes: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: np.ndarray | None = None
    trust: np.ndarray | None = None

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each row: the share of the best in the normalised exponential losses."""
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margin = x @ self.weights + self.constant
        # log(1 + e^m) is log(1 + e^-m) + m, so a codeword's loss is a common part and the margins where it says -1
        loss = (np.logaddexp(0, -margin) * self.trust).sum(axis=1, keepdims=True) + (margin * self.trust) @ ((1 - self.codes) / 2).T
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        return best, near[np.arange(len(x)), best] / near.sum(axis=1)


def fit(texts: list[bytes], languages: list[str], steps: int = 80, ridge: float = 1e-4) -> Model:
    return fit_features(np.stack([features(t) for t in texts]) if texts else np.zeros((0, DIMENSIONS), dtype=np.float32), languages, steps, ridge)


def fit_features(x: np.ndarray, languages: list[str], steps: int = 80, ridge: float = 1e-4) -> Model:
    names = sorted(set(languages))
    model = Model(names, code_matrix(len(names)))
    if len(names) < 2:
        return model
    number = {n: i for i, n in enumerate(names)}
    at = np.array([number[v] for v in languages])
    y = ((model.codes[at] + 1) / 2).astype(np.float32)
    share = np.bincount(at, minlength=len(names))
    row = (1 / share[at]) / len(names)  # languages count alike
    back = np.arange(len(x)) % 5 == 4
    for use in (~back, np.ones(len(x), dtype=bool)):  # first to see how far each bit can be trusted, then on all rows
        w, c = np.zeros((DIMENSIONS, y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
        m, s = np.zeros_like(w), np.full_like(w, 1e-8)
        a, t, r = x[use], y[use], (row[use] / row[use].sum()).astype(np.float32)[:, None]
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w + c, -30, 30)))
            err = (p - t) * r
            grad = a.T @ err + np.float32(ridge) * w
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            w -= 0.5 * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(s / (1 - 0.999 ** (k + 1))) + 1e-6)
            c -= err.sum(axis=0)
        model.weights, model.constant = w, c
        if model.trust is None:
            right = (((x[back] @ w + c) > 0) == (y[back] > 0.5)).mean(axis=0) if back.any() else np.ones(y.shape[1])
            model.trust = np.clip(2 * right - 1, 0.05, 1.0)
    return model


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, most_rows: int = SAMPLE_ROWS) -> Model:
    """From at most ``rows`` documents of each language outside the held-out fold, every language among them.

    With so many languages that these would be more than ``most_rows``, each
    gives fewer, one at least.  A language's documents are those with the smallest
    hash of id and text; equal rows take a place each and teach once.  Their texts, of any length, become vectors of
    ``DIMENSIONS`` shares where they are read; only those come to the driver.
    """
    src = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    src = src.filter((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Model()
    each = max(1, min(rows, most_rows // len(counts)))
    draw = F.xxhash64("doc_id", "lang", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    # hashes alone are ranked, per task first so that little is shuffled, and the chosen texts come back by their hash
    chosen = src.select("lang", "doc_id", draw.alias("draw")).withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "draw")
    picked = src.withColumn("draw", draw).join(F.broadcast(chosen), ["lang", "draw"], "left_semi").select("lang", "draw", "text")  # at most most_rows hashes

    def run(batches):
        for batch in batches:
            vectors = [features(t.encode()).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("lang"), batch.column("draw"), pa.array(vectors, pa.binary())], names=["lang", "draw", "x"])

    got = picked.mapInArrow(run, "lang string, draw long, x binary").dropDuplicates(["lang", "draw"]).collect()
    got.sort(key=lambda r: (r.lang, r.draw))
    return fit_features(np.stack([np.frombuffer(r.x, dtype=np.float32) for r in got]), [r.lang for r in got])


def language_id(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for each row.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    The prediction depends on the text alone.  Null texts and texts without a
    letter are ``und`` with score 0, as is every text when nothing could be
    learned.  ``ambiguous``: the score is below the given bound.  A null id has a
    null ``held_out``.  Texts are read whole, however long; equal texts have equal
    predictions; of languages with the same loss the first by name is taken.  An
    empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x bits numbers

    def run(batches):
        m = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and m.languages and has_letter(t)]
            for lo in range(0, len(known), 256):
                part = known[lo : lo + 256]
                best, share = m.decode(np.stack([features(texts[i].encode()) for i in part]))
                score[part] = share
                for i, k in zip(part, best):
                    pred[i] = m.languages[k]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
    return out.withColumn("ambiguous", F.col("score") < ambiguous)


def query(docs: DataFrame) -> DataFrame:
    return language_id(docs, learn(docs))

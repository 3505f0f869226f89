"""Quality score from two compression dictionaries.

Method: zstandard dictionaries are trained on good and on bad labelled text.  A
text is cut into blocks, each block is compressed under both, and the sums'
difference, over the text's length, says which kind of text it is closer to.  A
logistic calibration turns that into a probability.  Beside the difference it sees
the compressed size itself: text that repeats itself leaves both dictionaries
little to do, so the same difference says less about it.  The difference alone
orders texts as well, but puts the threshold of the score in a worse place for
such texts (figures in the README).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .compression import SAMPLE_ROWS, Coder, fit_logistic, labelled_sample, logistic

BLOCK = 1024
DICTIONARY_BYTES = 32 << 10
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    calibration: tuple | None = None
    prior: float = 0.5

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = Coder(model.good), Coder(model.bad)
        self.frame = self.good(b"")  # cost of a frame without text

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        good = bad = 0
        parts = blocks(text)
        for b in parts:
            good += self.good(b)
            bad += self.bad(b)
        return len(text), good - self.frame * len(parts), bad - self.frame * len(parts)

    @staticmethod
    def features(n: int, good: int, bad: int) -> tuple[float, ...]:
        if not n:
            return 0.0, 0.5, 0.25, 0.0
        r = min(good, bad) / n
        return (bad - good) / n, r, r * r, (bad - good) / max(1, min(good, bad))

    def score(self, text: bytes) -> float:
        if self.model.calibration is None:
            return self.model.prior
        return float(logistic(np.array([self.features(*self.sizes(text))]), self.model.calibration)[0])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    samples = [b for t in texts for b in blocks(t)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]


def fit(sample: list[tuple[bytes, int]], dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Half of the sample makes the dictionaries, the other half the calibration, so that it sees unseen text."""
    y = np.array([v for _, v in sample], dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    turn = np.zeros(len(y), dtype=bool)
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        turn[own[::2]] = True
    good = [t for (t, v), k in zip(sample, turn) if k and v]
    bad = [t for (t, v), k in zip(sample, turn) if k and not v]
    if not any(good) or not any(bad):
        return Model(prior=prior)
    model = Model(_dictionary(good, dictionary_bytes), _dictionary(bad, dictionary_bytes), prior=prior)
    scorer = Scorer(model)
    rest = [(t, v) for (t, v), k in zip(sample, turn) if not k]
    if len({v for _, v in rest}) == 2:
        x = np.array([scorer.features(*scorer.sizes(t)) for t, _ in rest])
        model.calibration = fit_logistic(x, np.array([v for _, v in rest], dtype=np.float64))
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(labelled_sample(docs, labels, "quality", rows))


def quality_score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_bytes, good_bytes, bad_bytes`` for each row.

    ``docs``: ``doc_id`` (integer), ``text`` (string); other columns are ignored.
    A score depends on the text alone, so repeated rows score alike.  Null and
    empty texts have no bytes and the score of a text that both dictionaries fit
    alike.  Long texts are compressed whole, block by block.  A null id is no
    learning row and has a null ``held_out``; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            sizes = [scorer.sizes((t or "").encode()) for t in batch.column("text").to_pylist()]
            cal = scorer.model.calibration
            scores = logistic(np.array([scorer.features(*s) for s in sizes]), cal) if cal is not None and sizes else np.full(len(sizes), scorer.model.prior)
            cols = [pa.array([s[i] for s in sizes], pa.int64()) for i in range(3)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), *cols], names=["doc_id", "held_out", "score", "n_bytes", "good_bytes", "bad_bytes"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, held_out boolean, score double, n_bytes long, good_bytes long, bad_bytes long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_bytes", "good_bytes", "bad_bytes")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_score(docs, learn(docs, labels))

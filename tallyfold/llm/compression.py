"""What the two compression classifiers share: labelled samples, dictionary coders, calibration."""

from __future__ import annotations

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Labelled rows that a classifier is fitted on, at most, and the characters of each.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 32 << 10


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> list[tuple[bytes, int]]:
    """(UTF-8 text, label) of the ``rows`` labelled documents of the learning folds with the smallest hash of their id.

    A longer text teaches by a stretch of ``most_chars`` characters at a place
    that its id's hash picks.  At most ``rows`` times ``most_chars`` characters
    come to the driver, however large the tables: an id that stands twice in
    ``labels`` with the same label, or twice in ``documents``, counts once (the
    smallest of its texts).
    """
    marked = labels.filter(F.col(column).isin(0, 1) & (fold() != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).distinct()
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spare = F.greatest(F.length(text) - most_chars, F.lit(0))
    stretch = F.substring(text, F.pmod(F.xxhash64(F.col("doc_id").cast("long")), spare + 1).cast("int") + 1, F.lit(most_chars))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stretch.alias("text"))
    got = found.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y").collect()
    return sorted((r.text.encode(), r.y) for r in got)


#: Seeds of the minhashes that tell copies in a sample.
_COPY_HASHES = np.random.default_rng(3).integers(1, 1 << 31, (6, 2), dtype=np.uint64)


def one_of_each_copy(sample: list[tuple[bytes, int]], words_of) -> list[tuple[bytes, int]]:
    """The sample with one text of each group of copies, so that a text that was copied often is no stronger evidence.

    A text goes if it shares one of six minhashes of word triples with an earlier one.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in sample:
        w = words_of(text)
        h = np.array([zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], dtype=np.uint64)
        keys = {(k, int(((h * (2 * a + 1) + b) & np.uint64(0xFFFFFFFF)).min())) for k, (a, b) in enumerate(_COPY_HASHES)}
        if seen.isdisjoint(keys):
            out.append((text, y))
        seen |= keys
    return out


class Coder:
    """Length of a frame under a fixed dictionary, without checksum, size and dictionary number.

    ``thorough`` searches the dictionary with binary trees for matches from three
    bytes on; the quick matchers overlook short words in it.
    """

    def __init__(self, dictionary: bytes, level: int = 3, raw: bool = False, thorough: bool = False):
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None
        if thorough:
            params = zstandard.ZstdCompressionParameters.from_level(
                level, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=3, target_length=64,
                strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            if data is not None:
                data.precompute_compress(compression_params=params)
            self.compress = zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress
            return
        if data is not None:
            data.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def __call__(self, block: bytes) -> int:
        return len(self.compress(block))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last) by Newton's method; rows of both labels keep their prior."""
    x = np.asarray(x, dtype=np.float64).reshape(len(y), -1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * len(y) * np.append(w[:-1], 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * (ridge * len(y) + 1e-6)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logistic(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    z = ((x - mean) / scale) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

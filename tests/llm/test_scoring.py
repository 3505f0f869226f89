"""Scores of the three text classifiers against plain computations over every document."""

import math
from collections import Counter

import numpy as np
import pytest
import zstandard

from tallyfold.llm import language_id, quality_classifier, toxicity
from tallyfold.llm.compression import Coder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language(tables):
    docs, _ = tables
    model = language_id.learn(docs)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in language_id.language_id(docs, model).collect()}

    def plain(text):
        b = text.encode().lower()
        counts = Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 20) for i in range(len(b) - 2))
        n = sum(counts.values())
        losses = []
        margins = [model.constant[j] + sum(math.sqrt(c / n) * model.weights[k, j] for k, c in counts.items()) for j in range(model.codes.shape[1])]
        for code in model.codes:
            losses.append(sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, code)))
        near = [math.exp(min(losses) - x) for x in losses]
        return model.languages[int(np.argmin(losses))], max(near) / sum(near)

    for doc, text in texts.items():
        if not any(c.isalpha() for c in text):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
        elif len(text) < 3000:
            lang, score = plain(text)
            assert abs(got[doc].score - score) < 2e-3
            assert got[doc].lang_pred == lang or score < 0.51


def test_quality(tables):
    docs, labels = tables
    model = quality_classifier.learn(docs, labels)
    mean, scale, w = model.calibration
    size = lambda block, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))
    frame = size(b"", model.good)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in quality_classifier.quality_score(docs, model).collect()}
    for doc, text in texts.items():
        parts = [text[i : i + 1024] for i in range(0, len(text), 1024)]
        good, bad = (sum(size(p, d) - frame for p in parts) for d in (model.good, model.bad))
        r = min(good, bad) / len(text) if text else 0.5
        x = np.array([(bad - good) / max(1, len(text)), r, r * r, (bad - good) / max(1, min(good, bad)) if text else 0.0])
        z = float(((x - mean) / scale) @ w[:-1] + w[-1])
        assert abs(got[doc].score - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9
        assert (got[doc].n_bytes, got[doc].good_bytes, got[doc].bad_bytes) == (len(text), good, bad)


def test_toxicity(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    texts = {r.doc_id: (r.text or "") for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    if model.calibration is None:
        assert {r.score for r in got.values()} == {model.prior}
        return
    mean, scale, w = model.calibration
    raw = lambda d: not d.startswith(toxicity._MAGIC)
    ordinary, toxic = Coder(model.ordinary, toxicity.LEVEL, raw(model.ordinary), True), Coder(model.toxic, toxicity.LEVEL, raw(model.toxic), True)
    for doc, text in texts.items():
        parts, now = [], b""
        words = text.encode().translate(toxicity._FOLD).split()
        for word in words:
            if now and len(now) + len(word) + 1 > toxicity.SPAN + 1:
                parts.append(now)
                now = b""
            now = now + b" " + word if now else b" " + word
        parts = [p + b" " for p in [*parts, now] if p]
        if any(len(x) >= toxicity.WINDOW for x in words):
            continue
        d = [ordinary(p + toxicity.PAD) - toxic(p + toxicity.PAD) for p in parts]
        over = [x - model.threshold for x in d if x > model.threshold]
        x = [math.log1p(sum(over)), max(over) + model.threshold, math.sqrt(len(over) / len(d)), math.log1p(len(over))] if over else [0.0] * 4
        z = float(((np.array(x) - mean) / scale) @ w[:-1] + w[-1])
        assert abs(got[doc].score - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9 and got[doc].n_hits == len(over)


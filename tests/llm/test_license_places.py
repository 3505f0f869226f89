"""A text with very many places is read whole, in time that grows with the text and not with its square."""

import time

from tallyfold.llm import license_scan

from .test_native import scan


def test_many_places(spark):
    texts = ["cc by nc " * 20_000, "x cc by nc, the mit license; " * 300 + "Apache License Version 2", "cc by nc " * 256, "cc by nc " * 257]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.monotonic()
    got = {r.doc_id: tuple(r)[1:6] for r in license_scan.query(df).collect()}
    assert time.monotonic() - began < 60
    assert got == {i: scan(t) for i, t in enumerate(texts)}

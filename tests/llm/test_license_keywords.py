"""No keyword or mark of the license rules may hide a text that a pattern matches."""

import re
from itertools import product

from tallyfold.llm import license_scan


def words(node):
    """Every string of a parsed pattern of literals, classes, groups, alternatives and options."""
    parts = []
    for op, arg in node:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            parts.append([chr(c) for o, v in arg for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))])
        elif op == "SUBPATTERN":
            parts.append(words(arg[3]))
        elif op == "BRANCH":
            parts.append([w for b in arg[1] for w in words(b)])
        else:
            assert op == "MAX_REPEAT" and arg[:2] == (0, 1), op
            parts.append(["", *words(arg[2])])
    return ["".join(p) for p in product(*parts)]


def test_keywords_and_marks_lose_nothing():
    for r in license_scan.RULES:
        for text in words(re._parser.parse(r.pattern)):
            assert f" {r.keyword}" in f" {text}", (r, text)
            assert any(m in text for m in license_scan.MARKS) or "cc" in text.split(), (r, text)


def test_names_behind_keywords(spark):
    texts = {"licensed under the FreeBSD License": "bsd-2", "licensed under the GPL3": "gpl-3", "Licensed under Apache2": "apache-2", "released under the MPL2 license": "mpl-2", "licensed under the MIT License": "mit", "a license for mitigation": ""}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.labels for r in license_scan.license_scan(df).collect()}
    assert got == texts

"""Quality rules: a learned decision list over native text statistics.

Method: sequential covering.  On labelled documents the driver grows one
conjunction of thresholds at a time (the condition with the best information
gain first), prunes it on rows that growing didn't see, removes what it covers,
and goes on until a rule no longer pays.  The list becomes an ordered Spark
conditional expression, so applying it is a projection inside the scan's stage:
no Python runs on executors and nothing is shuffled.

Learning uses a bounded sample: the ``sample_rows`` labelled documents with the
smallest hash of their id, of the learning folds.  Its size doesn't grow with
the corpus, so the statistics of those rows may come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, fold, settle, unused

#: Labelled documents that a list is learned from, at most.
SAMPLE_ROWS = 4000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_WS = f"[{WS_CLASS}]"
_BLANK = " \t\n\x0b\f\r"

#: Statistics that rules may test; all are shares or plain counts of a whole text.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share")


def base_statistics(docs: DataFrame, text: str = "text", distinct_as: str = "_distinct") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the number of different words (long) to the rows.

    Null texts count as empty: all zero.
    """
    words_, lines_, windows_, again_, placed_, at_ = unused(docs.withColumn(distinct_as, F.lit(0)), "words", "lines", "windows", "again", "placed", "at")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(_BLANK))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    df = docs.withColumns(
        {
            words_: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_WS}+")),
            "word_chars": (F.length(t) - F.regexp_count(t, F.lit(_WS))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            lines_: F.when(F.contains(t, F.lit("\n")), lines),
        }
    )
    words = F.col(words_)
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            distinct_as: F.size(F.array_distinct(words)).cast("long"),
            "n_dup_lines": F.coalesce(F.size(lines_) - F.size(F.array_distinct(lines_)), F.lit(0)).cast("long"),
            windows_: F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))),
        }
    ).drop(lines_, words_)
    # most texts repeat no window; only the others sort theirs with positions
    df = df.withColumn(again_, F.size(F.array_distinct(windows_)) < F.size(windows_))
    placed = F.array_sort(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(placed_, F.when(F.col(again_), placed))
    same = lambda a, b: F.get(placed_, a)["h"] == F.get(placed_, b)["h"]
    twice = F.filter(placed_, lambda p, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    df = df.withColumn(at_, F.when(F.col(again_), F.array_sort(F.transform(twice, lambda p: p["i"]))))
    gaps = F.transform(at_, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at_, k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    df = df.withColumn("n_repeat_words", F.when(F.col(again_), covered).otherwise(F.lit(0)).cast("long")).drop(windows_, again_, placed_, at_)
    return settle(df, distinct_as, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _features(text: str, distinct: str = "_distinct") -> dict[str, Column]:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    words = F.col("n_words")
    return {
        "mean_word": share(F.col("word_chars"), words),
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": share(F.col("n_dup_lines"), F.regexp_count(t, F.lit("\n")) + 1),
        "repeat_share": share(F.col("n_repeat_words"), words),
        "upper_share": share(F.regexp_count(t, F.lit("[A-Z]")), F.col("word_chars")),
        "mark_share": share(F.regexp_count(t, F.lit(r"[!?;:]")), F.col("word_chars")),
        "distinct_share": share(F.col(distinct), words),
    }


@dataclass(frozen=True)
class Test:
    """One threshold: ``feature >= value`` or ``feature < value``."""

    feature: str
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        col = x[:, FEATURES.index(self.feature)]
        return col >= self.value if self.at_least else col < self.value

    def column(self, cols: dict[str, Column]) -> Column:
        c = cols[self.feature]
        return c >= F.lit(self.value) if self.at_least else c < F.lit(self.value)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject a text; what no rule covers is kept."""

    rules: tuple[tuple[Test, ...], ...] = ()

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for rule in self.rules:
            out |= np.all([t.holds(x) for t in rule], axis=0)
        return out

    def column(self, cols: dict[str, Column]) -> Column:
        """Number of the first rule that covers a row (from 1); null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            c = rule[0].column(cols)
            for t in rule[1:]:
                c = c & t.column(cols)
            out = F.when(c, k) if out is None else out.when(c, k)
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        say = lambda t: f"{t.feature} {'>=' if t.at_least else '<'} {t.value:.6g}"
        return "\n".join(" AND ".join(map(say, r)) for r in self.rules)


def _grow(x: np.ndarray, y: np.ndarray, cuts: int, most: int) -> list[Test]:
    inside, rule = np.ones(len(y), dtype=bool), []
    while len(rule) < most and not y[inside].all():
        p, n = y[inside].sum(), (~y[inside]).sum()
        if not p:
            break
        best = (0.0, None)
        for k, name in enumerate(FEATURES):
            col = x[inside, k]
            for v in np.unique(np.quantile(np.concatenate([col, col[y[inside]]]), np.linspace(0, 1, cuts))):
                for at_least in (True, False):
                    m = col >= v if at_least else col < v
                    p1, n1 = (y[inside] & m).sum(), (~y[inside] & m).sum()
                    if not p1 or p1 + n1 == len(col):
                        continue
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                    if gain > best[0] + 1e-9:
                        best = (gain, Test(name, at_least, float(v)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _prune(rule: list[Test], x: np.ndarray, y: np.ndarray) -> list[Test]:
    """Cuts the rule's end where (covered bad - covered good) / covered is largest on unseen rows."""
    worth = []
    for k in range(1, len(rule) + 1):
        m = np.all([t.holds(x) for t in rule[:k]], axis=0)
        p, n = (y & m).sum(), (~y & m).sum()
        worth.append((p - n) / (p + n) if p + n else -1.0)
    return rule[: int(np.argmax(worth)) + 1] if worth else []


def _centre(rule: list[Test], x: np.ndarray, y: np.ndarray) -> tuple[Test, ...]:
    """Moves each threshold to the middle of the gap that it cuts, so unseen rows near it fall to the right side."""
    out = []
    for k, t in enumerate(rule):
        rest = np.all([r.holds(x) for i, r in enumerate(rule) if i != k] or [np.ones(len(y), dtype=bool)], axis=0)
        col = x[rest, FEATURES.index(t.feature)]
        below, above = col[col < t.value], col[col >= t.value]
        v = (below.max() + above.min()) / 2 if len(below) and len(above) else t.value
        out.append(Test(t.feature, t.at_least, float(v)))
    return tuple(out)


def learn_list(x: np.ndarray, bad: np.ndarray, *, cuts: int = 64, most_tests: int = 4, most_rules: int = 12, precision: float = 0.97, seed: int = 7) -> DecisionList:
    """Sequential covering for the rows marked ``bad``; a rule stays if its precision on unseen rows reaches ``precision``."""
    rng = np.random.default_rng(seed)
    left, rules = np.arange(len(bad)), []
    while len(rules) < most_rules and bad[left].sum() >= 2:
        order = rng.permutation(left)
        k = max(1, len(order) * 2 // 3)
        grow, prune = order[:k], order[k:]
        rule = _grow(x[grow], bad[grow], cuts, most_tests)
        if len(prune) and rule:
            rule = _prune(rule, x[prune], bad[prune])
        if not rule:
            break
        m = np.all([t.holds(x[left]) for t in rule], axis=0)
        hit = bad[left][m]
        if not len(hit) or hit.mean() < precision or hit.sum() < max(2, 0.01 * bad.sum()):
            break
        rules.append(_centre(rule, x[left], bad[left]))
        left = left[~np.all([t.holds(x[left]) for t in rules[-1]], axis=0) & ~m]
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A list from the labelled rows of the learning folds; without usable labels the list is empty."""
    marked = labels.filter(F.col("quality").isin(0, 1) & (fold() != 0)).select("doc_id", F.col("quality").cast("int").alias("_q")).distinct()
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "_q").limit(sample_rows)
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(some), "doc_id")  # at most sample_rows ids
    stats = base_statistics(found).withColumns(_features("text")).groupBy("doc_id", "_q").agg(*[F.min(c).alias(c) for c in FEATURES])  # an id that stands twice counts once, by the least of each
    stats = sorted(stats.select("doc_id", "_q", *FEATURES).collect())  # eight numbers for each id
    if not stats:
        return DecisionList()
    data = np.array([[float(v) for v in [*r[2:], r[1]]] for r in stats])
    keep = (data[:, 0] >= MIN_WORDS) & (100 * data[:, FEATURES.index("repeat_share")] <= MAX_REPEAT_PERCENT)  # the base rule has the others
    return learn_list(data[keep, :-1], data[keep, -1] == 0)


def quality_rules(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Adds the base statistics, ``base_failed``, ``rule`` (first learned rule that covers the text) and ``kept``.

    Every input column stays; a column of the same name as an output is replaced.
    Null, empty and white texts have no words, so ``base_failed`` is true.  Rows
    are judged on their own, whatever their length: repeated rows get equal
    verdicts, an empty table stays empty.
    """
    (distinct,) = unused(docs, "distinct")
    out = base_statistics(docs, text, distinct)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    cols = {"n_words": F.col("n_words")} | _features(text, distinct)
    return out.withColumns({"base_failed": failed, "rule": rules.column(cols)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(distinct)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality_rules(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

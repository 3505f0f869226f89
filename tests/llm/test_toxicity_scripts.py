"""Toxic words of text without spaces, and of fewer than four letters."""

import random

import pytest

from tallyfold.llm import toxicity


def corpus(rnd, make):
    return [(make(rnd, y).encode(), y) for y in [0, 1] * 150]


def unspaced(rnd, y):
    chars = [chr(rnd.randint(0x4E00, 0x4F80)) for _ in range(rnd.randint(60, 120))]
    for _ in range(3 * y):
        chars.insert(rnd.randrange(len(chars)), rnd.choice(["\u7a4d\u7a4e\u7a4f\u7a50", "\u8b01\u8b02\u8b03\u8b04\u8b05"]))
    return "".join(chars)


def short(rnd, y):
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(50)]
    for _ in range(3 * y):
        words.insert(rnd.randrange(50), rnd.choice(["zug", "vex", "qi"]))
    return " ".join(words)


@pytest.mark.parametrize("make", [unspaced, short])
def test_toxic_words_are_seen(make):
    model = toxicity.fit(corpus(random.Random(1), make))
    scorer = model.scorer()
    fresh = corpus(random.Random(2), make)
    right = sum((scorer.score(t) >= toxicity.THRESHOLD) == y for t, y in fresh)
    assert right >= 0.95 * len(fresh)


def test_windows_cover_a_long_word():
    word = bytes(range(97, 123)) * 9
    got = toxicity.pieces(word)
    assert all(len(p) == toxicity.WINDOW for p in got) and all(any(word[i : i + 32] in p for p in got) for i in range(len(word) - 31))

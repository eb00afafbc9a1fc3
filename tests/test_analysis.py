import random

import pytest

from siftline.functions import analysis
from siftline.functions.porter2 import stem


@pytest.mark.parametrize(
    ("text", "lines"),
    [("foo\r\nbar\r\n", ["foo", "bar"]), ("foo\n\nbar", ["foo", "", "bar"]), ("", []), (None, []), ("foo\rbar", ["foo\rbar"]), ("a\n", ["a"]), ("\n", [""]), ("a\r", ["a\r"])],
)
def test_lines(text, lines):
    assert analysis.lines(text) == lines


def _words(line):
    return [line.encode()[a:b].decode() for a, b in analysis.tokens(line)[0]]


def test_words():
    assert _words("can't stop 3.14 foo_bar U.S.A. 1,000") == ["can't", "stop", "3.14", "foo_bar", "U.S.A", "1,000"]
    assert _words("日本語 カタカナ") == ["日", "本", "語", "カタカナ"]
    assert _words("!!! ... ___") == []
    assert _words("l'été d’or a.b.c 1,2;3 a1.b x² 'é") == ["l'été", "d’or", "a.b.c", "1,2;3", "a1", "b", "x", "²", "é"]
    assert analysis.tokens("Été chaud")[0] == [(0, 5), (6, 11)]


def test_plain_words_are_the_segments_of_unicode():
    rng = random.Random(3)
    for _ in range(3000):
        line = "".join(rng.choices("aZé9ß ,.;:!-_'’#@/()²½·日カ́“\t", k=rng.randint(0, 14)))
        assert analysis._ranges(line) == analysis._segments(line), repr(line)


@pytest.mark.parametrize(
    "pair",
    "running-run hopping-hop hoping-hope ties-tie cries-cri generously-generous consistency-consist knightly-knight happy-happi national-nation relational-relat handly-hand kneeled-kneel agreed-agre conditional-condit kiwis-kiwi gas-gas this-this boyish-boyish sky-sky dying-die inning-inning say-say".split(),
)
def test_stems(pair):
    word, want = pair.split("-")
    assert stem(word) == want

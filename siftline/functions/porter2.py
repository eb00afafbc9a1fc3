"""The English Snowball stemmer (Porter2), from its published definition."""

from __future__ import annotations

_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = frozenset("cdeghkmnrt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STOP_1A = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _ending(word: str, endings: tuple[str, ...]) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in _VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)

    end = _ending(word, ("'s'", "'s", "'"))
    word = word[: len(word) - len(end)]

    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _STOP_1A:
        return word

    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif end and any(c in _VOWELS for c in word[: len(word) - len(end)]):
        word = word[: len(word) - len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    end = _ending(word, tuple(e for e, _ in _STEP2))
    if end and len(word) - len(end) >= r1:
        before = word[: len(word) - len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in _LI):
            word = before + dict(_STEP2)[end]

    end = _ending(word, tuple(e for e, _ in _STEP3))
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: len(word) - len(end)] + dict(_STEP3)[end]

    end = _ending(word, tuple(_STEP4))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: len(word) - len(end)]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")

"""From text to lines, words, byte ranges and stems.

Index and query go through the same functions.  Words are the segments between Unicode word
boundaries (UAX #29) that hold a letter or digit; stems are Porter2 of the lower-cased word,
whatever the language.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

from siftline.functions.porter2 import stem

#: Plain runs of word characters are the segments, unless a line holds one of these: characters that
#: join words when between two, and all beyond Latin letters, marks and ordinary punctuation.
_INVOLVED = re.compile(r"[^\W_]['.:·’;,․‧＇．][^\W_]|_['.:·’;,․‧＇．]|['.:·’;,․‧＇．]_|[ª-­²³¹º¼-¾]|[^\x00-ɏ‐-―‘-‟•…‰‹›€™]")
_PLAIN = re.compile(r"\w+")
_W = r"[[\p{L}\p{M}\p{Nd}\p{Nl}_]--[\p{Han}\p{Hiragana}\p{Katakana}]]"
_SEGMENT = regex.compile(rf"(?V1)[\p{{Han}}\p{{Hiragana}}]\p{{M}}*|[\p{{Katakana}}ー]+|\p{{No}}|{_W}+(?:(?:[:·.'’․‧＇．](?<=\p{{L}}\p{{M}}*.)(?=\p{{L}})|[.,;'’․＇．](?<=\p{{Nd}}.)(?=\p{{Nd}})){_W}+)*")


def lines(text: str | None) -> list[str]:
    r"""The lines of a text: separators are \n and \r\n, a final one adds no line, blank lines count."""
    if not text:
        return []
    found = text.split("\n")
    if found[-1] == "":
        found.pop()
    # only a carriage return before a line feed belongs to the separator
    last = len(found) - 1 if not text.endswith("\n") else len(found)
    return [line[:-1] if i < last and line.endswith("\r") else line for i, line in enumerate(found)]


def _segments(line: str) -> list[tuple[int, int]]:
    """Ranges of characters of the words, by the rules of Unicode.

    Ideographs and Hiragana are words by themselves, Katakana runs are words; marks stay with what they follow.
    """
    return [m.span() for m in _SEGMENT.finditer(line) if any(c.isalnum() for c in m.group())]


def _ranges(line: str) -> list[tuple[int, int]]:
    """Ranges of characters of the words."""
    if _INVOLVED.search(line):
        return _segments(line)
    if "_" in line:
        return [m.span() for m in _PLAIN.finditer(line) if m.group().strip("_")]
    return [m.span() for m in _PLAIN.finditer(line)]


@lru_cache(maxsize=1 << 18)
def term(word: str) -> str:
    """The term of a word as written."""
    return stem(word.lower())


def tokens(line: str, make: Callable[[str], str] = term) -> tuple[list[tuple[int, int]], list[str]]:
    """The words' ranges of UTF-8 bytes and their terms."""
    spans = _ranges(line)
    terms = [make(line[a:b]) for a, b in spans]
    if line.isascii():
        return spans, terms
    out, at, byte = [], 0, 0
    for a, b in spans:
        start = byte + len(line[at:a].encode())
        byte, at = start + len(line[a:b].encode()), b
        out.append((start, byte))
    return out, terms


#: Analyzers by the name that an index stores.
ANALYZERS: dict[str, Callable[[str], str]] = {"english": term, "lower": str.lower}


def phrase(text: str, analyzer: str = "english") -> list[str]:
    """The terms of a query's phrase; no lines are told apart."""
    return tokens(text, ANALYZERS[analyzer])[1]

"""Hashes of words and of runs of words, for many words at once."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MOST_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """A bounded memory of words: each has a place, at which the arrays hold its hashes.

    Row 0 of ``hashes`` has the hash of the whole word, row i that of its first ``stems[i - 1]``
    letters.
    """

    def __init__(self, stems: Sequence[int] = ()):
        super().__init__()
        self.cuts = (None, *stems)
        self.hashes = np.zeros((len(self.cuts), 1024), np.uint64)

    def __missing__(self, word: str) -> int:
        place = len(self)
        if place == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        for i, cut in enumerate(self.cuts):
            self.hashes[i, place] = xxhash.xxh64_intdigest(word[:cut])
        self[word] = place
        return place

    def of(self, words: Sequence[str]) -> np.ndarray:
        """One row of hashes for each cut, one column for each word."""
        if len(self) > MOST_WORDS:
            self.clear()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[:, places]  # only now: new words may have moved the array


def mixed(*columns: np.ndarray) -> np.ndarray:
    """One hash for each row of hashes; the order of the columns counts."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = (out ^ column) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Vocabulary:
    """The words of some short texts that are looked for; any other word is as good as another."""

    def __init__(self, texts: Sequence[str]):
        words = dict.fromkeys(w for text in texts for w in WORD.findall(text.lower()))  # in their order, in every run
        self.known = {w: xxhash.xxh64_intdigest(w) or 1 for w in words}

    def hashes(self, text: str) -> np.ndarray:
        """The hash of each known word of a text, 0 for the others."""
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.known.get, words, repeat(0)), np.uint64, len(words))


def known_runs(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and hashes of all runs of ``size`` known words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = hashes != 0
    whole = known[:count].copy()
    for i in range(1, size):
        whole &= known[i:i + count]
    places = np.flatnonzero(whole)
    return places, mixed(*[hashes[places + i] for i in range(size)])


def word_spans(text: str) -> list[tuple[int, int]]:
    """The code points of the words of ``text.lower()``; a letter may become two in lower case."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    place = []
    for i, letter in enumerate(text):
        place += [i] * len(letter.lower())
    return [(place[a], place[b - 1] + 1) for a, b in spans]

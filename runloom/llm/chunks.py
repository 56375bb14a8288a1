"""Byte-level BPE works inside pieces that never cross the gap before a run of white space.

So a text may be cut into chunks, each a run of white space and the run of other characters after
it, and every distinct chunk be encoded once. A run of plain letters ends a piece before any character
that is no letter, so words are cut off what follows them too; fewer chunks are then distinct.
``ChunkIds`` keeps a bounded memory of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
CHUNK = re.compile(rf"\s*(?:[{LETTERS}]+(?![^\W\d_])|\S+)|\s+")
# Python counts these four as white space and the tokenizers do not: such texts stay whole.
UNSURE = re.compile("[\x1c-\x1f]")
# White space other than blanks and line ends.
OTHER_SPACE = re.compile(r"[^\S \n]")
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
# Stands before the first word of a text, which has no blank before it.
FIRST = "\x00"
# Stands between chunks while Arrow cuts a batch, before blanks and where a word ends.
MARK = "\x01"
WORD_END = rf"([{LETTERS}])([!-@\[-`{{-~\n])"
MOST_KEPT = 300_000
LONGEST_KEPT = 100


def _spaced_otherwise(text: str) -> bool:
    """True unless blanks are single, and inside, and all other white space is line ends."""
    if ("  " in text or "\n \n" in text or text[0] == " " or text[-1] == " " or FIRST in text
            or MARK in text):
        return True
    if text.isascii():
        return any(c in text for c in ASCII_SPACE)
    return OTHER_SPACE.search(text) is not None


class Kept(dict):
    """A bounded memory in two halves.

    When the newer half is full it becomes the older one, and what is met again moves on; so frequent
    entries stay and rare ones go.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def missing(self, chunks: Sequence[str]) -> list[str]:
        wanted = set(filterfalse(self.__contains__, chunks))
        again = wanted.intersection(self.older)
        self.update((c, self.older[c]) for c in again)
        return list(wanted - again)


class ChunkIds:
    """Texts to ids, as little-endian unsigned 32-bit integers.

    Arrow cuts a batch of texts before blanks and behind words and finds the distinct chunks; only
    those are looked up or encoded, and numpy puts the ids of all chunks in place.
    """

    def __init__(self, encode_chunks: Callable[[Sequence[str]], Sequence[bytes]],
                 special: Sequence[str] = (), most: int = MOST_KEPT):
        self.encode_chunks = encode_chunks
        self.special = tuple(special)
        self.chunks = Kept(most)

    def many(self, texts: Sequence[str]) -> list[bytes]:
        """Most texts have single blanks between words and are split at them; others are cut."""
        self.chunks.turn()
        plain = [i for i, text in enumerate(texts) if text and not _spaced_otherwise(text)
                 and not any(s in text for s in self.special)]
        out: list[bytes] = [b""] * len(texts)
        rest = sorted(set(range(len(texts))).difference(plain))
        cut = [[texts[i]] if UNSURE.search(texts[i]) else CHUNK.findall(texts[i]) for i in rest]
        for i, ids in zip(rest, self._cut(cut), strict=True):
            out[i] = ids
        if plain:
            for i, ids in zip(plain, self._split([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def _split(self, texts: list[str]) -> list[bytes]:
        marked = pc.replace_substring(pa.array([FIRST + t for t in texts], pa.large_string()),
                                      " ", MARK + " ")
        marked = pc.replace_substring_regex(marked, WORD_END, rf"\1{MARK}\2")
        lists = pc.split_pattern(marked, MARK)
        coded = lists.values.dictionary_encode()
        ids = self._chunk_ids([c.removeprefix(FIRST) for c in coded.dictionary.to_pylist()])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, begins = as_ids(b"".join(ids)), np.cumsum(sizes) - sizes
        # Each chunk's ids stand together in the table; bring them into the order of the texts.
        places = coded.indices.to_numpy()
        lengths = sizes[places]
        ends = np.cumsum(lengths)
        at = np.repeat(begins[places] - (ends - lengths), lengths)
        at += np.arange(len(at))
        raw = table[at].tobytes()
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()] * 4
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        known = self.chunks
        new = known.missing(chunks)
        long = {}
        for chunk, ids in zip(new, self.encode_chunks(new), strict=True):
            (known if len(chunk) <= LONGEST_KEPT else long)[chunk] = ids
        get = (lambda c: known[c] if c in known else long[c]) if long else known.__getitem__
        return list(map(get, chunks))

    def _cut(self, cut: list[list[str]]) -> list[bytes]:
        ids = self._chunk_ids([c for chunks in cut for c in chunks])
        out, at = [], 0
        for chunks in cut:
            out.append(b"".join(ids[at:at + len(chunks)]))
            at += len(chunks)
        return out


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")

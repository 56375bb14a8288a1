"""Byte-level BPE by a contiguous rank array.

A short word is held as one row of part ids and one row of ranks, the rank of each part with its right
neighbour. The smallest rank is looked for, the boundary at its place is deleted, and the two ranks
next to it are refreshed, until no rank is left. Words of like length form the rows of two arrays, so
that numpy does each step for many words at once. A word longer than ``SHORT`` bytes keeps its parts
in a linked list with a heap of ranks instead, since scanning would take time with its square.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import regex
from tokenizers import pre_tokenizers

from runloom.llm.chunks import LETTERS, ChunkIds, as_ids

SHORT = 48
KEPT = 120_000  # chunks that a task remembers, twice over
NONE = np.int32(2**31 - 1)

# Letters and signs for which the pattern library and the tokenizers agree on what they are; other
# characters come from alphabets in which the two follow different Unicode versions.
USUAL = regex.compile(
    "[\x00-ͷΑ-ΡΣ-ώЀ-ԯא-תء-ي٠-٩"
    "‐-⁞₠-₿←-⇿　-〿ぁ-ゖァ-ヺ"
    "一-龥가-힣]*")


# A blank and a word: one piece.
WORD = regex.compile(f" ?[{LETTERS}]+")


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter of each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The merges, ids and special tokens of a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter, model = spec["pre_tokenizer"], spec["model"]
        if (splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or spec["normalizer"]
                or model["type"] != "BPE" or model.get("ignore_merges")):
            raise ValueError("only plain byte-level BPE files are read")
        letters = byte_letters()
        vocabulary = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first_id = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.first_id[byte] = vocabulary[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs] + [0], np.int32)
        # A pair that is listed twice keeps its later place, as in a table that is filled in order.
        last = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.keys = np.array(sorted(last), np.int64)
        self.ranks = np.array([last[k] for k in self.keys.tolist()], np.int32)
        self.rank_of = last
        self.pattern = regex.compile(pattern)
        self.split_exactly = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.specials = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.decimal = {i: str(i).encode() for i in self.bytes_of}

    # Pieces of text

    def pieces(self, text: str) -> list[str]:
        if WORD.fullmatch(text):
            return [text]
        if USUAL.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.split_exactly.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: Sequence[str]) -> list[bytes]:
        cut = []
        for chunk in chunks:
            if self.special and any(s in chunk for s in self.special):
                parts = []
                for part in self.specials.split(chunk):
                    parts += [self.special[part]] if part in self.special else self.pieces(part)
                cut.append(parts)
            else:
                cut.append(self.pieces(chunk))
        words = list({p for parts in cut for p in parts if isinstance(p, str)})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        return [b"".join(ids[p] if isinstance(p, str) else np.uint32(p).tobytes() for p in parts)
                for parts in cut]

    # Words

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            by_length[len(word)].append(i)
        for length, places in by_length.items():
            if length > SHORT:
                for i in places:
                    out[i] = self._long(words[i])
                continue
            for at in range(0, len(places), 20_000):
                some = places[at:at + 20_000]
                flat = np.frombuffer(b"".join([words[i] for i in some]), np.uint8)
                parts, sizes = self._short(self.first_id[flat].reshape(len(some), length))
                raw, width = parts.astype("<u4").tobytes(), 4 * length
                for k, (i, size) in enumerate(zip(some, sizes.tolist(), strict=True)):
                    out[i] = raw[k * width:k * width + 4 * size]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for a pair that is never joined; part -1 ends a word."""
        if not len(self.keys):
            return np.full(left.shape, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def _short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join the parts of equally long words, one row each; parts in front, and their number."""
        count, length = parts.shape
        sizes = np.full(count, length, np.int64)
        if length < 2:
            return parts, sizes
        parts = np.concatenate([parts, np.full((count, 1), -1, np.int32)], axis=1)
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        columns = np.arange(length + 1)
        live = np.arange(count)
        live_parts, live_ranks = parts, ranks
        while len(live):
            at = live_ranks.argmin(axis=1)
            row = np.arange(len(live))
            best = live_ranks[row, at]
            going = best != NONE
            if not going.all():
                parts[live[~going]] = live_parts[~going]
                live, at, best = live[going], at[going], best[going]
                live_parts, live_ranks = live_parts[going], live_ranks[going]
                row = np.arange(len(live))
                if not len(live):
                    break
            live_parts[row, at] = self.made[best]
            # Delete the boundary: what stands right of it moves one place to the left.
            moved = np.minimum(columns + (columns > at[:, None]), length)
            live_parts = np.take_along_axis(live_parts, moved, axis=1)
            live_parts[:, length] = -1
            moved = np.minimum(columns[:length] + (columns[:length] > at[:, None]), length - 1)
            live_ranks = np.take_along_axis(live_ranks, moved, axis=1)
            live_ranks[:, length - 1] = NONE
            # Refresh the ranks of the new part with its neighbours.
            live_ranks[row, at] = self._ranks(live_parts[row, at], live_parts[row, at + 1])
            inner = np.flatnonzero(at > 0)
            live_ranks[inner, at[inner] - 1] = self._ranks(live_parts[inner, at[inner] - 1],
                                                           live_parts[inner, at[inner]])
            sizes[live] -= 1
        return parts[:, :length], sizes

    def _long(self, word: bytes) -> bytes:
        parts = self.first_id[np.frombuffer(word, np.uint8)].tolist()
        right = [*range(1, len(parts)), -1]
        left = [*range(-1, len(parts) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                rank = self.rank_of.get(parts[i] << 32 | parts[right[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[right[i]]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            offer(left[i])
            offer(i)
        out, i = [], 0
        while i >= 0:
            out.append(parts[i])
            i = right[i]
        return np.array(out, "<u4").tobytes()

    # Texts

    def memory(self) -> ChunkIds:
        """A new memory of encoded chunks, for one task: what it holds goes when the task ends."""
        return ChunkIds(self.encode_chunks, list(self.special), KEPT)

    def encode(self, texts: Sequence[str], memory: ChunkIds | None = None) -> list[np.ndarray]:
        return [as_ids(raw) for raw in (memory or self.memory()).many(texts)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD. Unknown ids are left out."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        table = self.bytes_of
        try:
            return b"".join([table[i] for i in ids])
        except KeyError:
            return b"".join([table.get(i, b"") for i in ids])

    def decimals(self, ids: Sequence[int]) -> bytes:
        return b",".join([self.decimal[i] for i in ids])


_LOADED: dict[str, Bpe] = {}


def bpe_for(path: str, pattern: str) -> Bpe:
    """One table of merges in a worker process, shared by its tasks."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path, pattern)
    return _LOADED[path]

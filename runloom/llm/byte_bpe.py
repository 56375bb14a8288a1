"""Byte-level BPE by rank files: a transducer encodes, a UTF-8 state machine decodes as ids arrive.

A rank file has one token a line, in base64, and its id, which is also its rank. A text is cut by the
pattern, and every match is encoded by itself: a match that is a token is that token, any other one is
read by the transducer. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runloom.llm.batches import (
    flat_computed,
    fresh,
    name_column,
    text_column,
    whole_texts,
    with_computed,
)
from runloom.llm.chunks import ChunkIds, Kept, as_ids
from runloom.llm.transducer import Transducer, packed

KEPT = 200_000  # chunks that a worker remembers, twice over
AT_ONCE = 1 << 20  # ids that are turned into bytes at a time
REPLACEMENT = "\ufffd"

# Code points that the pattern library takes for letters, numbers or white space and the
# tokenizers' own library does not (the library's tables are of Unicode 16).
NOT_YET = regex.compile(
    "[\x1c-\x1f\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4"
    "\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    "\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f]")
NEITHER = "\ue000"  # a code point that is no letter, number or white space

# Alphabets about which all Unicode versions agree; only texts of these are cut into chunks.
BEYOND = regex.compile("[^\x00-\x1b\x20-\u024f]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in
                (line.split() for line in file if line.strip())}


class Bytes:
    """A table of byte strings; the strings of many ids are joined by numpy."""

    def __init__(self, strings: Sequence[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self._some(ids[at:at + AT_ONCE]) for at in range(0, len(ids), AT_ONCE))

    def _some(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


class Utf8Machine:
    """UTF-8 as it arrives. Its state is the bytes of a character that is not complete yet.

    Bytes that are no UTF-8 become U+FFFD, one for as many as begin some character.
    """

    def __init__(self) -> None:
        # For each beginning: the values that the next byte may have.
        tail = range(0x80, 0xC0)
        self.next: dict[bytes, range] = {}
        for lead in range(0xC2, 0xF5):
            second = {0xE0: range(0xA0, 0xC0), 0xED: range(0x80, 0xA0), 0xF0: range(0x90, 0xC0),
                      0xF4: range(0x80, 0x90)}.get(lead, tail)
            self.next[bytes([lead])] = second

    def _allowed(self, held: bytes) -> range:
        return self.next[held] if len(held) == 1 else range(0x80, 0xC0)

    @staticmethod
    def _size(lead: int) -> int:
        return 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4

    def feed(self, held: bytes, raw: bytes) -> tuple[str, bytes]:
        """The text that is settled after ``raw``, and the state then."""
        out = []
        for byte in raw:
            if held and byte in self._allowed(held):
                held += bytes([byte])
                if len(held) == self._size(held[0]):
                    out.append(held.decode())
                    held = b""
                continue
            if held:
                out.append(REPLACEMENT)
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif bytes([byte]) in self.next:
                held = bytes([byte])
            else:
                out.append(REPLACEMENT)
        return "".join(out), held

    @staticmethod
    def end(held: bytes) -> str:
        return REPLACEMENT if held else ""


class RankBpe:
    """The tokens of one rank file and the pattern that cuts texts for it."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(self.ranks)
        most = max(self.ranks.values()) + 1
        self.raw = [b""] * most
        for raw, i in self.ranks.items():
            self.raw[i] = raw
        self.bytes = Bytes(self.raw)
        self.decimals = Bytes([b"%d " % i for i in range(most)])
        self.machine = Utf8Machine()
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        # Tokens that are whole characters leave the machine where it starts.
        chars = []
        for raw in self.raw:
            text, held = self.machine.feed(b"", raw)
            chars.append(-1 if held or REPLACEMENT in text else len(text))
        self.chars = np.array(chars, np.int64)

    # Encoding

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, with the tokenizers' notion of letters and white space."""
        word = text[1:] if text[:1] == " " else text
        if word.isascii() and word.isalpha():
            return [text]
        seen = NOT_YET.sub(NEITHER, text)
        if seen == text:
            return self.pattern.findall(text)
        return [text[a:b] for a, b in (m.span() for m in self.pattern.finditer(seen))]

    def encode_piece(self, raw: bytes) -> bytes:
        token = self.ranks.get(raw)
        return self.transducer.encode(raw) if token is None else packed([token])

    def encode_chunks(self, chunks: Sequence[str]) -> list[bytes]:
        pieces, encode = self.pieces, self.encode_piece
        return [b"".join([encode(p.encode()) for p in pieces(c)]) for c in chunks]

    def memory(self) -> Memory:
        return Memory(self)

    def encode(self, texts: Sequence[str], memory: Memory | None = None) -> list[np.ndarray]:
        return [as_ids(raw) for raw in (memory or self.memory()).many(texts)]

    # Decoding

    def stream_text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids as they arrive; what is held back is part of one character at most.

        Unknown ids are left out.
        """
        held = b""
        for i in ids:
            text, held = self._step(held, i)
            yield text
        yield self.machine.end(held)

    def _step(self, held: bytes, i: int) -> tuple[str, bytes]:
        step = self.steps.get((held, i))
        if step is None:
            raw = self.raw[i] if 0 <= i < len(self.raw) else b""
            step = self.steps[held, i] = self.machine.feed(held, raw)
        return step

    def _odd_runs(self, ids: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """The runs of ids that are not whole characters each, with the text of the run."""
        end = 0
        for at in np.flatnonzero(self.chars[ids] < 0).tolist():
            if at < end:
                continue
            held, end, out = b"", at, []
            while end < len(ids) and (held or end == at):
                text, held = self._step(held, int(ids[end]))
                out.append(text)
                end += 1
            yield at, end, "".join(out) + self.machine.end(held)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; whole characters need no machine."""
        ids = ids[(ids >= 0) & (ids < len(self.raw))]
        out, after = [], 0
        for at, end, text in self._odd_runs(ids):
            out += [self.bytes.joined(ids[after:at]).decode(), text]
            after = end
        return "".join(out) + self.bytes.joined(ids[after:]).decode()

    def count_chars(self, ids: np.ndarray) -> int:
        """The code points of the decoded text."""
        sizes = self.chars[ids]
        return int(sizes.sum()) + sum(len(text) - int(sizes[at:end].sum())
                                      for at, end, text in self._odd_runs(ids))


class Memory:
    """What is remembered from text to text: ids of chunks, and of pieces of texts that are not cut into chunks."""

    def __init__(self, bpe: RankBpe):
        self.bpe = bpe
        self.chunks = ChunkIds(bpe.encode_chunks, most=KEPT)
        self.kept = Kept(KEPT)

    def many(self, texts: Sequence[str]) -> list[bytes]:
        self.kept.turn()
        far = {i for i, t in enumerate(texts) if not t.isascii() and BEYOND.search(t)}
        out: list[bytes] = [b""] * len(texts)
        near = [i for i in range(len(texts)) if i not in far]
        for i, ids in zip(near, self.chunks.many([texts[i] for i in near]), strict=True):
            out[i] = ids
        for i in far:
            pieces = self.bpe.pieces(texts[i])
            new = self.kept.missing(pieces)
            self.kept.update((p, self.bpe.encode_piece(p.encode())) for p in new)
            out[i] = b"".join(map(self.kept.__getitem__, pieces))
            self.kept.turn()
        return out


_LOADED: dict[tuple[str, str], tuple[RankBpe, Memory]] = {}


def tables_for(path: str, pattern: str) -> tuple[RankBpe, Memory]:
    """One set of tables and one bounded memory in a worker process, shared by its tasks."""
    if (path, pattern) not in _LOADED:
        bpe = RankBpe(path, pattern)
        _LOADED[path, pattern] = bpe, bpe.memory()
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """``docs`` plus a column of ids of every whole text.

    A null text is empty and has no ids. All columns and rows stay, repeated ones too; if ``into`` is
    taken, the new column gets underscores at its end.
    """
    out = fresh(docs, into)

    def start():
        bpe, memory = tables_for(path, pattern)

        def work(texts):
            ids = bpe.encode(whole_texts(texts), memory)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return work

    return with_computed(docs, ["text"], [T.StructField(out, T.ArrayType(T.IntegerType()))], start)


def decode_ids(rows: DataFrame, ids: str, path: str, pattern: str, into: str = "text") -> DataFrame:
    """``rows`` plus the text of a column of ids; null ids are an empty text, unknown ones are left out."""
    out = fresh(rows, into)

    def start():
        bpe, _ = tables_for(path, pattern)
        return lambda lists: [[bpe.decode(np.array([i for i in some or [] if i is not None], np.int64))
                               for some in lists]]

    return with_computed(rows, [ids], [T.StructField(out, T.StringType())], start)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars of the decoded text.

    A null text is empty. Rows stay apart, repeated ones too; a null doc_id stays null.
    """
    rows = docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType()), T.StructField("n_chars", T.LongType())]

    def start():
        bpe, memory = tables_for(path, pattern)

        def work(doc_ids, texts):
            sizes, ids_digests, text_digests, chars = [], [], [], []
            for ids in bpe.encode(texts, memory):
                sizes.append(len(ids))
                ids_digests.append(hashlib.sha256(bpe.decimals.joined(ids)[:-1]).hexdigest())
                text_digests.append(hashlib.sha256(bpe.bytes.joined(ids)).hexdigest())
                chars.append(bpe.count_chars(ids))
            return doc_ids, sizes, ids_digests, text_digests, chars
        return work

    return flat_computed(rows, fields, start)

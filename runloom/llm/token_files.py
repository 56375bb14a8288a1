"""Token files of directly addressable codes.

Every id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap tells
which ids go on, and level 1 holds the next chunk of those alone, and so on. The place of an id on
the next level is the number of set bits before it, which a directory (set bits before every 512th
bit) makes a short count. So any token, or any range of them, is read without decoding what lies
around it.

A token file is a Parquet table of segments in ascending order of documents. Each row has the codes
of whole documents, with the documents' ids and ends; Spark's committer writes it, so a lost executor
leaves no half file, and any store that Spark writes to will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from runloom.llm.batches import flat_computed, name_column, text_column
from runloom.llm.chunks import ChunkIds, as_ids

END_ID = 2
MAGIC = b"DAC1"
STEP = 512  # bits between two entries of a rank directory
SEGMENT_TOKENS = 1 << 18
KEPT = 600_000  # chunks that a worker process remembers, twice over
ROWS = 2000  # texts encoded at a time: more texts have fewer distinct chunks each
ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)


def encode_segment(ids: np.ndarray) -> bytes:
    """The codes of some ids: levels of chunk bytes, bitmaps and rank directories."""
    rest = np.asarray(ids, dtype=np.uint32)
    parts, levels = [], 0
    while levels == 0 or len(rest):
        low, high = (rest & 255).astype(np.uint8), rest >> 8
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STEP // 8), np.uint8)])
        ones = ONES[bits].reshape(-1, STEP // 8).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        parts += [np.uint32(len(low)).astype("<u4").tobytes(), low.tobytes(), bits.tobytes(),
                  directory.tobytes()]
        rest, levels = high[more], levels + 1
    return b"".join([MAGIC, bytes([levels]), *parts])


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(payload[4]):
            n = int(np.frombuffer(payload, "<u4", 1, at)[0])
            blocks = -(-n // STEP)
            at += 4
            low = np.frombuffer(payload, np.uint8, n, at)
            at += n
            bits = np.frombuffer(payload, np.uint8, blocks * STEP // 8, at)
            at += len(bits)
            directory = np.frombuffer(payload, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            self.levels.append((low, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, at: int) -> int:
        """Set bits before place ``at``: the directory's entry, whole bytes, the bits of one byte."""
        _, bits, directory = self.levels[level]
        block, byte = at // STEP, at // 8
        count = int(directory[block]) + int(ONES[bits[block * STEP // 8:byte]].sum())
        return count + (int(ONES[bits[byte] & ((1 << at % 8) - 1)]) if at % 8 else 0)

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < len(self):
            raise IndexError(at)
        value, shift = 0, 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= int(low[at]) << shift
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(level, at), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``; only their own chunks are read."""
        end = min(end, len(self))
        if start >= end:
            return np.zeros(0, np.uint32)
        pieces = []
        for level, (low, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            marks = np.unpackbits(bits[start // 8:-(-end // 8)], bitorder="little")
            more = marks[start % 8:start % 8 + end - start].astype(bool)
            pieces.append((low[start:end], more))
            start, end = self._rank(level, start), self._rank(level, end)
        values = np.zeros(0, np.uint32)
        for low, more in reversed(pieces):
            whole = low.astype(np.uint32)
            whole[more] |= values << np.uint32(8)
            values = whole
        return values


def library_encoder(path: str) -> ChunkIds:
    """Ids as the tokenizers library gives them, no special tokens added.

    Chunks are put one after the other and encoded in one call, those that do not begin with a blank
    or a line end behind a line end: the library cuts there, so the ids' lengths in bytes tell which
    chunk they belong to.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    letters = pre_tokenizers.ByteLevel.alphabet()
    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        # One letter of the vocabulary is one byte.
        sizes[i] = len(token) if all(c in letters for c in token) else 0

    def one(chunk) -> bytes:
        return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(chunks):
        out = [None] * len(chunks)
        plain = []
        everything = " ".join(chunks)
        marked = any(s in everything for s in special)
        for i, chunk in enumerate(chunks):
            # White space at an end of a chunk would grow together with what is put there.
            if (not chunk or chunk[-1].isspace() or (chunk[0] not in " \n" and chunk[0].isspace())
                    or (marked and any(s in chunk for s in special))):
                out[i] = one(chunk)
            else:
                plain.append(i)
        for at in range(0, len(plain), 5000):
            some = plain[at:at + 5000]
            led = [chunks[i] if chunks[i][0] in " \n" else "\n" + chunks[i] for i in some]
            found = np.array(tokenizer.encode("".join(led), add_special_tokens=False).ids, "<u4")
            ends = np.cumsum([len(c.encode()) for c in led])
            cuts = (np.searchsorted(np.cumsum(sizes[found]), ends, side="left") + 1).tolist()
            raw, begin = found.tobytes(), 0
            for i, whole, end in zip(some, led, cuts, strict=True):
                out[i] = raw[4 * (begin + (whole is not chunks[i])):4 * end]
                begin = end
        return out

    return ChunkIds(encode, special, KEPT)


_ENCODERS: dict[str, ChunkIds] = {}


def encoder_for(path: str) -> ChunkIds:
    """One encoder in a worker process, shared by its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = library_encoder(path)
    return _ENCODERS[path]


SEGMENT_SCHEMA = ("part int, segment int, first_token long, n_tokens long, doc_ids array<long>, "
                  "ends array<long>, codes binary")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
                      segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text, add the end id, and write the segments in ascending doc_id order.

    Null texts are empty; null doc_ids come first; rows of one doc_id are ordered by their text, so a
    doc_id that is repeated without end is spread over as many partitions as the sampled bounds give
    it. ``first_token`` counts inside a part. An empty table writes no segment.
    """
    rows = (docs.select(name_column("doc_id").cast("long").alias("doc_id"),
                        text_column().alias("text"))
            .withColumn("tie", F.xxhash64("text")))
    ordered = (rows.repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    end = np.array([end_id], "<u4").tobytes()
    names = ["part", "segment", "first_token", "n_tokens", "doc_ids", "ends", "codes"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.binary()]

    def write(found):
        encoder = encoder_for(tokenizer_path)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, ends, raw, size = [], [], [], 0

        def close():
            codes = encode_segment(as_ids(b"".join(raw)))
            row = [part, segment, first, size, doc_ids, ends, codes]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in found:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                texts = piece.column(1).to_pylist()
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.many(texts),
                                       strict=True):
                    raw.append(ids + end)
                    size += len(raw[-1]) // 4
                    doc_ids.append(doc_id)
                    ends.append(size)
                    if size >= segment_tokens:
                        yield close()
                        segment, first = segment + 1, first + size
                        doc_ids, ends, raw, size = [], [], [], 0
        if doc_ids:
            yield close()

    ordered.mapInArrow(write, SEGMENT_SCHEMA).write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids in all documents before each.

    The running sum is over one row per part, of which there are as many as write tasks.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (segments.join(F.broadcast(base), "part")
            .withColumn("start", F.col("base") + F.col("first_token")).drop("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32."""
    segments = read_segments(spark, path).select("start", "doc_ids", "ends", "codes")

    def start():
        def work(starts, doc_ids, ends, codes):
            out = ([], [], [], [])
            for base, docs, stops, payload in zip(starts, doc_ids, ends, codes, strict=True):
                segment, begin = Segment(payload), 0
                # All documents are wanted, so all levels are walked once.
                ids = segment.slice(0, len(segment)).astype("<u4").tobytes()
                for doc, stop in zip(docs, stops, strict=True):
                    for column, value in zip(out, (doc, base + begin, stop - begin, zlib.crc32(
                            ids[4 * begin:4 * stop])), strict=True):
                        column.append(value)
                    begin = stop
            return out
        return work

    fields = spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long"
                                   ).schema.fields
    return flat_computed(segments, fields, start)

"""Benchmark passages in training text: n-gram seeds, then Smith-Waterman alignment.

Words are compared without case and punctuation. Every three-word run of a test item is a seed, however
many documents hold it. Where a document holds a seed, and the words around it include as many of the
item's as the least score takes, they are aligned with the item: matching words score 2, replaced,
added and left-out words cost 1. The score is divided by that of the whole item, so an exact copy has
1.0 and a copy with every tenth word replaced 0.85. A part of a long item that is as good as a verbatim
copy of ``PART_WORDS`` words is a match too, whatever its share of the item. An item of fewer words than
a run is matched by texts with just these words.

A long text is searched in overlapping stretches, so what its runs and the items make together is
bounded by the stretch.

Test items are broadcast in blocks of about ``BLOCK_WORDS`` words, one scan of the documents each;
most benchmarks are one block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.batches import flat_computed, fresh, name_column, text_column, written
from runloom.llm.features import WORD, Vocabulary, known_runs, word_spans

SEED_WORDS = 3
LEAST_SCORE = 0.5
PART_WORDS = 40
STRETCH = 4096  # words of a text that are searched at a time, beside the overlap
BLOCK_WORDS = 1_000_000
MATCH, MISS, GAP = 2, 1, 1
CELLS = 400_000  # of the table that alignments fill at a time
_ONE = np.int64(1) << 32


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of each item with its window: score, start and end in the window.

    Cells are 64-bit integers with the score above and the start below, so that the best way into a
    cell brings its start along. All pairs advance by one word of their items at a time.
    """
    count = len(items)
    long, wide = max(map(len, items)), max(map(len, windows))
    left = np.zeros((count, long), np.uint64)
    right = np.zeros((count, wide), np.uint64)
    inside = np.zeros((count, wide), bool)
    for i, (item, window) in enumerate(zip(items, windows, strict=True)):
        left[i, :len(item)] = item
        right[i, :len(window)] = window
        inside[i, :len(window)] = True
    lengths = np.array([len(x) for x in items])
    starts = np.arange(wide + 1, dtype=np.int64)
    ramp = starts * (GAP * _ONE)
    before = np.broadcast_to(starts, (count, wide + 1)).copy()
    best = np.zeros(count, np.int64)
    ends = np.zeros(count, np.int64)
    rows = np.arange(count)
    for i in range(long):
        same = (right == left[:, i:i + 1]) & inside
        cell = before.copy()
        np.maximum(before[:, :-1] + np.where(same, MATCH * _ONE, -MISS * _ONE), before[:, 1:]
                   - GAP * _ONE, out=cell[:, 1:])
        np.maximum(cell, starts, out=cell)  # score 0, starting here
        cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        live = lengths > i
        at = (cell >> 32).argmax(axis=1)
        top = cell[rows, at]
        better = live & ((top >> 32) > (best >> 32))
        best[better], ends[better] = top[better], at[better]
        before = cell
    mask = _ONE - 1
    return list(zip((best >> 32).tolist(), (best & mask).tolist(), ends.tolist(), strict=True))


class Items:
    """The words of a block of test items, and the places of their runs."""

    def __init__(self, rows: list[tuple]):
        self.vocabulary = Vocabulary([text for _, text in rows])
        self.short: dict[bytes, list] = {}
        for i, text in rows:
            words = self.vocabulary.hashes(text)
            if 0 < len(words) < SEED_WORDS:
                self.short.setdefault(words.tobytes(), []).append(i)
        rows = [(i, text) for i, text in rows if len(WORD.findall(text.lower())) >= SEED_WORDS]
        self.ids = [i for i, _ in rows]
        self.words = [self.vocabulary.hashes(text) for _, text in rows]
        grams = [known_runs(w, SEED_WORDS)[1] for w in self.words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else flat
        self.grams, gram = np.unique(flat, return_inverse=True)
        # Rows (item, place) in the order of their runs.
        self.rows = np.argsort(gram, kind="stable")
        self.first = np.searchsorted(gram[self.rows], np.arange(len(self.grams) + 1))
        self.known = np.unique(np.concatenate(self.words)) if self.words else flat
        self.numbers = [np.searchsorted(self.known, w) for w in self.words]
        self.longest = max(map(len, self.words), default=0)

    def needed(self, item: int, least: float) -> float:
        """How many words have to match: a share of the item's, or those of a long part."""
        return min(least * len(self.words[item]), PART_WORDS)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text's words that hold a run of an item, and the numbers of those runs."""
        places, grams = known_runs(words, SEED_WORDS)
        if not len(self.grams) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[at] == grams
        return places[hit], at[hit]


def windows_of(items: Items, words: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Item, start and end of the windows of a text around its seeds; near windows are one.

    The text is taken stretch by stretch; the overlap holds a window of the longest item.
    """
    overlap = 4 * items.longest + 32
    found = []
    for at in range(0, max(1, len(words)), STRETCH):
        begin = max(0, at - overlap)
        some = words[begin:at + STRETCH + overlap]
        found += [(item, begin + a, begin + b) for item, a, b in stretch_windows(items, some, least)]
        if begin + len(some) == len(words):
            break
    return list(dict.fromkeys(found))


def stretch_windows(items: Items, words: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """The windows of one stretch.

    A match takes ``Items.needed`` of the item's words at least, so windows with fewer are left out.
    """
    places, grams = items.found(words)
    many = items.first[grams + 1] - items.first[grams]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rows = items.rows[np.repeat(items.first[grams], many) + step]
    own, begins = items.item[rows], np.repeat(places, many) - items.place[rows]
    there = np.zeros(len(items.known), bool)
    there[np.searchsorted(items.known, words[words != 0])] = True
    spans: dict[int, list[tuple[int, int]]] = {}
    order = np.argsort(own, kind="stable")
    own, begins = own[order], begins[order]
    cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else own
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        item = int(own[a])
        size = len(items.words[item])
        if there[items.numbers[item]].sum() < items.needed(item, least):
            continue
        begin = np.unique(begins[a:b])
        low = np.maximum(0, begin - size // 2 - 4)
        high = np.minimum(len(words), begin + size + size // 2 + 4)
        # Half of the words near one seed: windows that only together have enough are not lost.
        near = words_within(items.words[item], words, low, high) >= items.needed(item, least) / 2
        if near.any():
            spans[item] = list(zip(low[near].tolist(), high[near].tolist(), strict=True))
    out = []
    for item, found in spans.items():
        found.sort()
        begin, end = found[0]
        for a, b in found[1:]:
            if a <= end and b - begin <= 4 * len(items.words[item]) + 16:
                end = max(end, b)
            elif a >= begin and b <= end:
                continue
            else:
                out.append((item, begin, end))
                begin, end = a, b
        out.append((item, begin, end))
    return [w for w in out if np.isin(items.words[w[0]], words[w[1]:w[2]]).sum()
            >= items.needed(w[0], least)]


def words_within(item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of an item's words stand in each window [low, high) of a text."""
    known, counts = np.unique(item, return_counts=True)
    inside = np.flatnonzero(np.isin(words, known))
    order = np.argsort(words[inside], kind="stable")
    before = np.full(len(inside), -1)
    same = words[inside[order[1:]]] == words[inside[order[:-1]]]
    before[order[1:][same]] = inside[order[:-1][same]]
    worth = counts[np.searchsorted(known, words[inside])]
    first, last = np.searchsorted(inside, low), np.searchsorted(inside, high)
    sizes = last - first
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())
    # A word counts at its first place in a window.
    total = np.concatenate([[0], np.cumsum(worth[at] * (before[at] < np.repeat(low, sizes)))])
    return total[ends] - total[ends - sizes]


def blocks_of(benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of about BLOCK_WORDS words, dealt by a hash of their text."""
    items = benchmark.select(name_column("item_id").alias("item_id"), text_column().alias("text"))
    items = written(items.distinct(), "items")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, math.ceil(words / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("text"), F.lit(count))
    return [items.filter(block == k) for k in range(count)]


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, item_id, score, start, end`` of every document and item that match.

    The score is at least ``least`` or that of a long part. start and end are code points of the aligned
    part of the whole text, end exclusive. Null texts are empty; items of one or two words match texts
    with no other words, items without words match nothing. Repeated rows of documents
    give repeated matches; repeated rows of items count once; equal items with different ids each
    match. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text"))
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType),
              T.StructField("item_id", benchmark.schema["item_id"].dataType),
              T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()),
              T.StructField("end", T.LongType())]
    found = None
    for block in blocks_of(benchmark):
        # At most about BLOCK_WORDS words, or one item.
        items = Items([tuple(r) for r in block.sort("item_id", "text").collect()])
        if not items.ids and not items.short:
            continue
        some = aligned(rows, spark.sparkContext.broadcast(items), fields, least)
        found = some if found is None else found.union(some)
    return found if found is not None else spark.createDataFrame([], T.StructType(fields))


def aligned(rows: DataFrame, shared, fields: list[T.StructField], least: float) -> DataFrame:
    def start():
        items = shared.value

        def work(doc_ids, texts):
            waiting: list[tuple[int, int, int, np.ndarray]] = []
            cells, best = 0, {}

            def settle():
                nonlocal waiting, cells
                if not waiting:
                    return
                sides = align([items.words[w[1]] for w in waiting], [w[3] for w in waiting])
                for (row, item, begin, _), (score, a, b) in zip(waiting, sides, strict=True):
                    share = score / (MATCH * len(items.words[item]))
                    if (score >= MATCH * items.needed(item, least)
                            and share > best.get((row, item), (0.0,))[0]):
                        best[row, item] = (share, begin + a, begin + b)
                waiting, cells = [], 0

            exact = []
            for row, text in enumerate(texts):
                hashes = items.vocabulary.hashes(text)
                if len(hashes) < SEED_WORDS:
                    exact += [(row, i) for i in items.short.get(hashes.tobytes(), ())]
                    continue
                for item, begin, end in windows_of(items, hashes, least):
                    waiting.append((row, item, begin, hashes[begin:end]))
                    cells += end - begin
                    if cells > CELLS // 16:
                        settle()
            settle()
            out = ([], [], [], [], [])
            spans = {row: word_spans(texts[row]) for row, _ in best}
            for (row, item), (share, a, b) in sorted(best.items()):
                values = (doc_ids[row], items.ids[item], share, spans[row][a][0], spans[row][b - 1][1])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            for row, item_id in exact:
                whole = word_spans(texts[row])
                for column, value in zip(out, (doc_ids[row], item_id, 1.0, whole[0][0], whole[-1][1]),
                                         strict=True):
                    column.append(value)
            return out
        return work

    return flat_computed(rows, fields, start)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that match no test item, with the columns they had.

    A row without a doc_id that matches takes the others without a doc_id with it only if their
    texts are equal.
    """
    text_hash, key = fresh(docs, "text_hash"), fresh(docs, "matched_id")
    mine = docs.withColumn(text_hash, F.xxhash64(text_column()))
    bad = written(matches(mine.select(F.struct(name_column("doc_id").alias("id"),
                                               F.col(text_hash).alias("h")).alias("doc_id"),
                                      text_column().alias("text")), benchmark, least)
                  .select(F.col("doc_id.id").alias(key), F.col("doc_id.h").alias("h")).distinct(),
                  "contaminated")
    return (mine.join(bad, name_column("doc_id").eqNullSafe(F.col(key))
                      & (F.col(text_hash) == F.col("h")), "left_anti").drop(text_hash))

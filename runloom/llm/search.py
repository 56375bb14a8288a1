"""Ranked search over an inverted index with bounds for single terms and for pairs of terms.

The index has one row for each run of documents (a segment): their ids, and for every term the
documents that hold it, with its count. It is written in the scan that reads the texts and is never
shuffled, so a frequent term is spread over all segments. Weights need counts over the whole corpus,
which are sums over the segments' rows.

A second pass over the index precomputes, in every segment, the largest gain of each term and, for
pairs of an item's rarest terms, the documents that hold both with their largest joint gain. The best
documents of those lists are scored in full, and of all segments' such scores an item's k-th best is a
score that its results have to reach.

A search then takes the terms of an item in falling order of their bounds. Terms at the end whose
bounds together cannot reach the least score add no candidates of their own; a pair's joint bound
replaces the sum of its two terms' bounds wherever it is tighter, so more terms fall into that end and
more candidates are given up before their remaining terms are looked up. Scores are exact: what is
skipped has a bound below a score that k documents have.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.batches import name_column, text_column, written

RESULTS = 10
SEGMENT_DOCS = 8192          # documents of a segment
SEGMENT_POSTINGS = 2_000_000  # a segment also ends when it holds so many
PAIRED = 8                   # rarest terms of an item whose pairs are stored
MOST_TERMS = 200_000         # an index is limited to the terms of the items if they are at most so many
BLOCK_TERMS = 100_000        # terms of the items that are searched for at a time, about
SEEDS = 32                   # documents of a segment's pair lists that are scored in full for an item
AT_ONCE = 1 << 20            # bytes of a text that are cut into terms at a time

# Everything but ASCII letters, ASCII digits and characters beyond ASCII parts two terms.
_SEEN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
TERMS = bytes(b + 32 if 65 <= b <= 90 else b for b in _SEEN)


def term_runs(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, some at a time; only A to Z are lower-cased."""
    raw = (text or "").encode().translate(TERMS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + AT_ONCE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def terms_of(text: str | None) -> set[bytes]:
    return {term for run in term_runs(text) for term in run}


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def gains(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight one adds to the score of documents that hold it so many times."""
    norm = 100 - 90 + 90 * lengths * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * norm)


# The index


def build_index(docs: DataFrame, vocabulary: Iterable[str] | None = None,
                segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Segments of ``docs`` (doc_id, text), one row each, written to the shared folder.

    A segment has at most ``segment_docs`` documents, 65,536 or fewer.

    Columns: doc_ids and lengths of the documents in terms; n_docs with at least one term; n_terms of
    all; terms with the number of documents holding each; places and counts, the documents (as
    positions, 16 bits) and occurrences (32 bits) of one term after the other. With a ``vocabulary``
    only its terms are indexed. A null text has no terms; rows stay apart, repeated ones too; a null
    doc_id stays null.
    """
    rows = docs.select(name_column("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    wanted = None if vocabulary is None else {t.encode(): i for i, t in enumerate(sorted(vocabulary))}

    def run(batches):
        segment = _Segment(wanted)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment.add(doc_id, text.as_py())
                if len(segment.doc_ids) >= segment_docs or segment.postings >= SEGMENT_POSTINGS:
                    yield segment.row()
                    segment = _Segment(wanted)
        if segment.doc_ids:
            yield segment.row()

    return written(rows.mapInArrow(run, INDEX), "search-index")


INDEX = ("doc_ids array<long>, lengths binary, n_docs long, n_terms long, terms array<string>, "
         "holding array<int>, places binary, counts binary")


class _Segment:
    """The documents of a segment as they are read."""

    def __init__(self, wanted: dict[bytes, int] | None):
        self.number = {} if wanted is None else wanted
        self.grows = wanted is None
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: str) -> None:
        number, length, found = self.number, 0, []
        for run in term_runs(text):
            length += len(run)
            if self.grows:
                for term in run:
                    number.setdefault(term, len(number))
                found.append(np.fromiter(map(number.__getitem__, run), np.int64, len(run)))
            else:
                found.append(np.array([number[t] for t in run if t in number], np.int64))
        if found:
            # The term, the document and its occurrences, in one number each.
            terms, counts = np.unique(np.concatenate(found), return_counts=True)
            self.found.append(np.stack([terms << 16 | len(self.doc_ids), counts]))
            self.postings += len(terms)
        self.doc_ids.append(doc_id)
        self.lengths.append(length)

    def row(self) -> pa.RecordBatch:
        found = np.concatenate([np.zeros((2, 0), np.int64), *self.found], axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
        numbers, holding = np.unique(found[0] >> 16, return_counts=True)
        names = list(self.number)
        lengths = np.array(self.lengths, "<i8")
        values = [self.doc_ids, lengths.tobytes(), int((lengths > 0).sum()), int(lengths.sum()),
                  [names[i].decode() for i in numbers.tolist()], holding.tolist(),
                  (found[0] & 0xFFFF).astype("<u2").tobytes(),
                  np.minimum(found[1], 2**32 - 1).astype("<u4").tobytes()]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                 pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                               [c.split()[0] for c in INDEX.split(", ")])


# A block of items


@dataclass(frozen=True)
class Block:
    """Items as sets of terms: all their terms with weights, and each item's terms by number."""

    terms: tuple[str, ...]
    weights: np.ndarray
    items: tuple[np.ndarray, ...]
    n_docs: int
    n_terms: int

    def rarest(self, item: int) -> list[int]:
        terms = self.items[item]
        return terms[np.argsort(-self.weights[terms], kind="stable")][:PAIRED].tolist()


def make_block(index: DataFrame, items: Sequence[set[bytes]]) -> Block:
    """Weights of the items' terms by counts over the whole index."""
    terms = sorted({t.decode() for some in items for t in some})
    number = {t: i for i, t in enumerate(terms)}
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    holding = (index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"),
                                                  F.col("holding").alias("holding"))))
               .toDF("term", "holding").join(wanted, "term").groupBy("term").agg(F.sum("holding")))
    weights = np.zeros(len(terms), np.int64)
    for term, count in holding.collect():
        weights[number[term]] = weight(n_docs, count)
    return Block(tuple(terms), weights,
                 tuple(np.array(sorted(number[t.decode()] for t in some), np.int64) for some in items),
                 n_docs or 0, n_terms or 0)


# Bounds

PACKED = ("terms", "ends", "places", "gains", "firsts", "seconds", "joint", "pair_ends", "pair_places")
PAIRED_INDEX = ("doc_ids array<long>, " + "".join(f"{name} binary, " for name in PACKED)
                + "seeds array<struct<item: int, score: long>>")


class Lists:
    """The lists of one segment for the terms of a block, by number: places, and gains times weight."""

    def __init__(self, block: Block, terms: np.ndarray, ends: np.ndarray, places: np.ndarray,
                 gain: np.ndarray):
        self.block = block
        begins = np.concatenate([[0], ends])[:len(ends)].astype(np.int64)
        self.places = {t: places[a:b] for t, a, b in zip(terms.tolist(), begins, ends, strict=True)}
        self.scores = {t: gain[a:b] * block.weights[t]
                       for t, a, b in zip(terms.tolist(), begins, ends, strict=True)}
        self.bound = {t: int(s.max()) for t, s in self.scores.items()}

    def look_up(self, term: int, docs: np.ndarray) -> np.ndarray:
        """What the term adds to the scores of some documents."""
        places = self.places[term]
        at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
        return np.where(places[at] == docs, self.scores[term][at], 0)

    def of_item(self, item: int) -> list[int]:
        return [t for t in self.block.items[item].tolist() if t in self.places]

    def pair(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold both terms, and what both add to their scores."""
        if len(self.places[a]) > len(self.places[b]):
            a, b = b, a
        docs = self.places[a]
        other = self.look_up(b, docs)
        both = other > 0
        return docs[both], self.scores[a][both] + other[both]


def pair_index(index: DataFrame, block: Block, results: int) -> DataFrame:
    """The index of a block's terms with gains, pair lists and scores of promising documents, written."""
    number = {t: i for i, t in enumerate(block.terms)}

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _paired(block, number, results, *[c[row] for c in batch.columns])

    return written(index.select("doc_ids", "lengths", "terms", "holding", "places", "counts")
                   .mapInArrow(run, PAIRED_INDEX), "paired-index")


def _paired(block, number, results, doc_ids, lengths, terms, holding, places, counts):
    lengths = np.frombuffer(lengths.as_py(), "<i8")
    places = np.frombuffer(places.as_py(), "<u2").astype(np.int64)
    counts = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
    holding = np.array(holding.as_py(), np.int64)
    numbers = np.array([number.get(t, -1) for t in terms.as_py()], np.int64)
    kept = numbers >= 0
    inside = np.repeat(kept, holding)
    numbers, places, counts = numbers[kept], places[inside], counts[inside]
    gain = gains(counts, lengths[places], block.n_docs, block.n_terms)
    ends = np.cumsum(holding[kept])
    lists = Lists(block, numbers, ends, places, gain)
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    seeds = []
    for item in range(len(block.items)):
        mine = lists.of_item(item)
        rare = sorted(t for t in block.rarest(item) if t in lists.places)
        best = np.zeros(len(lengths), np.int64)
        for i, a in enumerate(rare):
            for b in rare[i + 1:]:
                if (a, b) not in pairs:
                    pairs[a, b] = lists.pair(a, b)
                docs, joint = pairs[a, b]
                np.maximum.at(best, docs, joint)
        if mine and not best.any():
            top = max(mine, key=lists.bound.__getitem__)
            best[lists.places[top]] = lists.scores[top]
        chosen = np.flatnonzero(best)
        chosen = chosen[np.argsort(-best[chosen], kind="stable")][:SEEDS]
        if len(chosen):
            chosen.sort()
            score = sum((lists.look_up(t, chosen) for t in mine), np.zeros(len(chosen), np.int64))
            seeds += [{"item": item, "score": s}
                      for s in sorted(score[score > 0].tolist(), reverse=True)[:results]]
    sizes = np.cumsum([len(docs) for docs, _ in pairs.values()], dtype=np.int64)
    packed = [numbers.astype("<i8"), ends.astype("<i8"), places.astype("<u2"), gain.astype("<u4"),
              np.array([a for a, _ in pairs], "<i8"), np.array([b for _, b in pairs], "<i8"),
              np.array([int(j.max()) if len(j) else 0 for _, j in pairs.values()], "<i8"),
              sizes.astype("<i8"),
              np.concatenate([np.zeros(0), *[d for d, _ in pairs.values()]]).astype("<u2")]
    kind = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())]))
    return pa.record_batch(
        [pa.array([doc_ids.as_py()], pa.list_(pa.int64())),
         *[pa.array([p.tobytes()], pa.binary()) for p in packed], pa.array([seeds], kind)],
        ["doc_ids", *PACKED, "seeds"])


def least_scores(paired: DataFrame, block: Block, results: int) -> np.ndarray:
    """For each item a score that ``results`` documents of the corpus reach, 1 if none is known."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    found = (paired.select(F.inline("seeds"))
             .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= results)
             .filter(F.col("place") == results))
    least = np.ones(len(block.items), np.int64)
    for item, score, _ in found.collect():
        least[item] = score
    return least


def search_segment(lists: Lists, joint: dict[tuple[int, int], int], item: int, least: int,
                   doc_ids: np.ndarray, results: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The best documents of a segment for an item, as places and scores; ties go to smaller doc_ids.

    Only documents that reach ``least``. Also returns that score as raised here, and how many postings
    were read.
    """
    none = np.zeros(0, np.int64)
    terms = sorted(lists.of_item(item), key=lists.bound.__getitem__)
    # Bounds of the first terms together, weakest first: a pair's joint bound in place of its two.
    bounds, free = [0], set()
    for t in terms:
        mine = lists.bound[t]
        saved, other = 0, None
        for u in free:
            both = joint.get((min(t, u), max(t, u)))
            if both is not None:
                known = lists.bound[u]
                less = mine + known - max(mine, known, both)
                if less > saved:
                    saved, other = less, u
        if other is None:
            free.add(t)
        else:
            free.discard(other)
        bounds.append(bounds[-1] + mine - saved)
    weak = max(k for k in range(len(terms) + 1) if bounds[k] < least)
    total = np.zeros(len(doc_ids), np.int64)
    read = 0
    for t in terms[weak:]:
        total[lists.places[t]] += lists.scores[t]
        read += len(lists.places[t])
    docs = np.flatnonzero(total)
    score = total[docs]
    for k in range(weak, -1, -1):
        if len(docs) >= results:
            least = max(least, int(np.partition(score, len(score) - results)[-results]))
        fine = score + bounds[k] >= least
        docs, score = docs[fine], score[fine]
        if not len(docs):
            return none, none, least, read
        if k:
            score = score + lists.look_up(terms[k - 1], docs)
            read += len(docs)
    order = np.lexsort([doc_ids[docs], -score])[:results]
    return docs[order], score[order], least, read


def search_block(paired: DataFrame, block: Block, least: np.ndarray, results: int) -> DataFrame:
    """``item, doc_id, score``: every segment's best documents, at most ``results`` for an item."""
    def run(batches):
        reached = least.copy()
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, *packed = [c[row].as_py() for c in batch.columns]
                numbers, ends, places, gain, firsts, seconds, bound = [
                    np.frombuffer(raw, kind).astype(np.int64) for raw, kind in
                    zip(packed, ("<i8", "<i8", "<u2", "<u4", "<i8", "<i8", "<i8"), strict=True)]
                lists = Lists(block, numbers, ends, places, gain)
                joint = dict(zip(zip(firsts.tolist(), seconds.tolist(), strict=True),
                                 bound.tolist(), strict=True))
                ids = np.array([2**63 - 1 if i is None else i for i in doc_ids], np.int64)
                out = [], [], []
                for item in range(len(block.items)):
                    docs, score, reached[item], _ = search_segment(
                        lists, joint, item, int(reached[item]), ids, results)
                    for values, more in zip(out, ([item] * len(docs), [doc_ids[d] for d in docs],
                                                  score.tolist()), strict=True):
                        values.extend(more)
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()),
                                       pa.array(out[2], pa.int64())], ["item", "doc_id", "score"])

    return (paired.select("doc_ids", *PACKED[:7])
            .mapInArrow(run, "item int, doc_id long, score long"))


def search(docs: DataFrame, items: DataFrame, results: int = RESULTS, most_terms: int = MOST_TERMS,
           block_terms: int = BLOCK_TERMS, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Each item's best documents: item_id, rank from 1, doc_id, score; equal scores by doc_id, nulls last.

    Items are rows of item_id and text; the same id and text twice are one item, the same id with
    different texts are items of their own. An item without terms, or whose terms no document holds,
    has no rows. Other columns do not matter.
    """
    spark = docs.sparkSession
    asked = items.select(name_column("item_id").alias("item_id"), text_column().alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            terms = [sorted(t.decode() for t in terms_of(text)) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(terms, pa.list_(pa.string()))],
                                  ["item_id", "terms"])

    asked = written(asked.mapInArrow(cut, f"item_id {kind}, terms array<string>")
                    .filter(F.size("terms") > 0), "items")
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    few = [r["term"] for r in vocabulary.limit(most_terms + 1).collect()]
    index = build_index(docs, few if len(few) <= most_terms else None, segment_docs)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = -(-total // block_terms)
    block_of = F.pmod(F.xxhash64("terms"), F.lit(max(1, count)))
    found = []
    for at in range(count):
        rows = asked.filter(block_of == at).collect()
        block = make_block(index, [{t.encode() for t in r["terms"]} for r in rows])
        if not rows or not block.n_terms:
            continue
        paired = pair_index(index, block, results)
        best = search_block(paired, block, least_scores(paired, block, results), results)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = (best.withColumn("rank", F.row_number().over(order))
                  .filter(F.col("rank") <= results))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                      f"item int, item_id {kind}")
        found.append(written(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"),
                             "found"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


ORACLE = """
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents),
sizes AS (SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark),
postings AS (
    SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, totals GROUP BY term),
scored AS (
    SELECT item_id, doc_id, row,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))
               ::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
    GROUP BY item_id, doc_id, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scored WHERE score > 0)
WHERE rank <= 10
"""

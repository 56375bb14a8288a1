"""Near-duplicates by SimHash, found by a generalised pigeonhole.

The 64 bits are dealt into partitions of correlated bits. If partition i is searched up to ``t_i``
differing bits and the ``t_i`` add up to ``distance - partitions + 1`` (a partition with t_i = -1 is
not searched), two fingerprints within the distance agree up to t_i on some partition i. How many
partitions, and which thresholds, is chosen by dynamic programming on numbers of candidates that a
bounded sample of fingerprints predicts; the choice moves cost, never results. Equal fingerprints are
one row before any search.

A probe value that more than ``MOST_SHARING`` fingerprints share would give candidates with the square
of their number. Its fingerprints are joined exactly by another way: two fingerprints are within two
bits if and only if some value is within one bit of both, and at most 65 fingerprints are within one
bit of a value. So each sends itself to its 65 values, and all that meet at one value are linked to
the smallest of them: 65 rows for each, no candidates and no cap.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.batches import (
    flat_computed,
    fresh,
    name_column,
    text_column,
    whole_texts,
    with_computed,
    written,
)
from runloom.llm.components import components

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
SAMPLE = 2000
MOST_SHARING = 32
PARTITIONS = (2, 3, 4)
_MAJORITY = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the hashes of the text's word shingles."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and white space of one byte only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(some), SEED)
                  for some in zip(*[words[i:] for i in range(shingle)], strict=False)]
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 300:
        ones = np.unpackbits(values, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(values[:, i], minlength=256) @ _MAJORITY
                               for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit integer) of every row's whole text; a null text is empty."""
    rows = docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text"))

    def start():
        def work(doc_ids, texts):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            return doc_ids, found
        return work

    return flat_computed(rows, [rows.schema["doc_id"], T.StructField("fp", T.LongType())], start)


# Partitions and thresholds

def sample_bits(distinct: DataFrame) -> np.ndarray:
    """Up to SAMPLE fingerprints, the first by a hash of their own, as rows of 64 bits."""
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    values = np.array([r["fp"] for r in some], np.int64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(values, axis=1, bitorder="little")


def group_bits(bits: np.ndarray, count: int) -> list[list[int]]:
    """``count`` partitions of like size; bits that go together are put together."""
    spread = bits.std(axis=0) if len(bits) > 1 else np.zeros(BITS)
    near = np.zeros((BITS, BITS))
    moving = np.flatnonzero(spread > 0)
    if len(moving) > 1:
        near[np.ix_(moving, moving)] = np.abs(np.corrcoef(bits[:, moving].T.astype(float)))
    left, groups = list(range(BITS)), []
    for k in range(count):
        size = BITS // count + (k < BITS % count)
        group = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (near[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on, one for each partition, that add up to ``total`` at least cost.

    ``costs[i][t + 1]`` is the cost of searching partition i up to t bits.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                key, value = spent + t, cost + more
                if key not in following or value < following[key][0]:
                    following[key] = (value, [*chosen, t])
        best = following
    return best[total]


def plan_search(distinct: DataFrame, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds with the least predicted probes and candidates a fingerprint."""
    bits = sample_bits(distinct)
    rows = distinct.count()
    best = None
    for count in PARTITIONS:
        groups, costs = group_bits(bits, count), []
        for group in groups:
            row = [0.0]
            part = bits[:, group].astype(np.float32)
            norm = part.sum(axis=1)
            apart = norm[:, None] + norm[None, :] - 2 * part @ part.T
            probes = 0
            for t in range(distance + 1):
                probes += len(list(combinations(group, t)))
                # Others of the sample within t bits, for each fingerprint of it; unseen values hold
                # what evenly spread ones would. Above MOST_SHARING the detour's rows are the cost.
                seen = (np.count_nonzero(apart <= t + 0.5, axis=1) - 1) / max(len(bits), 1)
                candidates = np.maximum(seen, probes / 2.0 ** len(group)) * rows
                candidates = np.where(candidates > MOST_SHARING, BITS + 1, candidates)
                row.append(probes + (float(candidates.mean()) if len(bits) else 0.0))
            costs.append(row)
        cost, chosen = allocate(costs, distance - count + 1)
        if best is None or cost < best[0]:
            best = (cost, groups, chosen)
    return best[1], best[2]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def links(distinct: DataFrame, groups: list[list[int]], thresholds: list[int],
          distance: int = DISTANCE, most_sharing: int = MOST_SHARING) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, of which none is lost between components.

    Pairs at a light value are verified one by one. The detour of heavy values is for a distance of
    two; other distances keep all values on the main way.
    """
    probes = [F.struct(F.lit(i).alias("part"), F.lit(k == 0).alias("own"),
                       F.col("fp").bitwiseAND(F.lit(_mask(group))).bitwiseXOR(F.lit(_mask(flip)))
                       .alias("value"))
              for i, (group, t) in enumerate(zip(groups, thresholds, strict=True))
              for k, flip in enumerate(f for size in range(t + 1)
                                       for f in combinations(group, size))]
    rows = written(distinct.select("fp", F.explode(F.array(*probes)).alias("p"))
                   .select("fp", "p.part", "p.own", "p.value"), "probes")
    sharing = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"),
                                                F.max("own").alias("met"))
    shared = written(sharing.filter("n > 1 and met").select("part", "value", "n"), "shared")
    met = rows.join(shared, ["part", "value"])
    light = met.filter(F.col("n") <= most_sharing) if distance == DISTANCE else met
    left = light.filter("own").select("part", "value", F.col("fp").alias("a"))
    right = light.select("part", "value", F.col("fp").alias("b"))
    pairs = (left.join(right, ["part", "value"])
             .filter((F.col("a") != F.col("b"))
                     & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
             .select("a", "b"))
    if distance != DISTANCE:
        return pairs.distinct()
    heavy = met.filter(F.col("n") > most_sharing).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)])
    at = written(heavy.select("fp", F.explode(near).alias("value")), "near_values")
    least = (at.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("last"))
             .filter("a <> last").select("value", "a"))
    stars = (at.join(least, "value").filter("fp <> a").select("a", F.col("fp").alias("b")))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    most_sharing: int = MOST_SHARING) -> DataFrame:
    """``doc_id, fp, component_id, root`` for every row of ``docs``.

    component_id is the smallest doc_id that links reach, root the smallest fingerprint of the
    component. Empty and null texts have fingerprint zero and are linked like any other. Repeated
    rows stay, a null doc_id is never smallest unless all are null, and an empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups, thresholds = plan_search(distinct.select("fp"), distance)
    found = written(links(distinct.select("fp"), groups, thresholds, distance, most_sharing), "pairs")
    if found.isEmpty():
        named = distinct.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        roots = components(found).withColumnRenamed("node", "fp")
        rooted = written(distinct.join(roots, "fp", "left")
                         .withColumn("root", F.coalesce("root", "fp")), "rooted")
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(written(named, "components"), "fp")


def query_rows(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with its smallest doc_id.

    Of several rows with that doc_id, or of a component without any doc_id, the row with the smallest
    fingerprint stays, of those the one with the smallest hash of its text; never more than one.
    """
    found = written(near_duplicates(docs).select("doc_id", "fp", "root", "component_id"), "near")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("kept"))
    key, kept_id, kept_fp = name_column("doc_id"), fresh(docs, "kept_id"), fresh(docs, "kept_fp")
    # Mostly one row per copy: written, so that Spark knows whether it is small enough to broadcast.
    apart = written(counts.filter("doc_id is not null and (n > 1 or kept = 0)")
                    .select(F.col("doc_id").alias(kept_id)), "apart")
    whole = docs.filter(key.isNotNull()).join(apart, key == F.col(kept_id), "left_anti")
    many = counts.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("id"))
    again = written(found.filter(stays).join(many, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
                    .groupBy("root").agg(F.min("doc_id").alias(kept_id), F.min("fp").alias(kept_fp))
                    .drop("root"), "repeated")
    if again.isEmpty():
        return whole
    rows = docs.join(again, key.eqNullSafe(F.col(kept_id)), "left_semi")
    mark = fresh(docs, "fp")

    def start():
        return lambda texts: [np.array([fingerprint(t) for t in whole_texts(texts)],
                                       np.uint64).view(np.int64)]

    marked = with_computed(rows, ["text"], [T.StructField(mark, T.LongType())], start)
    marked = marked.join(again, key.eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_fp)),
                         "left_semi")
    # Pre-aggregated before the shuffle, so a row that is repeated without end is one row per task.
    names = docs.columns
    one = (marked.groupBy(key.alias("k1"), F.col(mark).alias("k2"))
           .agg(F.min_by(F.struct(*[name_column(c) for c in names]),
                         F.struct(F.xxhash64("text"), F.length("text"))).alias("row")))
    return whole.unionByName(one.select(*[F.col("row")[c].alias(c) for c in names]))

"""Nearest neighbours by stable projections and kd-trees.

Largest inner product is first made a smallest distance: every vector gets one more component, so that
all have the length of the longest, and queries get a zero there. Projections on a few random normal
directions (a 2-stable distribution) then shrink a distance d to d * sqrt(chi-square with as many
degrees of freedom). Rows are dealt into blocks; each block's projections are indexed by a kd-tree, and
a query takes its projected neighbours in ascending order, leaf by leaf, and verifies them on the
original vectors. It stops when a row as near as its k-th best so far would have shown up by now with
probability ``SURE``: the chi-square distribution of (projected distance / k-th best distance)^2 has
reached it. Ties and scores are settled exactly in double precision.

Every row is indexed; nothing is sampled. Queries are dealt into blocks too, and every block of queries
meets every block of rows once, as packed arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.batches import name_column, written

DIRECTIONS = 8
SURE = 0.97
NEIGHBOURS = 20
QUERY_EVERY = 20
LEAF = 128
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
SEED = 20
MOST_TASKS = 100_000


def chi_square(value: float, freedom: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if value <= 0:
        return 0.0
    a, x = freedom / 2.0, value / 2.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-13:
        n += 1.0
        term *= x / n
        total += term
        if n > 10_000:
            return 1.0
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < share:
        high *= 2.0
    for _ in range(60):
        middle = (low + high) / 2.0
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return high


class KdTree:
    """Leaves of at most ``leaf`` points with their boxes, in the order of the tree."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds, waiting = [], [(0, len(points))]
        while waiting:
            begin, end = waiting.pop()
            if end - begin <= leaf:
                bounds.append((begin, end))
                continue
            own = self.order[begin:end]
            axis = int(np.ptp(points[own], axis=0).argmax())
            middle = (end - begin) // 2
            self.order[begin:end] = own[np.argpartition(points[own, axis], middle)]
            waiting += [(begin, begin + middle), (begin + middle, end)]
        self.leaves = sorted(bounds)
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in self.leaves])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in self.leaves])

    def distances(self, query: np.ndarray) -> np.ndarray:
        """The squared distance of a query to the box of every leaf."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0.0)
        return np.einsum("ij,ij->i", gap, gap)


class Block:
    """Rows of one block: ids ascending, vectors in double precision, the tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, directions: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        square = np.einsum("ij,ij->i", self.vectors, self.vectors)
        rest = np.sqrt(np.maximum(longest ** 2 - square, 0.0))
        self.longest = longest
        self.tree = KdTree(np.column_stack([self.vectors, rest]) @ directions)
        self.directions = directions
        # Verified leaf by leaf, so vectors and ids lie in the order of the tree.
        self.leaf_vectors = self.vectors[self.tree.order]

    def search(self, query_id: int, query: np.ndarray, k: int,
               limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest found, ties to smaller ids; the query's own row not.

        ``limit`` is the chi-square quantile of the stopping test.
        """
        far = float(query @ query) + self.longest ** 2  # squared distance = far - 2 * product
        slack = 1e-9 * max(far, 1e-300)  # equal vectors must not fall to rounding
        projected = np.append(query, 0.0) @ self.directions
        box = self.tree.distances(projected)
        order = np.argsort(box, kind="stable")
        kept = np.zeros(0, np.int64)
        products = np.zeros(0)
        bound, at = -np.inf, 0
        while at < len(order):
            if box[order[at]] > limit * max(far - 2.0 * bound, 0.0) + slack:
                break
            # Some leaves at a time: verifying one more leaf than asked loses nothing.
            some = order[at:at + max(1, min(16, at))]
            at += len(some)
            places = np.concatenate([np.arange(*self.tree.leaves[i]) for i in some])
            found = self.leaf_vectors[places] @ query
            near = found >= bound - slack
            kept = np.concatenate([kept, self.tree.order[places][near]])
            products = np.concatenate([products, found[near]])
            if len(kept) > k + 1:
                # One more than k, since the query's own row may be among them; ties stay.
                line = np.partition(products, len(products) - k - 1)[len(products) - k - 1]
                bound = max(bound, float(line))
                stay = products >= bound - slack
                kept, products = kept[stay], products[stay]
        kept = np.sort(kept)  # ids ascend with places
        kept = kept[self.ids[kept] != query_id]
        # Row by row, so equal vectors have equal scores wherever they lie.
        exact = (self.vectors[kept] * query).sum(axis=1)
        best = np.argsort(-exact, kind="stable")[:k]
        return self.ids[kept][best], exact[best]


def usable(embeddings: DataFrame, width: int | None = None) -> DataFrame:
    """``vec_id, v`` of the rows that take part: vectors of finite numbers, not all zero.

    Vectors of another length than ``width``, if not given the most frequent one (the longer of two as
    frequent), take no part either. Rows with a null id take no part; repeated rows each take part.
    """
    vector = name_column("embedding").cast("array<double>")
    rows = (embeddings.select(name_column("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                    & F.exists("v", lambda x: x != 0)))
    if width is None:
        sizes = (rows.groupBy(F.size("v").alias("n")).count()
                 .orderBy(F.desc("count"), F.desc("n")).first())
        width = sizes["n"] if sizes else 0
    return rows.filter(F.size("v") == width)


def packed(rows: DataFrame, blocks: int, per_task: str = "block") -> DataFrame:
    """One row per block: its number, ids and vectors as bytes; blocks are dealt by a hash of the row."""
    dealt = rows.withColumn(per_task, F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    sorted_rows = dealt.repartition(blocks, per_task).sortWithinPartitions(per_task, "vec_id")

    def run(batches):
        ids, vectors, current = [], [], None

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()),
                 pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary())],
                names=["block", "ids", "vectors"])

        for batch in batches:
            block = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if current is not None and block[a] != current:
                    yield close()
                    ids, vectors = [], []
                current = int(block[a])
                piece = batch.slice(a, b - a)
                ids.append(piece.column(0).to_numpy())
                vectors.append(piece.column(1).flatten().to_numpy(zero_copy_only=False))
        if current is not None:
            yield close()

    return sorted_rows.select("vec_id", "v", per_task).mapInArrow(
        run, "block int, ids binary, vectors binary")


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, directions: int = DIRECTIONS,
            sure: float = SURE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product found for each query.

    ``embeddings`` and ``queries`` have vec_id and embedding. Rows with the query's own id are not
    candidates. Equal queries are answered once each. Ties go to the smaller vec_id; with fewer than k
    candidates all are returned. Empty tables give no rows. Only the result of each block is sent on,
    at most k rows for a query, packed.
    """
    spark = embeddings.sparkSession
    rows = written(usable(embeddings), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(
        F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    width, longest = facts["width"], math.sqrt(facts["longest"]) * (1 + 1e-12)
    asked = written(usable(queries, width).distinct(), "queries")
    many = asked.count()
    blocks = max(1, math.ceil(facts["n"] / block_rows))
    query_blocks = max(1, math.ceil(many / QUERY_ROWS))
    left = written(packed(rows, blocks), "blocks")
    right = written(packed(asked, query_blocks), "query_blocks")
    # Every block of rows with every block of queries; each pair has a key of its own, so that the
    # pairs are dealt evenly, however few blocks one side has.
    pairs = blocks * query_blocks
    tasks = max(2, min(pairs, MOST_TASKS))
    rows_side = left.select("block", "ids", "vectors", F.explode(
        F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    query_side = right.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"),
                              F.col("vectors").alias("query_vectors"), F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = (rows_side.repartition(tasks, "block", "query_block")
           .join(query_side.repartition(tasks, "block", "query_block"), ["block", "query_block"])
           .select("ids", "vectors", "query_ids", "query_vectors"))
    random = np.random.default_rng(SEED).standard_normal((width + 1, directions))
    limit = chi_square_quantile(sure, directions)

    def search(batches):
        known, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                if known != row["ids"]:
                    known = row["ids"]
                    block = Block(ids, np.frombuffer(row["vectors"], "<f8").reshape(-1, width),
                                  longest, random)
                asked_ids = np.frombuffer(row["query_ids"], "<i8")
                vectors = np.frombuffer(row["query_vectors"], "<f8").reshape(-1, width)
                out = [block.search(int(i), v, k, limit)
                       for i, v in zip(asked_ids, vectors, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked_ids, pa.int64()), pa.array([v.tolist() for v in vectors],
                                                               pa.list_(pa.float64())),
                     pa.array([o[0].tolist() for o in out], pa.list_(pa.int64())),
                     pa.array([o[1].tolist() for o in out], pa.list_(pa.float64()))],
                    names=["query_id", "query", "vec_ids", "scores"])

    found = written(met.mapInArrow(search, "query_id long, query array<double>, vec_ids array<long>, "
                                           "scores array<double>"), "found")

    # The best of the blocks' lists; a query's lists come one after another.
    def best(batches):
        key, mine = None, []

        def close():
            mine.sort()
            some = mine[:k]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(some), pa.int64()),
                 pa.array(range(1, len(some) + 1), pa.int32()),
                 pa.array([i for _, i in some], pa.int64()),
                 pa.array([-s for s, _ in some], pa.float64())],
                names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if key is not None and key != (row["query_id"], row["query_hash"]):
                    yield close()
                    mine = []
                key = row["query_id"], row["query_hash"]
                mine += [(-s, i) for i, s in zip(row["vec_ids"], row["scores"], strict=True)]
                if len(mine) > 1000:
                    mine = sorted(mine)[:k]
        if key is not None:
            yield close()

    lists = (found.select("query_id", F.xxhash64("query").alias("query_hash"), "vec_ids", "scores")
             .repartition("query_id", "query_hash").sortWithinPartitions("query_id", "query_hash"))
    return lists.mapInArrow(best, schema)


def query_rows(embeddings: DataFrame) -> DataFrame:
    """The contract's queries, every row whose vec_id is divisible by QUERY_EVERY, against all rows."""
    return nearest(embeddings, embeddings.filter(name_column("vec_id") % QUERY_EVERY == 0))


def brute_force(embeddings: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """All inner products of a few queries, for measuring recall."""
    rows, asked = usable(embeddings), usable(queries).select(F.col("vec_id").alias("query_id"),
                                                             F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.join(F.broadcast(asked), F.col("vec_id") != F.col("query_id"))
            .select("query_id", "vec_id", product.alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


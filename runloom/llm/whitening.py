"""Whitening of embeddings by the eigenvalues and eigenvectors of their exact covariance.

Entries become integers, so the scatter of the distinct vectors is a matrix of integers, added up
without rounding: tasks multiply limbs of the entries in doubles that hold every product and sum
exactly, and Spark adds up one matrix per task. Its characteristic polynomial is worked out modulo many
primes, each in a task, and put together by remainders; its largest roots are isolated and refined, and
each root's eigenvectors are solved for in a task. What reaches the driver is of the size of the
matrix, whatever the number of rows; the distinct vectors are written to the shared folder once.

A vector takes part if it has entries, none of them null, not finite or of magnitude 2^56 or more, and
as many as most of the distinct vectors have (of equally frequent lengths, the smallest). Repeated rows
stay rows, but count once in every covariance. Directions without variance have no whitened value:
their rows hold null. A deviation that no long can hold is null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import char_poly
from runloom.llm.batches import name_column, written

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
LARGEST = 2.0**56
LIMB = 20        # bits of an entry that are multiplied at a time
EXACT_ROWS = 4096  # rows whose products of limbs add up below 2^53
DIGIT = 1 << 56  # sums travel in digits of this base
ROWS_AT_ONCE = 2048


def coded(embeddings: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """``code``, the long integers x = floor(64 * c) + 1000000 of a vector as bytes, after its ``key``."""
    keys = [name_column(key).alias("key")] if key else []
    rows = embeddings.select(*keys, name_column(vector).cast("array<double>").alias("vector"))

    def run(batches):
        for batch in batches:
            kept, code = _codes(batch.column(batch.num_columns - 1))
            columns = [c.filter(pa.array(kept)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, code], [*batch.schema.names[:-1], "code"])

    kind = "".join(f"key {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kind}code binary")


def _codes(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which vectors take part, and their codes."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    lengths = lengths.astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(lists), math.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        fine = np.abs(flat) < LARGEST
    before = np.concatenate([[0], np.cumsum(~fine)])
    ends = np.cumsum(lengths)
    kept = (lengths > 0) & (before[ends] == before[ends - lengths])
    codes = np.where(fine, scaled, 0).astype("<i8")[np.repeat(kept, lengths)] + OFFSET
    offsets = np.concatenate([[0], np.cumsum(lengths[kept] * 8)]).astype(np.int32)
    return kept, pa.Array.from_buffers(pa.binary(), int(kept.sum()),
                                       [None, pa.py_buffer(offsets), pa.py_buffer(codes)])


def _matrix(codes: pa.Array, width: int) -> np.ndarray:
    """Codes of one width as rows of integers, without the offset, which no covariance depends on."""
    values = b"".join(codes.to_pylist())
    return np.frombuffer(values, "<i8").reshape(-1, width) - OFFSET


def _add_up(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's sums of entries (row -1) and of products of entries, as digits with their places."""
    total = np.zeros((width + 1, width), object)
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, EXACT_ROWS):
            x = _matrix(batch.column(0).slice(at, EXACT_ROWS), width)
            rows += len(x)
            limbs, rest = [], x
            while rest.any() and len(limbs) < 4:
                # The last limb keeps the sign.
                low = rest if np.abs(rest).max() < 1 << LIMB else rest & ((1 << LIMB) - 1)
                limbs.append(low.astype(np.float64))
                rest = rest - low >> LIMB
            for i, left in enumerate(limbs):
                total[width] += left.sum(axis=0).astype(np.int64).astype(object) << LIMB * i
                for j, right in enumerate(limbs):
                    total[:width] += (left.T @ right).astype(np.int64).astype(object) << LIMB * (i + j)
    out: dict[str, list[int]] = {"i": [-1], "j": [-1], "place": [0], "digit": [rows]}
    for i in range(width + 1) if rows else ():
        for j in range(min(i, width - 1) + 1) if i < width else range(width):
            value, place = total[i, j], 0
            while value:
                sign = -1 if value < 0 else 1
                value, digit = divmod(abs(value), DIGIT)
                for name, number in (("i", i), ("j", j), ("place", place), ("digit", sign * digit)):
                    out[name].append(number)
                value, place = sign * value, place + 1
    yield pa.record_batch([pa.array(out["i"], pa.int32()), pa.array(out["j"], pa.int32()),
                           pa.array(out["place"], pa.int32()), pa.array(out["digit"], pa.int64())],
                          ["i", "j", "place", "digit"])


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """The number of vectors, their sums and n^2 times their covariance, all without the offset."""
    parts = (fit.mapInArrow(lambda batches: _add_up(batches, width),
                            "i int, j int, place int, digit long")
             .groupBy("i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("sum")))
    n, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for i, j, place, value in parts.collect():
        value = int(value) * DIGIT**place
        if i < 0:
            n = value
        elif i == width:
            sums[j] += value
        else:
            products[i][j] += value
    scatter = [[n * products[max(i, j)][min(i, j)] - sums[i] * sums[j] for j in range(width)]
               for i in range(width)]
    return n, sums, scatter


def in_tasks(spark: SparkSession, items: Sequence, work: Callable, tasks: int) -> list:
    """``work`` on each of a few items, spread over tasks; items and results travel as JSON."""
    rows = spark.createDataFrame([(i, json.dumps(item)) for i, item in enumerate(items)],
                                 "place int, item string").repartitionByRange(tasks, "place")

    def run(batches):
        for batch in batches:
            done = [json.dumps(work(json.loads(item))) for item in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(done, pa.string())], ["place", "done"])

    found = rows.mapInArrow(run, "place int, done string").collect()
    return [json.loads(r["done"]) for r in sorted(found)]


@dataclass(frozen=True)
class Whitening:
    """The fitted directions of vectors of ``width`` entries.

    ``n`` distinct vectors with the sums ``sums``, less the offset; ``trace`` of n^2 times their
    covariance. ``directions`` holds unit eigenvectors as rows, ``roots`` their eigenvalues times n^2,
    falling. There are ``components`` of them asked for, and fewer if the others have no variance.
    """

    width: int
    n: int
    sums: tuple[int, ...]
    trace: int
    components: int
    roots: tuple[tuple[int, int], ...]
    directions: np.ndarray

    def explained(self) -> list[float]:
        return [root / (self.trace << bits) for root, bits in self.roots]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: long integers, or Python's where those are too small."""
        most = max(map(abs, self.sums)) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if most < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if not len(centred):
            return []
        if centred.dtype != object and int(np.abs(centred).max()) ** 2 * self.width < 2**63:
            return (centred * centred).sum(axis=1).tolist()
        whole = centred.astype(object)
        return [int(d) if d < 2**63 else None for d in (whole * whole).sum(axis=1)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """One column per direction: the centred vector along it, over the root of its variance."""
        scale = [math.sqrt(root / (1 << bits)) for root, bits in self.roots]
        return centred.astype(np.float64) @ (self.directions / np.array(scale)[:, None]).T


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Directions of the distinct vectors in ``fit`` (column code); None if there are none."""
    spark = fit.sparkSession
    widths = fit.groupBy((F.octet_length("code") / 8).cast("int").alias("width")).count()
    first = widths.orderBy(F.desc("count"), "width").first()
    if first is None:
        return None
    width = first["width"]
    n, sums, scatter = exact_sums(of_width(fit, width), width)
    trace = sum(scatter[i][i] for i in range(width))
    tasks = max(2, spark.sparkContext.defaultParallelism)
    moduli = char_poly.enough_primes(width, trace)
    residues = in_tasks(spark, moduli, lambda p: char_poly.poly_mod(scatter, p),
                        min(len(moduli), tasks))
    roots = char_poly.largest_roots(char_poly.combine(moduli, residues), min(components, width))
    found = in_tasks(spark, roots, lambda r: char_poly.eigenvectors(scatter, *r).tolist(),
                     max(1, len(roots)))
    directions = [vector for some in found for vector in some][:components]
    values = [(root, bits) for root, bits, times in roots for _ in range(times)][:components]
    return Whitening(width, n, tuple(sums), trace, min(components, width), tuple(values),
                     np.array(directions).reshape(-1, width))


def of_width(rows: DataFrame, width: int) -> DataFrame:
    return rows.filter(F.octet_length("code") == 8 * width)


def identity_error(fit: DataFrame, white: Whitening) -> float | None:
    """The largest entry, by magnitude, of the whitened vectors' covariance less the identity."""
    size = len(white.roots)

    def run(batches):
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _matrix(batch.column(0).slice(at, ROWS_AT_ONCE), white.width)
                w = white.whitened(white.centred(x))
                total += w.sum(axis=0)
                products += w.T @ w
        rows = np.vstack([products, total])
        i, j = np.indices(rows.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                               pa.array(rows.ravel())], ["i", "j", "sum"])

    if not size:
        return None
    sums = np.zeros((size + 1, size))
    for i, j, value in (of_width(fit, white.width).mapInArrow(run, "i int, j int, sum double")
                        .groupBy("i", "j").agg(F.sum("sum")).collect()):
        sums[i, j] = value
    # The vectors are centred already; what is left of their means is rounding.
    means = sums[size] / white.n
    return float(np.abs(sums[:size] / white.n - np.outer(means, means) - np.eye(size)).max())


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """For each vector that takes part and each component: its whitened value and the component's share.

    Columns ``key``, component from 1 by falling variance, n, deviation, whitened, explained,
    identity_error. Other columns of ``embeddings`` do not matter.
    """
    fit = written(coded(embeddings, vector).distinct(), "distinct-vectors")
    white = fit_whitening(fit, components)
    kind = embeddings.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if white is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, white)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    count, size = white.components, len(white.roots)
    share = np.array([*white.explained(), *[0.0 if white.trace else math.nan] * (count - size)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                centred = white.centred(_matrix(piece.column(1), white.width))
                rows = len(centred)
                values = np.full((rows, count), math.nan)
                values[:, :size] = white.whitened(centred) if size else 0
                each = np.repeat(np.arange(rows), count)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, white.n)),
                    pa.array(white.deviations(centred), pa.int64()).take(pa.array(each)),
                    pa.array(values.ravel(), from_pandas=True),
                    pa.array(np.tile(share, rows), from_pandas=True),
                    pa.array([error] * (rows * count), pa.float64())], names)

    return of_width(coded(embeddings, vector, key), white.width).mapInArrow(run, schema)

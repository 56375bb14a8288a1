"""Toxicity by logistic regression, trained with FTRL-proximal steps.

Features are hashed words, their stems (first four and five letters), pairs of neighbouring words and
skip-grams (pairs with one or two words between them), each counted once in a text. Every weight has a learning rate of its own, and the L1
term keeps weights at zero until enough evidence stands against it, so a model is a short list of
buckets and weights that is broadcast whatever the corpus' size.

The model is fitted on at most ``SAMPLE`` labelled rows, the first by a hash of their ids; this bound
is a parameter. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.batches import (
    flat_computed,
    fresh,
    name_column,
    text_column,
    whole_texts,
    with_computed,
)
from runloom.llm.features import WORD, WordHashes, mixed

BITS = 20
SAMPLE = 12_000
FOLDS = 5  # of labelled rows, fold 0 by crc32 of the id is held out
EPOCHS = 3
STEMS = (4, 5)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
BIAS = -1  # the bucket of the bias in a model


def buckets(text: str, words: WordHashes) -> np.ndarray:
    """The buckets of a whole text's words, stems, word pairs and skip-grams, repeats included."""
    hashes = words.of(WORD.findall(text.lower()))
    whole = hashes[0]
    found = [row * np.uint64(2 * i + 1) for i, row in enumerate(hashes)]
    for gap in (1, 2, 3):
        if len(whole) > gap:
            found.append(mixed(whole[:-gap] + np.uint64(gap), whole[gap:]))
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Follow the regularised leader: z and n of every bucket, from which its weight follows."""

    def __init__(self, size: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA,
                 l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, z, n):
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n ** 0.5) / self.alpha)

    def learn(self, found: np.ndarray, label: int) -> None:
        z, n = self.z[found], self.n[found]
        weights = self.weights(z, n)
        gradient = sigmoid(weights.sum() + self.bias()) - label
        square = gradient * gradient
        grown = np.sqrt(n + square)
        self.z[found] = z + gradient - (grown - np.sqrt(n)) / self.alpha * weights
        self.n[found] = n + square
        step = ((self.bias_n + square) ** 0.5 - self.bias_n ** 0.5) / self.alpha
        self.bias_z += gradient - step * self.bias()
        self.bias_n += square


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled ids outside the held-out fold: label_id, label, place.

    An id with several labels is toxic if one of them says so; null ids and labels take no part.
    """
    key = name_column("doc_id")
    return (labels.filter(key.isNotNull() & name_column("toxic").isNotNull())
            .filter(F.crc32(key.cast("string")) % FOLDS != 0)
            .groupBy(key.alias("label_id"))
            .agg(F.max(F.when(name_column("toxic") > 0, 1).otherwise(0)).alias("label"))
            .withColumn("place", F.xxhash64("label_id"))
            .orderBy("place", "label_id").limit(sample))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
          epochs: int = EPOCHS) -> dict[int, float]:
    """The weights by bucket that are not zero, and the bias.

    The labelled ids are bounded by ``sample``, so they are broadcast, their buckets are found where
    their texts lie, and one task takes the steps, in an order fixed by a hash of the ids. Without a
    toxic row the model is empty, and every score is 0.
    """
    some = F.broadcast(training_labels(labels, sample))
    rows = docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text"))
    rows = rows.join(some, rows["doc_id"] == some["label_id"]).select("place", "text", "label")

    def start():
        words = WordHashes(STEMS)
        return lambda places, texts, known: (places,
                                             [np.unique(buckets(t, words)) for t in texts],
                                             known)

    fields = [T.StructField("place", T.LongType()), T.StructField("found", T.ArrayType(T.LongType())),
              T.StructField("label", T.IntegerType())]
    found = flat_computed(rows, fields, start).repartition(1).sortWithinPartitions("place", "label")

    def steps(batches):
        texts, known = [], []
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                texts.append(values[a:b].astype(np.int32))
            known += batch.column(2).to_pylist()
        if not any(known):
            return
        model = Ftrl()
        for _ in range(epochs):
            for buckets_of_text, label in zip(texts, known, strict=True):
                model.learn(buckets_of_text, label)
        weights = model.weights(model.z, model.n)
        chosen = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([BIAS, *chosen.tolist()], pa.int64()),
             pa.array([model.bias(), *weights[chosen].tolist()], pa.float64())],
            names=["bucket", "weight"])

    # At most 2 ** BITS + 1 rows, of which L1 leaves a few thousand.
    return {r["bucket"]: r["weight"]
            for r in found.mapInArrow(steps, "bucket long, weight double").collect()}


def score(docs: DataFrame, model: dict[int, float], into: str = "score") -> DataFrame:
    """``docs`` plus the score of every whole text, 0 to 1.

    A null text is empty, and an empty text scores what the bias says. All rows and columns stay; if
    ``into`` is taken, the new column gets underscores at its end.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    out = fresh(docs, into)

    def start():
        weights = np.zeros(1 << BITS)
        for bucket, weight in shared.value.items():
            if bucket >= 0:
                weights[bucket] = weight
        bias = shared.value.get(BIAS)
        words = WordHashes(STEMS)

        def work(texts):
            if bias is None:
                return [[0.0] * len(texts)]
            return [[one(t) for t in whole_texts(texts)]]

        def one(text):
            found = buckets(text, words)
            # Almost all weights are zero; only the others are told apart.
            told = np.unique(found[weights[found] != 0])
            return float(sigmoid(weights[told].sum() + bias))
        return work

    return with_computed(docs, ["text"], [T.StructField(out, T.DoubleType())], start)


def query_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false without an id), score, predicted for every row of ``docs``."""
    model = train(docs, labels)
    rows = score(docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text")), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score",
                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``at``, with the columns they had."""
    mark = fresh(docs, "score")
    return score(docs, train(docs, labels)).filter(name_column(mark) < at).drop(mark)

"""FTRL steps against a plain version, scores against a plain sum, held-out accuracy."""

import math
import zlib

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from runloom.llm import toxicity as X
from runloom.llm.features import WordHashes
from runloom.llm.queries import QUERIES


def plain_ftrl(texts, labels, alpha, beta, l1, l2, epochs):
    """The published update, one coordinate at a time."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = math.copysign(1.0, z[i])
        return -(z[i] - sign * l1) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def bias_weight():
        return -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)

    for _ in range(epochs):
        for found, label in zip(texts, labels, strict=True):
            p = 1 / (1 + math.exp(-(sum(weight(i) for i in found) + bias_weight())))
            g = p - label
            for i in found:
                w = weight(i)
                old = n.get(i, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = old + g * g
            sigma = (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / alpha
            w = bias_weight()
            bias = [bias[0] + g - sigma * w, bias[1] + g * g]
    return {i: weight(i) for i in z}, -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)


def test_steps_against_the_plain_version():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 40, 8)) for _ in range(120)]
    labels = [int(3 in t) for t in texts]
    model = X.Ftrl(64, alpha=0.7, beta=1.0, l1=0.4, l2=0.3)
    for _ in range(3):
        for t, y in zip(texts, labels, strict=True):
            model.learn(t, y)
    want, bias = plain_ftrl([t.tolist() for t in texts], labels, 0.7, 1.0, 0.4, 0.3, 3)
    got = model.weights(model.z, model.n)
    assert all(got[i] == pytest.approx(w, abs=1e-9) for i, w in want.items())
    assert model.bias() == pytest.approx(bias, abs=1e-9)
    assert (got == 0).sum() > 24 and got[3] == max(got)


def corpus(spark, toxic="vile", n=300):
    docs = [(i, f"some words number {i} of a text {toxic if i % 4 == 0 else 'mild'} end") for i in range(n)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(n)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_query_against_a_plain_sum(spark):
    docs, labels = corpus(spark)
    model = X.train(docs, labels)
    words = WordHashes(X.STEMS)
    got = {r["doc_id"]: r for r in X.query_rows(docs, labels).collect()}
    for r in docs.collect():
        total = model[X.BIAS] + sum(model.get(int(b), 0.0) for b in set(X.buckets(r["text"], words).tolist()))
        row = got[r["doc_id"]]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert row["predicted"] == int(row["score"] >= 0.5) == int(r["doc_id"] % 4 == 0)


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.train(docs, labels) == X.train(docs, flipped)


def test_odd_documents_and_labels(spark):
    docs, labels = corpus(spark)
    more = labels.union(spark.createDataFrame(
        [(None, 1, 1), (8, None, 0), (8, 0, 1), (4, 0, None), (4, 1, 1)], labels.schema))
    model = X.train(docs.union(odd.odd_documents(spark).select("doc_id", "text")), more)
    rows = X.score(odd.odd_documents(spark), model)
    assert rows.columns == [*odd.odd_documents(spark).columns, "score_"]
    scores = rows.collect()
    assert len(scores) == len(odd.TEXTS) and all(0.0 <= r["score_"] <= 1.0 for r in scores)
    empty = {r["score_"] for r in scores if not (r["text"] or "").strip()}
    assert len(empty) == 1
    kept = X.drop_toxic(odd.odd_documents(spark), labels)
    assert kept.columns == odd.odd_documents(spark).columns
    assert odd.keyed(kept.collect()) == odd.keyed(odd.odd_rows())


def test_empty_tables(spark):
    docs, labels = corpus(spark, n=8)
    assert X.query_rows(odd.no_documents(spark), labels).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 0")):
        rows = X.query_rows(docs, none).collect()
        assert {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_toxicity"](spark, folder).collect()
            if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows)
    up = [r["score"] for r in rows if labels[r["doc_id"]]]
    down = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert right >= 0.93
    assert np.mean([a > b for a in up for b in down]) >= 0.95

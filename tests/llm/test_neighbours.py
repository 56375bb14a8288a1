"""Neighbours against brute force: recall, ties, and rows that take no part."""

import numpy as np
import pytest

from runloom.llm import neighbours as N
from runloom.llm.queries import QUERIES


def plain(ids, vectors, query_id, query, k):
    scores = (vectors * query).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query_id][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_chi_square():
    assert N.chi_square(7.815, 3) == pytest.approx(0.95, abs=1e-4)
    assert N.chi_square(18.307, 10) == pytest.approx(0.95, abs=1e-4)
    assert N.chi_square_quantile(0.9, 8) == pytest.approx(13.362, abs=1e-3)
    assert N.chi_square(0, 4) == 0.0


def test_tree_boxes_hold_their_points():
    points = np.random.default_rng(1).standard_normal((3000, 6))
    tree = N.KdTree(points, 50)
    assert sorted(tree.order.tolist()) == list(range(3000))
    query = points[7] + 0.1
    low = tree.distances(query)
    for (a, b), box in zip(tree.leaves, low, strict=True):
        assert b - a <= 50
        assert ((points[tree.order[a:b]] - query) ** 2).sum(axis=1).min() >= box - 1e-12


@pytest.mark.parametrize("block_rows", [60, 10_000])
def test_recall_with_lengths_of_all_kinds(spark, block_rows):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((600, 12)) * rng.exponential(1.0, (600, 1))
    rows = [(i, v.astype(np.float32).tolist(), None) for i, v in enumerate(vectors)]
    exact = np.array([np.array(r[1], np.float32).astype(float) for r in rows])
    data = table(spark, rows)
    got = {}
    for r in N.nearest(data, data.where("vec_id % 20 = 0"), block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for query, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        want = plain(np.arange(600), exact, query, exact[query], 20)
        hits += len({f[1] for f in found} & {w[0] for w in want})
        for _, i, score in found:
            assert score == pytest.approx(float((exact[i] * exact[query]).sum()), rel=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_ties_go_to_smaller_ids(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(i, same, 0) for i in range(500)] + [(500 + i, [0.1, 0.2, 0.3], 0) for i in range(50)]
    data = table(spark, rows)
    got = N.nearest(data, data.where("vec_id = 40"), k=5, block_rows=100).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]
    own = N.nearest(data, data.where("vec_id = 2"), k=5, block_rows=100).orderBy("rank").collect()
    assert [r["vec_id"] for r in own] == [0, 1, 3, 4, 5]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (40, None, 1), (60, [0.0, 0.0], 1),
            (80, [nan, 1.0], 1), (100, [inf, 1.0], None), (120, [None, 1.0], 1), (1, [1.0, 1.0], 1),
            (2, [1.0], 1), (None, [5.0, 5.0], 1), (1, [1.0, 1.0], 1), (140, [], 1)]
    data = table(spark, rows).selectExpr("*", "label AS rank", "label AS score", "label AS block")
    got = N.query_rows(data).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0),
        (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 0, 0.0)]
    assert N.query_rows(table(spark, [])).collect() == []
    assert N.query_rows(table(spark, [(20, [0.0], 1)])).collect() == []
    assert N.query_rows(table(spark, [(20, [1.0], 1)])).collect() == []


def test_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    data = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = {}
    for r in N.brute_force(data, data.where("vec_id % 20 = 0")).collect():
        want.setdefault(r["query_id"], set()).add(r["vec_id"])
    got = {}
    for r in QUERIES["op4_neighbours"](spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys()
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_queries_have_the_width_of_the_table(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0]) for i in range(1, 31)] + [(40, [1.0, 2.0]), (60, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.query_rows(df).collect()
    assert {r["query_id"] for r in got} == {20} and len(got) == 20
    assert got[0]["vec_id"] == 30

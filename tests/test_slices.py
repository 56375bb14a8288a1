"""Sliced computations against plain windows over the whole key."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.operators import joins, percentiles
from runloom.operators import slices as S


@pytest.fixture(scope="module")
def rows(spark):
    """One hot key (two thirds of the rows), a NULL key, NULL values, equal times, a NULL time."""
    rng = random.Random(5)
    base = datetime.datetime(2024, 3, 30, 22)
    data = []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", "hot", "b", None])
        ts = base + datetime.timedelta(minutes=rng.randrange(0, 900))
        data.append((i, key, None if i == 77 else ts, rng.choice([None, 1.0, 2.5, -4.0, 7.0, 7.0])))
    return spark.createDataFrame(data, "id int, k string, ts timestamp_ntz, v double")


def same(left, right, columns):
    key = lambda r: r["id"]
    a = sorted(left.select(*columns).collect(), key=key)
    b = sorted(right.select(*columns).collect(), key=key)
    assert a == b


def whole():
    """The plain window over a whole key."""
    return Window.partitionBy("k").orderBy("ts", "id")


SIZES = [1, 7, 50, 10 ** 6]
ORDER = ["ts", "id"]


def test_small_keys_are_left_alone_and_hot_ones_are_cut(rows):
    assert S.slice_hot_keys(rows, ["k"], ORDER, 10 ** 6).columns == rows.columns
    sliced = S.slice_hot_keys(rows, ["k"], ORDER, 150)
    sizes = {(r["k"], r[S.SLICE]): r["count"] for r in sliced.groupBy("k", S.SLICE).count().collect()}
    assert sum(sizes.values()) == 600
    assert {k for k, s in sizes if s > 0} == {"hot"} and max(sizes.values()) <= 300


def test_cuts_fall_between_rows_of_one_time(spark):
    copies = spark.range(1000).select(F.lit("k").alias("k"), F.lit(0).alias("t"), "id")
    sliced = S.slice_hot_keys(copies, ["k"], ["t", "id"], 100)
    sizes = [r["count"] for r in sliced.groupBy(S.SLICE).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 300


@pytest.mark.parametrize("extra", [0, 3])
def test_more_large_keys_than_slices(spark, extra):
    """Every key is above the limit; of keys all alike none is cut, of others the largest."""
    many = spark.range(2 * (S.MOST_SLICES + 100) + extra).select(
        F.greatest(F.col("id") - extra, F.lit(0)).cast("long").alias("k"), "id")
    many = many.withColumn("k", F.floor(F.col("k") / 2))
    sliced = S.slice_hot_keys(many, ["k"], ["id"], 1)
    assert (S.SLICE in sliced.columns) == bool(extra)
    w = Window.partitionBy("k").orderBy("id")
    want = many.select("id", F.lag("id").over(w).alias("before"), F.row_number().over(w).alias("row_number"))
    got = S.row_numbers(S.previous_values(many, ["k"], ["id"], {"before": "id"}, 1), ["k"], ["id"],
                        max_rows=1)
    same(got, want, ["id", "before", "row_number"])


@pytest.mark.parametrize("most", SIZES)
def test_previous_and_next(rows, most):
    got = S.previous_values(rows, ["k"], ORDER, {"pv": "v", "pid": "id"}, most)
    got = S.next_values(got, ["k"], ORDER, {"nv": "v"}, most)
    want = rows.select("*", F.lag("v").over(whole()).alias("pv"),
                       F.lag("id").over(whole()).alias("pid"), F.lead("v").over(whole()).alias("nv"))
    same(got, want, ["id", "k", "ts", "v", "pv", "pid", "nv"])


@pytest.mark.parametrize("how,agg", [("sum", F.sum), ("max", F.max), ("min", F.min),
                                     ("last", lambda c: F.last(c, ignorenulls=True))])
@pytest.mark.parametrize("current", [True, False])
def test_running(rows, how, agg, current):
    frame = whole().rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = rows.withColumn("out", agg("v").over(frame))
    for most in (20, 10 ** 6):
        got = S.running(rows, ["k"], ORDER, "v", how, "out", current, most)
        same(got, want, ["id", "out"])


@pytest.mark.parametrize("most", SIZES)
def test_row_numbers_and_ntiles(rows, most):
    got = S.row_numbers(rows, ["k"], ORDER, max_rows=most)
    same(got, rows.withColumn("row_number", F.row_number().over(whole())), ["id", "row_number"])
    for tiles in (1, 3, 7, 1000):
        got = S.ntiles(rows, ["k"], ORDER, tiles, max_rows=most)
        same(got, rows.withColumn("ntile", F.ntile(tiles).over(whole())), ["id", "ntile"])


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("most", [1, 2, 10 ** 6])
def test_ranks(rows, descending, most):
    got = S.ranks(rows, ["k"], "v", descending, most)
    w = Window.partitionBy("k").orderBy(F.desc("v") if descending else F.asc("v"))
    names = ["rank", "dense_rank", "percent_rank", "cume_dist"]
    want = rows.select("*", *[getattr(F, n)().over(w).alias(n) for n in names])
    same(got, want, ["id", *names])


@pytest.mark.parametrize("preceding,size", [(0, 1), (2, 3), (2, 100), (5, 7)])
def test_moving_frame(rows, preceding, size):
    numbered = rows.withColumn("n", F.row_number().over(whole()))
    got = S.moving_frame(numbered, ["k"], "n", preceding, {"s": F.sum("v"), "c": F.count("v")}, size)
    frame = whole().rowsBetween(-preceding, 0)
    want = rows.select("*", F.sum("v").over(frame).alias("s"), F.count("v").over(frame).alias("c"))
    same(got, want, ["id", "s", "c"])
    with pytest.raises(ValueError):
        S.moving_frame(numbered, ["k"], "n", 3, {}, 3)


def test_moving_range(rows):
    timed = rows.where("ts IS NOT NULL").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("k").orderBy("sec").rangeBetween(-3600, 0)
    want = timed.select("*", F.count("v").over(w).alias("c"), F.sum("v").over(w).alias("s"),
                        F.min("v").over(w).alias("m"))
    outputs = {"c": ("v", "count"), "s": ("v", "sum"), "m": ("v", "min")}
    for width in (3600, 5000, 10 ** 6):
        got = S.moving_range(timed, ["k"], "sec", 3600, outputs, width)
        same(got, want, ["id", "c", "s", "m"])


@pytest.mark.parametrize("highest", [5, 5000])
def test_newest_per_key_limits_by_column(rows, highest):
    """A low highest limit is pushed down, a high one is not."""
    limited = rows.withColumn("keep", F.when(F.col("k") == "hot", 5).otherwise(2))
    got = S.newest_per_key(limited, ["k"], ORDER, "keep", highest, max_rows=50)
    w = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))
    want = limited.withColumn("n", F.row_number().over(w)).where("n <= keep")
    same(got, want, ["id", "k"])
    assert got.count() == 9


def test_asof_join_equal_times_and_no_match(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(0)), (3, "b", t(9)), (4, None, t(9))],
                                 "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame(
        [(10, "a", t(5)), (11, "a", t(5)), (12, "a", t(1)), (13, "b", t(10)), (14, None, t(2))],
        "rid int, k string, ts timestamp_ntz")
    for most in (1, 2, 100):
        got = joins.asof_join(left, right, ["k"], "ts", "rid", {"found": "rid"}, most)
        assert {r["id"]: r["found"] for r in got.collect()} == {1: 11, 2: None, 3: None, 4: None}
    timeless = left.withColumn("ts", F.when(F.col("id") != 1, F.col("ts")))
    late = right.withColumn("ts", F.when(F.col("rid") != 10, F.col("ts")))
    got = joins.asof_join(timeless, late, ["k"], "ts", "rid", {"found": "rid"}).collect()
    assert {r["id"]: r["found"] for r in got} == {1: None, 2: None, 3: None, 4: None}


def test_range_join_is_half_open_for_ranges_of_any_length(spark):
    points = spark.createDataFrame([(0.0,), (4.99,), (5.0,), (12.0,), (30.0,), (-7.5,)], "p double")
    ranges = spark.createDataFrame(
        [("a", 0.0, 5.0), ("b", 5.0, 30.0), ("c", 3.0, 3.0), ("all", -1e9, 1e9), ("n", -8.0, -7.5)],
        "name string, lo double, hi double")
    want = [(-7.5, "all"), (0.0, "a"), (0.0, "all"), (4.99, "a"), (4.99, "all"), (5.0, "all"),
            (5.0, "b"), (12.0, "all"), (12.0, "b"), (30.0, "all")]
    for width in (0.5, 5.0, 100.0):
        got = joins.range_join(points, ranges, "p", "lo", "hi", width).collect()
        assert sorted((r["p"], r["name"]) for r in got) == want
    inf = float("inf")
    ends = spark.createDataFrame([("up", 5.0, inf), ("down", -inf, 5.0), ("any", -inf, inf),
                                  ("null", None, 9.0)], "name string, lo double, hi double")
    more = points.union(spark.createDataFrame([(None,), (inf,), (float("-inf"),)], "p double"))
    want = sorted((p["p"], r["name"]) for p in more.collect() for r in ends.collect()
                  if None not in (p["p"], r["lo"]) and r["lo"] <= p["p"] < r["hi"])
    got = joins.range_join(more, ends.union(ranges.where("name = 'c'")), "p", "lo", "hi", 5.0)
    assert sorted((r["p"], r["name"]) for r in got.collect()) == want
    none = joins.range_join(points, ranges.where("name = 'c'"), "p", "lo", "hi", 1.0)
    assert none.count() == 0


@pytest.mark.parametrize("rows,broadcast", [(10_000, 100_000), (7, 100_000), (7, 0), (100, 5)])
def test_open_ranges_are_not_copied_for_few_points(spark, monkeypatch, rows, broadcast):
    """Many open ranges and few points: ranges go into one cell each, and are not broadcast."""
    monkeypatch.setattr(joins, "OPEN_ROWS", rows)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    inf = float("inf")
    points = spark.range(30).select((F.col("id") % 20).cast("double").alias("p"), "id")
    ranges = spark.range(500).select(
        F.col("id").alias("name"), F.when(F.col("id") % 2 == 0, -inf).otherwise(F.col("id") % 9).alias("lo"),
        F.when(F.col("id") % 3 == 0, inf).otherwise(F.col("id") % 9 + 4).alias("hi"))
    got = joins.range_join(points, ranges, "p", "lo", "hi", 4.0)
    want = sorted((p["id"], r["name"]) for p in points.collect() for r in ranges.collect()
                  if r["lo"] <= p["p"] < r["hi"])
    assert sorted((r["id"], r["name"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan()
    placed = [node for node in str(plan.toString()).splitlines() if "Join Inner" in node]
    assert len(placed) == 1 and ("leftHint=(strategy=broadcast)" in placed[0]
                                 or "rightHint=(strategy=merge)" in placed[0])


def test_exact_percentiles_against_builtin(rows):
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}
    got = percentiles.exact_percentiles(rows, ["k"], "v", shares, max_rows=2)
    want = rows.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
    key = lambda r: str(r["k"])
    a = [[r["k"], *[round(r[n], 9) for n in shares]] for r in sorted(got.collect(), key=key)]
    b = [[r["k"], *[round(r[n], 9) for n in shares]] for r in sorted(want.collect(), key=key)]
    assert a == b

"""Pruned joins, chains and nested sets, stored sketches, incremental reports, clustering, samples."""

import datetime
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import closure, pruning, samples, sketches
from runloom.plans import corrections
from runloom.plans import queries_depth as Q
from runloom.plans import report as R
from runloom.plans.catalogue import QUERIES
from runloom.session import open_session
from runloom.sources import curves, files, sinks


def executed(df):
    """Run ``df`` without adaptive re-planning and return all nodes of its plan."""
    df.collect()
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        found.append(node)
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def metric(node, name):
    return node.metrics().apply(name).value()


def still(spark, **conf):
    return open_session(spark, {"spark.sql.adaptive.enabled": "false",
                                **{"spark.sql." + k: v for k, v in conf.items()}})


# --- pruned joins ----------------------------------------------------------------------------

@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_only_partitions_with_partners_are_read(spark, sf_dir, threshold):
    child = still(spark, autoBroadcastJoinThreshold=threshold)
    joined = Q.pruned_report(child, sf_dir)
    days = {r[0] for r in Q.day_rules(child, sf_dir).select("day_of_week").distinct().collect()}
    assert 0 < len(days) < 7
    nodes = executed(joined)
    scan = next(n for n in nodes if n.nodeName().startswith("Scan parquet")
                and "trips_pruned" in n.nodeName())
    text = scan.simpleString(4000)
    assert ("dynamicpruningexpression(day_of_week" in text) == (threshold != "-1")
    assert metric(scan, "numPartitions") == len(days)


def test_a_side_with_very_many_values_is_joined_as_it_is(spark, sf_dir):
    child = still(spark, autoBroadcastJoinThreshold="-1")
    facts, side = Q.trips_by_day(child, sf_dir), Q.day_rules(child, sf_dir)
    pruned = pruning.pruned_join(facts, side, ["day_of_week"], "day_of_week")
    plain = pruning.pruned_join(facts, side, ["day_of_week"], "day_of_week", most_values=1)
    assert plain.count() == pruned.count() == facts.join(side, "day_of_week").count()
    assert pruning.pruned_join(facts, side.where("false"), ["day_of_week"], "day_of_week").count() == 0


def test_bloom_filter_leaves_rows_out_of_the_shuffle(spark, sf_dir):
    rows = {}
    for on in ("true", "false"):
        child = still(pruning.filtering_session(spark, smallest_scan="0"),
                      autoBroadcastJoinThreshold="-1",
                      **{"optimizer.runtime.bloomFilter.enabled": on})
        lines = child.read.parquet(f"{sf_dir}/lineitem.parquet")
        orders = (child.read.parquet(f"{sf_dir}/orders.parquet")
                  .where("o_orderstatus = 'P' AND o_custkey % 10 = 3"))
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_linenumber")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert ("might_contain" in text) == (on == "true")
        rows[on] = sum(metric(n, "shuffleRecordsWritten") for n in executed(joined)
                       if n.nodeName() == "Exchange")
        rows[on, "n"] = joined.count()
    assert rows["true"] < rows["false"] / 2 and rows["true", "n"] == rows["false", "n"]


# --- chains and nested sets ------------------------------------------------------------------

def plain_roots(edges):
    owner = {}
    for name, up in edges:
        if name is not None:
            owner[name] = min((x for x in (owner.get(name), up) if x is not None), default=None)
    rows = set()
    for name in owner:
        seen, here = [name], name
        while owner.get(here) is not None and owner[here] not in seen:
            here = owner[here]
            seen.append(here)
        if owner.get(here) is None:
            rows.add((name, here, len(seen) - 1, False))
        else:
            rows.add((name, min(seen[seen.index(owner[here]):]), None, True))
    return rows


def test_a_chain_of_ten_thousand_takes_a_logarithm_of_rounds(spark):
    edges = [(f"n{i:05}", f"n{i + 1:05}" if i < 9999 else None) for i in range(10_000)]
    roots, rounds = closure.follow_owners(spark.createDataFrame(edges, "name string, owner string"))
    assert rounds <= 15
    assert {tuple(r) for r in roots.collect()} == {
        (f"n{i:05}", "n09999", 9999 - i, False) for i in range(10_000)}


@pytest.mark.parametrize("seed", range(4))
def test_roots_of_random_chains_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{i}", r.choice([None, f"n{r.randrange(60)}", f"n{(i + 1) % 60}", "gone"]))
             for i in range(60)]
    edges += [(None, "n1"), ("n3", "n3"), ("n4", "n5"), ("n4", "n5")]
    for i in range(100, 140):  # a long cycle with a long way into it
        edges.append((f"n{i}", f"n{i + 1}" if i < 139 else "n120"))
    got = closure.root_owners(spark.createDataFrame(edges, "name string, owner string"))
    assert {tuple(x) for x in got.collect()} == plain_roots(edges)


def test_chains_are_joined_without_broadcasts(spark, tmp_path):
    """However small the owners: each level would bring them to the driver once more."""
    spark.range(1, 300).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    chain = QUERIES["owner_chain"](spark, str(tmp_path))
    for kind in ("", "adaptive."):
        assert chain.sparkSession.conf.get(f"spark.sql.{kind}autoBroadcastJoinThreshold") == "-1"
    ups = {(r["name"], r["ancestor"]): r["hops"] for r in chain.collect()}
    assert ups["r-298", "r-99"] == 1 and ups["r-298", "r-33"] == 2
    assert ups["r-1", "r-2"] == ups["r-2", "r-1"] == 1 and ups["r-1", "r-1"] == 2


def test_no_owners(spark):
    empty = spark.createDataFrame([], "name string, owner string")
    assert closure.root_owners(empty).count() == 0
    assert closure.reachable(empty, "name", "owner").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_reachable_pairs_with_fewest_steps(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(30)]
    edges += [(f"m{i}", f"m{i + 1}") for i in range(37)] + [("n1", None), (None, "n2")]
    nexts = {}
    for a, b in edges:
        if a and b:
            nexts.setdefault(a, set()).add(b)
    want = set()
    for start in nexts:
        far, front = {}, {start}
        hops = 0
        while front:
            hops += 1
            front = {b for a in front for b in nexts.get(a, ()) if b not in far}
            far.update(dict.fromkeys(front, hops))
        want |= {(start, b, h) for b, h in far.items()}
    got = closure.reachable(spark.createDataFrame(edges, "source string, target string"))
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("rows", [1, 10, 100])
def test_a_round_has_tasks_by_its_pairs(spark, monkeypatch, rows):
    """Many ways lead through one name; the pairs are dealt to many tasks, and stay the same."""
    monkeypatch.setattr(closure, "ROWS_OF_TASK", rows, raising=False)
    edges = ([(f"a{i}", "hub") for i in range(40)] + [("hub", f"b{i}") for i in range(12)]
             + [("b0", "c"), ("c", "a0"), ("b1", "d"), ("d", "d")])
    sent = []
    write = closure._written

    def written(df, name):
        sent.append(df.rdd.getNumPartitions())
        return write(df, name)

    monkeypatch.setattr(closure, "_written", written)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    child = open_session(spark, conf)
    got = closure.reachable(child.createDataFrame(edges, "source string, target string"))
    rows_got = [tuple(x) for x in got.collect()]
    monkeypatch.undo()
    want = [tuple(x) for x in closure.reachable(spark.createDataFrame(
        edges, "source string, target string")).collect()]
    assert sorted(rows_got) == sorted(want) and len(set(rows_got)) == len(rows_got)
    assert ("a5", "a0", 4) in rows_got and ("hub", "hub", 4) in rows_got and ("d", "d", 1) in rows_got
    assert max(sent) >= 480 // rows  # 40 x 12 pairs in the first round


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


@pytest.mark.parametrize("few", [0, 1000])
def test_a_round_is_made_in_slices_that_leave_no_shuffles(spark, monkeypatch, few):
    """Cycles, ways that meet again, a target and a source with more rows than a task should have."""
    monkeypatch.setattr(closure, "ROWS_OF_TASK", 60)
    monkeypatch.setattr(closure, "MOST_BROADCAST", few, raising=False)
    monkeypatch.setattr(closure, "_slices", lambda rows, spark: 2 if rows > 100 else 1, raising=False)
    edges = ([(f"a{i}", "hub") for i in range(12)] + [("hub", f"b{i}") for i in range(9)]
             + [(f"b{i}", f"c{i // 2}") for i in range(9)] + [(f"b{i}", f"c{i // 3}") for i in range(9)]
             + [("c0", "a0"), ("c1", "c1")])
    child = open_session(spark, {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"})
    given = closure._written(child.createDataFrame(edges, "source string, target string").coalesce(1), "given")
    names, write = [], closure._written

    def noted(df, name):
        names.append(f"{name}-")
        return write(df, name)

    monkeypatch.setattr(closure, "_written", noted)
    before = shuffle_files(spark)
    got = closure.reachable(given)
    # The first write belongs to the session of the edges.
    for _ in range(100):
        if len(left := shuffle_files(spark) - before) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1
    nexts, want = {}, set()
    for a, b in edges:
        nexts.setdefault(a, set()).add(b)
    for start in nexts:
        far, front, hops = {}, {start}, 0
        while front:
            hops += 1
            front = {b for a in front for b in nexts.get(a, ()) if b not in far}
            far.update(dict.fromkeys(front, hops))
        want |= {(start, b, h) for b, h in far.items()}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert got.sparkSession.conf.get("spark.sql.shuffle.partitions") == "2"
    assert sum("-2-1-" in name for name in names) > 1  # second slices of two


# --- stored sketches -------------------------------------------------------------------------

def hours(spark, rows):
    return spark.createDataFrame(rows, "kind string, ts timestamp_ntz, user long, value double")


def at(day, hour, minute=0):
    return datetime.datetime(2024, 1, day, hour, minute)


def test_merging_equals_sketching_once(spark):
    r = random.Random(1)
    rows = [("a", at(1 + i % 3, i % 24, i % 60), r.randrange(30_000), r.random())
            for i in range(20_000)]
    rows += [("b", at(1, 1), 5, None), ("b", at(2, 2), None, 1.5), ("c", at(1, 1), None, None)]
    events = hours(spark, rows)
    stored = sketches.hourly_sketches(events, ["kind"], "ts", "user", "value")
    merged = {x["kind"]: x for x in sketches.estimates(
        sketches.merge_sketches(sketches.merge_sketches(stored, ["kind", "day"]), ["kind"]),
        {"median": 0.5}).collect()}
    once = events.groupBy("kind").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("user", sketches.LG_K)).alias("n"),
        F.count_distinct("user").alias("exact")).collect()
    direct = {x["kind"]: x for x in sketches.estimates(sketches.merge_sketches(stored, ["kind"]),
                                                       {"median": 0.5}).collect()}
    for row in once:
        n, bound = merged[row["kind"]]["distinct_ids"], row["exact"] * sketches.distinct_bound()
        assert abs(direct[row["kind"]]["distinct_ids"] - row["exact"]) <= bound  # without days between
        assert abs(n - row["exact"]) <= bound and abs(row["n"] - row["exact"]) <= bound
        assert n == row["n"] or row["exact"] > 2048
    assert abs(merged["a"]["median"] - 0.5) < 0.02
    assert [(merged[k]["rows"], merged[k]["known"], merged[k]["median"]) for k in "bc"] == [
        (2, 1, 1.5), (1, 0, None)]


def test_a_day_written_again_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "sketches")
    for rows in ([("a", at(1, 1), 1, 1.0), ("a", at(2, 1), 2, 2.0)], [("a", at(2, 1), 3, 3.0),
                                                                    ("a", at(2, 5), 4, 3.0)]):
        sketches.write_sketches(sketches.hourly_sketches(hours(spark, rows), ["kind"], "ts", "user",
                                                         "value"), path)
    back = sketches.read_sketches(spark, path)
    days = sketches.estimates(sketches.merge_sketches(back, ["day"]), {}).orderBy("day").collect()
    assert [(x["rows"], x["distinct_ids"]) for x in days] == [(1, 1), (2, 2)]
    some = sketches.read_sketches(spark, path, "2024-01-02", "2024-01-02")
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 2


# --- reports over files that are corrected ---------------------------------------------------

TRIP = "tpep_pickup_datetime timestamp_ntz, passenger_count long, trip_distance double, total_amount double"


def write_trips(spark, path, rows):
    df = spark.createDataFrame([(at(d, 1) if d else None, n, x, a) for d, n, x, a in rows], TRIP)
    sinks.write_csv(df.coalesce(1), path)


def read_trips(spark, seen):
    def read(paths):
        seen.append(len(paths))
        return files.read_csv(spark, paths, spark.createDataFrame([], TRIP).schema)
    return read


def test_corrected_files_equal_the_batch_report(spark, tmp_path):
    path, store = str(tmp_path / "in put"), str(tmp_path / "store")
    seen = []

    def refresh():
        report = corrections.refresh_corrected(spark, path, store, read_trips(spark, seen))
        everything = (spark.read.schema(spark.createDataFrame([], TRIP).schema)
                      .option("recursiveFileLookup", True).option("header", True).csv(path))
        assert sorted(map(str, report.collect())) == sorted(
            map(str, R.weekday_report(everything).collect()))
        return report.count()

    write_trips(spark, f"{path}/a", [(1, 2, 0.1, 0.3), (1, None, 0.2, None), (None, 5, 1.0, 1.0)])
    write_trips(spark, f"{path}/b", [(1, 1, 1e16, 1e16), (3, 1, 2.0, 2.0)])
    refresh()
    assert refresh() == 3 and seen == [2]  # nothing is read again
    write_trips(spark, f"{path}/c", [(4, 7, None, 4.0)])
    refresh()
    write_trips(spark, f"{path}/b", [(1, 1, 1.0, 1.0)])  # replaced: the large sums leave no trace
    refresh()
    sinks.remove(spark, f"{path}/a")
    refresh()
    assert seen == [2, 1, 1]
    corrections.compact_partials(spark, store)
    assert refresh() == 2
    for _ in range(3):  # older manifests go, and then what only they named
        refresh()
    assert corrections.drop_unused(spark, store) == [0, 2, 3]
    assert corrections.drop_unused(spark, store) == []
    assert refresh() == 2 and seen == [2, 1, 1]
    sinks.remove(spark, f"{path}/b")
    sinks.remove(spark, f"{path}/c")
    assert refresh() == 0


def test_a_refresh_that_failed_before_its_manifest_is_run_again(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    write_trips(spark, f"{path}/a", [(1, 2, 0.1, 0.3)])
    corrections.refresh_corrected(spark, path, store, read_trips(spark, []))
    write_trips(spark, f"{path}/b", [(2, 3, 0.1, 0.3)])
    before = (tmp_path / "store" / "manifest" / "version=1")
    corrections.refresh_corrected(spark, path, store, read_trips(spark, []))
    sinks.remove(spark, str(before))  # as if the second refresh had stopped after its partials
    report = corrections.refresh_corrected(spark, path, store, read_trips(spark, []))
    assert sum(r["total_passengers"] for r in report.collect()) == 5


# --- files clustered along a curve -----------------------------------------------------------

@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (1, 5), (2, 1)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack([c.ravel() for c in np.indices((1 << bits,) * dims)], axis=1)
    place = curves.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_a_filter_on_any_clustered_column_opens_few_files(spark, tmp_path):
    r = random.Random(2)
    hot = datetime.datetime(2024, 1, 5)
    rows = [(i, hot if i % 3 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(
        minutes=r.randrange(40_000)), r.random() * 100, f"{r.choice('abcdef')}{r.randrange(99)}")
        for i in range(20_000)]
    rows += [(20_001, None, 5.0, "a"), (20_002, hot, None, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, amount double, code string")
    path = str(tmp_path / "curve")
    curves.write_clustered(df, path, ["ts", "amount", "code"], files=64)
    sizes = [x["rows"] for x in spark.read.parquet(f"{path}/ranges").collect()]
    assert sum(sizes) == len(rows)
    assert max(sizes) < 4 * sum(sizes) / len(sizes)  # a third of the rows has one time
    for column, low, high in (("ts", datetime.datetime(2024, 1, 20), datetime.datetime(2024, 1, 21)),
                              ("amount", 40.0, 44.0), ("code", "b1", "b2")):
        opened = curves.clustered_files(spark, path, column, low, high)
        assert len(opened) <= 0.45 * len(sizes), column
        got = {x["id"] for x in curves.read_clustered(spark, path, column, low, high).collect()}
        index = df.columns.index(column)
        assert got == {x[0] for x in rows if x[index] is not None and low <= x[index] <= high}
    assert curves.read_clustered(spark, path, "amount", 1000.0).count() == 0
    assert curves.read_clustered(spark, path, "amount").count() == len(rows) - 1


# --- exact samples ---------------------------------------------------------------------------

def test_samples_are_exact_nested_and_repeatable(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 30}", float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, kind string, w double")
    small, large = (samples.stratified_sample(df.repartition(n), ["kind"], "id", n, "x")
                    for n in (5, 20))
    few, many = ({x["id"] for x in s.collect()} for s in (small, large))
    assert few < many and len(few) == 5 * 11 and len(many) == 20 * 11
    assert few != {x["id"] for x in samples.stratified_sample(df, ["kind"], "id", 5, "y").collect()}
    text = large._jdf.queryExecution().executedPlan().toString()
    # Also in each task, before the shuffle.
    assert re.search(r"WindowGroupLimit .*Final.*Exchange.*WindowGroupLimit .*Partial", text, re.S)


def test_weighted_samples_follow_the_weights(spark):
    rows = [(i, "all", [1.0, 9.0, 0.0, -1.0, None][i % 5]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, kind string, w double")
    got = [x["w"] for x in samples.weighted_sample(df, ["kind"], "id", "w", 1000, "x").collect()]
    assert len(got) == 1000 and set(got) == {1.0, 9.0}
    assert 840 < got.count(9.0) < 940

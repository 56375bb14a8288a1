"""What the plans must and must not hold."""

import re

import pytest

from runloom.plans.catalogue import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, sf_dir, name) -> str:
    return plan_of(QUERIES[name](spark, sf_dir))


# Queries that only read; those that write first show the plan of their result table.
SHAPED = ["weekday_report", "metric_normalize", "gauge_rollup", "log_threshold", "latest_phase",
          "overlapping_runs", "retry_chains", "retained_runs", "missed_slots", "dependency_usage",
          "status_parent_join", "orphan_status", "join_range", "join_asof", "win_rank",
          "win_lag_lead", "win_rows_frame", "win_range_frame", "subquery_correlated",
          "agg_percentile", "name_collisions", "executor_states"]


@pytest.mark.parametrize("name", SHAPED)
def test_no_all_pairs_joins(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    report = plan(spark, sf_dir, "weekday_report")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", report).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"}
    scan = plan(spark, sf_dir, "parquet_scan")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", scan).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThanOrEqual(l_discount" in pushed


def test_report_on_partitioned_table_does_not_read_the_time(spark, sf_dir):
    from runloom.plans import report as R
    table = QUERIES["partitioned_table"](spark, sf_dir)
    text = plan_of(R.weekday_report(table, weekday_col="day_of_week"))
    assert "tpep_pickup_datetime" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    pruned = plan_of(table.where("day_of_week = 3"))
    assert re.search(r"PartitionFilters: \[[^\]]*day_of_week", pruned)


def test_aggregates_are_partial_before_their_shuffle(spark, sf_dir):
    for name in ("weekday_report", "latest_phase", "gauge_rollup", "executor_states"):
        text = plan(spark, sf_dir, name)
        assert "partial_" in text and text.count("Exchange") == 1, name
    for name in ("weekday_report", "gauge_rollup", "executor_states", "app_runtime"):
        text = plan(spark, sf_dir, name)
        assert "SortAggregate" not in text and not re.search(r"\bSort\b", text), name


def test_retention_limits_rows_before_the_shuffle(spark, sf_dir):
    text = plan(spark, sf_dir, "retained_runs")
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_log_filters_need_no_shuffle(spark, sf_dir):
    for name in ("log_threshold", "log_drop", "log_parse", "metric_normalize", "metric_labels"):
        assert "Exchange" not in plan(spark, sf_dir, name), name


def test_patterns_are_matched_once_per_line(spark, sf_dir):
    text = plan(spark, sf_dir, "gauge_rollup")
    assert text.count(r"driver\.CodeGenerator\.(.*)><>Count") == 1


def test_hot_keys_are_shuffled_by_slice(spark, sf_dir):
    """Above the row limit, windows are partitioned by key and slice; below, by key alone."""
    from runloom.operators import runs as U
    from runloom.plans import stand_ins as S
    runs, plans = S.runs(spark, sf_dir), S.schedules(spark, sf_dir)
    cut = plan_of(U.overlapping_runs(runs, plans, max_rows=50))
    assert re.search(r"hashpartitioning\(schedule_id#\d+L?, _slice#\d+, \d+\)", cut)
    assert "_slice" not in plan_of(U.overlapping_runs(runs, plans))


def test_top_k_per_group_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(spark, sf_dir, "topk_per_group")
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, "topk")


def test_clustered_write_uses_a_rebalance(spark, sf_dir):
    from runloom.plans import report as R
    from runloom.plans import stand_ins as S
    from runloom.sources import sinks
    day = R.add_weekday(S.trips(spark, sf_dir), "tpep_pickup_datetime")
    text = plan_of(sinks.cluster_for_write(day, "day_of_week", "VendorID", 4))
    assert "REBALANCE_PARTITIONS_BY_COL" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("hint,node", [("BROADCAST", "BroadcastHashJoin"),
                                       ("MERGE", "SortMergeJoin"),
                                       ("SHUFFLE_HASH", "ShuffledHashJoin")])
def test_join_hints(spark, sf_dir, hint, node):
    from runloom.plans.registry import table
    out = spark.sql(f"SELECT /*+ {hint}(c) */ o_orderkey, c_name FROM {{orders}} o "
                    "JOIN {customer} c ON o_custkey = c_custkey",
                    orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    assert node in plan_of(out)
    assert out.count() == table(spark, sf_dir, "orders").count()


def test_views_cache_and_distribution(spark, sf_dir):
    from runloom.plans.jobs import run_statements
    from runloom.session import open_session
    child = open_session(spark)
    out = run_statements(child, f"""
        CREATE TEMPORARY VIEW o USING parquet OPTIONS (path '{sf_dir}/orders.parquet');
        CREATE TEMPORARY VIEW priced AS SELECT o_custkey, o_totalprice FROM o WHERE o_totalprice > 0;
        CACHE LAZY TABLE priced;
        SELECT o_custkey, o_totalprice FROM priced DISTRIBUTE BY o_custkey SORT BY o_custkey;""")
    assert "InMemoryRelation" in plan_of(out) and "hashpartitioning(o_custkey" in plan_of(out)
    assert out.count() == child.table("priced").count()
    child.sql("UNCACHE TABLE priced")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from runloom.sources import sinks
    for name in ("left_b", "right_b"):
        sinks.write_table(spark.range(1000).withColumnRenamed("id", f"{name}_id"), name,
                          str(tmp_path / name), bucket_by=(4, f"{name}_id"))
    joined = spark.table("left_b").hint("merge").join(
        spark.table("right_b"), spark.table("left_b").left_b_id == spark.table("right_b").right_b_id)
    assert "Exchange" not in plan_of(joined) and joined.count() == 1000

"""Registered queries: Spark SQL features a job or session reaches, on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions import udfs
from runloom.functions.times import epoch_seconds
from runloom.operators import joins as J
from runloom.operators import percentiles as P
from runloom.operators import slices as W
from runloom.plans.registry import query, table


def on_views(spark, d, sql: str, *names: str):
    """Run SQL with the named tables inlined as relations: no views are left behind."""
    return spark.sql(sql, **{name: table(spark, d, name) for name in names})


# --- filters ---------------------------------------------------------------------------------

FILTER_SQL = """
SELECT o_orderkey, o_totalprice, o_orderpriority,
       CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid'
            ELSE 'low' END AS band,
       coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status
FROM {orders}
WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 50000 AND 400000
  AND (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW')
  AND o_custkey IS NOT NULL AND NOT (o_orderkey % 7 = 3)"""


@query("filter_predicates", FILTER_SQL.format(orders="orders"))
def filter_predicates(spark, d):
    return on_views(spark, d, FILTER_SQL, "orders")


@query("filter_regex", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')
   OR p_brand IS NOT DISTINCT FROM 'Brand#7'""")
def filter_regex(spark, d):
    return (table(spark, d, "part")
            .where(F.col("p_name").rlike("^(red|blue) .*t$")
                   | F.col("p_brand").eqNullSafe("Brand#7"))
            .select("p_partkey", "p_name"))


# --- joins -----------------------------------------------------------------------------------

@query("join_inner", """
SELECT o_orderpriority, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
GROUP BY 1""")
def join_inner(spark, d):
    # Line items are added up per order on the join key, so both steps use one shuffle of them.
    per_order = (table(spark, d, "lineitem").groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")))
    day = F.col("o_orderdate")
    orders = (table(spark, d, "orders")
              .where((day >= F.lit("1996-01-01").cast("timestamp_ntz"))
                     & (day < F.lit("1998-01-01").cast("timestamp_ntz")))
              .select("o_orderkey", "o_orderpriority"))
    return (per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_orderpriority")
            .agg(F.sum("n").alias("lines"), F.round(F.sum("r"), 2).alias("revenue")))


@query("join_left", """
SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def join_left(spark, d):
    # Orders are added up before the join: a customer with a third of them is one row by then.
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("spent"))
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return customers.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"),
        F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("join_full", """
SELECT c_custkey, c_nationkey, s_suppkey, s_nationkey
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3 AND c_nationkey = s_nationkey""")
def join_full(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    same = ((F.col("c_custkey") == F.col("s_suppkey") * 3)
            & (F.col("c_nationkey") == F.col("s_nationkey")))
    return customers.join(suppliers, same, "full")


@query("join_right", """
SELECT p_partkey, p_name, s_suppkey FROM supplier RIGHT JOIN part ON s_suppkey = p_partkey""")
def join_right(spark, d):
    return (table(spark, d, "supplier").select("s_suppkey")
            .join(table(spark, d, "part").select("p_partkey", "p_name"),
                  F.col("s_suppkey") == F.col("p_partkey"), "right"))


@query("join_semi", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def join_semi(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey").distinct()
    return (table(spark, d, "customer").select("c_custkey", "c_mktsegment")
            .join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi"))


@query("join_anti", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_anti(spark, d):
    buyers = table(spark, d, "orders").select("o_custkey").distinct()
    return (table(spark, d, "customer").select("c_custkey", "c_mktsegment")
            .join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_anti"))


@query("join_null_safe", """
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3)
GROUP BY 1""")
def join_null_safe(spark, d):
    per_nation = (table(spark, d, "customer")
                  .groupBy(F.nullif("c_nationkey", F.lit(3)).alias("c_key"))
                  .agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance")))
    nations = table(spark, d, "nation").select(
        "n_name", F.nullif("n_nationkey", F.lit(3)).alias("n_key"))
    return (per_nation.join(nations, F.col("c_key").eqNullSafe(F.col("n_key")))
            .select("n_name", "customers", F.round("balance", 2).alias("balance")))


@query("join_range", """
SELECT b.low, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN (SELECT DISTINCT CAST(p_size // 4 * 4 AS DOUBLE) AS low FROM part) b
  ON l_quantity >= b.low AND l_quantity < b.low + 4
GROUP BY 1""")
def join_range(spark, d):
    low = F.floor(F.col("p_size") / 4) * 4
    bands = (table(spark, d, "part").select(low.cast("double").alias("low")).distinct()
             .withColumn("high", F.col("low") + 4))
    # Quantities are added up by value first; the join sees one row per value.
    lines = (table(spark, d, "lineitem").groupBy("l_quantity")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("p")))
    return (J.range_join(lines, bands, "l_quantity", "low", "high", 4.0).groupBy("low")
            .agg(F.sum("n").alias("lines"), F.round(F.sum("p"), 2).alias("price")))


@query("join_asof", """
WITH clicks AS (SELECT * FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_asof(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    purchases = events.where("event_type = 'purchase'").drop("event_type")
    clicks = events.where("event_type = 'click'").drop("event_type")
    return J.asof_join(purchases, clicks, ["user_id"], "ts", "event_id",
                       {"click_id": "event_id", "click_ts": "ts"})


@query("join_asof_nulls", """
WITH e AS (SELECT event_id, nullif(user_id % 50, 3) AS k,
                  CASE WHEN event_id % 7 <> 0 THEN ts END AS ts, event_type FROM events),
clicks AS (SELECT * FROM e WHERE event_type = 'click'),
best AS (
  SELECT p.event_id, max({'ts': c.ts, 'id': c.event_id}) AS b
  FROM e p JOIN clicks c ON p.k = c.k AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1)
SELECT p.event_id, p.k, p.ts, b.id AS click_id, b.ts AS click_ts
FROM (SELECT * FROM e WHERE event_type = 'purchase') p LEFT JOIN best USING (event_id)""")
def join_asof_nulls(spark, d):
    events = table(spark, d, "events").select(
        "event_id", F.nullif(F.col("user_id") % 50, F.lit(3)).alias("k"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"), "event_type")
    purchases = events.where("event_type = 'purchase'").drop("event_type")
    clicks = events.where("event_type = 'click'").drop("event_type")
    return J.asof_join(purchases, clicks, ["k"], "ts", "event_id",
                       {"click_id": "event_id", "click_ts": "ts"})


@query("join_range_open", """
SELECT p_partkey, count(*) AS lines
FROM (SELECT DISTINCT l_quantity FROM lineitem) l JOIN (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-infinity'::DOUBLE WHEN 1 THEN p_size ELSE 10 END AS low,
         CASE p_partkey % 5 WHEN 0 THEN 'infinity'::DOUBLE WHEN 1 THEN NULL ELSE p_size + 5 END AS high
  FROM part) b ON l_quantity >= low AND l_quantity < high
GROUP BY 1""")
def join_range_open(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    endless = F.lit(float("inf"))
    bands = table(spark, d, "part").select(
        "p_partkey", F.when(key % 4 == 0, -endless).when(key % 4 == 1, size).otherwise(10.0).alias("low"),
        F.when(key % 5 == 0, endless).when(key % 5 != 1, size + 5).alias("high"))
    quantities = table(spark, d, "lineitem").select("l_quantity").distinct()
    return (J.range_join(quantities, bands, "l_quantity", "low", "high", 4.0).groupBy("p_partkey")
            .agg(F.count(F.lit(1)).alias("lines")))


# --- aggregates ------------------------------------------------------------------------------

AGG_SQL = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship,
       max(l_shipdate) AS last_ship, count(*) AS lines,
       count(*) FILTER (WHERE l_quantity > 25) AS large_lines,
       round(stddev_samp(l_quantity), 6) AS sd_qty,
       round(corr(l_quantity, l_extendedprice), 6) AS corr_price
FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"""


@query("agg_basic", AGG_SQL.format(lineitem="lineitem"))
def agg_basic(spark, d):
    return on_views(spark, d, AGG_SQL, "lineitem")


@query("agg_distinct", """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts
FROM lineitem GROUP BY 1""")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_distinct("l_partkey").alias("parts"))


PERCENTILE_SQL = """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
FROM lineitem GROUP BY 1"""


@query("agg_percentile", PERCENTILE_SQL)
def agg_percentile(spark, d):
    return _price_percentiles(spark, d, W.MAX_ROWS)


@query("agg_percentile_sliced", PERCENTILE_SQL)
def agg_percentile_sliced(spark, d):
    """The same with the three keys cut into slices, as for more rows than a task should get."""
    return _price_percentiles(spark, d, 500)


def _price_percentiles(spark, d, max_rows):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    out = P.exact_percentiles(lines, ["l_returnflag"], "l_extendedprice",
                              {"p25": 0.25, "p50": 0.5, "p99": 0.99}, max_rows)
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p99")})


@query("agg_percentile_approx", "SELECT DISTINCT l_returnflag, true AS near FROM lineitem")
def agg_percentile_approx(spark, d):
    """The sketch's quartiles lie between exact percentiles just below and above them."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    found = lines.groupBy("l_returnflag").agg(
        F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.99], 10_000).alias("q"))
    shares = {"low0": 0.248, "high0": 0.252, "low1": 0.498, "high1": 0.502, "low2": 0.988, "high2": 0.992}
    exact = P.exact_percentiles(lines, ["l_returnflag"], "l_extendedprice", shares)
    near = [F.col("q")[i].between(F.col(f"low{i}"), F.col(f"high{i}")) for i in range(3)]
    return found.join(exact, "l_returnflag").select(
        "l_returnflag", (near[0] & near[1] & near[2]).alias("near"))


@query("approx_distinct", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS near FROM lineitem GROUP BY 1""")
def approx_distinct(spark, d):
    """The sketch's count beside the exact one: within three of its standard errors."""
    found = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("about"),
        F.count_distinct("l_orderkey").alias("orders"))
    return found.select("l_returnflag", "orders",
                        (F.abs(F.col("about") - F.col("orders")) <= 0.06 * F.col("orders")).alias("near"))


@query("agg_collect", """
SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags
FROM lineitem GROUP BY 1""")
def agg_collect(spark, d):
    # A set of at most as many values as there are return flags.
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


def _cube_sql(grouping: str) -> str:
    return f"""
SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS qty,
       CAST(grouping(l_returnflag) AS INTEGER) AS all_flags
FROM {{lineitem}} GROUP BY {grouping}"""


for _name, _grouping in {
        "agg_rollup": "ROLLUP (l_returnflag, l_linestatus)",
        "agg_cube": "CUBE (l_returnflag, l_linestatus)",
        "agg_grouping_sets":
            "GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))"}.items():
    query(_name, _cube_sql(_grouping).format(lineitem="lineitem"))(
        lambda spark, d, sql=_cube_sql(_grouping): on_views(spark, d, sql, "lineitem"))


@query("pivot", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click,
       count(*) FILTER (event_type = 'purchase') AS purchase,
       count(*) FILTER (event_type = 'error') AS error
FROM events GROUP BY 1""")
def pivot(spark, d):
    kinds = ["click", "purchase", "error"]
    return (table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds)
            .agg(F.count(F.lit(1)))
            .select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds]))


@query("unpivot", """
SELECT measure, round(sum(amount), 2) AS total, count(*) AS n
FROM (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)
UNPIVOT (amount FOR measure IN (quantity, discount, tax)) GROUP BY 1""")
def unpivot(spark, d):
    return (table(spark, d, "lineitem")
            .selectExpr("l_quantity AS quantity", "l_discount AS discount", "l_tax AS tax")
            .unpivot([], ["quantity", "discount", "tax"], "measure", "amount")
            .groupBy("measure")
            .agg(F.round(F.sum("amount"), 2).alias("total"), F.count("amount").alias("n")))


# --- windows ---------------------------------------------------------------------------------

WIN_RANK_SQL = """
SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_extendedprice,
       rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
       round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC)"""


@query("win_rank", WIN_RANK_SQL)
def win_rank(spark, d):
    """Three keys only: a plain window would be three tasks."""
    return _ranked_lines(spark, d, W.MAX_ROWS)


@query("win_rank_sliced", WIN_RANK_SQL)
def win_rank_sliced(spark, d):
    """The same with the three keys cut into slices, as for more rows than a task should get."""
    return _ranked_lines(spark, d, 500)


def _ranked_lines(spark, d, max_rows):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = W.ranks(lines, ["l_returnflag"], "l_extendedprice", descending=True, max_rows=max_rows)
    return out.withColumns({c: F.round(c, 9) for c in ("percent_rank", "cume_dist")})


@query("win_ntile", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_suppkey,
       CAST(ntile(3) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_partkey,
                           l_linenumber) AS INTEGER) AS third
FROM lineitem""")
def win_ntile(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    return W.ntiles(lines, ["l_suppkey"],
                    ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"], 3, "third")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


BY_TIME = ["ts", "event_id"]


@query("win_lag_lead", """
SELECT event_id, user_id, ts, value, lag(value) OVER w AS before, lead(value) OVER w AS after
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag_lead(spark, d):
    rows = W.slice_hot_keys(_events(spark, d), ["user_id"], BY_TIME)
    back = W.previous_values(rows, ["user_id"], BY_TIME, {"before": "value"}, max_rows=None)
    return W.next_values(back, ["user_id"], BY_TIME, {"after": "value"}, max_rows=None).drop(W.SLICE)


@query("win_running", """
SELECT event_id, user_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS highest,
       row_number() OVER w AS place
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def win_running(spark, d):
    rows = _events(spark, d).withColumn("top", F.col("value")).withColumn(
        "one", F.lit(1).cast("long"))
    out = W.running_all(rows, ["user_id"], BY_TIME, {
        "total": ("value", "sum"), "highest": ("top", "max"), "place": ("one", "sum")})
    return out.select("event_id", "user_id", F.round("total", 4).alias("total"), "highest", "place")


@query("win_rows_frame", """
SELECT event_id, user_id, round(avg(value) OVER w, 6) AS mean_of_3, max(value) OVER w AS max_of_3
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def win_rows_frame(spark, d):
    numbered = W.row_numbers(_events(spark, d), ["user_id"], BY_TIME, "place")
    out = W.moving_frame(numbered, ["user_id"], "place", 2,
                         {"mean_of_3": F.avg("value"), "max_of_3": F.max("value")})
    return out.select("event_id", "user_id", F.round("mean_of_3", 6).alias("mean_of_3"), "max_of_3")


@query("win_range_frame", """
SELECT event_id, user_id, count(*) OVER w AS events_6h, round(sum(value) OVER w, 4) AS value_6h
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)""")
def win_range_frame(spark, d):
    events = _events(spark, d)
    timed = events.withColumn("sec", epoch_seconds(events, "ts"))
    out = W.moving_range(timed, ["user_id"], "sec", 21600,
                         {"events_6h": ("event_id", "count"), "value_6h": ("value", "sum")}, 86400)
    return out.select("event_id", "user_id", "events_6h", F.round("value_6h", 4).alias("value_6h"))


@query("win_range_frame_nulls", """
SELECT event_id, k, count(*) OVER w AS events_6h, round(sum(value) OVER w, 4) AS value_6h
FROM (SELECT *, user_id % 50 AS k,
             CASE WHEN event_id % 5 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS sec FROM events)
WINDOW w AS (PARTITION BY k ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)""")
def win_range_frame_nulls(spark, d):
    events = _events(spark, d)
    timed = events.select("event_id", "value", (F.col("user_id") % 50).alias("k"), F.when(
        F.col("event_id") % 5 != 0, epoch_seconds(events, "ts")).alias("sec"))
    out = W.moving_range(timed, ["k"], "sec", 21600,
                         {"events_6h": ("event_id", "count"), "value_6h": ("value", "sum")}, 86400)
    return out.select("event_id", "k", "events_6h", F.round("value_6h", 4).alias("value_6h"))


@query("win_first_last_nth", """
SELECT event_id, user_id, first_value(event_type) OVER w AS first_type,
       last_value(event_type) OVER w AS last_type, nth_value(event_type, 3) OVER w AS third_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last_nth(spark, d):
    """Over whole keys the first, last and third values are one row per key, joined back."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    place = F.struct("ts", "event_id")
    ends = events.groupBy("user_id").agg(F.min_by("event_type", place).alias("first_type"),
                                         F.max_by("event_type", place).alias("last_type"))
    third = (W.row_numbers(events, ["user_id"], BY_TIME, "place").where("place = 3")
             .select("user_id", F.col("event_type").alias("third_type")))
    return (events.select("event_id", "user_id").join(ends, "user_id")
            .join(third, "user_id", "left"))


# --- top-k -----------------------------------------------------------------------------------

TOPK_SQL = """
SELECT o_orderkey, o_totalprice FROM {orders}
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5"""


@query("topk", TOPK_SQL.format(orders="orders"))
def topk(spark, d):
    return on_views(spark, d, TOPK_SQL, "orders")


@query("topk_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
           AS place FROM orders) WHERE place <= 3""")
def topk_per_group(spark, d):
    # The limit is pushed below the shuffle: each task sends on three rows per customer.
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return (table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
            .withColumn("place", F.row_number().over(w)).where("place <= 3"))


@query("sorted_output", "SELECT c_custkey, c_acctbal FROM customer")
def sorted_output(spark, d):
    return (table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_first("c_acctbal"), "c_custkey"))


# --- set operations and subqueries -----------------------------------------------------------

def _buyers(year: int, distinct: str = "") -> str:
    return (f"SELECT {distinct} o_custkey FROM {{orders}} "
            f"WHERE o_orderdate >= TIMESTAMP_NTZ '{year}-01-01' "
            f"AND o_orderdate < TIMESTAMP_NTZ '{year + 1}-01-01'")


for _name, _op in {"set_union": "UNION", "set_union_all": "UNION ALL",
                   "set_intersect": "INTERSECT", "set_intersect_all": "INTERSECT ALL",
                   "set_except": "EXCEPT", "set_except_all": "EXCEPT ALL"}.items():
    # Set semantics: duplicates go before the shuffle, not after it.
    _kind = "" if _op.endswith("ALL") else "DISTINCT"
    _sql = f"{_buyers(1996, _kind)} {_op} {_buyers(1997, _kind)}"
    query(_name, f"{_buyers(1996)} {_op} {_buyers(1997)}".format(orders="orders")
          .replace("TIMESTAMP_NTZ", "TIMESTAMP"))(
        lambda spark, d, sql=_sql: on_views(spark, d, sql, "orders"))


# What a subquery looks up is made distinct, or counted, before it is joined: a key with a third of
# the line items is then a few rows.
SUBQUERIES = {
    "subquery_scalar": ("""
SELECT l_returnflag, count(*) AS above_mean FROM {lineitem}
WHERE l_quantity > (SELECT avg(l_quantity) FROM {lineitem}) GROUP BY 1""", ["lineitem"]),
    "subquery_exists": ("""
SELECT o_orderpriority, count(*) AS orders FROM {orders} o
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_quantity > 45) l
              WHERE l.l_orderkey = o.o_orderkey)
GROUP BY 1""", ["orders", "lineitem"]),
    "subquery_in": ("""
SELECT s_suppkey, s_name FROM {supplier}
WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM {lineitem}
                    WHERE l_discount >= 0.09 AND l_tax >= 0.07)""", ["supplier", "lineitem"]),
    "subquery_correlated": ("""
WITH counted AS (SELECT l_partkey, l_quantity, count(*) AS n FROM {lineitem} GROUP BY 1, 2)
SELECT l.l_partkey, CAST(sum(n) AS BIGINT) AS small_lines FROM counted l
WHERE l.l_quantity < (SELECT 0.4 * sum(i.l_quantity * i.n) / sum(i.n) FROM counted i
                      WHERE i.l_partkey = l.l_partkey)
GROUP BY 1""", ["lineitem"]),
    "cte": ("""
WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY 1),
     ranked AS (SELECT c_mktsegment, total FROM spent JOIN {customer} ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) AS buyers, round(max(total), 2) AS best, round(avg(total), 2) AS mean
FROM ranked GROUP BY 1""", ["orders", "customer"]),
}
ORACLE_TEXT = {
    "subquery_exists": """
SELECT o_orderpriority, count(*) AS orders FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)
GROUP BY 1""",
    "subquery_correlated": """
SELECT l.l_partkey, count(*) AS small_lines FROM lineitem l
WHERE l.l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i
                      WHERE i.l_partkey = l.l_partkey)
GROUP BY 1""",
}
for _name, (_sql, _tables) in SUBQUERIES.items():
    query(_name, ORACLE_TEXT.get(_name, _sql.format(**{t: t for t in _tables})))(
        lambda spark, d, sql=_sql, names=_tables: on_views(spark, d, sql, *names))


# --- generators and sampling -----------------------------------------------------------------

@query("explode_split", """
SELECT lang, word, count(*) AS n
FROM (SELECT lang, unnest(string_split_regex(text, '[ \\n]+')) AS word FROM documents)
WHERE word <> '' GROUP BY 1, 2""")
def explode_split(spark, d):
    words = table(spark, d, "documents").select(
        "lang", F.explode(F.split("text", "[ \\n]+")).alias("word"))
    return words.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("explode_position", """
SELECT lang, CAST(place AS INTEGER) AS place, count(*) AS texts, CAST(sum(length(line)) AS BIGINT) AS chars
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line,
             unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents)
GROUP BY 1, 2""")
def explode_position(spark, d):
    lines = table(spark, d, "documents").select(
        "lang", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.groupBy("lang", "place").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("line")).alias("chars"))


@query("lateral_stack", """
SELECT o_orderkey, step, amount FROM orders,
LATERAL (VALUES ('net', round(o_totalprice / 1.2, 4)), ('gross', o_totalprice)) v(step, amount)""")
def lateral_stack(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "stack(2, 'net', round(o_totalprice / 1.2D, 4), 'gross', o_totalprice) AS (step, amount)")


@query("table_sample")
def table_sample(spark, d):
    return table(spark, d, "lineitem").sample(0.05, seed=11).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"))


# --- functions -------------------------------------------------------------------------------

FUNCTIONS = {
    "fn_string": ("""
SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, CAST(length(c_name) AS INT) AS n,
       substring(c_name, 10, 9) AS digits, concat(c_name, '/', c_mktsegment) AS joined,
       concat_ws('-', c_mktsegment, c_name) AS dashed, lpad(c_mktsegment, 12, '*') AS padded,
       rpad(c_mktsegment, 12, '.') AS filled, trim('  x ') AS trimmed, reverse(c_name) AS backwards,
       replace(c_name, '#', '_') AS replaced, split_part(c_name, '#', 2) AS part2,
       translate(c_mktsegment, 'AEI', '431') AS leet, repeat(substring(c_mktsegment, 1, 1), 3) AS rep,
       regexp_extract(c_name, '([1-9][0-9]*)$', 1) AS tail, ascii(c_mktsegment) AS code,
       starts_with(c_mktsegment, 'BUILD') AS building, md5(c_name) AS digest
FROM {customer}""", ["customer"], {"starts_with": "startswith"}),
    "fn_date": ("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
       CAST(day(o_orderdate) AS INT) AS dd, CAST(quarter(o_orderdate) AS INT) AS q,
       CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(weekofyear(o_orderdate) AS INT) AS wk,
       last_day(o_orderdate) AS month_end, CAST(o_orderdate AS DATE) AS day,
       o_orderdate + INTERVAL 36 HOUR AS later,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(hour(o_orderdate) AS INT) AS h
FROM {orders}""", ["orders"], {}),
    "fn_math": ("""
SELECT l_orderkey, l_partkey, l_linenumber, CAST(floor(l_quantity / 3) AS BIGINT) AS f,
       CAST(ceil(l_tax * 100) AS BIGINT) AS c,
       round(l_extendedprice, -2) AS r, abs(l_discount - 0.05) AS a, round(sqrt(l_quantity), 6) AS s,
       round(ln(l_extendedprice), 6) AS lg, round(exp(l_discount), 6) AS ex,
       round(power(l_quantity, 2), 2) AS p, CAST(sign(l_discount - 0.05) AS INT) AS sg,
       l_orderkey % 7 AS md, greatest(l_quantity, l_tax * 100) AS g, least(l_discount, l_tax) AS le,
       round(sin(l_quantity), 6) AS sn, l_orderkey & 255 AS bits, l_partkey | 1 AS odd
FROM {lineitem}""", ["lineitem"], {}),
    "fn_conditional": ("""
SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS kind,
       CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 2 ELSE 0 END AS score,
       CASE WHEN value > 100 THEN 'big' END AS size, event_type IN ('click', 'view') AS passive,
       value IS NULL AS missing
FROM {events}""", ["events"], {}),
}
for _name, (_sql, _tables, _spark_names) in FUNCTIONS.items():
    _spark_sql = _sql
    for _duck, _own in _spark_names.items():
        _spark_sql = _spark_sql.replace(_duck, _own)
    query(_name, _sql.format(**{t: t for t in _tables}))(
        lambda spark, d, sql=_spark_sql, names=_tables: on_views(spark, d, sql, *names))


@query("fn_array", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive,
       embedding[1] AS first_value, list_max(embedding) AS highest,
       list_contains(list_transform(embedding, lambda x: x > 0.2), true) AS any_large,
       list_sort(embedding)[1:3] AS lowest_three
FROM embeddings""")
def fn_array(spark, d):
    e = F.col("embedding")
    squares = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.round(squares, 6).alias("norm2"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
        F.element_at(e, 1).alias("first_value"), F.array_max(e).alias("highest"),
        F.exists(e, lambda x: x > F.lit(0.2).cast("float")).alias("any_large"),
        F.slice(F.sort_array(e), 1, 3).alias("lowest_three"))


@query("fn_map", """
SELECT event_id, event_type AS k1, round(value, 1) AS kind_value,
       CAST(user_id AS DOUBLE) AS user_value, 2 AS n, 0 AS absent
FROM events""")
def fn_map(spark, d):
    m = F.map_concat(F.create_map("event_type", F.round("value", 1)),
                     F.create_map(F.lit("user"), F.col("user_id").cast("double")))
    return table(spark, d, "events").withColumn("m", m).select(
        "event_id", F.element_at(F.map_keys("m"), 1).alias("k1"),
        F.element_at("m", F.col("event_type")).alias("kind_value"),
        F.try_element_at("m", F.lit("user")).alias("user_value"), F.size("m").alias("n"),
        F.size(F.map_filter("m", lambda k, v: k == "absent")).alias("absent"))


@query("fn_struct", """
SELECT o_orderkey, o_totalprice AS price, upper(o_orderstatus) AS state
FROM orders WHERE o_orderstatus = 'F'""")
def fn_struct(spark, d):
    packed = table(spark, d, "orders").select(
        "o_orderkey", F.struct(F.col("o_totalprice").alias("price"),
                               F.upper("o_orderstatus").alias("state")).alias("s"))
    return packed.where("s.state = 'F'").select("o_orderkey", "s.price", "s.state")


@query("fn_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       '{"id":' || event_id || ',"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '}'
       AS packed
FROM events""")
def fn_json(spark, d):
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select(
        "event_id", "p.k",
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k"))).alias("packed"))


@query("fn_json_path", """
SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS digit, count(*) AS n FROM events
GROUP BY 1""")
def fn_json_path(spark, d):
    digit = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, d, "events").groupBy(digit.alias("digit")).agg(
        F.count(F.lit(1)).alias("n"))


@query("fn_hash", """
SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n,
       CAST(strlen(text) AS INTEGER) AS bytes
FROM documents""")
def fn_hash(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"),
        F.length("text").alias("n"), F.octet_length("text").alias("bytes"))


# --- user-defined functions ------------------------------------------------------------------

@query("udf_scalar", """
SELECT event_id, round(ln(1 + value), 6) AS damped FROM events""")
def udf_scalar(spark, d):
    damped = udfs.damped()
    return table(spark, d, "events").select(
        "event_id", F.round(damped("value"), 6).alias("damped"))


@query("udf_pandas_agg", """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS sd
FROM events GROUP BY 1""")
def udf_pandas_agg(spark, d):
    out = udfs.mean_and_spread(table(spark, d, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("agg_percentile_nulls", """
SELECT k, round(quantile_cont(v, 0.5), 6) AS p50
FROM (SELECT nullif(l_suppkey % 9, 4) AS k, CASE WHEN l_suppkey % 9 <> 2 THEN l_extendedprice END AS v
      FROM lineitem) GROUP BY 1""")
def agg_percentile_nulls(spark, d):
    nine = F.col("l_suppkey") % 9
    lines = table(spark, d, "lineitem").select(
        F.nullif(nine, F.lit(4)).alias("k"), F.when(nine != 2, F.col("l_extendedprice")).alias("v"))
    return P.exact_percentiles(lines, ["k"], "v", {"p50": 0.5}).withColumn("p50", F.round("p50", 6))


@query("udf_pandas_agg_nulls", """
SELECT k, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd
FROM (SELECT nullif(user_id % 9, 4) AS k, CASE WHEN user_id % 9 <> 2 THEN value + 1e9 END AS v
      FROM events) GROUP BY 1""")
def udf_pandas_agg_nulls(spark, d):
    nine = F.col("user_id") % 9
    rows = table(spark, d, "events").select(
        F.nullif(nine, F.lit(4)).alias("k"), F.when(nine != 2, F.col("value") + 1e9).alias("v"))
    out = udfs.mean_and_spread(rows, "k", "v")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query("udtf_split_nulls", """
SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(length(line) AS INTEGER) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(0, len(string_split(text, chr(10))))) AS place
      FROM documents WHERE doc_id % 3 <> 0)""")
def udtf_split_nulls(spark, d):
    spark.udtf.register("split_lines", udfs.SplitLines)
    docs = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    return spark.sql("SELECT doc_id, place, chars FROM {docs}, LATERAL split_lines(text)", docs=docs)


@query("udtf_split", """
SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(length(line) AS INTEGER) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents)""")
def udtf_split(spark, d):
    spark.udtf.register("split_lines", udfs.SplitLines)
    return spark.sql("SELECT doc_id, place, chars FROM {docs}, LATERAL split_lines(text)",
                     docs=table(spark, d, "documents").select("doc_id", "text"))

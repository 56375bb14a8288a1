"""Registered queries: pruned joins, chains of owners, nested sets, stored sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom import schemas
from runloom.operators import closure as C
from runloom.operators import pruning as P
from runloom.operators import samples as N
from runloom.operators import sketches as K
from runloom.plans import corrections
from runloom.plans import report as R
from runloom.plans import stand_ins as S
from runloom.plans.queries_reports import new_table, rounded
from runloom.plans.registry import query, table
from runloom.session import open_session, scratch_dir
from runloom.sources import curves, files, sinks

# --- pruned joins ----------------------------------------------------------------------------

PRUNED_SQL = """
SELECT r.rule, CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week, count(*) AS trips,
       CAST(sum(l_linenumber) AS BIGINT) AS passengers
FROM lineitem JOIN (SELECT n_name AS rule, n_nationkey % 7 + 1 AS day FROM nation
                    WHERE n_regionkey = 2 AND n_nationkey % 7 < 4) r
  ON dayofweek(l_shipdate) + 1 = r.day
GROUP BY 1, 2"""


def trips_by_day(spark, d):
    name, path = new_table(spark, "trips_pruned")
    day = R.add_weekday(S.trips(spark, d), "tpep_pickup_datetime")
    sinks.write_table(sinks.cluster_for_write(day, "day_of_week", "VendorID"), name, path,
                      partition_by=["day_of_week"])
    return spark.table(name)


def day_rules(spark, d):
    """Rules for some weekdays, filtered."""
    return (table(spark, d, "nation").where("n_regionkey = 2 AND n_nationkey % 7 < 4")
            .select(F.col("n_name").alias("rule"),
                    (F.col("n_nationkey") % 7 + 1).cast("int").alias("day_of_week")))


def pruned_report(spark, d):
    joined = P.pruned_join(trips_by_day(spark, d), day_rules(spark, d), ["day_of_week"], "day_of_week")
    return joined.groupBy("rule", "day_of_week").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("passenger_count").alias("passengers"))


@query("join_partition_pruned", PRUNED_SQL)
def join_partition_pruned(spark, d):
    """Only the weekdays that a rule is for are opened; Spark finds them while the query runs."""
    return pruned_report(spark, d)


@query("join_partition_pruned_large", PRUNED_SQL)
def join_partition_pruned_large(spark, d):
    """The same for a side that is too large to be broadcast: its weekdays are looked up first."""
    return pruned_report(open_session(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}), d)


@query("join_bloom", """
SELECT o_orderpriority, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'P' AND o_custkey % 10 = 3 GROUP BY 1""")
def join_bloom(spark, d):
    """Both sides are shuffled; lines that no chosen order can have are left out before that."""
    spark = P.filtering_session(spark, smallest_scan="0")
    # As for an orders table that is too large to be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    chosen = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_custkey % 10 = 3")
    joined = table(spark, d, "lineitem").join(chosen, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").cast("long").alias("numbers"))


# --- chains and nested sets ------------------------------------------------------------------

ANCESTORS_SQL = f"""
WITH RECURSIVE owners AS ({S.OWNERS_SQL}),
chain(name, up, hops, path) AS (
    SELECT name, owner, CAST(1 AS BIGINT), [name] FROM owners WHERE owner IS NOT NULL
    UNION ALL
    SELECT c.name, o.owner, c.hops + 1, list_append(c.path, c.up)
    FROM chain c JOIN owners o ON c.up = o.name
    WHERE o.owner IS NOT NULL AND NOT list_contains(c.path, c.up))
SELECT name, up AS ancestor, hops FROM chain"""


@query("owner_chain", ANCESTORS_SQL)
def owner_chain(spark, d):
    """All owners of owners by recursive SQL; a chain ends where it comes back to one of its names.

    Each level joins all owners again; as broadcasts they would come to the driver once a level.
    """
    child = open_session(spark, {"spark.sql.cteRecursionRowLimit": "-1",
                                 "spark.sql.cteRecursionLevelLimit": "10000",
                                 "spark.sql.autoBroadcastJoinThreshold": "-1",
                                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    S.owners(child, d).createOrReplaceTempView("owners")
    return child.sql("""
        WITH RECURSIVE chain(name, up, hops, path) AS (
            SELECT name, owner, CAST(1 AS BIGINT), array(name) FROM owners WHERE owner IS NOT NULL
            UNION ALL
            SELECT c.name, o.owner, c.hops + 1, array_append(c.path, c.up)
            FROM chain c JOIN owners o ON c.up = o.name
            WHERE o.owner IS NOT NULL AND NOT array_contains(c.path, c.up))
        SELECT name, up AS ancestor, hops FROM chain""")


@query("owner_roots", f"""
WITH RECURSIVE owners AS ({S.OWNERS_SQL}),
reach(name, up, hops) AS (
    SELECT name, name, CAST(0 AS BIGINT) FROM owners
    UNION
    SELECT r.name, o.owner, r.hops + 1 FROM reach r JOIN owners o ON r.up = o.name
    WHERE o.owner IS NOT NULL AND r.hops < 64),
ends AS (
    SELECT r.name, r.up AS root, r.hops FROM reach r LEFT JOIN owners o ON r.up = o.name
    WHERE o.owner IS NULL),
cycles AS (SELECT DISTINCT name FROM reach WHERE name = up AND hops > 0)
SELECT o.name, o.kind, coalesce(e.root, (SELECT min(r.up) FROM reach r JOIN cycles c ON r.up = c.name
                                         WHERE r.name = o.name)) AS root,
       e.hops, e.root IS NULL AS cyclic
FROM owners o LEFT JOIN ends e ON o.name = e.name""")
def owner_roots(spark, d):
    """The end of every chain of owners, in as many rounds as the logarithm of the longest."""
    owners = S.owners(spark, d)
    return owners.select("name", "kind").join(C.root_owners(owners), "name")


@query("nested_sets", f"""
WITH RECURSIVE edges AS (SELECT DISTINCT * FROM ({S.SETS_SQL})),
reach(source, target, hops) AS (
    SELECT source, target, CAST(1 AS BIGINT) FROM edges
    UNION
    SELECT r.source, e.target, r.hops + 1 FROM reach r JOIN edges e ON r.target = e.source
    WHERE r.hops < 24)
SELECT source, target, min(hops) AS hops FROM reach GROUP BY 1, 2""")
def nested_sets(spark, d):
    """Every set with all sets that it includes, directly or through others."""
    return C.reachable(S.nested_sets(spark, d))


# --- stored sketches -------------------------------------------------------------------------

QUANTILES = {"median": 0.5, "p95": 0.95}


def stored_sketches(spark, d) -> str:
    path = scratch_dir(spark, "event_sketches")
    K.write_sketches(K.hourly_sketches(table(spark, d, "events"), ["event_type"], "ts", "user_id",
                                       "value"), path)
    return path


@query("sketch_daily", """
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS rows, count(value) AS known,
       count(DISTINCT user_id) AS distinct_ids, quantile_disc(value, 0.5) AS median,
       quantile_disc(value, 0.95) AS p95
FROM events GROUP BY 1, 2""")
def sketch_daily(spark, d):
    """Days from stored hours. Sketches this small still hold every value, so SQL finds the same."""
    path = stored_sketches(spark, d)
    return K.estimates(K.merge_sketches(K.read_sketches(spark, path), ["event_type", "day"]),
                       QUANTILES)


@query("sketch_week", """
WITH days AS (SELECT * FROM events
              WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11')
SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS exact, true AS within_bound
FROM days GROUP BY 1""")
def sketch_week(spark, d):
    """A week from stored days from stored hours, beside the exact count of ids; sketches of a day are
    merged ones, stored again."""
    days = scratch_dir(spark, "daily_sketches")
    K.write_sketches(K.merge_sketches(K.read_sketches(spark, stored_sketches(spark, d)),
                                      ["event_type", "day"]), days)
    week = K.estimates(K.merge_sketches(K.read_sketches(spark, days, "2024-01-05", "2024-01-11"),
                                        ["event_type"]), {})
    exact = (table(spark, d, "events")
             .where(F.to_date("ts").between(F.lit("2024-01-05").cast("date"),
                                            F.lit("2024-01-11").cast("date")))
             .groupBy("event_type").agg(F.count_distinct("user_id").alias("exact")))
    off = F.abs(F.col("distinct_ids") - F.col("exact"))
    return (week.join(exact, "event_type")
            .select("event_type", "rows", "exact",
                    (off <= F.col("exact") * K.distinct_bound()).alias("within_bound")))


# --- reports over files that are corrected ---------------------------------------------------

@query("corrected_report", """
SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week,
       round(avg(l_extendedprice), 6) AS avg_amount,
       round(avg(l_quantity), 6) AS avg_trip_distance,
       CAST(sum(l_linenumber) AS BIGINT) AS total_passengers
FROM lineitem WHERE l_orderkey % 5 <> 3 GROUP BY 1""")
def corrected_report(spark, d):
    """Trips arrive as five folders of files; one is replaced, one withdrawn, one comes later."""
    path, store = scratch_dir(spark, "corrected_trips"), scratch_dir(spark, "corrected_store")
    lines = table(spark, d, "lineitem")
    schema = schemas.T.StructType([schemas.TRIPS[c] for c in S.TRIP_COLUMNS])

    def write(part: int, times: int = 1) -> None:
        columns = {**S.TRIP_COLUMNS, "passenger_count": f"CAST(l_linenumber * {times} AS BIGINT)"}
        rows = lines.where(F.col("l_orderkey") % 5 == part).selectExpr(
            *[f"{source} AS {name}" for name, source in columns.items()])
        sinks.write_csv(rows, f"{path}/part-{part}")

    def refresh():
        return corrections.refresh_corrected(
            spark, path, store, lambda some: files.read_csv(spark, some, schema))

    for part, times in ((0, 1), (1, 2), (2, 1), (3, 1)):
        write(part, times)
    refresh()
    write(1)
    sinks.remove(spark, f"{path}/part-3")
    write(4)
    return rounded(refresh())


# --- files clustered along a curve -----------------------------------------------------------

@query("clustered_curve", """
SELECT 'time' AS filtered_by, count(*) AS trips, CAST(sum(l_linenumber) AS BIGINT) AS passengers
FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-04-30'
UNION ALL
SELECT 'amount', count(*), CAST(sum(l_linenumber) AS BIGINT)
FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 22000""")
def clustered_curve(spark, d):
    """Trips along a Hilbert curve of time and amount; a filter on either opens few files."""
    path = scratch_dir(spark, "trips_curve")
    curves.write_clustered(S.trips(spark, d), path, ["tpep_pickup_datetime", "total_amount"], files=64)
    time = F.lit("1995-03-01").cast("timestamp_ntz"), F.lit("1995-04-30").cast("timestamp_ntz")
    found = {"time": curves.read_clustered(spark, path, "tpep_pickup_datetime", *time),
             "amount": curves.read_clustered(spark, path, "total_amount", 20000, 22000)}
    parts = [rows.agg(F.count(F.lit(1)).alias("trips"), F.sum("passenger_count").alias("passengers"))
             .select(F.lit(name).alias("filtered_by"), "trips", "passengers")
             for name, rows in found.items()]
    return parts[0].unionByName(parts[1])


# --- exact samples ---------------------------------------------------------------------------

_HASH = "md5('{}:' || event_id)"


@query("sample_stratified", f"""
SELECT event_id, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_HASH.format('s1')}, event_id) AS n
    FROM events) WHERE n <= 50""")
def sample_stratified(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return N.stratified_sample(events, ["event_type"], "event_id", 50, "s1")


@query("sample_weighted", f"""
SELECT event_id, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY
        -ln(CAST(('0x' || substr({_HASH.format('s2')}, 1, 13))::BIGINT + 1 AS DOUBLE)
            / 4503599627370496.0) / value, event_id) AS n
    FROM events WHERE value > 0) WHERE n <= 50""")
def sample_weighted(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return N.weighted_sample(events, ["event_type"], "event_id", "value", 50, "s2")

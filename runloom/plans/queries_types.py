"""Registered queries: semi-structured values, collations and scripts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runloom.operators import status as A
from runloom.plans import jobs
from runloom.plans import stand_ins as S
from runloom.plans.queries_reports import REPORT_SQL, rounded
from runloom.plans.registry import query, table
from runloom.session import open_session, scratch_dir
from runloom.sources import sinks

# --- VARIANT ---------------------------------------------------------------------------------

# Property texts as they arrive: nested, of changing types, broken and missing. The same SQL in both.
_PROPS = """
CASE WHEN event_id % 10 = 0 THEN 'broken {{' WHEN event_id % 11 = 0 THEN NULL
     WHEN event_id % 7 = 0 THEN '{{"k": "k' || event_id || '", "deep": {{"v": null}}}}'
     ELSE '{{"k": ' || event_id || ', "deep": {{"v": ' || CAST(user_id AS {text}) || '.5}}, "tags": ["'
          || event_type || '", "u' || CAST(user_id % 3 AS {text}) || '"]}}' END"""
PROPS_SQL = f"SELECT event_id, {_PROPS.format(text='VARCHAR')} AS props FROM events"


def variant_table(spark, d):
    """Events with their properties as VARIANT, written and read back; broken texts are NULL."""
    path = scratch_dir(spark, "variant_events")
    events = table(spark, d, "events").select(
        "event_id", F.expr(f"try_parse_json({_PROPS.format(text='STRING')})").alias("props"))
    sinks.write_parquet(events, path)
    return spark.read.parquet(path)


@query("variant_fields", f"""
SELECT event_id, props IS NULL OR NOT json_valid(props) AS missing,
       CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k_text,
       CASE WHEN json_valid(props) THEN CAST(json_extract_string(props, '$.deep.v') AS DOUBLE) END AS deep,
       CASE WHEN json_valid(props) THEN json_extract_string(props, '$.tags[1]') END AS tag
FROM ({PROPS_SQL})""")
def variant_fields(spark, d):
    """Fields by path and type; a value that does not fit its type is NULL."""
    v = F.col("props")
    return variant_table(spark, d).select(
        "event_id", v.isNull().alias("missing"),
        F.try_variant_get(v, "$.k", "long").alias("k"),
        F.variant_get(v, "$.k", "string").alias("k_text"),
        F.variant_get(v, "$.deep.v", "double").alias("deep"),
        F.variant_get(v, "$.tags[1]", "string").alias("tag"))


@query("variant_explode", f"""
SELECT place, tag, count(*) AS n
FROM (SELECT CAST(unnest(range(len(tags))) AS INTEGER) AS place, unnest(tags) AS tag
      FROM (SELECT CAST(json_extract(props, '$.tags') AS VARCHAR[]) AS tags FROM ({PROPS_SQL})
            WHERE json_valid(props)) WHERE tags IS NOT NULL)
GROUP BY 1, 2""")
def variant_explode(spark, d):
    rows = variant_table(spark, d)
    exploded = rows.lateralJoin(
        spark.tvf.variant_explode(F.variant_get(F.col("props").outer(), "$.tags", "variant")))
    return (exploded.groupBy(F.col("pos").alias("place"),
                             F.variant_get("value", "$", "string").alias("tag"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("variant_schema", "SELECT 'OBJECT<deep: OBJECT<v: DECIMAL(18,1)>, k: VARIANT, "
                         "tags: ARRAY<STRING>>' AS fields")
def variant_schema(spark, d):
    """The schema that all properties share, found in one pass."""
    fields = F.schema_of_variant_agg("props").alias("fields")
    return variant_table(spark, d).agg(F.regexp_replace(fields, r"DECIMAL\(\d+,1\)", "DECIMAL(18,1)")
                                       .alias("fields"))


# --- collations ------------------------------------------------------------------------------

_NAMES = """
SELECT event_id, 'ns' || (user_id % 5) AS namespace,
       CASE event_id % 4 WHEN 0 THEN 'Réport-' WHEN 1 THEN 'report-' WHEN 2 THEN 'REPORT-'
            ELSE 'rèpört-' END || user_id AS name
FROM {events}"""


def _names(spark, d):
    return spark.sql(_NAMES, events=table(spark, d, "events"))


@query("collated_collisions", f"""
SELECT namespace, lower(strip_accents(name)) AS folded, count(DISTINCT name) AS names,
       count(*) AS uses
FROM ({_NAMES.format(events='events')}) GROUP BY 1, 2 HAVING count(DISTINCT name) > 1""")
def collated_collisions(spark, d):
    """Names that differ by case or accents only, as one group of their collation."""
    found = A.collated_collisions(_names(spark, d))
    return found.select("namespace", F.lower(F.translate("name", "éèöÉÈÖ", "eeoEEO")).alias("folded"),
                        "names", "uses")


@query("collated_join", f"""
SELECT n.event_id, p.n_name
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name
                       ELSE upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) END AS name
      FROM events JOIN nation ON user_id % 30 = n_nationkey) n
JOIN nation p ON lower(n.name) = lower(p.n_name)""")
def collated_join(spark, d):
    """Keys meet whatever their case: the collation is in the join, no column is rewritten."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    written = F.expr("""CASE event_id % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name
                        ELSE upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) END""")
    uses = (table(spark, d, "events").join(nation, F.col("user_id") % 30 == F.col("n_nationkey"))
            .select("event_id", written.alias("name")))
    known = nation.select("n_name")
    return uses.join(known, F.collate("name", "UTF8_LCASE") == F.collate("n_name", "UTF8_LCASE")).select(
        "event_id", "n_name")


# --- scripts ---------------------------------------------------------------------------------

SCRIPT = """
BEGIN
  -- The report, weekday by weekday; a day that fails is counted and left out.
  DECLARE day INT DEFAULT 1;
  DECLARE failed INT DEFAULT 0;
  DECLARE statement STRING;
  CREATE TABLE {name} (day_of_week INT, avg_amount DOUBLE, avg_trip_distance DOUBLE,
                       total_passengers BIGINT) USING parquet LOCATION '{path}';
  WHILE day <= 8 DO
    BEGIN
      DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO SET failed = failed + 1;
      SET statement = 'INSERT INTO {name} SELECT dayofweek(tpep_pickup_datetime), avg(total_amount), '
        || 'avg(trip_distance), sum(passenger_count) FROM given_trips '
        || 'WHERE dayofweek(tpep_pickup_datetime) = ' || day || ' AND 1 DIV (8 - ' || day || ') >= 0 '
        || 'GROUP BY 1';
      EXECUTE IMMEDIATE statement;
    END;
    SET day = day + 1;
  END WHILE;
  IF failed = 1 THEN
    SELECT * FROM {name};
  ELSE
    SELECT * FROM {name} WHERE false;
  END IF;
END
"""


@query("sql_script", REPORT_SQL)
def sql_script(spark, d):
    """A procedural SQL file: variables, a loop, a handler and statements made at run time."""
    child = open_session(spark)
    S.trips(child, d).createOrReplaceTempView("given_trips")
    script = SCRIPT.format(name=f"script_report_{uuid.uuid4().hex[:12]}",
                           path=scratch_dir(spark, "script_report"))
    return rounded(jobs.run_script(child, script))

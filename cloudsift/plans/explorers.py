"""Explorers over detections that Spark derives from the event log, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators import explore
from cloudsift.plans import datasets as D
from cloudsift.plans.dataset_queries import STATEMENTS, detections, plain
from cloudsift.plans.events import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIMENSIONS = ["api", "SrcIP", "UserAgent", "UserAccessKeyID", "AwsRegion"]


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL; times come as text."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return put


@query(f"""SELECT count(*) AS identities, CAST(sum(num_of_events) AS BIGINT) AS total_events, CAST(sum(abused_success) AS BIGINT) AS abused_apis, CAST(sum(abused_failed) AS BIGINT) AS failed_abuse,
count(*) FILTER (abused_success + abused_failed > 0) AS identities_abused FROM ({STATEMENTS["identities"]})""")
def o87_identity_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-87: totals over identities."""
    made = detections(spark, sf_dir)
    return explore.identity_kpis(D.identities(made["summary"], made["calls"], made["attributes"]))


@query(f"""SELECT api AS "API", call_count AS "Count", first_seen AS "FirstSeen" FROM ({STATEMENTS["api_calls"]}) WHERE user_arn = 'user/1' AND is_abused AND outcome = 'success' ORDER BY call_count DESC, api LIMIT 200""")
def o88_api_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-88: abused calls of an identity that succeeded."""
    return explore.api_quadrant(detections(spark, sf_dir)["calls"], "user/1", True, "success").select("API", "Count", "FirstSeen")


@query(f"""SELECT value AS "Value", occurrence_count AS "Count", last_seen AS "LastSeen" FROM ({STATEMENTS["attributes"]}) WHERE user_arn = 'user/1' AND attribute = 'SrcIP' AND value LIKE '%0.1%' ORDER BY occurrence_count, value LIMIT 200""")
def o88_attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-88: an identity's addresses that hold a text, the rarest first."""
    return explore.attribute_values(detections(spark, sf_dir)["attributes"], "user/1", "SrcIP", "0.1", descending=False).select("Value", "Count", "LastSeen")


@query(f"""SELECT user_arn AS "UserARN", occurrence_count AS "Count" FROM ({STATEMENTS["attributes"]}) WHERE attribute = 'SrcIP' AND value = '10.0.0.7'""")
def o88_identities_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-88: the identities that used an address."""
    return explore.identities_with(detections(spark, sf_dir)["attributes"], "SrcIP", "10.0.0.7").select("UserARN", "Count")


@query(f"""WITH held AS (SELECT user_arn, attribute AS dimension, value AS v, occurrence_count AS n FROM ({STATEMENTS["attributes"]}) UNION ALL SELECT user_arn, 'api', api || ' (' || event_source || ')', CAST(sum(call_count) AS BIGINT) FROM ({STATEMENTS["api_calls"]}) GROUP BY user_arn, api, event_source),
a AS (SELECT * FROM held WHERE user_arn = 'user/1'), b AS (SELECT * FROM held WHERE user_arn = 'user/2')
SELECT coalesce(a.dimension, b.dimension) AS dimension, coalesce(a.v, b.v) AS "Value", coalesce(a.n, 0) AS weight_a, coalesce(b.n, 0) AS weight_b, CASE WHEN b.v IS NULL THEN 'only_a' WHEN a.v IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.dimension = b.dimension AND a.v = b.v""")
def o89_compare_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-89: two identities along all five dimensions."""
    made, out = detections(spark, sf_dir), None
    for name in DIMENSIONS:
        own = explore.compare_along(made["calls"], made["attributes"], "user/1", "user/2", name).withColumn("dimension", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""SELECT field AS "Field", value AS "Value", occurrence_count AS "Count" FROM ({STATEMENTS["detection_metrics"]}) WHERE field = 'k' AND occurrence_count BETWEEN 3 AND 100000 AND value LIKE '%1%' AND first_seen >= '2024-01-01 00:10:00'""")
def o90_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-90: values of a field within counts that hold a text, first seen after a time."""
    return explore.field_values(detections(spark, sf_dir)["metrics"], "k", 3, 100_000, "1", "2024-01-01 00:10:00").select("Field", "Value", "Count")


@query(f"""SELECT coalesce(src_country, 'unknown') AS place, count(*) AS distinct_values, CAST(sum(occurrence_count) AS BIGINT) AS total FROM ({STATEMENTS["detection_metrics"]}) WHERE field = 'k' GROUP BY 1""")
def o92_geo_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-92: a field's counts by country."""
    return explore.geo_breakdown(detections(spark, sf_dir)["metrics"], "k")

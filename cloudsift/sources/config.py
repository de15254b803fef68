"""Resource-configuration snapshots to snapshots, resources and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "resourceId string, resourceType string, awsRegion string, resourceName string, awsAccountId string, configurationItemCaptureTime string, "
    "configuration string, tags string, relationships array<struct<resourceId:string, resourceType:string, name:string>>"
)


def read_snapshots(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O-09 to O-11: (snapshots, resources, edges); edges only to resources of the same snapshot."""
    files = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    whole = files.select(F.get_json_object("value", "$.configSnapshotId").alias("snapshot_id"), F.from_json(F.get_json_object("value", "$.configurationItems"), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITEM.split(', ', 8))}>>").alias("items"))
    each = whole.select("snapshot_id", F.posexplode("items").alias("at", "item"))
    taken = F.try_to_timestamp(F.regexp_replace("item.configurationItemCaptureTime", "Z$", "+00:00"))
    rows = each.select("snapshot_id", "at", F.col("item.resourceId").alias("resource_id"), F.col("item.resourceType").alias("resource_type"), F.col("item.resourceName").alias("resource_name"), F.col("item.awsRegion").alias("region"), F.col("item.awsAccountId").alias("account_id"), F.nullif(F.col("item.configuration"), F.lit("{}")).alias("configuration"), F.nullif(F.col("item.tags"), F.lit("{}")).alias("tags"), taken.alias("captured_at"), "item.relationships")
    snapshots = rows.groupBy("snapshot_id").agg(F.min_by("account_id", "at").alias("account_id"), F.min_by("region", "at").alias("region"), F.max("captured_at").alias("captured_at"), F.count("*").alias("record_count"))
    # Of an item that is met twice in a snapshot the first counts.
    facts = ["resource_name", "region", "configuration", "tags"]
    resources = rows.groupBy("snapshot_id", "resource_id", "resource_type").agg(F.min(F.struct("at", *facts)).alias("first")).select("snapshot_id", "resource_id", "resource_type", *(f"first.{c}" for c in facts))
    edges = rows.select("snapshot_id", F.col("resource_id").alias("source_id"), F.explode("relationships").alias("r")).select("snapshot_id", "source_id", F.col("r.resourceId").alias("target_id"), F.trim("r.name").alias("name"))
    edges = edges.filter(F.coalesce("target_id", F.lit("")) != "").distinct()
    return snapshots, resources, without_dangling(edges, resources)


def without_dangling(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """O-10: edges whose target is in the same snapshot."""
    there = resources.select("snapshot_id", F.col("resource_id").alias("target_id"))
    return edges.join(there, ["snapshot_id", "target_id"], "left_semi")


def to_import(found: DataFrame, snapshots: DataFrame, resources: DataFrame) -> DataFrame:
    """O-12: snapshots that are new, or known but without resources (a broken import)."""
    whole = snapshots.join(resources.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return found.join(whole.select("snapshot_id"), "snapshot_id", "left_anti")

"""Explorers over detection summaries and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.operators.combine import compare_sets
from cloudsift.operators.group import joined


def identity_overview(summary: DataFrame, calls: DataFrame, attributes: DataFrame) -> DataFrame:
    """O-87: each identity with its abused and other calls by outcome and its distinct attribute values."""
    hit = lambda abused, outcome: (F.col("IsAbused") == abused) & (F.col("Outcome") == outcome)
    named = [("abused_success", True, "success"), ("abused_failed", True, "failed"), ("other_success", False, "success"), ("other_failed", False, "failed")]
    facts = calls.groupBy("UserARN").agg(*(F.count_if(hit(a, o)).alias(n) for n, a, o in named), F.count_distinct(F.when(F.col("IsAbused"), F.col("API"))).alias("abused_apis"), F.sum("Count").alias("calls"))
    values = attributes.groupBy("UserARN").agg(F.count_distinct("Attribute", "Value").alias("attribute_values"))
    out = summary.join(facts, "UserARN", "left").join(values, "UserARN", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in (*(n for n, *_ in named), "abused_apis", "calls", "attribute_values")})


def identity_kpis(overview: DataFrame) -> DataFrame:
    """O-87: totals over the dataset of identities, one row."""
    return overview.agg(
        F.count("*").alias("identities"), F.sum("num_of_events").alias("total_events"), F.sum("abused_success").alias("abused_apis"), F.sum("abused_failed").alias("failed_abuse"),
        F.count_if(F.col("abused_success") + F.col("abused_failed") > 0).alias("identities_abused"),
    )


def api_quadrant(calls: DataFrame, arn: str, abused: bool, outcome: str, limit: int = 200) -> DataFrame:
    """O-88: an identity's calls of one kind, the most frequent first."""
    found = calls.filter((F.col("UserARN") == arn) & (F.col("IsAbused") == abused) & (F.col("Outcome") == outcome))
    return found.orderBy(F.desc("Count"), "API", "EventSource").limit(limit)


def attribute_values(attributes: DataFrame, arn: str, attribute: str, search: str = "", descending: bool = True, limit: int = 200) -> DataFrame:
    """O-88: values of an identity's attribute that hold a text, by count."""
    found = attributes.filter((F.col("UserARN") == arn) & (F.col("Attribute") == attribute))
    found = found.filter(F.contains(F.lower("Value"), F.lit(search.lower()))) if search else found
    return found.orderBy(F.desc("Count") if descending else F.asc("Count"), "Value").limit(limit)


def sharing(attributes: DataFrame, attribute: str, least: int = 2) -> DataFrame:
    """O-88: values of an attribute that several identities have."""
    found = attributes.filter(F.col("Attribute") == attribute).groupBy("Value").agg(F.count_distinct("UserARN").alias("identities"), joined("UserARN").alias("arns"), F.sum("Count").alias("uses"))
    return found.filter(F.col("identities") >= least)


def identities_with(attributes: DataFrame, attribute: str, value: str) -> DataFrame:
    """O-88: the identities that were seen with a value, the most frequent first."""
    found = attributes.filter((F.col("Attribute") == attribute) & (F.col("Value") == value))
    return found.orderBy(F.desc("Count"), "UserARN")


def compare_along(calls: DataFrame, attributes: DataFrame, a: str, b: str, dimension: str) -> DataFrame:
    """O-89: two identities side by side by their actions (api) or by one of their attributes; nulls are left out."""
    if dimension == "api":
        own = calls.withColumn("Value", F.concat("API", F.lit(" ("), "EventSource", F.lit(")")))
    else:
        own = attributes.filter(F.col("Attribute") == dimension)
    return compare_sets(own.filter("Value is not null"), "UserARN", a, b, "Value", "Count")


def compare_identities(attributes: DataFrame, a: str, b: str, attribute: str) -> DataFrame:
    """O-89: two identities side by side along one dimension."""
    return compare_sets(attributes.filter(F.col("Attribute") == attribute), "UserARN", a, b, "Value", "Count")


def field_stats(metrics: DataFrame) -> DataFrame:
    """O-90: each field's values, total, largest share and values seen once."""
    out = metrics.groupBy("Field").agg(F.count("*").alias("distinct_values"), F.sum("Count").alias("total"), F.max("Count").alias("top"), F.count_if(F.col("Count") == 1).alias("singletons"))
    return out.withColumn("top_share", F.col("top") / F.col("total"))


def field_values(metrics: DataFrame, field: str, low: int | None = None, high: int | None = None, search: str = "", after: str | None = None) -> DataFrame:
    """O-90: a field's values within counts, holding a text, first seen after a time."""
    out = metrics.filter(F.col("Field") == field)
    out = out.filter(F.col("Count") >= low) if low is not None else out
    out = out.filter(F.col("Count") <= high) if high is not None else out
    out = out.filter(F.contains(F.lower("Value"), F.lit(search.lower()))) if search else out
    return out.filter(F.col("FirstSeen") >= F.lit(after).cast("timestamp")) if after else out


def geo_breakdown(metrics: DataFrame, field: str, column: str = "SrcCountry") -> DataFrame:
    """O-92: a field's counts by country; without one, unknown."""
    return metrics.filter(F.col("Field") == field).groupBy(F.coalesce(column, F.lit("unknown")).alias("place")).agg(F.count("*").alias("distinct_values"), F.sum("Count").alias("total"))


def compare_fields(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """O-92: the values of two fields side by side."""
    return compare_sets(metrics, "Field", a, b, "Value", "Count")

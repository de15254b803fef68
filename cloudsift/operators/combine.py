"""Joins, unions and set comparisons of hunts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_join(left: DataFrame, right: DataFrame, on: Sequence[str], before: str, after: str) -> DataFrame:
    """O-42: pairs on equal keys whose right time lies after the left one."""
    return left.join(right, list(on)).filter(F.col(after) > F.col(before))


def with_facts(left: DataFrame, facts: DataFrame, on: Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """O-43: all rows of left with aggregated facts, absent ones filled."""
    out = left.join(facts, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (fill or {}).items()})


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """O-49: SQL's NOT IN: a null among the values leaves nothing, a null in the column is dropped."""
    name = values.columns[0]
    nulls = values.agg(F.count_if(F.col(name).isNull()).alias("nulls"), F.count("*").alias("n"))
    kept = df.join(values.select(F.col(name).alias("_value")).distinct(), F.col(column) == F.col("_value"), "left_anti")
    # One row; an empty list excludes nothing, not even nulls.
    return kept.crossJoin(F.broadcast(nulls)).filter((F.col("n") == 0) | ((F.col("nulls") == 0) & F.col(column).isNotNull())).drop("nulls", "n")


def rare_dimension_filter(df: DataFrame, dimension: str, least: float) -> DataFrame:
    """O-49: rows whose dimension value holds less than a share of all rows."""
    counts = df.groupBy(dimension).agg(F.count("*").alias("n"))
    common = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).filter(F.col("n") >= least * F.col("total")).select(dimension)
    return not_in(df, dimension, common)


def co_occurrence(df: DataFrame, principal: str, bucket: Column, item: str) -> DataFrame:
    """O-46: pairs of items of one principal in one bucket, with how often and for how many principals.

    A bucket's items are distinct before they meet, so a pair counts once in it. The join is an equality
    on principal and bucket that Spark's skew handling can split.
    """
    seen = df.select(F.col(principal).alias("principal"), bucket.alias("bucket"), F.col(item).alias("item")).dropna().distinct()
    pairs = seen.withColumnRenamed("item", "item_a").join(seen.withColumnRenamed("item", "item_b"), ["principal", "bucket"]).filter("item_a < item_b")
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("together"), F.count_distinct("principal").alias("principals"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))


def in_ranges(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, start: str, stop: str) -> DataFrame:
    """O-47: for every range, how many points of the same keys lie in it (ends included).

    A range is known by its keys and ends, so that its count finds it again however often Spark makes the ranges. They are
    one struct: counting by it shuffles partial counts, and Spark can split a hot key of the join before.
    """
    own = list(dict.fromkeys([*on, start, stop]))
    named = lambda df: df.withColumn("_range", F.struct(*own))
    hits = named(ranges.select(*own).distinct()).join(points.select(*on, at), list(on)).filter(F.col(at).between(F.col(start), F.col(stop)))
    return named(ranges).join(hits.groupBy("_range").agg(F.count("*").alias("points")), "_range", "left").withColumn("points", F.coalesce("points", F.lit(0))).drop("_range")


def compare_sets(df: DataFrame, key: str, a: object, b: object, value: str, weight: str) -> DataFrame:
    """O-50, O-89, O-92: values of two keys side by side: shared, only_a or only_b."""
    side = lambda which, name: df.filter(F.col(key) == F.lit(which)).groupBy(value).agg(F.sum(weight).alias(name))
    both = side(a, "weight_a").join(side(b, "weight_b"), value, "full_outer")
    kind = F.when(F.col("weight_b").isNull(), "only_a").when(F.col("weight_a").isNull(), "only_b").otherwise("shared")
    return both.select(value, F.coalesce("weight_a", F.lit(0)).alias("weight_a"), F.coalesce("weight_b", F.lit(0)).alias("weight_b"), kind.alias("side"))


def indicators(df: DataFrame, columns: Mapping[str, str], aggs: Sequence[Column]) -> DataFrame:
    """O-72: (type, value) of several columns with aggregates, from one scan; nulls drop. Own columns of these names are hidden."""
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("value")) for kind, c in columns.items())))
    return df.withColumn("_one", each).withColumns({"type": F.col("_one.type"), "value": F.col("_one.value")}).filter(F.col("value").isNotNull()).groupBy("type", "value").agg(*aggs)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """O-73: the distinct values of several columns, from one scan."""
    return df.select(F.explode(F.array(*columns)).alias("value")).filter(F.col("value").isNotNull()).distinct()


def explode_rollup(df: DataFrame, array: str, name: str, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """O-74: groups by the elements of an array column; rows without elements drop."""
    return df.withColumn(name, F.explode(array)).groupBy(*keys, name).agg(*aggs)


def tags_long(df: DataFrame, tactics: str = "Tactics", techniques: str = "TechniqueIDs", others: str = "OtherTags") -> DataFrame:
    """O-74: one row for each tag, with its kind: tactic, technique, group (G and four digits) or other."""
    tag = lambda kind: lambda x: F.struct(kind(x).alias("tag_kind"), x.alias("tag"))
    empty = F.array().cast("array<struct<tag_kind:string,tag:string>>")
    lists = [
        F.coalesce(F.transform(tactics, tag(lambda x: F.lit("tactic"))), empty),
        F.coalesce(F.transform(techniques, tag(lambda x: F.lit("technique"))), empty),
        F.coalesce(F.transform(others, tag(lambda x: F.when(x.rlike("^[Gg][0-9]{4}$"), "group").otherwise("other"))), empty),
    ]
    return df.withColumn("_tag", F.explode(F.concat(*lists))).select("*", "_tag.tag_kind", "_tag.tag").drop("_tag")

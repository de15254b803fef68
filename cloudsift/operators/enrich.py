"""Geography of addresses."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudsift.functions import net
from cloudsift.sources.scratch import cut

GEO = ["country", "city", "asn", "org"]
#: Names of columns that hold addresses.
# Loose shapes of addresses, which names of services lack.
IPV4_SHAPE, IPV6_SHAPE = r"^[0-9]{1,3}([.][0-9]{1,3}){3}$", r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]+$"
ADDRESS_NAME = re.compile(r"(^|_)(ip|addr|ip_?address|srcip|source_?ip)($|_)", re.I)


def swept(points: DataFrame, at: str, ranges: DataFrame) -> DataFrame:
    """(ip, facts) of the points (ip, `at`) that one of the disjoint ranges (low, high, facts) holds.

    Borders and points are sorted together in ranges of their values and written. Within a part the last border
    goes along to the points behind it, and each part takes up the last border of the parts before it: one
    row for each part. So what is shuffled is each point and each range once, however wide ranges are.
    """
    facts = [g for g in GEO if g in ranges.columns]
    border = F.struct("low", "high", *facts)
    lines = ranges.select(F.lit(None).cast("string").alias("ip"), F.col("low").alias("at"), border.alias("border")).unionByName(points.select("ip", F.col(at).alias("at")), allowMissingColumns=True)
    by = [F.col("at"), F.col("ip").asc_nulls_first()]
    ordered = lines.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumn("part", F.shiftright("id", 33)), "sweep")
    ends = ordered.groupBy(F.col("part").alias("own_part")).agg(F.max_by("border", F.when(F.col("border").isNotNull(), F.col("id"))).alias("end"))
    carried = ends.select("own_part", F.last("end", ignorenulls=True).over(Window.orderBy("own_part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    last = F.last("border", ignorenulls=True).over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    met = ordered.withColumn("last", last).filter("ip is not null").join(carried, F.col("part") == F.col("own_part"))
    return met.select("ip", "at", F.coalesce("last", "carried").alias("held")).filter("at <= held.high").select("ip", *(f"held.{g}" for g in facts))


def geo_lookup(addresses: DataFrame, ranges: DataFrame, ip: str = "ip", ranges6: DataFrame | None = None) -> DataFrame:
    """O-26: (ip, country, city, asn, org) of distinct addresses over disjoint ranges (low, high, ...), and IPv6 ones over ranges6.

    Special addresses get their class as country and nothing else; others that no range holds, nulls.
    """
    own = addresses.select(F.col(ip).alias("ip")).filter("ip is not null").distinct()
    own = own.withColumns({"n": net.ip_number(F.col("ip")), "class": net.ip_class(F.col("ip"))})
    found = swept(own.filter("class is null and n is not null"), "n", ranges)
    if ranges6 is not None:
        found = found.unionByName(geo_lookup6(own.filter("class is null and n is null").select("ip"), ranges6), allowMissingColumns=True)
    every = own.join(found, "ip", "left")
    return every.select("ip", F.coalesce("class", "country").alias("country"), *(g for g in GEO[1:] if g in ranges.columns))


def geo_lookup6(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges (low, high as 32 hexadecimal digits, ...) that hold IPv6 addresses; those that none holds are left out."""
    own = addresses.withColumn("digits", net.ip6_digits(F.col("ip"))).filter("digits is not null")
    return swept(own, "digits", ranges)


def populate(geo: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], ranges: DataFrame, ranges6: DataFrame | None = None) -> DataFrame:
    """O-27: the lookup with the addresses that it lacks, found once each over all tables and columns."""
    every = None
    for df, columns in tables:
        own = df.select(F.explode(F.array(*columns)).alias("ip"))
        every = own if every is None else every.unionAll(own)
    new = every.filter("ip is not null").distinct().join(geo.select("ip"), "ip", "left_anti")
    return geo.unionByName(geo_lookup(new, ranges, ranges6=ranges6), allowMissingColumns=True)


def with_geo(df: DataFrame, geo: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """O-30: a table beside the geography of one address column."""
    facts = geo.select(F.col("ip").alias("_ip"), *(F.col(g).alias(f"{prefix}geo_{g}") for g in GEO if g in geo.columns))
    return df.join(facts, F.col(column) == F.col("_ip"), "left").drop("_ip")


def address_columns(df: DataFrame, columns: Sequence[str] = ()) -> list[str]:
    """Text columns with an address's name, or given, that hold a value of an address's shape. One row reaches the driver."""
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    named = [c for c in df.columns if c in strings and (c in columns or ADDRESS_NAME.search(c))]
    shaped = lambda c: F.max(F.col(f"`{c}`").rlike(IPV4_SHAPE) | F.col(f"`{c}`").rlike(IPV6_SHAPE))
    held = df.agg(*(shaped(c).alias(f"_{i}") for i, c in enumerate(named))).first() if named else ()
    return [c for c, yes in zip(named, held, strict=True) if yes]


def enrich_result(df: DataFrame, geo: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """O-32: country, city and organisation right after each address column, found by name or given, and by its values.

    A result that has geography already stays as it is; the second and later columns get a prefix.
    """
    if any(c.startswith("geo_") for c in df.columns):
        return df
    found = address_columns(df, columns)
    order: list[str] = []
    out = df
    for c in df.columns:
        order.append(c)
        if c in found:
            prefix = "" if found.index(c) == 0 else f"{c}_"
            out = with_geo(out, geo.select("ip", *(g for g in ("country", "city", "org") if g in geo.columns)), c, prefix)
            order += [f"{prefix}geo_{g}" for g in ("country", "city", "org") if g in geo.columns]
    return out.select(*order)


def lookup_source(geo: DataFrame, events: DataFrame, ip: str = "source_ip_address") -> DataFrame:
    """O-33: the lookup, and for addresses that it lacks the largest values that events carry."""
    own = events.filter(F.col(ip).isNotNull()).groupBy(F.col(ip).alias("ip")).agg(*(F.max(f"geo_{g}").alias(g) for g in GEO if f"geo_{g}" in events.columns))
    return geo.unionByName(own.join(geo.select("ip"), "ip", "left_anti"), allowMissingColumns=True)


def flow_log_configs(events: DataFrame) -> DataFrame:
    """O-31: flow logs made or removed in the audit trail: the first id, traffic type, resources and format, by patterns of the JSON texts."""
    rows = events.filter((F.col("event_source") == "ec2.amazonaws.com") & F.col("event_name").isin("CreateFlowLogs", "DeleteFlowLogs"))
    both = F.concat_ws(" ", F.coalesce("response_elements", F.lit("")), F.coalesce("request_parameters", F.lit("")))
    one = lambda text, pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return rows.select(
        "event_time", "event_name", F.col("recipient_account_id").alias("account_id"), F.col("aws_region").alias("region"), "user_identity_arn",
        one(both, "fl-[0-9a-f]+", 0).alias("flow_log_id"), one("request_parameters", r'"[Tt]raffic[Tt]ype"\s*:\s*"(ALL|ACCEPT|REJECT)"').alias("traffic_type"),
        F.regexp_extract_all("request_parameters", F.lit("(?:vpc|subnet|eni)-[0-9a-f]+"), F.lit(0)).alias("resource_ids"),
        one("request_parameters", r'"[Ll]og[Ff]ormat"\s*:\s*"([^"]*)"').alias("log_format"), "error_code", "request_parameters", "response_elements",
    )

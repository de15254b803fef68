"""The datasets that charts read: tables with fixed columns, and the metrics that each one names.

A dataset is a function of the tables that it is made from. Texts of several values are joined by a comma.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.operators import combine as C
from cloudsift.operators import enrich, shape
from cloudsift.operators import group as G
from cloudsift.plans import flow_hunts as V
from cloudsift.sources import flows

FAILED = "count(CASE WHEN error_code IS NOT NULL THEN 1 END)"
WRITES = "count(CASE WHEN read_only = false THEN 1 END)"
CALLERS = "count(DISTINCT user_identity_arn)"
ALL = "count(*)"
#: Metrics by dataset, as SQL over its columns. Their names, and the error codes of a denial.
METRICS: dict[str, dict[str, str]] = {
    "audit_events": {
        "count": ALL, "event_count": ALL, "call_count": ALL, "request_count": ALL, "error_count": FAILED, "error_requests": FAILED, "write_count": WRITES, "write_requests": WRITES, "write_events": WRITES,
        "error_events": FAILED, "total_events": ALL, "unique_callers": CALLERS, "unique_identities": CALLERS,
        "denied_count": "count(CASE WHEN error_code IN ('AccessDenied', 'Client.UnauthorizedAccess', 'UnauthorizedAccess', 'AccessDeniedException') THEN 1 END)",
        "total_logins": ALL, "failed_logins": FAILED, "success_logins": "count(CASE WHEN error_code IS NULL THEN 1 END)",
    },
    "detection_metrics": {
        "count": ALL, "occurrence_total": "sum(occurrence_count)", "distinct_values": "count(DISTINCT value)", "distinct_fields": "count(DISTINCT field)", "top_share": "max(percent)",
        "singleton_values": "count(CASE WHEN occurrence_count = 1 THEN 1 END)",
    },
    "api_calls": {
        "count": ALL, "call_total": "sum(call_count)", "abused_call_total": "sum(CASE WHEN is_abused THEN call_count ELSE 0 END)", "failed_call_total": "sum(CASE WHEN outcome = 'failed' THEN call_count ELSE 0 END)",
        "abused_failed_total": "sum(CASE WHEN is_abused AND outcome = 'failed' THEN call_count ELSE 0 END)", "distinct_abused_apis": "count(DISTINCT CASE WHEN is_abused THEN api END)", "distinct_identities": "count(DISTINCT user_arn)",
    },
    "attributes": {"count": ALL, "occurrence_total": "sum(occurrence_count)", "distinct_values": "count(DISTINCT value)", "distinct_identities": "count(DISTINCT user_arn)"},
    "identities": {
        "count": ALL, "identity_count": ALL, "total_events": "sum(num_of_events)", "abused_success_total": "sum(abused_success)", "abused_failed_total": "sum(abused_failed)",
        "other_total": "sum(other_success) + sum(other_failed)", "max_active_days": "max(active_days)",
    },
    "timeline": {
        "count": ALL, "detection_count": ALL, "distinct_events": "count(DISTINCT event_id)", "severe_count": "count(CASE WHEN level IN ('critical', 'high') THEN 1 END)",
        "medium_plus_count": "count(CASE WHEN level IN ('critical', 'high', 'medium') THEN 1 END)", "distinct_rules": "count(DISTINCT rule_title)", "distinct_principals": "count(DISTINCT user_arn)",
        "distinct_src_ips": "count(DISTINCT src_ip)", "failed_count": FAILED,
    },
    "timeline_tags": {"count": ALL, "distinct_detections": "count(DISTINCT event_id)", "distinct_tag_values": "count(DISTINCT tag_value)", "distinct_rules": "count(DISTINCT rule_title)"},
    **{name: {"count": ALL} for name in ("provenance", "flow_egress_daily", "flow_internal_pairs", "flow_log_configs", "flow_periodicity", "flow_records", "flow_reject_accept", "flow_sources", "flow_staging")},
}

# The columns of detection outputs and what the datasets call them.
FIELD_COUNTS = {"Field": "field", "TimelineColumn": "timeline_column", "Value": "value", "Count": "occurrence_count", "FieldTotal": "field_total", "Percent": "percent", "FirstSeen": "first_seen", "LastSeen": "last_seen"}
PLACES = {"SrcASN": "src_asn", "SrcCity": "src_city", "SrcCountry": "src_country"}
API_CALLS = {"UserARN": "user_arn", "IsAbused": "is_abused", "Outcome": "outcome", "API": "api", "EventSource": "event_source", "Description": "description", "Count": "call_count", "FirstSeen": "first_seen", "LastSeen": "last_seen"}
ATTRIBUTES = {"UserARN": "user_arn", "Attribute": "attribute", "Value": "value", "Count": "occurrence_count", "FirstSeen": "first_seen", "LastSeen": "last_seen"}
DETECTIONS = {
    "EventName": "event_name", "EventSource": "event_source", "AwsRegion": "aws_region", "ErrorCode": "error_code", "ErrorMessage": "error_message", "SrcIP": "src_ip", "UserAgent": "user_agent", "UserName": "user_name",
    "UserType": "user_type", "UserAccountID": "user_account_id", "UserARN": "user_arn", "UserPrincipalID": "user_principal_id", "UserAccessKeyID": "user_access_key_id", "EventID": "event_id",
}
RULES = {"Timestamp": "event_time", "RuleTitle": "rule_title", "RuleID": "rule_id", "RuleAuthor": "rule_author"}
# Paths of traffic by number from 1.
TRAFFIC_PATHS = ["Same VPC / Outpost LGW", "IGW or gateway endpoint (ambiguous)", "Virtual private gateway", "Intra-region peering", "Inter-region peering", "Local / Wavelength Zone", "Gateway endpoint", "Internet gateway"]
#: What the geography of an address may hold, by what the datasets call it.
GEO = {"country_code": "country", "country_name": "country_name", "city": "city", "latitude": "latitude", "longitude": "longitude", "asn": "asn", "org": "org"}


def metrics(df: DataFrame, dataset: str, by: Sequence[Column | str] = (), names: Sequence[str] = ()) -> DataFrame:
    """The metrics of a dataset (all, or those named) over its rows or over groups of them."""
    chosen = {n: METRICS[dataset][n] for n in names or METRICS[dataset]}
    return df.groupBy(*by).agg(*(F.expr(e).alias(n) for n, e in chosen.items()))


def renamed(df: DataFrame, names: Mapping[str, str]) -> list[Column]:
    """Columns by new names; those that the table lacks are null texts."""
    return [(F.col(old) if old in df.columns else F.lit(None).cast("string")).alias(new) for old, new in names.items()]


def audit_events(events: DataFrame) -> DataFrame:
    """D-01: the audit table as it is."""
    return events


def detection_metrics(counts: DataFrame) -> DataFrame:
    """D-02: values of fields with their counts, shares and the days between first and last sight."""
    return counts.select(*renamed(counts, FIELD_COUNTS), F.datediff("LastSeen", "FirstSeen").alias("active_days"), *renamed(counts, PLACES))


def provenance(meta: DataFrame, path: str) -> DataFrame:
    """D-03, D-07, D-09: the one row on a run of the detection tool, and where it was read."""
    return meta.withColumn("source_file", F.lit(path))


def api_calls(calls: DataFrame) -> DataFrame:
    """D-04: calls of identities, by action and outcome."""
    return calls.select(*renamed(calls, API_CALLS))


def attributes(values: DataFrame) -> DataFrame:
    """D-05: what identities were seen with."""
    return values.select(*renamed(values, ATTRIBUTES))


def identities(summary: DataFrame, calls: DataFrame, values: DataFrame) -> DataFrame:
    """D-06: identities with the calls of each kind and outcome and the distinct values of each attribute; 0 where there are none."""
    abused = F.coalesce("IsAbused", F.lit(False))
    kinds = {f"{kind}_{outcome}": (abused if kind == "abused" else ~F.coalesce("IsAbused", F.lit(True))) & (F.col("Outcome") == outcome) for kind in ("abused", "other") for outcome in ("success", "failed")}
    called = calls.groupBy("UserARN").agg(*(F.sum(F.when(c, F.col("Count"))).alias(n) for n, c in kinds.items()), F.count_distinct(F.when(abused, F.col("API"))).alias("abused_apis"))
    held = {"distinct_src_ips": "SrcIP", "distinct_user_agents": "UserAgent", "distinct_access_keys": "UserAccessKeyID", "distinct_regions": "AwsRegion"}
    seen = values.groupBy("UserARN").agg(*(F.count_distinct(F.when(F.col("Attribute") == a, F.col("Value"))).alias(n) for n, a in held.items()))
    all_facts = summary.join(called, "UserARN", "left").join(seen, "UserARN", "left")
    return all_facts.select(
        F.col("UserARN").alias("user_arn"), F.array_join("UserTypes", ", ").alias("user_types"), F.col("NumOfEvents").alias("num_of_events"), F.col("FirstTimestamp").alias("first_seen"),
        F.col("LastTimestamp").alias("last_seen"), F.datediff("LastTimestamp", "FirstTimestamp").alias("active_days"), *(F.coalesce(n, F.lit(0)).alias(n) for n in (*kinds, "abused_apis", *held)),
    )


def rank() -> Column:
    """5 to 1 from critical on; other levels are 1."""
    return F.coalesce(shape.level_rank(F.col("Level")), F.lit(1))


def timeline(detections: DataFrame) -> DataFrame:
    """D-08: detections with the rank of their level and their outcome; lists as texts."""
    lists = {"Tactics": "tactics", "TechniqueIDs": "technique_ids", "OtherTags": "other_tags"}
    return detections.select(
        *renamed(detections, RULES), F.col("Level").cast("string").alias("level"), rank().alias("level_rank"), *renamed(detections, DETECTIONS),
        F.when(F.col("ErrorCode").isNull(), "Success").otherwise("Failed").alias("outcome"), *(F.array_join(a, ", ").alias(b) for a, b in lists.items()),
    )


def timeline_tags(detections: DataFrame) -> DataFrame:
    """D-10: one row for each tag of a detection."""
    own = {n: DETECTIONS[n] for n in ("EventName", "UserName", "UserARN", "UserAccountID", "EventID")}
    each = C.tags_long(detections)
    return each.select(*renamed(each, RULES), F.col("Level").cast("string").alias("level"), rank().alias("level_rank"), *renamed(each, own), F.col("tag_kind").alias("tag_type"), F.col("tag").alias("tag_value"))


def flow_egress_daily(records: DataFrame) -> DataFrame:
    """D-11: what hosts send to outside in a day, and the median and number of their earlier days."""
    daily = G.earlier_medians(V.daily_egress(records), "local_addr", "day", "egress_bytes")
    daily = daily.withColumnsRenamed({"earlier_median": "baseline_bytes", "earlier_rows": "baseline_days"}).drop("earlier_days")
    return daily.withColumn("ratio_to_baseline", F.try_divide("egress_bytes", "baseline_bytes"))


def flow_internal_pairs(records: DataFrame) -> DataFrame:
    """D-12: private sources, destinations and ports; new from a day after the first record of all."""
    inside = records.filter(V.ok() & (F.col("src_scope") == "private") & (F.col("dst_scope") == "private"))
    pairs = inside.groupBy(*V.flow_ends(), "dstport").agg(F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"), F.count("*").alias("observations"), V.volume().alias("bytes_measured"))
    # One row.
    start = records.agg(F.min("start_time").alias("history_start"))
    return pairs.crossJoin(F.broadcast(start)).withColumn("is_new_pair", F.expr("first_seen >= history_start + INTERVAL 1 DAY"))


def flow_log_configs(events: DataFrame) -> DataFrame:
    """D-13: subscriptions made or removed; resources as a text."""
    return enrich.flow_log_configs(events).drop("request_parameters", "response_elements").withColumn("resource_ids", F.array_join("resource_ids", ", "))


def flow_periodicity(records: DataFrame) -> DataFrame:
    """D-14: peers met at even gaps, with all measures; flows without ports have none."""
    found = V.beacons(records, by=["protocol_name"]).filter("dstport IS NOT NULL")
    window = F.when(F.col("longest") > 60, 600).otherwise(60)
    ratio = F.col("active_buckets") / ((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / F.col("period_secs") + 1)
    return found.select(
        *V.PEER, "protocol_name", F.array_join(F.sort_array("interfaces"), ", ").alias("interface_ids"), "first_seen", "last_seen", "span_hours", "active_buckets", "period_secs",
        window.alias("aggregation_window_secs"), ratio.alias("active_bucket_ratio"), "jitter", "bytes_cv", "skipdata_overlaps", "confidence",
    )


def with_remote_geo(df: DataFrame, geo: DataFrame) -> DataFrame:
    """Rows with all that is known of the place of their remote address."""
    facts = geo.select(F.col("ip").alias("_ip"), *((F.col(own) if own in geo.columns else F.lit(None).cast("string")).alias(f"remote_geo_{name}") for name, own in GEO.items()))
    return df.join(facts, F.col("remote_addr") == F.col("_ip"), "left").drop("_ip")


def flow_records(records: DataFrame, geo: DataFrame) -> DataFrame:
    """D-15: records with both ends, names of their path, peers and middleboxes, and the remote place; blocked access has no bytes."""
    labels = F.try_element_at(F.array(*(F.lit(x) for x in TRAFFIC_PATHS)), F.when(F.col("traffic_path") > 0, F.col("traffic_path")))
    log = records if "flow_log_id" in records.columns else records.withColumn("flow_log_id", flows.flow_file_meta(F.col("source_file"))[2])
    own = log.select(
        "start_time", "end_time", F.col("duration").alias("duration_secs"), "flow_log_id", "account_id", "region", "vpc_id", "subnet_id", "interface_id", "instance_id", "interface_type", "resource_id",
        "srcaddr", "dstaddr", "pkt_srcaddr", "pkt_dstaddr", *V.flow_ends(), "src_scope", "dst_scope", "local_addr", "remote_addr", "remote_scope", "direction_source", "flow_direction", "srcport", "dstport",
        "protocol", "protocol_name", "ip_version", "packets", V.measured().alias("bytes_measured"), "action", "log_status", "tcp_flags", "traffic_path", labels.alias("traffic_path_label"),
        "pkt_src_aws_service", "pkt_dst_aws_service", F.coalesce("pkt_src_aws_service", "pkt_dst_aws_service").isNotNull().alias("aws_service_peer"), "reject_reason", "encryption_status",
        (F.col("interface_type").isNotNull() | F.col("resource_id").isNotNull()).alias("via_middlebox"), "has_parse_issue",
    )
    return with_remote_geo(own, geo)


def flow_reject_accept(records: DataFrame, geo: DataFrame) -> DataFrame:
    """D-16: peers that were refused and got in later, with their country."""
    found = V.v006_rejected_then_accepted(records, limit=None)
    return with_remote_geo(found, geo).select("remote_addr", "remote_geo_country_code", "local_addr", "dstport", "rejects", "accepts", "first_reject", "last_accept")


def flow_sources(records: DataFrame, files: DataFrame) -> DataFrame:
    """D-17: flow logs with their files' figures and the number of interfaces that they saw."""
    seen = records.groupBy("flow_log_id").agg(F.count_distinct("interface_id").alias("interfaces_seen"))
    return flows.flow_sources(files).join(seen, "flow_log_id", "left")


def flow_staging(records: DataFrame) -> DataFrame:
    """D-18: hosts that took data in from inside and sent data out later."""
    return V.v013_staging(records, limit=None)

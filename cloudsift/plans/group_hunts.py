"""Grouped, windowed and staged hunts over the audit trail."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.operators import combine as C
from cloudsift.operators import group as G
from cloudsift.operators import shape as S

# Services and actions of the hunts.
DENIED = ["AccessDenied", "AccessDeniedException", "UnauthorizedAccess"]
MARKERS = ["PRIVATE", "LOOPBACK", "LINK-LOCAL", "SPECIAL"]
INVOKE = ["InvokeModel", "InvokeModelWithResponseStream", "Converse", "ConverseStream"]
GLOBAL_SERVICES = ["iam", "sts", "signin", "organizations", "cloudfront", "route53"]
READS = ["GetObject", "SelectObjectContent", "CopyObject", "ListObjects", "ListObjectsV2"]
RECOVERY = ["DeleteBackupVault", "DeleteRecoveryPoint", "DeleteBackupPlan", "DeleteDBSnapshot", "DeleteDBClusterSnapshot", "DeleteSnapshot", "DeregisterImage"]
PROTECTION = ["DeleteBucketLifecycle", "PutBucketLogging", "DeleteBackupVaultLockConfiguration"]
IMPACT = ["DeleteObject", "DeleteObjects", "ScheduleKeyDeletion", "DisableKey", "ReEncrypt", "Encrypt", "TerminateInstances"]
ENUMERATE = ["ListBuckets", "ListObjects", "ListObjectsV2", "GetBucketAcl", "GetBucketPolicy", "GetBucketVersioning", "GetBucketLocation", "GetBucketEncryption", "GetBucketLogging", "GetBucketReplication"]
MODEL_RECON = ["ListFoundationModels", "GetFoundationModelAvailability", "ListProvisionedModelThroughputs", "ListInferenceProfiles", "GetUseCaseForModelAccess", "ListFoundationModelAgreementOffers"]
VAULT = ["GetWorkloadAccessToken", "GetWorkloadAccessTokenForJWT", "GetWorkloadAccessTokenForUserId", "GetResourceOauth2Token", "GetResourceApiKey", "CreateWorkloadIdentity", "DeleteWorkloadIdentity", "SetTokenVaultCMK", "CreateApiKeyCredentialProvider", "CreateOauth2CredentialProvider"]
PRESIGNED = ["CreatePresignedNotebookInstanceUrl", "CreatePresignedDomainUrl", "CreatePresignedMlflowTrackingServerUrl"]
TOOLS = "pacu|boto|python|curl|wget"

ARN, IP = "user_identity_arn", "source_ip_address"


def source(*names: str) -> Column:
    """Events of some services."""
    return F.col("event_source").isin(*(f"{n}.amazonaws.com" for n in names))


def action(*names: str) -> Column:
    """Events of some actions."""
    return F.col("event_name").isin(*names)


def request(path: str) -> Column:
    """A request parameter."""
    return F.get_json_object("request_parameters", f"$.{path}")


def hour() -> Column:
    """The event's hour."""
    return F.date_trunc("hour", "event_time").alias("hour_bucket")


def calls(name: str) -> Column:
    """The number of events under a name."""
    return F.count("*").alias(name)


def distinct(c: Column | str, name: str) -> Column:
    """The number of different values under a name."""
    return F.count_distinct(c).alias(name)


def seen() -> list[Column]:
    """First and last event."""
    return [F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")]


def placed() -> Column:
    """Events from a country, not from a marked address."""
    return F.col("geo_country_code").isNotNull() & ~F.col("geo_country_code").isin(*MARKERS)


@dataclass(frozen=True)
class Grouped:
    """where, keys, aggregates, threshold, order and limit; columns are made when the hunt runs."""

    severity: str
    where: Callable[[], Column]
    keys: Callable[[], Sequence[Column | str]]
    aggs: Callable[[], Sequence[Column]]
    order: Sequence[str]
    limit: int
    having: Callable[[], Column] | None = None
    rising: bool = False

    def run(self, events: DataFrame, whole: bool = False) -> DataFrame:
        """The first `limit` groups in order, or all in none; ties go by all other columns of the key."""
        found = events.filter(self.where()).groupBy(*self.keys()).agg(*self.aggs())
        found = found.filter(self.having()) if self.having else found
        first = [F.col(c).asc_nulls_last() if self.rising else F.col(c).desc_nulls_last() for c in self.order]
        rest = [F.col(c).asc_nulls_last() for c, kind in found.dtypes if c not in self.order and not kind.startswith(("array", "map"))]
        return G.top(found, G.ANY_ORDER if whole else self.limit, *first, *rest)


HUNTS: dict[str, Grouped] = {
    "H013": Grouped("P3", lambda: F.col("error_code").isin(*DENIED), lambda: [ARN, "event_name", "event_source"], lambda: [calls("denied_count"), F.count("vpc_endpoint_id").alias("via_vpc_endpoint"), G.joined("vpc_endpoint_id").alias("vpc_endpoints"), *seen()], ["denied_count"], 50),
    "H040": Grouped("P1", lambda: source("s3") & action("DeleteObject", "DeleteObjects"), lambda: [ARN, IP, hour()], lambda: [calls("delete_count"), distinct(request("bucketName"), "buckets_affected")], ["delete_count"], 50, lambda: F.col("delete_count") >= 50),
    "H045": Grouped("P2", lambda: source("s3") & action("GetObject", "SelectObjectContent"), lambda: [ARN, IP, hour()], lambda: [calls("call_count"), F.count_if(action("SelectObjectContent")).alias("s3_select_calls"), distinct(request("bucketName"), "distinct_buckets")], ["call_count"], 50, lambda: F.col("call_count") >= 100),
    "H046": Grouped("P1", lambda: source("secretsmanager") & action("GetSecretValue"), lambda: [ARN, IP, hour()], lambda: [calls("call_count"), distinct(request("secretId"), "distinct_secrets")], ["call_count"], 50, lambda: F.col("call_count") >= 10),
    "H048": Grouped("P2", lambda: source("ssm") & action("GetParameter", "GetParameters", "GetParametersByPath"), lambda: [ARN, IP, hour()], lambda: [calls("call_count"), distinct(request("name"), "distinct_params")], ["call_count"], 50, lambda: F.col("call_count") >= 20),
    "H061": Grouped("P2", lambda: source("sns", "sqs", "ses", "s3") & action("Publish", "SendMessage", "SendEmail", "PutObject"), lambda: [ARN, "event_source", "event_name", hour()], lambda: [calls("call_count")], ["call_count"], 50, lambda: F.col("call_count") >= 50),
    "H066": Grouped("P3", lambda: source("s3") & action(*ENUMERATE), lambda: [ARN, IP, hour()], lambda: [calls("enum_calls"), distinct(request("bucketName"), "buckets_touched")], ["enum_calls"], 50, lambda: F.col("enum_calls") >= 10),
    "H068": Grouped("P3", lambda: action(*PRESIGNED), lambda: [ARN, "event_name", "event_source"], lambda: [calls("urls_generated"), distinct(IP, "distinct_source_ips"), *seen()], ["urls_generated"], 100),
    "H070": Grouped("P2", lambda: source("s3") & action(*READS), lambda: [F.col(ARN).alias("principal"), F.to_date("event_time").alias("access_date")], lambda: [calls("read_calls"), distinct(request("bucketName"), "distinct_buckets"), F.approx_count_distinct(F.concat_ws("/", request("bucketName"), request("key"))).alias("approx_distinct_objects"), F.count_if(~F.col("recipient_account_id").eqNullSafe(F.col("user_identity_account_id"))).alias("cross_account_calls"), G.joined(request("bucketName")).alias("buckets"), *seen()], ["approx_distinct_objects"], 100),
    "H071": Grouped("P1", lambda: source("ec2") & action("TerminateInstances", "StopInstances"), lambda: [ARN, IP, "aws_region", hour()], lambda: [calls("instance_ops_count"), F.count_if(action("TerminateInstances")).alias("terminate_count"), F.count_if(action("StopInstances")).alias("stop_count")], ["instance_ops_count"], 50, lambda: F.col("instance_ops_count") >= 5),
    "H086": Grouped("P1", lambda: source("ec2") & action("DeregisterImage", "DeleteSnapshot"), lambda: [ARN, IP, hour()], lambda: [calls("delete_count"), distinct(F.coalesce(request("snapshotId"), request("imageId")), "distinct_items")], ["delete_count"], 50, lambda: F.col("delete_count") >= 5),
    "H087": Grouped("P3", lambda: source("bedrock") & action(*INVOKE), lambda: [ARN, hour(), request("modelId").alias("model_id")], lambda: [calls("invocation_count"), distinct(IP, "distinct_ips"), distinct("aws_region", "distinct_regions")], ["invocation_count"], 100, lambda: F.col("invocation_count") >= 50),
    "H090": Grouped("P3", lambda: source("bedrock") & action(*MODEL_RECON), lambda: [ARN, hour()], lambda: [calls("recon_calls"), distinct("aws_region", "distinct_regions"), G.joined("aws_region").alias("regions"), G.joined("event_name").alias("api_calls")], ["recon_calls"], 100, lambda: (F.col("recon_calls") >= 10) | (F.col("distinct_regions") >= 2)),
    "H091": Grouped("P3", lambda: source("bedrock") & action(*INVOKE) & F.col("error_code").isNotNull(), lambda: [ARN], lambda: [calls("failed_calls"), G.joined("error_code").alias("error_codes"), distinct(request("modelId"), "models_tried"), distinct("aws_region", "regions_tried"), *seen()], ["failed_calls"], 100, lambda: F.col("failed_calls") >= 5),
    "H096": Grouped("P1", lambda: source("bedrock-agentcore") & action(*VAULT), lambda: [ARN, IP, "event_name", request("workloadName").alias("workload_name")], lambda: [calls("token_requests"), distinct("aws_region", "distinct_regions"), *seen()], ["token_requests"], 100),
    "H115": Grouped("P3", lambda: action("GetCallerIdentity") & (F.col(IP) != "AWS Internal") & ~F.col(IP).endswith(".amazonaws.com"), lambda: [ARN, "user_identity_type", "user_identity_access_key_id", IP, "user_agent"], lambda: [calls("calls"), *seen()], ["first_seen"], 100),
    "H116": Grouped("P3", lambda: action("AssumeRole") & F.col("error_code").isNull() & request("roleArn").isNotNull(), lambda: [request("roleArn").alias("target_role_arn"), F.col("user_identity_account_id").alias("source_account")], lambda: [calls("assume_count"), distinct(ARN, "distinct_callers"), distinct(IP, "distinct_source_ips"), G.joined(IP).alias("source_ips"), *seen()], ["assume_count"], 100),
    "H118": Grouped("P2", lambda: F.col("user_identity_access_key_id").startswith("ASIA"), lambda: [F.col("user_identity_access_key_id").alias("session_key_id"), F.col(ARN).alias("session_arn"), F.col("session_issuer_arn").alias("issuing_role")], lambda: [calls("api_calls"), distinct("event_name", "distinct_apis"), distinct(IP, "distinct_source_ips"), distinct("aws_region", "distinct_regions"), G.joined("event_source").alias("services"), *seen()], ["api_calls"], 100),
    "H122": Grouped("P3", lambda: F.col("event_name").rlike("^(Describe|List|Get)"), lambda: [ARN, hour()], lambda: [distinct("event_name", "distinct_api_calls"), calls("total_calls")], ["distinct_api_calls"], 50, lambda: F.col("distinct_api_calls") >= 10),
    "H123": Grouped("P3", lambda: F.col("user_agent").isNotNull(), lambda: ["user_agent"], lambda: [calls("event_count"), distinct(ARN, "distinct_callers"), *seen()], ["event_count"], 100, lambda: (F.col("event_count") < 5) | F.lower("user_agent").rlike(TOOLS), rising=True),
    "H124": Grouped("P3", lambda: ~F.coalesce(F.col("read_only"), F.lit(False)) & F.col(ARN).isNotNull(), lambda: [ARN, F.to_date("event_time").alias("day")], lambda: [distinct("aws_region", "distinct_regions"), G.joined("aws_region").alias("regions")], ["distinct_regions"], 50, lambda: F.col("distinct_regions") >= 3),
    "H125": Grouped("P2", lambda: F.col(ARN).isNotNull() & F.col("aws_region").isNotNull() & ~source(*GLOBAL_SERVICES), lambda: [ARN, "event_name", "event_source", hour()], lambda: [distinct("aws_region", "distinct_regions"), G.joined("aws_region").alias("regions"), calls("call_count"), distinct(IP, "distinct_source_ips")], ["distinct_regions", "call_count"], 100, lambda: F.col("distinct_regions") >= 3),
    "H128": Grouped("P3", lambda: F.col("error_code").isNull() & F.col(ARN).isNotNull(), lambda: [ARN, "event_name", "event_source"], lambda: [calls("call_count"), distinct(IP, "distinct_source_ips"), *seen()], ["call_count"], 100, lambda: F.col("call_count") > 50),
    "H132": Grouped("P3", lambda: F.col(ARN).isNotNull() & ((F.hour("event_time") >= 22) | (F.hour("event_time") < 6)), lambda: [ARN, F.hour("event_time").alias("event_hour_utc")], lambda: [calls("calls"), F.count_if(~F.coalesce(F.col("read_only"), F.lit(False))).alias("write_calls"), distinct("event_name", "distinct_apis"), distinct(IP, "distinct_source_ips"), *seen()], ["calls"], 100),
    "H136": Grouped("P2", placed, lambda: ["geo_country_code", ARN, IP], lambda: [calls("event_count"), *seen()], ["event_count"], 100, lambda: F.col("event_count") < 10, rising=True),
    "H137": Grouped("P3", lambda: F.col("error_code").isin(*DENIED) & placed(), lambda: ["geo_country_code"], lambda: [calls("denied_count"), distinct(IP, "unique_ips"), distinct(ARN, "unique_identities"), *seen()], ["denied_count"], 20),
}


def h014_kill_chain(events: DataFrame, limit: int | None = 100) -> DataFrame:
    """Principals and days with recovery removed, protection disabled and impact."""
    stages = {
        "stage_recovery_removed": action(*RECOVERY),
        "stage_protection_disabled": (action("PutBucketVersioning") & F.col("request_parameters").contains("Suspended")) | action(*PROTECTION),
        "stage_impact": action(*IMPACT),
    }
    aggs = [calls("events"), G.joined("event_name").alias("observed_events"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")]
    found = G.stage_chain(events.filter(F.col(ARN).isNotNull()), [F.col(ARN).alias("principal"), F.to_date("event_time").alias("activity_date")], stages, 3, aggs)
    return G.top(found, limit, *S.latest("last_event"), "principal")


def h033_key_abuse(events: DataFrame, limit: int | None = 50) -> DataFrame:
    """Principals from several addresses in the data's last week."""
    recent = G.relative_window(events, "event_time", "7 DAYS").filter(F.col(ARN).isNotNull() & F.col(IP).isNotNull())
    found = recent.groupBy(ARN).agg(distinct(IP, "distinct_source_ips"), *seen(), calls("total_calls")).filter("distinct_source_ips >= 3")
    return G.top(found, limit, F.desc("distinct_source_ips"), ARN)


def h126_first_calls(events: DataFrame, limit: int | None = 100) -> DataFrame:
    """Actions first seen in the data's last day."""
    found = G.first_seen(events, ["event_source", "event_name"], "event_time", "24 HOURS", aggs=[distinct(ARN, "distinct_callers"), distinct(IP, "distinct_source_ips")])
    return G.top(found.withColumnRenamed("n", "call_count"), limit, F.desc("call_count"), "event_source", "event_name")


def h127_first_regions(events: DataFrame, limit: int | None = 50) -> DataFrame:
    """Regions first seen in the data's last day."""
    found = G.first_seen(events.filter("aws_region is not null"), ["aws_region"], "event_time", "24 HOURS", aggs=[distinct(ARN, "distinct_callers"), distinct("event_name", "distinct_events")])
    return G.top(found.withColumnRenamed("n", "event_count").drop("last_seen"), limit, *S.latest("first_seen"), "aws_region")


def h129_odd_regions(events: DataFrame, limit: int | None = 200) -> DataFrame:
    """Creations outside the regions that hold a twentieth of all events."""
    rare = C.rare_dimension_filter(events, "aws_region", 0.05)
    rows = rare.filter(F.col("event_name").startswith("Create") | action("RunInstances", "StartInstances"))
    return G.top(rows.select("event_time", ARN, "aws_region", "event_name", "event_source", request("instanceType").alias("instance_type"), IP, "geo_country_code", "error_code", "event_id"), limit, *S.latest("event_time"), "event_id")


def h130_daily_deviation(events: DataFrame, limit: int | None = 100) -> DataFrame:
    """A principal's days against its average day."""
    read = F.coalesce(F.col("read_only"), F.lit(False))
    days = events.filter(F.col(ARN).isNotNull()).groupBy(ARN, F.to_date("event_time").alias("day")).agg(calls("total_calls"), F.count_if(source("s3")).alias("s3_calls"), F.count_if(read).alias("read_calls"), F.count_if(~read).alias("write_calls"))
    found = G.baseline_ratio(days, [ARN], "total_calls").select(*days.columns, F.round("baseline", 1).alias("avg_daily_calls"), F.round("ratio", 2).alias("times_baseline"))
    return G.top(found, limit, F.desc("times_baseline"), F.desc("total_calls"), ARN, "day")


def h134_recent_errors(events: DataFrame, limit: int | None = 200) -> DataFrame:
    """Failed events of the data's last day, newest first."""
    rows = G.relative_window(events, "event_time", "24 HOURS").filter("error_code is not null")
    return G.top(rows, limit, *S.latest("event_time"), "event_id")


def h135_error_spikes(events: DataFrame, limit: int | None = 100) -> DataFrame:
    """Hours with three times the errors of their day's average hour."""
    hours = events.filter("error_code is not null").groupBy(hour()).agg(calls("error_count"), distinct(ARN, "distinct_callers"), distinct(IP, "distinct_ips"), G.joined("error_code", most=5).alias("error_codes"))
    found = G.baseline_ratio(hours.withColumn("day", F.to_date("hour_bucket")), ["day"], "error_count", 3).withColumns({"avg_hourly_errors": F.round("baseline", 1), "times_baseline": F.round("ratio", 2)}).drop("ratio", "baseline", "day")
    return G.top(found, limit, F.desc("times_baseline"), F.desc("error_count"), "hour_bucket")


#: id: (severity, function).
FUNCTIONS = {
    "H014": ("P1", h014_kill_chain), "H033": ("P2", h033_key_abuse), "H126": ("P3", h126_first_calls), "H127": ("P3", h127_first_regions), "H129": ("P3", h129_odd_regions), "H130": ("P3", h130_daily_deviation),
    "H134": ("P4", h134_recent_errors), "H135": ("P3", h135_error_spikes),
}


def run(key: str, events: DataFrame, whole: bool = False) -> DataFrame:
    """A hunt by its id; whole leaves out the report's limit and order."""
    if key in HUNTS:
        return HUNTS[key].run(events, whole)
    return FUNCTIONS[key][1](events, G.ANY_ORDER) if whole else FUNCTIONS[key][1](events)

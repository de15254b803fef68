"""Audit-trail JSON to one row for each event."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column, JSON path and type of the fields of an event; order is that of the table.
FIELDS = [
    ("event_time", "$.eventTime", "timestamp"),
    ("event_name", "$.eventName", "name"),
    ("event_source", "$.eventSource", "name"),
    ("aws_region", "$.awsRegion", "name"),
    ("source_ip_address", "$.sourceIPAddress", "string"),
    ("user_agent", "$.userAgent", "string"),
    ("user_identity_type", "$.userIdentity.type", "string"),
    ("user_identity_arn", "$.userIdentity.arn", "string"),
    ("user_identity_account_id", "$.userIdentity.accountId", "string"),
    ("user_identity_principal_id", "$.userIdentity.principalId", "string"),
    ("user_identity_access_key_id", "$.userIdentity.accessKeyId", "string"),
    ("user_identity_user_name", "$.userIdentity.userName", "string"),
    ("user_identity_invoked_by", "$.userIdentity.invokedBy", "string"),
    ("session_mfa_authenticated", "$.userIdentity.sessionContext.attributes.mfaAuthenticated", "string"),
    ("session_creation_date", "$.userIdentity.sessionContext.attributes.creationDate", "timestamp"),
    ("session_issuer_type", "$.userIdentity.sessionContext.sessionIssuer.type", "string"),
    ("session_issuer_arn", "$.userIdentity.sessionContext.sessionIssuer.arn", "string"),
    ("session_issuer_account_id", "$.userIdentity.sessionContext.sessionIssuer.accountId", "string"),
    ("session_issuer_user_name", "$.userIdentity.sessionContext.sessionIssuer.userName", "string"),
    ("session_issuer_principal_id", "$.userIdentity.sessionContext.sessionIssuer.principalId", "string"),
    ("request_parameters", "$.requestParameters", "string"),
    ("response_elements", "$.responseElements", "string"),
    ("error_code", "$.errorCode", "string"),
    ("error_message", "$.errorMessage", "string"),
    ("read_only", "$.readOnly", "boolean"),
    ("event_type", "$.eventType", "string"),
    ("recipient_account_id", "$.recipientAccountId", "string"),
    ("event_id", "$.eventID", "string"),
    ("event_category", "$.eventCategory", "string"),
    ("resources", "$.resources", "string"),
    ("additional_event_data", "$.additionalEventData", "string"),
    ("shared_event_id", "$.sharedEventID", "string"),
    ("vpc_endpoint_id", "$.vpcEndpointId", "string"),
    ("management_event", "$.managementEvent", "boolean"),
    ("tls_version", "$.tlsDetails.tlsVersion", "string"),
    ("tls_cipher_suite", "$.tlsDetails.cipherSuite", "string"),
    ("tls_client_host", "$.tlsDetails.clientProvidedHostHeader", "string"),
    ("service_event_details", "$.serviceEventDetails", "string"),
    ("session_credential_from_console", "$.sessionCredentialFromConsole", "boolean"),
    ("api_version", "$.apiVersion", "string"),
]

#: Keys of no use to a hunt, stripped from payloads on request: fixed values.
NOISE = (
    "maxResults", "MaxResults", "maxItems", "MaxItems", "nextToken", "NextToken", "marker", "Marker", "pageSize", "PageSize",
    "dryRun", "DryRun", "clientToken", "ClientToken", "clientRequestToken", "ClientRequestToken",
    "sessionToken", "SessionToken", "secretAccessKey", "SecretAccessKey",
    "eventCategoriesMapList", "reservedNodeOfferings", "sslPolicies", "orderableClusterOptions",
    "filterSet", "ownersSet", "Host", "host",
)


def schema() -> str:
    """FIELDS as one schema: all leaves are texts, which for objects and lists means their JSON."""
    root: dict = {}
    for _, path, _ in FIELDS:
        *parents, leaf = path.removeprefix("$.").split(".")
        node = root
        for name in parents:
            node = node.setdefault(name, {})
        node[leaf] = None
    ddl = lambda node: "struct<" + ", ".join(f"{k}: {ddl(v) if v else 'string'}" for k, v in node.items()) + ">"
    return ddl(root)


def typed(event: str, path: str, kind: str) -> Column:
    """A field of a parsed event; missing names are empty texts, flags may be texts."""
    value = F.col(path.replace("$", event, 1))
    if kind == "timestamp":
        return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))
    if kind == "boolean":
        return F.lower(value).try_cast("boolean")
    return F.coalesce(value, F.lit("")) if kind == "name" else value


def records(files: DataFrame) -> DataFrame:
    """(path, value) of whole files to (path, events): null events where the envelope is no JSON."""
    return files.select("path", F.from_json("value", "Records array<string>")["Records"].alias("events"))


def read_audit(spark: SparkSession, paths: str | list[str], keep_raw: bool = True) -> tuple[DataFrame, DataFrame]:
    """O-03, O-04, O-19: (events, errors): one row for each event of plain or gzip files; files that are no envelope are errors.

    A file is parsed once into its events, and an event once into its fields, whatever their number.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parsed(files, keep_raw)


def parsed(files: DataFrame, keep_raw: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of whole files (path, value)."""
    found = records(files)
    each = found.select(F.col("path").alias("source_file"), F.explode("events").alias("raw_event"))
    each = each.select("source_file", "raw_event", F.from_json("raw_event", schema()).alias("event"))
    rows = each.select(*(typed("event", path, kind).alias(name) for name, path, kind in FIELDS), "raw_event" if keep_raw else F.lit(None).cast("string").alias("raw_event"), "source_file")
    return rows.withColumn("event_date", F.to_date("event_time")), found.filter("events is null").select("path")


def strip_noise(keys: tuple[str, ...] = NOISE):
    """O-18: a column function that removes keys at any depth from JSON texts; other texts stay as they are.

    Nesting is unbounded, which no built-in function follows.
    """
    drop = frozenset(keys)

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in drop}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def one(text: str | None) -> str | None:
        if text is None or not any(f'"{k}"' in text for k in drop):
            return text
        try:
            return json.dumps(clean(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    @F.pandas_udf("string")
    def stripped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one, na_action="ignore")

    return stripped


def write_events(events: DataFrame, path: str) -> None:
    """O-20: a table in days, sorted by time within files so that row groups prune."""
    events.repartition("event_date", F.pmod(F.xxhash64("source_file"), F.lit(16))).sortWithinPartitions("event_date", "event_time").write.mode("append").partitionBy("event_date").parquet(path)

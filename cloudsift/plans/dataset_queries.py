"""The datasets and their metrics over logs that Spark derives from the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.plans import datasets as D
from cloudsift.plans.events import Query, T, events, text
from cloudsift.plans.hunts import AT, AT_TIME, FLOW_PARTS, RECORDS, flow_geo, flow_records
from cloudsift.plans.ingest import FILE_EVENTS, HUNTED, hunt_files
from cloudsift.sources import flows

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL; times come as text."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return put


def plain(df: DataFrame) -> DataFrame:
    """Times as text."""
    return df.select(*(text(c).alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in df.dtypes))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Quotients to some digits, as engines differ in the last."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as an audit trail with subscriptions to flow logs."""
    df, n = events(spark, sf_dir), F.col("event_id")
    kind = F.element_at(F.array(F.lit("CreateFlowLogs"), F.lit("DeleteFlowLogs"), F.lit("GetObject")), (n % 3 + 1).cast("int"))
    traffic = F.element_at(F.array(*(F.lit(x) for x in ("ALL", "ACCEPT", "REJECT", "NONE"))), (n % 4 + 1).cast("int"))
    request = F.format_string('{"trafficType": "%s", "ids": ["vpc-a%s", "subnet-%s"], "LogFormat":"v%s w"}', traffic, n, n, n % 5)
    return df.select(
        F.col("ts").alias("event_time"), kind.alias("event_name"), F.when(n % 5 == 0, "s3.amazonaws.com").otherwise("ec2.amazonaws.com").alias("event_source"), F.format_string("%012d", n % 9).alias("recipient_account_id"),
        F.concat(F.lit("r"), n % 7).alias("aws_region"), F.concat(F.lit("user/"), "user_id").alias("user_identity_arn"), F.when(F.col("event_type") == "error", "AccessDenied").when(F.col("event_type") == "view", "Throttled").alias("error_code"),
        (F.col("event_type") == "click").alias("read_only"), F.when(n % 11 != 0, request).alias("request_parameters"), F.when(n % 2 == 0, F.concat(F.lit('{"fl": "fl-0'), n, F.lit('"}'))).alias("response_elements"),
    )


AUDIT = f"""(SELECT event_id AS n, {T.format("ts")} AS event_time, list_extract(['CreateFlowLogs', 'DeleteFlowLogs', 'GetObject'], CAST(event_id % 3 + 1 AS BIGINT)) AS event_name, 'r' || (event_id % 7) AS region,
'user/' || user_id AS user_identity_arn, CASE event_type WHEN 'error' THEN 'AccessDenied' WHEN 'view' THEN 'Throttled' END AS error_code, event_type = 'click' AS read_only FROM events)"""


@query(f"SELECT event_name, {', '.join(f'{e} AS {n}' for n, e in D.METRICS['audit_events'].items())} FROM {AUDIT} GROUP BY event_name")
def d01_audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-01: the metrics of the audit table by action."""
    return D.metrics(D.audit_events(audit(spark, sf_dir)), "audit_events", ["event_name"])


@query(f"""SELECT event_time, event_name, lpad(CAST(n % 9 AS VARCHAR), 12, '0') AS account_id, region, user_identity_arn, CASE WHEN n % 2 = 0 THEN 'fl-0' || n END AS flow_log_id,
CASE WHEN n % 11 <> 0 AND n % 4 < 3 THEN list_extract(['ALL', 'ACCEPT', 'REJECT'], CAST(n % 4 + 1 AS BIGINT)) END AS traffic_type, CASE WHEN n % 11 <> 0 THEN 'vpc-a' || n || ', subnet-' || n END AS resource_ids,
CASE WHEN n % 11 <> 0 THEN 'v' || (n % 5) || ' w' END AS log_format, error_code FROM {AUDIT} WHERE n % 3 < 2 AND n % 5 <> 0""")
def d13_flow_log_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13, O-31: subscriptions to flow logs."""
    return D.flow_log_configs(audit(spark, sf_dir))


#: Actions of the event log as classes and outcomes of calls; what identities are seen with, by attribute.
ABUSED = "event_type IN ('error', 'signup')"
OUTCOME = "CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END"
HELD = {"SrcIP": "'10.0.0.' || (k % 30)", "UserAgent": "'cli/' || (event_id % 4)", "UserAccessKeyID": "'AKIA' || (user_id % 50)", "AwsRegion": "'r' || (k % 3)"}
ROWS = "(SELECT *, 'user/' || user_id AS arn, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
SPAN = f"count(*) AS n, {T.format('min(ts)')} AS first_seen, {T.format('max(ts)')} AS last_seen"
DAYS = "CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS active_days"


def detections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The event log as outputs of a detection tool: summary, calls, attributes, metrics, meta and timeline."""
    df = events(spark, sf_dir).withColumn("UserARN", F.concat(F.lit("user/"), "user_id"))
    seen = [F.count("*").alias("Count"), F.min("ts").alias("FirstSeen"), F.max("ts").alias("LastSeen")]
    held = df.select("UserARN", "ts", F.explode(F.create_map(*(x for a, e in HELD.items() for x in (F.lit(a), F.expr(e))))).alias("Attribute", "Value"))
    fields = df.select("ts", F.explode(F.create_map(F.lit("eventName"), F.col("event_type"), F.lit("k"), F.col("k").cast("string"))).alias("Field", "Value"))
    counts = fields.groupBy("Field", F.initcap("Field").alias("TimelineColumn"), "Value").agg(*seen)
    totals = fields.groupBy("Field").agg(F.count("*").alias("FieldTotal"))
    n = F.col("event_id")
    level = F.element_at(F.array(*(F.lit(x) for x in ("informational", "low", "medium", "high", "critical"))), (n % 5 + 1).cast("int"))
    other = F.when(n % 4 == 0, F.array(F.concat(F.lit("G000"), n % 10), F.lit("cve"))).when(n % 4 == 1, F.array().cast("array<string>"))
    return {
        "summary": df.groupBy("UserARN").agg(F.array(F.lit("IAMUser"), F.lit("Root")).alias("UserTypes"), F.count("*").alias("NumOfEvents"), F.min("ts").alias("FirstTimestamp"), F.max("ts").alias("LastTimestamp")),
        "calls": df.groupBy("UserARN", F.expr(ABUSED).alias("IsAbused"), F.expr(OUTCOME).alias("Outcome"), F.col("event_type").alias("API"), F.lit("s3.amazonaws.com").alias("EventSource"), F.concat(F.lit("why "), "event_type").alias("Description")).agg(*seen),
        "attributes": held.groupBy("UserARN", "Attribute", "Value").agg(*seen),
        "metrics": counts.join(totals, "Field").withColumns({"Percent": F.col("Count") * 100 / F.col("FieldTotal"), "SrcCountry": F.when(F.col("Field") == "k", "JP")}),
        "meta": df.agg(F.lit("count").alias("command"), F.max("ts").alias("generated_at"), F.count("*").alias("scanned_events"), F.count_distinct("user_id").alias("output_rows")),
        "timeline": df.select(
            F.col("ts").alias("Timestamp"), F.concat(F.lit("rule "), F.col("k") % 20).alias("RuleTitle"), F.concat(F.lit("id-"), F.col("k") % 20).alias("RuleID"), F.lit("someone").alias("RuleAuthor"), level.alias("Level"),
            F.col("event_type").alias("EventName"), F.when(F.col("event_type") == "error", "AccessDenied").alias("ErrorCode"), F.expr(HELD["SrcIP"]).alias("SrcIP"), "UserARN", n.cast("string").alias("EventID"),
            F.array(F.lit("Impact"), F.concat(F.lit("tactic "), n % 3)).alias("Tactics"), F.array(F.concat(F.lit("T"), F.col("k") % 9)).alias("TechniqueIDs"), other.alias("OtherTags"),
        ),
    }


NULLS = lambda *names: ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)
VALUES = "(SELECT 'eventName' AS field, event_type AS v, ts FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k'), ts FROM events)"
ATTRS = "(" + " UNION ALL ".join(f"SELECT arn, '{a}' AS attribute, {e} AS v, ts FROM {ROWS}" for a, e in HELD.items()) + ")"
LEVELS = "list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST(event_id % 5 + 1 AS BIGINT))"
OTHER = "CASE event_id % 4 WHEN 0 THEN ['G000' || (event_id % 10), 'cve'] WHEN 1 THEN CAST([] AS VARCHAR[]) END"
RULE = f"{T.format('ts')} AS event_time, 'rule ' || (k % 20) AS rule_title, 'id-' || (k % 20) AS rule_id, 'someone' AS rule_author, {LEVELS} AS level, CAST(event_id % 5 + 1 AS INTEGER) AS level_rank"
#: The statement of each dataset of detections.
STATEMENTS = {
    "detection_metrics": f"""SELECT field, CASE field WHEN 'k' THEN 'K' ELSE 'Eventname' END AS timeline_column, v AS value, count(*) AS occurrence_count, CAST(sum(count(*)) OVER (PARTITION BY field) AS BIGINT) AS field_total,
round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY field), 6) AS percent, {T.format('min(ts)')} AS first_seen, {T.format('max(ts)')} AS last_seen, {DAYS}, {NULLS('src_asn', 'src_city')}, CASE field WHEN 'k' THEN 'JP' END AS src_country FROM {VALUES} GROUP BY field, v""",
    "api_calls": f"SELECT arn AS user_arn, {ABUSED} AS is_abused, {OUTCOME} AS outcome, event_type AS api, 's3.amazonaws.com' AS event_source, 'why ' || event_type AS description, {SPAN.replace('AS n', 'AS call_count')} FROM {ROWS} GROUP BY 1, 2, 3, 4, 5, 6",
    "attributes": f"SELECT arn AS user_arn, attribute, v AS value, {SPAN.replace('AS n', 'AS occurrence_count')} FROM {ATTRS} GROUP BY 1, 2, 3",
    "identities": f"""SELECT arn AS user_arn, 'IAMUser, Root' AS user_types, {SPAN.replace('AS n', 'AS num_of_events')}, {DAYS}, count(*) FILTER ({ABUSED} AND event_id % 3 <> 0) AS abused_success, count(*) FILTER ({ABUSED} AND event_id % 3 = 0) AS abused_failed,
count(*) FILTER (NOT ({ABUSED}) AND event_id % 3 <> 0) AS other_success, count(*) FILTER (NOT ({ABUSED}) AND event_id % 3 = 0) AS other_failed, count(DISTINCT event_type) FILTER ({ABUSED}) AS abused_apis,
count(DISTINCT {HELD['SrcIP']}) AS distinct_src_ips, count(DISTINCT {HELD['UserAgent']}) AS distinct_user_agents, count(DISTINCT {HELD['UserAccessKeyID']}) AS distinct_access_keys, count(DISTINCT {HELD['AwsRegion']}) AS distinct_regions FROM {ROWS} GROUP BY arn""",
    "timeline": f"""SELECT {RULE}, event_type AS event_name, CASE event_type WHEN 'error' THEN 'AccessDenied' END AS error_code, {HELD['SrcIP']} AS src_ip, arn AS user_arn, CAST(event_id AS VARCHAR) AS event_id,
{NULLS('event_source', 'aws_region', 'error_message', 'user_agent', 'user_name', 'user_type', 'user_account_id', 'user_principal_id', 'user_access_key_id')},
CASE event_type WHEN 'error' THEN 'Failed' ELSE 'Success' END AS outcome, 'Impact, tactic ' || (event_id % 3) AS tactics, 'T' || (k % 9) AS technique_ids, array_to_string({OTHER}, ', ') AS other_tags FROM {ROWS}""",
    "timeline_tags": f"""SELECT {RULE}, event_type AS event_name, arn AS user_arn, CAST(event_id AS VARCHAR) AS event_id, {NULLS('user_name', 'user_account_id')}, tag_type, tag_value FROM (
SELECT *, 'tactic' AS tag_type, unnest(['Impact', 'tactic ' || (event_id % 3)]) AS tag_value FROM {ROWS} UNION ALL SELECT *, 'technique', 'T' || (k % 9) FROM {ROWS}
UNION ALL SELECT *, 'group', 'G000' || (event_id % 10) FROM {ROWS} WHERE event_id % 4 = 0 UNION ALL SELECT *, 'other', 'cve' FROM {ROWS} WHERE event_id % 4 = 0)""",
}


def detection_dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dataset of detections by its name."""
    made = detections(spark, sf_dir)
    build = {
        "detection_metrics": lambda: rounded(D.detection_metrics(made["metrics"]), percent=6), "api_calls": lambda: D.api_calls(made["calls"]), "attributes": lambda: D.attributes(made["attributes"]),
        "identities": lambda: D.identities(made["summary"], made["calls"], made["attributes"]), "timeline": lambda: D.timeline(made["timeline"]), "timeline_tags": lambda: D.timeline_tags(made["timeline"]),
    }
    return build[name]()


def register_detections() -> None:
    """One query for each dataset of detections, and for the run facts of each of the three outputs."""
    for number, name in ((2, "detection_metrics"), (4, "api_calls"), (5, "attributes"), (6, "identities"), (8, "timeline"), (10, "timeline_tags")):
        QUERIES[f"d{number:02}_{name}"] = lambda spark, sf_dir, name=name: plain(detection_dataset(spark, sf_dir, name))
        SQL[f"d{number:02}_{name}"] = STATEMENTS[name]
    for number, path in ((3, "metrics"), (7, "summary"), (9, "timeline")):
        QUERIES[f"d{number:02}_{path}_provenance"] = lambda spark, sf_dir, path=path: plain(D.provenance(detections(spark, sf_dir)["meta"], path))
        SQL[f"d{number:02}_{path}_provenance"] = f"SELECT 'count' AS command, {T.format('max(ts)')} AS generated_at, count(*) AS scanned_events, count(DISTINCT user_id) AS output_rows, '{path}' AS source_file FROM events"


register_detections()


@query(" UNION ALL ".join(f"SELECT '{name}' AS dataset, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM ({STATEMENTS[name]})" for name in STATEMENTS for m, e in D.METRICS[name].items()))
def dataset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-02 to D-10: all metrics of the datasets of detections."""
    out = None
    for name in STATEMENTS:
        row = D.metrics(detection_dataset(spark, sf_dir, name), name)
        own = row.select(F.lit(name).alias("dataset"), F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in D.METRICS[name]))))
        out = own if out is None else out.unionByName(own)
    return out


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geography of all remote addresses."""
    return flow_geo(spark, sf_dir)


@query(f"""WITH {RECORDS} SELECT loc AS local_addr, {AT_TIME('day')} AS day, inst AS instance_id, CAST(b AS BIGINT) AS egress_bytes, peers AS remote_peers, quantile_cont(b, 0.5) OVER w AS baseline_bytes, count(*) OVER w AS baseline_days,
round(b / nullif(quantile_cont(b, 0.5) OVER w, 0), 6) AS ratio_to_baseline FROM daily WINDOW w AS (PARTITION BY loc ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def d11_flow_egress_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-11: daily egress and its baseline."""
    return rounded(D.flow_egress_daily(flow_records(spark, sf_dir)), ratio_to_baseline=6)


@query(f"""WITH {RECORDS} SELECT srcaddr AS flow_src, dstaddr AS flow_dst, dstport, {AT_TIME('min(t)')} AS first_seen, {AT_TIME('max(t)')} AS last_seen, count(*) AS observations, CAST(sum(vol) AS BIGINT) AS bytes_measured,
{AT_TIME('(SELECT min(t) FROM r)')} AS history_start, min(t) >= (SELECT min(t) FROM r) + INTERVAL 1 DAY AS is_new_pair FROM r WHERE status = 'OK' AND sscope = 'private' AND dscope = 'private' GROUP BY srcaddr, dstaddr, dstport""")
def d12_flow_internal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-12: internal pairs."""
    return D.flow_internal_pairs(flow_records(spark, sf_dir))


@query(f"""WITH {RECORDS}, seen AS (SELECT *, epoch(m) - epoch(lag(m) OVER (PARTITION BY loc, rem, dstport ORDER BY m, iface, pname)) AS gap FROM (SELECT loc, rem, dstport, pname, iface, date_trunc('minute', t) AS m, max(end_s - start_s) AS w, sum(bytes) AS b
FROM r WHERE way IS NOT NULL AND rscope = 'public' AND status = 'OK' AND dstport IS NOT NULL GROUP BY ALL)),
even AS (SELECT loc, rem, dstport, min(pname) AS pname, list(DISTINCT iface) AS ifaces, count(*) AS buckets, quantile_cont(gap, 0.5) AS period, min(m) AS a, max(m) AS q, max(w) AS w, stddev_pop(b) / nullif(avg(b), 0) AS cv FROM seen GROUP BY loc, rem, dstport),
kept AS (SELECT *, epoch(q) - epoch(a) AS span, CASE WHEN w > 60 THEN 600 ELSE 60 END AS least FROM even WHERE buckets >= 20 AND epoch(q) - epoch(a) >= 43200 AND period > CASE WHEN w > 60 THEN 600 ELSE 60 END),
off AS (SELECT loc, rem, dstport, quantile_cont(abs(gap - period), 0.5) / any_value(period) AS jitter FROM seen JOIN kept USING (loc, rem, dstport) GROUP BY loc, rem, dstport),
full_facts AS (SELECT kept.*, jitter, (SELECT count(*) FROM r WHERE status = 'SKIPDATA' AND list_contains(kept.ifaces, r.iface) AND r.t BETWEEN kept.a AND kept.q) AS skipped FROM kept JOIN off USING (loc, rem, dstport))
SELECT loc AS local_addr, rem AS remote_addr, dstport, pname AS protocol_name, array_to_string(list_sort(ifaces), ', ') AS interface_ids, {AT_TIME('a')} AS first_seen, {AT_TIME('q')} AS last_seen, round(span / 3600.0, 4) AS span_hours, buckets AS active_buckets,
period AS period_secs, least AS aggregation_window_secs, round(buckets / (span / period + 1), 6) AS active_bucket_ratio, round(jitter, 6) AS jitter, round(cv, 6) AS bytes_cv, skipped AS skipdata_overlaps,
CASE WHEN skipped = 0 AND jitter <= 0.1 THEN 'high' WHEN jitter <= 0.25 THEN 'medium' ELSE 'low' END AS confidence FROM full_facts""")
def d14_flow_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-14: peers met at even gaps."""
    return rounded(D.flow_periodicity(flow_records(spark, sf_dir)), span_hours=4, active_bucket_ratio=6, jitter=6, bytes_cv=6)


@query(f"""WITH {RECORDS} SELECT fl AS flow_log_id, {AT_TIME('t')} AS start_time, {AT_TIME('z')} AS end_time, CAST(end_s - start_s AS BIGINT) AS duration_secs, iface AS interface_id, inst AS instance_id, itype AS interface_type, srcaddr AS flow_src, dstaddr AS flow_dst, loc AS local_addr, rem AS remote_addr,
rscope AS remote_scope, dstport, pname AS protocol_name, vol AS bytes_measured, CASE path WHEN 8 THEN 'Internet gateway' END AS traffic_path_label, psrc AS pkt_src_aws_service, psrc IS NOT NULL AS aws_service_peer, itype IS NOT NULL AS via_middlebox,
CASE WHEN rscope IN ('private', 'link-local') THEN upper(rscope) ELSE n_name END AS remote_geo_country_code FROM r LEFT JOIN {AT.format('rem')} AND rscope = 'public'""")
def d15_flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-15: records with labels and places."""
    records = flow_records(spark, sf_dir)
    return D.flow_records(records, places(spark, sf_dir)).select(
        "flow_log_id", "start_time", "end_time", "duration_secs", "interface_id", "instance_id", "interface_type", "flow_src", "flow_dst", "local_addr", "remote_addr", "remote_scope", "dstport", "protocol_name",
        "bytes_measured", "traffic_path_label", "pkt_src_aws_service", "aws_service_peer", "via_middlebox", "remote_geo_country_code",
    )


@query(f"WITH {RECORDS} SELECT found.*, n_name AS remote_geo_country_code FROM ({FLOW_PARTS['V006']}) AS found LEFT JOIN {AT.format('remote_addr')}")
def d16_flow_reject_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-16: refused, then let in."""
    records = flow_records(spark, sf_dir)
    return D.flow_reject_accept(records, places(spark, sf_dir))


@query(f"""WITH {RECORDS}, all_rows AS (SELECT 'fl-' || (event_id // {FILE_EVENTS} % 4) AS fl, count(DISTINCT event_id // {FILE_EVENTS}) AS files FROM events GROUP BY 1)
SELECT fl AS flow_log_id, '123456789012' AS account_ids, 'us' AS regions, CAST(1 AS BIGINT) AS header_variants, '{' '.join(HUNTED)}' AS header, any_value(files) AS files, count(*) AS rows_total, count(*) AS rows_valid, CAST(0 AS BIGINT) AS rows_with_issues, CAST(0 AS BIGINT) AS rows_rejected,
count(*) FILTER (status = 'NODATA') AS nodata_rows, count(*) FILTER (status = 'SKIPDATA') AS skipdata_rows, {AT_TIME('min(t)')} AS first_observation, {AT_TIME('max(z)')} AS last_observation, count(DISTINCT iface) AS interfaces_seen FROM r JOIN all_rows USING (fl) GROUP BY fl""")
def d17_flow_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-17, O-28: flow logs with the figures of their files."""
    _, files, _ = flows.read_flows(spark, hunt_files(spark, sf_dir, blocks=1))
    # The derived files lie in folders that bear the file's name.
    name = F.concat(F.lit("/"), F.regexp_extract("source_file", r"file=([^/]+)/", 1), F.lit("_h.log"))
    named = files.drop("file_account", "file_region", "flow_log_id").select("*", *flows.flow_file_meta(name))
    return D.flow_sources(flow_records(spark, sf_dir), named)


@query(f"WITH {RECORDS} {FLOW_PARTS['V013']}")
def d18_flow_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-18: data taken in, then sent out."""
    return D.flow_staging(flow_records(spark, sf_dir))

"""Hunt catalogues over logs that Spark derives from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators.enrich import geo_lookup
from cloudsift.operators.group import ANY_ORDER
from cloudsift.plans import flow_hunts, group_hunts, row_hunts, timeline_hunts
from cloudsift.plans.events import Query, events, table, text
from cloudsift.plans.ingest import FILE_EVENTS, HUNTED, hunt_files, ranges
from cloudsift.sources import flows
from cloudsift.sources.scratch import cut, once

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as an audit trail whose actions run through those of the row hunts."""
    pairs = [(f"{h.sources[0]}.amazonaws.com" if h.sources else "app.amazonaws.com", a) for h in row_hunts.HUNTS.values() for a in h.actions]
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), (F.col("event_id") % len(pairs) + 1).cast("int"))
    null = lambda *names: {n: F.lit(None).cast("string") for n in names}
    return table(spark, sf_dir, "events").select("*", F.col("ts").alias("event_time"), pick(0).alias("event_source"), pick(1).alias("event_name")).withColumns({
        "event_id": F.col("event_id").cast("string"), "request_parameters": F.col("props"), "user_identity_arn": F.concat(F.lit("user/"), F.col("user_id").cast("string")),
        "user_identity_type": F.when(F.col("user_id") == 7, "Root").otherwise("IAMUser"), "error_code": F.when(F.col("event_type") == "error", "AccessDenied"), "read_only": F.col("event_type") == "view", "source_ip_address": F.concat(F.lit("10.0.0."), (F.col("user_id") % 5 + F.col("event_id") % 3).cast("string")), "aws_region": F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")),
        **null("additional_event_data", "user_agent", "session_credential_from_console", "user_identity_account_id", "recipient_account_id", "session_issuer_arn", "vpc_endpoint_id", "user_identity_access_key_id", "geo_country_code"),
    })


@query(None)
def o41_row_hunts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-37, O-41: hits of every row hunt in one pass."""
    return row_hunts.bulk(trail(spark, sf_dir))


#: Services and actions of the grouped hunts; the last one gets a new name in each burst.
BURST = "s3:DeleteObject s3:GetObject secretsmanager:GetSecretValue ssm:GetParameter sns:Publish s3:ListBuckets sagemaker:CreatePresignedDomainUrl ec2:TerminateInstances ec2:DeleteSnapshot bedrock:InvokeModel bedrock:ListFoundationModels bedrock-agentcore:GetResourceApiKey sts:GetCallerIdentity sts:AssumeRole s3:PutBucketLogging ec2:DescribeInstances iam:ListUsers s3:GetBucketAcl ec2:DescribeVolumes ec2:CreateVolume".split()
CASES = lambda values: "CASE c " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
#: An audit trail in bursts of 120 rounds, b, five hours apart, over c (an action) and h (a round); one principal in each even burst,
#: as many as events in each odd one, so that no threshold is met there. SQL that Spark and DuckDB share.
BURSTS = {
    "event_source": CASES([x.split(":")[0] + ".amazonaws.com" for x in BURST]),
    "event_name": f"CASE WHEN c = 19 THEN 'CreateVolume' || b ELSE {CASES([x.split(':')[1] for x in BURST])} END",
    "user_identity_arn": "CASE WHEN b % 2 = 0 THEN 'user/' || b ELSE 'user/' || b || '-' || c || '-' || h END",
    "user_identity_account_id": "'acct/' || (b % 3)", "recipient_account_id": "'0'", "user_identity_type": "'IAMUser'",
    "source_ip_address": "'10.0.' || (b % 250) || '.' || CASE WHEN c > 14 THEN h % 4 ELSE 9 END",
    "aws_region": "CASE WHEN c = 19 THEN 'z' || b WHEN c % 2 = 1 THEN 'r' || (h % 7) ELSE 'r0' END",
    "error_code": "CASE WHEN c = 9 AND h % 3 = 0 OR c < 10 AND h % 2 = 0 AND b % 5 = 2 THEN 'AccessDenied' END",
    "user_agent": "CASE WHEN h % 50 = 7 THEN 'boto3/' || (h % 3) WHEN h % 50 <> 8 THEN 'ua/' || b END",
    "user_identity_access_key_id": "CASE WHEN c % 2 = 0 THEN 'ASIA' ELSE 'AKIA' END || b",
    "geo_country_code": "CASE c WHEN 12 THEN 'JP' WHEN 9 THEN 'US' WHEN 10 THEN 'PRIVATE' END",
    "role": "CASE WHEN c = 13 AND h % 4 > 0 THEN 'role/' || (h % 9) END", "model": "CASE WHEN c = 9 THEN 'm' || (h % 2) END",
    "sec": "1704067200 + b * 18000 + h % 120 * 20",
}


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as an audit trail with groups over the thresholds of the grouped hunts and groups below them."""
    n = table(spark, sf_dir, "events").selectExpr("event_id AS n", f"event_id div {len(BURST)} AS h", f"event_id % {len(BURST)} AS c", f"event_id div {len(BURST)} div 120 AS b")
    own = n.selectExpr("n", "h", "c", "b", *(f"{e} AS {k}" for k, e in BURSTS.items()))
    request = F.to_json(F.struct(F.col("role").alias("roleArn"), F.col("model").alias("modelId"), F.concat(F.lit("b"), (F.col("h") % 5).cast("string")).alias("bucketName")))
    null = {c: F.lit(None).cast("string") for c in ("additional_event_data", "session_issuer_arn", "vpc_endpoint_id")}
    return own.withColumns({"event_time": F.timestamp_seconds("sec"), "event_id": F.col("n").cast("string"), "read_only": F.col("c") % 4 == 1, "request_parameters": request, **null}).drop("n", "h", "c", "b", "sec", "role", "model")


TRAIL = f"""n AS (SELECT event_id AS n, event_id // {len(BURST)} AS h, event_id % {len(BURST)} AS c, event_id // {len(BURST)} // 120 AS b FROM events),
y AS (SELECT n, c, h, {", ".join(f"{e} AS {k}" for k, e in BURSTS.items())} FROM n),
x AS (SELECT split_part(event_source, '.', 1) AS src, event_name AS act, user_identity_arn AS arn, user_identity_account_id AS acct, source_ip_address AS ip, aws_region AS reg, error_code AS err, user_agent AS ua, user_identity_access_key_id AS key, geo_country_code AS geo, role, model, n, 'b' || (h % 5) AS bucket, c % 4 = 1 AS ro, to_timestamp(sec) AT TIME ZONE 'UTC' AS t, date_trunc('hour', t) AS hr, date_trunc('day', t) AS day FROM y),
top AS (SELECT max(t) AS edge, count(*) AS total FROM x)"""
#: id: a statement whose rows the hunt must have.
GROUP_PARTS = {
    "H013": "SELECT 1 FROM x WHERE err = 'AccessDenied' GROUP BY arn, act, src",
    "H014": "SELECT 1 FROM x GROUP BY arn, day HAVING count(*) FILTER (act = 'DeleteSnapshot') > 0 AND count(*) FILTER (act = 'PutBucketLogging') > 0 AND count(*) FILTER (act IN ('DeleteObject', 'TerminateInstances')) > 0",
    "H033": "SELECT 1 FROM x, top WHERE t >= edge - INTERVAL 7 DAY GROUP BY arn HAVING count(DISTINCT ip) >= 3",
    "H040": "SELECT 1 FROM x WHERE act = 'DeleteObject' GROUP BY arn, ip, hr HAVING count(*) >= 50",
    "H045": "SELECT 1 FROM x WHERE act = 'GetObject' GROUP BY arn, ip, hr HAVING count(*) >= 100",
    "H046": "SELECT 1 FROM x WHERE act = 'GetSecretValue' GROUP BY arn, ip, hr HAVING count(*) >= 10",
    "H048": "SELECT 1 FROM x WHERE act = 'GetParameter' GROUP BY arn, ip, hr HAVING count(*) >= 20",
    "H061": "SELECT 1 FROM x WHERE act = 'Publish' GROUP BY arn, src, hr HAVING count(*) >= 50",
    "H066": "SELECT 1 FROM x WHERE src = 's3' AND act IN ('ListBuckets', 'GetBucketAcl') GROUP BY arn, ip, hr HAVING count(*) >= 10",
    "H068": "SELECT 1 FROM x WHERE act = 'CreatePresignedDomainUrl' GROUP BY arn",
    "H070": "SELECT 1 FROM x WHERE act = 'GetObject' GROUP BY arn, day",
    "H071": "SELECT 1 FROM x WHERE act = 'TerminateInstances' GROUP BY arn, ip, reg, hr HAVING count(*) >= 5",
    "H086": "SELECT 1 FROM x WHERE act = 'DeleteSnapshot' GROUP BY arn, ip, hr HAVING count(*) >= 5",
    "H087": "SELECT 1 FROM x WHERE act = 'InvokeModel' GROUP BY arn, hr, model HAVING count(*) >= 50",
    "H090": "SELECT 1 FROM x WHERE act = 'ListFoundationModels' GROUP BY arn, hr HAVING count(*) >= 10 OR count(DISTINCT reg) >= 2",
    "H091": "SELECT 1 FROM x WHERE act = 'InvokeModel' AND err IS NOT NULL GROUP BY arn HAVING count(*) >= 5",
    "H096": "SELECT 1 FROM x WHERE act = 'GetResourceApiKey' GROUP BY arn, ip",
    "H115": "SELECT 1 FROM x WHERE act = 'GetCallerIdentity' GROUP BY arn, key, ip, ua",
    "H116": "SELECT 1 FROM x WHERE act = 'AssumeRole' AND err IS NULL AND role IS NOT NULL GROUP BY role, acct",
    "H118": "SELECT 1 FROM x WHERE key LIKE 'ASIA%' GROUP BY key, arn",
    "H122": "SELECT 1 FROM x WHERE regexp_matches(act, '^(Describe|List|Get)') GROUP BY arn, hr HAVING count(DISTINCT act) >= 10",
    "H123": "SELECT 1 FROM x WHERE ua IS NOT NULL GROUP BY ua HAVING count(*) < 5 OR ua LIKE '%boto%'",
    "H124": "SELECT 1 FROM x WHERE NOT ro GROUP BY arn, day HAVING count(DISTINCT reg) >= 3",
    "H125": "SELECT 1 FROM x WHERE src NOT IN ('iam', 'sts') GROUP BY arn, act, src, hr HAVING count(DISTINCT reg) >= 3",
    "H126": "SELECT 1 FROM x, top GROUP BY src, act, edge HAVING min(t) >= edge - INTERVAL 24 HOUR",
    "H127": "SELECT 1 FROM x, top GROUP BY reg, edge HAVING min(t) >= edge - INTERVAL 24 HOUR",
    "H128": "SELECT 1 FROM x WHERE err IS NULL GROUP BY arn, act, src HAVING count(*) > 50",
    "H129": "SELECT 1 FROM x WHERE act LIKE 'Create%' AND reg NOT IN (SELECT reg FROM x, top GROUP BY reg, total HAVING count(*) >= 0.05 * total)",
    "H130": "SELECT 1 FROM x GROUP BY arn, day",
    "H132": "SELECT 1 FROM x WHERE hour(t) >= 22 OR hour(t) < 6 GROUP BY arn, hr - day",
    "H134": "SELECT 1 FROM x, top WHERE err IS NOT NULL AND t >= edge - INTERVAL 24 HOUR",
    "H135": "SELECT 1 FROM (SELECT n, avg(n) OVER (PARTITION BY day) AS a FROM (SELECT hr, day, count(*) AS n FROM x WHERE err IS NOT NULL GROUP BY hr, day)) WHERE n / a >= 3",
    "H136": "SELECT 1 FROM x WHERE geo <> 'PRIVATE' GROUP BY geo, arn, ip HAVING count(*) < 10",
    "H137": "SELECT 1 FROM x WHERE geo <> 'PRIVATE' AND err = 'AccessDenied' GROUP BY geo",
}


def counts(parts: dict[str, str]) -> str:
    """Statements as their numbers of rows."""
    return " UNION ALL ".join(f"SELECT '{k}' AS label, count(*) AS hits FROM ({q})" for k, q in parts.items())


@query(f"WITH {TRAIL.replace(' div ', ' // ')} {counts(GROUP_PARTS)}")
def group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H013 to H137: all rows of every grouped hunt, beyond its report's limit."""
    df, out = cut(bursts(spark, sf_dir), "trail"), None
    for key in sorted({**group_hunts.HUNTS, **group_hunts.FUNCTIONS}):
        own = group_hunts.run(key, df, whole=True).agg(F.lit(key).alias("label"), F.count("*").alias("hits"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 'user/' || user_id AS user_identity_arn FROM events WHERE user_id = 7 ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 100")
def h015_root_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H015: the newest rows of the root identity (a top-k report)."""
    return row_hunts.HUNTS["H015"].run(trail(spark, sf_dir)).select("event_id", "user_identity_arn")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a detection timeline."""
    df, n = events(spark, sf_dir), F.col("event_id")
    level = F.element_at(F.array(*(F.lit(x) for x in ("informational", "low", "medium", "high", "critical"))), (n % 5 + 1).cast("int"))
    return df.select(
        F.col("ts").alias("Timestamp"), F.concat(F.lit("rule "), (F.col("k") % 20).cast("string")).alias("RuleTitle"), level.alias("Level"), F.concat(F.lit("action "), (F.col("k") % 10).cast("string")).alias("EventName"), F.when(F.col("event_type") == "error", "AccessDenied").alias("ErrorCode"),
        F.concat(F.lit("10.0.0."), (F.col("k") % 30).cast("string")).alias("SrcIP"), F.concat(F.lit("cli/"), (n % 4).cast("string")).alias("UserAgent"), F.lit("IAMUser").alias("UserType"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("UserARN"),
        F.concat(F.when(n % 2 == 0, "AKIA").otherwise("ASIA"), F.col("user_id").cast("string")).alias("UserAccessKeyID"), n.cast("string").alias("EventID"), F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("AwsRegion"),
        F.array(F.element_at(F.array(*(F.lit(x) for x in ("Impact", "CredAccess", "Exfil", "Discovery"))), (n % 4 + 1).cast("int"))).alias("Tactics"), F.array(F.concat(F.lit("T"), (F.col("k") % 9).cast("string"))).alias("TechniqueIDs"), F.array().cast("array<string>").alias("OtherTags"),
    )


LINE = """(SELECT ts, 'rule ' || (k % 20) AS rule, event_id % 5 >= 3 AS severe, event_type, 'user/' || user_id AS arn, '10.0.0.' || (k % 30) AS ip, event_id, (CASE WHEN event_id % 2 = 0 THEN 'AKIA' ELSE 'ASIA' END) || user_id AS key,
list_extract(['Impact', 'CredAccess', 'Exfil', 'Discovery'], CAST(event_id % 4 + 1 AS BIGINT)) AS tactic, 'action ' || (k % 10) AS act FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS detections, count(*) FILTER (severe) AS severe, count(DISTINCT arn) AS principals, count(DISTINCT rule) AS rules, count(DISTINCT ip) AS source_ips FROM {LINE} GROUP BY date_trunc('hour', ts) ORDER BY detections DESC, severe DESC, hour LIMIT 100")
def t004_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T004: detections by hour, the largest first (a top-k report)."""
    return timeline_hunts.run("T004", timeline(spark, sf_dir)).withColumn("hour", text("hour"))


@query(f"SELECT arn AS \"UserARN\", count(DISTINCT tactic) AS tactics, array_to_string(list_sort(list(DISTINCT tactic)), ', ') AS tactic_spread, count(*) AS detections, count(*) FILTER (severe) AS severe FROM {LINE} GROUP BY arn HAVING count(DISTINCT tactic) >= 3 ORDER BY tactics DESC, severe DESC, arn LIMIT 100")
def t011_kill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T011: principals over several tactics (a top-k report)."""
    return timeline_hunts.run("T011", timeline(spark, sf_dir)).select("UserARN", "tactics", "tactic_spread", "detections", "severe")


@query(f"""SELECT "UserAccessKeyID", key_type, detections, severe, place FROM (SELECT key AS "UserAccessKeyID", CASE WHEN key LIKE 'ASIA%' THEN 'temporary' ELSE 'long-lived' END AS key_type, count(*) AS detections, count(*) FILTER (severe) AS severe,
row_number() OVER (PARTITION BY CASE WHEN key LIKE 'ASIA%' THEN 'temporary' ELSE 'long-lived' END ORDER BY count(*) FILTER (severe) DESC, count(*) DESC, key) AS place FROM {LINE} GROUP BY key) WHERE place <= 50""")
def t013_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T013: the worst access keys of each kind (a top-k report)."""
    return timeline_hunts.run("T013", timeline(spark, sf_dir)).select("UserAccessKeyID", "key_type", "detections", "severe", "place")


@query(f"""WITH d AS (SELECT arn, act, count(*) AS denials, min(ts) AS a FROM {LINE} WHERE event_type = 'error' GROUP BY ALL), w AS (SELECT arn, act, min(ts) AS b FROM {LINE} WHERE event_type <> 'error' GROUP BY ALL)
SELECT d.arn AS "UserARN", d.act AS "EventName", denials, date_diff('minute', a, b) AS minutes FROM d JOIN w ON d.arn = w.arn AND d.act = w.act WHERE b > a ORDER BY minutes, denials DESC, "UserARN", "EventName" LIMIT 100""")
def t021_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T021: actions denied and done later (a top-k report)."""
    return timeline_hunts.run("T021", timeline(spark, sf_dir)).select("UserARN", "EventName", "denials", "minutes")


@query(f"""WITH s AS (SELECT DISTINCT arn, date_trunc('hour', ts) AS h, rule FROM {LINE})
SELECT a.rule AS item_a, b.rule AS item_b, count(*) AS together, count(DISTINCT a.arn) AS principals FROM s a JOIN s b ON a.arn = b.arn AND a.h = b.h AND a.rule < b.rule GROUP BY ALL ORDER BY together DESC, item_a, item_b LIMIT 100""")
def t030_rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T030: rules that fire together (a top-k report)."""
    return timeline_hunts.run("T030", timeline(spark, sf_dir)).select("item_a", "item_b", "together", "principals")


#: T001 to T030 over the same rows: lines with the columns that LINE leaves out.
LINES = """l AS (SELECT *, 'rule ' || (k % 20) AS rule, event_id % 5 AS lv, event_id % 5 >= 3 AS severe, 'user/' || user_id AS arn, '10.0.0.' || (k % 30) AS ip, (CASE WHEN event_id % 2 = 0 THEN 'AKIA' ELSE 'ASIA' END) || user_id AS key, event_id % 4 AS tactic,
'action ' || (k % 10) AS act, 'r' || (k % 3) AS reg, k % 9 AS tech, event_type = 'error' AS err, date_trunc('day', ts) AS day, date_trunc('hour', ts) AS hr FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
pairs AS (SELECT ip, arn FROM l GROUP BY ip, arn)"""
OFF = "hour(ts) < 6 OR hour(ts) >= 22 OR isodow(ts) >= 6"
LINE_PARTS = {
    "T001": "SELECT 1 FROM l WHERE severe", "T002": "SELECT 1 FROM l GROUP BY lv", "T003": "SELECT 1 FROM l GROUP BY day", "T004": "SELECT 1 FROM l GROUP BY hr", "T005": f"SELECT 1 FROM l WHERE {OFF} GROUP BY arn, hour(ts)", "T006": "SELECT 1 FROM l GROUP BY arn",
    "T007": "SELECT 1 FROM l GROUP BY rule, lv", "T008": "SELECT 1 FROM l GROUP BY rule, lv HAVING count(*) = 1", "T009": "SELECT 1 FROM l GROUP BY rule, lv", "T010": "SELECT 1 FROM l GROUP BY arn", "T011": "SELECT 1 FROM l GROUP BY arn HAVING count(DISTINCT tactic) >= 3", "T012": "SELECT 1 FROM l WHERE arn LIKE '%:root' GROUP BY day, act, rule",
    "T013": "SELECT 1 FROM l GROUP BY key", "T014": "SELECT 1 FROM l WHERE arn IS NULL", "T015": "SELECT 1 FROM l GROUP BY ip", "T016": "SELECT 1 FROM pairs WHERE ip IN (SELECT ip FROM pairs GROUP BY ip HAVING count(*) > 1) OR arn IN (SELECT arn FROM pairs GROUP BY arn HAVING count(*) > 1)", "T017": "SELECT 1 FROM l GROUP BY ip", "T018": "SELECT 1 FROM (SELECT 'cli') WHERE EXISTS (FROM l)",
    "T019": "SELECT 1 FROM l GROUP BY day, arn HAVING count(DISTINCT reg) > 1", "T020": "SELECT 1 FROM l WHERE err GROUP BY arn", "T021": "SELECT 1 FROM l GROUP BY arn, act HAVING min(ts) FILTER (NOT err) > min(ts) FILTER (err)", "T022": "SELECT 1 FROM l WHERE err GROUP BY arn, hr HAVING count(*) >= 5", "T023": "SELECT 1 FROM l GROUP BY tech", "T024": "SELECT 1 FROM l GROUP BY tactic",
    "T025": "SELECT 1 FROM l GROUP BY rule, lv", "T026": "SELECT 1 FROM l WHERE tactic = 0", "T027": "SELECT 1 FROM l WHERE tactic = 1 GROUP BY key, arn", "T028": "SELECT 1 FROM l GROUP BY tactic", "T029": "SELECT DISTINCT unnest([ip, arn, key]) FROM l", "T030": "SELECT 1 FROM (SELECT DISTINCT arn, hr, rule FROM l) a JOIN (SELECT DISTINCT arn, hr, rule FROM l) b ON a.arn = b.arn AND a.hr = b.hr AND a.rule < b.rule GROUP BY a.rule, b.rule",
}


@query(f"WITH {LINES} {counts(LINE_PARTS)}")
def timeline_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T001 to T030: all rows of every timeline hunt, beyond its report's limit."""
    df, out = cut(timeline(spark, sf_dir), "timeline"), None
    for key in sorted({**timeline_hunts.HUNTS, **timeline_hunts.FUNCTIONS}):
        own = timeline_hunts.run(key, df, whole=True).agg(F.lit(key).alias("label"), F.count("*").alias("hits"))
        out = own if out is None else out.unionByName(own)
    return out


ONE, SPAN_SQL = lambda c: f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ', '), '')", "first_seen=min(t); last_seen=max(t)"
WHO, SERVICE = "user_identity_arn=arn", "event_source=src || '.amazonaws.com'"
AT_HOUR = f"{WHO}; source_ip_address=ip; hour_bucket=hr"
#: id: the columns of a grouped hunt as name=SQL, and where its rows come from. Estimated counts are left out.
GROUP_ROWS = {
    "H013": (f"{WHO}; event_name=act; {SERVICE}; denied_count=count(*); via_vpc_endpoint=0; vpc_endpoints=''; {SPAN_SQL}", "x WHERE err = 'AccessDenied' GROUP BY arn, act, src"),
    "H014": (f"principal=arn; activity_date=CAST(day AS DATE); stage_recovery_removed=max(CASE WHEN act = 'DeleteSnapshot' THEN 1 ELSE 0 END); stage_protection_disabled=max(CASE WHEN act = 'PutBucketLogging' THEN 1 ELSE 0 END); stage_impact=max(CASE WHEN act IN ('DeleteObject', 'TerminateInstances') THEN 1 ELSE 0 END); events=count(*); observed_events={ONE('act')}; first_event=min(t); last_event=max(t); stages=3", "x GROUP BY arn, day HAVING count(*) FILTER (act = 'DeleteSnapshot') > 0 AND count(*) FILTER (act = 'PutBucketLogging') > 0 AND count(*) FILTER (act IN ('DeleteObject', 'TerminateInstances')) > 0"),
    "H033": (f"{WHO}; distinct_source_ips=count(DISTINCT ip); {SPAN_SQL}; total_calls=count(*)", "x, top WHERE t >= edge - INTERVAL 7 DAY GROUP BY arn HAVING count(DISTINCT ip) >= 3"),
    "H040": (f"{AT_HOUR}; delete_count=count(*); buckets_affected=count(DISTINCT bucket)", "x WHERE act = 'DeleteObject' GROUP BY arn, ip, hr HAVING count(*) >= 50"),
    "H045": (f"{AT_HOUR}; call_count=count(*); s3_select_calls=0; distinct_buckets=count(DISTINCT bucket)", "x WHERE act = 'GetObject' GROUP BY arn, ip, hr HAVING count(*) >= 100"),
    "H046": (f"{AT_HOUR}; call_count=count(*); distinct_secrets=0", "x WHERE act = 'GetSecretValue' GROUP BY arn, ip, hr HAVING count(*) >= 10"),
    "H048": (f"{AT_HOUR}; call_count=count(*); distinct_params=0", "x WHERE act = 'GetParameter' GROUP BY arn, ip, hr HAVING count(*) >= 20"),
    "H061": (f"{WHO}; {SERVICE}; event_name=act; hour_bucket=hr; call_count=count(*)", "x WHERE act = 'Publish' GROUP BY arn, src, act, hr HAVING count(*) >= 50"),
    "H066": (f"{AT_HOUR}; enum_calls=count(*); buckets_touched=count(DISTINCT bucket)", "x WHERE src = 's3' AND act IN ('ListBuckets', 'GetBucketAcl') GROUP BY arn, ip, hr HAVING count(*) >= 10"),
    "H068": (f"{WHO}; event_name=act; {SERVICE}; urls_generated=count(*); distinct_source_ips=count(DISTINCT ip); {SPAN_SQL}", "x WHERE act = 'CreatePresignedDomainUrl' GROUP BY arn, act, src"),
    "H070": (f"principal=arn; access_date=CAST(day AS DATE); read_calls=count(*); distinct_buckets=count(DISTINCT bucket); cross_account_calls=count(*) FILTER (acct <> '0'); buckets={ONE('bucket')}; {SPAN_SQL}", "x WHERE act = 'GetObject' GROUP BY arn, day"),
    "H071": (f"{WHO}; source_ip_address=ip; aws_region=reg; hour_bucket=hr; instance_ops_count=count(*); terminate_count=count(*); stop_count=0", "x WHERE act = 'TerminateInstances' GROUP BY arn, ip, reg, hr HAVING count(*) >= 5"),
    "H086": (f"{AT_HOUR}; delete_count=count(*); distinct_items=0", "x WHERE act = 'DeleteSnapshot' GROUP BY arn, ip, hr HAVING count(*) >= 5"),
    "H087": (f"{WHO}; hour_bucket=hr; model_id=model; invocation_count=count(*); distinct_ips=count(DISTINCT ip); distinct_regions=count(DISTINCT reg)", "x WHERE act = 'InvokeModel' GROUP BY arn, hr, model HAVING count(*) >= 50"),
    "H090": (f"{WHO}; hour_bucket=hr; recon_calls=count(*); distinct_regions=count(DISTINCT reg); regions={ONE('reg')}; api_calls={ONE('act')}", "x WHERE act = 'ListFoundationModels' GROUP BY arn, hr HAVING count(*) >= 10 OR count(DISTINCT reg) >= 2"),
    "H091": (f"{WHO}; failed_calls=count(*); error_codes={ONE('err')}; models_tried=count(DISTINCT model); regions_tried=count(DISTINCT reg); {SPAN_SQL}", "x WHERE act = 'InvokeModel' AND err IS NOT NULL GROUP BY arn HAVING count(*) >= 5"),
    "H096": (f"{WHO}; source_ip_address=ip; event_name=act; workload_name=NULL; token_requests=count(*); distinct_regions=count(DISTINCT reg); {SPAN_SQL}", "x WHERE act = 'GetResourceApiKey' GROUP BY arn, ip, act"),
    "H115": (f"{WHO}; user_identity_type='IAMUser'; user_identity_access_key_id=key; source_ip_address=ip; user_agent=ua; calls=count(*); {SPAN_SQL}", "x WHERE act = 'GetCallerIdentity' GROUP BY arn, key, ip, ua"),
    "H116": (f"target_role_arn=role; source_account=acct; assume_count=count(*); distinct_callers=count(DISTINCT arn); distinct_source_ips=count(DISTINCT ip); source_ips={ONE('ip')}; {SPAN_SQL}", "x WHERE act = 'AssumeRole' AND err IS NULL AND role IS NOT NULL GROUP BY role, acct"),
    "H118": (f"session_key_id=key; session_arn=arn; issuing_role=NULL; api_calls=count(*); distinct_apis=count(DISTINCT act); distinct_source_ips=count(DISTINCT ip); distinct_regions=count(DISTINCT reg); services={ONE("src || '.amazonaws.com'")}; {SPAN_SQL}", "x WHERE key LIKE 'ASIA%' GROUP BY key, arn"),
    "H122": (f"{WHO}; hour_bucket=hr; distinct_api_calls=count(DISTINCT act); total_calls=count(*)", "x WHERE regexp_matches(act, '^(Describe|List|Get)') GROUP BY arn, hr HAVING count(DISTINCT act) >= 10"),
    "H123": (f"user_agent=ua; event_count=count(*); distinct_callers=count(DISTINCT arn); {SPAN_SQL}", "x WHERE ua IS NOT NULL GROUP BY ua HAVING count(*) < 5 OR ua LIKE '%boto%'"),
    "H124": (f"{WHO}; day=CAST(day AS DATE); distinct_regions=count(DISTINCT reg); regions={ONE('reg')}", "x WHERE NOT ro GROUP BY arn, day HAVING count(DISTINCT reg) >= 3"),
    "H125": (f"{WHO}; event_name=act; {SERVICE}; hour_bucket=hr; distinct_regions=count(DISTINCT reg); regions={ONE('reg')}; call_count=count(*); distinct_source_ips=count(DISTINCT ip)", "x WHERE src NOT IN ('iam', 'sts') GROUP BY arn, act, src, hr HAVING count(DISTINCT reg) >= 3"),
    "H126": (f"{SERVICE}; event_name=act; {SPAN_SQL}; call_count=count(*); distinct_callers=count(DISTINCT arn); distinct_source_ips=count(DISTINCT ip)", "x, top GROUP BY src, act, edge HAVING min(t) >= edge - INTERVAL 24 HOUR"),
    "H127": ("aws_region=reg; first_seen=min(t); event_count=count(*); distinct_callers=count(DISTINCT arn); distinct_events=count(DISTINCT act)", "x, top GROUP BY reg, edge HAVING min(t) >= edge - INTERVAL 24 HOUR"),
    "H128": (f"{WHO}; event_name=act; {SERVICE}; call_count=count(*); distinct_source_ips=count(DISTINCT ip); {SPAN_SQL}", "x WHERE err IS NULL GROUP BY arn, act, src HAVING count(*) > 50"),
    "H129": (f"event_time=t; {WHO}; aws_region=reg; event_name=act; {SERVICE}; instance_type=NULL; source_ip_address=ip; geo_country_code=geo; error_code=err; event_id=n", "x WHERE act LIKE 'Create%' AND reg NOT IN (SELECT reg FROM x, top GROUP BY reg, total HAVING count(*) >= 0.05 * total)"),
    "H130": (f"{WHO}; day=CAST(day AS DATE); total_calls=n; s3_calls=s3; read_calls=r; write_calls=n - r; avg_daily_calls=round(a, 1); times_baseline=round(n / a, 2)", "(SELECT *, avg(n) OVER (PARTITION BY arn) AS a FROM (SELECT arn, day, count(*) AS n, count(*) FILTER (src = 's3') AS s3, count(*) FILTER (ro) AS r FROM x GROUP BY arn, day))"),
    "H132": (f"{WHO}; event_hour_utc=hour(t); calls=count(*); write_calls=count(*) FILTER (NOT ro); distinct_apis=count(DISTINCT act); distinct_source_ips=count(DISTINCT ip); {SPAN_SQL}", "x WHERE hour(t) >= 22 OR hour(t) < 6 GROUP BY arn, hour(t)"),
    "H134": (f"event_time=t; event_id=n; {WHO}; event_name=act; {SERVICE}; error_code=err; source_ip_address=ip; aws_region=reg", "x, top WHERE err IS NOT NULL AND t >= edge - INTERVAL 24 HOUR"),
    "H135": ("hour_bucket=hr; error_count=n; distinct_callers=w; distinct_ips=i; error_codes=e; avg_hourly_errors=round(a, 1); times_baseline=round(n / a, 2)", f"(SELECT *, avg(n) OVER (PARTITION BY day) AS a FROM (SELECT hr, day, count(*) AS n, count(DISTINCT arn) AS w, count(DISTINCT ip) AS i, {ONE('err')} AS e FROM x WHERE err IS NOT NULL GROUP BY hr, day)) WHERE n / a >= 3"),
    "H136": (f"geo_country_code=geo; {WHO}; source_ip_address=ip; event_count=count(*); {SPAN_SQL}", "x WHERE geo <> 'PRIVATE' GROUP BY geo, arn, ip HAVING count(*) < 10"),
    "H137": (f"geo_country_code=geo; denied_count=count(*); unique_ips=count(DISTINCT ip); unique_identities=count(DISTINCT arn); {SPAN_SQL}", "x WHERE geo <> 'PRIVATE' AND err = 'AccessDenied' GROUP BY geo"),
}


def row_statement(key: str, columns: str, source: str) -> str:
    """The rows of a hunt as one text each."""
    values = " || '|' || ".join(f"coalesce(CAST({c.split('=', 1)[1]} AS VARCHAR), '-')" for c in columns.split("; "))
    return f"SELECT '{key}' AS label, {values} AS hit FROM {source}"


def as_text(found: DataFrame, key: str, columns: str) -> DataFrame:
    """The rows of a hunt as one text each, by the columns that its statement names."""
    names = [c.split("=", 1)[0] for c in columns.split("; ")]
    return found.select(F.lit(key).alias("label"), F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names)).alias("hit"))


@query(f"WITH {TRAIL.replace(' div ', ' // ')} " + " UNION ALL ".join(row_statement(k, *v) for k, v in GROUP_ROWS.items()))
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H013 to H137: all rows of every grouped hunt, with all of their columns."""
    df, out = cut(bursts(spark, sf_dir), "trail"), None
    for key, (columns, _) in GROUP_ROWS.items():
        own = as_text(group_hunts.run(key, df, whole=True), key, columns)
        out = own if out is None else out.unionByName(own)
    return out


_TACTIC = "list_extract(['Impact', 'CredAccess', 'Exfil', 'Discovery'], CAST(tactic + 1 AS BIGINT))"
_LEVEL = "list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST(lv + 1 AS BIGINT))"
#: Keys and measures of the timeline hunts over LINES.
LINE_KEYS = {
    "Level": _LEVEL, "day": "day", "hour": "hr", "UserARN": "arn", "hour_of_day": "hour(ts)", "RuleTitle": "rule", "UserType": "'IAMUser'", "EventName": "act", "SrcIP": "ip", "agent_family": "'cli'", "ErrorCode": "CASE WHEN err THEN 'AccessDenied' END",
    "error_family": "CASE WHEN err THEN 'authorization' END", "technique": "'T' || tech", "tactic": _TACTIC, "UserAccessKeyID": "key",
}
LINE_MEASURES = {
    "detections": "count(*)", "severe": "count(*) FILTER (lv >= 3)", "medium": "count(*) FILTER (lv = 2)", "rules": "count(DISTINCT rule)", "rule_list": ONE("rule"), "principals": "count(DISTINCT arn)", "source_ips": "count(DISTINCT ip)", "distinct_events": "count(DISTINCT event_id)",
    "distinct_actions": "count(DISTINCT act)", "distinct_errors": "count(DISTINCT err) FILTER (err)", "regions": "count(DISTINCT reg)", "region_list": ONE("reg"), "variants": "count(DISTINCT event_id % 4)", "first_seen": "min(ts)", "last_seen": "max(ts)", "active_days": "count(DISTINCT day)",
    "max_rank": "max(lv) + 1", "failed": "count(*) FILTER (err)", "failures": "count(*)", "on_weekend": "count(*) FILTER (isodow(ts) >= 6)", "last_action": "arg_max(act, ts)", "last_user_agent": "arg_max('cli/' || (event_id % 4), ts)", "sample_event_id": "min(CAST(event_id AS VARCHAR))",
    "event_name": "min(act)", "user_arn": "min(arn)", "src_ip": "min(ip)", "tactics": "count(DISTINCT tactic)", "tactic_spread": ONE(_TACTIC), "techniques": ONE("'T' || tech"),
}
#: id: keys, measures, condition, condition on groups.
LINE_GROUPS = {
    "T002": ("Level", "max_rank detections distinct_events rules first_seen last_seen", "", ""), "T003": ("day", "detections severe medium principals", "", ""), "T004": ("hour", "detections severe principals rules source_ips", "", ""),
    "T005": ("UserARN hour_of_day", "detections severe on_weekend rules first_seen last_seen", OFF, ""), "T006": ("UserARN", "first_seen last_seen active_days detections severe rules", "", ""), "T007": ("RuleTitle Level", "detections principals source_ips first_seen last_seen", "", ""),
    "T008": ("RuleTitle Level", "detections max_rank first_seen event_name user_arn src_ip sample_event_id", "", "count(*) = 1"), "T009": ("RuleTitle Level", "first_seen last_seen detections", "", ""), "T010": ("UserARN UserType", "severe medium detections rules source_ips first_seen last_seen", "", ""),
    "T011": ("UserARN", "detections severe rules source_ips first_seen last_seen tactics tactic_spread", "", "count(DISTINCT tactic) >= 3"), "T012": ("day EventName RuleTitle", "max_rank detections failed source_ips regions sample_event_id", "arn LIKE '%:root'", ""),
    "T013": ("UserAccessKeyID", "user_arn detections severe source_ips rules first_seen last_seen", "", ""), "T015": ("SrcIP", "rules detections severe principals first_seen last_seen", "", ""), "T017": ("SrcIP", "first_seen last_seen detections severe principals rules", "", ""),
    "T018": ("agent_family", "detections severe variants principals source_ips last_user_agent", "", ""), "T019": ("day UserARN", "regions detections region_list", "", "count(DISTINCT reg) > 1"), "T020": ("ErrorCode error_family UserARN", "failures distinct_actions source_ips last_action first_seen last_seen", "err", ""),
    "T022": ("UserARN hour", "failures distinct_actions distinct_errors source_ips last_action", "err", "count(*) >= 5"), "T023": ("technique", "detections severe rules principals", "", ""), "T024": ("tactic", "detections severe rules principals", "", ""),
    "T025": ("RuleTitle Level", "detections techniques", "", ""), "T027": ("UserAccessKeyID UserARN", "detections rules rule_list max_rank first_seen last_seen", "tactic = 1", ""), "T028": ("tactic", "detections severe rules principals first_seen last_seen", "", ""),
}


def line_rows(keys: str, measures: str, where: str, having: str) -> tuple[str, str]:
    """Columns and source of a timeline hunt, as in GROUP_ROWS."""
    columns = [f"{k}={LINE_KEYS[k]}" for k in keys.split()] + [f"{m}={LINE_MEASURES[m]}" for m in measures.split()]
    by = ", ".join(dict.fromkeys(LINE_KEYS[k] for k in keys.split()))
    return "; ".join(columns), f"l {f'WHERE {where}' if where else ''} GROUP BY {by} {f'HAVING {having}' if having else ''}"


_EVENTS = f"Timestamp=ts; RuleTitle=rule; Level={_LEVEL}; EventName=act; ErrorCode=CASE WHEN err THEN 'AccessDenied' END; SrcIP=ip; UserARN=arn; UserAccessKeyID=key; EventID=event_id; AwsRegion=reg"
_PAIR = "SELECT ip, arn, count(*) AS n, count(*) FILTER (lv >= 3) AS s, count(DISTINCT rule) AS r, min(ts) AS a, max(ts) AS b FROM l GROUP BY ip, arn"
LINE_ROWS = {k: line_rows(*v) for k, v in LINE_GROUPS.items()} | {
    "T001": (_EVENTS, "l WHERE lv >= 3"), "T014": (_EVENTS, "l WHERE arn IS NULL"), "T026": (_EVENTS, "l WHERE tactic = 0"),
    "T016": ("SrcIP=ip; UserARN=arn; principals_on_ip=p; ips_for_principal=q; detections=n; severe=s; rules=r; first_seen=a; last_seen=b", f"(SELECT *, count(*) OVER (PARTITION BY ip) AS p, count(*) OVER (PARTITION BY arn) AS q FROM ({_PAIR})) WHERE p > 1 OR q > 1"),
    "T021": ("UserARN=arn; EventName=act; denials=n; first_denied=a; first_allowed=b; allowed_event=e; minutes=date_diff('minute', a, b)", "(SELECT arn, act, count(*) FILTER (err) AS n, min(ts) FILTER (err) AS a, min(ts) FILTER (NOT err) AS b, arg_min(event_id, ts) FILTER (NOT err) AS e FROM l GROUP BY arn, act) WHERE b > a"),
    "T029": ("type=y; value=v; detections=count(*); severe=count(*) FILTER (lv >= 3); rules=count(DISTINCT rule); first_seen=min(ts); last_seen=max(ts)", "(SELECT *, unnest(['source_ip', 'principal', 'access_key']) AS y, unnest([ip, arn, key]) AS v FROM l) GROUP BY y, v"),
    "T030": ("item_a=a.rule; item_b=b.rule; together=count(*); principals=count(DISTINCT a.arn)", "(SELECT DISTINCT arn, hr, rule FROM l) a JOIN (SELECT DISTINCT arn, hr, rule FROM l) b ON a.arn = b.arn AND a.hr = b.hr AND a.rule < b.rule GROUP BY a.rule, b.rule"),
}


@query(f"WITH {LINES} " + " UNION ALL ".join(row_statement(k, *v) for k, v in LINE_ROWS.items()))
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T001 to T030: all rows of every timeline hunt, with all of their columns."""
    df, out = cut(timeline(spark, sf_dir), "timeline"), None
    for key, (columns, _) in LINE_ROWS.items():
        own = as_text(timeline_hunts.run(key, df, whole=True), key, columns)
        out = own if out is None else out.unionByName(own)
    return out


#: The columns that name a row of each flow hunt, and its measure.
FLOW_ROWS = {
    "V001": ("flow_log_id", "records"), "V002": ("interface_id local_addresses", "skipdata_windows"), "V003": ("remote_addr local_addr rejected", "distinct_ports"), "V004": ("remote_addr dstport rejected", "distinct_targets"), "V005": ("remote_addr local_addr dstport country_code", "bytes"),
    "V006": ("remote_addr local_addr dstport rejects", "accepts"), "V007": ("local_addr day remote_peers", "egress_bytes"), "V008": ("local_addr remote_addr dstport protocol_name", "records"), "V009": ("local_addr remote_addr remote_scope protocol_name", "records"), "V010": ("local_addr mail_servers", "records"),
    "V011": ("local_addr remote_addr dstport active_buckets skipdata_overlaps confidence", "period_secs"), "V012": ("flow_src ports", "new_destinations"), "V013": ("host internal_in_bytes external_peers", "external_out_bytes"), "V014": ("flow_src flow_dst protocol_name", "records"), "V015": ("flow_src ports records", "external_destinations"),
    "V016": ("flow_src flow_dst protocol_name records", "bytes"), "V017": ("country_code ports sources", "records"), "V018": ("reject_reason interface_id flow_src flow_dst dstport", "records"),
}
BASE = {"start": "start_s", "end": "end_s", "interface-id": "iface", "log-status": "status", "tcp-flags": "flags", "flow-direction": "way", "reject-reason": "reason", "instance-id": "inst", "traffic-path": "path", "interface-type": "itype", "pkt-src-aws-service": "psrc"}
SCOPE = "CASE WHEN {0} LIKE '10.%' OR {0} LIKE '192.168.%' OR {0} LIKE 'fd00:%' THEN 'private' WHEN {0} LIKE '169.254.%' THEN 'link-local' WHEN {0} IS NOT NULL THEN 'public' END"
#: Records: loc and rem are the ends by the direction, else the only private side; t is the start and z the end.
RECORDS = f"""e AS (SELECT event_id AS n, event_id // 20 AS h, event_id % 20 AS c, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
f AS MATERIALIZED (SELECT 'fl-' || (n // {FILE_EVENTS} % 4) AS fl, {", ".join(f"{e.replace(' div ', ' // ')} AS {BASE.get(k, k)}" for k, e in HUNTED.items())} FROM e),
g AS MATERIALIZED (SELECT *, {SCOPE.format("srcaddr")} AS sscope, {SCOPE.format("dstaddr")} AS dscope, to_timestamp(start_s) AT TIME ZONE 'UTC' AS t, to_timestamp(end_s) AT TIME ZONE 'UTC' AS z FROM f),
k AS MATERIALIZED (SELECT *, CASE WHEN way = 'ingress' THEN false WHEN way = 'egress' THEN true WHEN srcaddr LIKE '%.%' AND dstaddr LIKE '%.%' AND (sscope = 'public') <> (dscope = 'public') THEN dscope = 'public' END AS outward FROM g),
r AS MATERIALIZED (SELECT *, CASE WHEN outward THEN srcaddr WHEN NOT outward THEN dstaddr END AS loc, CASE WHEN outward THEN dstaddr WHEN NOT outward THEN srcaddr END AS rem, CASE WHEN outward THEN sscope WHEN NOT outward THEN dscope END AS lscope, CASE WHEN outward THEN dscope WHEN NOT outward THEN sscope END AS rscope,
CASE WHEN coalesce(reason, '') <> 'BPA' THEN bytes END AS vol, CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 58 THEN 'ICMPv6' ELSE CAST(protocol AS VARCHAR) END AS pname FROM k),
i AS (SELECT * FROM r WHERE way = 'ingress' AND rscope = 'public'), o AS (SELECT * FROM r WHERE way = 'egress' AND rscope = 'public'),
beat AS (SELECT *, epoch(m) - epoch(lag(m) OVER (PARTITION BY loc, rem, dstport ORDER BY m, iface)) AS gap FROM (SELECT loc, rem, dstport, iface, date_trunc('minute', t) AS m, max(end_s - start_s) AS w FROM r WHERE way IS NOT NULL AND rscope = 'public' AND status = 'OK' GROUP BY ALL)),
per AS (SELECT loc, rem, dstport, list(DISTINCT iface) AS ifaces, count(*) AS buckets, quantile_cont(gap, 0.5) AS period, min(m) AS a, max(m) AS b, max(w) AS w FROM beat GROUP BY loc, rem, dstport),
per2 AS (SELECT * FROM per WHERE buckets >= 20 AND epoch(b) - epoch(a) >= 43200 AND period > CASE WHEN w > 60 THEN 600 ELSE 60 END),
jit AS (SELECT beat.loc, beat.rem, beat.dstport, quantile_cont(abs(gap - period), 0.5) / any_value(period) AS jitter FROM beat JOIN per2 ON beat.loc = per2.loc AND beat.rem = per2.rem AND beat.dstport IS NOT DISTINCT FROM per2.dstport GROUP BY ALL),
beacon AS (SELECT per2.*, jitter, (SELECT count(*) FROM r WHERE status = 'SKIPDATA' AND list_contains(per2.ifaces, r.iface) AND t BETWEEN a AND b) AS skipped FROM per2 JOIN jit ON jit.loc = per2.loc AND jit.rem = per2.rem AND jit.dstport IS NOT DISTINCT FROM per2.dstport),
daily AS (SELECT loc, date_trunc('day', t) AS day, max(inst) AS inst, sum(vol) AS b, count(DISTINCT rem) AS peers FROM o WHERE action = 'ACCEPT' GROUP BY loc, date_trunc('day', t)),
prior AS (SELECT *, quantile_cont(b, 0.5) OVER (PARTITION BY loc ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM daily),
pairs AS (SELECT srcaddr AS src, dstaddr AS dst, dstport, min(t) AS first FROM r WHERE status = 'OK' AND sscope = 'private' AND dscope = 'private' GROUP BY ALL),
ins AS (SELECT loc, sum(vol) AS b_in, min(t) AS a FROM r WHERE way = 'ingress' AND rscope = 'private' GROUP BY loc),
outs AS (SELECT loc, sum(vol) AS b_out, max(t) AS last, count(DISTINCT rem) AS peers FROM o WHERE action = 'ACCEPT' GROUP BY loc)"""
AT = "nation ON {0} NOT LIKE '%:%' AND CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT) BETWEEN n_nationkey * CAST(100000000 AS BIGINT) AND n_nationkey * CAST(100000000 AS BIGINT) + 69999999"
PORTS = "array_to_string(list_sort(list(DISTINCT dstport)), ', ')"
AT_TIME = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
SEEN = f"{AT_TIME('min(t)')} AS first_seen, {AT_TIME('max(z)')} AS last_seen"
PART = lambda held, name: f"round(avg(CASE WHEN status = 'OK' THEN CAST({held} AS INTEGER) END), 3) AS {name}_share"
#: id: the statement whose rows the hunt must have, without its report's limit.
FLOW_PARTS = {
    "V001": f"SELECT fl AS flow_log_id, count(*) FILTER (status = 'OK') AS records, count(*) FILTER (status = 'NODATA') AS nodata, count(*) FILTER (status = 'SKIPDATA') AS skipdata, {SEEN}, {PART('way IS NOT NULL', 'recorded_direction')}, {PART('false', 'packet_address')}, {PART('flags IS NOT NULL', 'tcp_flags')}, {PART('bytes IS NOT NULL', 'bytes')}, {PART('path IS NOT NULL', 'traffic_path')} FROM r GROUP BY fl",
    "V002": f"SELECT iface AS interface_id, local_addresses, skipdata_windows, first_gap, last_gap FROM (SELECT iface, count(*) AS skipdata_windows, {AT_TIME('min(t)')} AS first_gap, {AT_TIME('max(z)')} AS last_gap FROM r WHERE status = 'SKIPDATA' GROUP BY iface) LEFT JOIN (SELECT iface, array_to_string(list_sort(list(DISTINCT srcaddr)), ', ') AS local_addresses FROM r WHERE status = 'OK' AND sscope = 'private' GROUP BY iface) USING (iface)",
    "V003": f"SELECT rem AS remote_addr, loc AS local_addr, count(DISTINCT dstport) AS distinct_ports, count(*) FILTER (action = 'REJECT') AS rejected, count(*) FILTER (flags = 2) AS syn_only, {SEEN} FROM i GROUP BY rem, loc HAVING count(DISTINCT dstport) >= 20",
    "V004": f"SELECT rem AS remote_addr, dstport, count(DISTINCT loc) AS distinct_targets, count(*) FILTER (action = 'REJECT') AS rejected, {SEEN} FROM i GROUP BY rem, dstport HAVING count(DISTINCT loc) >= 10",
    "V005": f"SELECT rem AS remote_addr, n_name AS country_code, CAST(NULL AS VARCHAR) AS org, loc AS local_addr, dstport, count(*) AS records, max(flags) AS max_tcp_flags, CAST(sum(vol) AS BIGINT) AS bytes, {AT_TIME('min(t)')} AS first_seen FROM i LEFT JOIN {AT.format('rem')} WHERE action = 'ACCEPT' AND dstport IN (22, 3389, 5985, 5986, 3306, 5432, 1433, 6379, 9200, 27017, 2375, 10250) GROUP BY rem, loc, dstport, n_name",
    "V006": f"SELECT rem AS remote_addr, loc AS local_addr, dstport, count(*) FILTER (action = 'REJECT') AS rejects, count(*) FILTER (action = 'ACCEPT') AS accepts, {AT_TIME("min(t) FILTER (action = 'REJECT')")} AS first_reject, {AT_TIME("max(t) FILTER (action = 'ACCEPT')")} AS last_accept FROM i GROUP BY rem, loc, dstport HAVING max(t) FILTER (action = 'ACCEPT') > min(t) FILTER (action = 'REJECT')",
    "V007": f"SELECT loc AS local_addr, inst AS instance_id, {AT_TIME('day')} AS day, CAST(b AS BIGINT) AS egress_bytes, med AS baseline_bytes, round(b / med, 1) AS ratio_to_baseline, peers AS remote_peers FROM prior WHERE med > 0 AND b >= 10 * med",
    "V008": f"SELECT loc AS local_addr, rem AS remote_addr, dstport, pname AS protocol_name, count(*) AS records, {SEEN} FROM o WHERE action = 'ACCEPT' AND dstport IN (4444, 6667, 1337, 31337, 9001, 9030, 3333, 5555, 7777, 14444) GROUP BY loc, rem, dstport, pname",
    "V009": f"SELECT loc AS local_addr, rem AS remote_addr, rscope AS remote_scope, pname AS protocol_name, count(*) AS records, {SEEN} FROM r WHERE way = 'egress' AND dstport = 53 GROUP BY loc, rem, rscope, pname",
    "V010": f"SELECT loc AS local_addr, count(DISTINCT rem) AS mail_servers, count(*) AS records, {SEEN} FROM o WHERE action = 'ACCEPT' AND dstport IN (25, 465, 587) GROUP BY loc",
    "V011": "SELECT loc AS local_addr, rem AS remote_addr, dstport, period AS period_secs, buckets AS active_buckets, round(jitter, 3) AS jitter, skipped AS skipdata_overlaps, round((epoch(b) - epoch(a)) / 3600.0, 1) AS span_hours, CASE WHEN skipped = 0 AND jitter <= 0.1 THEN 'high' WHEN jitter <= 0.25 THEN 'medium' ELSE 'low' END AS confidence FROM beacon",
    "V012": f"SELECT src AS flow_src, count(DISTINCT dst) AS new_destinations, {PORTS} AS ports, {AT_TIME('min(first)')} AS first_seen FROM pairs WHERE first >= (SELECT min(t) FROM r) + INTERVAL 1 DAY AND dstport IN (22, 135, 139, 445, 3389, 5985, 5986) GROUP BY src",
    "V013": f"SELECT loc AS host, CAST(b_in AS BIGINT) AS internal_in_bytes, CAST(b_out AS BIGINT) AS external_out_bytes, {AT_TIME('a')} AS first_internal_in, {AT_TIME('last')} AS last_external_out, peers AS external_peers FROM ins JOIN outs USING (loc) WHERE last > a",
    "V014": f"SELECT srcaddr AS flow_src, dstaddr AS flow_dst, pname AS protocol_name, count(*) AS records, {AT_TIME('min(t)')} AS first_seen FROM r WHERE status = 'OK' AND protocol NOT IN (1, 6, 17, 58) GROUP BY srcaddr, dstaddr, pname",
    "V015": f"SELECT srcaddr AS flow_src, count(DISTINCT dstaddr) AS external_destinations, {PORTS} AS ports, count(*) AS records FROM r WHERE status = 'OK' AND protocol = 17 AND dscope = 'public' GROUP BY srcaddr HAVING count(DISTINCT dstaddr) >= 20",
    "V016": "SELECT srcaddr AS flow_src, dstaddr AS flow_dst, pname AS protocol_name, count(*) AS records, CAST(sum(vol) AS BIGINT) AS bytes FROM r WHERE status = 'OK' AND protocol IN (1, 58) GROUP BY srcaddr, dstaddr, pname",
    "V017": f"SELECT n_name AS country_code, CAST(NULL AS VARCHAR) AS country_name, count(*) AS records, count(DISTINCT rem) AS sources, {PORTS} AS ports FROM i JOIN {AT.format('rem')} WHERE action = 'ACCEPT' GROUP BY n_name",
    "V018": f"SELECT reason AS reject_reason, iface AS interface_id, srcaddr AS flow_src, dstaddr AS flow_dst, dstport, count(*) AS records, {AT_TIME('min(t)')} AS first_seen FROM r WHERE reason IS NOT NULL GROUP BY reason, iface, srcaddr, dstaddr, dstport",
}
NAMED = lambda columns: "array_to_string([" + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns.split()) + "], '|')"
FLOW_SQL = " UNION ALL ".join(f"SELECT '{k}' AS label, {NAMED(FLOW_ROWS[k][0])} AS name, CAST({FLOW_ROWS[k][1]} AS DOUBLE) AS measure FROM ({q})" for k, q in FLOW_PARTS.items())


def flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the hunts out of the table that their logs are ingested into, once."""

    def ingest(path: str) -> None:
        records, _, _ = flows.read_flows(spark, hunt_files(spark, sf_dir))
        # The derived files lie in folders that bear the file's name.
        flows.write_flows(records.withColumn("flow_log_id", F.regexp_extract("source_file", r"file=[^/]*_(fl-\d+)_", 1)), path)

    return spark.read.parquet(once(spark, "flow_table", sf_dir, ingest))


def flow_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geography of all remote addresses of the flow table, looked up once."""
    found = lambda path: geo_lookup(flow_records(spark, sf_dir).select(F.col("remote_addr").alias("ip")), ranges(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(once(spark, "flow_geo", sf_dir, found))


def flow_hunted(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """All rows of a flow hunt, without the report's limit; times as text."""
    df = flow_records(spark, sf_dir)
    hunt, wants_geo = flow_hunts.HUNTS[key][2:]
    if wants_geo:
        geo = flow_geo(spark, sf_dir).withColumn("org", F.lit(None).cast("string"))
        found = hunt(df, geo, limit=None)
    else:
        found = hunt(df, limit=None)
    return found.select(*(text(c).alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in found.dtypes))


def register_flow_hunts() -> None:
    """One query for each flow hunt, with SQL for all of its columns."""
    for key, (_, _, hunt, _) in flow_hunts.HUNTS.items():
        QUERIES[hunt.__name__] = lambda spark, sf_dir, key=key: flow_hunted(spark, sf_dir, key)
        SQL[hunt.__name__] = f"WITH {RECORDS} {FLOW_PARTS[key]}"


register_flow_hunts()


@query(f"WITH {RECORDS}, hit AS ({FLOW_SQL}) SELECT label, count(name) AS hits FROM (SELECT unnest({list(FLOW_PARTS)}) AS label) LEFT JOIN hit USING (label) GROUP BY label")
def flow_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V001 to V018: rows of every flow hunt."""
    return flow_union(spark, sf_dir, lambda key, found: found.agg(F.lit(key).alias("label"), F.count("*").alias("hits")))


@query(f"WITH {RECORDS} {FLOW_SQL}")
def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V001 to V018: the rows themselves, by the columns that name them and a measure."""

    def named(key: str, found: DataFrame) -> DataFrame:
        names, measure = FLOW_ROWS[key]
        return found.select(F.lit(key).alias("label"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names.split())).alias("name"), F.col(measure).cast("double").alias("measure"))

    return flow_union(spark, sf_dir, named)


def flow_union(spark: SparkSession, sf_dir: str, part: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Something of every flow hunt, over records that are written once for all of them."""
    df, out = flow_records(spark, sf_dir), None
    geo = flow_geo(spark, sf_dir).withColumn("org", F.lit(None).cast("string"))
    for key, (_, _, hunt, wants_geo) in flow_hunts.HUNTS.items():
        own = part(key, hunt(df, geo, limit=ANY_ORDER) if wants_geo else hunt(df, limit=ANY_ORDER))
        out = own if out is None else out.unionByName(own)
    return out

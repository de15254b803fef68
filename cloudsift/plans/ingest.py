"""Ingest, enrichment, graph and explorers over logs that Spark first derives from the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.functions import net
from cloudsift.operators import enrich, explore, graph
from cloudsift.operators import group as G
from cloudsift.plans.events import Query, T, events, table, text
from cloudsift.sources import audit, config, flows, ledger, paths
from cloudsift.sources.scratch import cut, folder, once

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Events in a derived file.
FILE_EVENTS = 500
#: As many of these blocks go into one flow log where no query counts files, as a file costs as much as its 500 lines.
LOG_BLOCKS = 400


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def address(n: Column) -> Column:
    """An address for a number: all classes occur."""
    tail = F.concat(F.lit("."), (n % 7).cast("string"), F.lit("."), (n % 251).cast("string"))
    head = F.element_at(F.array(*(F.lit(x) for x in ("10.1", "127.0", "172.16", "192.168", "169.254", "8.8", "224.0", "203.0", "52.95"))), (n % 9 + 1).cast("int"))
    return F.concat(head, tail)


ADDRESS = "list_extract(['10.1', '127.0', '172.16', '192.168', '169.254', '8.8', '224.0', '203.0', '52.95'], CAST({0} % 9 + 1 AS BIGINT)) || '.' || ({0} % 7) || '.' || ({0} % 251)"
CLASS = """CASE {0} % 9 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'LOOPBACK' WHEN 2 THEN 'PRIVATE' WHEN 3 THEN 'PRIVATE' WHEN 4 THEN 'LINK-LOCAL' WHEN 6 THEN 'SPECIAL' END"""


def audit_files(spark: SparkSession, sf_dir: str) -> str:
    """The event log as envelopes of audit JSON, one file for each FILE_EVENTS events, and one file that is no JSON."""
    df = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.col("event_type").alias("eventName"), F.lit("app.example").alias("eventSource"),
        F.struct(F.lit("IAMUser").alias("type"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("arn")).alias("userIdentity"),
        address(F.col("event_id")).alias("sourceIPAddress"), F.from_json("props", "k int").alias("requestParameters"),
        F.when(F.col("event_type") == "error", "AccessDenied").alias("errorCode"), F.col("event_id").cast("string").alias("eventID"), (F.col("event_id") % 2 == 0).alias("readOnly"),
    ))
    whole = df.select(F.floor(F.col("event_id") / FILE_EVENTS).alias("file"), record.alias("r")).groupBy("file").agg(F.concat(F.lit('{"Records":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value"))
    broken = df.agg(F.lit(-1).cast("long").alias("file"), F.lit("{not json").alias("value"))
    return once(spark, "audit", sf_dir, lambda path: whole.unionByName(broken).write.partitionBy("file").text(path))


@query(f"""SELECT event_type AS event_name, CAST(event_id AS VARCHAR) AS event_id, {T.format("ts")} AS event_time, 'user/' || user_id AS user_identity_arn, {ADDRESS.format("event_id")} AS source_ip_address,
json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code, event_id % 2 = 0 AS read_only, '' AS aws_region FROM events""")
def o03_read_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-03: events out of JSON envelopes, payloads as JSON text, absent names as empty texts."""
    rows, _ = audit.read_audit(spark, audit_files(spark, sf_dir))
    return rows.select("event_name", "event_id", text("event_time").alias("event_time"), "user_identity_arn", "source_ip_address", F.get_json_object("request_parameters", "$.k").alias("k"), "error_code", "read_only", "aws_region")


@query(f"SELECT 'errors' AS what, 1 AS n UNION ALL SELECT 'rows', count(*) FROM events UNION ALL SELECT 'CloudTrail', NULL FROM events WHERE false UNION ALL SELECT 'SkippedOther', CAST(count(DISTINCT event_id // {FILE_EVENTS}) + 1 AS BIGINT) FROM events")
def o04_o21_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-02, O-04, O-21: files by kind, rows, and files that could not be read."""
    path = audit_files(spark, sf_dir)
    rows, errors = audit.read_audit(spark, path)
    return ledger.statistics(paths.log_inventory(spark, path), rows, errors)


PLACES = ["/AWSLogs/1/CloudTrail/us/2024/01/{d}/123456789012_CloudTrail_us_2024{x}.json.gz", "/x/vpcflowlogs/year=2024/month=1/day={d}/123456789012_vpcflowlogs_us_fl-1_a.log.gz", "/x/aws-service=Config/a.json", "/x/{d}.json", "/x/{d}.txt"]


@query("""WITH p AS (SELECT user_id AS u, day(ts) AS d, event_id FROM events), s AS (SELECT event_id % 5 AS kind, d FROM p)
SELECT CASE kind WHEN 0 THEN 'CloudTrail' WHEN 1 THEN 'VpcFlowText' WHEN 2 THEN 'SkippedConfig' WHEN 3 THEN 'CloudTrail' ELSE 'SkippedOther' END AS kind, count(*) AS n
FROM s WHERE (kind > 1 OR d BETWEEN 3 AND 20) AND kind <> 4 GROUP BY 1""")
def o01_o16_o17_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01, O-16, O-17: kinds of log files in a range of days, without an excluded glob."""
    day = F.dayofmonth("ts").cast("string")
    fill = lambda p: F.replace(F.replace(F.lit(p), F.lit("{d}"), F.lpad(day, 2, "0") if "2024/01" in p else day), F.lit("{x}"), F.lit("z"))
    path = F.element_at(F.array(*(fill(p) for p in PLACES)), (F.col("event_id") % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select(path.alias("path")).filter(paths.wanted(F.col("path"), date(2024, 1, 3), date(2024, 1, 20), exclude=["*.txt"]))
    return df.groupBy(paths.classify_log(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT event_id // {FILE_EVENTS}) AS pending, count(*) AS rows_after FROM events")
def o13_o14_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-13, O-14: with one file marked, the others are pending; rows of a file read again replace the old ones."""
    path = audit_files(spark, sf_dir)
    found = cut(ledger.fingerprints(spark, path), "found")
    known = found.filter(F.col("file_path").contains("file=-1"))
    left = ledger.pending(found, known)
    rows, _ = audit.read_audit(spark, path)
    rows = cut(rows.select("event_id", "source_file"), "rows")
    after = ledger.replaced(rows, rows.filter(F.col("source_file").contains("file=0")))
    return left.agg(F.count("*").alias("pending")).crossJoin(after.agg(F.count("*").alias("rows_after")))


@query("""SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || '}}' AS cleaned FROM events""")
def o18_strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-18: noise keys leave at any depth."""
    noisy = F.concat(F.lit('{"sessionToken":"x","a":{"nextToken":[1,{"k":2}],"filterSet":{},"k":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", audit.strip_noise()(noisy).alias("cleaned"))


def flow_files(spark: SparkSession, sf_dir: str, blocks: int = LOG_BLOCKS) -> str:
    """The event log as flow-log text: files with the default fields, with a header in another order, and broken lines; a file of either kind for so many blocks."""
    n, df = F.col("event_id"), table(spark, sf_dir, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    src, dst = address(n), address(n * 5 + 3)
    status = F.when(n % 50 == 7, "NODATA").otherwise("OK")
    port = F.when(n % 40 == 3, "x").otherwise((n % 1000).cast("string"))
    plain = F.concat_ws(" ", F.lit("2"), F.lit("123456789012"), F.concat(F.lit("eni-"), (n % 3).cast("string")), src, dst, port, F.lit("443"), F.lit("6"), F.lit("10"), (n % 5000).cast("string"), start.cast("string"), (start + 60).cast("string"), F.lit("ACCEPT"), status)
    other = F.concat_ws(" ", dst, src, (n % 5000).cast("string"), start.cast("string"), status, F.when(n % 4 == 1, "egress").otherwise("-"), F.lit("zz"))
    line = F.when(n % 100 == 99, F.lit("2 broken line")).when(n % 2 == 0, plain).otherwise(other)
    kind = F.when((n % 2 == 0) & (n % 100 != 99), "plain").otherwise("other")
    lines = df.select(F.concat(F.lit("123456789012_vpcflowlogs_us_fl-"), kind, F.lit("_"), F.floor(n / (FILE_EVENTS * blocks)).cast("string")).alias("file"), kind.alias("kind"), n.alias("n"), line.alias("line"))
    header = F.when(F.first("kind") == "other", F.lit("dstaddr srcaddr bytes start log-status flow-direction custom\n")).otherwise("")
    whole = lines.groupBy("file").agg(F.concat(header, F.array_join(F.collect_list("line"), "\n")).alias("value"))
    return once(spark, f"flows{blocks}", sf_dir, lambda path: whole.write.partitionBy("file").text(path))


#: Flow records of the hunts over h (a running number), c (a kind from 0 to 19) and s (the event's second), as SQL that Spark and
#: DuckDB share. Each kind is one scenario of flow_hunts or a near miss of it.
LOCAL = """CASE c WHEN 0 THEN '10.1.0.1' WHEN 1 THEN '10.1.0.1' WHEN 2 THEN '10.2.0.' || (h % 30) WHEN 3 THEN '10.2.0.' || (h % 9) WHEN 4 THEN '10.3.0.' || (h % 10) WHEN 5 THEN '10.3.1.1' WHEN 6 THEN '10.4.0.' || (h % 5)
WHEN 7 THEN '10.5.0.' || (h % 20) WHEN 8 THEN '10.6.0.' || (h % 100) WHEN 9 THEN '10.7.' || (h div 50 % 250) || '.' || (h % 4) WHEN 10 THEN '10.10.0.' || (h div 80 % 250) WHEN 11 THEN '10.8.0.' || (h % 50) WHEN 12 THEN '10.9.0.' || (h % 10)
WHEN 13 THEN '10.9.0.' || (h % 10) WHEN 14 THEN '10.13.0.' || (h % 40) WHEN 15 THEN '10.11.0.' || (h div 200 % 250) WHEN 16 THEN '10.12.0.' || (h div 200 % 250) WHEN 17 THEN CASE WHEN h % 3 = 1 THEN 'fd00::' || (h % 50) ELSE '10.14.0.' || (h % 50) END WHEN 19 THEN '10.15.0.' || (h % 6) END"""
REMOTE = """CASE c WHEN 0 THEN '8.8.' || (h div 200 % 250) || '.' || (h % 2) WHEN 1 THEN '8.9.' || (h div 200 % 250) || '.' || (h % 2) WHEN 2 THEN '9.9.' || (h div 200 % 250) || '.1' WHEN 3 THEN '9.8.' || (h div 200 % 250) || '.1'
WHEN 4 THEN CASE WHEN h % 5 = 4 THEN '10.16.0.' || (h % 50) ELSE '20.0.' || (h div 100 % 250) || '.' || (h % 100) END WHEN 5 THEN '21.' || (h div 1000 % 250) || '.0.' || (h div 4 % 250) WHEN 6 THEN '22.0.0.' || (h % 50) WHEN 7 THEN '23.0.' || (h div 100 % 250) || '.1'
WHEN 8 THEN CASE h % 3 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '169.254.169.253' ELSE '10.0.0.2' END WHEN 9 THEN '24.0.0.' || (h % 30) WHEN 10 THEN '27.0.0.' || (h div 80 % 250) WHEN 11 THEN '192.168.0.' || (h div 50 % 250) WHEN 12 THEN '192.168.9.' || (h % 20)
WHEN 13 THEN '25.0.0.' || (h % 40) WHEN 14 THEN '28.0.0.' || (h div 40 % 250) WHEN 15 THEN '26.0.' || (h % 60) || '.1' WHEN 16 THEN '26.1.' || (h % 19) || '.1' WHEN 17 THEN CASE WHEN h % 3 = 1 THEN '2001:db8::' || (h % 9) ELSE '29.0.0.' || (h % 90) END WHEN 19 THEN (11 + h % 90) || '.' || (h % 250) || '.0.1' END"""
#: The field `flow-direction`; other records leave it open.
WAY = "CASE WHEN c IN (0, 1, 2, 3, 4, 5, 12, 19) THEN 'ingress' WHEN c IN (6, 7, 8, 9, 10, 11, 13, 15, 16) THEN 'egress' END"
#: Beacons by the hour; every fourth one in windows of ten minutes at that gap, every third of the rest in 19 minutes only.
BEAT = "CASE WHEN c <> 10 THEN s WHEN h div 80 % 4 = 3 THEN 1704067200 + h % 80 * 600 WHEN h div 80 % 3 = 2 THEN 1704067200 + h % 80 % 19 * 3600 ELSE 1704067200 + h % 80 * 3600 END"
HUNTED = {
    "instance-id": "CASE WHEN c = 6 THEN 'i-' || (h % 5) END",
    "traffic-path": "CASE WHEN c IN (6, 7) THEN 8 END",
    "interface-id": "'eni-' || CASE WHEN c = 18 THEN h % 30 ELSE c END",
    "srcaddr": f"CASE WHEN {WAY} = 'ingress' THEN {REMOTE} ELSE {LOCAL} END",
    "dstaddr": f"CASE WHEN {WAY} = 'ingress' THEN {LOCAL} ELSE {REMOTE} END",
    "dstport": """CASE c WHEN 0 THEN 1000 + h div 2 % 60 WHEN 1 THEN 1000 + h div 2 % 19 WHEN 2 THEN 8080 WHEN 3 THEN 8080 WHEN 4 THEN CASE h % 3 WHEN 0 THEN 22 WHEN 1 THEN 3389 ELSE 443 END WHEN 5 THEN 8443 WHEN 6 THEN 443 WHEN 7 THEN CASE h % 3 WHEN 0 THEN 4444 WHEN 1 THEN 3333 ELSE 4443 END
WHEN 8 THEN 53 WHEN 9 THEN CASE h % 4 WHEN 0 THEN 25 WHEN 1 THEN 465 WHEN 2 THEN 587 ELSE 26 END WHEN 10 THEN 443 WHEN 11 THEN CASE h % 50 % 3 WHEN 0 THEN 445 WHEN 1 THEN 22 ELSE 5432 END WHEN 12 THEN 2049 WHEN 13 THEN 443 WHEN 15 THEN 9000 + h % 7 WHEN 16 THEN 9000 + h % 7 WHEN 19 THEN 443 END""",
    "protocol": "CASE WHEN c = 18 THEN NULL WHEN c IN (8, 15, 16) THEN 17 WHEN c = 14 THEN CASE WHEN h % 2 = 0 THEN 47 ELSE 50 END WHEN c = 17 THEN CASE h % 3 WHEN 0 THEN 1 WHEN 1 THEN 58 ELSE 2 END ELSE 6 END",
    "bytes": "CASE WHEN c = 18 THEN NULL WHEN c = 6 AND s div 86400 % 10 = 7 THEN CASE WHEN h % 5 IN (0, 2, 4) THEN 20000 ELSE 3000 END ELSE 1000 END",
    "start": BEAT,
    "end": f"{BEAT} + CASE WHEN c = 10 AND h div 80 % 4 = 3 THEN 600 ELSE 60 END",
    "action": "CASE WHEN c = 18 THEN NULL WHEN c IN (0, 1, 2, 3) OR c = 7 AND h % 7 = 0 OR c = 13 AND h % 10 >= 5 OR c = 19 AND h % 4 = 0 OR c = 5 AND (h % 4 < 2) = (h div 4 % 2 = 0) THEN 'REJECT' ELSE 'ACCEPT' END",
    "log-status": "CASE WHEN c <> 18 THEN 'OK' WHEN h % 3 = 0 THEN 'NODATA' ELSE 'SKIPDATA' END",
    "tcp-flags": "CASE WHEN c IN (0, 1, 2, 3) THEN 2 END",
    "flow-direction": WAY,
    "reject-reason": "CASE WHEN c = 6 AND h % 5 = 4 AND s div 86400 % 10 = 7 OR c = 19 AND h % 8 = 0 THEN 'BPA' WHEN c = 19 AND h % 8 = 4 THEN 'EC' END",
    "interface-type": "CASE WHEN c = 6 AND h % 3 = 0 THEN 'nat_gateway' END",
    "pkt-src-aws-service": "CASE WHEN c = 7 AND h % 4 = 0 THEN 'S3' END",
}


def hunt_files(spark: SparkSession, sf_dir: str, blocks: int = LOG_BLOCKS) -> str:
    """The event log as flow-log text of four flow logs with the scenarios of the hunts and their near misses; a file of each flow log for so many blocks."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.expr("event_id div 20").alias("h"), F.expr("event_id % 20").alias("c"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    # Nulls are filled by a function over the list: the fields by themselves make one method too long for the JVM to compile.
    line = F.array_join(F.transform(F.array(*(F.expr(e).cast("string") for e in HUNTED.values())), lambda x: F.coalesce(x, F.lit("-"))), " ")
    block = F.expr(f"n div {FILE_EVENTS}")
    lines = own.select(F.concat(F.lit("123456789012_vpcflowlogs_us_fl-"), (block % 4).cast("string"), F.lit("_"), F.expr(f"n div {FILE_EVENTS * blocks}").cast("string")).alias("file"), line.alias("line"))
    whole = lines.groupBy("file").agg(F.concat(F.lit(" ".join(HUNTED) + "\n"), F.array_join(F.collect_list("line"), "\n")).alias("value"))
    return once(spark, f"hunted{blocks}", sf_dir, lambda path: whole.write.partitionBy("file").text(path))


FLOW = f"""(SELECT event_id AS n, {ADDRESS.format("event_id")} AS src, {ADDRESS.format("(event_id * 5 + 3)")} AS dst, {CLASS.format("event_id")} AS src_class, {CLASS.format("(event_id * 5 + 3)")} AS dst_class,
event_id % 2 = 0 AS plain, event_id % 50 = 7 AS nodata FROM events WHERE event_id % 100 <> 99)"""


@query(f"""WITH e AS (SELECT *, CASE WHEN nodata THEN 'unknown' WHEN NOT plain AND n % 4 = 1 THEN 'record' WHEN (src_class IS NULL) <> (dst_class IS NULL) THEN 'heuristic' ELSE 'unknown' END AS direction_source FROM {FLOW}),
l AS (SELECT *, CASE direction_source WHEN 'record' THEN src_class WHEN 'heuristic' THEN coalesce(src_class, dst_class) END AS local_class FROM e)
SELECT direction_source, CASE WHEN direction_source = 'unknown' THEN NULL ELSE lower(coalesce(local_class, 'public')) END AS local_scope, count(*) AS n, CAST(sum(n % 5000) AS BIGINT) AS bytes, count(*) FILTER (plain AND n % 40 = 3) AS issues, count(*) FILTER (NOT plain) AS with_extra FROM l GROUP BY ALL""")
def o05_o24_read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-05, O-22 to O-25: flow records of two layouts with their endpoints."""
    records, _, _ = flows.read_flows(spark, flow_files(spark, sf_dir))
    return records.groupBy("direction_source", "local_scope").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("has_parse_issue").alias("issues"), F.count("extra").alias("with_extra"))


@query(f"""SELECT CASE WHEN event_id % 2 = 0 THEN 'fl-plain' ELSE 'fl-other' END AS flow_log_id, '123456789012' AS file_account, count(*) AS total, count(*) FILTER (event_id % 100 = 99) AS rejected, count(*) FILTER (event_id % 50 = 7) AS nodata, count(*) FILTER (event_id % 2 = 0 AND event_id % 40 = 3) AS field_issues
FROM events GROUP BY event_id % 2""")
def o06_o08_flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06 to O-08: statistics by flow log out of its files."""
    _, files, _ = flows.read_flows(spark, flow_files(spark, sf_dir))
    # The derived files lie in folders that bear the file's name.
    named = files.withColumn("name", F.regexp_extract("source_file", r"file=([^/]+)/", 1)).select("total", "rejected", "nodata", "with_issues", *flows.flow_file_meta(F.concat(F.lit("/"), "name", F.lit("_h.log"))))
    return named.groupBy("flow_log_id", "file_account").agg(F.sum("total").alias("total"), F.sum("rejected").alias("rejected"), F.sum("nodata").alias("nodata"), F.sum("with_issues").alias("field_issues"))


@query(f"""SELECT src AS srcaddr, dst AS dstaddr, max(n % 5000) AS bytes, count(*) AS observations FROM (SELECT f.*, date_trunc('minute', ts) AS m FROM {FLOW} f JOIN events ON n = event_id) WHERE plain AND NOT nodata GROUP BY src, dst, CASE WHEN n % 40 = 3 THEN NULL ELSE n % 1000 END, m""")
def o29_flow_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-29: one row for a 5-tuple and minute."""
    records, _, _ = flows.read_flows(spark, flow_files(spark, sf_dir))
    found = flows.flow_unique(records.filter("protocol = 6"))
    return found.select(F.col("flow_src").alias("srcaddr"), F.col("flow_dst").alias("dstaddr"), "bytes", F.col("observation_count").alias("observations"))


@query(f"SELECT {ADDRESS.format("event_id")} AS ip, {CLASS.format("event_id")} AS class, lower(coalesce({CLASS.format("event_id")}, 'public')) AS scope FROM events")
def o22_o23_ip_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-22, O-23: class and scope of addresses."""
    df = table(spark, sf_dir, "events").select(address(F.col("event_id")).alias("ip"))
    return df.select("ip", net.ip_class(F.col("ip")).alias("class"), net.address_scope(F.col("ip")).alias("scope"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range for each nation: half a /4 block, so that some addresses lie in none."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select((n * 100_000_000).alias("low"), (n * 100_000_000 + 69_999_999).alias("high"), F.col("n_name").alias("country"))


@query(f"""WITH a AS (SELECT DISTINCT {ADDRESS.format("event_id")} AS ip, {CLASS.format("event_id")} AS class FROM events),
n AS (SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS x FROM a)
SELECT ip, coalesce(class, n_name) AS country FROM n LEFT JOIN nation ON class IS NULL AND x BETWEEN n_nationkey * CAST(100000000 AS BIGINT) AND n_nationkey * CAST(100000000 AS BIGINT) + 69999999""")
def o26_geo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-26: countries of distinct addresses by range."""
    df = table(spark, sf_dir, "events").select(address(F.col("event_id")).alias("ip"))
    return enrich.geo_lookup(df, ranges(spark, sf_dir))


def ranges6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One IPv6 range for each nation: half a /32 block."""
    block = F.concat(F.lit("2a00"), F.lpad(F.lower(F.hex("n_nationkey")), 4, "0"))
    return table(spark, sf_dir, "nation").select(F.rpad(block, 32, "0").alias("low"), F.rpad(F.concat(block, F.lit("7")), 32, "f").alias("high"), F.col("n_name").alias("country"))


@query("""SELECT DISTINCT CASE WHEN event_id % 100 = 1 THEN '::1' ELSE format('2a00:{:x}:{}::{:x}', event_id % 40, CASE WHEN event_id % 2 = 0 THEN '7fff' ELSE '8000' END, event_id % 251) END AS ip,
CASE WHEN event_id % 100 = 1 THEN 'LOOPBACK' WHEN event_id % 2 = 0 THEN n_name END AS country FROM events LEFT JOIN nation ON n_nationkey = event_id % 40""")
def o26_geo_lookup6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-26: countries of distinct IPv6 addresses by range."""
    n, short = F.col("event_id"), lambda c: F.lower(F.hex(c))
    ip = F.concat(F.lit("2a00:"), short(n % 40), F.when(n % 2 == 0, ":7fff::").otherwise(":8000::"), short(n % 251))
    df = table(spark, sf_dir, "events").select(F.when(n % 100 == 1, "::1").otherwise(ip).alias("ip"))
    return enrich.geo_lookup(df, ranges(spark, sf_dir), ranges6=ranges6(spark, sf_dir))


@query(f"""WITH a AS (SELECT event_id, {ADDRESS.format("event_id")} AS ip, {CLASS.format("event_id")} AS class FROM events),
n AS (SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS x FROM a)
SELECT coalesce(class, n_name) AS geo_country, count(*) AS n FROM n LEFT JOIN nation ON class IS NULL AND x BETWEEN n_nationkey * CAST(100000000 AS BIGINT) AND n_nationkey * CAST(100000000 AS BIGINT) + 69999999 GROUP BY 1""")
def o27_o32_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-27, O-30, O-32: the lookup filled for the addresses of a result, beside the result."""
    df = table(spark, sf_dir, "events").select("event_id", address(F.col("event_id")).alias("source_ip"))
    empty = spark.createDataFrame([], "ip string, country string")
    known = enrich.populate(empty, [(df, ["source_ip"])], ranges(spark, sf_dir))
    return enrich.enrich_result(df, known).groupBy("geo_country").agg(F.count("*").alias("n"))


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions as VPCs, nations as subnets, customers as interfaces (in their subnet by association), suppliers as functions."""
    rows = lambda df, kind, key: df.select(F.lit("s").alias("snapshot_id"), F.concat(F.lit(kind[1]), F.col(key).cast("string")).alias("resource_id"), F.lit(kind[0]).alias("resource_type"), F.lit(None).cast("string").alias("resource_name"), F.lit(None).cast("string").alias("configuration"))
    pick = lambda name: table(spark, sf_dir, name)
    kinds = {"region": ("AWS::EC2::VPC", "vpc-"), "nation": ("AWS::EC2::Subnet", "subnet-"), "customer": ("AWS::EC2::NetworkInterface", "eni-"), "supplier": ("AWS::EC2::Instance", "i-"), "part": ("AWS::S3::Bucket", "b-")}
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    resources = None
    for name, kind in kinds.items():
        own = rows(pick(name), kind, keys[name])
        resources = own if resources is None else resources.unionByName(own)
    edge = lambda df, a, b, what: df.select(F.lit("s").alias("snapshot_id"), a.alias("source_id"), b.alias("target_id"), F.lit(what).alias("name"))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = edge(pick("nation"), name("subnet-", "n_nationkey"), name("vpc-", "n_regionkey"), "Is contained in Vpc")
    edges = edges.unionByName(edge(pick("customer"), name("eni-", "c_custkey"), name("subnet-", "c_nationkey"), "Is associated with "))
    edges = edges.unionByName(edge(pick("supplier"), name("i-", "s_suppkey"), F.concat(F.lit("eni-"), (F.col("s_suppkey") % 100).cast("string")), "Is attached to"))
    return resources, edges


@query("""SELECT 'subnet-' || n_nationkey AS resource_id, 'vpc-' || n_regionkey AS parent_id, 1 AS depth FROM nation UNION ALL SELECT 'eni-' || c_custkey, 'subnet-' || c_nationkey, 2 FROM customer
UNION ALL SELECT 'i-' || s_suppkey, 'vpc-' || n_regionkey, 1 FROM supplier JOIN customer ON c_custkey = s_suppkey % 100 JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'b-' || p_partkey, '__svc__S3', 1 FROM part UNION ALL SELECT 'vpc-' || r_regionkey, NULL, 0 FROM region UNION ALL SELECT '__svc__S3', NULL, 0 FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM part)""")
def o76_o85_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-76 to O-79, O-81, O-85: parents and depths of a snapshot: containment, subnets and VPCs by association, service groups."""
    resources, edges = (cut(x, "snapshot") for x in snapshot(spark, sf_dir))
    nodes, _ = graph.build_graph(resources, edges)
    return nodes.select("resource_id", "parent_id", "depth")


def wide_snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot that shows zones, association records, access points, defaults and groups: regions as VPCs, nations as subnets with route tables, parts as buckets, suppliers as access points and defaults."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def rows(name: str, key: str, prefix: str, kind: str, where: str = "true", configuration: str = "CAST(NULL AS STRING)") -> DataFrame:
        own = table(spark, sf_dir, name).filter(where)
        return own.select(F.lit("s").alias("snapshot_id"), named(prefix, key).alias("resource_id"), F.lit(kind).alias("resource_type"), named("name of ", key).alias("resource_name"), F.expr(configuration).alias("configuration"))

    def links(name: str, source: Column, target: Column, label: str, where: str = "true") -> DataFrame:
        return table(spark, sf_dir, name).filter(where).select(F.lit("s").alias("snapshot_id"), source.alias("source_id"), target.alias("target_id"), F.lit(label).alias("name"))

    resources = [
        rows("region", "r_regionkey", "vpc-", "AWS::EC2::VPC"), rows("nation", "n_nationkey", "subnet-", "AWS::EC2::Subnet", configuration="""concat('{"availabilityZone":"z', n_nationkey % 2, '"}')"""),
        rows("nation", "n_nationkey", "rt-", "AWS::EC2::RouteTable"), rows("nation", "n_nationkey", "assoc-", "AWS::EC2::SubnetRouteTableAssociation", "n_nationkey % 3 < 2"), rows("part", "p_partkey", "b-", "AWS::S3::Bucket"),
        rows("supplier", "s_suppkey", "ap-", "AWS::S3::AccessPoint"), rows("supplier", "s_suppkey", "dc-", "AWS::CodeDeploy::DeploymentConfig", "s_suppkey % 2 = 0"),
    ]
    nation = "n_nationkey"
    edges = [
        links("nation", named("subnet-", nation), named("vpc-", "n_regionkey"), "Is contained in Vpc"), links("nation", named("rt-", nation), named("vpc-", "n_regionkey"), "Is contained in Vpc"),
        links("nation", named("assoc-", nation), named("subnet-", nation), "Is associated with", "n_nationkey % 3 < 2"), links("nation", named("assoc-", nation), named("rt-", nation), "Is associated with", "n_nationkey % 3 = 0"),
        links("supplier", named("ap-", "s_suppkey"), F.concat(F.lit("b-"), (F.col("s_suppkey") % 10 + 1).cast("string")), "Is associated with"),
    ]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return cut(union(resources), "snapshot"), cut(union(edges), "snapshot")


@query("""WITH wide AS (SELECT n_regionkey AS r FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey % 2) > 1),
leaf AS (SELECT 'assoc-' || n_nationkey AS id, '__svc__EC2' AS parent FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'b-' || p_partkey, '__svc__S3' FROM part UNION ALL SELECT 'dc-' || s_suppkey, '__svc__AccountDefaults' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'vpc-' || r_regionkey AS resource_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth, CAST(NULL AS BIGINT) AS member_count FROM region
UNION ALL SELECT DISTINCT '__az__vpc-' || n_regionkey || '__z' || (n_nationkey % 2), 'vpc-' || n_regionkey, 1, NULL FROM nation JOIN wide ON r = n_regionkey
UNION ALL SELECT 'subnet-' || n_nationkey, CASE WHEN r IS NULL THEN 'vpc-' || n_regionkey ELSE '__az__vpc-' || n_regionkey || '__z' || (n_nationkey % 2) END, CASE WHEN r IS NULL THEN 1 ELSE 2 END, NULL FROM nation LEFT JOIN wide ON r = n_regionkey
UNION ALL SELECT 'rt-' || n_nationkey, 'vpc-' || n_regionkey, 1, NULL FROM nation UNION ALL SELECT 'ap-' || s_suppkey, 'b-' || (s_suppkey % 10 + 1), 2, NULL FROM supplier
UNION ALL SELECT id, parent, 1, NULL FROM leaf UNION ALL SELECT parent, NULL, 0, count(*) FROM leaf GROUP BY parent""")
def o79_o86_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-79, O-80, O-81, O-83, O-85, O-86: access points in buckets, zones of wide VPCs, groups of services and of defaults with their members."""
    nodes, _ = graph.build_graph(*wide_snapshot(spark, sf_dir))
    return nodes.select("resource_id", "parent_id", "depth", "member_count")


@query("""SELECT 'subnet-' || n_nationkey AS source_id, 'rt-' || n_nationkey AS target_id, 'route table' AS name FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'assoc-' || n_nationkey, 'subnet-' || n_nationkey, 'Is associated with' FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'ap-' || s_suppkey, 'b-' || (s_suppkey % 10 + 1), 'Is associated with' FROM supplier""")
def o82_o84_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-82, O-84: edges between shown nodes; association records give way to a direct edge."""
    _, edges = graph.build_graph(*wide_snapshot(spark, sf_dir))
    return edges.select("source_id", "target_id", "name")


@query("""SELECT 's' AS snapshot_id, kind AS resource_type FROM (SELECT 'AWS::EC2::VPC' AS kind FROM region UNION SELECT 'AWS::EC2::Subnet' FROM nation UNION SELECT 'AWS::EC2::NetworkInterface' FROM customer UNION SELECT 'AWS::EC2::Instance' FROM supplier UNION SELECT 'AWS::S3::Bucket' FROM part)""")
def o75_resource_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-75: the types that each snapshot holds."""
    return graph.resource_types(snapshot(spark, sf_dir)[0])


@query("SELECT 's' AS snapshot_id, 'subnet-' || n_nationkey AS resource_id, 'AWS::EC2::Subnet' AS resource_type FROM nation WHERE n_nationkey = 3")
def o75_resource_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-75: one resource."""
    return graph.resource_detail(snapshot(spark, sf_dir)[0], "s", "subnet-3").select("snapshot_id", "resource_id", "resource_type")


@query("SELECT count(*) + count(*) FILTER (event_id < 10) + 1 AS rows_after, count(DISTINCT event_id) + 1 AS rows_by_key, count(*) FILTER (event_id < 10) AS again FROM events")
def o15_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-15: a changed file adds all of its rows again, or by key only the new one."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"))
    again = rows.filter("CAST(event_id AS long) < 10")
    fresh = again.unionByName(spark.range(1).select(F.lit("new").alias("event_id")))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(ledger.appended(rows, fresh), "rows_after").crossJoin(count(ledger.appended(rows, fresh, "event_id"), "rows_by_key")).crossJoin(count(again, "again"))


def detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summary, calls, attributes, metrics) of the event log: users as identities, actions as calls, parameters as attributes."""
    df = events(spark, sf_dir).withColumn("UserARN", F.concat(F.lit("user/"), F.col("user_id").cast("string")))
    summary = df.groupBy("UserARN").agg(F.count("*").alias("NumOfEvents"), F.min("ts").alias("FirstTimestamp"), F.max("ts").alias("LastTimestamp"))
    calls = df.groupBy("UserARN", F.col("event_type").isin("error", "signup").alias("IsAbused"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("Outcome"), F.col("event_type").alias("API")).agg(F.count("*").alias("Count"))
    attributes = df.groupBy("UserARN", F.lit("k").alias("Attribute"), F.col("k").cast("string").alias("Value")).agg(F.count("*").alias("Count"))
    metrics = df.groupBy(F.col("event_type").alias("Field"), F.col("k").cast("string").alias("Value")).agg(F.count("*").alias("Count"), F.min("ts").alias("FirstSeen"))
    return summary, calls, attributes, metrics


@query("""SELECT 'user/' || user_id AS "UserARN", count(*) AS "NumOfEvents", count(DISTINCT CASE WHEN event_type = 'signup' THEN 1 END) AS abused_success, count(DISTINCT CASE WHEN event_type = 'error' THEN 1 END) AS abused_failed,
count(DISTINCT CASE WHEN event_type IN ('error', 'signup') THEN event_type END) AS abused_apis, count(DISTINCT props) AS attribute_values FROM events GROUP BY user_id""")
def o87_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43, O-87: identities with their calls by quadrant."""
    summary, calls, attributes, _ = detections(spark, sf_dir)
    return explore.identity_overview(summary, calls, attributes).select("UserARN", "NumOfEvents", "abused_success", "abused_failed", "abused_apis", "attribute_values")


@query("""SELECT json_extract_string(props, '$.k') AS "Value", count(DISTINCT user_id) AS identities, array_to_string(list_sort(list(DISTINCT 'user/' || user_id)), ', ') AS arns, count(*) AS uses FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2""")
def o88_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-88: parameter values that several identities share."""
    return explore.sharing(detections(spark, sf_dir)[2], "k")


@query("""WITH a AS (SELECT props, count(*) AS w FROM events WHERE user_id = 1 GROUP BY 1), b AS (SELECT props, count(*) AS w FROM events WHERE user_id = 2 GROUP BY 1)
SELECT json_extract_string(coalesce(a.props, b.props), '$.k') AS "Value", coalesce(a.w, 0) AS weight_a, coalesce(b.w, 0) AS weight_b, CASE WHEN b.props IS NULL THEN 'only_a' WHEN a.props IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.props = b.props""")
def o89_compare_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-89: two identities along one dimension."""
    return explore.compare_identities(detections(spark, sf_dir)[2], "user/1", "user/2", "k")


@query("""WITH m AS (SELECT event_type, props, count(*) AS n FROM events GROUP BY ALL) SELECT event_type AS "Field", count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, count(*) FILTER (n = 1) AS singletons, round(max(n) / sum(n), 6) AS top_share FROM m GROUP BY event_type""")
def o90_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-90: fields with their largest share and singletons."""
    return explore.field_stats(detections(spark, sf_dir)[3]).withColumn("top_share", F.round("top_share", 6))


@query("""WITH m AS (SELECT event_type, props, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT * FROM m WHERE event_type = 'view'), b AS (SELECT * FROM m WHERE event_type = 'click')
SELECT json_extract_string(coalesce(a.props, b.props), '$.k') AS "Value", coalesce(a.n, 0) AS weight_a, coalesce(b.n, 0) AS weight_b, CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.props = b.props""")
def o92_compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-92: two fields side by side."""
    return explore.compare_fields(detections(spark, sf_dir)[3], "view", "click")


@query(f"""SELECT CASE WHEN event_id % 2 = 0 AND event_id % 100 <> 99 THEN 'plain' ELSE 'other' END AS kind, event_id // {FILE_EVENTS} AS file, count(*) AS total, count(*) FILTER (event_id % 100 = 99) AS rejected, count(*) FILTER (event_id % 100 = 99) > 0.01 * count(*) AS warn FROM events GROUP BY 1, 2""")
def o08_warned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06, O-08: files with their rejected lines, and whether these are worth a warning."""
    _, files, _ = flows.read_flows(spark, flow_files(spark, sf_dir, blocks=1))
    name = F.regexp_extract("source_file", r"_fl-([a-z]+)_(\d+)/", 1), F.regexp_extract("source_file", r"_fl-([a-z]+)_(\d+)/", 2).cast("long")
    return files.select(name[0].alias("kind"), name[1].alias("file"), "total", "rejected", "warn")


def snapshot_files(spark: SparkSession, sf_dir: str) -> str:
    """A configuration snapshot for each region: nations as subnets with edges to the region, to another snapshot's and to nothing."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    link = lambda target, name: F.struct(target.alias("resourceId"), F.lit("x").alias("resourceType"), F.lit(name).alias("name"))
    edges = F.array(link(F.concat(F.lit("subnet-"), (n - n % 2).cast("string")), " Is attached to "), link(F.lit("gone"), "Is attached to"), link(F.lit(""), "Contains"))
    item = F.to_json(F.struct(
        F.concat(F.lit("subnet-"), n.cast("string")).alias("resourceId"), F.lit("AWS::EC2::Subnet").alias("resourceType"), F.col("n_name").alias("resourceName"), F.concat(F.lit("r"), r.cast("string")).alias("awsRegion"), F.lit("123456789012").alias("awsAccountId"),
        F.concat(F.lit("2024-01-"), F.lpad((n + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("configurationItemCaptureTime"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("tags"), edges.alias("relationships"),
    ))
    whole = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("item")))).alias("items"))
    text_ = F.concat(F.lit('{"configSnapshotId":"s'), F.col("n_regionkey").cast("string"), F.lit('","configurationItems":['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}"))
    return once(spark, "snapshots", sf_dir, lambda path: whole.select(F.col("n_regionkey").alias("file"), text_.alias("value")).write.partitionBy("file").text(path))


@query("""WITH e AS (SELECT a.n_regionkey AS r, count(*) AS edges FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey - a.n_nationkey % 2 AND b.n_regionkey = a.n_regionkey GROUP BY 1)
SELECT 's' || n_regionkey AS snapshot_id, '123456789012' AS account_id, 'r' || n_regionkey AS region, strftime(DATE '2024-01-01' + CAST(max(n_nationkey) AS INTEGER), '%Y-%m-%d 00:00:00') AS captured_at, count(*) AS record_count, count(*) AS resources, count(*) AS without_tags,
coalesce(any_value(edges), 0) AS edges, n_regionkey <> 0 AS pending FROM nation LEFT JOIN e ON r = n_regionkey GROUP BY n_regionkey""")
def o09_o12_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-09 to O-12: snapshots with their resources and edges, dangling ones left out; those to import where s0 is known as a whole and s1 is known without resources."""
    snapshots, resources, edges = config.read_snapshots(spark, snapshot_files(spark, sf_dir))
    known = snapshots.filter("snapshot_id in ('s0', 's1')")
    pending = config.to_import(snapshots, known, resources.filter("snapshot_id = 's0'")).select("snapshot_id", F.lit(True).alias("pending"))
    counts = resources.groupBy("snapshot_id").agg(F.count("*").alias("resources"), F.count_if(F.col("tags").isNull()).alias("without_tags"))
    links = edges.groupBy("snapshot_id").agg(F.count("*").alias("edges"))
    out = snapshots.join(counts, "snapshot_id").join(links, "snapshot_id", "left").join(pending, "snapshot_id", "left")
    return out.select("snapshot_id", "account_id", "region", text("captured_at").alias("captured_at"), "record_count", "resources", "without_tags", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("pending", F.lit(False)).alias("pending"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n, CAST(0 AS BIGINT) AS with_raw, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def o19_o20_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-19, O-20: events without their raw text, written as a table in days and read back."""
    rows, _ = audit.read_audit(spark, audit_files(spark, sf_dir), keep_raw=False)
    path = folder(spark, "event_table")
    audit.write_events(rows, path)
    kept = spark.read.parquet(path)
    return kept.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_date")).agg(F.count("*").alias("n"), F.count("raw_event").alias("with_raw"), F.count_distinct("user_identity_arn").alias("users"))


@query("SELECT DISTINCT 'u' || user_id AS ip, CASE WHEN user_id % 2 = 0 THEN 'known' ELSE 'c' || max(event_id % 3) OVER (PARTITION BY user_id) END AS country FROM events")
def o33_lookup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-33: the lookup, and for addresses that it lacks the largest value that events carry."""
    df = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_ip_address"), "user_id", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("geo_country"))
    known = df.filter("user_id % 2 = 0").select(F.col("source_ip_address").alias("ip"), F.lit("known").alias("country")).distinct()
    return enrich.lookup_source(known, df).select("ip", "country")


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def o60_kept_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-60: distinct values out of daily sketches, within 5 % of the exact count."""
    df = events(spark, sf_dir)
    kept = cut(G.daily_sketches(df, ["event_type"], "ts", "user_id"), "sketches")
    exact = df.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return G.sketched_distinct(kept, ["event_type"], "estimate").join(exact, "event_type").select("event_type", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))

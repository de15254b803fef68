"""The charts of five dashboards over datasets that Spark derives from the driver's tables, and their rare variants (O-70)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators.charts import ROW_CAP, Ranking, run_many
from cloudsift.plans import chart_specs as S
from cloudsift.plans import datasets as D
from cloudsift.plans.dataset_queries import SQL as DATASET_SQL
from cloudsift.plans.dataset_queries import STATEMENTS, audit, detection_dataset, detections, places
from cloudsift.plans.events import Query, table
from cloudsift.plans.hunts import AT, RECORDS, flow_records
from cloudsift.plans.ingest import hunt_files
from cloudsift.sources import flows
from cloudsift.sources.scratch import cut

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Measures of a chart at most.
WIDTH = 10

#: (what stands in a spec, Spark SQL, DuckDB SQL).
FUNCTIONS = [
    (r"json\((\w+), '?([\w.-]+)'?\)", r"get_json_object(\1, '$.\2')", lambda m: f"json_extract_string({m[1]}, '$.{chr(34)}{m[2]}{chr(34)}')" if "-" in m[2] else f"json_extract_string({m[1]}, '$.{m[2]}')"),
    (r"span\(day, (\w+\(\w+\)), (\w+\(\w+\))\)", r"datediff(\2, \1)", r"date_diff('day', \1, \2)"),
    (r"span\(minute, (\w+\(\w+\)), (\w+\(\w+\))\)", r"div(unix_timestamp(date_trunc('minute', \2)) - unix_timestamp(date_trunc('minute', \1)), 60)", r"date_diff('minute', \1, \2)"),
    (r"secs\((\w+\(\w+\))\)", r"unix_timestamp(\1)", r"epoch(\1)"),
    (r"clock_hour\((\w+)\)", r"lpad(CAST(hour(\1) AS STRING), 2, '0')", r"lpad(CAST(hour(\1) AS VARCHAR), 2, '0')"),
    (r"clock_day\((\w+)\)", r"(dayofweek(\1) - 1)", r"dayofweek(\1)"),
    (r"five\((\w+)\)", r"(date_trunc('hour', \1) + make_dt_interval(0, 0, CAST(floor(minute(\1) / 5) * 5 AS INT), 0))", r"time_bucket(INTERVAL 5 MINUTE, \1)"),
    (r"matches\((.+), '([^']*)'\)", lambda m: f"regexp_like({m[1]}, '{m[2].replace('/', '|')}')", lambda m: f"regexp_matches({m[1]}, '{m[2].replace('/', '|')}')"),
]


def said(sql: str, engine: int) -> str:
    """SQL of a spec for Spark (0) or DuckDB (1)."""
    for pattern, *by_engine in FUNCTIONS:
        sql = re.sub(pattern, by_engine[engine], sql)
    return sql.replace("div(", "CAST((", 1).replace(", 60)", ") / 60 AS BIGINT)", 1) if engine == 0 and "div(" in sql else sql


def in_order(spec: S.Spec, sql: str) -> str:
    """A condition on measures by their places."""
    for i, (name, _) in enumerate(spec.measures):
        sql = re.sub(rf"\b{name}\b", f"m{i + 1}", sql)
    return sql


def ranking(spec: S.Spec) -> Ranking:
    """A spec in Spark's SQL."""
    value = lambda pair: (said(pair[1], 0), pair[0] in S.TIMES)
    return Ranking(f"{spec.number} {spec.name}", tuple(said(d, 0) for _, d in spec.dims), tuple(map(value, spec.measures)), said(spec.where, 0), in_order(spec, spec.having), spec.limit or ROW_CAP, value(spec.order), spec.ascending)


def statement(spec: S.Spec, source: str) -> str:
    """A spec in DuckDB's SQL, by itself."""
    value = lambda pair: f"floor(epoch({said(pair[1], 1)}))" if pair[0] in S.TIMES else f"round(CAST({said(pair[1], 1)} AS DOUBLE), 4)"
    measures = [value(m) for m in spec.measures] + ["CAST(NULL AS DOUBLE)"] * (WIDTH - len(spec.measures))
    dims = " || '|' || ".join(f"coalesce(CAST({said(d, 1)} AS VARCHAR), '-')" for _, d in spec.dims) or "''"
    where = f"WHERE {said(spec.where, 1)}" if spec.where else ""
    columns = ", ".join(f"{m} AS m{i + 1}" for i, m in enumerate(measures))
    inner = f"SELECT {dims} AS dims, {value(spec.order)} AS o, {columns} FROM {source} {where} {'GROUP BY 1' if spec.dims else ''}"
    having = f"WHERE {in_order(spec, spec.having)}" if spec.having else ""
    place = f"row_number() OVER (ORDER BY o {'ASC' if spec.ascending else 'DESC'} NULLS LAST, dims)"
    return f"SELECT '{spec.number} {spec.name}' AS chart, {place} AS place, dims, {', '.join(f'm{i + 1}' for i in range(WIDTH))} FROM ({inner}) {having} QUALIFY place <= {spec.limit or ROW_CAP}"


def timed(df: DataFrame) -> DataFrame:
    """Times without a zone as times, to the second."""
    return df.withColumns({c: F.date_trunc("second", F.col(c).cast("timestamp")) for c, kind in df.dtypes if kind == "timestamp_ntz"})


# An audit trail in which every action of a chart occurs, as SQL that Spark and DuckDB share; `pick` stands for an element of a list.
PAIRS = sorted({(s, a) for spec in S.catalogue("CC") for part in re.findall(r"(?:event_source IN \(([^)]*)\) AND )?event_name IN \(([^)]*)\)", spec.where) for s in (re.findall(r"'([^']*)'", part[0]) or ["iam.amazonaws.com"])[:1] for a in re.findall(r"'([^']*)'", part[1])})
COUNTRIES = ["JP", "US", "DE", "PRIVATE", "BR"]
N = "event_id"
TRAIL = {
    "event_time": f"CASE WHEN {N} % 8 = 7 THEN date_trunc('hour', TIMESTAMP '2024-01-02 01:00:00') ELSE date_trunc('second', ts) END",
    "event_source": f"CASE WHEN {N} % 8 = 7 THEN 's3.amazonaws.com' ELSE pick(sources, {N} % {len(PAIRS)}) END",
    "event_name": f"CASE WHEN {N} % 16 = 7 THEN 'GetObject' WHEN {N} % 8 = 7 THEN 'DeleteObject' ELSE pick(actions, {N} % {len(PAIRS)}) END",
    "user_identity_arn": f"CASE WHEN {N} % 8 = 7 THEN 'user/burst' || ({N} % 3) WHEN {N} % 37 <> 5 THEN 'user/' || (user_id % 50) END",
    "user_identity_type": f"CASE {N} % 6 WHEN 0 THEN 'Root' WHEN 1 THEN 'AssumedRole' WHEN 2 THEN 'AssumedRole' ELSE 'IAMUser' END",
    "user_identity_account_id": f"CASE WHEN {N} % 9 > 0 THEN '11111111111' || ({N} % 3) END", "recipient_account_id": f"CASE WHEN {N} % 11 > 0 THEN '11111111111' || ({N} % 2) END",
    "user_identity_access_key_id": f"CASE WHEN {N} % 3 = 0 THEN 'ASIA' ELSE 'AKIA' END || (user_id % 40)", "session_issuer_arn": f"CASE WHEN {N} % 4 < 3 THEN 'role/' || ({N} % 10) END", "session_mfa_authenticated": f"CASE {N} % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END",
    "source_ip_address": f"CASE WHEN {N} % 8 = 7 THEN '203.0.113.9' ELSE pick(addresses, {N} % 7) || ({N} % 5) END", "user_agent": f"CASE WHEN {N} % 19 > 0 THEN 'cli/' || ({N} % 6) END",
    "geo_country_code": f"CASE WHEN {N} % 13 > 1 THEN pick(countries, {N} % 5) END", "geo_country_name": f"CASE WHEN {N} % 13 > 1 THEN 'land ' || pick(countries, {N} % 5) END", "geo_city": f"CASE WHEN {N} % 13 > 2 THEN 'city ' || ({N} % 17) END", "geo_org": f"CASE WHEN {N} % 13 > 3 THEN 'org ' || ({N} % 8) END",
    "aws_region": f"CASE WHEN {N} % 23 > 0 THEN 'r' || ({N} % 7) END", "read_only": f"CASE {N} % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END", "error_code": f"CASE WHEN {N} % 3 = 0 THEN pick(errors, {N} % 7) END",
    "request_parameters": f"CASE WHEN {N} % 29 > 0 THEN pick(requests, {N} % 11) END", "response_elements": f"CASE {N} % 3 WHEN 0 THEN '{{\"ConsoleLogin\":\"Failure\"}}' WHEN 1 THEN '{{\"ConsoleLogin\":\"Success\"}}' END",
    "additional_event_data": f"pick(extras, {N} % 6)",
}
LISTS = {
    "sources": [s for s, _ in PAIRS], "actions": [a for _, a in PAIRS], "countries": COUNTRIES, "addresses": ["10.0.0.", "8.8.8.", "172.16.0.", "172.40.0.", "192.168.1.", "52.1.2."] + ["127.0.0."],
    "errors": ["AccessDenied", "Client.UnauthorizedAccess", "Throttling", "", "Client.UnauthorizedOperation", "RequestLimitExceeded", "Forbidden"],
    "requests": [
        '{"bucketName":"b1","key":"README_decrypt","x-amz-copy-source":"other/x"}', '{"bucketName":"b2","key":"data","copySource":"c"}', '{"modelId":"m1","enabled":true}', '{"modelId":"m2"}', '{"x":"userData","group":"All"}', '{"a":{"group":"all"},"restore":1}', '{"skipFinalSnapshot":"true","kmsKeyId":"k"}',
        '{"status":"Suspended","roleArn":"role/next"}', '{"policyEngineConfiguration":{"cedarConfiguration":{"mode":"STRICT"}},"gatewayIdentifier":"g1"}', '{"enable":false,"attributes":{"MonthlySpendLimit":"9"}}', '{"BucketLoggingStatus":{},"phoneNumber":"1"}',
    ],
    "extras": ['{"MFAUsed":"No"}', '{"MFAUsed":"Yes","success":"true"}', '{"success":"false"}', '{"federatedProvider":"okta"}', '{"SSEApplied":"SSE_C"}', "{}"],
}


def picked(sql: str, engine: int) -> str:
    """SQL with elements of LISTS, counted from 0."""

    def one(m: re.Match) -> str:
        items = ", ".join("'" + x.replace("'", "''") + "'" for x in LISTS[m[1]])
        return f"element_at(array({items}), CAST({m[2]} AS INT) + 1)" if engine == 0 else f"list_extract([{items}], CAST({m[2]} AS BIGINT) + 1)"

    return re.sub(r"pick\((\w+), ((?:\([^)]*\) )?[\w% ]+)\)", one, sql)


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as an audit trail with the actions of all charts."""
    df = timed(table(spark, sf_dir, "events"))
    return df.select(*(F.expr(picked(e, 0)).alias(c) for c, e in TRAIL.items()))


def flow_datasets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The flow datasets, each made once."""
    records = flow_records(spark, sf_dir)
    geo = places(spark, sf_dir)
    name = F.concat(F.lit("/"), F.regexp_extract("source_file", r"file=([^/]+)/", 1), F.lit("_h.log"))
    files = flows.read_flows(spark, hunt_files(spark, sf_dir, blocks=1))[1].drop("file_account", "file_region", "flow_log_id").select("*", *flows.flow_file_meta(name))
    return {
        "flow_records": D.flow_records(records, geo), "flow_log_configs": D.flow_log_configs(audit(spark, sf_dir)), "flow_sources": D.flow_sources(records, files), "flow_egress_daily": D.flow_egress_daily(records),
        "flow_internal_pairs": D.flow_internal_pairs(records), "flow_staging": D.flow_staging(records), "flow_periodicity": D.flow_periodicity(records), "flow_reject_accept": D.flow_reject_accept(records, geo),
    }


def detection_datasets(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    """The datasets of detections, and the run facts of one output; facts that it lacks are null."""
    facts = D.provenance(detections(spark, sf_dir)["meta"], path)
    return {**{name: detection_dataset(spark, sf_dir, name) for name in STATEMENTS}, "provenance": facts.select("*", *(F.lit(None).cast("string").alias(c) for c in FACTS if c not in facts.columns))}


#: Columns of run facts that charts read.
FACTS = "source_file command command_line tool_version rules_version timestamp_tz scanned_files scanned_events output_rows rules_count duplicate_rows_removed".split()
MADE = {
    "CC": lambda spark, sf_dir: {"audit_events": trail(spark, sf_dir)}, "CV": flow_datasets, "CT": lambda spark, sf_dir: detection_datasets(spark, sf_dir, "timeline"),
    "CS": lambda spark, sf_dir: detection_datasets(spark, sf_dir, "summary"), "CM": lambda spark, sf_dir: detection_datasets(spark, sf_dir, "metrics"),
}


def held(df: DataFrame, specs: Sequence[S.Spec]) -> DataFrame:
    """A dataset as some charts read it, written once: each of their scans would make it anew. Only the columns that they name."""
    read = {w for s in specs for sql in (*(d for _, d in s.dims), *(m for _, m in s.measures), s.where, s.having, s.order[1]) for w in re.findall(r"\w+", sql or "")}
    return cut(df.select(*([c for c in df.columns if c in read] or df.columns[:1])), "dataset")


def charts(spark: SparkSession, sf_dir: str, prefix: str, specs: Sequence[S.Spec]) -> DataFrame:
    """(chart, place, dims, measures) of charts of a catalogue."""
    made, out = MADE[prefix](spark, sf_dir), None
    for name in dict.fromkeys(s.dataset for s in specs):
        mine = [s for s in specs if s.dataset == name]
        df = timed(made[name])
        # Detections cost less to make than to write.
        own = run_many(held(df, mine) if prefix == "CC" else df, [ranking(s) for s in mine], WIDTH)
        out = own if out is None else out.unionByName(own)
    return out


def as_times(sql: str, columns: str) -> str:
    """A dataset's statement with texts of times as times."""
    return f"(SELECT * REPLACE ({', '.join(f'CAST({c} AS TIMESTAMP) AS {c}' for c in columns.split())}) FROM ({sql}))"


#: Datasets in DuckDB's SQL.
SOURCES = {
    "audit_events": "(SELECT " + ", ".join(f"{picked(e, 1)} AS {c}" for c, e in TRAIL.items()) + " FROM events)",
    **{name: as_times(sql, "event_time" if name.startswith("timeline") else "first_seen last_seen") for name, sql in STATEMENTS.items()},
    "flow_records": f"(WITH {RECORDS} SELECT fl AS flow_log_id, t AS start_time, z AS end_time, iface AS interface_id, inst AS instance_id, itype AS interface_type, CAST(NULL AS VARCHAR) AS resource_id, srcaddr AS flow_src, dstaddr AS flow_dst, CAST(NULL AS VARCHAR) AS pkt_srcaddr, sscope AS src_scope, dscope AS dst_scope, "
    "loc AS local_addr, rem AS remote_addr, rscope AS remote_scope, CASE WHEN way IS NOT NULL THEN 'record' WHEN outward IS NOT NULL THEN 'heuristic' ELSE 'unknown' END AS direction_source, way AS flow_direction, dstport, protocol, pname AS protocol_name, vol AS bytes_measured, action, status AS log_status, flags AS tcp_flags, "
    "CASE path WHEN 8 THEN 'Internet gateway' END AS traffic_path_label, CAST(NULL AS VARCHAR) AS pkt_dst_aws_service, reason AS reject_reason, CAST(NULL AS INTEGER) AS encryption_status, itype IS NOT NULL AS via_middlebox, CASE WHEN coalesce(srcaddr, dstaddr) LIKE '%:%' THEN 6 WHEN coalesce(srcaddr, dstaddr) IS NOT NULL THEN 4 END AS ip_version, "
    f"CASE WHEN rscope IN ('private', 'link-local') THEN upper(rscope) ELSE n_name END AS remote_geo_country_code, CAST(NULL AS VARCHAR) AS remote_geo_country_name, CAST(NULL AS VARCHAR) AS remote_geo_asn, CAST(NULL AS VARCHAR) AS remote_geo_org FROM r LEFT JOIN {AT.format('rem')} AND rscope = 'public')",
}
_FLOW = {"d11_flow_egress_daily": "day", "d12_flow_internal_pairs": "first_seen last_seen", "d13_flow_log_configs": "event_time", "d14_flow_periodicity": "first_seen last_seen", "d16_flow_reject_accept": "first_reject last_accept", "d17_flow_sources": "first_observation last_observation", "d18_flow_staging": "first_internal_in last_external_out"}
SOURCES |= {name.split("_", 1)[1]: as_times(DATASET_SQL[name], columns) for name, columns in _FLOW.items()}


def facts(path: str) -> str:
    """The run facts of an output of the detection tool."""
    known = {"command": "'count'", "source_file": f"'{path}'", "scanned_events": "count(*)", "output_rows": "count(DISTINCT user_id)"}
    return "(SELECT " + ", ".join(f"{known.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in FACTS) + " FROM events)"


def register(name: str, prefix: str, specs: list[S.Spec]) -> None:
    """One query for some charts of a catalogue, with SQL for each chart."""
    path = {"CT": "timeline", "CS": "summary", "CM": "metrics"}.get(prefix, "")
    used = dict.fromkeys(s.dataset for s in specs)
    sources = ", ".join(f"{d} AS MATERIALIZED (SELECT * FROM {facts(path) if d == 'provenance' else SOURCES[d]})" for d in used)
    QUERIES[name] = lambda spark, sf_dir: charts(spark, sf_dir, prefix, specs)
    SQL[name] = f"WITH {sources} " + " UNION ALL ".join(f"SELECT * FROM ({statement(s, s.dataset)})" for s in specs)


for _name, _prefix in (("cc_audit_charts", "CC"), ("cv_flow_charts", "CV"), ("ct_timeline_charts", "CT"), ("cs_summary_charts", "CS"), ("cm_metrics_charts", "CM")):
    register(_name, _prefix, S.catalogue(_prefix))
register("cc_rare_charts", "CC", [s.rare() for s in S.catalogue("CC") if s.rankable])

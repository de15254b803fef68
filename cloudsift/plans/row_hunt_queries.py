"""The row hunts of the audit trail with all of their columns, over a trail in which each condition is met and nearly met."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.plans import row_hunts
from cloudsift.plans.chart_queries import LISTS, TRAIL, picked, timed
from cloudsift.plans.events import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def named_in(text: str) -> list[str]:
    """Services and actions that a condition names."""
    return re.findall(r"'([\w-]+\.amazonaws\.com|[A-Z]\w+)'", text)


def pairs() -> list[tuple[str, str]]:
    """(source, action) of every action of a row hunt: of its own lists, and of its condition."""
    out = []
    for h in row_hunts.HUNTS.values():
        out += [(f"{s}.amazonaws.com", a) for s in (h.sources or ("app",))[:2] for a in h.actions]
        source = f"{h.sources[0]}.amazonaws.com" if h.sources else "app.amazonaws.com"
        out += [(source, "AnyAction")] if not h.actions and not h.condition else []
        for name in [] if h.actions else named_in(h.condition):
            source, own = (name, None) if name.endswith(".com") else (source, name)
            out += [(source, own)] if own else []
    # Actions of hunts with a further condition come four times, as only some of their events meet it.
    return list(dict.fromkeys(out)) + 3 * [(f"{(h.sources or ('app',))[0]}.amazonaws.com", a) for h in row_hunts.HUNTS.values() if h.condition for a in h.actions]


PAIRS = pairs()
# JSON texts in which conditions hold and in which they nearly do.
LISTS |= {
    "row_sources": [s for s, _ in PAIRS], "row_actions": [a for _, a in PAIRS],
    "row_requests": [
        '{"type":"SERVICE_CONTROL_POLICY","name":"n"}', '{"type":"TAG_POLICY","userData":"aGk="}', '{"groupName":"Admins","userName":"u1"}', '{"groupName":"readers","roleName":"u2","userData":"aGk="}', '{"allowUnauthenticatedIdentities":true}', '{"allowUnauthenticatedIdentities":false}',
        '{"c":{"blockPublicAcls":false,"ignorePublicAcls":true}}', '{"c":{"blockPublicAcls":true}}', '{"attributeName":"restore","valuesToAdd":["all"]}', '{"skipFinalSnapshot":"true","publiclyAccessible":true}', '{"skipFinalSnapshot":"false","publiclyAccessible":false}',
        '{"status":"Suspended"}', '{"BucketLoggingStatus":{}}', '{"LoggingEnabled":{}}', '{"x":["all"],"kmsKeyId":"k"}', '{"group":"ALL"}', '{"x-amz-server-side-encryption-customer-algorithm":"AES256","key":"k"}', '{"key":"how-to_decrypt.txt","bucketName":"b"}', '{"key":"notes.txt"}',
        '{"masterUserPassword":"x","userData":"aGk="}', '{"x-amz-copy-source":"a/b"}', '{"userData":"aGk="}', '{"roleArn":"arn:aws:iam::111111111110:role/r","roleSessionName":"s"}',
    ],
    "row_extras": ['{"MFAUsed":"No"}', '{"MFAUsed":"Yes"}', '{"SSEApplied":"SSE_C"}', '{"federatedProvider":"okta"}', '{"credentialId":"c"}'],
    "row_agents": ["cli/1", "console.aws.amazon.com", "signin.amazonaws.com", "boto3/1"],
}
N = "event_id"
ROW_TRAIL = TRAIL | {
    "event_time": "date_trunc('second', ts)", "event_source": f"pick(row_sources, {N} % {len(PAIRS)})", "event_name": f"pick(row_actions, {N} % {len(PAIRS)})", "user_identity_arn": f"CASE WHEN {N} % 2 = 0 THEN 'user/u' || ({N} % 3) ELSE 'user/' || user_id END", "user_identity_type": f"CASE user_id % 5 WHEN 0 THEN 'Root' WHEN 1 THEN 'AssumedRole' WHEN 2 THEN 'AssumedRole' ELSE 'IAMUser' END",
    "request_parameters": f"CASE WHEN {N} % 31 > 0 THEN pick(row_requests, ({N} + user_id) % 23) END", "additional_event_data": f"CASE WHEN {N} % 7 > 0 THEN pick(row_extras, {N} % 5) END", "user_agent": f"pick(row_agents, {N} % 4)",
    "response_elements": f"CASE WHEN {N} % 2 = 0 THEN '{{\"publicIp\":\"9.9.9.9\",\"keyFingerprint\":\"aa:bb\"}}' END", "session_credential_from_console": f"CASE {N} % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END", "event_id": f"CAST({N} AS VARCHAR(20))",
}


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as an audit trail for the row hunts."""
    df = timed(table(spark, sf_dir, "events"))
    return df.select(*(F.expr(picked(e, 0)).alias(c) for c, e in ROW_TRAIL.items()))


def duck(sql: str) -> str:
    """A condition of a row hunt in DuckDB's SQL."""
    sql = re.sub(r"get_json_object\((\w+), (?:'\$\.([\w.]+)'|\"\$\['([\w-]+)'\]\")\)", lambda m: f"json_extract_string({m[1]}, '$.{m[2]}')" if m[2] else f"json_extract_string({m[1]}, '$.\"{m[3]}\"')", sql)
    sql = re.sub(r"(upper\(json_extract_string\([^)]*\)\)|\w+) rlike ('[^']*')", r"regexp_matches(\1, \2)", sql)
    return sql.replace("endswith(", "ends_with(")


def where_of(h: row_hunts.RowHunt) -> str:
    """The whole condition of a row hunt in DuckDB's SQL."""
    parts = []
    if h.sources:
        parts.append("event_source IN (" + ", ".join(f"'{s}.amazonaws.com'" for s in h.sources) + ")")
    if h.actions:
        parts.append("event_name IN (" + ", ".join(f"'{a}'" for a in h.actions) + ")")
    return " AND ".join([*parts, *([f"({duck(h.condition)})"] if h.condition else [])])


def value_of(column: str, path: str) -> str:
    """A value out of JSON in DuckDB's SQL."""
    step = path.removeprefix("$.")
    quoted = path if path.startswith("$[") and "'" not in path else "$" + re.sub(r"\['([^']*)'\]", r'."\1"', path[1:]) if path.startswith("$[") else "$." + ".".join(f'"{p}"' if "-" in p else p for p in step.split("."))
    return f"json_extract_string({column}, '{quoted}')"


def report(h: row_hunts.RowHunt) -> str:
    """The rows of a row hunt in DuckDB's SQL, its named columns as one text."""
    values = " || '|' || ".join(f"coalesce({v}, '-')" for v in [*(f"CAST({c} AS VARCHAR)" for c in row_hunts.KEEP if c not in {"event_id"}), *(value_of(*p) for p in h.paths.values())])
    return f"SELECT '{h.id}' AS hunt, event_id, {values} AS hit FROM trail WHERE {where_of(h)}"


_SOURCE = "WITH trail AS MATERIALIZED (SELECT " + ", ".join(f"{picked(e, 1)} AS {c}" for c, e in ROW_TRAIL.items()) + " FROM events)"


def row_hunt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-37, O-41, H001 to H139: every row that a row hunt hits, with the hunt's columns, from one scan of the trail."""
    return row_hunts.every_hit(trail(spark, sf_dir))


def row_hunt_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41: hits and severity of every row hunt in one pass."""
    return row_hunts.bulk(trail(spark, sf_dir))


QUERIES |= {"row_hunt_rows": row_hunt_rows, "row_hunt_hits": row_hunt_hits}
SQL |= {
    "row_hunt_rows": f"{_SOURCE} " + " UNION ALL ".join(map(report, row_hunts.HUNTS.values())),
    "row_hunt_hits": f"{_SOURCE} " + " UNION ALL ".join(f"SELECT '{h.id}' AS label, '{h.severity}' AS severity, count(*) AS hits FROM trail WHERE {where_of(h)}" for h in row_hunts.HUNTS.values()),
}

# The plain trail of o41_row_hunts, in which many columns are null.
_PLAIN = [(f"{h.sources[0]}.amazonaws.com" if h.sources else "app.amazonaws.com", a) for h in row_hunts.HUNTS.values() for a in h.actions]
_ITEM = lambda i: "list_extract([" + ", ".join(f"'{p[i]}'" for p in _PLAIN) + f"], event_id % {len(_PLAIN)} + 1)"
_NULLS = "additional_event_data user_agent session_credential_from_console user_identity_account_id recipient_account_id session_issuer_arn vpc_endpoint_id user_identity_access_key_id geo_country_code response_elements".split()
SQL["o41_row_hunts"] = (
    f"WITH trail AS MATERIALIZED (SELECT {_ITEM(0)} AS event_source, {_ITEM(1)} AS event_name, props AS request_parameters, 'user/' || user_id AS user_identity_arn, CASE WHEN user_id = 7 THEN 'Root' ELSE 'IAMUser' END AS user_identity_type, "
    "CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code, event_type = 'view' AS read_only, " + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _NULLS) + " FROM events) "
) + " UNION ALL ".join(f"SELECT '{h.id}' AS label, '{h.severity}' AS severity, count(*) AS hits FROM trail WHERE {where_of(h)}" for h in row_hunts.HUNTS.values())

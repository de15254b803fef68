"""Datasets and places on small hand-made rows."""

import ipaddress
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cloudsift.functions import net
from cloudsift.operators import enrich
from cloudsift.plans import datasets as D
from cloudsift.plans import flow_hunts as V
from cloudsift.sources import flows

FIELDS = "srcaddr dstaddr dstport protocol bytes start end action log-status flow-direction interface-id interface-type encryption-status reject-reason"
START = 1_704_067_200


def read(spark, path, lines):
    (path / "123456789012_vpcflowlogs_us-east-1_fl-9_20240101T0000Z_ab.log").write_text("\n".join([FIELDS, *lines]))
    records, files, _ = flows.read_flows(spark, str(path))
    return records.withColumn("flow_log_id", F.lit("fl-9")), files


def test_digits_of_addresses(spark):
    texts = ["::", "::1", "2001:db8::8:800:200c:417a", "FE80:0:0:0:1:2:3:4", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "10.0.0.1", "1:2:3", "g::", "1::2::3", "::1.2.3.400", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ip string").select("i", net.ip6_digits(F.col("ip")).alias("d")).collect()

    def want(t):
        try:
            return f"{int(ipaddress.IPv6Address(t)):032x}"
        except ValueError:
            return None

    assert {r.i: r.d for r in rows} == {i: want(t) if t is not None else None for i, t in enumerate(texts)}


def test_ranges_of_any_borders(spark):
    pad = lambda x: x.ljust(32, "0")
    ranges = [(pad("2a"), pad("2a"), "one"), ("2a" + "0" * 29 + "1", "2a1" + "f" * 29, "wide"), (pad("2a2"), "2aff" + "f" * 28, "rest")]
    df = spark.createDataFrame(ranges, "low string, high string, country string")
    own = spark.createDataFrame([("2a00::",), ("2a00::1",), ("2a1f:ffff::",), ("2a20::",), ("2b00::",), (None,), ("8.8.8.8",)], "ip string")
    v4 = spark.createDataFrame([(0, 2**32 - 1, "four")], "low long, high long, country string")
    found = {r.ip: r.country for r in enrich.geo_lookup(own, v4, ranges6=df).collect()}
    assert found == {"2a00::": "one", "2a00::1": "wide", "2a1f:ffff::": "wide", "2a20::": "rest", "2b00::": None, "8.8.8.8": "four"}


def test_new_fields_and_records(spark, tmp_path):
    line = f"10.0.0.1 8.8.8.8 443 6 500 {START} {START + 60} ACCEPT OK egress eni-1"
    records, files = read(spark, tmp_path, [f"{line} nat_gateway 1 -", f"{line} - x BPA"])
    geo = spark.createDataFrame([("8.8.8.8", "US", "37.5")], "ip string, country string, latitude string")
    first, second = D.flow_records(records, geo).orderBy(F.desc("via_middlebox")).collect()
    assert (first.via_middlebox, first.encryption_status, first.bytes_measured, first.remote_geo_country_code, first.remote_geo_latitude, first.remote_geo_org) == (True, 1, 500, "US", "37.5", None)
    assert (second.via_middlebox, second.encryption_status, second.bytes_measured, second.has_parse_issue) == (False, None, None, True)
    source = D.flow_sources(records, files).collect()[0]
    assert (source.account_ids, source.regions, source.files, source.rows_total, source.rows_with_issues, source.interfaces_seen) == ("123456789012", "us-east-1", 1, 2, 1, 1)


def test_flow_seen_on_two_interfaces_is_one(spark, tmp_path):
    line = lambda action, eni, n: f"10.0.0.1 8.8.8.8 443 6 {n} {START} {START + 60} {action} OK egress {eni} - - -"
    records, _ = read(spark, tmp_path, [line("ACCEPT", "eni-1", 5), line("REJECT", "eni-2", 9)])
    row = flows.flow_unique(records).collect()[0]
    assert (row.observation_count, row.bytes, row.interface_ids) == (2, 9, "eni-1,eni-2")


def test_skipped_windows_count_though_they_have_no_port(spark, tmp_path):
    beat = [f"10.0.0.1 8.8.8.8 443 6 {100 + i % 2} {START + i * 3600} {START + i * 3600 + 60} ACCEPT OK egress eni-1 - - -" for i in range(30)]
    skip = f"- - - - - {START + 7200} {START + 7260} - SKIPDATA - eni-1 - - -"
    records, _ = read(spark, tmp_path, [*beat, skip])
    row = D.flow_periodicity(records).collect()[0]
    assert (row.active_buckets, row.period_secs, row.jitter, row.skipdata_overlaps, row.confidence, row.protocol_name, row.active_bucket_ratio) == (30, 3600, 0, 1, "medium", "TCP", 1)
    assert abs(row.bytes_cv - 0.5 / 100.5) < 1e-9
    assert V.v011_periodic(records).collect()[0].confidence == "medium"


def test_baselines_are_of_earlier_days(spark, tmp_path):
    day = [f"10.0.0.1 8.8.8.8 443 6 {n} {START + d * 86400} {START + d * 86400 + 60} ACCEPT OK egress eni-1 - - -" for d, n in enumerate((0, 10, 30))]
    records, _ = read(spark, tmp_path, day)
    rows = D.flow_egress_daily(records).orderBy("day").collect()
    assert [(r.egress_bytes, r.baseline_bytes, r.baseline_days, r.ratio_to_baseline) for r in rows] == [(0, None, 0, None), (10, 0, 1, None), (30, 5, 2, 6)]


def test_subscriptions(spark):
    at = datetime(2024, 1, 1)
    own = [
        (at, "CreateFlowLogs", "ec2.amazonaws.com", '{"TrafficType":"REJECT","ResourceIds":["vpc-12ab","eni-9"],"logFormat":""}', '{"ids":["fl-0a1"]}'),
        (at + timedelta(1), "DeleteFlowLogs", "ec2.amazonaws.com", '{"x":"fl-0b2"}', None),
        (at, "CreateFlowLogs", "other.amazonaws.com", None, None),
        (at, "DeleteFlowLogs", "ec2.amazonaws.com", None, None),
    ]
    df = spark.createDataFrame(own, "event_time timestamp, event_name string, event_source string, request_parameters string, response_elements string")
    df = df.withColumns({c: F.lit("c") for c in ("recipient_account_id", "aws_region", "user_identity_arn", "error_code")})
    rows = D.flow_log_configs(df).collect()
    assert sorted((r.flow_log_id or "", r.traffic_type, r.resource_ids, r.log_format) for r in rows) == [("", None, None, None), ("fl-0a1", "REJECT", "vpc-12ab, eni-9", None), ("fl-0b2", None, "", None)]


def test_identities_without_calls_have_zeros(spark):
    at = datetime(2024, 1, 1, 23)
    summary = spark.createDataFrame([("a", ["x"], 3, at, at + timedelta(hours=2)), ("b", None, 1, at, at)], "UserARN string, UserTypes array<string>, NumOfEvents long, FirstTimestamp timestamp, LastTimestamp timestamp")
    calls = spark.createDataFrame([("a", True, "success", "Run", 4), ("a", None, "success", "No", 9), ("a", False, "failed", "Run", 2)], "UserARN string, IsAbused boolean, Outcome string, API string, Count long")
    values = spark.createDataFrame([("a", "SrcIP", "1"), ("a", "SrcIP", "1"), ("a", "AwsRegion", None)], "UserARN string, Attribute string, Value string")
    rows = {r.user_arn: r for r in D.identities(summary, calls, values).collect()}
    assert (rows["a"].abused_success, rows["a"].other_success, rows["a"].other_failed, rows["a"].abused_apis, rows["a"].distinct_src_ips, rows["a"].distinct_regions, rows["a"].active_days) == (4, 0, 2, 1, 1, 0, 1)
    assert (rows["b"].abused_success, rows["b"].abused_apis, rows["b"].distinct_src_ips) == (0, 0, 0)

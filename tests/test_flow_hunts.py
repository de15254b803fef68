"""Flow hunts: a planted positive hits, near misses don't, and counts don't stop at a report's limit."""

from pathlib import Path

import duckdb
import pytest

from cloudsift.plans import flow_hunts, hunts
from cloudsift.sources import flows

DATA = Path("/root/testdata/sf0.01")
COLUMNS = "flow_log_id string, interface_id string, srcaddr string, dstaddr string, pkt_srcaddr string, pkt_dstaddr string, dstport int, protocol int, protocol_name string, bytes long, start long, end long, action string, log_status string, tcp_flags int, flow_direction string, reject_reason string, direction_source string, local_addr string, remote_addr string, local_scope string, remote_scope string, src_scope string, dst_scope string, duration long, instance_id string, traffic_path int"
DAY = 86_400


def flow(local="10.0.0.1", remote="8.8.8.8", way="egress", port=443, at=0, **more):
    src, dst = (remote, local) if way == "ingress" else (local, remote)
    scope = lambda ip: "private" if ip.startswith("10.") else "public"
    row = {"flow_log_id": "fl", "interface_id": "eni", "srcaddr": src, "dstaddr": dst, "dstport": port, "protocol": 6, "protocol_name": "TCP", "bytes": 10, "start": at, "end": at + 60, "action": "ACCEPT", "log_status": "OK", "flow_direction": way, "direction_source": "record"}
    return row | {"local_addr": local, "remote_addr": remote, "local_scope": scope(local), "remote_scope": scope(remote), "src_scope": scope(src), "dst_scope": scope(dst), "duration": 60} | more


def inbound(**more):
    return flow(way="ingress", **more)


def beats(n, gap, **more):
    return [flow(at=i * gap, **more) for i in range(n)]


NONE = {"local_addr": None, "remote_addr": None, "local_scope": None, "remote_scope": None}
SKIP = {"log_status": "SKIPDATA", "local_addr": None, "remote_addr": None, "local_scope": None, "remote_scope": None}
#: id: (rows that hit, near misses, the column that names a row, the names of the rows found).
CASES = {
    "V001": ([flow()], [], "flow_log_id", ["fl"]),
    "V002": ([flow(interface_id="a", **SKIP)], [flow(interface_id="b", **SKIP | {"log_status": "NODATA"})], "interface_id", ["a"]),
    "V003": ([inbound(port=p) for p in range(20)], [inbound(remote="8.8.4.4", port=p) for p in range(19)] + [inbound(remote="10.9.9.9", port=p) for p in range(20)], "remote_addr", ["8.8.8.8"]),
    "V004": ([inbound(local=f"10.0.0.{i}") for i in range(10)], [inbound(remote="8.8.4.4", local=f"10.0.0.{i}") for i in range(9)], "remote_addr", ["8.8.8.8"]),
    "V005": ([inbound(port=22)], [inbound(port=443, remote="1.1.1.1"), inbound(port=22, remote="1.1.1.2", action="REJECT"), inbound(port=22, remote="10.1.1.1"), flow(port=22, remote="1.1.1.3")], "remote_addr", ["8.8.8.8"]),
    "V006": ([inbound(action="REJECT"), inbound(at=1)], [inbound(remote="1.1.1.1", at=1, action="REJECT"), inbound(remote="1.1.1.1")], "remote_addr", ["8.8.8.8"]),
    "V007": ([flow(), flow(at=DAY, bytes=100)], [flow(local="10.0.0.2"), flow(local="10.0.0.2", at=DAY, bytes=99), flow(local="10.0.0.3"), flow(local="10.0.0.3", at=DAY, bytes=100, reject_reason="BPA")], "local_addr", ["10.0.0.1"]),
    "V008": ([flow(port=4444)], [flow(port=4443), flow(port=3333, remote="1.1.1.1", action="REJECT")], "remote_addr", ["8.8.8.8"]),
    "V009": ([flow(port=53), flow(port=53, remote="169.254.169.253")], [flow(port=54, remote="1.1.1.1"), inbound(port=53, remote="1.1.1.2")], "remote_addr", ["169.254.169.253", "8.8.8.8"]),
    "V010": ([flow(port=25)], [flow(port=26, local="10.0.0.2"), flow(port=25, local="10.0.0.3", remote="10.1.1.1")], "local_addr", ["10.0.0.1"]),
    "V011": (beats(10, 7200) + [flow(at=3600 + i * 7200, interface_id="eni2") for i in range(10)], beats(19, 3600, local="10.0.0.2") + beats(720, 60, local="10.0.0.3") + beats(20, 1800, local="10.0.0.4") + beats(20, 3600, local="10.0.0.5", log_status="NODATA"), "local_addr", ["10.0.0.1"]),
    "V012": ([flow(remote="10.2.0.1", port=445, at=DAY, flow_direction=None, direction_source="unknown", **NONE)], [flow(at=0), flow(remote="10.2.0.1", local="10.0.0.2", port=445, at=0), flow(remote="10.2.0.1", local="10.0.0.3", port=5432, at=DAY)], "flow_src", ["10.0.0.1"]),
    "V013": ([inbound(remote="10.2.0.1"), flow(at=1)], [inbound(remote="10.2.0.1", local="10.0.0.2", at=1), flow(local="10.0.0.2", at=1), inbound(remote="10.2.0.1", local="10.0.0.3"), flow(local="10.0.0.3", at=1, action="REJECT")], "host", ["10.0.0.1"]),
    "V014": ([flow(protocol=47)], [flow(protocol=6), flow(protocol=47, local="10.0.0.2", log_status="NODATA")], "flow_src", ["10.0.0.1"]),
    "V015": ([flow(protocol=17, remote=f"8.8.8.{i}") for i in range(20)], [flow(protocol=17, local="10.0.0.2", remote=f"8.8.8.{i}") for i in range(19)] + [flow(local="10.0.0.3", remote=f"8.8.8.{i}") for i in range(20)], "flow_src", ["10.0.0.1"]),
    "V016": ([flow(protocol=58)], [flow(protocol=2, local="10.0.0.2"), flow(protocol=1, local="10.0.0.3", log_status="NODATA")], "flow_src", ["10.0.0.1"]),
    "V017": ([inbound()], [inbound(remote="10.2.0.1"), inbound(remote="1.1.1.1"), inbound(remote="8.8.4.4", action="REJECT"), flow(remote="8.8.4.4")], "country_code", ["X"]),
    "V018": ([flow(reject_reason="BPA")], [flow(action="REJECT")], "reject_reason", ["BPA"]),
}


def records(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLUMNS).selectExpr("*", "timestamp_seconds(start) AS start_time", "timestamp_seconds(end) AS end_time")


@pytest.mark.parametrize("key", sorted(flow_hunts.HUNTS))
def test_planted(spark, key):
    hits, misses, column, want = CASES[key]
    geo = spark.createDataFrame([("8.8.8.8", "X", None), ("8.8.4.4", "Y", None), ("10.2.0.1", "PRIVATE", None)], "ip string, country string, org string")
    hunt, wants_geo = flow_hunts.HUNTS[key][2:]
    run = lambda rows, **more: [r[column] for r in (hunt(records(spark, rows), geo, **more) if wants_geo else hunt(records(spark, rows), **more)).collect()]
    assert run(hits + misses, limit=None) == want
    if misses:
        assert run(misses, limit=None) == []


def test_limit_is_the_report_s(spark):
    df = records(spark, [flow(protocol=47, local=f"10.0.{i}.1") for i in range(130)])
    assert flow_hunts.v014_odd_protocols(df).count() == 100 and flow_hunts.v014_odd_protocols(df, limit=None).count() == 130


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_derived_flows_hit_and_miss():
    """By the SQL alone: every hunt finds rows, and none finds all groups."""
    db = duckdb.connect()
    for t in ("events", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    hits = dict(db.execute(hunts.SQL["flow_hits"]).fetchall())
    assert len(hits) == 18 and all(hits.values())
    names = {label: {r[0] for r in db.execute(f"SELECT name FROM ({hunts.SQL['flow_rows']}) WHERE label = '{label}'").fetchall()} for label in ("V003", "V004", "V010", "V013", "V015")}
    assert all(n.startswith("8.8.") for n in names["V003"]) and all(n.startswith("9.9.") for n in names["V004"]) and not any(n.split("|")[0].endswith(".3") for n in names["V010"])
    assert {n.split("|")[0] for n in names["V013"]} == {f"10.9.0.{i}" for i in range(5)} and all(n.startswith("10.11.") for n in names["V015"])


def test_confidence_and_skipped_windows(spark):
    rows = beats(20, 3600) + beats(20, 3600, local="10.0.0.2", interface_id="b") + [flow(interface_id="b", at=7200, **SKIP)]
    got = {r.local_addr: (r.period_secs, r.active_buckets, r.jitter, r.skipdata_overlaps, r.confidence) for r in flow_hunts.v011_periodic(records(spark, rows)).collect()}
    assert got == {"10.0.0.1": (3600, 20, 0, 0, "high"), "10.0.0.2": (3600, 20, 0, 1, "medium")}


@pytest.mark.parametrize("key", ["V005", "V011", "V012", "V013"])
def test_plans_on_unwritten_records_stay_small(spark, tmp_path, key):
    (tmp_path / "a.log").write_text("2 1 eni-a 10.0.0.1 10.0.0.2 5 22 6 1 10 100 160 ACCEPT OK\n2 1 eni-a 10.0.0.1 10.0.0.2 5 445 6 1 10 90000 90060 ACCEPT OK\n")
    df, _, _ = flows.read_flows(spark, str(tmp_path))
    geo = spark.createDataFrame([], "ip string, country string, org string")
    hunt, wants_geo = flow_hunts.HUNTS[key][2:]
    out = hunt(df, geo) if wants_geo else hunt(df)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 250_000
    assert [r.flow_src for r in out.collect()] == ["10.0.0.1"] if key == "V012" else out.count() == 0

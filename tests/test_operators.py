"""Planted rows and near misses for what SQL on the driver tables does not reach."""

import gzip
import random
import statistics
import time
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from cloudsift.functions import net
from cloudsift.operators import combine, enrich, graph, group, shape
from cloudsift.plans import catalogue
from cloudsift.sources import audit, config, flows, ledger

DATA = Path("/root/testdata/sf0.01")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_unknown_severity(spark):
    df = spark.createDataFrame([("high", datetime(2024, 1, 1)), (None, datetime(2024, 1, 2))], "Level string, Timestamp timestamp")
    with pytest.raises(ValueError, match="unknown"):
        shape.apply_filters(df, shape.TIMELINE, levels=["grave"])
    assert shape.apply_filters(df, shape.TIMELINE, levels=shape.SEVERITIES).count() == 2
    assert shape.apply_filters(df, shape.TIMELINE, levels=["high"]).count() == 1
    assert shape.apply_filters(df, shape.TIMELINE, end=date(2024, 1, 1)).count() == 1


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert combine.not_in(left, "a", spark.createDataFrame([(1,)], "b int")).count() == 1
    assert combine.not_in(left, "a", spark.createDataFrame([(1,), (None,)], "b int")).count() == 0
    assert combine.not_in(left, "a", spark.createDataFrame([], "b int")).count() == 3


@pytest.fixture
def cut_by_size(spark):
    """Spark cuts the shuffles of a plan by their sizes, as it does with large tables."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    kept = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranges_keep_their_points_however_spark_cuts_them(spark, cut_by_size):
    df = spark.range(60_000).select((F.col("id") * 7919 % 1013).alias("k"), (F.col("id") * 104_729 % 50_021).alias("t"), F.col("id") % 3 == 0)
    df = df.toDF("k", "t", "point").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    ranges = df.filter(~F.col("point")).groupBy("k").agg(F.min("t").alias("start"), F.max("t").alias("stop")).withColumn("stop", F.col("stop") - F.coalesce("k", F.lit(0)) * 20)
    got = rows(combine.in_ranges(df.filter("point"), ranges, ["k"], "t", "start", "stop").filter("k is not null"), "k", "points")
    points = {}
    for r in df.filter("point").collect():
        points.setdefault(r.k, []).append(r.t)
    assert got == sorted((r.k, sum(r.start <= t <= r.stop for t in points.get(r.k, []))) for r in ranges.filter("k is not null").collect())


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_errors_between_purchases_however_spark_cuts_them(spark, cut_by_size):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = db.execute(catalogue.oracle_sql()["o47_in_ranges"]).fetchall()
    assert rows(catalogue.queries()["o47_in_ranges"](spark, str(DATA)), "user_id", "points") == sorted(want)


def test_ranges_that_are_equal_empty_or_without_a_key(spark):
    ranges = spark.createDataFrame([("a", 1, 3, "x"), ("a", 1, 3, "x"), ("a", 1, 3, "y"), ("a", 3, 5, "z"), ("a", 5, 1, "z"), ("a", None, 5, "n"), ("b", 1, 9, "x"), (None, 1, 9, "x")], "k string, lo int, hi int, tag string")
    points = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", 6), ("a", None), (None, 2), ("c", 2)], "k string, at int")
    found = combine.in_ranges(points, ranges, ["k"], "at", "lo", "hi")
    assert found.columns == ["k", "lo", "hi", "tag", "points"]
    n = {("a", 1, 3): 3, ("a", 3, 5): 2}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((*r, n.get(tuple(r)[:3], 0)) for r in ranges.collect()), key=str)


def test_addresses(spark):
    seen = ["127.0.0.1", "10.1.2.3", "172.15.0.1", "172.31.9.9", "169.254.1.1", "224.0.0.1", "203.0.113.9", "8.8.8.8", "300.1.1.1", "::1", "fd00::1", "fe80::1", "2001:db8::1", "ff02::1", "host", "::"]
    df = spark.createDataFrame([(x,) for x in seen], "ip string")
    got = [r.c for r in df.select(net.ip_class(F.col("ip")).alias("c")).collect()]
    assert got == ["LOOPBACK", "PRIVATE", None, "PRIVATE", "LINK-LOCAL", "SPECIAL", "SPECIAL", None, None, "LOOPBACK", "PRIVATE", "LINK-LOCAL", None, "SPECIAL", None, "SPECIAL"]
    scopes = [r.s for r in df.select(net.address_scope(F.col("ip")).alias("s")).collect()]
    assert scopes[7] == "public" and scopes[8] is None and scopes[12] == "public"


def test_audit_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"Records":[{"eventTime":"2024-01-01T00:00:00Z","eventName":"A","eventID":"1","userIdentity":{"type":"Root","sessionContext":{"attributes":{"mfaAuthenticated":true}}},"requestParameters":{"x":{"y":1}},"managementEvent":"true"}]}')
    (tmp_path / "bad.json").write_text("nope")
    events, errors = audit.read_audit(spark, str(tmp_path))
    (row,) = events.collect()
    assert (row.event_name, row.user_identity_type, row.session_mfa_authenticated, row.management_event, row.aws_region) == ("A", "Root", "true", True, "")
    assert row.request_parameters == '{"x":{"y":1}}' and str(row.event_date) == "2024-01-01"
    assert errors.count() == 1


def test_flow_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2 1 eni-a 10.0.0.1 8.8.8.8 5 443 6 1 10 100 160 ACCEPT OK\n2 1 eni-a - - - - - - - 100 160 - NODATA\nshort line\n")
    (tmp_path / "b.log").write_text("\nsrcaddr dstaddr bytes mystery flow-direction\n8.8.4.4 10.0.0.2 x hello ingress\n")
    records, files, issues = flows.read_flows(spark, str(tmp_path))
    got = {r.srcaddr: r for r in records.collect()}
    assert got["10.0.0.1"].local_scope == "private" and got["10.0.0.1"].remote_scope == "public" and got["10.0.0.1"].protocol_name == "TCP"
    assert got["8.8.4.4"].extra == '{"mystery":"hello"}' and got["8.8.4.4"].has_parse_issue and got["8.8.4.4"].direction_source == "record"
    assert got[None].direction_source == "unknown"
    assert sorted((r.total, r.valid, r.rejected, r.warn) for r in files.collect()) == [(1, 1, 0, False), (3, 2, 1, True)]
    assert sorted((r.kind, r.field) for r in issues.collect()) == [("field", "bytes"), ("row", None)]


def test_snapshots(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"configSnapshotId":"s1","configurationItems":[{"resourceId":"vpc-1","resourceType":"AWS::EC2::VPC","awsRegion":"r","awsAccountId":"1","configurationItemCaptureTime":"2024-01-01T00:00:00Z","configuration":{"a":1},"tags":{"t":"v"},"relationships":[]},'
        '{"resourceId":"i-1","resourceType":"AWS::EC2::Instance","awsRegion":"r","awsAccountId":"1","configurationItemCaptureTime":"2024-01-02T00:00:00Z","configuration":{},"tags":{},"relationships":[{"resourceId":"vpc-1","resourceType":"AWS::EC2::VPC","name":"Is contained in Vpc "},{"resourceId":"gone","resourceType":"x","name":"Is attached to "}]}]}'
    )
    snapshots, resources, edges = config.read_snapshots(spark, str(tmp_path))
    assert rows(snapshots, "snapshot_id", "record_count") == [("s1", 2)]
    got = {r.resource_id: r for r in resources.collect()}
    assert got["vpc-1"].configuration == '{"a":1}' and got["i-1"].tags is None and got["i-1"].configuration is None
    assert rows(edges, "source_id", "target_id", "name") == [("i-1", "vpc-1", "Is contained in Vpc")]
    assert rows(config.to_import(snapshots, snapshots, resources.limit(0)), "snapshot_id") == [("s1",)]
    nodes, _ = graph.build_graph(resources, edges)
    assert {r.resource_id: (r.parent_id, r.depth) for r in nodes.collect()} == {"vpc-1": (None, 0), "i-1": ("vpc-1", 1)}


def test_zones_and_folding(spark):
    kind = "AWS::EC2::"
    resources = spark.createDataFrame(
        [("s", "v", f"{kind}VPC", None, None), ("s", "a", f"{kind}Subnet", None, '{"availabilityZone":"z1"}'), ("s", "b", f"{kind}Subnet", None, '{"availabilityZone":"z2"}'), ("s", "rt", f"{kind}RouteTable", None, None), ("s", "x", f"{kind}SubnetRouteTableAssociation", None, None)],
        "snapshot_id string, resource_id string, resource_type string, resource_name string, configuration string",
    )
    edges = spark.createDataFrame([("s", "a", "v", "Is contained in Vpc"), ("s", "b", "v", "Is contained in Vpc"), ("s", "rt", "v", "Is contained in Vpc"), ("s", "x", "a", "Is associated with"), ("s", "x", "rt", "Is associated with"), ("s", "rt", "a", "Contains Subnet")], "snapshot_id string, source_id string, target_id string, name string")
    nodes, links = graph.build_graph(resources, edges)
    got = {r.resource_id: (r.parent_id, r.depth) for r in nodes.collect()}
    assert got["a"] == ("__az__v__z1", 2) and got["rt"] == ("v", 1) and "x" not in got
    assert ("a", "rt", "route table") in rows(links, "source_id", "target_id", "name")


def test_ledger(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "file_path string, sha256 string")
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "file_path string, sha256 string")
    left = ledger.pending(found, old)
    assert rows(left, "file_path") == [("b",), ("c",)]
    assert rows(ledger.marked(old, left), "file_path", "sha256") == [("a", "1"), ("b", "2"), ("c", "1")]
    have = spark.createDataFrame([("1", "f"), ("2", "f")], "event_id string, source_file string")
    fresh = spark.createDataFrame([("2", "f"), ("3", "f"), (None, "f")], "event_id string, source_file string")
    assert ledger.appended(have, fresh).count() == 5 and ledger.replaced(have, fresh).count() == 3
    assert ledger.appended(have, fresh.unionByName(fresh), "event_id").count() == 5


def test_boundaries(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 30), datetime(2024, 1, 1, 0, 1, 10))], "a timestamp, b timestamp")
    assert df.select(group.boundaries(F.col("a"), F.col("b"), "minute")).first()[0] == 1


def test_first_of_skips_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "b", 2), (1, "a", 2)], "g int, v string, t int")
    assert df.groupBy("g").agg(group.first_of("v", "t").alias("v")).first().v == "a"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a string, b string, ts timestamp")
    assert group.fan_out(empty, "a", "b").count() == 0
    assert combine.co_occurrence(empty, "a", F.date_trunc("hour", "ts"), "b").count() == 0
    assert group.periodicity(empty, ["a"], "ts").count() == 0
    assert shape.coverage_gaps(empty, ["a"]) == ["<empty>"]


def test_long_chains_and_cycles_of_containers(spark):
    chain = [("s", f"n{i}", f"n{i + 1}") for i in range(40)] + [("s", "a", "b"), ("s", "b", "a")]
    got = {(r.resource_id, r.ancestor_id): r.distance for r in graph.ancestors(spark.createDataFrame(chain, "snapshot_id string, resource_id string, parent_id string")).collect()}
    assert got[("n0", "n40")] == 40 and len(got) == 40 * 41 // 2 + 2 and got[("a", "b")] == 1


def test_all_issues_are_kept_unless_bounded(spark, tmp_path):
    (tmp_path / "a.log").write_text("broken line\n" * 150 + "2 1 eni-a 10.0.0.1 8.8.8.8 x 443 6 y 10 100 160 ACCEPT OK\n")
    begun = time.perf_counter()
    issues = flows.read_flows(spark, str(tmp_path))[2].collect()
    assert sorted((r.kind, r.field or "", r.line) for r in issues) == [("field", "packets", 151), ("field", "srcport", 151), *(("row", "", i) for i in range(1, 151))]
    bounded = flows.read_flows(spark, str(tmp_path), issues_per_file=100)[2].collect()
    assert sorted((r.kind, r.line) for r in bounded) == [("row", i) for i in range(1, 101)]
    assert time.perf_counter() - begun < 40


def whole(text):
    """(line, tokens) of a file's filled lines and its header, as a plain reading gives them."""
    rows = [x.removesuffix("\r") for x in text.split("\n")]
    filled = [(i, x.split()) for i, x in enumerate(rows, 1) if x.strip()]
    named = bool(filled) and bool(set(filled[0][1]) & set(flows.KNOWN))
    return (filled[0][1] if named else flows.DEFAULT), filled[named:]


def test_files_cut_in_splits_read_as_whole_ones(spark, tmp_path):
    rng = random.Random(3)
    line = lambda i: rng.choice([f"2 1 eni-{i} 10.0.0.{i % 250} 8.8.8.8 5 443 6 1 {i} {100 + i} {160 + i} ACCEPT OK", f"srcline {i}", "", "  ", f"2 1 eni-x - - - - - - - 100 160 - NODATA\r"])
    texts = {
        "default.log": "\n".join(line(i) for i in range(4000)),
        "late_header.log": "\n" * 70_000 + "srcaddr dstaddr bytes mystery\n" + "\n".join(f"1.1.1.1 2.2.2.2 {i} m{i}" for i in range(5000)) + "\n",
        "header.log": "srcaddr dstaddr bytes\r\n" + "\r\n".join(f"1.1.1.1 2.2.2.2 {i}" for i in range(6000)),
        "only_header.log": "srcaddr dstaddr\n",
        "empty.log": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with gzip.open(tmp_path / "zipped.log.gz", "wt") as f:
        f.write(texts["default.log"])
    texts["zipped.log.gz"] = texts["default.log"]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        assert flows.scan(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        got = {}
        for r in flows.lines(flows.scan(spark, str(tmp_path))).collect():
            got.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.line, r.tokens, r.header))
        files = {r.source_file.rsplit("/", 1)[1]: (r.total, r.valid) for r in flows.read_flows(spark, str(tmp_path))[1].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    for name, text in texts.items():
        header, want = whole(text)
        assert sorted(got.get(name, [])) == [(i, tokens, header) for i, tokens in want], name
        if want:
            assert files[name] == (len(want), sum(len(t) == len(header) for _, t in want))
    assert set(files) == {n for n, t in texts.items() if whole(t)[1]}


def test_fingerprints_tell_changed_files(spark, tmp_path):
    def prints(text):
        (tmp_path / "a.log").write_text(text)
        return flows.read_flows(spark, str(tmp_path))[1].first().fingerprint

    one = prints("a b\nc d\n")
    assert one == prints("a b\nc d\n") and len({one, prints("c d\na b\n"), prints("a b\nc d\nc d\n"), prints("a b\n\nc d\n")}) == 4


def test_medians_of_earlier_days(spark):
    rng = random.Random(2)
    data = [(k, d, None if rng.random() < 0.1 else rng.randrange(50), 2**60 + d) for k in ("a", "b", None) for d in range(40)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, day int, v long, big long")
    got = {(r.k, r.day): (r.earlier_rows, r.earlier_days, r.earlier_median, r.v, r.big) for r in group.earlier_medians(df, "k", "day", "v").collect()}
    for k, d, v, big in data:
        before = [x for kk, dd, x, _ in data if kk == k and dd < d and x is not None]
        assert got[k, d] == (d, len(before), statistics.median(before) if before else None, v, big)
    long = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").alias("day"), (F.col("id") * 7919 % 100_003).alias("v"))
    begun = time.perf_counter()
    assert group.prior_median_ratio(long, "k", "day", "v").count() == 99_999
    assert time.perf_counter() - begun < 30


def test_pareto_of_one_hot_partition_takes_many_tasks(spark):
    rng = random.Random(6)
    data = [("hot", f"v{i:04}", rng.choice([None, 0, 1, 5, i])) for i in range(3000)] + [("cold", "x", 3), ("cold", "y", None), (None, "z", 2), ("none", "q", None)]
    df = spark.createDataFrame(data, "p string, v string, w long").repartition(8)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r.p, r.v): (r.place, r.upto, r.upto_share) for r in group.pareto(df, "v", "w", "p").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    for p in ("hot", "cold", None, "none"):
        own = sorted(((v, w) for pp, v, w in data if pp == p), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        total, upto = sum(w or 0 for _, w in own), 0
        for i, (v, w) in enumerate(own, 1):
            upto += w or 0
            place, got_upto, share = got[p, v]
            assert place == i and got_upto == (upto if p != "none" else None) and (share == pytest.approx(upto / total) if total else share is None)


def test_depths_of_trees_long_chains_and_cycles(spark):
    parent = {"a": "r", "b": "a", "c": "b", "d": "a", "x": "y", "y": "z", "z": "x", "t": "x", "u": "t", "p": "q", "q": "p"} | {f"n{i}": f"n{i + 1}" for i in range(300)}
    schema = "snapshot_id string, resource_id string, parent_id string"
    rows_ = [(s, a, b) for s in ("s1", "s2") for a, b in parent.items()]
    marked = spark.createDataFrame([("s1", "r"), ("s1", "a"), ("s1", "n150"), ("s1", "y")], "snapshot_id string, resource_id string")
    got = {(r.snapshot_id, r.resource_id): (r.depth, r.nearest) for r in graph.climbed(spark.createDataFrame(rows_, schema), marked).collect()}
    assert len(got) == len(rows_)
    for s, a, _ in rows_:
        way, at = [], a
        while (at := parent.get(at)) and at not in way:
            way.append(at)
        first = next((x for x in way if s == "s1" and x in {"r", "a", "n150", "y"}), None)
        assert got[s, a] == (len({*way} - {a}), first), a


def test_a_chain_of_100000_takes_linear_rows(spark):
    chain = spark.range(100_000).select(F.lit("s").alias("snapshot_id"), F.format_string("n%07d", "id").alias("resource_id"), F.format_string("n%07d", F.col("id") + 1).alias("parent_id"))
    begun = time.perf_counter()
    state, rounds = graph.jumped(chain, chain.limit(0).select(*graph.NODE))
    assert state.count() == 100_000 and rounds <= 18
    assert state.agg(F.max("hops"), F.min("hops")).first()[:] == (100_000, 1)
    assert time.perf_counter() - begun < 150


def test_types_and_items_that_are_met_twice_have_one_answer(spark, tmp_path):
    item = lambda kind, name: f'{{"resourceId":"r","resourceType":"{kind}","resourceName":"{name}","awsRegion":"x","awsAccountId":"1","configurationItemCaptureTime":"2024-01-01T00:00:00Z","relationships":[]}}'
    (tmp_path / "s.json").write_text(f'{{"configSnapshotId":"s","configurationItems":[{item("T::b", "first")},{item("T::b", "again")},{item("T::a", "other")}]}}')
    _, resources, _ = config.read_snapshots(spark, str(tmp_path))
    assert rows(resources, "resource_type", "resource_name") == [("T::a", "other"), ("T::b", "first")]
    assert rows(graph.types(resources), "resource_id", "resource_type") == [("r", "T::a")]


def test_sweep_carries_borders_over_parts(spark):
    rng = random.Random(4)
    edges = sorted(rng.sample(range(100_000), 400))
    spans = [(a, b - 1 if i % 3 else b - (b - a) // 2, f"c{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if i % 7]
    ranges = spark.createDataFrame([*spans, (200_000, 900_000, "wide")], "low long, high long, country string")
    data = [(f"p{i}", n) for i, n in enumerate([*rng.choices(range(100_000), k=3000), *range(250_000, 850_000, 1000), 900_000, 900_001, *(a for a, _, _ in spans[:20]), *(b for _, b, _ in spans[:20])])]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.ip: r.country for r in enrich.swept(spark.createDataFrame(data, "ip string, n long").repartition(6), "n", ranges).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    for ip, n in data:
        want = next((c for a, b, c in [*spans, (200_000, 900_000, "wide")] if a <= n <= b), None)
        assert got.get(ip) == want, (ip, n)
    assert enrich.swept(spark.createDataFrame(data, "ip string, n long"), "n", ranges.limit(0)).count() == 0


def test_address_columns_by_name_and_value(spark):
    df = spark.createDataFrame([("1.2.3.4", "svc.amazonaws.com", None, "9.9.9.9", 5), ("AWS Internal", "x", "::1", "y", 6)], "source_ip_address string, dst_ip string, ip string, host string, n int")
    assert enrich.address_columns(df) == ["source_ip_address", "ip"] and enrich.address_columns(df, ["host"]) == ["source_ip_address", "ip", "host"]
    geo = spark.createDataFrame([("1.2.3.4", "JP")], "ip string, country string")
    assert enrich.enrich_result(df, geo).columns == ["source_ip_address", "geo_country", "dst_ip", "ip", "ip_geo_country", "host", "n"]


def test_profiles_and_fitness(spark):
    df = spark.createDataFrame([], "Timestamp timestamp, Level string, SrcIP string")
    assert shape.fitness(df, ["Timestamp", "RuleTitle", "Level"]) == ["RuleTitle"] and shape.fitness(df, ["Level"]) == []
    assert {p.table: (p.time, p.severity, p.limit) for p in shape.PROFILES.values()}["timeline"] == ("Timestamp", "Level", 200)


def test_kept_sketches_merge_over_any_span(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") % 30 * 86_400).alias("t"), (F.col("id") * 7919 % 20_011).alias("v"))
    kept = group.daily_sketches(df, ["k"], "t", "v")
    for days in (1, 7, 30):
        got = {r.k: r.distinct_values for r in group.sketched_distinct(kept.filter(F.datediff("day", F.lit("1970-01-01")) < days), ["k"]).collect()}
        want = {r.k: r.n for r in df.filter(F.col("t") < F.timestamp_seconds(F.lit(days * 86_400))).groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.05 * want[k] for k in want)

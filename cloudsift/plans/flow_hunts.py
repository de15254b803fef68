"""Hunts over flow records: functions of the records (and of the address geography where they need it).

A limit of None gives all rows of a report, ANY_ORDER gives them unsorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudsift.operators import combine as C
from cloudsift.operators import group as G

# Ports by purpose.
ADMIN_PORTS = [22, 3389, 5985, 5986, 3306, 5432, 1433, 6379, 9200, 27017, 2375, 10250]
ODD_PORTS = [4444, 6667, 1337, 31337, 9001, 9030, 3333, 5555, 7777, 14444]
MAIL_PORTS = [25, 465, 587]
INTERNAL_ADMIN = [22, 135, 139, 445, 3389, 5985, 5986]
#: What names a service that a host talks to.
PEER = ["local_addr", "remote_addr", "dstport"]


def directed(direction: str) -> Column:
    """Records whose direction the log itself names."""
    return (F.col("direction_source") == "record") & (F.col("flow_direction") == direction)


def bounds() -> list[Column]:
    """First start and last end."""
    return [F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen")]


def down(*columns: str) -> list[Column]:
    """Falling by the first column, rising by the others, as ties need it."""
    return [F.col(columns[0]).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in columns[1:])]


def public() -> Column:
    """The remote side is public."""
    return F.col("remote_scope") == "public"


def accepted() -> Column:
    """Records that were let through."""
    return F.col("action") == "ACCEPT"


def ok() -> Column:
    """Records with data."""
    return F.col("log_status") == "OK"


def measured() -> Column:
    """Bytes; blocked public access has none."""
    return F.when(F.coalesce(F.col("reject_reason"), F.lit("")) != "BPA", F.col("bytes"))


def volume() -> Column:
    """Sum of the measured bytes."""
    return F.sum(measured())


def flow_ends() -> list[Column]:
    """The ends of the packets, which differ from the interface's behind a gateway."""
    return [F.coalesce("pkt_srcaddr", "srcaddr").alias("flow_src"), F.coalesce("pkt_dstaddr", "dstaddr").alias("flow_dst")]


def v001_sources(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Records and gaps by flow log, and the parts of its records that carry optional fields."""
    part = lambda held, name: F.round(F.avg(F.when(ok(), held.cast("int"))), 3).alias(f"{name}_share")
    aggs = [F.count_if(ok()).alias("records"), F.count_if(F.col("log_status") == "NODATA").alias("nodata"), F.count_if(F.col("log_status") == "SKIPDATA").alias("skipdata"), *bounds()]
    aggs += [part(F.col("direction_source") == "record", "recorded_direction"), part(F.col("pkt_srcaddr").isNotNull(), "packet_address")]
    aggs += [part(F.col(c).isNotNull(), c) for c in ("tcp_flags", "bytes", "traffic_path")]
    return G.group_hunt(df, ["flow_log_id"], aggs, order=down("records", "flow_log_id"), limit=limit)


def v002_gaps(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Skipped windows of an interface beside the private addresses that it sends from."""
    skipped = df.filter("log_status = 'SKIPDATA'").groupBy("interface_id").agg(F.count("*").alias("skipdata_windows"), F.min("start_time").alias("first_gap"), F.max("end_time").alias("last_gap"))
    served = df.filter(ok() & (F.col("src_scope") == "private")).groupBy("interface_id").agg(G.joined(flow_ends()[0]).alias("local_addresses"))
    return G.top(C.with_facts(skipped, served, ["interface_id"]), limit, *down("skipdata_windows", "interface_id"))


def v003_vertical_scans(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """One peer on many ports of one address."""
    aggs = [F.count_distinct("dstport").alias("distinct_ports"), F.count_if(F.col("action") == "REJECT").alias("rejected"), F.count_if(F.col("tcp_flags") == 2).alias("syn_only"), *bounds()]
    return G.group_hunt(df, ["remote_addr", "local_addr"], aggs, directed("ingress") & public(), F.col("distinct_ports") >= 20, down("distinct_ports", "remote_addr", "local_addr"), limit)


def v004_horizontal_sweeps(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """One peer on one port of many addresses."""
    aggs = [F.count_distinct("local_addr").alias("distinct_targets"), F.count_if(F.col("action") == "REJECT").alias("rejected"), *bounds()]
    return G.group_hunt(df, ["remote_addr", "dstport"], aggs, directed("ingress") & public(), F.col("distinct_targets") >= 10, down("distinct_targets", "remote_addr", "dstport"), limit)


def v005_admin_ports(df: DataFrame, geo: DataFrame, limit: int | None = 200) -> DataFrame:
    """Accepted access from outside to administration and database ports."""
    rows = df.filter(directed("ingress") & public() & accepted() & F.col("dstport").isin(*ADMIN_PORTS))
    facts = rows.groupBy("remote_addr", "local_addr", "dstport").agg(F.count("*").alias("records"), F.max("tcp_flags").alias("max_tcp_flags"), volume().alias("bytes"), F.min("start_time").alias("first_seen"))
    named = facts.join(geo.select(F.col("ip").alias("remote_addr"), F.col("country").alias("country_code"), "org"), "remote_addr", "left")
    return G.top(named, limit, F.asc_nulls_last("first_seen"), "remote_addr", "local_addr", "dstport")


def v006_rejected_then_accepted(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """A peer that was refused and got in later."""
    reject = F.col("action") == "REJECT"
    aggs = [F.count_if(reject).alias("rejects"), F.count_if(accepted()).alias("accepts"), F.min(F.when(reject, F.col("start_time"))).alias("first_reject"), F.max(F.when(accepted(), F.col("start_time"))).alias("last_accept")]
    having = (F.col("rejects") > 0) & (F.col("last_accept") > F.col("first_reject"))
    return G.group_hunt(df, ["remote_addr", "local_addr", "dstport"], aggs, directed("ingress") & public(), having, down("last_accept", "remote_addr", "local_addr", "dstport"), limit)


def daily_egress(df: DataFrame) -> DataFrame:
    """Accepted bytes to outside, and peers, of a host in a day."""
    rows = df.filter(directed("egress") & public() & accepted())
    return rows.groupBy("local_addr", F.date_trunc("day", "start_time").alias("day")).agg(F.max("instance_id").alias("instance_id"), volume().alias("egress_bytes"), F.count_distinct("remote_addr").alias("remote_peers"))


def v007_egress_spike(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Days whose accepted bytes to outside are ten times the median of the host's earlier days."""
    found = G.prior_median_ratio(daily_egress(df), "local_addr", "day", "egress_bytes", 10).filter("earlier_median > 0")
    found = found.select("local_addr", "instance_id", "day", "egress_bytes", F.col("earlier_median").alias("baseline_bytes"), F.round("ratio", 1).alias("ratio_to_baseline"), "remote_peers")
    return G.top(found, limit, *down("ratio_to_baseline", "local_addr", "day"))


def v008_odd_ports(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """Accepted egress to ports of command channels and miners."""
    where = directed("egress") & public() & accepted() & F.col("dstport").isin(*ODD_PORTS)
    keys = ["local_addr", "remote_addr", "dstport", "protocol_name"]
    return G.group_hunt(df, keys, [F.count("*").alias("records"), *bounds()], where, order=[F.asc_nulls_last("first_seen"), *(F.asc_nulls_last(k) for k in keys)], limit=limit)


def v009_dns(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """Name lookups that leave: the platform's own resolver is never logged, so every row went to another."""
    keys = ["local_addr", "remote_addr", "remote_scope", "protocol_name"]
    return G.group_hunt(df, keys, [F.count("*").alias("records"), *bounds()], directed("egress") & (F.col("dstport") == 53), order=down("records", *keys), limit=limit)


def v010_mail(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Hosts that send mail to outside."""
    where = directed("egress") & public() & accepted() & F.col("dstport").isin(*MAIL_PORTS)
    return G.group_hunt(df, ["local_addr"], [F.count_distinct("remote_addr").alias("mail_servers"), F.count("*").alias("records"), *bounds()], where, order=down("records", "local_addr"), limit=limit)


def beacons(df: DataFrame, buckets: int = 20, hours: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Peers met at even gaps, in either direction: median gap as period, median deviation over it as jitter.

    A minute counts once for each interface (and each value of `by`) that saw it. A period must pass a minute, or ten where a
    record's own window does. Windows that one of the interfaces skipped within the span forbid a high confidence.
    """
    keys = PEER
    seen = df.filter((F.col("direction_source") == "record") & public() & ok()).groupBy(*keys, "interface_id", *by, F.date_trunc("minute", "start_time").alias("bucket")).agg(F.max("duration").alias("duration"), F.sum("bytes").alias("bytes"))
    before = F.lag("bucket").over(Window.partitionBy(*keys).orderBy("bucket", "interface_id", *by))
    gaps = seen.withColumn("gap", F.unix_timestamp("bucket") - F.unix_timestamp(before))
    period = gaps.groupBy(*keys).agg(
        F.collect_set("interface_id").alias("interfaces"), F.min("bucket").alias("first_seen"), F.max("bucket").alias("last_seen"),
        F.count("*").alias("active_buckets"), F.percentile("gap", 0.5).alias("period_secs"), F.max("duration").alias("longest"),
        F.try_divide(F.stddev_pop("bytes"), F.avg("bytes")).alias("bytes_cv"), *(F.min(c).alias(c) for c in by),
    )
    span = F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")
    period = period.filter((F.col("active_buckets") >= buckets) & (span >= hours * 3600) & (F.col("period_secs") > F.when(F.col("longest") > 60, 600).otherwise(60)))
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}_{k}")) for k in keys]
    named = lambda frame, other: frame.select(*(F.col(k).alias(f"{other}_{k}") for k in keys), *(c for c in frame.columns if c not in keys))
    jitter = named(gaps, "g").join(period.select(*keys, "period_secs"), same("g")).groupBy(*keys).agg((F.percentile(F.abs(F.col("gap") - F.col("period_secs")), 0.5) / F.first("period_secs")).alias("jitter"))
    skips = df.filter("log_status = 'SKIPDATA'").select("interface_id", F.col("start_time").alias("skipped_at"))
    each = period.select(*keys, F.explode("interfaces").alias("interface_id"), "first_seen", "last_seen")
    overlaps = C.in_ranges(skips, each, ["interface_id"], "skipped_at", "first_seen", "last_seen").groupBy(*keys).agg(F.sum("points").alias("skipdata_overlaps"))
    out = period.join(named(jitter, "j"), same("j")).join(named(overlaps, "o"), same("o"), "left").withColumn("skipdata_overlaps", F.coalesce("skipdata_overlaps", F.lit(0)))
    confidence = F.when((F.col("jitter") <= 0.1) & (F.col("skipdata_overlaps") == 0), "high").when(F.col("jitter") <= 0.25, "medium").otherwise("low")
    return out.withColumns({"span_hours": span / 3600.0, "confidence": confidence})


def v011_periodic(df: DataFrame, buckets: int = 20, hours: int = 12, limit: int | None = 100) -> DataFrame:
    """Beacons, the surest first."""
    out = beacons(df, buckets, hours).select(*PEER, "period_secs", "active_buckets", F.round("jitter", 3).alias("jitter"), "skipdata_overlaps", F.round("span_hours", 1).alias("span_hours"), "confidence")
    return G.top(out, limit, "confidence", "jitter", F.desc("active_buckets"), *PEER)


def v012_new_internal_pairs(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Sources that reach new internal destinations on administration ports a day or more after the records begin."""
    inside = df.filter(ok() & (F.col("src_scope") == "private") & (F.col("dst_scope") == "private") & F.col("dstport").isin(*INTERNAL_ADMIN))
    pairs = inside.groupBy(*flow_ends(), "dstport").agg(F.min("start_time").alias("first_seen"))
    # One row.
    start = df.agg(F.min("start_time").alias("history_start"))
    fresh = pairs.crossJoin(F.broadcast(start)).filter("first_seen >= history_start + INTERVAL 1 DAY")
    return G.group_hunt(fresh, ["flow_src"], [F.count_distinct("flow_dst").alias("new_destinations"), G.joined("dstport").alias("ports"), F.min("first_seen").alias("first_seen")], order=down("new_destinations", "flow_src"), limit=limit)


def v013_staging(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Hosts that took data in from inside and sent data out later."""
    host = F.col("local_addr").alias("host")
    inside = df.filter(directed("ingress") & (F.col("remote_scope") == "private")).groupBy(host).agg(volume().alias("internal_in_bytes"), F.min("start_time").alias("first_internal_in"))
    outside = df.filter(directed("egress") & public() & accepted()).groupBy(host).agg(volume().alias("external_out_bytes"), F.max("start_time").alias("last_external_out"), F.count_distinct("remote_addr").alias("external_peers"))
    return G.top(C.sequence_join(inside, outside, ["host"], "first_internal_in", "last_external_out"), limit, *down("external_out_bytes", "host"))


def v014_odd_protocols(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Protocols besides ICMP, TCP, UDP and ICMPv6."""
    return G.group_hunt(df, [*flow_ends(), "protocol_name"], [F.count("*").alias("records"), F.min("start_time").alias("first_seen")], ok() & ~F.col("protocol").isin(1, 6, 17, 58), order=down("records", "flow_src", "flow_dst", "protocol_name"), limit=limit)


def v015_udp_fan_out(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Sources of UDP to many outside hosts."""
    src, dst = flow_ends()
    aggs = [F.count_distinct(dst).alias("external_destinations"), G.joined("dstport").alias("ports"), F.count("*").alias("records")]
    return G.group_hunt(df, [src], aggs, ok() & (F.col("protocol") == 17) & (F.col("dst_scope") == "public"), F.col("external_destinations") >= 20, down("external_destinations", "flow_src"), limit)


def v016_icmp(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """ICMP peers by volume."""
    return G.group_hunt(df, [*flow_ends(), "protocol_name"], [F.count("*").alias("records"), volume().alias("bytes")], ok() & F.col("protocol").isin(1, 58), order=down("bytes", "flow_src", "flow_dst", "protocol_name"), limit=limit)


def v017_countries(df: DataFrame, geo: DataFrame, limit: int | None = 100) -> DataFrame:
    """Accepted inbound by country."""
    name = F.col("country_name") if "country_name" in geo.columns else F.lit(None).cast("string").alias("country_name")
    named = geo.filter(F.col("country").isNotNull() & ~F.col("country").isin("PRIVATE", "LOOPBACK", "LINK-LOCAL", "SPECIAL")).select(F.col("ip").alias("remote_addr"), F.col("country").alias("country_code"), name)
    rows = df.filter(directed("ingress") & public() & accepted()).join(named, "remote_addr")
    return G.group_hunt(rows, ["country_code"], [F.max("country_name").alias("country_name"), F.count("*").alias("records"), F.count_distinct("remote_addr").alias("sources"), G.joined("dstport").alias("ports")], order=down("records", "country_code"), limit=limit)


def v018_control_rejections(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Rejections by public-access blocks and encryption controls."""
    keys = ["reject_reason", "interface_id", "flow_src", "flow_dst", "dstport"]
    return G.group_hunt(df, ["reject_reason", "interface_id", *flow_ends(), "dstport"], [F.count("*").alias("records"), F.min("start_time").alias("first_seen")], F.col("reject_reason").isNotNull(), order=down("records", *keys), limit=limit)


#: id: (severity, columns that must hold values, function, whether it takes the geography).
HUNTS = {
    "V001": ("P4", ["flow_log_id"], v001_sources, False), "V002": ("P3", ["log_status", "interface_id"], v002_gaps, False), "V003": ("P3", ["flow_direction", "dstport"], v003_vertical_scans, False),
    "V004": ("P3", ["flow_direction", "dstport"], v004_horizontal_sweeps, False), "V005": ("P1", ["flow_direction", "dstport", "action"], v005_admin_ports, True), "V006": ("P2", ["flow_direction", "action", "dstport"], v006_rejected_then_accepted, False),
    "V007": ("P1", ["flow_direction", "bytes", "action"], v007_egress_spike, False), "V008": ("P2", ["flow_direction", "dstport"], v008_odd_ports, False), "V009": ("P3", ["flow_direction", "dstport"], v009_dns, False),
    "V010": ("P3", ["flow_direction", "dstport"], v010_mail, False), "V011": ("P2", ["flow_direction", "dstport", "start_time"], v011_periodic, False), "V012": ("P1", ["dstport", "src_scope", "dst_scope"], v012_new_internal_pairs, False),
    "V013": ("P2", ["flow_direction", "bytes"], v013_staging, False), "V014": ("P3", ["protocol"], v014_odd_protocols, False), "V015": ("P3", ["protocol", "dst_scope"], v015_udp_fan_out, False), "V016": ("P4", ["protocol"], v016_icmp, False),
    "V017": ("P4", ["flow_direction", "action"], v017_countries, True), "V018": ("P3", ["reject_reason"], v018_control_rejections, False),
}

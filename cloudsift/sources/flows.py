"""Flow-log text to records, file statistics and issues."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudsift.functions import net
from cloudsift.sources.scratch import cut, few_listers

#: Fields of a file without a header, in their order.
DEFAULT = "version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status".split()
NUMBERS = {"version": "int", "srcport": "int", "dstport": "int", "protocol": "int", "packets": "bigint", "bytes": "bigint", "start": "bigint", "end": "bigint", "tcp-flags": "int", "traffic-path": "int", "encryption-status": "int"}
TEXTS = (
    "account-id interface-id srcaddr dstaddr action log-status vpc-id subnet-id instance-id type pkt-srcaddr pkt-dstaddr region az-id sublocation-type sublocation-id "
    "pkt-src-aws-service pkt-dst-aws-service flow-direction reject-reason resource-id ecs-cluster-arn ecs-cluster-name ecs-container-instance-arn ecs-container-instance-id "
    "ecs-container-id ecs-second-container-id ecs-service-name ecs-task-definition-arn ecs-task-arn ecs-task-id instance-tag instance-tag-2 interface-tag interface-tag-2 asg-tag asg-tag-2 "
    "interface-type next-hop-interface-id next-hop-subnet-id next-hop-az-id next-hop-vpc-id next-hop-interface-type"
).split()
KNOWN = [*NUMBERS, *TEXTS]
#: The share of rejected rows that is worth a warning.
WARN_RATIO = 0.01


def raw_lines(lines: DataFrame) -> DataFrame:
    """(source_file, block, value) of a text scan, batch or stream, of plain or gzip files; plain ones are cut into splits."""
    return lines.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value")


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The raw lines of all files below the paths."""
    with few_listers(spark):
        return raw_lines(spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths))


def tokens(text: Column) -> Column:
    """The words of a line; a pattern splits it only where more than single spaces stand between them, as it costs many times as much."""
    own = F.trim(text)
    odd = any_of(own.contains(space) for space in ("  ", "\t", "\x0b", "\f", "\r"))
    return F.when(odd, F.split(own, r"\s+")).otherwise(F.split(own, " "))


def lines(raw: DataFrame) -> DataFrame:
    """(source_file, header, places, unknown, line, text, width, tokens): the filled lines with their numbers from 1, without headers.

    A file's header is its first filled line if that names a field, else the default. `places` are the
    positions of the KNOWN fields from 1 (0: absent), `unknown` those of others, `width` the number of words.

    Lines are written once with a rising number, so that neither a retry nor another cut of the files moves
    them. One row for each split then says how many lines the file has before it and which header; it meets its
    lines by a join of the written tables, of which the small one is broadcast only if Spark finds it small.
    """
    text = F.regexp_replace("value", "\r$", "")
    raw = raw.withColumn("text", text)
    each = cut(raw.select("source_file", "block", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("id"), "text", (F.trim("text") != "").alias("filled"), F.size(tokens(F.col("text"))).alias("width")), "flow_lines")
    # The first filled line of a split; a file's is that of its first split that has one.
    splits = each.groupBy("source_file", "block", "task").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min(F.when(F.col("filled"), F.struct("id", "text"))).alias("head"))
    file = Window.partitionBy("source_file").orderBy("block")
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 - F.col("first"))
    head = F.when(F.col("head").isNotNull(), F.struct((F.col("head.id") + F.col("base")).alias("line"), F.split(F.trim("head.text"), r"\s+").alias("names")))
    splits = splits.withColumn("head", F.first(head, ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    known = F.array(*(F.lit(k) for k in KNOWN))
    splits = splits.withColumn("named", F.coalesce(F.arrays_overlap("head.names", known), F.lit(False)))
    splits = splits.withColumn("header", F.when(F.col("named"), F.col("head.names")).otherwise(F.array(*(F.lit(k) for k in DEFAULT))))
    layout = splits.select(
        *(F.col(c).alias(f"{c}_") for c in ("source_file", "block", "task")), "base", "header",
        F.transform(known, lambda k: F.array_position("header", k).cast("int")).alias("places"),
        F.filter(F.transform("header", lambda k, i: F.struct(k.alias("name"), i.alias("at"))), lambda x: ~F.array_contains(known, x["name"])).alias("unknown"),
        F.when(F.col("named"), F.col("head.line")).otherwise(0).alias("header_line"),
    )
    met = each.filter("filled").join(cut(layout, "flow_splits"), (F.col("source_file") == F.col("source_file_")) & (F.col("block") == F.col("block_")) & (F.col("task") == F.col("task_")))
    met = met.withColumn("line", (F.col("id") + F.col("base")).cast("int")).filter("line != header_line")
    return met.select("source_file", "header", "places", "unknown", "line", "text", "width", tokens(F.col("text")).alias("tokens"))


def value(name: str) -> Column:
    """The text of a field in a line; a hyphen is null.

    No nullif: Spark would bind its argument in a step before, and those of all fields make a method too long for the JVM to compile.
    """
    token = F.get("tokens", F.get("places", KNOWN.index(name)) - 1)
    return F.when(token != "-", token)


def read_flows(spark: SparkSession, paths: str | list[str], issues_per_file: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O-05 to O-08, O-24, O-25: (records, files, issues) of all files below the paths."""
    return parsed(scan(spark, paths), issues_per_file)


def parsed(raw: DataFrame, issues_per_file: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, files, issues) of raw lines."""
    return of_lines(lines(raw), issues_per_file)


def of_lines(numbered: DataFrame, issues_per_file: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, files, issues) of numbered lines, or of those of some files.

    Fields come in any order, the first of a repeated one counts; unknown ones go to the JSON text `extra`;
    a hyphen is null. A line of a wrong length is rejected; a number that is none becomes null. Both are
    issues: all of them, or the first `issues_per_file` of each file. Files have a fingerprint: two
    sums over all numbered lines, so it needs neither a whole file in a row nor a second reading.
    """
    rows = numbered.withColumn("ok", F.col("width") == F.size("header"))
    column = lambda name: name.replace("-", "_")
    fits = rows.filter("ok")
    broken = {n: value(n).isNotNull() & value(n).try_cast(t).isNull() for n, t in NUMBERS.items()}
    extra = F.filter(F.transform("unknown", lambda u: F.struct(u["name"].alias("k"), F.get("tokens", u["at"]).alias("v"))), lambda x: x["v"] != "-")
    extra = F.when(F.size("unknown") > 0, F.when(F.size(extra) > 0, F.to_json(F.map_from_entries(extra))))
    fields = [value(n).try_cast(t).alias(column(n)) for n, t in NUMBERS.items()] + [value(n).alias(column(n)) for n in TEXTS]
    records = derived(fits.select("source_file", "line", *fields, extra.alias("extra"), any_of(broken.values()).alias("has_parse_issue")))
    # A rejected line has one issue without a field; the list is made once, so that no filter repeats its conditions.
    bad = F.when(F.col("ok"), F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())))).otherwise(F.array(F.lit(None).cast("string")))
    marked = barrier(rows, bad=bad).select("source_file", "line", F.explode("bad").alias("field"), F.col("text").alias("raw"))
    issues = marked.select("source_file", "line", F.when(F.col("field").isNull(), "row").otherwise("field").alias("kind"), "field", "raw")
    if issues_per_file is not None:
        place = F.row_number().over(Window.partitionBy("source_file").orderBy("line", "kind", "field"))
        issues = issues.withColumn("place", place).filter(F.col("place") <= issues_per_file).drop("place")
    whole = lambda c: F.col("ok") & c
    seed = lambda n: F.sum(F.xxhash64(F.lit(n), "line", "text").cast("decimal(20,0)"))
    files = rows.groupBy("source_file").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("valid"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.count_if(whole(any_of(broken.values()))).alias("with_issues"),
        F.count_if(whole(value("log-status") == "NODATA")).alias("nodata"),
        F.count_if(whole(value("log-status") == "SKIPDATA")).alias("skipdata"),
        F.min(F.when(F.col("ok"), F.timestamp_seconds(value("start").try_cast("bigint")))).alias("first_start"),
        F.max(F.when(F.col("ok"), F.timestamp_seconds(value("end").try_cast("bigint")))).alias("last_end"),
        F.min("header").alias("header"),
        F.concat_ws(":", F.count("*"), seed(1), seed(2)).alias("fingerprint"),
    )
    files = files.withColumns({"warn": F.col("rejected") > WARN_RATIO * F.col("total"), "fingerprint": F.sha2(F.concat_ws(" ", "fingerprint", F.concat_ws(" ", "header")), 256)})
    return records, files.select("*", *flow_file_meta(F.col("source_file"))), issues


def write_flows(records: DataFrame, path: str) -> None:
    """The ingested flow table: days as folders, large days over several files, rows of a file by time so that row groups prune."""
    days = records.withColumn("day", F.to_date("start_time"))
    days.hint("rebalance", "day").sortWithinPartitions("day", "start_time").write.partitionBy("day").parquet(path)


def any_of(conditions: Iterable[Column]) -> Column:
    """Whether one of the conditions holds."""
    return reduce(Column.__or__, conditions)


def flow_file_meta(path: Column) -> list[Column]:
    """O-07: account, region and flow-log id from {account}_vpcflowlogs_{region}_{id}_{time}_{hash}.log.gz."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "_")
    fits = (F.size(parts) >= 5) & (F.element_at(parts, 2) == "vpcflowlogs") & F.element_at(parts, 1).rlike("^[0-9]{12}$")
    return [F.when(fits, F.get(parts, i)).alias(n) for i, n in ((0, "file_account"), (2, "file_region"), (3, "flow_log_id"))]


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that later filters and projections read but do not repeat: they come out of a generator of one row."""
    made = df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made


def derived(records: DataFrame) -> DataFrame:
    """O-23 to O-25: times, duration, protocol, version, endpoints and all scopes."""
    own = records.withColumns({"_src": F.coalesce("pkt_srcaddr", "srcaddr"), "_dst": F.coalesce("pkt_dstaddr", "dstaddr")})
    own = barrier(own, _src_version=net.ip_version(F.col("_src")), _dst_version=net.ip_version(F.col("_dst")))
    end = lambda side: F.struct(F.col(f"{side}_version").alias("version"), net.scope_of(F.col(side), F.col(f"{side}_version")).alias("scope"))
    # Without an address of the packet, the interface's is the end.
    version = lambda side: F.when(F.col(f"pkt{side}addr").isNull(), F.col(f"{side}_version")).otherwise(net.ip_version(F.col(f"{side[1:]}addr")))
    sides = barrier(own, _src_end=end("_src"), _dst_end=end("_dst"), ip_version=F.coalesce(version("_src"), version("_dst")))
    told = barrier(sides, _way=net.flow_direction(F.col("flow_direction"), F.col("log_status"), F.col("_src_end"), F.col("_dst_end")))
    pick = lambda a, b: F.when(F.col("_way.outward"), F.col(a)).when(~F.col("_way.outward"), F.col(b))
    return told.withColumns({
        "start_time": F.timestamp_seconds("start"),
        "end_time": F.timestamp_seconds("end"),
        "duration": F.col("end") - F.col("start"),
        "protocol_name": net.protocol_name(F.col("protocol")),
        "local_addr": pick("_src", "_dst"),
        "remote_addr": pick("_dst", "_src"),
        "direction_source": F.col("_way.source"),
        "src_scope": F.col("_src_end.scope"),
        "dst_scope": F.col("_dst_end.scope"),
        "local_scope": pick("_src_end.scope", "_dst_end.scope"),
        "remote_scope": pick("_dst_end.scope", "_src_end.scope"),
    }).drop("_src", "_dst", "_src_version", "_dst_version", "_src_end", "_dst_end", "_way")


def flow_sources(files: DataFrame) -> DataFrame:
    """O-28: one row for each flow log: accounts, regions, header variants and one of them, sums and bounds of its files."""
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    header = F.array_join("header", " ")
    sums = {"rows_total": "total", "rows_valid": "valid", "rows_with_issues": "with_issues", "rows_rejected": "rejected", "nodata_rows": "nodata", "skipdata_rows": "skipdata"}
    return files.groupBy("flow_log_id").agg(
        text("file_account").alias("account_ids"), text("file_region").alias("regions"), F.count_distinct(header).alias("header_variants"), F.min(header).alias("header"), F.count("*").alias("files"),
        *(F.sum(c).alias(n) for n, c in sums.items()), F.min("first_start").alias("first_observation"), F.max("last_end").alias("last_observation"),
    )


def flow_unique(records: DataFrame) -> DataFrame:
    """O-29: one row for a flow (ends of the packets, ports, protocol) and minute that several interfaces saw, with the largest counts."""
    kept = records.withColumns({"flow_src": F.coalesce("pkt_srcaddr", "srcaddr"), "flow_dst": F.coalesce("pkt_dstaddr", "dstaddr")}).filter((F.coalesce("log_status", F.lit("OK")) == "OK") & F.col("flow_src").isNotNull())
    keys = ["flow_src", "flow_dst", "srcport", "dstport", "protocol"]
    return kept.groupBy(*keys, F.date_trunc("minute", "start_time").alias("window_start")).agg(
        F.count("*").alias("observation_count"), F.max("bytes").alias("bytes"), F.max("packets").alias("packets"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.array_join(F.sort_array(F.collect_set("interface_id")), ",").alias("interface_ids"),
    )

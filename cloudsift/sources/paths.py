"""Which files a log tree holds, and which of them to read."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Service directories and file-name parts by kind.
SERVICES = {"CloudTrail": "CloudTrail", "vpcflowlogs": "VpcFlowText", "CloudTrail-Digest": "SkippedDigest", "CloudTrail-Insight": "SkippedInsight", "Config": "SkippedConfig"}


def classify_log(path: Column) -> Column:
    """O-01: kind by the service in the file's name, then by its directory, then by its ending."""
    file = F.element_at(F.split(path, "/"), -1)
    by_name = F.regexp_extract(file, r"^[0-9]{12}_([A-Za-z-]+)_", 1)
    by_directory = F.regexp_extract(path, r"/(?:aws-service=)?(CloudTrail-Digest|CloudTrail-Insight|CloudTrail|vpcflowlogs|Config)/", 1)
    service = F.coalesce(F.nullif(by_name, F.lit("")), F.nullif(by_directory, F.lit("")), F.lit(""))
    kind = F.lit(None).cast("string")
    for name, value in SERVICES.items():
        kind = F.when(service == name, value).otherwise(kind)
    kind = F.when((kind == "VpcFlowText") & path.rlike(r"\.parquet$"), "SkippedParquet").otherwise(kind)
    return F.coalesce(kind, F.when(file.rlike(r"\.json(\.gz)?$"), "CloudTrail").otherwise("SkippedOther"))


def path_date(path: Column) -> Column:
    """O-16: the day in a path: yyyy/mm/dd, year=/month=/day=, or _YYYYMMDDTHHmmZ_; else null."""
    found = F.lit(None).cast("date")
    for pattern in (r"_([0-9]{4})([0-9]{2})([0-9]{2})T[0-9]{4}Z_", r"/year=([0-9]{4})/month=([0-9]{1,2})/day=([0-9]{1,2})(?:/|$)", r"/([0-9]{4})/([0-9]{2})/([0-9]{2})(?:/|$)"):
        day = F.concat_ws("-", *(F.regexp_extract(path, pattern, i) for i in (1, 2, 3)))
        found = F.coalesce(F.when(path.rlike(pattern), F.try_to_date(day, "yyyy-M-d")), found)
    return found


def glob_regex(glob: str) -> str:
    """A pattern in which a star also crosses slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def wanted(path: Column, start: date | None = None, end: date | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """O-16, O-17: in the range of days (paths without one stay), in an included glob, in no excluded one."""
    day, out = path_date(path), F.lit(True)
    out = out & (day.isNull() | (day >= F.lit(start))) if start else out
    out = out & (day.isNull() | (day <= F.lit(end))) if end else out
    if include:
        hit = F.lit(False)
        for glob in include:
            hit = hit | path.rlike(glob_regex(glob))
        out = out & hit
    for glob in exclude:
        out = out & ~path.rlike(glob_regex(glob))
    return out


def log_inventory(spark: SparkSession, root: str) -> DataFrame:
    """O-02: path, kind, size and day of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", classify_log(F.col("path")).alias("kind"), F.col("length").alias("size"), path_date(F.col("path")).alias("day"))

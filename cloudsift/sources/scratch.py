"""Tables that cut the lineage of iterative jobs, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; without it a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """List trees of many small folders and files in 64 tasks; Spark would start one for each path."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, min(int(before), 64))
    try:
        yield
    finally:
        spark.conf.set(LISTERS, before)


#: Derived inputs of this session, by what they are made from.
MADE: dict[tuple[str, ...], str] = {}


def once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The folder that `write` filled for this source; it is filled once in a session."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in MADE:
        path = folder(spark, name)
        write(path)
        MADE[key] = path
    return MADE[key]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df and return a scan of it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

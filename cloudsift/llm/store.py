"""Intermediate tables that outlive a lost executor.

Iterative operators cut their lineage by writing Parquet below the folder that the cluster names in
spark.checkpoint.dir, which driver and executors share, and reading it back.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; without it a temporary one, on a local master only."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: The number of a row within a stage.
ROW = "_row_number"


def free(taken: list[str], name: str = ROW) -> str:
    """A column name like `name` that none of the taken ones equals, in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def only(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with these columns, whatever signs are in their names."""
    return rows.select(*(F.col(f"`{c.replace('`', '``')}`") for c in columns))


class Store:
    """Tables of one run of an operator, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a scan of what was written."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def numbered(self, df: DataFrame, name: str = "numbered", row: str = ROW) -> DataFrame:
        """The rows with a number each in the new column `row`, which being written keeps: keys may be null or repeat."""
        return self.put(df.withColumn(row, F.monotonically_increasing_id()), name)

    def drop(self, *names: str) -> None:
        """Delete tables that no pending plan reads."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(hadoop).delete(path, True)

"""Incremental ingest: what was read before, by path and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, sha256) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("sha256"))


def pending(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """O-13: files that are new or changed."""
    return found.join(ledger.select("file_path", "sha256"), ["file_path", "sha256"], "left_anti")


def marked(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger after a run: the newest fingerprint of each path."""
    return ledger.select("file_path", "sha256").join(done.select("file_path"), "file_path", "left_anti").unionByName(done.select("file_path", "sha256"))


def replaced(rows: DataFrame, fresh: DataFrame, source: str = "source_file") -> DataFrame:
    """O-14: rows of changed files give way to what was read anew."""
    return rows.join(fresh.select(source).distinct(), source, "left_anti").unionByName(fresh, allowMissingColumns=True)


def appended(rows: DataFrame, fresh: DataFrame, key: str | None = None) -> DataFrame:
    """O-15: a changed file adds all of its rows, those that are known too.

    With a key, rows whose key is known or met twice in the file are left out; rows without a key all stay.
    """
    if key is None:
        return rows.unionByName(fresh, allowMissingColumns=True)
    new = fresh.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(rows.select(key), key, "left_anti")
    return rows.unionByName(new, allowMissingColumns=True).unionByName(fresh.filter(F.col(key).isNull()), allowMissingColumns=True)


def statistics(inventory: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """O-21: files by kind, rows and errors of a run."""
    kinds = inventory.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    return kinds.unionByName(rows.agg(F.lit("rows").alias("what"), F.count("*").alias("n"))).unionByName(errors.agg(F.lit("errors").alias("what"), F.count("*").alias("n")))

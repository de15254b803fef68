"""A table that grows by loads, each of which is there as a whole or not at all (O-14, O-15).

Rows of a load lie in a folder of their own. Only the ledger, whose entry is written last, makes them count: a
reader takes, for each source file, the rows of the load that the ledger names last. So a changed file's rows
replace the old ones at one stroke; a load that broke off leaves rows that nobody sees, and its repetition writes
the same folder anew. No row is deleted while readers may hold it; `vacuum` removes what no entry names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "source_file string, fingerprint string, load long"


class Loads:
    """The tables below a root: any names for rows, and the ledger of files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at))

    def ledger(self) -> DataFrame:
        """(source_file, fingerprint, load): the last entry of each file."""
        if not self._there(f"{self.root}/ledger"):
            return self.spark.createDataFrame([], LEDGER)
        entries = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")
        return entries.groupBy("source_file").agg(F.max_by("fingerprint", "load").alias("fingerprint"), F.max("load").alias("load"))

    def pending(self, files: DataFrame) -> DataFrame:
        """O-13: files (source_file, fingerprint) whose content the ledger does not have."""
        return files.join(self.ledger().select("source_file", "fingerprint"), ["source_file", "fingerprint"], "left_anti")

    def write(self, load: int, tables: dict[str, DataFrame]) -> None:
        """Write a load's rows; they don't count yet. What an earlier try of the load left is replaced."""
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/load={load}")

    def commit(self, load: int, files: DataFrame) -> None:
        """Make a load count: one file, which is there as a whole or not; it has a row for each file of a load."""
        files.select("source_file", "fingerprint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/load={load}")

    def rows(self, name: str, appended: bool = False) -> DataFrame:
        """The rows that count: of each file's last load or, appended, of all its committed loads."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}")
        entries = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger") if appended else self.ledger()
        return rows.join(entries.select("source_file", "load"), ["source_file", "load"], "left_semi")

    def vacuum(self, name: str) -> list[int]:
        """Delete the loads of a table that no file's last entry names; give their numbers."""
        live = {r.load for r in self.ledger().select("load").distinct().collect()}
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs, gone = top.getFileSystem(hadoop), []
        for status in fs.listStatus(top):
            folder = status.getPath().getName()
            if folder.startswith("load=") and (load := int(folder.removeprefix("load="))) not in live:
                fs.delete(status.getPath(), True)
                gone.append(load)
        return sorted(gone)

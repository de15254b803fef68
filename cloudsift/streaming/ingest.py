"""Ingest of log trees as availableNow streams, through a ledger of contents (O-13, O-14, O-15).

A file stream finds files by path and so would pass a file that changed. Each run is therefore a stream of its
own over all files, and the ledger says which contents are new. The run's checkpoint lasts until the run has
ended: a run that breaks off is taken up where it stopped, with the same batches under the same load numbers, so
what it had half written is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.sources import audit, flows
from cloudsift.sources.loads import Loads
from cloudsift.sources.scratch import cut, few_listers

#: Bytes of a batch, as these and not the number of files are what its tasks hold, and room for the batches of a run in a load's number.
MOST_BYTES, BATCHES = 512 << 20, 1 << 20

#: From a batch's text scan: the files (source_file, fingerprint), and from those of them to load (source_file) the tables to keep.
Parse = Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], dict[str, DataFrame]]]]


def of_files(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of some files."""
    return rows.join(fresh.select("source_file"), "source_file", "left_semi")


def flow_batch(scan: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], dict[str, DataFrame]]]:
    """Flow records, figures of files and issues. The figures are made once; lines of files that are known already are not taken apart."""
    rows = flows.lines(scan)
    files = cut(flows.of_lines(rows)[1], "batch_files")

    def tables(fresh: DataFrame) -> dict[str, DataFrame]:
        records, _, issues = flows.of_lines(of_files(rows, fresh))
        return {"records": records, "files": of_files(files, fresh).drop("fingerprint"), "issues": issues}

    return files, tables


def audit_batch(scan: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], dict[str, DataFrame]]]:
    """Audit events; files that are no envelope have none, and are errors."""

    def tables(fresh: DataFrame) -> dict[str, DataFrame]:
        events, errors = audit.parsed(of_files(scan, fresh).select(F.col("source_file").alias("path"), "value"))
        return {"events": events, "errors": errors.select(F.col("path").alias("source_file"))}

    return scan.select("source_file", F.sha2(F.col("value").cast("binary"), 256).alias("fingerprint")), tables


def runs(spark: SparkSession, root: str) -> tuple[int, int]:
    """(runs begun, runs ended) of a root."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return max((int(n) for n in names if n.isdigit()), default=-1) + 1, max((int(n.removesuffix(".ended")) for n in names if n.endswith(".ended")), default=-1) + 1


def ingest(spark: SparkSession, source: str, root: str, parse: Parse = flow_batch, whole: bool = False, most_files: int | None = None, after_write: Callable[[int], None] | None = None) -> Loads:
    """One run over all files below `source`, into the tables below `root`; `whole`: a file is one row.

    Batches hold MOST_BYTES, or `most_files` if given. New and changed files are loaded, others are passed. `after_write` is called between a load's rows and its
    ledger entry.
    """
    loads, (begun, ended) = Loads(spark, root), runs(spark, root)
    run = begun if begun == ended else begun - 1
    # A schema of one text: file streams need one.
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true")
    lines = lines.option("maxFilesPerTrigger", most_files) if most_files else lines.option("maxBytesPerTrigger", MOST_BYTES)
    lines = (lines.option("wholetext", "true") if whole else lines.option("lineSep", "\n")).load(source)

    def batch(rows: DataFrame, number: int) -> None:
        load = run * BATCHES + number
        files, tables = parse(rows)
        fresh = loads.pending(files.select("source_file", "fingerprint")).persist()
        try:
            if fresh.isEmpty():
                return
            loads.write(load, tables(fresh))
            if after_write:
                after_write(load)
            loads.commit(load, fresh)
        finally:
            fresh.unpersist()

    with few_listers(spark):
        stream = flows.raw_lines(lines).writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/runs/{run}").trigger(availableNow=True).start()
        stream.awaitTermination()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/{run}.ended")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
    return loads

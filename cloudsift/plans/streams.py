"""Streaming forms of ingest and hunts over logs that Spark derives from the driver's tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.plans.events import Query, T, table, text
from cloudsift.plans.ingest import FILE_EVENTS
from cloudsift.sources.scratch import few_listers, folder
from cloudsift.streaming import hunts, ingest

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


class Tree:
    """A tree of flow logs that changes between runs: a file for every FILE_EVENTS events, four kinds of files by turns."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.events = spark, table(spark, sf_dir, "events").select("event_id", "ts")
        self.path = folder(spark, "tree")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, kinds: list[int], more: int, least: int) -> None:
        """Write the files of some kinds, in place of those that are there: bytes grow by `more`, events below place `least` are left out."""
        n = F.col("event_id")
        start = F.unix_timestamp(F.col("ts").cast("timestamp"))
        line = F.concat_ws(" ", F.lit("2 1"), F.concat(F.lit("eni-"), (n % 3).cast("string")), F.lit("10.0.0.1 8.8.8.8 5 443 6 1"), (n % 5000 + more).cast("string"), start.cast("string"), (start + 60).cast("string"), F.lit("ACCEPT OK"))
        rows = self.events.filter((F.floor(n / FILE_EVENTS) % 4).isin(kinds) & (n % FILE_EVENTS >= least))
        made = folder(self.spark, "made")
        rows.groupBy(F.floor(n / FILE_EVENTS).alias("file")).agg(F.array_join(F.collect_list(line), "\n").alias("value")).write.partitionBy("file").text(made)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self.fs.mkdirs(path(self.path))

        def move(part: str) -> None:
            target = path(f"{self.path}/{part.split('/')[-2]}.log")
            self.fs.delete(target, False)
            self.fs.rename(path(part), target)

        # Only names pass the driver; a store that is slow to answer is asked for several files at a time.
        with few_listers(self.spark):
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(made)
        parts = [r.path for r in found.select("path").collect()]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, parts))


def of_file(source: Column) -> Column:
    """The number in a file's name."""
    return F.regexp_extract(source, r"file=(\d+)\.log", 1).cast("long")


#: Events with their file and its kind; `stays`: not left out by the change.
FILED = f"(SELECT *, f % 4 AS kind, f % 4 <> 1 OR event_id % {FILE_EVENTS} > 0 AS stays FROM (SELECT *, event_id // {FILE_EVENTS} AS f FROM events))"


@query(f"""SELECT f AS file, CAST(kind % 2 AS BIGINT) AS run, count(*) FILTER (stays) AS rows, CAST(sum(event_id % 5000 + CASE WHEN kind = 1 THEN 1 ELSE 0 END) FILTER (stays) AS BIGINT) AS bytes,
count(*) + CASE WHEN kind = 1 THEN count(*) FILTER (stays) ELSE 0 END AS rows_appended FROM {FILED} GROUP BY f, kind""")
def o13_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-13 to O-15: two runs over a tree in which files are left alone (kinds 0 and 2), changed (1) and added (3)."""
    tree, root = Tree(spark, sf_dir), folder(spark, "loads")
    tree.put([0, 1, 2], 0, 0)
    ingest.ingest(spark, tree.path, root)
    tree.put([1], 1, 1)
    tree.put([3], 0, 0)
    loads = ingest.ingest(spark, tree.path, root)
    by_file = lambda rows, *aggs: rows.groupBy(of_file(F.col("source_file")).alias("file")).agg(*aggs)
    now = by_file(loads.rows("records"), F.floor(F.max("load") / ingest.BATCHES).alias("run"), F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    return now.join(by_file(loads.rows("records", appended=True), F.count("*").alias("rows_appended")), "file")


@query(f"""WITH p AS (SELECT unnest(['1 first', '2 broken', '3 repeated']) AS phase)
SELECT phase, count(*) AS rows, CAST(sum(event_id % 5000 + CASE WHEN kind = 1 AND phase = '3 repeated' THEN 1 ELSE 0 END) AS BIGINT) AS bytes
FROM p, {FILED} WHERE phase = '3 repeated' AND stays OR phase <> '3 repeated' AND kind <> 3 GROUP BY phase""")
def o14_whole_or_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-14: what readers see after a run, after one that broke off between rows and ledger, and after its repetition."""
    tree, root = Tree(spark, sf_dir), folder(spark, "loads")
    seen = []

    def look(phase: str, loads: ingest.Loads) -> None:
        # One row.
        seen.append(loads.rows("records").agg(F.lit(phase).alias("phase"), F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first())

    def fail(load: int) -> None:
        raise InterruptedError(f"load {load} breaks off")

    tree.put([0, 1, 2], 0, 0)
    look("1 first", ingest.ingest(spark, tree.path, root))
    tree.put([1], 1, 1)
    tree.put([3], 0, 0)
    try:
        ingest.ingest(spark, tree.path, root, after_write=fail)
    except Exception as e:
        if "breaks off" not in str(e):
            raise
    look("2 broken", ingest.Loads(spark, root))
    look("3 repeated", ingest.ingest(spark, tree.path, root))
    return spark.createDataFrame(seen, "phase string, rows long, bytes long")


@query(f"SELECT user_id, {T.format("date_trunc('hour', ts)")} AS hour, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) >= 2")
def o54_stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-52, O-54: the hourly bursts as a stream that runs three times, each time over the next third of the log."""
    log, source, root = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), folder(spark, "log"), folder(spark, "bursts")
    # One row.
    first, last = log.agg(F.min("ts"), F.max("ts")).first() or (None, None)
    keys, aggs = ["user_id"], {"n": F.count("*"), "kinds": F.size(F.collect_set("event_type")).cast("long")}
    for i in range(3):
        edges = [first + (last - first) * k / 3 if first else None for k in (i, i + 1)]
        part = log.filter((F.col("ts") >= F.lit(edges[0])) & ((F.col("ts") < F.lit(edges[1])) | F.lit(i == 2)))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        if late := hunts.run(hunts.windowed(stream, keys, "ts", aggs), keys, root):
            raise ValueError(f"{late} groups came late")
    return hunts.windows(spark, keys, root).filter("n >= 2").select("user_id", text("window_start").alias("hour"), "n", "kinds")

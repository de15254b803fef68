"""Windowed hunts as streams: event-time windows with a watermark (O-52, O-54)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, keys: Sequence[str], time: str, aggs: Mapping[str, Column], window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Aggregates by keys and tumbling window of a stream; state is kept until no row within `delay` can still reach it."""
    own = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, window).alias("window"))
    return own.agg(*(c.alias(n) for n, c in aggs.items())).withColumn("window_start", F.col("window.start")).drop("window")


def run(found: DataFrame, keys: Sequence[str], root: str) -> int:
    """Take all new input of a windowed stream into the table below `root`; how many late groups of rows were left out.

    A window that grows is written anew, with the number of its batch; windows are thus there before the
    watermark closes them, and a batch that is repeated writes the same folder again. A row is late if its
    window ended before the watermark, which is the newest time of earlier runs less the delay; late rows are
    counted by key, window and task, as they reach the state.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/windows/batch={number}")

    query = found.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def windows(spark: SparkSession, keys: Sequence[str], root: str) -> DataFrame:
    """The newest state of each key and window."""
    rows = spark.read.parquet(f"{root}/windows")
    rest = [c for c in rows.columns if c not in {*keys, "window_start", "batch"}]
    last = rows.groupBy(*keys, "window_start").agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*keys, "window_start", *(f"last.{c}" for c in rest))

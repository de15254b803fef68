"""Grouped aggregates, windows and rankings of hunts."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cloudsift.sources.scratch import cut

#: A limit that asks for all rows in no order: results that are counted or united need no sort of all their groups.
ANY_ORDER = 0


@dataclass(frozen=True)
class Text:
    """An aggregate of a group's texts: all different ones in order, the least, or that of the newest row (equal times: the largest)."""

    name: str
    value: Column | str
    kind: str = "joined"
    time: str | None = None

    def of_pairs(self) -> Column:
        """Its value over the group's different texts, each with its newest time."""
        picks = {"joined": lambda: joined("_text"), "least": lambda: F.min("_text"), "newest": lambda: first_of("_text", "_at", largest=True)}
        return picks[self.kind]().alias(self.name)


def grouped(df: DataFrame, keys: Sequence[Column | str], aggs: Sequence[Column | Text]) -> DataFrame:
    """Groups with aggregates and texts, in the order given.

    Spark's hash aggregation holds no texts: one of them beside counts of distinct values has all rows sorted by group, once for
    each count. So each text comes from the pairs of group and text, which are hashed, and meets the other aggregates by group.
    """
    names = df.select(*keys).columns
    found = df.groupBy(*keys).agg(*(a for a in aggs if not isinstance(a, Text)))
    rest, order = iter(found.columns[len(names) :]), list(names)
    for a in aggs:
        order.append(a.name if isinstance(a, Text) else next(rest))
    for t in aggs:
        if isinstance(t, Text):
            value = F.col(t.value) if isinstance(t.value, str) else t.value
            at = F.max(F.when(value.isNotNull(), F.col(t.time))) if t.time else F.lit(None)
            pairs = df.groupBy(*keys, value.alias("_text")).agg(at.alias("_at"))
            own = pairs.groupBy(*(F.col(n).alias(f"_{n}") for n in names)).agg(t.of_pairs())
            found = found.join(own, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]).drop(*(f"_{n}" for n in names))
    return found.select(*order)


def group_hunt(df: DataFrame, keys: Sequence[Column | str], aggs: Sequence[Column | Text], where: Column | None = None, having: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """O-51 to O-56, O-69: groups over a threshold, the first by order. Filters stand before the shuffle."""
    df = df.filter(where) if where is not None else df
    found = grouped(df, keys, aggs)
    found = found.filter(having) if having is not None else found
    return top(found, limit, *order)


def top(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first rows by order; all where there is no limit, and with ANY_ORDER unsorted."""
    df = df.orderBy(*order) if order and limit != ANY_ORDER else df
    return df.limit(limit) if limit else df


def first_of(value: Column | str, by: Column | str, largest: bool = False) -> Column:
    """O-57: the value at the least (largest) `by` among rows that have one; equal `by` go to the least (largest) value."""
    value, by = (F.col(x) if isinstance(x, str) else x for x in (value, by))
    pair = F.when(value.isNotNull() & by.isNotNull(), F.struct(by.alias("by"), value.alias("value")))
    return (F.max(pair) if largest else F.min(pair))["value"]


def daily_sketches(df: DataFrame, keys: Sequence[str], time: str, value: str, precision: int = 14) -> DataFrame:
    """O-60: a sketch of the distinct values of each key and day, to be kept and merged for any span."""
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(F.hll_sketch_agg(F.col(value).cast("string"), precision).alias("sketch"))


def sketched_distinct(sketches: DataFrame, keys: Sequence[str], name: str = "distinct_values") -> DataFrame:
    """O-60: distinct values of each key over all days of kept sketches, without the rows."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def joined(value: Column | str, sep: str = ", ", most: int | None = None) -> Column:
    """O-55, O-56: the distinct values in order as one text, or the first of them."""
    values = F.sort_array(F.collect_set(value))
    return F.array_join(F.slice(values, 1, most) if most else values, sep)


def share(condition: Column, among: Column | None = None) -> Column:
    """O-62: the part of the rows (of those in `among`) where a condition holds; null counts as not."""
    flag = F.when(condition, 1.0).otherwise(0.0)
    return F.avg(F.when(among, flag) if among is not None else flag)


def stage_chain(df: DataFrame, keys: Sequence[Column | str], stages: Mapping[str, Column], least: int, aggs: Sequence[Column] = ()) -> DataFrame:
    """O-61: groups that reached `least` of the stages; one 0/1 column for each."""
    flags = [F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in stages.items()]
    total = sum((F.col(n) for n in stages), F.lit(0))
    return df.groupBy(*keys).agg(*flags, *aggs).withColumn("stages", total).filter(F.col("stages") >= least)


def baseline_ratio(df: DataFrame, partition: Sequence[str], value: str, least: float | None = None) -> DataFrame:
    """O-63, O-68: value over its partition's average, kept from `least` on."""
    mean = F.avg(value).over(Window.partitionBy(*partition))
    out = df.withColumns({"baseline": mean, "ratio": F.col(value) / F.when(mean != 0, mean)})
    return out.filter(F.col("ratio") >= least) if least is not None else out


class Median:
    """The median of values that come one by one: the lower half in a heap of negated values, the upper half in another."""

    def __init__(self) -> None:
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, value: float) -> None:
        """Take a value."""
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def now(self) -> float | None:
        """The median; of an even number of values the mean of the middle two."""
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def earlier_medians(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """The rows with the number of the key's earlier rows, of those that have a value, and their median.

    A key's rows are read once in their order (equal days by value), so n days cost n log n; a growing window
    would sort each row's days anew. A key's rows are one group: as many as it has days.
    """
    names = ["earlier_rows", "earlier_days", "earlier_median"]

    def run(rows: pa.Table) -> pa.Table:
        nulls_first = [(day, "ascending"), (value, "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=nulls_first, null_placement="at_start"))
        seen, counts, medians = Median(), [], []
        for x in rows[value].cast(pa.float64()).to_pylist():
            counts.append(len(seen.low) + len(seen.high))
            medians.append(seen.now())
            if x is not None:
                seen.add(x)
        for name, column in zip(names, (pa.array(range(len(rows)), pa.int64()), pa.array(counts, pa.int64()), pa.array(medians, pa.float64())), strict=True):
            rows = rows.append_column(name, column)
        return rows

    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType() if n == "earlier_median" else LongType()) for n in names)])
    return df.groupBy(key).applyInArrow(run, schema)


def prior_median_ratio(df: DataFrame, key: str, day: str, value: str, least: float | None = None, days: int = 1) -> DataFrame:
    """O-48: a day's value over the median of the key's earlier days, where there are `days` of them."""
    out = earlier_medians(df, key, day, value).drop("earlier_rows")
    out = out.withColumn("ratio", F.col(value) / F.when(F.col("earlier_median") != 0, F.col("earlier_median"))).filter(F.col("earlier_days") >= days)
    return out.filter(F.col("ratio") >= least) if least is not None else out


def gaps(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """O-64: seconds since the key's previous distinct bucket; the first has none."""
    window = Window.partitionBy(*keys).orderBy(bucket)
    own = df.select(*keys, bucket).distinct()
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_timestamp(c.cast("timestamp"))
    return own.withColumn("gap", seconds(bucket) - seconds(F.lag(bucket).over(window)))


def periodicity(df: DataFrame, keys: Sequence[str], time: str, grain: str = "minute", buckets: int = 5, span: int = 3600, spread: float = 0.5) -> DataFrame:
    """O-59, O-64: keys seen in many buckets over a long span at even gaps (spread: deviation over mean)."""
    own = gaps(df.withColumn("bucket", F.date_trunc(grain, time)), keys, "bucket")
    found = own.groupBy(*keys).agg(
        F.count("*").alias("buckets"),
        F.percentile("gap", 0.5).alias("median_gap"),
        (F.stddev_pop("gap") / F.avg("gap")).alias("variation"),
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        F.sum("gap").alias("span"),
    )
    return found.filter((F.col("buckets") >= buckets) & (F.col("span") >= span) & (F.col("variation") <= spread))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """O-65: the first k rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def fan_out(df: DataFrame, a: str, b: str) -> DataFrame:
    """O-66: pairs with how many b an a has and how many a a b has, where either is over 1.

    The counts are grouped and joined rather than windowed: a value that a third of all rows share
    is then summed before the shuffle, and its pairs are split by the join.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    out = pairs.join(pairs.groupBy(a).agg(F.count("*").alias(f"{b}_per_{a}")), a).join(pairs.groupBy(b).agg(F.count("*").alias(f"{a}_per_{b}")), b)
    return out.filter((F.col(f"{b}_per_{a}") > 1) | (F.col(f"{a}_per_{b}") > 1))


def pareto(df: DataFrame, value: str, weight: str, partition: str) -> DataFrame:
    """O-67, O-91: place, cumulative weight and its share of the partition's total, heaviest first.

    Rows are sorted in ranges over partition, weight and value, and written; sums run within a range, and each
    range takes up what the ranges before it hold of its partition. So a partition of any size is spread
    over many tasks, and only one row for each range and partition meets in one place.
    """
    by = [F.col(partition), F.col(weight).desc_nulls_last(), F.col(value).asc_nulls_last()]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumn("_range", F.shiftright("_id", 33)), "pareto")
    ranges = ordered.groupBy(F.col(partition).alias("_p"), F.col("_range").alias("_r")).agg(F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_p")
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_p", "_r", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.sum("_sum").over(whole).alias("_total"))
    own = Window.partitionBy(partition, "_range").orderBy("_id")
    sums = ordered.withColumns({"_place": F.row_number().over(own), "_upto": F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    met = sums.join(offsets, F.col(partition).eqNullSafe(F.col("_p")) & (F.col("_range") == F.col("_r")))
    upto = F.when(F.col("_total").isNotNull(), F.col("_base") + F.coalesce("_upto", F.lit(0)))
    return met.select(*df.columns, (F.col("_rows") + F.col("_place")).cast("int").alias("place"), upto.alias("upto"), (upto / F.col("_total")).alias("upto_share"))


def values_covering(df: DataFrame, value: str, weight: str, partition: str, part: float) -> DataFrame:
    """O-91: how many of the heaviest values reach a part of each partition's total."""
    return pareto(df, value, weight, partition).filter(F.col("upto_share") >= part).groupBy(partition).agg(F.min("place").alias("values_needed"))


def first_seen(df: DataFrame, keys: Sequence[str], time: str, within: str, anchor: str = "max", aggs: Sequence[Column] = ()) -> DataFrame:
    """O-45: keys first seen in the last `within` of the data (anchor max), or later than that after its start (min)."""
    seen = df.groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"), *aggs)
    edge = df.agg((F.max(time) if anchor == "max" else F.min(time)).alias("edge"))
    shift = F.expr(f"edge - INTERVAL {within}") if anchor == "max" else F.expr(f"edge + INTERVAL {within}")
    # One row.
    return seen.crossJoin(F.broadcast(edge)).filter(F.col("first_seen") >= shift).drop("edge")


def relative_window(df: DataFrame, time: str, within: str) -> DataFrame:
    """O-45: rows in the last `within` before the data's newest row; no wall clock."""
    edge = df.agg(F.max(time).alias("edge"))
    return df.crossJoin(F.broadcast(edge)).filter(F.col(time) >= F.expr(f"edge - INTERVAL {within}")).drop("edge")


def result_timeline(df: DataFrame, time: str, grain: str, measure: str | None = None) -> DataFrame:
    """O-93: rows per bucket, or the sum of a measure."""
    return df.groupBy(F.date_trunc(grain, time).alias("bucket")).agg((F.sum(measure) if measure else F.count("*")).alias("value"))


def boundaries(first: Column, last: Column, grain: str) -> Column:
    """Calendar borders between two times, as day or minute: not whole units."""
    if grain == "day":
        return F.datediff(last, first)
    seconds = {"second": 1, "minute": 60, "hour": 3600}[grain]
    cut = lambda c: F.unix_timestamp(F.date_trunc(grain, c).cast("timestamp"))
    return ((cut(last) - cut(first)) / seconds).cast("long")

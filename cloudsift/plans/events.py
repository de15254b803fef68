"""Each hunting operator over the driver's event log and orders, with the SQL that it must equal.

The event log stands in for an audit log: ts, event_type, user_id and $.k of props for time, action,
principal and a request parameter.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators import combine as C
from cloudsift.operators import group as G
from cloudsift.operators import shape as S
from cloudsift.operators.charts import Chart, run_chart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EVENTS = S.Profile("events", "ts")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with its parameter as k."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def text(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time as text."""
    return F.date_format(c, pattern)


T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
E = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query(f"""SELECT user_id, {T.format("date_trunc('hour', ts)")} AS hour, count(*) AS n, count(DISTINCT event_type) AS kinds
FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) >= 2""")
def o54_burst_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-52, O-54: principals with several actions in an hour."""
    found = G.group_hunt(events(spark, sf_dir), ["user_id", F.date_trunc("hour", "ts").alias("h")], [F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")], having=F.col("n") >= 2)
    return found.select("user_id", text("h").alias("hour"), "n", "kinds")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 23:59:59'")
def o34_apply_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-34: an inclusive window of days."""
    return S.apply_filters(events(spark, sf_dir), EVENTS, date(2024, 1, 5), date(2024, 1, 9)).select("event_id", "user_id", "event_type")


@query("""SELECT c AS "column", n AS "rows", filled, filled = 0 AS gap FROM (SELECT count(*) AS n, count(user_id) AS u, count(props) AS p, count(nullif(event_type, event_type)) AS z FROM events),
LATERAL (VALUES ('user_id', u), ('props', p), ('missing', z)) AS v(c, filled)""")
def o35_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-35: filled values per required column."""
    df = events(spark, sf_dir).withColumn("missing", F.nullif("event_type", F.col("event_type")))
    return S.coverage(df, ["user_id", "props", "missing"])


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def o36_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-36: the caller's limit after the hunt's order (a top-k report)."""
    return S.row_limit(events(spark, sf_dir).orderBy(F.desc("value"), "event_id"), 25, preset=100).select("event_id", "user_id", "value")


@query("""SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS parameter FROM events
WHERE event_type IN ('error', 'purchase') AND props LIKE '%"k": 7%' ORDER BY ts DESC, event_id LIMIT 100""")
def o37_event_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-37: predicate, JSON path, newest first."""
    where = F.col("event_type").isin("error", "purchase") & F.col("props").like('%"k": 7%')
    return S.event_hunt(events(spark, sf_dir), where, {"parameter": ("props", "$.k")}, ["event_id", "user_id", "event_type", "ts"], [F.desc("ts"), F.asc("event_id")], 100).drop("ts")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 200")
def o40_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40: the newest rows of one value of an allowed column."""
    return S.pivot_to(events(spark, sf_dir), EVENTS, "event_type", "error", ["event_type", "user_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT 'errors' AS label, 'high' AS severity, count(*) AS hits FROM events WHERE event_type = 'error'
UNION ALL SELECT 'large', 'medium', count(*) FROM events WHERE value > 100
UNION ALL SELECT 'late signup', 'low', count(*) FROM events WHERE event_type = 'signup' AND hour(ts) >= 22""")
def o41_bulk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41: hits of several hunts in one pass."""
    late = (F.col("event_type") == "signup") & (F.hour("ts") >= 22)
    return S.bulk_counts(events(spark, sf_dir), {"errors": ("high", F.col("event_type") == "error"), "large": ("medium", F.col("value") > 100), "late signup": ("low", late)})


@query("""WITH d AS (SELECT user_id, count(*) AS denials, min(ts) AS first_denied FROM events WHERE event_type = 'error' GROUP BY user_id),
a AS (SELECT user_id, min(ts) AS first_allowed FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, denials, date_diff('minute', first_denied, first_allowed) AS minutes FROM d JOIN a USING (user_id) WHERE first_allowed > first_denied""")
def o42_sequence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42: denied, then allowed; minutes are calendar borders."""
    df = events(spark, sf_dir)
    denied = df.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("denials"), F.min("ts").alias("first_denied"))
    allowed = df.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first_allowed"))
    found = C.sequence_join(denied, allowed, ["user_id"], "first_denied", "first_allowed")
    return found.select("user_id", "denials", G.boundaries(F.col("first_denied"), F.col("first_allowed"), "minute").alias("minutes"))


@query("""SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def o43_with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43: every key with its facts, absent ones 0."""
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return C.with_facts(table(spark, sf_dir, "customer"), facts, ["c_custkey"], {"orders": 0}).select("c_custkey", "c_mktsegment", "orders")


@query("""SELECT n_name, r_name, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def o44_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44: fact rows with their dimension; Spark broadcasts it while its size allows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    df = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query(f"""SELECT user_id, k, {T.format("min(ts)")} AS first_seen, count(*) AS n FROM {E} GROUP BY user_id, k HAVING min(ts) >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY""")
def o45_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-45: pairs first seen in the last three days of the data."""
    found = G.first_seen(events(spark, sf_dir), ["user_id", "k"], "ts", "3 DAYS")
    return found.select("user_id", "k", text("first_seen").alias("first_seen"), "n")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY event_type")
def o45_relative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-45: the last five days before the newest row."""
    return G.relative_window(events(spark, sf_dir), "ts", "5 DAYS").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT DISTINCT user_id AS principal, date_trunc('day', ts) AS bucket, event_type AS item FROM events)
SELECT a.item AS item_a, b.item AS item_b, count(*) AS together, count(DISTINCT a.principal) AS principals, {T.format("min(a.bucket)")} AS first_bucket, {T.format("max(a.bucket)")} AS last_bucket
FROM s a JOIN s b ON a.principal = b.principal AND a.bucket = b.bucket AND a.item < b.item GROUP BY a.item, b.item""")
def o46_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-46: actions that one principal mixes in a day."""
    found = C.co_occurrence(events(spark, sf_dir), "user_id", F.date_trunc("day", "ts"), "event_type")
    return found.withColumns({c: text(c) for c in ("first_bucket", "last_bucket")})


@query("""WITH r AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT r.user_id, count(e.ts) AS points FROM r LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error') e ON r.user_id = e.user_id AND e.ts BETWEEN a AND b GROUP BY r.user_id""")
def o47_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-47: errors between a principal's first and last purchase."""
    df = events(spark, sf_dir)
    ranges = df.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return C.in_ranges(df.filter("event_type = 'error'"), ranges, ["user_id"], "ts", "start", "stop").select("user_id", "points")


@query(f"""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(k) AS total FROM {E} GROUP BY ALL),
p AS (SELECT *, count(total) OVER w AS earlier_days, quantile_cont(total, 0.5) OVER w AS earlier_median FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, {T.format("day")} AS day, CAST(total AS BIGINT) AS total, earlier_days, round(total / nullif(earlier_median, 0), 4) AS ratio FROM p WHERE earlier_days >= 3 AND total / nullif(earlier_median, 0) >= 2""")
def o48_prior_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48: days of twice the median of the days before."""
    days = events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("k").alias("total"))
    return G.prior_median_ratio(days, "user_id", "day", "total", 2, days=3).select("user_id", text("day").alias("day"), "total", "earlier_days", F.round("ratio", 4).alias("ratio"))


@query("""SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)""")
def o49_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-49: rows of principals without a large error."""
    df = events(spark, sf_dir)
    return C.not_in(df, "user_id", df.filter("event_type = 'error' AND value > 150").select("user_id")).select("event_id", "user_id")


@query(f"""WITH c AS (SELECT k, count(*) AS n FROM {E} GROUP BY k) SELECT event_id, e.k FROM {E} e JOIN c ON e.k = c.k WHERE n < 0.009 * (SELECT count(*) FROM events)""")
def o49_rare_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-49: rows whose parameter is rare."""
    return C.rare_dimension_filter(events(spark, sf_dir), "k", 0.009).select("event_id", "k")


@query(f"""WITH a AS (SELECT k, count(*) AS w FROM {E} WHERE event_type = 'click' GROUP BY k), b AS (SELECT k, count(*) AS w FROM {E} WHERE event_type = 'signup' GROUP BY k)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.w, 0) AS weight_a, coalesce(b.w, 0) AS weight_b, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def o50_compare_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-50: parameters of two actions side by side."""
    return C.compare_sets(events(spark, sf_dir).withColumn("one", F.lit(1)), "event_type", "click", "signup", "k", "one")


@query(f"""SELECT event_type, count(*) AS n, {T.format("min(ts)")} AS first_ts, {T.format("max(ts)")} AS last_ts, CAST(sum(k) AS BIGINT) AS total, round(avg(k), 4) AS mean FROM {E} GROUP BY event_type""")
def o51_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-51: count, min, max, sum, avg."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), text(F.min("ts")).alias("first_ts"), text(F.max("ts")).alias("last_ts"), F.sum("k").alias("total"), F.round(F.avg("k"), 4).alias("mean"))


@query(f"SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT k) AS parameters FROM {E} GROUP BY event_type")
def o52_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-52: several distinct counts."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("k").alias("parameters"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) FILTER (value > 50) AS large_kinds FROM events GROUP BY user_id""")
def o53_filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53: aggregates of some rows of a group."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("large_kinds"))


@query(f"""SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ', ') AS kinds, array_to_string(list_sort(list_distinct(list(k)))[1:5], ', ') AS first_five FROM {E} GROUP BY user_id""")
def o55_o56_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-55, O-56: distinct values as a sorted text, and the first five."""
    return events(spark, sf_dir).groupBy("user_id").agg(G.joined("event_type").alias("kinds"), F.array_join(F.slice(F.sort_array(F.collect_set("k")), 1, 5).cast("array<string>"), ", ").alias("first_five"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_kind, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def o57_arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-57: the first action and the last id by time."""
    return events(spark, sf_dir).groupBy("user_id").agg(G.first_of("event_type", F.struct("ts", "event_id")).alias("first_kind"), G.first_of("event_id", F.struct("ts", "event_id"), largest=True).alias("last_id"))


@query("SELECT n_regionkey, any_value(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def o58_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-58: a value that all rows of a group share."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("n_regionkey").agg(F.any_value("r_name", True).alias("region"))


@query(f"""WITH b AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS bucket FROM events),
g AS (SELECT *, epoch(bucket) - epoch(lag(bucket) OVER (PARTITION BY user_id ORDER BY bucket)) AS gap FROM b)
SELECT user_id, count(*) AS buckets, quantile_cont(gap, 0.5) AS median_gap, round(stddev_pop(gap) / avg(gap), 4) AS variation, {T.format("min(bucket)")} AS first_bucket, {T.format("max(bucket)")} AS last_bucket, CAST(sum(gap) AS BIGINT) AS span
FROM g GROUP BY user_id HAVING count(*) >= 5 AND sum(gap) >= 3600 AND stddev_pop(gap) / avg(gap) <= 1.0""")
def o59_o64_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-59, O-64: principals with even gaps between active hours."""
    found = G.periodicity(events(spark, sf_dir), ["user_id"], "ts", "hour", 5, 3600, 1.0)
    return found.withColumns({"variation": F.round("variation", 4), "first_bucket": text("first_bucket"), "last_bucket": text("last_bucket")})


@query(None)
def o60_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-60: estimated distinct counts; sketches differ between engines."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("""SELECT * FROM (SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS entry, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS fault,
max(CASE WHEN event_type = 'purchase' AND value > 20 THEN 1 ELSE 0 END) AS gain, count(*) AS n, entry + fault + gain AS stages FROM events GROUP BY user_id, date_trunc('day', ts)) WHERE stages >= 3""")
def o61_stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-61: principals and days that passed all three stages."""
    kind = F.col("event_type")
    stages = {"entry": kind == "signup", "fault": kind == "error", "gain": (kind == "purchase") & (F.col("value") > 20)}
    return G.stage_chain(events(spark, sf_dir), ["user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")], stages, 3, [F.count("*").alias("n")])


@query("""SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_share, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FILTER (value > 20), 6) AS large_error_share FROM events GROUP BY user_id""")
def o62_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-62: parts of a group's rows, and of some of them."""
    bad = F.col("event_type") == "error"
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(G.share(bad), 6).alias("error_share"), F.round(G.share(bad, F.col("value") > 20), 6).alias("large_error_share"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, avg(n) OVER (PARTITION BY event_type) AS baseline FROM c)
SELECT user_id, event_type, n, round(n / baseline, 4) AS ratio FROM r WHERE n / baseline >= 1.3""")
def o63_o68_baseline_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-63, O-68: principals that use an action more than others do."""
    counts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return G.baseline_ratio(counts, ["event_type"], "n", 1.3).select("user_id", "event_type", "n", F.round("ratio", 4).alias("ratio"))


@query("""SELECT event_type, user_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE place <= 5""")
def o65_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-65: the five busiest principals of each action (a top-k report)."""
    counts = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return G.top_per_group(counts, ["event_type"], [F.desc("n"), F.asc("user_id")], 5)


@query(f"""WITH p AS (SELECT user_id, k, count(*) AS n FROM {E} GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k_per_user_id, count(*) OVER (PARTITION BY k) AS user_id_per_k FROM p)
SELECT * FROM c WHERE k_per_user_id > 1 OR user_id_per_k > 1""")
def o66_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-66: parameters of a principal and principals of a parameter."""
    return G.fan_out(events(spark, sf_dir), "user_id", "k")


@query(f"""WITH w AS (SELECT event_type, k, count(*) AS n FROM {E} GROUP BY ALL)
SELECT event_type, k, n, row_number() OVER o AS place, CAST(sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, round(sum(n) OVER (o ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY event_type), 6) AS upto_share FROM w WINDOW o AS (PARTITION BY event_type ORDER BY n DESC, k)""")
def o67_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-67: cumulative shares of an action's parameters."""
    weights = events(spark, sf_dir).groupBy("event_type", "k").agg(F.count("*").alias("n"))
    return G.pareto(weights, "k", "n", "event_type").withColumn("upto_share", F.round("upto_share", 6))


@query(f"""WITH w AS (SELECT event_type, k, count(*) AS n FROM {E} GROUP BY ALL), p AS (SELECT event_type, row_number() OVER o AS place, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY event_type) AS s FROM w WINDOW o AS (PARTITION BY event_type ORDER BY n DESC, k))
SELECT event_type, min(place) AS values_needed FROM p WHERE s >= 0.8 GROUP BY event_type""")
def o91_values_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-91: how many parameters hold four fifths of an action."""
    weights = events(spark, sf_dir).groupBy("event_type", "k").agg(F.count("*").alias("n"))
    return G.values_covering(weights, "k", "n", "event_type", 0.8)


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) ORDER BY n DESC, user_id NULLS LAST, event_type NULLS LAST LIMIT 50")
def o69_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-69: many-key order and limit (a top-k report)."""
    return G.group_hunt(events(spark, sf_dir), ["user_id", "event_type"], [F.count("*").alias("n")], order=[F.desc("n"), F.asc_nulls_last("user_id"), F.asc_nulls_last("event_type")], limit=50)


@query(f"""SELECT type, value, count(*) AS n, count(DISTINCT event_type) AS kinds FROM (SELECT 'principal' AS type, CAST(user_id AS VARCHAR) AS value, event_type FROM events UNION ALL SELECT 'parameter', CAST(k AS VARCHAR), event_type FROM {E}) WHERE value IS NOT NULL GROUP BY type, value""")
def o72_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-72: an indicator sheet of two columns."""
    return C.indicators(events(spark, sf_dir), {"principal": "user_id", "parameter": "k"}, [F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")])


@query("SELECT l_suppkey AS value FROM lineitem UNION SELECT l_partkey FROM lineitem UNION SELECT l_orderkey FROM lineitem")
def o73_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-73: distinct values of three columns from one scan."""
    return C.distinct_values(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_orderkey"])


@query("""SELECT tag, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM (SELECT o_custkey, unnest(string_split(o_orderpriority, '-')) AS tag FROM orders) GROUP BY tag""")
def o74_explode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-74: groups by the parts of a list."""
    df = table(spark, sf_dir, "orders").withColumn("parts", F.split("o_orderpriority", "-"))
    return C.explode_rollup(df, "parts", "tag", [F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers")])


@query("""SELECT o_orderstatus, tag_kind, tag, count(*) AS n FROM (
SELECT o_orderstatus, 'tactic' AS tag_kind, o_orderstatus AS tag FROM orders UNION ALL SELECT o_orderstatus, 'technique', 'T' || (o_custkey % 7) FROM orders
UNION ALL SELECT o_orderstatus, CASE WHEN regexp_matches(t, '^[Gg][0-9]{4}$') THEN 'group' ELSE 'other' END, t FROM (SELECT o_orderstatus, 'G' || lpad(CAST(o_custkey % 12 AS VARCHAR), 4, '0') AS t FROM orders UNION ALL SELECT o_orderstatus, o_orderpriority FROM orders)) GROUP BY ALL""")
def o74_tags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-74: tags of four kinds in long form."""
    key = F.col("o_custkey")
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.array("o_orderstatus").alias("Tactics"), F.array(F.concat(F.lit("T"), (key % 7).cast("string"))).alias("TechniqueIDs"), F.array(F.concat(F.lit("G"), F.lpad((key % 12).cast("string"), 4, "0")), "o_orderpriority").alias("OtherTags"))
    return C.tags_long(df).groupBy("o_orderstatus", "tag_kind", "tag").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') AND user_id NOT IN (1, 2, 3) AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL)""")
def o94_dashboard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-94: time range, values in and values out; a filter on an absent column does nothing."""
    df = S.dashboard_filters(events(spark, sf_dir), EVENTS, datetime(2024, 1, 2), datetime(2024, 1, 20), {"event_type": ["click", "view", "error"], "region": ["x"]}, {"user_id": [1, 2, 3]})
    return df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM events GROUP BY event_type) SELECT event_type, 'n' AS metric, n AS value FROM m UNION ALL SELECT event_type, 'users', users FROM m""")
def o95_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-95: measures in long form."""
    wide = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return S.melt_measures(wide, ["event_type"], ["n", "users"])


@query(f"SELECT {T.format("date_trunc('day', ts)")} AS bucket, count(*) AS value FROM events GROUP BY date_trunc('day', ts)")
def o93_result_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-93: rows per day."""
    return G.result_timeline(events(spark, sf_dir), "ts", "day").withColumn("bucket", text("bucket"))


def data(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Datasets of the charts."""
    return {"events": events(spark, sf_dir), "customers": table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))}


def counted(**more: Column) -> dict[str, Column]:
    """The row count and other metrics."""
    return {"n": F.count("*"), **more}


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error'")
def c1_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1: one global aggregate."""
    return run_chart(Chart("kpi", "events", counted(users=F.count_distinct("user_id")), where=F.col("event_type") == "error"), data(spark, sf_dir))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 10 ORDER BY n DESC, user_id LIMIT 40")
def c2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: grouped top-N with a threshold (a top-k report)."""
    return run_chart(Chart("top", "events", counted(), {"user_id": F.col("user_id")}, having=F.col("n") >= 10, limit=40), data(spark, sf_dir))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n, user_id LIMIT 40")
def o70_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-70: the rarest first (a bottom-k report)."""
    return run_chart(Chart("top", "events", counted(), {"user_id": F.col("user_id")}, limit=40), data(spark, sf_dir), rare=True)


@query(f"SELECT {T.format("time_bucket(INTERVAL 5 MINUTE, ts)")} AS bucket, event_type, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL 5 MINUTE, ts), event_type")
def c3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: a series in buckets of five minutes with a breakdown."""
    chart = Chart("series", "events", counted(), {"event_type": F.col("event_type")}, time="ts", grain="PT5M", limit=2_000_000_000)
    return run_chart(chart, data(spark, sf_dir)).withColumn("bucket", text("bucket"))


@query("SELECT isodow(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def c4_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: weekday by hour."""
    return run_chart(Chart("heatmap", "events", counted(), {"weekday": F.weekday("ts") + 1, "hour": F.hour("ts")}), data(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def c5_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5: composition."""
    return run_chart(Chart("pie", "events", counted(), {"event_type": F.col("event_type")}), data(spark, sf_dir))


@query("SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def c6_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6: a rollup by country."""
    return run_chart(Chart("map", "customers", counted(), {"country": F.col("n_name")}), data(spark, sf_dir))

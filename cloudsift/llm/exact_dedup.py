"""Exact deduplication by distributed MSD radix partitioning.

Rows are split by successive digits of their normalised text, most significant first, until a group
holds one row or its texts have ended; two texts are equal when they end in the same group, so no
digest decides equality. A digit is a run of whole characters (so of whole bytes), and its width grows
geometrically from round to round: a text of n characters needs O(log n) rounds. A round counts the
groups with partial aggregation, writes those with more than one row, and joins the rows to them; rows
that meet no group are alone and leave. Both sides of that join are plain scans, so a group with a
third of all rows is split by Spark's skew join (hence the merge hints). Nothing is collected but whether rows are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.store import Store, free, only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters in the first digit, and how much wider each next one is.
FIRST_DIGIT, WIDEN = 64, 16


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def radix_groups(spark: SparkSession, rows: DataFrame, key: str, text: str, first_digit: int = FIRST_DIGIT, widen: int = WIDEN, row: str | None = None) -> DataFrame:
    """One row per row of `rows`: key, keep (the group's largest key), group_size, kept, text_sha256; and `row`, if given.

    `rows` needs the columns `key` (long) and `text` (string); others are ignored. A null text is empty;
    a row whose key is null is kept only if no key of its group is known. Of repeated (key, text) rows
    exactly one is kept; `row` names a column of distinct written numbers to tell which. An empty table gives an empty result.
    """
    store = Store(spark, "exact_dedup")
    docs = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(row).alias("row")] if row else []))

    # Digit 0 is the group's name until rows get stable numbers, by being written.
    first = docs.select(normalised(F.substring("text", 1, first_digit)).alias("gid"))
    shared = store.put(first.groupBy("gid").agg(F.count("*").alias("n")).filter("n > 1").select("gid"), "shared0")
    met = docs.withColumn("gid0", normalised(F.substring("text", 1, first_digit))).join(shared.hint("merge"), F.col("gid0") == F.col("gid"), "left")
    split = met.select(
        "row" if row else F.monotonically_increasing_id().alias("row"),
        "key",
        F.sha2(normalised(F.col("text")), 256).alias("sha"),
        "gid",
        F.when(F.col("gid").isNotNull(), normalised(F.expr(f"substring(text, {first_digit + 1})"))).alias("rest"),
    )
    split = store.put(split, "round0")
    alone = [split.filter("gid is null").select("row", "key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")]
    live, width, k = split.filter("gid is not null"), first_digit, 0

    while live.limit(1).count():
        k, width = k + 1, width * widen
        digit = live.withColumns({"digit": F.substring("rest", 1, width), "ended": F.length("rest") <= width})
        groups = digit.groupBy("gid", "digit", "ended").agg(
            F.count("*").alias("n"),
            F.max("key").alias("keep"),
            F.coalesce(F.max_by("row", "key"), F.max("row")).alias("keep_row"),
            F.max("row").alias("next"),
        )
        groups = store.put(groups.filter("n > 1").select(*(F.col(c).alias(f"g_{c}") for c in groups.columns)), f"shared{k}")
        met = digit.join(groups.hint("merge"), (F.col("gid") == F.col("g_gid")) & (F.col("digit") == F.col("g_digit")) & (F.col("ended") == F.col("g_ended")), "left")
        met = store.put(
            met.select(
                "row", "key", "sha", F.col("g_next").alias("gid"), "ended",
                F.when(F.col("g_gid").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                F.when(F.col("g_gid").isNull(), F.col("key")).otherwise(F.col("g_keep")).alias("keep"),
                F.coalesce("g_n", F.lit(1)).cast("long").alias("n"),
                F.coalesce(F.col("g_keep_row") == F.col("row"), F.lit(True)).alias("kept"),
            ),
            f"round{k}",
        )
        alone.append(met.filter("gid is null or ended").select("row", "key", "keep", "n", "kept", "sha"))
        live = met.filter("gid is not null and not ended").select("row", "key", "sha", "gid", "rest")

    out = alone[0]
    for more in alone[1:]:
        out = out.unionAll(more)
    return out.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), *([F.col("row").alias(row)] if row else []))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest doc_id of a group stays."""
    return radix_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


OP1_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns they came with.

    One row of each text stays, by a written number: null and repeated doc_ids are rows like others, null
    and empty texts are one text, and no documents give no documents.
    """
    rows = Store(spark, "exact_stage").numbered(docs, row=(row := free(docs.columns)))
    kept = radix_groups(spark, rows, "doc_id", "text", row=row).filter("kept").select(row)
    return only(rows.join(kept, row, "left_semi"), docs.columns)

"""Chat formatting by prefix-target expansion, with Spark SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply
lies under the loss mask. A conversation that ends on another turn, or has no reply, gives one more
example with an empty mask, so that no turn is lost. Turns are marked as

    <|im_start|>role\\ntext<|im_end|>\\n

and a marker can't come from a text: an opening sign before a bar gets an exclamation mark in between
(one more if there are some already), which is taken away again on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    """No marker is left; `unescaped` undoes it."""
    return F.regexp_replace(text, r"<(!*)\|", "<!$1|")


def unescaped(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, r"<!(!*)\|", "<$1|")


def name(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unnamed(role: Column) -> Column:
    """What `name` was given."""
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, alone, example, text, loss_start, loss_end, last): offsets count characters from 0, ends exclusive.

    Turns go by number, and by role and text where numbers repeat; repeated rows are repeated turns. A
    null text or role is empty. A row without an id belongs to no other: it is a conversation of its own,
    which `alone` numbers (null for all others). Other columns are ignored; no rows give no examples. A
    conversation is one example's text, so it is gathered as a whole.
    """
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone")
    said = turns.select(F.col(conv).alias("conv"), alone, F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("said"))
    whole = said.groupBy("conv", "alone").agg(F.sort_array(F.collect_list("said")).alias("said"))
    head = lambda s: F.concat(F.lit(START), name(s["role"]), F.lit("\n"))
    whole = whole.withColumn("parts", F.transform("said", lambda s: F.struct(head(s).alias("head"), escaped(s["text"]).alias("body"), (s["role"] == TARGET).alias("target"))))
    n = F.size("parts")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["target"] | (i == n))
    each = whole.select("conv", "alone", "parts", n.alias("n"), F.explode(wanted).alias("example"))
    own = F.element_at("parts", F.col("example"))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("example") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    each = each.select("conv", "alone", "example", "n", own.alias("own"), F.concat(context, own["head"]).alias("before"))
    start = F.length("before")
    return each.select(
        F.col("conv").alias(conv),
        "alone",
        "example",
        F.concat("before", F.col("own")["body"], F.lit(END + "\n")).alias("text"),
        start.alias("loss_start"),
        F.when(F.col("own")["target"], start + F.length(F.col("own")["body"])).otherwise(start).alias("loss_end"),
        (F.col("example") == F.col("n")).alias("last"),
    )


def turns_of(text: Column) -> Column:
    """The (role, text) of a formatted text, in order."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    body = lambda p: F.substring_index(p, END, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(unnamed(F.substring_index(body(p), "\n", 1)).alias("role"), unescaped(F.substr(body(p), F.instr(body(p), F.lit("\n")) + 1)).alias("text")),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: what the examples say about its turns and its trainable text."""
    said = F.when(F.col("last"), turns_of(F.col("text")))
    rows = formatted.withColumn("said", said)
    rows = rows.select(
        conv,
        "alone",
        F.size("said").alias("n"),
        F.sha2(F.array_join(F.transform("said", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"),
        F.struct("example", unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("reply")).alias("loss"),
        F.length("text").alias("chars"),
    )
    rows = rows.groupBy(conv, "alone").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    replies = F.array_join(F.transform("loss", lambda x: x["reply"]), "")
    return rows.select(conv, "n_turns", "turns_sha256", F.length(replies).cast("long").alias("loss_chars"), F.sha2(replies.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the markers themselves."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(f"{END}{START}assistant ok").alias("text")
    )
    return read_back(examples(told.unionByName(tricky)))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c AS (
  SELECT *, sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(!*)\|', '<!\1|', 'g')) + length('<|im_end|>') + 1)
              OVER (PARTITION BY conv_id, alone ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, alone
"""

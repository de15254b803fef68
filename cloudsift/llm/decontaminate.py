"""Benchmark decontamination by winnowing.

A text's fingerprints are the minimum k-gram hashes of its sliding windows (the rightmost of equal
ones). With GRAM = 8 words and windows of 6 hashes, every 13 consecutive words that a document shares
with a benchmark item hold a k-gram that both sides selected. Items of 1 to 12 words are one window:
their fingerprint is the whole item, and documents are matched at those lengths. Each fingerprint
carries the words around it, so that a hit is extended to the left and right where it is found; a run
of 13 shared words (or the whole short item) is a contamination.

Documents meet a bitmap of fixed size (BITMAP bits, whatever the benchmark) that drops fingerprints no
item has; the survivors are joined with the items' fingerprints, and Spark chooses how. Hits are
merged per document and item first, then per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm import words as W
from cloudsift.llm.store import ROW, Store, free, only

WINDOW, GRAM = 13, 8
#: Bits of the map that is sent to every task.
BITMAP = 1 << 24
#: A document is contaminated when SHARE * n_hit >= n_words and n_hit > 0.
SHARE = 20

PRINTS = "key long, h long, gram int, at long, before array<long>, after array<long>"


def winnow(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost minimum of every `width` consecutive hashes inside one row of [first[i], first[i + 1])."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low, at = hashes[:m].copy(), np.arange(m)
    for j in range(1, width):
        later = hashes[j : j + m]
        take = later <= low
        low[take], at[take] = later[take], np.flatnonzero(take) + j
    row = np.searchsorted(first, np.arange(m), "right") - 1
    return np.unique(at[np.arange(m) + width <= first[row + 1]])


def hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first): row i has words first[i] to first[i + 1]."""
    buf = W.LOWER[buf]
    starts, ends, first = W.spans(buf, offsets, W.LETTER_DIGIT)
    return W.span_hash(W.prefix_hash(buf), starts, ends), first


def fingerprints(one: np.ndarray, first: np.ndarray, short: list[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram, positions, hashes): selected k-grams of the rows, and all grams of the lengths in `short`.

    With short None the rows are items: those under WINDOW words give their one whole gram.
    """
    size = np.diff(first)
    if len(one) >= WINDOW:
        grams = W.gram_hash(one, GRAM)
        # A row of n words has n - GRAM + 1 grams; those that run over its end must not be selected.
        row = np.searchsorted(first, np.arange(len(grams)), "right") - 1
        whole = np.flatnonzero((np.arange(len(grams)) + GRAM <= first[row + 1]) & (size[row] >= WINDOW))
        counts = np.bincount(row[whole], minlength=len(size))
        at = whole[winnow(grams[whole], np.concatenate([[0], np.cumsum(counts)]), WINDOW - GRAM + 1)]
        yield GRAM, at, grams[at]
    for n in range(1, WINDOW) if short is None else short:
        grams = W.gram_hash(one, n)
        row = np.searchsorted(first, np.arange(len(grams)), "right") - 1
        at = np.flatnonzero((np.arange(len(grams)) + n <= first[row + 1]) & ((size[row] == n) if short is None else True))
        # Other lengths must not meet: a whole item is matched at its own length only.
        yield -n, at, grams[at]


def rows_of(keys: pa.Array, one: np.ndarray, first: np.ndarray, found: Iterator[tuple[int, np.ndarray, np.ndarray]], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Record batches of fingerprints with the words around them, as many as a shared window can hold."""
    reach = WINDOW - GRAM
    for gram, at, h in found:
        h = W.mix(h + W.U64(gram + 100))
        if wanted is not None:
            bit = (h % W.U64(BITMAP)).astype(np.int64)
            keep = (wanted[bit >> 6] >> (bit & 63).astype(W.U64)) & W.U64(1) == 1
            at, h = at[keep], h[keep]
        if not len(at):
            continue
        row = np.searchsorted(first, at, "right") - 1
        if gram > 0:
            low, high = np.maximum(first[row], at - reach), np.minimum(first[row + 1], at + GRAM + reach)
            before = [one[a:b][::-1].view(np.int64) for a, b in zip(low, at, strict=True)]
            after = [one[a:b].view(np.int64) for a, b in zip(at + gram, high, strict=True)]
        else:
            before = after = [np.zeros(0, np.int64)] * len(at)
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(np.full(len(at), gram, np.int32)), pa.array(at - first[row]), pa.array(before, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int64()))],
            names=["key", "h", "gram", "at", "before", "after"],
        )


def prints(short: list[int] | None, wanted: np.ndarray | None):
    """A mapInArrow function from (key, text) to fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offsets in W.chunks(batch.column(1)):
                one, first = hashed(buf, offsets)
                yield from rows_of(batch.column(0).slice(row, len(first) - 1), one, first, fingerprints(one, first, short), wanted)

    return run


def extended(hits: DataFrame) -> DataFrame:
    """(key, item, start, stop): shared runs around each pair of equal fingerprints that are long enough."""
    # Equal words on either side: the place of the first difference.
    run = "coalesce(nullif(array_position(zip_with(slice({a}, 1, least(size({a}), size({b}))), slice({b}, 1, least(size({a}), size({b}))), (x, y) -> x <=> y), false), 0) - 1, least(size({a}), size({b})))"
    hits = hits.withColumns({"left_": F.expr(run.format(a="before", b="item_before")), "right_": F.expr(run.format(a="after", b="item_after"))})
    hits = hits.filter(f"gram < 0 or left_ + gram + right_ >= {WINDOW}")
    return hits.select("key", "item", (F.col("at") - F.col("left_")).alias("start"), (F.col("at") + F.abs("gram") + F.col("right_")).alias("stop"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated; and `row`, if given.

    Null and empty texts have no words: nothing is hit, and items without words match nothing. Long texts
    are read whole. An empty item table leaves every document clean; no documents give no rows. Each
    document row gets a verdict of its own, also where its key is null or repeats: `row` names a column of
    distinct written numbers (else rows get them here). Repeated items count once, and items without an
    id hit words but are not named or counted. Other columns of either table are ignored.
    """
    store = Store(spark, "decontaminate")
    named = docs.select(F.col(key).cast("long").alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *([F.col(row).alias(ROW)] if row else []))
    named = named if row else store.numbered(named)
    docs = named.select(F.col(ROW).alias("key"), "text")
    items = items.select(F.col(item).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = store.put(items.mapInArrow(prints(None, None), PRINTS).distinct(), "items")

    # At most BITMAP / 64 longs and WINDOW lengths reach the driver.
    bit = F.col("h").bitwiseAND(F.lit(BITMAP - 1))
    bits = marks.select(bit.alias("bit")).groupBy(F.expr("bit >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    wanted = np.zeros(BITMAP >> 6, np.int64)
    if bits:
        wanted[[r.word for r in bits]] = [r.bits for r in bits]
    wanted = wanted.view(W.U64)
    short = sorted(-r.gram for r in marks.filter("gram < 0").select("gram").distinct().collect())

    shipped = spark.sparkContext.broadcast(wanted)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offsets in W.chunks(batch.column(1)):
                one, first = hashed(buf, offsets)
                yield from rows_of(batch.column(0).slice(row, len(first) - 1), one, first, fingerprints(one, first, short), shipped.value)

    # A passage that many items share is met once: items are named by their surroundings only after that.
    place = F.xxhash64("h", "gram", "before", "after")
    there = marks.select(place.alias("item"), "h", F.col("gram").alias("item_gram"), F.col("before").alias("item_before"), F.col("after").alias("item_after")).distinct()
    met = docs.mapInArrow(survivors, PRINTS).join(there, "h").filter("gram = item_gram")
    runs = store.put(extended(met).distinct(), "runs")
    words = runs.select("key", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    owners = marks.filter("key is not null").select(place.alias("item"), F.col("key").cast("string").alias("owner")).distinct()
    owned = runs.select("key", "item").distinct().join(owners, "item").select("key", "owner").distinct().groupBy("key").agg(F.sort_array(F.collect_list("owner")).alias("items"))
    found = store.put(words.join(owned, "key", "left"), "found")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, name, n_words)."""
        for batch in batches:
            for at, buf, offsets in W.chunks(batch.column(2)):
                _, _, first = W.spans(W.LOWER[buf], offsets, W.LETTER_DIGIT)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(first) - 1) for i in (0, 1)), pa.array(np.diff(first).astype(np.int64))], names=["key", "name", "n_words"])

    sizes = named.select(F.col(ROW).alias("key"), "name", "text").mapInArrow(sized, "key long, name long, n_words long")
    out = sizes.join(found, "key", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("name").alias(key),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
        *([F.col("key").alias(row)] if row else []),
    )


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark passages."""
    return contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS r(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, len(ws) - n + 2)) AS r(i)),
hits AS (SELECT DISTINCT doc_id, item_id, i, dw.n FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, with the columns they came with.

    Rows are judged one by one by a written number, so null and repeated doc_ids get verdicts of their
    own; null and empty texts stay, and no documents give no documents.
    """
    rows = Store(spark, "decontaminate_stage").numbered(docs, row=(row := free(docs.columns)))
    bad = contamination(spark, rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row=row).filter("contaminated").select(row)
    return only(rows.join(bad, row, "left_anti"), docs.columns)

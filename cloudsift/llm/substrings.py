"""Removal of repeated byte strings: every byte under a 200-byte window that also starts elsewhere.

Windows are compared by content in three steps of falling size, so that no step sorts or ships all of
them. A window belongs to its least gram of GRAM bytes (the rightmost of equal ones): equal windows have
equal grams at equal distances, and neighbouring windows mostly share theirs, so a text becomes runs of
windows. Runs whose gram occurs once are unique. Runs that are equal as a whole are repeated. What is
left differs somewhere near its gram, at the edges of repeated passages: it is cut into blocks of BLOCK
windows, which are unique if what all windows of the block share is unique and repeated if all that
they cover is; and the windows of the few blocks in between are compared one by one. Every comparison is
a count by key with partial aggregation and a join of plain scans, so that a passage that a third of
all texts share is never gathered in one task.
"""


from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm import words as W
from cloudsift.llm.store import ROW, Store

LENGTH, GRAM = 200, 64
#: Windows in a block.
BLOCK = 8
WIDTH = LENGTH - GRAM + 1


def grams(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, from prefix_hash."""
    _, down = W.powers(n + 1)
    return W.mix((h[k : n + 1] - h[: n + 1 - k]) * down[: n + 1 - k])


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the rightmost minimum of every `width` consecutive values."""
    value, place, step = g, np.arange(len(g), dtype=np.int32), 1
    while step < width:
        move = min(step, width - step)
        right = value[move:]
        left = value[: len(right)]
        later = right <= left
        value, place = np.where(later, right, left), np.where(later, place[move:], place[: len(right)])
        step += move
    return place


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, last, anchor, h, ext): the windows a to last of a text whose least gram is the one at anchor."""
    for batch in batches:
        for row, buf, offsets in W.chunks(batch.column(1)):
            n = len(buf)
            if n < LENGTH:
                continue
            h = W.prefix_hash(buf)
            g = grams(h, n, GRAM)
            place = least_places(g, WIDTH)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
            inside = np.arange(len(place)) + LENGTH <= offsets[doc + 1]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate([[True], (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])]))
            a, last = at[first], at[np.concatenate([first[1:] - 1, [len(at) - 1]])]
            anchor = place[a]
            ext = W.mix(W.span_hash(h, a, last + LENGTH) ^ W.mix((anchor - a).astype(W.U64)))
            own = doc[a]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own + row)), pa.array((a - offsets[own]).astype(np.int64)), pa.array((last - offsets[own]).astype(np.int64)), pa.array((anchor - offsets[own]).astype(np.int64)), pa.array(g[anchor].view(np.int64)), pa.array(ext.view(np.int64))],
                names=["key", "a", "last", "anchor", "h", "ext"],
            )


RUNS = "key long, a long, last long, anchor long, h long, ext long"


def pieces(size: int):
    """A mapInArrow function from (key, text, runs of (a, last, anchor, m)) to pieces of at most `size` windows.

    (key, a, last, anchor, m, core, ext): pieces start at multiples of `size` windows before the anchor,
    `core` is what all windows of a full piece share, and `ext` what the windows of this one cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for row, buf, offsets in W.chunks(batch.column(1)):
                own = lists.slice(row, len(offsets) - 1)
                base = np.repeat(offsets[:-1], own.value_lengths().to_numpy(zero_copy_only=False))
                doc = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
                a, last, anchor, m = (x.to_numpy(zero_copy_only=False) for x in own.flatten().flatten())
                # Distances from the window to the anchor, nearest first.
                near, far = (anchor - last) // size, (anchor - a) // size
                count = far - near + 1
                which = np.repeat(np.arange(len(a)), count)
                piece = near[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                low = np.maximum(piece * size, (anchor - last)[which])
                high = np.minimum(piece * size + size - 1, (anchor - a)[which])
                h, at = W.prefix_hash(buf), anchor[which] + base[which]
                mark = W.mix(piece.astype(W.U64) + W.U64(size << 20))
                core = W.mix(W.span_hash(h, at - piece * size, at - piece * size - size + 1 + LENGTH) ^ mark)
                ext = W.mix(W.span_hash(h, at - high, at - low + LENGTH) ^ W.mix((low * 1000 + high).astype(W.U64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[which] + row)), *(pa.array(x.astype(np.int64)) for x in ((anchor[which] - high), (anchor[which] - low), anchor[which], m[which])), pa.array(core.view(np.int64)), pa.array(ext.view(np.int64))],
                    names=["key", "a", "last", "anchor", "m", "core", "ext"],
                )

    return run


PIECES = "key long, a long, last long, anchor long, m long, core long, ext long"


def cut(keep: bool):
    """A mapInArrow function from (key, text, spans) to (key, n_bytes, n_removed, n_spans, kept, sha).

    A span is start << 32 | stop. `kept` is what lies outside the spans, null without `keep`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for row, buf, offsets in W.chunks(batch.column(1)):
                columns = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "sha")}
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True), row):
                    data = buf[a:b]
                    packed = np.sort(lists[i].values.to_numpy(zero_copy_only=False)) if lists[i].is_valid else np.zeros(0, np.int64)
                    start, stop = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
                    first = np.concatenate([[True], start[1:] > stop[:-1]]) if len(start) else np.zeros(0, bool)
                    start, stop = start[first], stop[np.concatenate([first[1:], [True]])] if len(stop) else stop
                    out = np.delete(data, np.concatenate([np.arange(x, y) for x, y in zip(start, stop, strict=True)])) if len(start) else data
                    out = out.tobytes()
                    columns["n_bytes"].append(len(data))
                    columns["n_removed"].append(len(data) - len(out))
                    columns["n_spans"].append(len(start))
                    columns["kept"].append(out if keep else None)
                    columns["sha"].append(hashlib.sha256(out).hexdigest())
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), *(pa.array(v, t) for v, t in zip(columns.values(), types, strict=True))], names=["key", *columns])

    return run


def without_repeats(spark: SparkSession, rows: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """One row per row: key, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    `kept` is null in rows without any repeated run, whose text stays as it is, and everywhere without `keep`.

    A null text is empty; texts under LENGTH bytes lose nothing; long ones are read whole. Rows are
    documents of their own by a written number, also where their key is null or repeats, so repeated rows
    remove each other. Other columns are ignored; no rows give no rows.
    """
    store = Store(spark, "substrings")
    named = store.numbered(rows.select(F.col(key).cast("long").alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    docs = named.select(F.col(ROW).alias("key"), "text")
    found = docs.mapInArrow(runs, RUNS)
    again = store.put(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "again")
    found = store.put(found.join(again.hint("merge"), "h"), "found")

    # The texts that hold such runs, shuffled once; of the others, only the digest is needed.
    held = store.put(found.select(F.col("key").alias("held")).distinct(), "held")
    split = docs.join(held.hint("merge"), F.col("key") == F.col("held"), "left")
    split = store.put(split.select("key", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("held").isNotNull(), F.col("text")).alias("text"), F.when(F.col("held").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "split")
    pool = split.filter("text is not null").select("key", "text")

    # Equal runs; of the others, one of each kind, where kinds differ under one gram.
    kinds = store.put(found.groupBy("h", "ext").agg(F.count("*").alias("m"), F.min("key").alias("key"), F.min_by(F.struct("a", "last", "anchor"), "key").alias("run")), "kinds")
    equal = found.join(kinds.filter("m > 1").select("h", "ext").hint("merge"), ["h", "ext"], "left_semi").select("key", "a", "last")
    several = store.put(kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("m").alias("least")).filter("k > 1 and least = 1").select("h"), "several")
    open_ = kinds.join(several.hint("merge"), "h", "left_semi").select("key", "run.*", "m")

    spans = [equal]
    for size in (BLOCK, 1):
        own = store.put(open_.groupBy("key").agg(F.collect_list(F.struct("a", "last", "anchor", "m")).alias("runs")), f"own{size}")
        cuts = pool.join(own.withColumnRenamed("key", "own").hint("merge"), F.col("key") == F.col("own")).select("key", "text", "runs")
        cuts = store.put(cuts.mapInArrow(pieces(size), PIECES), f"pieces{size}")
        cores = store.put(cuts.groupBy("core").agg(F.sum("m").alias("n"), F.min("ext").alias("low"), F.max("ext").alias("high")).filter("n > 1").select(F.col("core").alias("met"), (F.col("low") != F.col("high")).alias("open")), f"cores{size}")
        cuts = store.put(cuts.join(cores.hint("merge"), F.col("core") == F.col("met")).drop("met"), f"met{size}")
        store.drop(f"pieces{size}", f"cores{size}", f"own{size}")
        if size == 1:
            # One window: its core is all of it.
            spans.append(cuts.filter("m = 1").select("key", "a", "last"))
            break
        kinds = store.put(cuts.filter("open").groupBy("core", "ext").agg(F.sum("m").alias("m"), F.min("key").alias("key"), F.min_by(F.struct("a", "last", "anchor"), "key").alias("run")), "block_kinds")
        equal = cuts.filter("open and m = 1").join(kinds.filter("m > 1").select("core", "ext").hint("merge"), ["core", "ext"], "left_semi")
        spans += [cuts.filter("not open and m = 1").select("key", "a", "last"), equal.select("key", "a", "last")]
        open_ = kinds.select("key", "run.*", "m")

    every = spans[0]
    for more in spans[1:]:
        every = every.unionAll(more)
    packed = F.shiftleft("a", 32).bitwiseOR(F.col("last") + LENGTH)
    own = store.put(every.groupBy("key").agg(F.collect_list(packed).alias("spans")), "spans")
    left = pool.join(own.withColumnRenamed("key", "own").hint("merge"), F.col("key") == F.col("own"), "left").select("key", "text", "spans")
    left = left.mapInArrow(cut(keep), "key long, n_bytes long, n_removed long, n_spans long, kept binary, sha string")
    rest = split.filter("text is null").select("key", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept"), "sha", "n_bytes")
    every = left.unionByName(rest).join(named.select(F.col(ROW).alias("key"), "name").hint("merge"), "key")
    return every.select(F.col("name").alias(key), "n_bytes", "n_removed", "n_spans", "kept", F.col("sha").alias("kept_sha256"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents, as digests."""
    return without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False).drop("kept")

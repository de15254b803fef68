"""Near-duplicate groups by circulant MinHash.

One pass turns a text into its set of word shingles and a signature from two permutations: sigma sends
a shingle to one of DOMAIN places, pi is a table over those places, and coordinate k of the signature
is the least pi(sigma(s) + k) over the set: the same pi shifted circularly by k. Bands of the signature
give candidate links, 1-bit sketches and set sizes weed them out, and every link that counts is
confirmed on the full shingle sets of the two texts.

A bucket of m texts never emits its m * m / 2 pairs. First, texts with equal sets become one class. Then
come star rounds: a bucket emits one link from its hub to each member of another component. Components
are merged, and buckets that lie in one component leave. Of the texts in what remains, those in different
components are paired over their rarest shingles (see `across_components`), which loses no link and
keeps apart the many texts that share one passage.
Components are found by label propagation with pointer jumping over tables in the shared folder.

At a similarity of 0.75, a pair meets in no band with a probability of 7e-6 (5 rows, 44 bands), and
its sketch of 128 bits falls below the bar at six standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm import words as W
from cloudsift.llm.store import ROW, Store, free, only

SHINGLE = 5
#: A link: SCALE * intersection >= LEAST * union.
LEAST, SCALE = 75, 100
DOMAIN = 1 << 18
ROWS, BANDS = 5, 44
SKETCH = 128
STARS = 2
#: Pairs across components for each row of the open buckets that are fine without another star round.
CHEAP = 50
#: Counters of shingle frequencies.
SLOTS = 1 << 18


@lru_cache(maxsize=1)
def circulant(coordinates: int) -> np.ndarray:
    """Row i holds pi(i), pi(i + 1), ... pi(i + coordinates - 1), circularly; a view of one table."""
    pi = np.argsort(W.mix(np.arange(DOMAIN, dtype=W.U64) + W.U64(77))).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each row; fewer than k words are one shingle, no words an empty set."""
    buf = W.LOWER[buf]
    starts, ends, first = W.spans(buf, offsets, W.NOT_SPACE)
    one = W.span_hash(W.prefix_hash(buf), starts, ends)
    grams, out = W.gram_hash(one, k), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else W.gram_hash(one[a:b], b - a) if b > a else one[:0])
    return out


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each shift over a set, in blocks of bounded size."""
    table, least = circulant(coordinates), None
    at = (W.mix(shingles ^ W.U64(0x5851F42D4C957F2D)) % W.U64(DOMAIN)).astype(np.int64)
    for i in range(0, len(at), 512):
        low = table[at[i : i + 512]].min(axis=0)
        least = low if least is None else np.minimum(least, low)
    return least


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: key, n, a digest of the set (two longs), the sketch (two longs) and the band hashes."""
    bands = np.arange(1, BANDS + 1, dtype=W.U64) * W.U64(0xD6E8FEB86659FD93)
    for batch in batches:
        for row, buf, offsets in W.chunks(batch.column(1)):
            sets = shingle_sets(buf, offsets)
            n = np.array([len(s) for s in sets])
            digest, sketch, hashes = np.zeros((len(n), 2), W.U64), np.zeros((len(n), SKETCH // 64), W.U64), np.zeros((len(n), BANDS), W.U64)
            for i, s in enumerate(sets):
                if not len(s):
                    continue
                digest[i] = W.mix(s + W.U64(1)).sum(), W.mix(s ^ W.U64(0xA5A5A5A5A5A5A5A5)).sum()
                low = signature(s, ROWS * BANDS).astype(W.U64)
                sketch[i] = np.packbits((low[:SKETCH] & W.U64(1)).astype(np.uint8)).view(W.U64)
                band, mixed = low.reshape(BANDS, ROWS), bands
                for r in range(ROWS):
                    mixed = W.mix(mixed + band[:, r])
                hashes[i] = mixed
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32), hashes[n > 0].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(n)), pa.array(n.astype(np.int64)), *(pa.array(x) for x in digest.view(np.int64).T.copy()), *(pa.array(x) for x in sketch.view(np.int64).T.copy()), lists],
                names=["key", "n", "d1", "d2", "s1", "s2", "bands"],
            )


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, text_a, text_b) whose full sets are similar enough."""
    last, last_set = None, None
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        yes = np.zeros(batch.num_rows, bool)
        for row, buf, offsets in W.chunks(right):
            for i, s in enumerate(shingle_sets(buf, offsets), row):
                if last != (key := a[i].as_py()):
                    text = np.frombuffer(left[i].as_py().encode(), np.uint8)
                    last, last_set = key, shingle_sets(text, np.array([0, len(text)]))[0]
                both = len(np.intersect1d(last_set, s, assume_unique=True))
                yes[i] = SCALE * both >= LEAST * (len(last_set) + len(s) - both)
        keep = pa.array(yes)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def components(store: Store, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of all nodes on edges (a, b): comp is the least node that is reachable."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("peer")))
    near = store.put(both.distinct(), f"{name}_near")
    labels = store.put(near.groupBy("node").agg(F.least("node", F.min("peer")).alias("comp")), f"{name}_0")
    k = 0
    while True:
        # The least label among the neighbours, then the label of that label.
        heard = near.join(labels.select(F.col("node").alias("peer"), "comp"), "peer").groupBy("node").agg(F.min("comp").alias("heard"))
        heard = store.put(heard, f"{name}_heard{k}")
        step = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("via"))
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), "via", "left")
        new = store.put(jump.select("node", "was", F.least("via", F.coalesce("far", "via")).alias("comp")), f"{name}_{k + 1}")
        done = not new.filter("comp < was").limit(1).count()
        store.drop(f"{name}_heard{k}", f"{name}_{k}")
        labels, k = new.select("node", "comp"), k + 1
        if done:
            store.drop(f"{name}_near")
            return labels


def near_groups(spark: SparkSession, rows: DataFrame, key: str, text: str, row: str | None = None) -> DataFrame:
    """One row per row of `rows`: key, n_shingles, component_id (the least key reachable over links), kept; and `row`, if given.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows are linked like
    equal texts. Exactly one row of a component is kept: keys may repeat, and those that are null come
    after all others, so that a component without a key has a null component_id. `row` names a column of
    distinct written numbers (else rows get them here). Other columns are ignored; an empty table gives an empty result.
    """
    store = Store(spark, "near_dedup")
    named = rows.select(F.col(key).cast("long").alias("name"), F.col(text).cast("string").alias("text"), *([F.col(row).alias(ROW)] if row else []))
    named = named if row else store.numbered(named)
    # From here on, a row's number is its key.
    docs = named.select(F.col(ROW).alias("key"), "text")
    signed = store.put(docs.mapInArrow(sign, "key long, n long, d1 long, d2 long, s1 long, s2 long, bands array<long>"), "signed")

    # Equal sets are one class, named by its least key.
    sets = store.put(signed.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("key").alias("cls")), "sets")
    classes = signed.join(sets.select("cls").distinct(), F.col("key") == F.col("cls"), "left_semi").dropDuplicates(["key"])
    facts = store.put(classes.select(F.col("key").alias("cls"), "n", "s1", "s2"), "facts")
    marks = classes.select(F.explode("bands").alias("bucket"), F.col("key").alias("cls"))
    hubs = store.put(marks.groupBy("bucket").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).filter("hub < top").select("bucket", "hub"), "hubs")
    members = store.put(marks.join(hubs, "bucket").select("bucket", "cls", "hub"), "members")
    store.drop("hubs")

    facts_a, facts_b = (facts.select(*(F.col(c).alias(f"{c}_{x}") for c in facts.columns)) for x in "ab")
    near = "n_a * {s} >= n_b * {l} and n_b * {s} >= n_a * {l} and bit_count(s1_a ^ s1_b) + bit_count(s2_a ^ s2_b) <= {most}"
    # Bits differ with a chance of (1 - similarity) / 2 each; six standard deviations above the mean at the bar.
    p = (1 - LEAST / SCALE) / 2
    near = near.format(s=SCALE, l=LEAST, most=int(SKETCH * p + 6 * (SKETCH * p * (1 - p)) ** 0.5))

    # The texts that any later step needs, shuffled once.
    wanted = store.put(members.select("cls").distinct(), "wanted")
    pool = store.put(docs.join(wanted.hint("merge"), F.col("key") == F.col("cls"), "left_semi"), "pool")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that hold on the full sets of the texts."""
        pairs = store.put(pairs, f"{name}_pairs")
        sides = pairs.join(pool.select(F.col("key").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        sides = sides.join(pool.select(F.col("key").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")
        return store.put(sides.mapInArrow(confirm, "a long, b long"), f"{name}_links")

    weighed = lambda pairs: pairs.distinct().join(facts_a, F.col("a") == F.col("cls_a")).join(facts_b, F.col("b") == F.col("cls_b")).filter(near).select("a", "b")

    tried, label, star = None, None, 0
    while True:
        if label is None:
            pairs = members.filter("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
        else:
            open_ = store.put(spanning(members, label), f"open{star}")
            sizes = open_.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("across"), F.sum("m").alias("rows"))
            across, rows_open = sizes.agg(F.sum("across"), F.sum("rows")).first()
            if not rows_open:
                break
            if star >= STARS or across <= CHEAP * rows_open:
                rest = across_components(store, pool, open_.select("cls", "comp").distinct(), facts, near)
                label = merged(store, label, links(rest.join(tried, ["a", "b"], "left_anti"), "rest"), "comp")
                break
            # Another hub in each bucket that still spans components: the least by a hash of this round.
            by = F.xxhash64("cls", F.lit(star))
            hub = store.put(open_.groupBy("bucket").agg(F.min_by("cls", by).alias("hub"), F.min_by("comp", by).alias("hub_comp")), f"hub{star}")
            pairs = open_.join(hub, "bucket").filter("comp <> hub_comp").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"))
        pairs = weighed(pairs)
        label = merged(store, label, links(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"star{star}"), f"comp{star}")
        told = spark.read.schema("a long, b long").parquet(f"{store.root}/star{star}_pairs")
        tried, star = told if tried is None else tried.unionAll(told), star + 1

    own = signed.select("key", "n", "d1", "d2").join(sets, ["n", "d1", "d2"], "left")
    own = own.join(label.withColumnRenamed("node", "cls"), "cls", "left")
    own = own.select("key", "n", F.coalesce("comp", "cls", "key").alias("comp")).join(named.select(F.col(ROW).alias("key"), "name"), "key")
    own = store.put(own, "own")
    # The least name of each component of several rows, then the least number.
    least = F.min(F.struct(F.col("name").isNull().alias("unknown"), "name", "key")).alias("least")
    several = store.put(own.groupBy("comp").agg(least, F.count("*").alias("rows")).filter("rows > 1").select("comp", "least"), "several")
    out = own.join(several.hint("merge"), "comp", "left")
    alone = F.col("least").isNull()
    return out.select(
        F.col("name").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("name")).otherwise(F.col("least.name")).alias("component_id"),
        (alone | (F.col("key") == F.col("least.key"))).alias("kept"),
        *([F.col("key").alias(row)] if row else []),
    )


def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): how many shingles fall into each of SLOTS counters."""
    for batch in batches:
        for _, buf, offsets in W.chunks(batch.column(1)):
            n = np.bincount((np.concatenate(shingle_sets(buf, offsets)) % W.U64(SLOTS)).astype(np.int64), minlength=SLOTS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def across_components(store: Store, pool: DataFrame, placed: DataFrame, facts: DataFrame, near: str) -> DataFrame:
    """Pairs (a, b) of placed texts (cls, comp) in different components that may be similar; none that is gets lost.

    Two sets of a similarity of t or more share one of the first (1 - t) n + 1 shingles of either, in any
    common order, and where they first meet bounds their overlap. In the order of rising frequency, a
    passage that many texts share comes last and brings no two of them together. Frequencies are counters of fixed size, summed by Spark.
    """
    spark = store.spark
    placed = store.put(placed, "placed")
    texts = store.put(pool.join(placed, F.col("key") == F.col("cls")).select("key", "text", "comp"), "placed_texts")
    counts = texts.select("key", "text").mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    often = np.zeros(SLOTS, np.int64)
    # At most SLOTS rows of two numbers.
    for r in counts.collect():
        often[r.slot] = r.n
    shipped = spark.sparkContext.broadcast(often)

    def first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offsets in W.chunks(batch.column(1)):
                own = []
                for shingles in shingle_sets(buf, offsets):
                    order = np.lexsort((shingles, shipped.value[(shingles % W.U64(SLOTS)).astype(np.int64)]))
                    own.append(shingles[order[: len(shingles) - -(-LEAST * len(shingles) // SCALE) + 1]])
                at = pa.array(np.repeat(np.arange(row, row + len(own)), [len(x) for x in own]))
                place = pa.array(np.concatenate([np.arange(len(x)) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), place, batch.column(0).take(at), batch.column(2).take(at)], names=["shingle", "place", "cls", "comp"])

    first = store.put(texts.mapInArrow(first_shingles, "shingle long, place long, cls long, comp long"), "first")
    wide = store.put(first.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("shingle"), "wide")
    # Similar sets are of one size class or of neighbouring ones: a shingle that many share is split by it.
    size = F.floor(F.log("n") / math.log(SCALE / LEAST) + 1e-9)
    told = store.put(first.join(wide, "shingle").join(facts, "cls").withColumn("size", size), "told")
    left, right = (told.select(*(F.col(c).alias(f"{c}_{x}") for c in told.columns)) for x in "ab")
    left = left.withColumn("size_a", F.explode(F.array(*(F.col("size_a") + d for d in (-1, 0, 1)))))
    # Where two sets first meet, the rest of either bounds what they share.
    bound = F.expr(f"least(n_a - place_a, n_b - place_b) * {SCALE + LEAST} >= {LEAST} * (n_a + n_b)")
    rest = left.join(right, (F.col("shingle_a") == F.col("shingle_b")) & (F.col("size_a") == F.col("size_b")) & (F.col("comp_a") < F.col("comp_b")) & bound & F.expr(near))
    return rest.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def spanning(members: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, cls, comp) of the buckets that hold more than one component."""
    placed = members.select("bucket", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("comp", "cls").alias("comp"))
    wide = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket")
    return placed.join(wide, "bucket")


def merged(store: Store, label: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """Labels after more links: components of the links between the old components."""
    if label is None:
        return components(store, links, name)
    if not links.limit(1).count():
        return label
    old = label.withColumnRenamed("comp", "old")
    ends = links.join(old.withColumnRenamed("node", "a"), "a", "left").withColumn("x", F.coalesce("old", "a")).drop("old")
    ends = ends.join(old.withColumnRenamed("node", "b"), "b", "left").withColumn("y", F.coalesce("old", "b"))
    new = components(store, ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), f"{name}_new")
    both = label.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
    alone = new.join(label, "node", "left_anti")
    return store.put(both.unionByName(alone.select("node", "comp")), f"{name}_all")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents, over all documents."""
    return near_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, with the columns it came with.

    Rows are told apart by a written number, so null and repeated doc_ids are rows like others; texts
    without words are linked with nothing and stay; no documents give no documents.
    """
    rows = Store(spark, "near_stage").numbered(docs, row=(row := free(docs.columns)))
    kept = near_groups(spark, rows, "doc_id", "text", row).filter("kept").select(row)
    return only(rows.join(kept, row, "left_semi"), docs.columns)

"""WARC archives: writing with deduplication, and reading with boundary-chain verification.

Writing: a payload that occurs more than once is stored by the page with the smallest id (a response);
the others point at it (revisit). Spark's text writer lays down the files, with the blank lines that end
a record as its line separator. Files may be of any size.

Reading: payloads may hold record magic, so magic does not tell where records begin. Spark's text reader
cuts files of any size at magic, in splits, and each task emits the candidate records of its splits with
the places that their lengths lead to (their successors), relative to the split. A split's place in its
file is the sum of the splits before it. Splits are cut into segments of SEGMENT bytes: `exit` is the
first successor outside the record's segment. From the start of each file, pointer jumping over the exits
(the reached set and the length of the jumps double each round) finds where the true chain enters each
segment; inside one, a record is on the chain when the entry's place in the forest of successors lies
below it (nested intervals). Everything else is rejected, and is payload of the record before it: such
payloads are put together again from their pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudsift.llm.store import Store

MAGIC, GAP = b"WARC/1.0\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SEGMENT = 1 << 20
#: A payload of fewer bytes is always stored.
LEAST_BYTES = 0
#: Bits of the map of digests that occur again: six hex digits of one.
BITMAP = 1 << 24
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: A place behind a magic, relative to its split; those that can't be records have no successor (`to`). A split's last row has the type END and the split's size for `at`.
FOUND = "path string, split long, seg long, at long, to long, exit long, enter long, leave long, start long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
END = "-"


def base32_of(digest: Column) -> Column:
    """Upper-case base32 of a hex SHA-1: each five hex digits are four signs of five bits."""
    sign = lambda bits, shift: F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1))
    group = lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(*(sign(group(i), s) for s in (15, 10, 5, 0)))), "")


def slot(digest: str) -> Column:
    """The place of a hex digest in a map of BITMAP bits."""
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("int")


def occurs_again(same: DataFrame):
    """A column function of slots: whether a digest of `same` may have this slot. The map that is sent to tasks has BITMAP bits, whatever the input."""
    bits = same.select(slot("same").alias("slot")).groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).collect()
    held = np.zeros(BITMAP >> 6, np.int64)
    if bits:
        held[[r.word for r in bits]] = [r.bits for r in bits]
    shipped = same.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def again(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shipped.value[at >> 6] >> (at & 63)) & 1 == 1)

    return again


def write(pages: DataFrame, path: str, store: Store) -> None:
    """Archives of pages (page_id, url, html) below path; other columns are ignored, no pages give no records.

    A null html is empty; a null url is left out of its record, and so is a null id: of equal payloads, a
    record without an id is a response, and ids are compared without it. Rows that repeat a page's id and
    payload are of equal rank, so each of them is what the first is.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    same = rows.filter(F.col("bytes") >= LEAST_BYTES).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    same = store.put(same.filter("n > 1 and first is not null").select(F.col("sha").alias("same"), "first"), "same")
    # Pages whose payload surely occurs once are written where they are read; only the others are shuffled.
    again = occurs_again(same)
    single = rows.filter(~again(slot("sha"))).withColumn("first", F.lit(None).cast("long"))
    others = rows.filter(again(slot("sha"))).join(same.hint("merge"), F.col("sha") == F.col("same"), "left").drop("same")
    rows = single.unionByName(others).withColumn("digest", base32_of(F.col("sha")))
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n").otherwise(""),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def number(value: str | None) -> int | None:
    """The page of <urn:page:7>."""
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def fields_of(content: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, start of the block, its length) of what follows a magic, if it can be a record."""
    head = content.find(b"\r\n\r\n")
    if head < 0:
        return None
    fields = {}
    for row in content[:head].decode("utf-8", "replace").split("\r\n"):
        key, _, value = row.partition(": ")
        fields[key.lower()] = value
    length = fields.get("content-length", "")
    return (fields, head + 4, int(length)) if length.isdigit() and len(length) < 16 else None


def described(fields: dict[str, str], block: bytes | None) -> tuple:
    """(page, payload bytes, digest, type, refers to, url): of a response, the first three come from its block, if that is at hand."""
    kind = fields.get("warc-type")
    size = digest = None
    if kind == "revisit":
        length, digest = fields.get("warc-payload-length", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        size = int(length) if length.isdigit() else None
    elif block is not None:
        body = block.find(b"\r\n\r\n")
        payload = block[body + 4 :] if body >= 0 else b""
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return number(fields.get("warc-record-id")), size, digest, kind, number(fields.get("warc-refers-to")), fields.get("warc-target-uri")


def forest(places: list[int], successors: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(exit, enter, leave) of each place, in the order given (rising): nested intervals of successor trees inside segments."""
    where = {p: i for i, p in enumerate(places)}
    exits, below = list(successors), [[] for _ in places]
    roots = []
    for i in reversed(range(len(places))):
        j = where.get(successors[i])
        if j is not None and places[j] // SEGMENT == places[i] // SEGMENT:
            exits[i] = exits[j]
            below[j].append(i)
        else:
            roots.append(i)
    enter, leave, clock = [0] * len(places), [0] * len(places), 0
    for root in roots:
        stack = [(root, False)]
        while stack:
            i, done = stack.pop()
            clock += 1
            if done:
                leave[i] = clock
            else:
                enter[i] = clock
                stack.append((i, True))
                stack += [(j, False) for j in below[i]]
    return exits, enter, leave


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A record batch of rows."""
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(columns, types, strict=True)], names=list(names))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND out of (path, split, what lies between two magics), in the order of the file."""
    own, at, found, none = None, 0, [], []

    def done() -> pa.RecordBatch:
        exits, enter, leave = forest([x[0] for x in found], [x[1] for x in found])
        rows = [(*own, begin // SEGMENT, begin, to, out, a, b, start, *more) for (begin, to, start, *more), out, a, b in zip(found, exits, enter, leave, strict=True)]
        rows += [(*own, begin // SEGMENT, begin, *[None] * 11) for begin in none]
        return table([*rows, (*own, None, at, *[None] * 8, END, None, None)], FOUND)

    for batch in batches:
        for path, split, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            content = content.as_py()
            if own != (path, split):
                if own:
                    yield done()
                own, at, found, none = (path, split), 0, [], []
                # What lies before a file's first magic is no record; other splits begin behind a magic.
                if not split:
                    at = len(content)
                    continue
            begin, at = at, at + len(MAGIC) + len(content)
            if record := fields_of(content):
                fields, start, length = record
                block = content[start : start + length] if start + length <= len(content) else None
                found.append((begin, begin + len(MAGIC) + start + length + len(GAP), len(MAGIC) + start, *described(fields, block)))
            else:
                none.append(begin)
    if own:
        yield done()


def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, split, place behind which a magic stands, content), as `scan` counts places."""
    own, at = None, 0
    for batch in batches:
        places = []
        for path, split, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(2)).to_pylist(), strict=True):
            fresh, own = own != (path, split), (path, split)
            at = 0 if fresh else at
            # A file's first piece has no magic before it.
            places.append(-1 if fresh and not split else at)
            at += size + (0 if fresh and not split else len(MAGIC))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(2)], names=["path", "split", "local", "content"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, payload bytes, digest) out of (file, at, to, start, contents of the pieces in order)."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            file, at, to, start, pieces = (batch.column(c)[i].as_py() for c in range(5))
            record = MAGIC + MAGIC.join(pieces)
            if len(record) < to - at - len(GAP):
                raise ValueError("pieces of a record are missing: the archives were split anew between two reads")
            rows.append((file, at, *described({}, record[start : to - at - len(GAP)])[1:3]))
        yield table(rows, "file long, at long, own_bytes long, own_digest string")


def with_payloads(chain: DataFrame, places: DataFrame, text: DataFrame, splits: DataFrame, store: Store) -> DataFrame:
    """The chain with the payloads of records that hold magic: their pieces are read again and put together, each record by itself."""
    broken = chain.filter("payload_digest is null and not record_type <=> 'revisit'").select("file", "at", "to", "start")
    broken = store.put(broken, "broken")
    if not broken.limit(1).count():
        return chain
    # Places meet the records around them by blocks of SEGMENT bytes.
    blocks = broken.withColumn("block", F.explode(F.sequence(F.expr(f"at div {SEGMENT}"), F.expr(f"to div {SEGMENT}"))))
    inner = places.select("file", "split", "local", F.col("at").alias("place"), F.expr(f"at div {SEGMENT}").alias("block")).join(blocks, ["file", "block"]).filter("place >= at and place < to")
    inner = store.put(inner.join(splits.select("file", "split", "path"), ["file", "split"]).select("path", "split", "local", "file", "at", "to", "start", "place"), "inner")
    pieces = text.mapInArrow(located, "path string, split long, local long, content binary").join(inner, ["path", "split", "local"])
    pieces = pieces.groupBy("file", "at", "to", "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]).alias("pieces"))
    own = store.put(pieces.mapInArrow(joined, "file long, at long, own_bytes long, own_digest string"), "payloads")
    out = chain.join(own.hint("merge"), ["file", "at"], "left")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "own_bytes"), "payload_digest": F.coalesce("payload_digest", "own_digest")})


def read(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """The records of all archives below path, plain or gzipped: those on the chain from the start of their file.

    Files may be of any size: a split is a task's work. A file without a record at its start gives no
    records, and no files give none; records that repeat are all given.
    """
    text = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("content"))
    found = store.put(text.mapInArrow(scan, FOUND), "scan")
    # Files by number, and where their splits begin.
    ends = found.filter(F.col("record_type") == END).select("path", "split", F.col("at").alias("size"))
    files = store.put(ends.select("path").distinct().withColumn("file", F.monotonically_increasing_id()), "files")
    before = F.sum("size").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = store.put(ends.withColumn("base", F.coalesce(before, F.lit(0))).join(files.hint("merge"), "path").select("path", "split", "file", "base"), "splits")
    placed = found.filter(F.coalesce("record_type", F.lit("")) != END).join(splits.hint("merge"), ["path", "split"])
    lift = lambda c: (F.col(c) + F.col("base")).alias(c)
    placed = placed.select("file", "split", "seg", lift("at"), F.col("at").alias("local"), lift("to"), lift("exit"), "enter", "leave", "start", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    places = store.put(placed, "found")
    found = places.filter("to is not null")

    jump = found.select("file", "at", F.col("exit").alias("to"))
    reached = store.put(found.filter("at = 0").select("file", "at"), "reached0")
    k, known = 0, reached.count()
    while True:
        more = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))
        k += 1
        wider = store.put(reached.unionAll(more).distinct(), f"reached{k}")
        if (now := wider.count()) == known:
            break
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = store.put(jump.join(far.hint("merge"), ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), f"jump{k}")
        reached, known = wider, now
    entry = found.select("file", "split", "seg", "at", "enter").join(reached.hint("merge"), ["file", "at"], "left_semi").select("file", "split", "seg", F.col("enter").alias("entry"))
    chain = store.put(found.join(entry.hint("merge"), ["file", "split", "seg"]).filter("enter <= entry and entry <= leave").drop("entry"), "chain")
    return with_payloads(chain, places, text, splits, store).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "at")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    store = Store(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{store.root}/archive", store)
    return read(spark, f"{store.root}/archive", store).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS d, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(d, i * 5 + 1, 5) AS INTEGER) >> s) % 32 + 1, 1), '' ORDER BY i, s DESC) AS b
         FROM h, range(8) AS a(i), unnest([15, 10, 5, 0]) AS c(s) GROUP BY page_id)
SELECT h.page_id, n AS payload_bytes, b AS payload_digest, CASE WHEN h.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN h.page_id <> first THEN first END AS refers_to
FROM h JOIN bits USING (page_id)
"""

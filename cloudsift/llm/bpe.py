"""Byte-pair encoding and decoding of words with a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in two short lists. The least rank is found by
scanning, the boundary between its two parts is deleted, and the ranks of the two neighbours are looked
up again, until no pair has a rank. Scanning beats a heap for short words; words over LONG parts use a heap over
the same pairs in the same order. Words repeat, so each Python worker keeps the codes of some
CACHE runs between white space and words.

Text is prepared as the vocabulary file says: added tokens are cut out, the rest is normalised (NFC,
white space, lower case letter by letter), split by the file's pattern and mapped from bytes to signs.
The file is read once, on the driver, and its tables reach the tasks by broadcast: their size is that
of the file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG, CACHE = 128, 150_000
#: Room for an id beside a rank.
BITS = 24
MASK = (1 << BITS) - 1
#: Bytes of text turned into Python strings at once.
SLICE_ROWS = 256
NO_RANK = 1 << 62

OUT = "key long, n_tokens long, ids binary, decoded string"


def byte_signs() -> list[str]:
    """The printable sign of each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(free)
            free += 1
    return [signs[b] for b in range(256)]


class Codec:
    """Encoder and decoder of a vocabulary file of kind BPE with an end-of-word suffix."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merged = lambda a, b: self.vocab[a + b]
        #: Of two adjacent ids: the rank of their merge and the id that it gives, in one integer.
        self.ranks = {self.vocab[a] << BITS | self.vocab[b]: i << BITS | merged(a, b) for i, (a, b) in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.added).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.space, self.separators = regex.compile(r"\s+"), regex.compile("[\x1c-\x1f]")
        self.signs = byte_signs()
        #: Runs between white space, in a young and an old half, and words.
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def runs(self, text: str) -> list[str]:
        """The text in NFC and lower case (each letter by itself), cut at white space, over which no word reaches."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # Python's split also cuts at four separators that are no white space in Unicode.
        return self.space.split(text) if self.separators.search(text) else text.split()

    def merged(self, word: str) -> list[int]:
        """The ids of the parts of a word whose bytes are already signs; signs without an id give none."""
        vocab, ranks = self.vocab, self.ranks
        parts = [vocab.get(sign) for sign in word[:-1]] + [vocab.get(word[-1] + self.suffix)]
        if None in parts:
            parts = [part for part in parts if part is not None]
        if len(parts) > LONG:
            return self._merged_long(parts)
        rank = [ranks.get(a << BITS | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while rank and (least := min(rank)) != NO_RANK:
            i = rank.index(least)
            parts[i] = part = least & MASK
            del parts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(part << BITS | parts[i + 1], NO_RANK)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] << BITS | part, NO_RANK)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, from a heap of (rank, place of the left part)."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(a: int) -> int:
            return ranks.get(parts[a] << BITS | parts[after[a]], NO_RANK) if after[a] < n else NO_RANK

        now = [rank(a) for a in range(n)]
        heap = [(r, a) for a, r in enumerate(now) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, a = heapq.heappop(heap)
            if now[a] != r:
                continue
            b = after[a]
            parts[a], after[a], now[b] = r & MASK, after[b], -1
            if after[b] < n:
                before[after[b]] = a
            for x in (a, before[a]):
                if x >= 0:
                    now[x] = rank(x)
                    if now[x] < NO_RANK:
                        heapq.heappush(heap, (now[x], x))
        return [part for part, r in zip(parts, now, strict=True) if r != -1]

    def run(self, run: str) -> list[int]:
        """The ids of a run without white space, from the older cache, or of its words."""
        if (ids := self.older.get(run)) is None:
            ids = []
            for word in self.pattern.findall(run):
                if (own := self.words.get(word)) is None:
                    signs = self.signs
                    own = self.merged("".join([signs[b] for b in word.encode()]))
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    if len(word) <= LONG:
                        self.words[word] = own
                ids += own
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        if len(run) <= LONG:
            self.known[run] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        out: list[int] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.added:
                out.append(self.added[piece])
            else:
                for run in self.runs(piece):
                    out += self.known.get(run) or self.run(run)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by a space; unknown ids give nothing."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


_codecs: dict[int, Codec] = {}


def codec(spec: bytes) -> Codec:
    """The codec of a file's content; one for each worker process."""
    if (key := hash(spec)) not in _codecs:
        _codecs[key] = Codec(json.loads(spec))
    return _codecs[key]


def texts(column: pa.Array, most: int = 1 << 21) -> Iterator[str]:
    """The strings of a column, null as empty, made in slices of bounded size."""
    column = column.cast(pa.large_string())
    i, n = 0, len(column)
    while i < n:
        step = SLICE_ROWS
        while step > 1 and column.slice(i, step).nbytes > most:
            step //= 2
        for text in column.slice(i, step).to_pylist():
            yield text or ""
        i += step


def coded(spark: SparkSession, rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text.

    A null text is empty and gives no tokens and an empty decoded text. Keys may be null or repeat;
    other columns are ignored; an empty table gives an empty result.
    """
    shipped = spark.sparkContext.broadcast(open(path, "rb").read())  # noqa: SIM115

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            done = 0
            counts, ids, decoded, size = [], [], [], 0
            for i, t in enumerate(texts(batch.column(1)), 1):
                tokens = own.encode(t)
                counts.append(len(tokens))
                ids.append(struct.pack(f"<{len(tokens)}I", *tokens))
                decoded.append(own.decode(tokens))
                size += len(t)
                if size > 1 << 21 or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, i - done), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids", "decoded"])
                    done, counts, ids, decoded, size = i, [], [], [], 0

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT).withColumnRenamed("key", key)


def digest(ids: bytes) -> str:
    """SHA-256 in lower-case hex."""
    return hashlib.sha256(ids).hexdigest()


def vocabulary() -> str:
    """Place of the public vocabulary of the query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every document and what they decode to, as digests."""
    out = coded(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the digests of every document's codes."""
    out = coded(spark, docs, vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

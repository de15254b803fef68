"""Fill-in-the-middle examples by displacement scatter.

A text is cut behind two units into prefix, middle and suffix, which change places between markers. Texts
of a batch lie one behind the other in one buffer. Every segment moves by one displacement, so a
difference array with an entry where a segment starts, summed up, gives each byte its output place, and
one scatter builds all outputs of the batch. Restoring finds the markers in the outputs, makes the
displacements anew from them and the form alone, and gathers the bytes back.

A unit is white space and the word behind it, or white space that ends the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.words import NOT_SPACE, chunks, spans

#: Of 100 texts, how many change, and how many of these put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
MARKERS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Code of a form, in the order of the names.
PLAIN, PSM, SPM = range(3)
FORMS = ("plain", "psm", "spm")
WIDTH = 3
OUT = "key long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def marker_places(buf: np.ndarray) -> np.ndarray:
    """Where a marker starts; one may reach over a text's end."""
    at = np.flatnonzero(buf[: max(0, len(buf) - 2)] == ord("<"))
    at = at[buf[at + 2] == ord(">")]
    return at[np.isin(buf[at + 1], np.frombuffer(b"PSM", np.uint8))]


def displaced(starts: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """Places of n bytes: from each of the ascending starts on (some may be equal), bytes move by its shift."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    places = np.cumsum(steps[:n], out=steps[:n])
    places += np.arange(n)
    return places


def layout(first: np.ndarray, sizes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of prefix, middle, suffix; places of the markers prefix, suffix, middle) in outputs that start at `first`; a row each."""
    p, m, s = sizes
    plain, spm = form == PLAIN, form == SPM
    head = np.where(spm, first + WIDTH, first + 2 * WIDTH + p)
    prefix = np.where(plain, first, np.where(spm, first + 2 * WIDTH + s, first + WIDTH))
    middle = np.where(plain, first + p, first + 3 * WIDTH + p + s)
    suffix = np.where(plain, first + p + m, head)
    return np.stack([prefix, middle, suffix]), np.stack([prefix - WIDTH, suffix - WIDTH, middle - WIDTH])


def scatter(buf: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs; cuts has, for each text, where prefix and middle end."""
    edges = np.stack([offsets[:-1], *cuts, offsets[1:]])
    sizes = np.diff(edges, axis=0)
    grown = np.diff(offsets) + np.where(form == PLAIN, 0, 3 * WIDTH)
    out_offsets = np.concatenate([[0], np.cumsum(grown)])
    places, marks = layout(out_offsets[:-1], sizes, form)
    out = np.empty(out_offsets[-1], np.uint8)
    out[displaced(edges[:3].T.ravel(), (places - edges[:3]).T.ravel(), len(buf))] = buf
    for row, sign in zip(marks[:, form != PLAIN], MARKERS.values(), strict=True):
        for i, byte in enumerate(sign):
            out[row + i] = byte
    return out, out_offsets


def gather(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that gave these outputs."""
    at = marker_places(out)
    owner = np.searchsorted(offsets, at, "right") - 1
    at = at[(form[owner] != PLAIN) & (at + WIDTH <= offsets[owner + 1])]
    moved, spm = form != PLAIN, form[form != PLAIN] == SPM
    first, second, third = at.reshape(-1, 3).T
    ends = offsets[1:][moved]
    begin = np.zeros((3, len(form)), np.int64)
    size = np.zeros((3, len(form)), np.int64)
    begin[0], size[0] = offsets[:-1], np.diff(offsets)
    begin[:, moved] = np.stack([np.where(spm, second, first), third, np.where(spm, first, second)]) + WIDTH
    size[:, moved] = np.stack([np.where(spm, third, second), ends, np.where(spm, second, third)]) - begin[:, moved]
    places = np.concatenate([[0], np.cumsum(size.T.ravel())])
    back = displaced(places[:-1], begin.T.ravel() - places[:-1], places[-1])
    return out[back], places[::3]


def strings(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The Arrow array of the strings between the offsets."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def transformed(rows: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row: key, n (units), form, prefix_chars and middle_chars (null if plain), output, restored.

    Draws come from the SHA-256 of `seed:key`, so they hang on nothing but the key; rows with equal keys
    draw alike, a null key draws as an empty one. A null or empty text is plain, as is one that holds a
    marker. A text of white space is one unit. Other columns are ignored; an empty table gives an empty result.
    """
    sign = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(sign, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.stack([batch.column(2 + i).to_numpy() for i in range(4)])
            for row, buf, offsets in chunks(batch.column(1)):
                m = len(offsets) - 1
                h, size = drawn[:, row : row + m], np.diff(offsets)
                starts, ends, first = spans(buf, offsets, NOT_SPACE)
                words = np.diff(first)
                n = words.copy()
                full = np.flatnonzero(size)
                n[full] += ~NOT_SPACE[buf[offsets[1:][full] - 1]]
                at = marker_places(buf)
                owner = np.searchsorted(offsets, at, "right") - 1
                marked = np.zeros(m, bool)
                marked[owner[at + WIDTH <= offsets[owner + 1]]] = True
                form = np.where((size == 0) | marked | (h[2] % 100 >= rate), PLAIN, np.where(h[3] % 100 < suffix_first, SPM, PSM))
                units = np.sort(h[:2] % (n + 1), axis=0)
                behind = np.append(ends, 0)[np.clip(first[:-1] + units - 1, 0, len(ends))]
                cuts = np.where(units == 0, offsets[:-1], np.where(units <= words, behind, offsets[1:]))
                cuts = np.where(form == PLAIN, offsets[:-1], cuts)
                out, out_offsets = scatter(buf, offsets, cuts, form)
                back, back_offsets = gather(out, out_offsets, form)
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                plain = form == PLAIN
                columns = [
                    batch.column(0).slice(row, m),
                    pa.array(n.astype(np.int64)),
                    pa.array(np.array(FORMS)[form].tolist(), pa.string()),
                    pa.array(chars[cuts[0]] - chars[offsets[:-1]], pa.int64(), mask=plain),
                    pa.array(chars[cuts[1]] - chars[cuts[0]], pa.int64(), mask=plain),
                    strings(out, out_offsets),
                    strings(back, back_offsets),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *draws).mapInArrow(run, OUT).withColumnRenamed("key", key)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the output and of the text restored from it, for every document."""
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, least(a, b)), '') AS p, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m,
         array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS s
  FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

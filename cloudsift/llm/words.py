"""Words and their hashes, for whole Arrow batches at once.

Texts stay UTF-8 bytes in one buffer; words are found with byte-class tables and hashed with prefix sums
of a polynomial modulo 2**64, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is worked on alone.
CHUNK = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, U64(_inverse(int(BASE))))
    up[0] = down[0] = U64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    return _powers(1 << max(20, int(n).bit_length()))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with (H[e] - H[s]) * BASE**-s the hash of buf[s:e]."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, from prefix_hash; equal bytes give equal hashes."""
    _, down = powers(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U64))


def outside(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table: true outside the inclusive ranges."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_SPACE = outside((0x20, 0x20), (0x09, 0x0D))
LETTER_DIGIT = outside((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; row i has words first[i] to first[i + 1]."""
    n = len(buf)
    inside = is_word[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, over row borders too."""
    if len(words) < k:
        return np.zeros(0, U64)
    m = len(words) - k + 1
    out = np.full(m, U64(k))
    for j in range(k):
        out = out * BASE + words[j : j + m]
    return mix(out)

"""Token counts of a byte-level BPE vocabulary, by deterministic finite-state transducers.

Two machines run one behind the other, and neither builds a token.

The **splitter** reads classes of characters and marks where a word starts. It has 13 states, so what a
stretch of text does to it is a map from 13 states to 13. Texts of a batch lie in one stream that is cut
into stretches of STRETCH signs; all maps are made at once, composed by a parallel prefix scan, and from
the scan each stretch knows the state it is entered with and marks its words.

The **counter** reads the bytes of a word. Its transitions carry the change in the number of tokens that
the bytes so far have, and their sum is the word's count. A state holds, for every suffix of the bytes so
far that begins some token, which token ended before that suffix and how many tokens stood there. The last
token of a longer prefix is the one that may follow the token before it: merging the bytes of both gives
both again. States and transitions are compiled when first met, kept in one table, and all words of a
slice advance through it byte by byte together.

The vocabulary file is read once, on the driver, and reaches tasks by broadcast: its size is that of the
file.
At MOST_STATES states the table is begun anew, and a slice adds no more
than its bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.bpe import byte_signs
from cloudsift.llm.words import chunks

STRETCH, MOST_STATES, MOST_PAIRS = 64, 1 << 18, 1 << 19
#: Bytes of words that advance together; longer words than LONG, and the last FEW of a slice, go alone.
SLICE, LONG, FEW = 1 << 18, 1 << 12, 24
#: A suffix in a state: node from bit NODE, token ahead of it from bit TOKEN, count below it; a count of 0 is HALF.
NODE, TOKEN, HALF = 40, 16, 1 << 15
ONES = (1 << NODE - TOKEN) - 1
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LIMIT = 1024
OUT = "key long, n_bytes long, n_tokens long"

# Signs of the splitter. END ends a text or stands for a letter of a special token.
SP, WS, LET, NUM, OTH, APO, ONE, R_, V_, L_, E_, END = range(12)
SIGNS = 12
# States: what the last sign belongs to. *1, *2: white space so far, one sign or more, the last a space or not.
START, WORD, DIGITS, OTHER, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLIPPED, SPACE1, SPACE2, BLANK1, BLANK2 = range(13)
STATES = 13
#: Marks: a word starts before this sign, before the one ahead of it.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and sign.

    Words are: an apostrophe with s, t, re, ve, m, ll or d; letters, digits or other signs, each with at
    most one space ahead; white space. The last sign of white space ahead of something else is left to it if it is
    a space, and alone if not.
    """
    to, marks = np.zeros((STATES, SIGNS), np.uint8), np.zeros((STATES, SIGNS), np.uint8)
    letters = (LET, ONE, R_, V_, L_, E_)
    kind = dict.fromkeys(letters, WORD) | {NUM: DIGITS, OTH: OTHER, APO: OTHER}
    fresh = kind | {APO: QUOTE, SP: SPACE1, WS: BLANK1}

    def put(state: int, sign: int, target: int, mark: int) -> None:
        to[state, sign], marks[state, sign] = target, mark

    for state in range(STATES):
        for sign in range(END):
            put(state, sign, fresh[sign], HERE)
        put(state, END, START, 0)
    for sign in letters:
        put(WORD, sign, WORD, 0)
    put(DIGITS, NUM, DIGITS, 0)
    for state in (OTHER, QUOTE):
        put(state, OTH, OTHER, 0)
        put(state, APO, OTHER, 0)
    # An apostrophe that starts a word may be clipped with what follows.
    put(QUOTE, ONE, CLIPPED, 0)
    for sign, state, closing in ((R_, QUOTE_R, E_), (V_, QUOTE_V, E_), (L_, QUOTE_L, L_)):
        put(QUOTE, sign, state, 0)
        for after in range(END):
            put(state, after, fresh[after], BEFORE if after in letters else BEFORE | HERE)
        put(state, END, START, BEFORE)
        put(state, closing, CLIPPED, 0)
    # White space: one more sign, or what it stands ahead of.
    for state, ahead in ((SPACE1, 0), (SPACE2, BEFORE), (BLANK1, HERE), (BLANK2, BEFORE | HERE)):
        space = state in (SPACE1, SPACE2)
        for sign, target in (kind if space else fresh).items():
            put(state, sign, target, ahead)
        put(state, SP, SPACE2, 0)
        put(state, WS, BLANK2, 0)
    return to, marks


def sign_table() -> np.ndarray:
    """The sign of every code point."""
    codes = np.full(0x110000, OTH, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, sign in ((r"\p{L}+", LET), (r"\p{N}+", NUM), (r"\p{White_Space}+", WS)):
        for found in regex.finditer(pattern, every):
            codes[ord(found[0][0]) : ord(found[0][-1]) + 1] = sign
    codes[0xD800:0xE000] = OTH
    for text, sign in ((" ", SP), ("'", APO), ("stmd", ONE), ("r", R_), ("v", V_), ("l", L_), ("e", E_)):
        for c in text:
            codes[ord(c)] = sign
    return codes


def entered(signs: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The state that each stretch (a row of signs) is entered with: maps of all stretches, composed by a prefix scan."""
    flat = to.ravel()
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], len(signs), axis=1)
    for column in np.ascontiguousarray(signs.T):
        maps = flat[maps * np.uint8(SIGNS) + column]
    step = 1
    while step < len(signs):
        maps = np.concatenate([maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)], axis=1)
        step *= 2
    return np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)


def word_marks(signs: np.ndarray, to: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether a word starts before each sign of a stream that ends in END."""
    n = len(signs)
    rows = np.full((n + STRETCH - 1) // STRETCH * STRETCH, END, np.uint8)
    rows[:n] = signs
    rows = rows.reshape(-1, STRETCH)
    state, flat, emit = entered(rows, to), to.ravel(), marks.ravel()
    out = np.empty((STRETCH, len(rows)), np.uint8)
    for j, column in enumerate(np.ascontiguousarray(rows.T)):
        at = state * np.uint8(SIGNS) + column
        out[j], state = emit[at], flat[at]
    out = out.T.ravel()[:n]
    found = (out & HERE).astype(bool)
    found[:-1] |= (out[1:] & BEFORE).astype(bool)
    return found


class Counter:
    """The counting transducer of a vocabulary, compiled as it is met."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        byte = {sign: b for b, sign in enumerate(byte_signs())}
        self.bytes = {i: bytes(byte[c] for c in token) for token, i in model["vocab"].items() if all(c in byte for c in token)}
        ids = {v: k for k, v in self.bytes.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        pairs = ((m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        self.ranks = {(model["vocab"][a], model["vocab"][b]): (i, model["vocab"][a + b]) for i, (a, b) in enumerate(pairs)}
        self.follow: dict[tuple[int, int], bool] = {}
        #: Trie of the tokens: children of a node by byte, and the token that ends there.
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, token in self.bytes.items():
            if self.merged(token) != [i]:  # no text gives it
                continue
            node = 0
            for b in token:
                if (deeper := self.children[node].get(b)) is None:
                    deeper = self.children[node][b] = len(self.token)
                    self.token.append(-1)
                    self.children.append({})
                node = deeper
            self.token[node] = i
        self.restart()

    def restart(self) -> None:
        """Forget all states but the first."""
        self.number: dict[tuple[int, ...], int] = {}
        #: A state is a tuple of suffixes: trie node, token ahead of it + 1, tokens there against now + HALF; packed.
        self.states: list[tuple[int, ...]] = []
        #: Transitions by hash of state << 8 | byte, with open addressing: next state << 8 | change in tokens + 128.
        self.bits, self.used = 12, 0
        self.keys, self.entries = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.state((HALF,))

    def merged(self, data: bytes) -> list[int]:
        """The tokens of some bytes, by merging the pair of least rank until none is left."""
        parts, ranks = [self.single[b] for b in data], self.ranks
        while found := [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in ranks]:
            (_, token), i = min(found)
            parts[i : i + 2] = [token]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a: merging the bytes of both gives both."""
        if (known := self.follow.get((a, b))) is None:
            if len(self.follow) >= MOST_PAIRS:
                self.follow.clear()
            known = self.follow[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def state(self, key: tuple[int, ...]) -> int:
        """The number of a state, new or known."""
        if (number := self.number.get(key)) is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies, or may be put."""
        last = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return at

    def compile(self, state: int, byte: int) -> int:
        """Make the transition of a state by a byte; what the table has of it."""
        went, last, change = [], -1, 0
        for suffix in self.states[state]:
            if (deeper := self.children[suffix >> NODE].get(byte)) is None:
                continue
            if last < 0 <= (token := self.token[deeper]):
                before = (suffix >> TOKEN & ONES) - 1
                if before < 0 or self.follows(before, token):
                    last, change = token, (suffix & 2 * HALF - 1) - HALF + 1
            if self.children[deeper]:
                went.append(deeper << NODE | suffix & (1 << NODE) - 1)
        target = self.state((*[suffix - change for suffix in went], last + 1 << TOKEN | HALF))
        entry = target << 8 | change + 128
        if 4 * self.used >= len(self.keys):
            old, values = self.keys, self.entries
            self.bits += 2
            self.keys, self.entries = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
            for key, value in zip(old[old >= 0].tolist(), values[old >= 0].tolist(), strict=True):
                self._put(key, value)
        self._put(state << 8 | byte, entry)
        self.used += 1
        return entry

    def _place(self, key: int) -> int:
        at = (key * int(SPREAD) & (1 << 64) - 1) >> 64 - self.bits
        while self.keys.item(at) not in (-1, key):
            at = at + 1 & len(self.keys) - 1
        return at

    def _put(self, key: int, entry: int) -> None:
        at = self._place(key)
        self.keys[at], self.entries[at] = key, entry

    def alone(self, data: bytes, state: int = 0, anew: bool = False) -> int:
        """The change in tokens over some bytes from a state on, byte by byte; `anew` lets the table be begun anew on the way."""
        total = 0
        for byte in data:
            at = self._place(key := state << 8 | byte)
            if self.keys.item(at) == key:
                entry = self.entries.item(at)
            else:
                if anew and len(self.states) >= MOST_STATES:
                    own = self.states[state]
                    self.restart()
                    state = self.state(own)
                entry = self.compile(state, byte)
            state = entry >> 8
            total += (entry & 255) - 128
        return total

    def together(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of some words of LONG bytes at most."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, size = starts[order], size[order]
        counts, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        more = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for j, m in enumerate(more):
            if m <= FEW:
                for i in range(m):
                    counts[i] += self.alone(buf[at[i] + j : at[i] + size[i]].tobytes(), int(state[i]))
                break
            keys = (state[:m] << 8) | buf[at[:m] + j]
            slots = self.slots(keys)
            if len(absent := np.flatnonzero(self.keys[slots] < 0)):
                for key in np.unique(keys[absent]).tolist():
                    self.compile(key >> 8, key & 255)
                slots = self.slots(keys)
            entries = self.entries[slots]
            counts[:m] += (entries & 255) - 128
            state[:m] = entries >> 8
        out = np.empty_like(counts)
        out[order] = counts
        return out

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of words, given where they start and end."""
        counts = np.zeros(len(starts), np.int64)
        size = ends - starts
        short = np.flatnonzero(size <= LONG)
        edges = np.cumsum(size[short])
        i = 0
        while i < len(short):
            j = max(i + 1, int(np.searchsorted(edges, (edges[i - 1] if i else 0) + SLICE, "right")))
            self.bounded()
            own = short[i:j]
            counts[own] = self.together(buf, starts[own], ends[own])
            i = j
        for i in np.flatnonzero(size > LONG):
            self.bounded()
            counts[i] = self.alone(buf[starts[i] : ends[i]].tobytes(), anew=True)
        return counts

    def bounded(self) -> None:
        """Begin the table anew if it is full."""
        if len(self.states) >= MOST_STATES:
            self.restart()


class Machine:
    """Splitter and counter of a vocabulary file of kind byte-level BPE."""

    def __init__(self, spec: dict) -> None:
        self.to, self.marks = splitter()
        self.signs = sign_table()
        self.counter = Counter(spec)
        special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each of the texts that lie one behind the other in buf."""
        m = len(offsets) - 1
        out = np.zeros(m, np.int64)
        data = buf.tobytes()
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        owner = np.repeat(np.arange(m), np.diff(np.searchsorted(lead, offsets)))
        slots = np.arange(len(lead)) + owner
        signs = np.full(len(lead) + m, END, np.uint8)
        signs[slots] = self.signs[np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)]
        places, owners = np.empty(len(signs), np.int64), np.empty(len(signs), np.int64)
        places[slots], owners[slots] = lead, owner
        ends = np.searchsorted(owner, np.arange(m), "right") + np.arange(m)
        places[ends], owners[ends] = offsets[1:], np.arange(m)
        if self.special:
            for text in np.flatnonzero(np.diff(offsets)) if self.special.search(data) else ():
                for found in self.special.finditer(data, offsets[text], offsets[text + 1]):
                    i, j = np.searchsorted(lead, found.span()) + text
                    signs[i:j] = END
                    out[text] += 1
        starts = word_marks(signs, self.to, self.marks)
        edges = np.flatnonzero(starts | (signs == END))
        words = np.flatnonzero(starts[edges])
        begin, end = edges[words], edges[words + 1]
        counts = self.counter.count(buf, places[begin], places[end])
        return out + np.bincount(owners[begin], counts, m).astype(np.int64)


_machines: dict[int, Machine] = {}


def machine(spec: bytes) -> Machine:
    """The machine of a file's content; one for each worker process."""
    if (key := hash(spec)) not in _machines:
        _machines[key] = Machine(json.loads(spec))
    return _machines[key]


def counted(spark: SparkSession, rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_bytes (UTF-8) and n_tokens.

    A null text is empty and has no tokens. Strings of special tokens inside a text count as one token each, as
    the library's default has it. Keys may be null or repeat; texts may be of any length and without white space;
    other columns are ignored; an empty table gives an empty result.
    """
    shipped = spark.sparkContext.broadcast(open(path, "rb").read())  # noqa: SIM115

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(shipped.value)
        for batch in batches:
            sizes, counts = [], []
            for _, buf, offsets in chunks(batch.column(1)):
                sizes.append(np.diff(offsets))
                counts.append(own.count(buf, offsets))
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], names=["key", "n_bytes", "n_tokens"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT).withColumnRenamed("key", key)


def vocabulary() -> str:
    """Place of the public vocabulary of the query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than LIMIT tokens."""
    out = counted(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)

"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a clause word by word: insult, threat, target, negation and reported
speech. Each is a two-state machine over word classes; `compose` builds their product, a table of
states by classes, so that a clause is one walk. An insult or threat gives its weight to the channel
that the product state names when it is met (negated, reported or plain; insults and threats have their
own), and a target anywhere in the clause doubles the plain channel's part as `aimed`. A text's channels are sums over its matched clauses;
words outside a clause that holds an insult or threat count for nothing.

The grammar's small word lists are fixed. Insults are learned: words and word beginnings of labelled
texts, counted by Spark and weighted by log odds. A logistic model over the channels turns them into a
score. Both are fitted on at most SAMPLE labelled rows outside the held-out fifth (the documented bound
of what the fit reads); scoring covers every row and whole texts.

A null or empty text has no clauses; a long one is read to its end. Repeated rows score alike, each on
its own; a null key stays null. Other columns are ignored, whatever their names; an empty table gives an
empty result. Labels that contradict each other on one key all count; a null label or key teaches nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import takewhile

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.bpe import texts
from cloudsift.llm.store import Store, free, only

#: Labelled rows that the fit reads at most, and insults that it keeps at most.
SAMPLE, LEXICON = 20_000, 2_000
#: Shares of the toxic texts: a term in so many is kept; one in fewer must explain new texts.
COMMON, RARE = 0.05, 0.01
#: Fewer toxic texts than this prove nothing: a rare word is in so many of them by chance.
LEAST = 5
#: Letters of the word beginnings that may become insults.
STEMS = (4, 5, 6)

#: Word classes of the grammar, in English, German, French and Spanish.
WORDS = {
    "threat": "kill murder destroy hurt stab shoot burn töten umbringen vernichten verletzen tuer frapper détruire matar golpear destruir".split(),
    "target": "you your yours u du dich dir ihr euch tu toi te vous usted tú ti vosotros they them she her him he".split(),
    "negation": "not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split(),
    "report": "said says quoted reported claims called wrote sagte sagt laut zitiert dit dits selon disait dijo dice según".split(),
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report")
CHANNELS = ("plain", "aimed", "negated", "reported", "threat", "threat_aimed", "threat_negated", "threat_reported")
#: The most that a text without a matched clause may weigh: it is no evidence, whatever the share of toxic labels.
BLANK = -0.1
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_END = ".!?;:\n"
CLAUSES = re.compile(f"[{CLAUSE_END}]")
#: Words after which a clause is negated or reported.
TURNS = frozenset(WORDS["negation"] + WORDS["report"])


def flag(on: str) -> list[list[int]]:
    """A transducer with two states that a word of one class switches on until the clause ends."""
    return [[int(s or c == on) for c in CLASSES] for s in (0, 1)]


@lru_cache(maxsize=1)
def compose() -> np.ndarray:
    """The product of the five transducers: bits insult, threat, target, negation, report."""
    parts = [flag(c) for c in CLASSES[1:]]
    table = np.zeros((1 << len(parts), len(CLASSES)), np.int8)
    for state in range(len(table)):
        for c in range(len(CLASSES)):
            table[state, c] = sum(part[state >> i & 1][c] << i for i, part in enumerate(parts))
    return table


TARGET, NEGATION, REPORT = 4, 8, 16


@dataclass(frozen=True)
class Model:
    """Insult weights by beginning of a word ('idiot$' is a whole word), and the logistic model."""

    insults: dict[str, float]
    bias: float = 0.0
    weights: tuple[float, ...] = (0.0,) * len(CHANNELS)


class Grammar:
    """The compiled grammar of a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, compose().tolist()
        self.classes = {w: CLASSES.index(c) for c, ws in WORDS.items() for w in ws}
        self.cues = ahocorasick.Automaton()
        for w in {*(x.rstrip("$") for x in model.insults), *WORDS["threat"]}:
            self.cues.add_word(w, len(w))
        if len(self.cues):
            self.cues.make_automaton()

    def insult(self, word: str) -> float:
        """The largest weight of the insults that a word is or begins with."""
        insults = self.model.insults
        return max(insults.get(word + "$", 0.0), *(insults.get(word[:k], 0.0) for k in STEMS))

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that hold a cue at the beginning of a word."""
        end = -1
        for last, size in self.cues.iter(text) if len(self.cues) else ():
            start = last - size + 1
            if start < end or start and (text[start - 1].isalnum()):
                continue
            begin = max(map(lambda c: text.rfind(c, max(end, 0), start), CLAUSE_END)) + 1
            begin = max(begin, end, 0)
            # One search for all signs: it ends where the clause does, so a text is searched once.
            end = stop.start() if (stop := CLAUSES.search(text, last)) else len(text)
            yield text[begin:end]

    def channels(self, text: str) -> list[float]:
        """Weights by channel over a text's matched clauses."""
        out, table = [0.0] * len(CHANNELS), self.table
        for clause in self.clauses(text.lower()):
            state, plain, threats = 0, 0.0, 0.0
            for word in WORD.findall(clause):
                c = self.classes.get(word, 0)
                weight = 0.0 if c else self.insult(word)
                state = table[state][1 if weight else c]
                if weight:
                    if state & REPORT:
                        out[3] += weight
                    elif state & NEGATION:
                        out[2] += weight
                    else:
                        plain += weight
                elif c == 2:
                    if state & REPORT:
                        out[7] += 1.0
                    elif state & NEGATION:
                        out[6] += 1.0
                    else:
                        threats += 1.0
            out[0] += plain
            out[1] += plain * bool(state & TARGET)
            out[4] += threats
            out[5] += threats * bool(state & TARGET)
        return out

    def score(self, channels: list[float]) -> float:
        """The logistic model's value, from 0 to 1."""
        x = self.model.bias + float(np.dot(self.model.weights, np.log1p(channels)))
        return float(1 / (1 + np.exp(-x)))


def held_out(key: Column) -> Column:
    """A fifth of all keys, by the checksum of their decimal digits."""
    return F.crc32(key.cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most SAMPLE labelled texts outside the held-out fifth: (text, label), chosen by a hash of the key."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = chosen.select(F.col(key).alias("chosen"), F.col(label).alias("label")).orderBy(F.xxhash64("chosen"), "chosen", "label").limit(SAMPLE)
    # Only key and text of the documents, under names of their own. At most SAMPLE rows of two numbers.
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return docs.join(F.broadcast(chosen), F.col("key") == F.col("chosen")).select("text", "label")


def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic texts, clean texts): whole words and word beginnings, summed for parts of a partition."""
    counts: dict[str, Counter] = {"t": Counter(), "c": Counter()}

    def out() -> pa.RecordBatch:
        names = list(counts["t"].keys() | counts["c"].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[x][w] for w in names], pa.int64()) for x in "tc")], names=["term", "t", "c"])
        counts["t"].clear()
        counts["c"].clear()
        return batch

    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts["t" if label else "c"].update(terms_of(text.lower()))
            if len(counts["c"]) + len(counts["t"]) > 300_000:
                yield out()
    yield out()


def direct(text: str) -> set[str]:
    """The words of a lower-case text that are met neither negated nor reported, as the grammar reads a clause."""
    words = set(WORD.findall(text))
    if words.isdisjoint(TURNS):
        return words
    return {w for clause in CLAUSES.split(text) for w in takewhile(lambda w: w not in TURNS, WORD.findall(clause))}


def terms_of(text: str) -> set[str]:
    """Whole words (of three letters or more, marked by $) and word beginnings of a lower-case text, out of its direct words."""
    words = direct(text)
    found = {w + "$" for w in words if len(w) >= 3}
    for k in STEMS:
        found.update(w[:k] for w in words if len(w) >= k)
    return found


def held_by(candidates: list[str]):
    """A mapInArrow function from (text, label) to the places of the candidates that a text holds."""
    place = {w: i for i, w in enumerate(candidates)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[place[w] for w in terms_of(t.lower()) if w in place] for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], names=["held"])

    return run


def lexicon(train: DataFrame) -> dict[str, float]:
    """Insults by log odds, hardly met in clean texts.

    A term in COMMON of the toxic texts is kept. Of rarer ones (RARE of them, LEAST at least), only
    those are kept that explain toxic texts which no term before explains: a rare word of a toxic text
    that has copies explains nothing new.
    """
    totals = {int(r.label): r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    sums = train.select("text", "label").mapInArrow(terms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    least = max(LEAST, round(RARE * toxic))
    found = sums.filter((F.col("t") >= least) & (F.col("c") * 50 <= F.col("t"))).withColumn("odds", odds)
    found = found.orderBy(F.desc("odds"), F.desc("t"), F.desc(F.length("term")), "term").limit(LEXICON).collect()
    # At most SAMPLE lists of places.
    held = [set(r.held) for r in train.filter("label = 1").select("text", "label").mapInArrow(held_by([r.term for r in found]), "held array<int>").collect()]
    has: list[set[int]] = [set() for _ in found]
    for text, places in enumerate(held):
        for i in places:
            has[i].add(text)
    insults: dict[str, float] = {}
    left = set(range(len(held)))
    order = [i for i, r in enumerate(found) if r.t >= COMMON * toxic]
    rare = [i for i, r in enumerate(found) if r.t < COMMON * toxic]
    while order or rare:
        if order:
            i = order.pop(0)
        else:
            i = max(rare, key=lambda i: len(has[i] & left))
            rare.remove(i)
            if len(has[i] & left) < least:
                break
        word = found[i].term
        # A beginning covers longer words; a shorter one of the same texts adds nothing.
        if not any(word.startswith(x.rstrip("$")) or x.startswith(word.rstrip("$")) for x in insults):
            insults[word] = float(found[i].odds)
            left -= has[i]
    return insults


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """(bias, weights) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def measured(model: Model):
    """A mapInArrow function from (text, label) to the channels and the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for batch in batches:
            rows = np.array([grammar.channels(t) for t in texts(batch.column(0))]).reshape(-1, len(CHANNELS))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(len(CHANNELS))), batch.column(1).cast(pa.int64())], names=[*CHANNELS, "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn insults and the logistic model, which needs no insults; without labels of both kinds, a model that scores 0 or near it."""
    train = sample(docs, labels, label)
    model = Model(lexicon(train))
    # At most SAMPLE rows of nine numbers reach the driver.
    seen = np.array(train.mapInArrow(measured(model), ", ".join(f"{c} double" for c in CHANNELS) + ", label long").collect(), float)
    if not len(seen) or len(np.unique(seen[:, -1])) < 2:
        return Model({}, -3.0)
    bias, weights = logistic(np.log1p(seen[:, :-1]), seen[:, -1])
    return Model(model.insults, min(bias, BLANK), tuple(float(w) for w in weights))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, score and the channels it comes from. Nulls and empty texts score as no clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for batch in batches:
            rows = [grammar.channels(t) for t in texts(batch.column(1))]
            columns = np.array(rows).reshape(-1, len(CHANNELS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.score(r) for r in rows], pa.float64()), *(pa.array(columns[:, i]) for i in range(len(CHANNELS)))], names=["key", "score", *CHANNELS])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, score double, " + ", ".join(f"{c} double" for c in CHANNELS)).withColumnRenamed("key", key)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First pipeline stage: documents that score under 0.5, with the columns they came with.

    Rows are judged one by one by a written number, so null and repeated doc_ids get verdicts of their
    own; null and empty texts stay, and no documents give no documents.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = Store(spark, "toxicity_stage").numbered(docs, row=(row := free(docs.columns)))
    bad = scored(rows, model, row).filter("score >= 0.5").select(row)
    return only(rows.join(bad, row, "left_anti"), docs.columns)

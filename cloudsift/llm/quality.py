"""Text quality by a sparse ensemble of rules over statistics.

`statistics` are Spark columns over the whole text. On a bounded sample of labelled rows, small trees
are grown by gradient boosting; every path from a root becomes a rule, a conjunction of thresholds. A
logistic model with an L1 penalty keeps few of the rules, and `score` compiles those into one Spark
column expression, so that scoring never leaves the JVM. The fit reads at most SAMPLE labelled rows
outside the held-out fifth, as numbers, never texts.

A null text is empty; its statistics are 0. Long texts count whole. Repeated rows score alike, each on its own; a null
key stays null. Other columns are ignored, whatever their names; an empty table gives an empty result,
and labels of one kind, or none, or that no statistic tells apart, a model without rules. Ties between thresholds fall to the first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.toxicity import held_out, sample

TREES, DEPTH, LEAF, RATE = 40, 3, 20, 0.3
#: Thresholds tried for each statistic, at even quantiles.
BINS = 32
#: Rules kept at most, the strength of the L1 penalty (a share of the sample) and its steps.
RULES, PENALTY, STEPS = 400, 0.0005, 600


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with one double column s_<name> for each statistic; columns of these names give way, all others stay.

    A null text is an empty one, whose statistics are 0. Each row counts by itself, so repeated rows
    count alike, and no rows give no rows. Words are runs between white space, lines between line feeds.
    """
    own = []
    while len(own) < 6:
        own.append(max([*rows.columns, *own, "s"], key=len) + "_")
    t, words, lines, rest, n, n_words = (F.col(f"`{x}`") for x in own)
    rows = rows.withColumn(own[0], F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumns({own[1]: F.array_remove(F.split(t, r"\s+"), ""), own[2]: F.array_remove(F.split(t, "\n"), ""), own[3]: F.regexp_replace(t, "[a-z ]+", ""), own[4]: F.length(t).cast("double")})
    rows = rows.withColumn(own[5], F.size(words).cast("double"))
    n_lines = F.size(lines).cast("double")
    # Signs are counted as what a removal leaves out, in the part without small letters and spaces: a pattern passes over a text faster than a map of signs does.
    count = lambda signs: (F.length(rest) - F.length(F.regexp_replace(rest, signs, ""))).cast("double")
    lower = (F.length(F.replace(t, F.lit(" "), F.lit(""))) - F.length(rest)).cast("double")
    per = lambda x, of: F.when(of > 0, x / of).otherwise(0.0).cast("double")
    again = F.size(F.filter(words, lambda x, i: x == F.get(words, i - 1))).cast("double")
    stats = {
        "chars": F.log1p(n),
        "words": F.log1p(n_words),
        "word_length": per(n, n_words),
        "upper": per(count("[A-Z]+"), n),
        "lower": per(lower, n),
        "digits": per(count("[0-9]+"), n),
        "stops": per(count("[.,;:]+"), n),
        "shouts": per(count("[!?]+"), n),
        "signs": per(count(r"[&#$%*@^~<>{}\[\]\\/_=+]+"), n),
        "bars": per(count("[|]+"), n),
        "lines": per(n_lines, n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), n_lines),
        "again": per(again, n_words),
        "outside_ascii": per(n - F.octet_length(t), n),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)),
    }
    return rows.withColumns({f"s_{k}": v.cast("double") for k, v in stats.items()}).drop(*own)



Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Model:
    """Rules as conjunctions of (statistic, is above, threshold), with their weights."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]


def tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[tuple[tuple, float]], np.ndarray]:
    """(paths, values): all paths of a small tree that follows the gradient, and each row's step."""
    paths: list[tuple[tuple, float]] = []
    value = np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        if path:
            paths.append((path, g / (h + 1)))
        value[rows] = g / (h + 1)
        best = (1e-6, 0, 0.0)
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                bin_ = np.searchsorted(cut, x[rows, j], "left")
                gs, hs, ns = (np.bincount(bin_, w, len(cut) + 1).cumsum()[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                    best = (float(gain[k]), j, float(cut[k]))
        if best[0] > 1e-6:
            _, j, c = best
            above = x[rows, j] > c
            grow(rows[~above], (*path, (j, False, c)))
            grow(rows[above], (*path, (j, True, c)))

    grow(np.arange(len(x)), ())
    return paths, value


def holds(path: tuple, x: np.ndarray) -> np.ndarray:
    """Where all conditions of a path hold."""
    out = np.ones(len(x), bool)
    for j, above, c in path:
        out &= (x[:, j] > c) == above
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(bias, weights) of an L1 logistic regression, by accelerated proximal steps."""
    n = len(x)
    rate = 4 * n / (np.linalg.norm(np.column_stack([np.ones(n), x]), 2) ** 2)
    bias = ahead_bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30))) - y
        new_bias = ahead_bias - rate * error.mean()
        new = ahead - rate * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return bias, w


def learn(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Grow trees, turn their paths into rules and keep what the L1 penalty leaves."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(base, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 2)[1:-1], method="lower")) for j in range(x.shape[1])]
    margin, paths = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, step = tree(x, y - p, p * (1 - p), cuts)
        margin = margin + RATE * step
        for path, weight in found:
            key = tuple(sorted(path))
            paths[key] = max(paths.get(key, 0.0), abs(weight))
    if not paths:
        return Model(base, ())
    chosen = sorted(paths, key=lambda k: (-paths[k], k))[:RULES]
    z = np.column_stack([holds(path, x) for path in chosen]).astype(float)
    bias, w = lasso(z, y, PENALTY)
    rules = tuple((tuple((names[j], above, c) for j, above, c in path), float(v)) for path, v in zip(chosen, w, strict=True) if abs(v) > 1e-4)
    return Model(float(bias), rules)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from at most SAMPLE rows of numbers."""
    train = statistics(sample(docs, labels, label)).drop("text")
    names = train.columns[1:]
    rows = np.array(train.select("label", *names).collect(), float).reshape(-1, len(names) + 1)
    return learn(rows[:, 1:], rows[:, 0], names)


def score(model: Model) -> Column:
    """The model as one expression over the statistics' columns."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        held = F.lit(True)
        for name, above, c in rule:
            held = held & ((F.col(name) > c) if above else (F.col(name) <= c))
        total = total + F.when(held, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    out = statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model).alias("score"))
    return out.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))

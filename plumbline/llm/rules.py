"""A quality classifier of sparse rules.

Trees are grown on statistics of the texts, each on what the ones before leave unexplained; every path from a root is a
*rule*, a conjunction of thresholds. A logistic regression with a lasso penalty gives most rules no weight. What is left
is compiled into one Spark column expression over the columns of statistics. Scoring is a projection of the scan,
without a shuffle; the statistics of whole texts are counted in Arrow batches.

Trees and weights are fitted on the driver from the statistics (numbers, not texts) of at most ``Settings.sample``
labelled rows, those of least hash; that is the documented bound. A fifth of them chooses the strength of the penalty.

Defined cases: a null, empty or word-less text has zeros for all statistics and the score that they give; rows without a
label, and label rows without a document, are not learned from; a document with several label rows counts once for each;
without any labelled row every score is 0.5, and with one label only it lies near that label; rows are scored one by
one; an empty table gives no rows. Columns other than the text are no input of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_, eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, least_rows, map_arrow

#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3


class Settings(NamedTuple):
    #: Labelled rows that are learned from at most.
    sample: int = 8_000
    trees: int = 40
    depth: int = 3
    #: Thresholds tried for each statistic, at quantiles.
    cuts: int = 32
    #: Rows that a rule must hold for, and must not hold for, at least.
    least: int = 5
    rate: float = 0.3
    held: float = 0.2
    #: Penalties tried, as shares of the least one that takes every weight to zero.
    penalties: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
    steps: int = 150


class Condition(NamedTuple):
    """``statistic > threshold``, or not."""

    statistic: int
    threshold: float
    above: bool


Rule = tuple[Condition, ...]


class Ensemble(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    bias: float


# ---- statistics

STATISTICS = (
    "words", "word_length", "distinct_words", "distinct_by_root", "distinct_pairs", "equal_neighbours", "lines",
    "line_words", "distinct_lines", "symbols", "calls", "stops", "capitals", "digits", "beyond_ascii", "odd_words",
    "long_words", "capital_words", "addresses")
_SYMBOLS = b"#*$%&|<>=_~^\\/{}[]@+"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_BEYOND = bytes(range(128, 256))
_ODD_WORD = re.compile(rb"(?<![^\x20\x09-\x0D])[^0-9A-Za-z\x80-\xFF\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
_LONG_WORD = re.compile(rb"[^\x20\x09-\x0D]{30,}")
_CAPITAL_WORD = re.compile(rb"(?<![0-9A-Za-z\x80-\xFF])[A-Z]{2,}(?![0-9a-z\x80-\xFF])")
_ADDRESS = re.compile(rb"https?://|www\.|@[A-Za-z0-9]")


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The numbers of STATISTICS, from the whole text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    dark = len(data.translate(None, SPACES))
    lines = [line for line in data.split(b"\n") if line.strip()]
    distinct = len(set(words))

    def share(characters: bytes) -> float:
        return (len(data) - len(data.translate(None, characters))) / dark

    return (
        float(n), dark / n, distinct / n, distinct / n**0.5, len(set(zip(words, words[1:]))) / n,
        sum(map(eq, words, words[1:])) / n, float(len(lines)), n / len(lines), len(set(lines)) / len(lines),
        share(_SYMBOLS), share(b"!?"), share(b".,;:"), share(_CAPITALS), share(_DIGITS), share(_BEYOND),
        len(_ODD_WORD.findall(data)) / n, len(_LONG_WORD.findall(data)) / n, len(_CAPITAL_WORD.findall(data)) / n,
        len(_ADDRESS.findall(data)) / n)


def with_statistics(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """The columns ``kept`` and those of STATISTICS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [text_statistics(t.as_py()) for t in batch.column(text)]
            columns = list(zip(*numbers)) or [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *(pa.array(c, pa.float64()) for c in columns)], names=[*kept, *STATISTICS])

    kinds = dict(rows.dtypes)
    schema = [f"{k} {kinds[k]}" for k in kept] + [f"{s} double" for s in STATISTICS]
    return map_arrow(rows.select(text, *kept), count, ", ".join(schema))


# ---- trees and their paths


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], settings: Settings):
    """One tree for a Newton step of the logistic loss: the rules of its nodes, and the step of every row."""
    codes = [np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]  # code > k: x above cut k
    rules: list[Rule] = []
    step = np.zeros(len(x))
    nodes = [((), np.arange(len(x)))]
    while nodes:
        path, rows = nodes.pop()
        best, found = 1e-9, None
        g, h = gradient[rows], weight[rows]
        if len(path) < settings.depth:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for j, some in enumerate(cuts):
                if not len(some):
                    continue
                code, size = codes[j][rows], len(some) + 1
                low = [np.cumsum(np.bincount(code, w, size))[:-1] for w in (g, h, None)]
                high = [t - part for t, part in zip((g.sum(), h.sum(), len(rows)), low)]
                gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1) - whole
                gain[(low[2] < settings.least) | (high[2] < settings.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, found = gain[k], (j, k)
        if found is None:
            step[rows] = g.sum() / (h.sum() + 1)
            continue
        j, k = found
        above = codes[j][rows] > k
        for side in (False, True):
            longer = (*path, Condition(j, float(cuts[j][k]), side))
            rules.append(longer)
            nodes.append((longer, rows[above == side]))
    return rules, step


def tightened(rule: Rule) -> Rule:
    """The rule with one condition for each statistic and side, in order."""
    ends: dict[tuple[int, bool], float] = {}
    for c in rule:
        key = (c.statistic, c.above)
        known = ends.get(key, c.threshold)
        ends[key] = max(known, c.threshold) if c.above else min(known, c.threshold)
    return tuple(Condition(s, t, a) for (s, a), t in sorted(ends.items()))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Rows by rules, 1 where the rule holds."""
    out = np.ones((len(x), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for c in rule:
            out[:, i] *= (x[:, c.statistic] > c.threshold) == c.above
    return out


def path_rules(x: np.ndarray, y: np.ndarray, settings: Settings) -> list[Rule]:
    """The different rules on the paths of boosted trees."""
    inner = np.linspace(0, 1, settings.cuts + 2)[1:-1]
    cuts = [np.unique(np.quantile(x[:, j], inner, method="lower")) for j in range(x.shape[1])]
    margin = np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(settings.trees):
        chance = 1 / (1 + np.exp(-margin))
        rules, step = grow(x, y - chance, chance * (1 - chance), cuts, settings)
        found |= dict.fromkeys(map(tightened, rules))
        margin += settings.rate * step
    return list(found)


# ---- lasso


def lasso(a: np.ndarray, y: np.ndarray, penalties: list[float], steps: int) -> list[tuple[np.ndarray, float]]:
    """Logistic weights and bias for each penalty in turn, by accelerated proximal gradient steps."""
    n, p = a.shape
    rate = 4.0 / (_largest_square(a) / n + 1)  # the loss bends by a quarter of this at most
    w, bias = np.zeros(p), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    found = []
    for penalty in penalties:
        ahead_w, ahead_bias, momentum = w, bias, 1.0
        for _ in range(steps):
            error = (1 / (1 + np.exp(-(a @ ahead_w.astype(np.float32) + ahead_bias))) - y) / n
            moved = ahead_w - rate * (error.astype(np.float32) @ a)
            new_w = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
            new_bias = ahead_bias - rate * error.sum()
            later = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            pull = (momentum - 1) / later
            ahead_w, ahead_bias = new_w + pull * (new_w - w), new_bias + pull * (new_bias - bias)
            w, bias, momentum = new_w, new_bias, later
        found.append((w, float(bias)))
    return found


def _largest_square(a: np.ndarray) -> float:
    """An upper estimate of the largest eigenvalue of a'a, by power steps."""
    v = np.ones(a.shape[1], np.float32)
    size = 0.0
    for _ in range(20):
        v = a.T @ (a @ v)
        size = float(np.linalg.norm(v))
        if size == 0:
            return 0.0
        v /= size
    return 1.1 * size


def log_loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean())


def fit_ensemble(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Ensemble:
    """Rules and lasso weights; the first ``held`` share of the rows chooses the penalty."""
    if not len(y):
        return Ensemble([], [], 0.0)
    plain = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    held = int(len(y) * settings.held)
    rules = path_rules(x[held:], y[held:], settings) if 0 < y[held:].sum() < len(y) - held else []
    a = holds(rules, x)
    size = a[held:].mean(axis=0) if rules else np.zeros(0)
    usable = (size * (len(y) - held) >= settings.least) & ((1 - size) * (len(y) - held) >= settings.least)
    # of rules that hold for the same rows the first one stays
    first: dict[bytes, int] = {}
    for i in np.flatnonzero(usable):
        first.setdefault(a[:, i].tobytes(), int(i))
    chosen = list(first.values())
    if not chosen:
        return Ensemble([], [], plain)
    a = a[:, chosen]
    scale = a[held:].std(axis=0)
    a /= scale  # so that the penalty weighs frequent and rare rules alike
    most = float(np.abs((y[held:] - y[held:].mean()) @ a[held:]).max()) / (len(y) - held)
    penalties = [most * p for p in settings.penalties]
    path = lasso(a[held:], y[held:], penalties, settings.steps)
    losses = [log_loss(a[:held] @ w + bias, y[:held]) for w, bias in path] if held else [0.0] * len(path)
    last = int(np.argmin(losses))
    w, bias = lasso(a, y, penalties[: last + 1], settings.steps)[-1]
    kept = np.flatnonzero(w)
    return Ensemble([rules[chosen[i]] for i in kept], [float(w[i] / scale[i]) for i in kept], bias)


# ---- as Spark columns


def condition_column(c: Condition) -> Column:
    value = F.col(STATISTICS[c.statistic])
    return value > F.lit(c.threshold) if c.above else value <= F.lit(c.threshold)


def score_column(ensemble: Ensemble) -> Column:
    """The chance of label 1 as an expression over the columns of STATISTICS."""
    margin = F.lit(ensemble.bias)
    for rule, weight in zip(ensemble.rules, ensemble.weights):
        margin = margin + F.when(reduce(and_, map(condition_column, rule)), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def is_held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_rules(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    settings: Settings = Settings(),
) -> Ensemble:
    """Fit on the ``settings.sample`` labelled rows of least hash that are not held out."""
    known = labels.select(column(doc_id).cast("long").alias("id"), column(label).cast("double").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("id")))
    some = least_rows(known, F.xxhash64(F.lit(13), "id"), settings.sample, "id", "y")
    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    # at most ``sample`` rows of two numbers
    joined = given.join(F.broadcast(some), F.col("doc_id") == F.col("id"))
    rows = with_statistics(joined, "text", "id", "y")
    # ids that many documents share may have brought up more rows
    order = [F.xxhash64(F.lit(13), "id"), F.col("id"), F.col("y"), *map(F.col, STATISTICS)]
    chosen = rows.orderBy(*order).limit(settings.sample).collect()
    x = np.array([[r[s] for s in STATISTICS] for r in chosen]).reshape(-1, len(STATISTICS))
    return fit_ensemble(x, np.array([float(r["y"] > 0) for r in chosen]), settings)


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    rows = with_statistics(given, "text", "doc_id")
    return rows.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score_column(ensemble).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Quality rules with line labels: a linear-chain conditional random field marks lines as content or boilerplate.

Base counts fail documents that are very short or repeat themselves. For the others the lines are a sequence; each
line has yes/no features, a linear-chain field scores labels and neighbouring labels, and Viterbi decoding finds the
best sequence. A document is kept if content lines hold at least ``CONTENT_SHARE`` of its words.

The field is trained here, by gradient ascent on the conditional likelihood (forward-backward in numpy), on the lines
of ``SAMPLE`` documents of least hash, the documented bound. Their labels are weak ones, from strict signs of
boilerplate (symbols, capitals, repetition, copies of earlier lines); features are softer and see the neighbours, so
that decoding smooths over single odd lines.

Defined cases: null, empty and word-less texts have no words and fail the base rule; lines without a word are left out
of the sequence; rows are treated one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, least_rows, map_arrow

SAMPLE = 400
CONTENT_SHARE = 0.5
LEAST_WORDS = 10
SYMBOLS = b"#*$%&|<>"
_ODD = b"#*$%&|<>=_~^\\/{}[]@"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LETTERS = _UPPER + _UPPER.lower()
_NUMBERS = b"0123456789"
_HIGH = bytes(range(128, 256))
_STOPS = frozenset(b".!?:;\"')")
FEATURES = 13


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, words, range(n)), np.int64, n)
    keys, span = ids, n
    for i in range(1, width):
        if span * n >= 1 << 62:  # renumber what is joined so far
            keys = np.unique(keys, return_inverse=True)[1]
            span = n
        keys, span = keys[: n - i] * n + ids[i:], span * n
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(keys, twice))
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _without(line: bytes, these: bytes) -> int:
    return len(line) - len(line.translate(None, these))


def line_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the lines with a word: features, words, weak label (1: boilerplate), and the number of repeated lines."""
    seen: set[bytes] = set()
    rows, counts, weak, copies = [], [], [], 0
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        copy = line in seen
        seen.add(line)
        copies += copy
        n = len(words)
        size = len(line) - _without(line, SPACES)
        odd = _without(line, _ODD) / size
        upper = _without(line, _UPPER)
        letters = _without(line, _ASCII_LETTERS) + _without(line, _HIGH)
        numbers = _without(line, _NUMBERS) / size
        distinct = len(set(words)) / n
        shout = upper / max(letters, 1)
        ended = line.rstrip(SPACES)[-1] in _STOPS
        rows.append((
            1, n < 3, n >= 8, ended, odd > 0.03, odd > 0.1, shout > 0.3, shout > 0.6, numbers > 0.3, letters < 0.6 * size,
            n >= 6 and distinct < 0.6, n >= 6 and distinct < 0.35, copy))
        counts.append(n)
        weak.append(
            odd > 0.12 or (shout > 0.7 and letters > 8) or (n >= 8 and distinct < 0.3) or copy or letters < 0.3 * size)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(counts, np.int64), np.array(weak, np.int64), copies


class Field:
    """Weights of two labels (0 content, 1 boilerplate): by feature, and by pair of neighbours."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence (Viterbi); ties go to content."""
        scores = features @ self.emission
        if not len(scores):
            return np.zeros(0, np.int64)
        (cc, cb), (bc, bb) = self.transition.tolist()
        back = []
        c, b = scores[0].tolist()
        for ec, eb in scores[1:].tolist():
            to_c, to_b = b + bc > c + cc, b + bb > c + cb
            back.append((to_c, to_b))
            c, b = (b + bc if to_c else c + cc) + ec, (b + bb if to_b else c + cb) + eb
        label = int(b > c)
        labels = [label]
        for to in reversed(back):
            label = int(to[label])
            labels.append(label)
        return np.array(labels[::-1], np.int64)


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 100, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the mean conditional log-likelihood of (features, labels) sequences."""
    emission = np.zeros((FEATURES, 2))
    transition = np.zeros((2, 2))
    total = sum(len(y) for _, y in sequences)
    if not total:
        # nothing to learn from: all lines are content
        emission[0] = (1.0, 0.0)
        return Field(emission, transition)
    mean = [np.zeros_like(emission), np.zeros_like(transition)]
    square = [np.zeros_like(emission), np.zeros_like(transition)]
    for turn in range(1, steps + 1):
        d_emission, d_transition = np.zeros_like(emission), np.zeros_like(transition)
        for x, y in sequences:
            if not len(y):
                continue
            score = x @ emission
            forward, backward = np.zeros_like(score), np.zeros_like(score)
            forward[0] = score[0]
            for t in range(1, len(y)):
                forward[t] = score[t] + np.logaddexp(forward[t - 1, 0] + transition[0], forward[t - 1, 1] + transition[1])
            for t in range(len(y) - 2, -1, -1):
                after = score[t + 1] + backward[t + 1]
                backward[t] = np.logaddexp(transition[:, 0] + after[0], transition[:, 1] + after[1])
            log_z = np.logaddexp(*forward[-1])
            single = np.exp(forward + backward - log_z)
            truth = np.eye(2)[y]
            d_emission += x.T @ (truth - single)
            if len(y) > 1:
                pair = np.exp(forward[:-1, :, None] + transition + (score + backward)[1:, None, :] - log_z)
                d_transition -= pair.sum(axis=0)
                np.add.at(d_transition, (y[:-1], y[1:]), 1)
        for i, (weight, slope) in enumerate(((emission, d_emission), (transition, d_transition))):
            slope = slope / total - decay * weight
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
            weight += rate * (mean[i] / (1 - 0.9**turn)) / (np.sqrt(square[i] / (1 - 0.99**turn)) + 1e-8)
    return Field(emission, transition)


def fit_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Field:
    """Train on the lines of the ``sample`` documents of least hash."""
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).filter("text is not null")
    by = F.xxhash64(F.lit(5), "doc_id", F.octet_length("text"))
    chosen = least_rows(rows, by, sample, "text").select("text").collect()
    tables = [line_table(r["text"].encode()) for r in chosen]
    return fit_field([(x, y) for x, _, y, _ in tables])


_QUALITY = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)


def line_quality(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id", share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, content_share."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                source = value.as_py() or ""
                data = source.encode()
                words = data.split()
                n = len(words)
                repeats = repeated_words(words)
                features, counts, _, copies = line_table(data)
                failed = n < LEAST_WORDS or 100 * repeats > 20 * n
                content = float(counts[field.decode(features) == 0].sum() / n) if n else 0.0
                chars = len(source) - _without(data, SPACES)
                rows.append((n, chars, _without(data, SYMBOLS), copies, repeats, failed, not failed and content >= share, content))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return map_arrow(given, judge, _QUALITY)

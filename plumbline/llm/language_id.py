"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Every text is the average of the embeddings of its hashed byte n-grams, over the whole text; a linear softmax on top
gives the languages. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``Settings.sample`` rows of least hash, the documented bound); everything else covers all rows. A fifth of
the sample is held out of the training to fit a temperature and what is rejected.

A softmax only tells the learned languages apart. What is none of them shows in how usual a text's n-grams are: their
mean log frequency in the predicted language, against that of held-out texts of the language, in units of a spread that
depends on the number of n-grams. Held-out texts, whole and cut short, say how far texts of learned languages go; each
language's texts, seen without that language, say where others begin. The limit lies between the two, and rejects no
more than ``rejected`` of the former.

Prediction needs two tables: the product of embeddings and softmax weights, of whose rows for the n-grams a text's
logits are the mean, and the log frequencies. They have a fixed size (``buckets`` x languages) and go to the executors
with the function.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows without a language
are not learned from; without any labelled row every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, least_rows, map_arrow, mix, slices, text_bytes

UNKNOWN = "und"
#: Bytes of text whose n-grams a prediction holds at once.
PIECE = 1 << 18
_LETTER = r"\p{L}"


class Settings(NamedTuple):
    sample: int = 3000
    grams: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 15
    size: int = 16
    epochs: int = 12
    #: Small samples are gone through more often, until so many steps are made.
    steps: int = 1200
    batch: int = 32
    rate: float = 0.5
    held: float = 0.2
    #: Share of the calibration texts that may be rejected at most.
    rejected: float = 0.001
    #: Confidence that is never rejected.
    enough: float = 0.5
    #: Bytes to which calibration texts are cut, to know the spread of short texts.
    cuts: tuple[int, ...] = (40, 200)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    settings: Settings
    #: Log frequency of each bucket, and its mean over texts of the language.
    usual: np.ndarray
    typical: np.ndarray
    #: Variance of a text's mean: a part that stays, and one per n-gram.
    spread: tuple[float, float]
    limit: float


def gram_ids(
    flat: np.ndarray, offsets: np.ndarray, settings: Settings, starts: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of ASCII-lower-cased bytes, those across texts left out, and each text's number; of the
    n-grams that start within the first ``starts`` bytes, if given."""
    flat = flat[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    letters = lower[flat]
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    left = (np.repeat(offsets[1:], lengths) - np.arange(len(flat))) if len(flat) else np.zeros(0, np.int64)
    ids, owners = [], []
    code = np.zeros(len(flat), np.uint32)
    for n in range(1, max(settings.grams) + 1):
        shifted = np.zeros(len(flat), np.uint32)
        shifted[: max(len(flat) - n + 1, 0)] = letters[n - 1 :]
        code = (code << np.uint32(8)) | shifted if n <= 4 else (code * np.uint32(16777619)) ^ shifted
        if n in settings.grams:
            whole = left >= n
            whole[len(flat) if starts is None else starts :] = False
            hashed = (code[whole] + np.uint32(n)) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x85EBCA77)
            ids.append((hashed >> np.uint32(32 - settings.bits)).astype(np.int32))
            owners.append(text[whole])
    return np.concatenate(ids), np.concatenate(owners)


def means_of(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Mean rows of ``table`` over each text's n-grams, and how many there are, gone through in pieces of ``PIECE``
    bytes, which may end within a text: a piece is followed by the bytes that its last n-grams still need."""
    rows, kinds = len(offsets) - 1, table.shape[1]
    counts, sums = np.zeros(rows), np.zeros((rows, kinds))
    ahead = max(settings.grams) - 1
    for low in range(int(offsets[0]), int(offsets[-1]), PIECE):
        high = min(low + PIECE, int(offsets[-1]))
        first = int(np.searchsorted(offsets, low, side="right")) - 1
        last = int(np.searchsorted(offsets, high, side="left"))
        end = min(high + ahead, int(offsets[last]))
        ends = np.minimum(offsets[first : last + 1], end)
        ids, owners = gram_ids(flat, np.concatenate(([low], ends[1:])), settings, high - low)
        size = last - first
        counts[first:last] += np.bincount(owners, minlength=size)
        for k in range(kinds):
            sums[first:last, k] += np.bincount(owners, weights=table[ids, k], minlength=size)
    return sums / np.maximum(counts, 1)[:, None], counts


def logits_of(flat: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    return means_of(flat, offsets, model.table, model.settings)[0] + model.bias


def _unusual(means: np.ndarray, counts: np.ndarray, kind: np.ndarray, typical: np.ndarray, spread) -> np.ndarray:
    """How far texts lie below what is typical of language ``kind``, in units of the spread of so many n-grams."""
    below = typical[kind] - means[np.arange(len(kind)), kind]
    return below / np.sqrt(spread[0] + spread[1] / np.maximum(counts, 1))


def _temperature(raw: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least cross-entropy; targets leave one count for each way of being wrong, as a finite number
    of right answers does not tell certainty, so that the best value is finite."""
    kinds = raw.shape[1]
    wrong = 1 / (len(truth) + 2)
    target = np.full(raw.shape, wrong / max(kinds - 1, 1))
    target[np.arange(len(truth)), truth] = 1 - wrong

    def loss(log_t: float) -> float:
        x = raw / np.exp(log_t)
        top = x.max(axis=1, keepdims=True)
        return float(-(target * (x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True)))).sum(axis=1).mean())

    low, high = -12.0, 12.0
    while kinds > 1 and high - low > 1e-4:  # the loss is convex in 1 / t
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _calibrate(texts: list[str], truth: np.ndarray, table: np.ndarray, bias, usual, settings: Settings):
    """typical, spread and limit from texts that were not trained on."""
    kinds = len(bias)
    whole = [t.encode() for t in texts]
    cut = [w[:n] for n in settings.cuts for w in whole if len(w) > n]
    kind = np.concatenate((truth, *(truth[[len(w) > n for w in whole]] for n in settings.cuts)))
    both = np.hstack((table, usual))
    parts = [means_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]), both, settings) for w in (*whole, *cut)]
    means, counts = np.concatenate([m for m, _ in parts]), np.concatenate([n for _, n in parts])
    logits, common = means[:, :kinds] + bias, means[:, kinds:]
    own = np.arange(len(whole))
    typical = np.array([common[own[truth == k], k].mean() if (truth == k).any() else common[own].max(axis=1).mean()
                        for k in range(kinds)])
    below = typical[kind] - common[np.arange(len(kind)), kind]
    shape = np.column_stack((np.ones(len(kind)), 1 / np.maximum(counts, 1)))
    spread = tuple(np.maximum(np.linalg.lstsq(shape, below**2, rcond=None)[0], (1e-4, 1e-2)))
    known = float(np.quantile(_unusual(common, counts, kind, typical, spread), 1 - settings.rejected))
    limit = max(known, 0.0)
    if kinds > 1:  # the same texts as if their language had not been learned
        others = logits[own].copy()
        others[own, truth] = -np.inf
        foreign = _unusual(common[own], counts[own], others.argmax(axis=1), typical, spread)
        begin = float(np.quantile(foreign, 0.05))
        if begin > limit > 0:
            limit = float(np.sqrt(limit * begin))
    return typical, spread, limit


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Train on texts in their given order."""
    languages = sorted(set(labels))
    if not languages:
        none = np.zeros((1 << settings.bits, 0))
        return Model([], none, np.zeros(0), 1.0, 1.0, settings, none, np.zeros(0), (1.0, 0.0), 0.0)
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(7)
    width = 1 << settings.bits
    embed = rng.normal(0, 0.1, (width, settings.size))
    weight = rng.normal(0, 0.1, (settings.size, len(languages)))
    bias = np.zeros(len(languages))
    bags = []
    for text in texts:
        flat, offsets = text_bytes(pa.array([text]))
        ids, counts = np.unique(gram_ids(flat, offsets, settings)[0], return_counts=True)
        bags.append((ids, counts / max(counts.sum(), 1)))
    held = int(len(texts) * settings.held)
    train = np.arange(held, len(texts))
    epochs = max(settings.epochs, -(-settings.steps // max(1, len(train) // settings.batch)))
    for epoch in range(epochs):
        rate = settings.rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // settings.batch)):
            if not len(part):
                continue
            mean = np.stack([bags[i][1] @ embed[bags[i][0]] for i in part])
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(part)), y[part]] -= 1
            back = error @ weight.T
            weight -= rate * mean.T @ error / len(part)
            bias -= rate * error.mean(axis=0)
            for i, g in zip(part, back):
                # each n-gram's own step is scaled up as its share of a long text is tiny
                embed[bags[i][0]] -= rate * 20 * np.sqrt(bags[i][1])[:, None] * g / len(part)
    table = embed @ weight
    checked = range(held) if held else range(len(texts))
    raw = np.stack([bags[i][1] @ table[bags[i][0]] + bias for i in checked])
    truth = y[list(checked)]
    temperature = _temperature(raw, truth)
    best = _softmax(raw / temperature).max(axis=1)
    least = min(float(np.quantile(best, settings.rejected)), settings.enough)
    shares = np.zeros((width, len(languages)))
    for i in train:
        shares[bags[i][0], y[i]] += bags[i][1]
    usual = np.log((shares + 1 / width) / (shares.sum(axis=0) + 1))
    typical, spread, limit = _calibrate([texts[i] for i in checked], truth, table, bias, usual, settings)
    return Model(languages, table, bias, temperature, least, settings, usual, typical, spread, limit)


def is_held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null doc_id counts as one to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", settings: Settings = Settings()
) -> Model:
    """Train on the ``settings.sample`` rows of least hash that have a language and are not held out."""
    rows = docs.select(column(text).alias("text"), column(lang).alias("lang"), column(doc_id).alias("doc_id"))
    rows = rows.filter(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("text").rlike(_LETTER))
    # which texts are learned from must not hang on the order of rows
    by = F.xxhash64(F.lit(11), "doc_id", F.octet_length("text"))
    chosen = least_rows(rows, by, settings.sample, "text").select("text", "lang").collect()
    return fit([r["text"] for r in chosen], [r["lang"] for r in chosen], settings)


def predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNKNOWN])
        kinds, both = len(model.languages), np.hstack((model.table, model.usual))
        for batch in batches:
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, _LETTER), False).to_numpy(zero_copy_only=False)
            flat, offsets = text_bytes(text)
            best = np.full(len(lettered), len(model.languages))
            score, unusual = np.zeros(len(lettered)), np.zeros(len(lettered))
            for first, last in slices(offsets) if model.languages else ():
                means, counts = means_of(flat, offsets[first : last + 1], both, model.settings)
                chances = _softmax((means[:, :kinds] + model.bias) / model.temperature)
                best[first:last] = chances.argmax(axis=1)
                score[first:last] = chances.max(axis=1)
                unusual[first:last] = _unusual(means[:, kinds:], counts, best[first:last], model.typical, model.spread)
            best[~lettered] = len(model.languages)
            score[best == len(model.languages)] = 0
            rejected = (score < model.least) | (unusual > model.limit) | (best == len(model.languages))
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names_kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, names.take(pa.array(best)), pa.array(score), pa.array(rejected)],
                names=[*names_kept, "lang_pred", "score", "rejected"],
            )

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    given = docs.select(
        column(doc_id).cast("long").alias("doc_id"), is_held_out(column(doc_id)).alias("held_out"), column(text).alias("text"))
    return map_arrow(
        given, predictor(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not rejected; columns as given."""
    predict = predictor(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(text))], names=["text"])
            yield batch.filter(pc.invert(next(predict(iter([texts]))).column("rejected")))

    return map_arrow(docs, keep, docs.schema)

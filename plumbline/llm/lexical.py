"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time over blocks of documents.

Every task goes through its documents in blocks. A block is indexed in memory by the terms of the items: for each term a
posting list of documents with the (integer) impacts. For an item, its *short* lists are summed term at a time into
accumulators; these are then one more iterator, bounded by their largest sum, beside the long lists. Document at a time,
in ascending windows of documents, the iterators are divided by their bounds: those that cannot reach the item's current
limit even together are only looked into for documents that the others bring up, largest bound first, and a document is
given up as soon as what is left cannot take it to the limit. The limit is the item's lowest score of the best so far
and goes on from block to block; equality never gives a document up, so ties are decided by doc_id alone.

A task returns the best of each item, so what is shuffled is at most ``top`` rows for each item and task. The terms'
document counts come from one pass over all documents, pre-aggregated in the tasks. Items are taken in groups of about
``GROUP`` (item, term) pairs, which bounds what a task is sent; every group goes over all documents.

Defined cases: a null, empty or term-less text has no terms and does not count among the documents; an item without a
term that occurs anywhere has no rows; items of one id are one item with all their terms; every row of documents counts
on its own, also if its id repeats; equal scores go by ascending doc_id, null last; an empty table on either side gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, landed, map_arrow

TOP = 10
#: (item, term) pairs of one group of items.
GROUP = 200_000
#: Bytes of text that are indexed at once, and documents of one window.
BLOCK_BYTES = 1 << 24
WINDOW = 4096
#: A list is short if it holds at most this share of the block's documents.
SHORT = 1 / 16
#: Different terms that a task counts before it gives them on.
COUNTED = 1 << 18

#: Separators are spaces, A-Z small letters; bytes of 128 and more belong to terms.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Statistics(NamedTuple):
    """Number of documents with a term, number of all their terms, and ``(term, df)`` as a landed table."""

    documents: int
    terms: int
    frequencies: DataFrame


def collect_statistics(docs: DataFrame, text: str = "text") -> Statistics:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        size = words = 0

        def batch_of() -> pa.RecordBatch:
            # the empty term stands for all: documents and their terms
            names = pa.array([b"", *found], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [names, pa.array([size, *found.values()]), pa.array([words] + [0] * len(found))], names=["term", "df", "words"])

        for batch in batches:
            for value in batch.column("text"):
                terms = terms_of(value.as_py())
                size += bool(terms)
                words += len(terms)
                found.update(set(terms))
                if len(found) > COUNTED:
                    yield batch_of()
                    found.clear()
                    size = words = 0
        yield batch_of()

    rows = map_arrow(docs.select(column(text).alias("text")), counted, "term string, df long, words long")
    table = landed(rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "terms")
    whole = table.filter(F.col("term") == "").first()
    frequencies = table.filter(F.col("term") != "").select("term", "df")
    return Statistics(whole["df"] if whole else 0, whole["words"] if whole else 0, frequencies)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Item(NamedTuple):
    """An item with the numbers of its terms."""

    id: int | None
    terms: np.ndarray


class Postings(NamedTuple):
    """Documents in ascending order, their impacts, and the largest impact."""

    docs: np.ndarray
    impacts: np.ndarray
    bound: int


class Block:
    """The posting lists of some documents, which stand in the order of their ids."""

    def __init__(self, ids: list, texts: list[str], vocabulary: dict[bytes, int], weights: np.ndarray, stats: tuple[int, int]):
        self.size = len(ids)
        order = sorted(range(self.size), key=lambda i: (ids[i] is None, ids[i]))
        self.ids = [ids[i] for i in order]
        lengths = np.zeros(self.size, np.int64)
        keys = []
        for place, i in enumerate(order):
            terms = terms_of(texts[i])
            lengths[place] = len(terms)
            known = np.fromiter(map(vocabulary.get, terms, repeat(-1)), np.int64, len(terms))
            keys.append(known[known >= 0] * self.size + place)
        pairs, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        owner, docs = pairs // max(self.size, 1), pairs % max(self.size, 1)
        documents, terms_in_all = stats
        m = 100 - 90 + (90 * lengths * documents) // terms_in_all
        impacts = weights[owner] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        self.lists: dict[int, Postings] = {}
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for first, last in zip(starts, [*starts[1:], len(owner)]):
            part = impacts[first:last]
            self.lists[int(owner[first])] = Postings(docs[first:last], part, int(part.max()))

    def iterators(self, item: Item) -> list[Postings]:
        """The long lists of the item, and the sums of its short ones as one list."""
        lists = [self.lists[t] for t in item.terms.tolist() if t in self.lists]
        short = [p for p in lists if len(p.docs) <= SHORT * self.size]
        found = [p for p in lists if len(p.docs) > SHORT * self.size]
        if short:
            docs = np.concatenate([p.docs for p in short])
            order = np.argsort(docs, kind="stable")
            docs, impacts = docs[order], np.concatenate([p.impacts for p in short])[order]
            starts = np.flatnonzero(np.diff(docs, prepend=-1))
            sums = np.add.reduceat(impacts, starts)
            found.append(Postings(docs[starts], sums, int(sums.max())))
        return found


class Best:
    """The best documents of an item so far, and the score that another one must reach."""

    def __init__(self, top: int):
        self.top = top
        self.rows: list[tuple[int, bool, int]] = []

    @property
    def limit(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, places: np.ndarray, ids: list) -> None:
        rows = [(-s, ids[p] is None, ids[p] or 0) for s, p in zip(scores.tolist(), places.tolist())]
        self.rows = sorted(self.rows + rows)[: self.top]


def search_block(block: Block, item: Item, best: Best) -> None:
    """Take the block's documents for the item into ``best``."""
    iterators = sorted(block.iterators(item), key=lambda p: p.bound)
    reach = np.cumsum([p.bound for p in iterators])  # what an iterator and all of lesser bounds can add up to
    for low in range(0, block.size, WINDOW):
        # iterators that cannot reach the limit together bring up no document
        needed = int(np.searchsorted(reach, best.limit))
        if needed == len(iterators):
            return
        scores = np.zeros(min(WINDOW, block.size - low), np.int64)
        for p in iterators[needed:]:
            first, last = np.searchsorted(p.docs, (low, low + WINDOW))
            scores[p.docs[first:last] - low] += p.impacts[first:last]
        places = np.flatnonzero(scores)
        scores = scores[places]
        for k in range(needed - 1, -1, -1):
            open_ = scores + reach[k] >= best.limit
            places, scores = places[open_], scores[open_]
            if not len(places):
                break
            p = iterators[k]
            at = np.minimum(np.searchsorted(p.docs, places + low), len(p.docs) - 1)
            scores += np.where(p.docs[at] == places + low, p.impacts[at], 0)
        reached = scores >= best.limit
        places, scores = places[reached], scores[reached]
        if len(places) > best.top:  # places ascend with the ids, so a stable order decides ties
            chosen = np.argsort(-scores, kind="stable")[: best.top]
            places, scores = places[chosen], scores[chosen]
        best.add(scores, places + low, block.ids)


def searcher(items: list[Item], vocabulary: dict[bytes, int], weights: np.ndarray, stats: tuple[int, int], top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(top) for _ in items]
        ids: list = []
        texts: list[str] = []
        held = 0

        def done() -> None:
            block = Block(ids, texts, vocabulary, weights, stats)
            for item, best in zip(items, found):
                search_block(block, item, best)

        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                text = value.as_py()
                if not text:
                    continue
                ids.append(key.as_py())
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    done()
                    ids, texts, held = [], [], 0
        if ids:
            done()
        rows = [(item.id, None if no_id else key, -score) for item, best in zip(items, found) for score, no_id, key in best.rows]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return search


def item_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """The distinct ``(item_id, term)`` of the items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(set(terms_of(t.as_py()))) for t in batch.column("text")]
            owners = batch.column("item_id").take(pa.array([i for i, t in enumerate(terms) for _ in t], pa.int64()))
            names = pa.array([t for some in terms for t in some], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([owners, names], names=["item_id", "term"])

    given = items.select(column(key).cast("long").alias("item_id"), column(text).alias("text"))
    return map_arrow(given, split, "item_id long, term string").distinct()


def ranked_search(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", top: int = TOP, group: int = GROUP,
) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    stats = collect_statistics(docs, text)
    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    wanted = landed(item_terms(items, item_text, item_id).join(stats.frequencies, "term"), "item-terms")
    groups = -(-wanted.count() // group)
    number = F.pmod(F.xxhash64("item_id"), F.lit(groups)) if groups > 1 else F.lit(0)
    found = []
    for at in range(groups):
        rows = wanted.filter(number == at).orderBy("item_id", "term").collect()  # about ``group`` rows
        frequencies = {r["term"].encode(): r["df"] for r in rows}
        vocabulary = {t: i for i, t in enumerate(frequencies)}
        weights = np.array([weight(stats.documents, df) for df in frequencies.values()], np.int64)
        terms: dict = {}
        for r in rows:
            terms.setdefault(r["item_id"], []).append(vocabulary[r["term"].encode()])
        search = searcher(
            [Item(i, np.array(t)) for i, t in terms.items()], vocabulary, weights, (stats.documents, stats.terms), top)
        best = _first(map_arrow(given, search, "item_id long, doc_id long, score long"), top)
        found.append(landed(best, "found") if groups > 1 else best)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found).select("item_id", "rank", "doc_id", "score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

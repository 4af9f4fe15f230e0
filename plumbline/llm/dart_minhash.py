"""Near-duplicate classes of documents by dart-throwing weighted minhash and banding.

A document is a weighted set: its shingles of ``SHINGLE`` words (lower-cased A-Z), weighted by how often they occur.
A shingle of weight w owns the region [0, w) x [0, infinity) of weight and rank; darts fall on the plane as a Poisson
process that depends on the shingle only. A document of total weight W looks at the darts of rank below t / W, about
t of them however large it is, keeps the earliest dart of each of its coordinates, and doubles the rank if a
coordinate got none. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents of equal weighted sets are one node. Nodes that share a band are compared by exact similarity: first every
node of a band's bucket with the bucket's leader, which is one row a node however large the bucket is. Of the buckets
that hold several classes after that, all nodes of different classes meet, in cells of two blocks each, so that every
two similar nodes that share a band are in one class.

Defined cases: null, empty and word-less texts have no shingle and are classes of their own, one for each row; texts
of fewer than ``SHINGLE`` words have one shingle, all their words; of rows that repeat a doc_id with equal texts one
stays; a null doc_id ranks above every other, so that such a row stays only where all its class has none; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, landed, map_arrow, mix, nested, slices, text_bytes, unit, window_hashes, window_starts, words_of
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
#: Nodes, and strips, of about one block of a large bucket.
BLOCK, BLOCK_STRIPS = 512, 1 << 18
#: Different strips that are counted in one step of a cell.
_COLUMNS = 4096

_LEAST_RANK = 2.0**-6
_SLOT = np.uint64((1 << 48) - 1)
_tables: dict[int, np.ndarray] = {}


def _poisson(level: int) -> np.ndarray:
    """Cumulated Poisson probabilities of the number of darts in a unit strip of this level."""
    if level not in _tables:
        mean = _LEAST_RANK * 2.0 ** max(level - 1, 0)
        count = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
        logs = count * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(count[1:]))))
        _tables[level] = np.cumsum(np.exp(logs))
    return _tables[level]


def elements(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit strips of the texts' weighted sets, ascending by text, and how many each text has.

    A shingle of weight w gives w strips: its hash mixed with 0, 1, .. w - 1.
    """
    words = words_of(flat, offsets, lower=True)
    hashes = words.hashes[0]
    first, text = window_starts(words, size)
    grams = window_hashes(hashes, size)[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([
            mix(np.array([len(h)], np.uint64) + window_hashes(h, len(h)))[0]
            for h in (hashes[f : f + c] for f, c in zip(words.first[short], words.counts[short]))
        ])
        grams, text = np.concatenate((grams, whole)), np.concatenate((text, short))
    rows = len(offsets) - 1
    keys = np.sort((text.astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    begun = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
    copy = (np.arange(len(keys)) - begun).astype(np.uint64)
    strips = mix((keys & _SLOT) + copy * np.uint64(0xA0761D6478BD642F))
    return strips, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=rows)


def dart_ranks(strips: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The least rank in each coordinate, one line per text (of a weight above 0)."""
    result = np.full((len(weights), coordinates), np.inf)
    pending = np.flatnonzero(weights > 0)
    reach = np.zeros(len(weights))
    reach[pending] = coordinates * (math.log(coordinates) + 2) / weights[pending]
    owner = np.repeat(np.arange(len(weights)), weights)
    while len(pending):
        member = np.zeros(len(weights), bool)
        member[pending] = True
        own = np.flatnonzero(member[owner])
        levels = np.maximum(np.ceil(np.log2(reach / _LEAST_RANK, where=member, out=np.zeros(len(weights)))), 0)
        for level in range(int(levels[pending].max()) + 1):
            if level:
                own = own[levels[owner[own]] >= level]
            seeds = mix(strips[own] ^ np.uint64(level * 0x9E3779B1 + 1))
            count = np.searchsorted(_poisson(level), unit(seeds), side="right")
            width = _LEAST_RANK * 2.0 ** max(level - 1, 0)
            low = width if level else 0.0
            source = np.repeat(np.arange(len(own)), count)
            nth = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
            darts = mix(seeds[source] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
            rank = low + width * unit(darts)
            text = owner[own[source]]
            near = rank < reach[text]
            place = (mix(darts[near]) % np.uint64(coordinates)).astype(np.int64)
            np.minimum.at(result.reshape(-1), text[near] * coordinates + place, rank[near])
        pending = pending[~np.isfinite(result[pending]).all(axis=1)]
        reach[pending] *= 2
    return result


def band_keys(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = mix(np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), bands, rows))
    key = np.zeros((len(ranks), bands), np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(3) + bits[:, :, i])
    return (key + mix(np.arange(bands, dtype=np.uint64))).view(np.int64)


_SIGNATURE = "doc_id long, row long, key long, weight long, print_a long, print_b long, bands array<long>"


def _prints(strips: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each text's strips; 0 where it has none."""
    full = weights > 0
    begun = (np.cumsum(weights) - weights)[full]
    lanes = []
    for salt in (0x1B873593, 0x85EBCA6B):
        lane = np.zeros(len(weights), np.uint64)
        if full.any():
            lane[full] = np.add.reduceat(mix(strips ^ np.uint64(salt)), begun)
        lanes.append(lane.view(np.int64))
    return lanes


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """docs (doc_id, row, text): weight, a 128-bit print of the weighted set, and the band keys."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch.column("text"))
            for first, last in slices(offsets):
                strips, weights = elements(flat, offsets[first : last + 1], size)
                full = weights > 0
                prints = _prints(strips, weights)
                keys = band_keys(dart_ranks(strips, weights[full], bands * rows), bands, rows).reshape(-1)
                at = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("row").slice(first, last - first),
                        batch.column("key").slice(first, last - first),
                        pa.array(weights.astype(np.int64)),
                        pa.array(prints[0]),
                        pa.array(prints[1]),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys)),
                    ],
                    names=["doc_id", "row", "key", "weight", "print_a", "print_b", "bands"],
                )

    return map_arrow(docs, compute, _SIGNATURE)


def strip_sets(texts: DataFrame, size: int) -> DataFrame:
    """texts (node, text, print_a, print_b): the sorted strips of each text whose prints are those named."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch.column("text"))
            for first, last in slices(offsets):
                strips, weights = elements(flat, offsets[first : last + 1], size)
                ends = np.cumsum(weights)
                for a, b in zip(ends - weights, ends):
                    strips[a:b].sort()
                at = np.concatenate(([0], ends)).astype(np.int32)
                part = batch.slice(first, last - first)
                prints = _prints(strips, weights)
                own = prints[0] == part.column("print_a").to_numpy()
                own &= prints[1] == part.column("print_b").to_numpy()
                sets = pa.ListArray.from_arrays(pa.array(at), pa.array(strips.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], names=["node", "strips"]).filter(pa.array(own))

    return map_arrow(texts, compute, "node long, strips array<long>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose strip sets have at least this Jaccard similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            left, right = batch.column("left_strips"), batch.column("right_strips")
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
            rv = right.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            kept = batch.select(["a", "b"]).filter(pa.array(good))
            if kept.num_rows:
                yield kept

    left = sets.select(F.col("node").alias("a"), F.col("strips").alias("left_strips"))
    right = sets.select(F.col("node").alias("b"), F.col("strips").alias("right_strips"))
    return map_arrow(pairs.select("a", "b").join(left, "a").join(right, "b"), verify, "a long, b long")


def near_classes(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
) -> DataFrame:
    """One row per document: doc_id, row, print_a, print_b, weight, class (a number), best (its row that stays)."""
    given = docs.select(
        column(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        _key(text, doc_id).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"),
    )
    signed = landed(signatures(given, bands, rows, size), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "key")
    nodes = landed(
        signed.filter("weight > 0").groupBy("print_a", "print_b", "weight")
        .agg(F.min(first).alias("best"), F.count("*").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    inside = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = inside.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    buckets = landed(inside.join(shared, ["band", "key"]), "buckets")
    labels = _link(docs, text, doc_id, signed, nodes, buckets, similarity, size)
    labelled = nodes.join(labels, "node", "left").select(
        "print_a", "print_b", "weight", "best", "size", F.coalesce("label", "node").alias("class"))
    classes = labelled.groupBy("class").agg(F.min("best").alias("best"), F.sum("size").alias("class_size"))
    located = labelled.drop("best", "size").join(classes, "class")
    keys = ["print_a", "print_b", "weight"]
    full = signed.filter("weight > 0").drop("bands").join(located, keys)
    alone = signed.filter("weight = 0").drop("bands").select(
        "*", F.lit(None).cast("long").alias("class"), first.alias("best"), F.lit(1).cast("long").alias("class_size"))
    return full.select(alone.columns).unionByName(alone)


def _link(docs, text, doc_id, signed, nodes, buckets, similarity, size) -> DataFrame:
    """(node, label) of the nodes that are linked to another."""
    spark = docs.sparkSession
    wanted = buckets.select("node").distinct()
    chosen = nodes.join(wanted, "node", "left_semi").select(
        "node", F.col("best.key").alias("__key"), "print_a", "print_b")
    named = docs.select(_key(text, doc_id).alias("__doc"), F.coalesce(column(text), F.lit("")).alias("text"))
    texts = named.join(chosen, F.col("__doc") == F.col("__key")).select("node", "text", "print_a", "print_b")
    sets = landed(strip_sets(texts, size).dropDuplicates(["node"]), "strips")
    labels = landed(wanted.withColumn("label", F.col("node")), "labels")
    leaders = buckets.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("leader"))
    meeting = buckets.join(leaders, ["band", "key"]).filter("node <> leader")
    meeting = meeting.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    labels = _merged(labels, landed(similar_pairs(meeting, sets, similarity), "near-links"))
    # of two nodes, one has been the other's leader
    mixed = landed(_mixed(buckets.join(labels, "node"), 2).select("band", "key", "node", "label"), "mixed-buckets")
    if mixed.isEmpty():
        return labels
    return _merged(labels, landed(close_pairs(mixed, nodes, sets, similarity, forest=True).distinct(), "near-links"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) after the classes of linked nodes (a, b) became one."""
    if links.isEmpty():
        return labels
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    merged = links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(merged).select(F.col("node").alias("label"), F.col("label").alias("now"))
    return landed(labels.join(merged, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "labels")


def _overlaps(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many values each two owners share, or more where an owner holds a value twice."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    number = np.cumsum(fresh) - 1
    common = np.bincount(number) > 1
    number, owner = (np.cumsum(common) - 1)[number[common[number]]], owner[common[number]]
    total = np.zeros((rows, rows), np.float32)
    for low in range(0, int(common.sum()), _COLUMNS):
        first, last = np.searchsorted(number, (low, low + _COLUMNS))
        at = owner[first:last] * _COLUMNS + number[first:last] - low
        held = np.bincount(at, minlength=rows * _COLUMNS).astype(np.float32).reshape(rows, _COLUMNS)
        total += held @ held.T
    return total


def _forest(linked: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the linked pairs, as many as connect what all of them connect, given that ``same`` ones are one already."""
    joined, left = linked | same, np.ones(len(linked), bool)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for root in np.flatnonzero(linked.any(axis=1)):
        front, left[root] = np.array([root] if left[root] else [], np.int64), False
        while len(front):
            reached = np.flatnonzero(joined[front].any(axis=0) & left)
            left[reached] = False
            ends.append((front[joined[np.ix_(front, reached)].argmax(axis=0)], reached))
            front = reached
    a, b = (np.concatenate([e[i] for e in ends] or [np.zeros(0, np.int64)]) for i in (0, 1))
    kept = ~same[a, b]
    return a[kept], b[kept]


def close_pairs(
    placed: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, forest: bool = False
) -> DataFrame:
    """Pairs (a, b) of different labels in one bucket of ``placed`` (band, key, node, label) that may be similar.

    A bucket is cut into blocks, and each two of them meet in one cell. Overlaps are counted there on 32 bits of the
    strips, which makes none smaller, so that no similar pair is left out; pairs may be named more than once. With
    ``forest`` they are counted on whole strips, and of the similar pairs of a cell only those are named that are needed
    to connect the same nodes, given the labels: fewer than the cell has nodes.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            node, label = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("node", "label"))
            weight = np.concatenate([p.column("short").value_lengths().to_numpy() for p in parts]).astype(np.int64)
            values = np.concatenate([p.column("short").flatten().to_numpy() for p in parts])
            common = _overlaps(values, np.repeat(np.arange(len(node)), weight), len(node))
            both = weight[:, None] + weight[None, :]
            good = common >= similarity * (both - common) - (1e-9 if forest else 1e-3)
            good &= np.minimum.outer(weight, weight) >= similarity * np.maximum.outer(weight, weight) - 1e-9
            same = label[:, None] == label[None, :]
            if forest:
                a, b = _forest(good & ~same, same)
            else:
                a, b = np.nonzero(good & ~same & (node[:, None] < node[None, :]))
            low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

        parts, current = [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)])) if len(cells) else [0]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if parts and cells[first] != current:
                    yield close(parts)
                    parts = []
                parts.append(batch.slice(first, last - first))
                current = cells[first]
        if parts:
            yield close(parts)

    buckets = placed.join(nodes.select("node", "weight"), "node").groupBy("band", "key").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("weight") / BLOCK_STRIPS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    dealt = placed.join(buckets, ["band", "key"]).withColumn("own", own).select(
        "band", "key", "node", "label", "own", F.explode(others).alias("other"))
    cell = F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other"))
    strips = F.col("strips") if forest else F.transform("strips", lambda x: F.shiftright(x, 32).cast("int"))
    short = sets.select("node", strips.alias("short"))
    cells = dealt.select(cell.alias("cell"), "node", "label").join(short, "node")
    return map_arrow(cells.repartition("cell").sortWithinPartitions("cell"), meet, "a long, b long")


def _mixed(placed: DataFrame, over: int) -> DataFrame:
    """The rows of buckets that hold more than ``over`` nodes and several labels, with the number ``n`` of nodes."""
    of = placed.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    of = of.filter((F.col("n") > over) & (F.col("low") != F.col("high"))).select("band", "key", "n")
    return placed.join(of, ["band", "key"])


def _key(text: str, doc_id: str) -> Column:
    """What a document is found again by."""
    return F.xxhash64(column(doc_id).cast("long"), F.coalesce(column(text), F.lit("")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one of each class left; columns as given."""
    kept = near_classes(docs, text, doc_id).filter(F.col("row") == F.col("best.row")).select(
        F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    keyed = docs.select(nested(docs), _key(text, doc_id).alias("key"), column(doc_id).cast("long").alias("id"))
    same = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    once = Window.partitionBy("key", "id").orderBy("key")
    left = keyed.join(kept, same, "left_semi").withColumn("n", F.row_number().over(once))
    return left.filter("n = 1").select("doc.*")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id (the doc_id that stays), class_size, kept."""
    return near_classes(docs, text, doc_id).select(
        "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))

"""Removal of repeated passages: count-min prefilter, then exact grouping of the windows that may repeat.

A window is ``WIDTH`` consecutive words. Its anchor is the least hash among its runs of ``ANCHOR`` words; equal windows
have equal anchors, and neighbouring windows mostly share theirs, so that anchors are about five times fewer. Each
partition sketches the anchors of its documents (once for each document) as cells of ``DEPTH`` rows, partition
sketches are added block by block, and a window whose anchor stays below two in a row cannot occur in two documents.
Collisions only overestimate: no repeated window is lost. The second pass groups the windows left by 128 bits of
hash, first within each task and then in one shuffle, and removes every word that a window covers which also begins in a
document of a smaller doc_id.

The sketch's width follows the bytes of text up to ``MOST_BITS``, so that what is broadcast (one bit per cell) has a
fixed bound; beyond it more windows go to the second pass and the result stays the same.

Defined cases: null and empty texts have no words; texts of fewer than ``WIDTH`` words keep all; a null doc_id ranks
above every other, and equal doc_ids are not smaller than each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, landed, map_arrow, mix, slices, text_bytes, window_hashes, window_starts, words_of

WIDTH, ANCHOR = 13, 5
DEPTH = 2
#: A cell for each so many bytes of text: about four for each anchor.
BYTES_PER_CELL = 8
LEAST_BITS, MOST_BITS = 20, 29
BLOCK_BITS = 16
#: Anchors that a partition gathers before it gives out a part of its sketch.
GATHERED = 1 << 21
#: Windows that a task compares with each other before they are shuffled.
COMPARED = 1 << 20


def window_anchors(hashes: np.ndarray, first: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """The anchors of the windows that begin at ``first``."""
    least = window_hashes(hashes, anchor)
    span, reach = width - anchor + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reach += step
    return least[first] if len(first) else np.zeros(0, np.uint64)


def cells_of(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchors + np.uint64(0x5851F42D4C957F2D * (row + 1) & (2**64 - 1))) >> np.uint64(64 - bits)


def _sketch_parts(bits: int, width: int, anchor: int):
    block_bits = min(BLOCK_BITS, bits)

    def parts(gathered: list[np.ndarray]) -> pa.RecordBatch:
        anchors = np.concatenate(gathered)
        rows, blocks, cells = [], [], []
        for row in range(DEPTH):
            found, counts = np.unique(cells_of(anchors, row, bits), return_counts=True)
            block = (found >> np.uint64(block_bits)).astype(np.int32)
            inner = ((found & np.uint64((1 << block_bits) - 1)) | (np.uint64(1 << 31) * (counts > 1))).astype("<u4")
            cuts = np.flatnonzero(np.diff(block)) + 1
            for piece, number in zip(np.split(inner, cuts), block[np.concatenate(([0], cuts))]):
                rows.append(row)
                blocks.append(int(number))
                cells.append(piece.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["depth", "block", "cells"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count = [], 0
        for batch in batches:
            flat, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                words = words_of(flat, offsets[a : b + 1])
                first, text = window_starts(words, width)
                if not len(first):
                    continue
                anchors = window_anchors(words.hashes[0], first, width, anchor)
                fresh = np.ones(len(anchors), bool)
                fresh[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                anchors, text = anchors[fresh], text[fresh]
                order = np.lexsort((text, anchors))
                anchors, text = anchors[order], text[order]
                fresh = np.ones(len(anchors), bool)
                fresh[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                gathered.append(anchors[fresh])
                count += len(gathered[-1])
                if count >= GATHERED:
                    yield parts(gathered)
                    gathered, count = [], 0
        if count:
            yield parts(gathered)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, cells in zip(*(batch.column(n).to_pylist() for n in ("depth", "block", "cells"))):
                counts = dense.setdefault((row, block), np.zeros(1 << block_bits, np.uint8))
                values = np.frombuffer(cells, "<u4")
                at = values & np.uint32(0x7FFFFFFF)
                counts[at] = np.minimum(counts[at] + 1 + (values >> np.uint32(31)).astype(np.uint8), 2)
        for (row, block), counts in dense.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())],
                names=["depth", "block", "cells"])

    return sketch, merge


def repeated_cells(texts: DataFrame, bits: int, width: int = WIDTH, anchor: int = ANCHOR) -> np.ndarray:
    """The merged sketch as bits, DEPTH x cells: is a cell's count two or more? Its size is fixed by ``bits``."""
    sketch, merge = _sketch_parts(bits, width, anchor)
    block_bits = min(BLOCK_BITS, bits)
    schema = "depth int, block int, cells binary"
    parts = map_arrow(texts.select("text"), sketch, schema)
    blocks = DEPTH << (bits - block_bits)
    merged = map_arrow(parts.repartition(min(blocks, max(12, blocks // 16)), "depth", "block"), merge, schema)
    result = np.zeros((DEPTH, 1 << (bits - block_bits), (1 << block_bits) // 8), np.uint8)
    for part in merged.toLocalIterator(prefetchPartitions=True):
        result[part["depth"], part["block"]] = np.frombuffer(part["cells"], np.uint8)
    return result.reshape(DEPTH, -1)


_QUESTIONS = "a long, b long, rank long, print long, spots binary"


def _packed(at: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Runs of ``at`` that begin at ``begins``, each as little-endian 32-bit integers."""
    offsets = np.append(begins, len(at)).astype(np.int32) * np.int32(4)
    return pa.Array.from_buffers(
        pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(at.astype("<i4").tobytes())])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before; the first does."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(fresh)


def _questions(sketch, bits: int, width: int, anchor: int):
    """rank, print, text -> the windows that may repeat, as one row for each window and document, with all its places.

    Windows are compared within a task first: of those it holds together, only the ones of least rank are asked about
    (so a window in very many documents leaves a task once). The others are surely repeated; they come out as one row
    per document, with a null ``b``.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        table = sketch.value
        for batch in batches:
            flat, offsets = text_bytes(batch.column("text"))
            ranks, prints = (batch.column(n).to_numpy() for n in ("rank", "print"))
            for p, q in slices(offsets):
                words = words_of(flat, offsets[p : q + 1], lanes=2)
                first, text = window_starts(words, width)
                anchors = window_anchors(words.hashes[0], first, width, anchor)
                maybe = np.ones(len(first), bool)
                for row in range(DEPTH):
                    cell = cells_of(anchors, row, bits)
                    maybe &= (table[row][cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
                first, text = first[maybe], text[maybe]
                a, b = (window_hashes(words.hashes[i], width, i)[first].view(np.int64) for i in (0, 1))
                yield a, b, ranks[p:q][text], prints[p:q][text], (first - words.first[text]).astype(np.int32)

    def settled(gathered: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, rank, print_, at = (np.concatenate(parts) for parts in zip(*gathered))
        order = np.lexsort((print_, rank, b, a))  # stable: places stay in order
        a, b, rank, print_, at = (x[order] for x in (a, b, rank, print_, at))
        begins = _changes(a, b)
        sure = rank > np.repeat(rank[begins], np.diff(np.append(begins, len(a))))
        repeated = np.flatnonzero(sure)
        repeated = repeated[np.lexsort((at[repeated], print_[repeated], rank[repeated]))]
        a, b, asked, asked_print, asked_at = (x[~sure] for x in (a, b, rank, print_, at))
        rank, print_, at = rank[repeated], print_[repeated], at[repeated]
        names = ["a", "b", "rank", "print", "spots"]
        if len(a):
            begins = _changes(a, b, asked, asked_print)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[begins]) for x in (a, b, asked, asked_print)), _packed(asked_at, begins)], names=names)
        if len(rank):
            begins = _changes(rank, print_)
            apart = mix(print_[begins].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(apart), pa.nulls(len(begins), pa.int64()), pa.array(rank[begins]), pa.array(print_[begins]),
                 _packed(at, begins)], names=names)

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count = [], 0
        for found in search(batches):
            if len(found[0]):
                gathered.append(found)
                count += len(found[0])
            if count >= COMPARED:
                for rows in settled(gathered):
                    yield from _sliced(rows)
                gathered, count = [], 0
        if count:
            for rows in settled(gathered):
                yield from _sliced(rows)

    return questions


def _sliced(rows: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for first in range(0, rows.num_rows, most):
        yield rows.slice(first, most)


def _remove(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(text_bytes(batch.column("text"))[1]):
                yield mended(batch.slice(first, last - first))

    def mended(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, shas, texts = [], [], [], []
        for text, spots in zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist()):
            words = left = text.encode().split()
            if spots:
                covered = np.zeros(len(words) + 1, np.int32)
                at = np.frombuffer(b"".join(spots), "<i4")
                np.add.at(covered, at, 1)
                np.add.at(covered, at + width, -1)
                keep = np.cumsum(covered[:-1]) == 0
                left = [w for w, k in zip(words, keep.tolist()) if k]
            joined = b" ".join(left)
            counts.append(len(words))
            removed.append(len(words) - len(left))
            shas.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined.decode() if spots else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
             pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return remove


def remove_repeated(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, anchor: int = ANCHOR, bits: int | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text where words were removed."""
    spark = docs.sparkSession
    given = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    if bits is None:
        size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max((size // BYTES_PER_CELL).bit_length(), LEAST_BITS), MOST_BITS)
    sketch = spark.sparkContext.broadcast(repeated_cells(given, bits, width, anchor))
    # documents are known by rank and print; rows alike in both have the same words removed
    known = given.withColumns({"rank": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "print": F.xxhash64("text")})
    asked = map_arrow(known.select("rank", "print", "text"), _questions(sketch, bits, width, anchor), _QUESTIONS)
    low = F.min("rank").over(Window.partitionBy("a", "b"))
    hits = asked.withColumn("low", low).filter("b is null or rank > low")
    spots = landed(hits.groupBy("rank", "print").agg(F.collect_list("spots").alias("spots")), "window-spots")
    mended = known.join(spots, ["rank", "print"], "left").select("doc_id", "text", "spots")
    return map_arrow(
        mended, _remove(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")

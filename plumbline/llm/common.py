"""Helpers shared by the operators of this subpackage: landed tables, word hashing, batch slicing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: Bytes between words: space and the controls from tab to carriage return.
SPACES = b" \t\n\r\x0b\x0c"
#: Bytes of text that one vectorised step takes at once; a longer text is one step of its own.
CHUNK_BYTES = 1 << 19


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nested(docs: DataFrame) -> Column:
    """All columns in one, ``doc``, so that no name of theirs meets one of an operator's own; "doc.*" gives them back."""
    return F.struct(*map(column, docs.columns)).alias("doc")


def landed(df: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the shared folder and read back, so that lost executors repeat nothing before it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="code-")  # the driver serves the archive from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def least_rows(rows: DataFrame, by: Column, count: int, *ties: str) -> DataFrame:
    """The ``count`` rows of least ``by``; ``ties`` order equal ones.

    The limit is found among the values of ``by`` alone, so that no task holds more rows than are kept of all.
    """
    marked = rows.withColumn("__by", by)
    cut = marked.select("__by").orderBy("__by").limit(count).agg(F.max("__by")).first()[0]
    return marked.filter(F.col("__by") <= F.lit(cut).cast("long")).orderBy("__by", *ties).limit(count).drop("__by")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts as none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return F.size(F.filter(parts, lambda p: p != "")).cast("long")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    large = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]] if len(at) else flat[:0], at.astype(np.int64) - (at[0] if len(at) else 0)


def slices(offsets: np.ndarray, most_rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), rows, first + most_rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))
_BYTE = tuple(mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * lane + 7)) for lane in (1, 2))
_powers: dict[int, np.ndarray] = {}


def powers(multiplier: np.uint64, count: int) -> np.ndarray:
    known = _powers.get(int(multiplier))
    if known is None or len(known) < count:
        size = max(count, 1 << 12)
        known = np.full(size, multiplier, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[int(multiplier)] = known
    return known[:count]


class Words(NamedTuple):
    """The words of some texts: hashes by lane, first and end byte, number by text, and first word by text."""

    hashes: list[np.ndarray]
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    first: np.ndarray


def words_of(flat: np.ndarray, offsets: np.ndarray, lanes: int = 1, lower: bool = False) -> Words:
    """Hash every word of the texts ``flat[offsets[i]:offsets[i + 1]]``."""
    flat = flat[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    rows = len(offsets) - 1
    if lower:
        flat = _LOWER[flat]
    inside = _IS_WORD[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    first = np.searchsorted(starts, offsets[:-1])
    counts = np.diff(np.append(first, len(starts))) if rows else np.zeros(0, np.int64)
    hashes = []
    if len(starts):
        at = np.flatnonzero(inside)
        lengths = ends - starts
        runs = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = at - np.repeat(starts, lengths)
        letters = flat[at]
        for lane in range(lanes):
            values = _BYTE[lane][letters]
            values *= powers(_MULTIPLIER[lane], int(lengths.max()))[within]
            hashes.append(mix(np.add.reduceat(values, runs) + lengths.astype(np.uint64)))
    else:
        hashes = [np.zeros(0, np.uint64) for _ in range(lanes)]
    return Words(hashes, starts, ends, counts, first)


_STEP = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BACK = tuple(np.uint64(pow(int(s), -1, 1 << 64)) for s in _STEP)


def window_hashes(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """The hash of every run of ``width`` consecutive words, over the ends of texts too; the caller drops those."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_STEP[lane], len(hashes)), out=sums[1:])
    spans = sums[width:] - sums[:-width]
    return mix(spans * powers(_BACK[lane], len(spans)))


def window_starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that lie within one text, and their texts."""
    per = np.maximum(words.counts - width + 1, 0)
    text = np.repeat(np.arange(len(per)), per)
    total = int(per.sum())
    begun = np.concatenate(([0], np.cumsum(per)[:-1])) if len(per) else per
    return np.arange(total) - np.repeat(begun, per) + words.first[text], text

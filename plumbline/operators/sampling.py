"""Samples and splits by a hash of each row's lineage: the same rows whatever the partitioning.

Exact sizes need the n-th smallest hash. Two passes over the rows find it, whatever their number: one counts hash
prefixes, the other writes the hashes with the right prefix, a 4,096th of all, and these are narrowed down on their own.
The sample itself is a plain filter: no sort, and no set of rows gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .lineage import LINEAGE, lineage_text
from .tracked import Tracked

_HASH = "__hash"
_TEXT = "__text"
_DIGITS = 3  # hex digits per level: 4,096 counts
_FULL_DIGITS = 32
_FAN = 4096  # different hashes that the driver orders in the end


def row_hash(seed: int) -> Column:
    """md5 of the seed and the lineage, as hex text; its order is the sampling order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), lineage_text(F.col(LINEAGE))))


@dataclass(frozen=True)
class Cut:
    """The first rows in hash order: those in ``head``, and ``copies`` of the equal rows in ``edge``."""

    head: Column
    edge: Column | None = None
    copies: int = 0


def _sizes(hashes: DataFrame, digits: int) -> list[tuple[str, int]]:
    """Rows by prefix in order, at most 4,096 prefixes where the digits before are the same."""
    prefix = F.substring(_HASH, 1, min(digits, _FULL_DIGITS)).alias("prefix")
    counted = hashes.groupBy(prefix).agg(F.sum("count").alias("size")).collect()
    return sorted((r["prefix"], r["size"]) for r in counted)


def _holding(sizes: list[tuple[str, int]], wanted: int) -> tuple[str, int]:
    """The prefix that holds the ``wanted``-th row, and that row's place among those of the prefix."""
    for prefix, size in sizes:
        if wanted <= size:
            break
        wanted -= size
    return prefix, wanted


def find_cut(df: DataFrame, n: int | Callable[[int], int], seed: int) -> Cut:
    """Where the first ``n`` rows in hash order end.

    ``n`` may be a function of the number of rows, which the first counts give for free.
    """
    hashed = df.select(row_hash(seed).alias(_HASH), lineage_text(F.col(LINEAGE)).alias(_TEXT))
    digits = _DIGITS
    sizes = _sizes(hashed.withColumn("count", F.lit(1)), digits)
    rows = sum(size for _, size in sizes)
    wanted = n(rows) if callable(n) else n
    if wanted <= 0:
        return Cut(F.lit(False))
    if wanted >= rows:
        return Cut(F.lit(True))
    prefix, wanted = _holding(sizes, wanted)

    # Equal lineages share a hash, so the boundary lies between distinct (hash, lineage) values, or
    # inside one of them when rows of the same lineage repeat.
    path = fresh_path(df.sparkSession, "hashes")
    hashed.filter(F.col(_HASH).startswith(prefix)).groupBy(_HASH, _TEXT).count().write.parquet(path)
    within = df.sparkSession.read.schema(f"{_HASH} string, {_TEXT} string, count bigint").parquet(path)
    while len(found := within.limit(_FAN + 1).collect()) > _FAN and digits < _FULL_DIGITS:
        digits += _DIGITS
        prefix, wanted = _holding(_sizes(within, digits), wanted)
        within = within.filter(F.col(_HASH).startswith(prefix))
    if len(found) > _FAN:
        raise RuntimeError("too many different lineages share one md5")
    for last in sorted(found, key=lambda r: (r[_HASH], r[_TEXT])):
        if wanted <= last["count"]:
            break
        wanted -= last["count"]

    hash_now, text_now = row_hash(seed), lineage_text(F.col(LINEAGE))
    here = hash_now == F.lit(last[_HASH])
    before = (hash_now < F.lit(last[_HASH])) | (here & (text_now < F.lit(last[_TEXT])))
    edge = here & (text_now == F.lit(last[_TEXT]))
    if wanted == last["count"]:
        return Cut(before | edge)
    return Cut(before, edge, wanted)


def split_at_rank(
    df: DataFrame, n: int | Callable[[int], int], seed: int
) -> tuple[DataFrame, DataFrame]:
    """Split into the first ``n`` rows in hash order and the rest. Both together are all rows."""
    return _apply(df, find_cut(df, n, seed))


def _apply(df: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    if cut.edge is None:
        return df.filter(cut.head), df.filter(~cut.head)
    head, tail = _split_copies(df.filter(cut.edge), cut.copies)
    after = df.filter(~(cut.head | cut.edge))
    return df.filter(cut.head).unionByName(head), after.unionByName(tail)


def _split_copies(df: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Split rows of one lineage after the first ``wanted``, in the order of their values.

    Only a union of branches over the same source repeats a lineage, so the number of different rows
    is at most the number of branches. Copies equal in every column cannot be told apart: they are
    counted here and written out again by ``explode``.
    """
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__copies"))
    head, tail = df.limit(0), df.limit(0)
    for row in sorted(groups.collect(), key=repr):
        first = min(wanted, row["__copies"])
        wanted -= first
        one = df.sparkSession.createDataFrame([row], groups.schema)
        copy = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
        copies = one.select("*", copy).drop("__copies")
        head = head.unionByName(copies.filter(F.col("__copy") <= first).drop("__copy"))
        tail = tail.unionByName(copies.filter(F.col("__copy") > first).drop("__copy"))
    return head, tail


def sample_rows(frame: Tracked, n: int, seed: int = 42) -> Tracked:
    """Exactly ``n`` rows without replacement; an error if there are fewer."""

    def checked(rows: int) -> int:
        if n > rows:
            raise ValueError(f"a sample of {n} rows was asked of {rows}")
        return n

    return frame.with_rows(split_at_rank(frame.df, checked, seed)[0])


def balance_classes(frame: Tracked, is_kept: Column, seed: int = 42) -> Tracked:
    """Keep the rows that satisfy ``is_kept`` and sample equally many of the others."""
    flag = F.coalesce(is_kept, F.lit(False))
    kept, others = frame.filter(flag), frame.filter(~flag)
    return kept.union(sample_rows(others, kept.df.count(), seed))


def random_split(
    frame: Tracked, test_size: float = 0.2, seed: int = 42, exact: bool = True
) -> tuple[Tracked, Tracked]:
    """(train, test). Exact sizes: ``ceil(test_size * n)`` test rows; else a hash threshold, in one pass."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if exact:
        cut = find_cut(frame.df, lambda rows: math.ceil(test_size * rows), seed)
        if cut.edge is not None:
            test, train = _apply(frame.df, cut)
            return frame.with_rows(train), frame.with_rows(test)
        is_test = cut.head
    else:
        is_test = row_hash(seed) < F.lit(f"{int(test_size * 16**8):08x}")
    return frame.branched(~is_test), frame.branched(is_test)


def temporal_split(
    frame: Tracked, column: str, split_date, overlap: bool = False
) -> tuple[Tracked, Tracked]:
    """(train, test): up to the date, and after it. ``overlap`` plants a leak: the date is in both."""
    moment = F.col(column)
    late = moment >= F.lit(split_date) if overlap else moment > F.lit(split_date)
    return frame.branched(moment <= F.lit(split_date)), frame.branched(late)

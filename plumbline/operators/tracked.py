"""DataFrames that carry, for every row, the ids of the source rows it came from."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import add_separator_join
from ..sources.identity import ROW_ID, check_ids, hashed_ids, key_ids
from .lineage import LINEAGE, merge_lineage, origin

_SALT = "__salt"
_join_numbers = itertools.count()


@dataclass(frozen=True)
class JoinRecord:
    """One join: its number, the sources below it, and its (lazy) output, or instead of it the sources of which the
    output really holds rows."""

    number: int
    source_ids: frozenset[int]
    output: DataFrame | None = field(compare=False, repr=False)
    seen: frozenset[int] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Branch:
    """The frame is ``parent`` filtered by ``condition``: splits of one frame can be read in one pass."""

    parent: DataFrame
    condition: Column


@dataclass(frozen=True)
class Tracked:
    """A DataFrame with a lineage column, the sources it reads and the joins it went through.

    Everything is lazy. ``sources`` maps a source id to that source's rows, with their lineage, as they
    were read; a source stays listed even when a later filter drops all rows that stem from it.
    """

    df: DataFrame
    sources: Mapping[int, DataFrame]
    names: Mapping[int, str]
    joins: frozenset[JoinRecord] = frozenset()
    branch: Branch | None = field(default=None, compare=False, repr=False)

    def with_rows(self, df: DataFrame) -> Tracked:
        """The same provenance over other rows."""
        return replace(self, df=df, branch=None)

    def branched(self, condition: Column) -> Tracked:
        rows = self.df.filter(condition)
        return replace(self, df=rows, branch=Branch(self.df, condition))

    @property
    def source_ids(self) -> frozenset[int]:
        return frozenset(self.sources)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != LINEAGE]

    def apply(self, step: Callable[[DataFrame], DataFrame]) -> Tracked:
        """Run a row-wise DataFrame step that leaves the lineage column alone."""
        result = step(self.df)
        if LINEAGE not in result.columns:
            raise ValueError(f"the step dropped the column {LINEAGE!r}")
        return self.with_rows(result)

    # ---- row selection

    def filter(self, condition: Column | str) -> Tracked:
        return self.with_rows(self.df.filter(condition))

    def filter_equal(self, column: str, value) -> Tracked:
        return self.filter(F.col(column) == F.lit(value))

    def filter_in(self, column: str, values: Sequence) -> Tracked:
        return self.filter(F.col(column).isin(list(values)))

    def filter_between(self, column: str, low=None, high=None) -> Tracked:
        """Keep ``low <= column <= high``; either end may be open; nulls and NaN are dropped."""
        result = self
        if self._is_fractional(column) and (low is not None or high is not None):
            result = result.filter(~F.isnan(column))
        if low is not None:
            result = result.filter(F.col(column) >= F.lit(low))
        if high is not None:
            result = result.filter(F.col(column) <= F.lit(high))
        return result

    def exclude(self, column: str, values: Iterable) -> Tracked:
        """Drop the rows that hold one of the values; rows with a null stay."""
        result = self
        for value in values:
            result = result.filter(~F.col(column).eqNullSafe(F.lit(value)))
        return result

    # ---- columns

    def select(self, *columns: str | Column) -> Tracked:
        return self.with_rows(self.df.select(*columns, F.col(LINEAGE)))

    def with_column(self, name: str, value: Column) -> Tracked:
        if name == LINEAGE:
            raise ValueError(f"{LINEAGE!r} is reserved")
        return self.with_rows(self.df.withColumn(name, value))

    def drop(self, *columns: str) -> Tracked:
        return self.with_rows(self.df.drop(*[c for c in columns if c != LINEAGE]))

    def rename(self, mapping: Mapping[str, str]) -> Tracked:
        return self.with_rows(self.df.withColumnsRenamed(dict(mapping)))

    def fill_null(self, columns: Sequence[str], value) -> Tracked:
        """Nulls, and NaN in fractional columns, become ``value``."""
        return self.with_rows(
            self.df.withColumns({
                c: F.coalesce(F.nanvl(c, F.lit(None)) if self._is_fractional(c) else F.col(c), F.lit(value))
                for c in columns
            })
        )

    def _is_fractional(self, column: str) -> bool:
        return isinstance(self.df.schema[column].dataType, (DoubleType, FloatType))

    def concat_text(self, name: str, columns: Sequence[str], separator: str = " ") -> Tracked:
        return self.with_column(name, add_separator_join([F.col(c) for c in columns], separator))

    def scale_column(self, column: str, factor: float) -> Tracked:
        return self.with_column(column, F.col(column) * F.lit(float(factor)))

    # ---- combination

    def join(
        self,
        other: Tracked,
        on: str | Sequence[str] | None = None,
        left_on: str | Sequence[str] | None = None,
        right_on: str | Sequence[str] | None = None,
        null_safe: bool = False,
        suffixes: tuple[str, str] = ("_x", "_y"),
        salt: int | None = None,
        shuffled: bool = False,
    ) -> Tracked:
        """Inner equi-join; a result row's lineage is the union of its two sides'.

        ``on`` keeps one copy of the keys, ``left_on``/``right_on`` keep both. Other columns found on
        both sides get the suffixes. ``null_safe`` also matches null with null. Whether a side is
        broadcast is left to the optimiser, which checks its size. ``salt=n`` splits every key of the
        left side over ``n`` parts and repeats the right side ``n`` times: for a shuffled join whose
        left side has very frequent keys. It is never broadcast, as the optimiser would take the
        repeated side for as small as it was before. ``shuffled`` says that the other side grows
        with the data and is not to be broadcast: the optimiser goes by the size of compressed
        files, which may be a small part of what their rows take in memory.
        """
        shared = on is not None
        left_keys = _names(on if shared else left_on)
        right_keys = _names(on if shared else right_on)
        if not left_keys or len(left_keys) != len(right_keys):
            raise ValueError("give on=, or left_on= and right_on= of the same length")

        kept_once = set(left_keys) if shared else set()
        clashing = (set(self.columns) & set(other.columns)) - kept_once
        left, right = self.df.alias("l"), other.df.alias("r")
        if salt:
            spread = F.pmod(F.xxhash64(F.col(LINEAGE)), F.lit(salt))
            left = self.df.withColumn(_SALT, spread.cast("int")).alias("l")
            copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
            right = other.df.withColumn(_SALT, copies).alias("r")
        if salt or shuffled:
            right = right.hint("merge")

        def col(side: str, name: str) -> Column:
            return F.col(f"{side}.`{name}`")

        condition = F.lit(True)
        for a, b in zip(left_keys, right_keys, strict=True):
            pair = (
                col("l", a).eqNullSafe(col("r", b)) if null_safe else col("l", a) == col("r", b)
            )
            condition = condition & pair
        if salt:
            condition = condition & (col("l", _SALT) == col("r", _SALT))

        outputs = [
            col("l", c).alias(c + suffixes[0] if c in clashing else c) for c in self.columns
        ]
        outputs += [
            col("r", c).alias(c + suffixes[1] if c in clashing else c)
            for c in other.columns
            if c not in kept_once
        ]
        lineage = merge_lineage(
            col("l", LINEAGE), col("r", LINEAGE), self.source_ids, other.source_ids
        )
        joined = left.join(right, condition, "inner").select(*outputs, lineage.alias(LINEAGE))
        _check_sources(self, other)
        record = JoinRecord(next(_join_numbers), self.source_ids | other.source_ids, joined)
        return Tracked(
            joined,
            {**self.sources, **other.sources},
            {**self.names, **other.names},
            self.joins | other.joins | {record},
        )

    def union(self, other: Tracked) -> Tracked:
        """All rows of both frames, columns matched by name."""
        _check_sources(self, other)
        return Tracked(
            self.df.unionByName(other.df),
            {**self.sources, **other.sources},
            {**self.names, **other.names},
            self.joins | other.joins,
        )


def _check_sources(one: Tracked, two: Tracked) -> None:
    """Lineages of two different sources with one id could not be told apart."""
    for source_id in one.source_ids & two.source_ids:
        if one.sources[source_id] is not two.sources[source_id]:
            raise ValueError(f"two different sources have the id {source_id}")


def _names(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def track(
    df: DataFrame,
    source_id: int,
    name: str | None = None,
    key: str | Sequence[str] | None = None,
    check: bool = False,
) -> Tracked:
    """Register a source. ``key`` is a unique integral column, or several columns to be hashed.

    Without a key the frame must come from ``file_position_ids``. ``check`` runs one job and raises if a key is null or
    repeated: rows of one id could not be told apart later on.
    """
    if isinstance(key, str):
        df = key_ids(df, key)
    elif key is not None:
        df = hashed_ids(df, key)
    elif ROW_ID not in df.columns:
        raise ValueError("give key=, or read the source with file_position_ids")
    if check:
        check_ids(df)
    rows = df.withColumn(LINEAGE, origin(source_id, F.col(ROW_ID))).drop(ROW_ID)
    return Tracked(rows, {source_id: rows}, {source_id: name or f"source-{source_id}"})

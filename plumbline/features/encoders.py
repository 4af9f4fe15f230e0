"""Feature encoders: what each must learn from the training rows, and the expression it turns into.

An encoder that learns from plain aggregates lists them in ``aggregates``; one that needs the most frequent value sets
``needs_mode``; one whose positions are the distinct values of a column sets ``is_category``. The feature plan runs one
job for all encoders that stand at the same place of their chains.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hashed_ngrams, normalise_array, number, safe_log


class Encoder:
    #: ``learned`` gets the most frequent value as ``mode``, and ``fractional`` if that is of a fractional column.
    needs_mode = False
    is_array = False
    #: The expression gives ``array<struct<pos,value>>`` within ``entry_width`` positions.
    is_entries = False
    #: The positions are the distinct training values of the column; such an encoder is the last of its chain.
    is_category = False

    def arguments(self) -> dict[str, str]:
        """The settings given by the user, for the run's parameters."""
        return {f.name: _shown(getattr(self, f.name)) for f in fields(self)} if is_dataclass(self) else {}

    def aggregates(self, col: Column) -> dict[str, Column]:
        return {}

    def expression(self, col: Column, learned: Mapping) -> Column:
        raise NotImplementedError


class ImputeMean(Encoder):
    def aggregates(self, col: Column) -> dict[str, Column]:
        return {"mean": F.avg(number(col))}

    def expression(self, col: Column, learned: Mapping) -> Column:
        return F.coalesce(number(col), F.lit(learned["mean"]))


class SafeLog(Encoder):
    def expression(self, col: Column, learned: Mapping) -> Column:
        return safe_log(col)


class StandardScale(Encoder):
    """(x - mean) / population standard deviation; a zero deviation divides by one.

    NaN is left out of both and stays NaN.
    """

    def aggregates(self, col: Column) -> dict[str, Column]:
        x = number(col)
        return {"mean": F.avg(x), "std": F.stddev_pop(x)}

    def expression(self, col: Column, learned: Mapping) -> Column:
        mean, std = learned["mean"], learned["std"]
        return (col.cast("double") - F.lit(mean if mean is not None else 0.0)) / F.lit(std or 1.0)


class ImputeMode(Encoder):
    """The most frequent training value; of equally frequent ones the smallest. NaN is a missing value."""

    needs_mode = True

    def expression(self, col: Column, learned: Mapping) -> Column:
        return F.coalesce(number(col) if learned["fractional"] else col, F.lit(learned["mode"]))


class OneHot(Encoder):
    """A 1 at the position of the value among the training values in sorted order, null last; unseen values give none.

    The positions are a table of their own that is joined to the rows, so there may be as many values as there are
    training rows.
    """

    is_category = True

    def expression(self, col: Column, learned: Mapping) -> Column:
        return col


@dataclass
class HashNgrams(Encoder):
    buckets: int = 100
    low: int = 1
    high: int = 3
    is_entries = True

    @property
    def entry_width(self) -> int:
        return self.buckets

    def expression(self, col: Column, learned: Mapping) -> Column:
        return hashed_ngrams(col, self.buckets, self.low, self.high)


@dataclass
class ArrayFeature(Encoder):
    """A numeric array used as it is, or divided by a constant."""

    divisor: float = 1.0
    is_array = True

    def expression(self, col: Column, learned: Mapping) -> Column:
        return col.cast("array<double>") if self.divisor == 1.0 else normalise_array(col, self.divisor)


@dataclass
class Apply(Encoder):
    """A user's function of the column: a Column expression, or a pandas UDF."""

    function: Callable[[Column], Column]
    is_array: bool = False

    def expression(self, col: Column, learned: Mapping) -> Column:
        return self.function(col)


def _shown(setting) -> str:
    return getattr(setting, "__name__", None) or str(setting)

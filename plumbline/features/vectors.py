"""The two forms of a row's features, and what is read from either.

*Dense* features are an ``array<double>``. *Sparse* ones are ``struct<size, indices, values>`` with ascending indices
and without zeros; plans with one-hot or hashed blocks give these, so that a row costs what it holds and not what the
whole plan is wide.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "struct<pos:int,value:double>"


def is_sparse(df: DataFrame, name: str = "features") -> bool:
    return isinstance(df.schema[name].dataType, StructType)


def sparse(size: Column, entries: Column) -> Column:
    """The sparse form of an ``array<struct<pos,value>>`` that is in order and holds no zeros."""
    return F.struct(size.cast("int").alias("size"), entries["pos"].alias("indices"), entries["value"].alias("values"))


def width(df: DataFrame, name: str = "features") -> Column:
    return F.col(f"{name}.size") if is_sparse(df, name) else F.size(name)


def stored(df: DataFrame, name: str = "features") -> Column:
    """What a row holds as ``array<struct<pos,value>>``: everything of dense features, all but zeros of sparse ones."""
    if is_sparse(df, name):
        pairs = F.arrays_zip(F.col(f"{name}.indices").alias("pos"), F.col(f"{name}.values").alias("value"))
    else:
        pairs = F.transform(name, lambda v, i: F.struct(i.alias("pos"), v.alias("value")))
    return pairs.cast(f"array<{ENTRY}>")


def stored_entries(df: DataFrame, *kept: str | Column, name: str = "features") -> DataFrame:
    """``(kept, pos, value)``, one row for each number that is held. The outer form of ``inline`` spares a filter that
    would compute the features a second time."""
    return df.select(*kept, F.inline_outer(stored(df, name))).filter(F.col("pos").isNotNull())


def dense(df: DataFrame, name: str = "features") -> Column:
    """The features as an array with all zeros, for plans that are narrow enough for that."""
    if not is_sparse(df, name):
        return F.col(name)
    known = F.map_from_arrays(f"{name}.indices", f"{name}.values")
    places = F.when(F.col(f"{name}.size") > 0, F.sequence(F.lit(0), F.col(f"{name}.size") - 1)).otherwise(F.array())
    return F.transform(places.cast("array<int>"), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0.0)))


def vector(df: DataFrame, name: str = "features") -> Column:
    """The features as a vector of pyspark.ml, sparse ones as a sparse vector."""
    return _sparse_vector()(F.col(name)) if is_sparse(df, name) else array_to_vector(F.col(name))


def _sparse_vector():
    @F.arrow_udf(VectorUDT())
    def as_vector(features: pa.Array) -> pa.Array:
        size, indices, values = (features.field(f) for f in ("size", "indices", "values"))
        kind = pa.array([0] * len(features), pa.int8())  # 0 marks a sparse vector
        return pa.StructArray.from_arrays([kind, size, indices, values], names=["type", "size", "indices", "values"])

    return as_vector

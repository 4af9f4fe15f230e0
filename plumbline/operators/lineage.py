"""The lineage column: a sorted, duplicate-free array of (operator_id, row_id) structs."""

from __future__ import annotations

from collections.abc import Set

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINEAGE = "lineage"
LINEAGE_TYPE = "array<struct<operator_id:int,row_id:bigint>>"


def origin(source_id: int, row_id: Column) -> Column:
    """The lineage of a freshly read row."""
    return F.array(
        F.struct(
            F.lit(source_id).cast("int").alias("operator_id"), row_id.cast("bigint").alias("row_id")
        )
    ).cast(LINEAGE_TYPE)


def merge_lineage(left: Column, right: Column, left_ids: Set[int], right_ids: Set[int]) -> Column:
    """Set union of two canonical lineages, itself canonical.

    Sides with different sources share no id, and when all ids of one side come first their plain
    concatenation is sorted already.
    """
    if left_ids and right_ids and not (left_ids & right_ids):
        if max(left_ids) < min(right_ids):
            return F.concat(left, right)
        if max(right_ids) < min(left_ids):
            return F.concat(right, left)
        return F.sort_array(F.concat(left, right))
    return F.sort_array(F.array_union(left, right))


def canonical(lineage: Column) -> Column:
    return F.sort_array(F.array_distinct(lineage.cast(LINEAGE_TYPE)))


def lineage_text(lineage: Column) -> Column:
    """``'0:17,1:4'``; equal for equal lineages."""
    return F.array_join(
        F.transform(lineage, lambda e: F.concat(e["operator_id"], F.lit(":"), e["row_id"])), ","
    )


def row_ids_of(lineage: Column, source_id: int) -> Column:
    """The row ids of one source within a lineage."""
    return F.filter(lineage, lambda e: e["operator_id"] == source_id)["row_id"]


def row_id_of(lineage: Column, source_id: int) -> Column:
    """The single row id of one source, null when the row does not stem from it."""
    return F.get(row_ids_of(lineage, source_id), F.lit(0))


def lineage_entries(df: DataFrame) -> DataFrame:
    """(operator_id, row_id) of every entry of every lineage, repeats included.

    The outer form of ``inline`` spares the optimiser's extra filter on the array's size.
    """
    return df.select(F.inline_outer(LINEAGE)).filter(F.col("operator_id").isNotNull())


def lineage_pairs(df: DataFrame, source_id: int | None = None) -> DataFrame:
    """The distinct (operator_id, row_id) pairs that occur in any row's lineage.

    ``distinct`` combines before the shuffle, so a dimension row found in a third of all lineages
    travels once per task.
    """
    entries = lineage_entries(df)
    if source_id is not None:
        entries = entries.filter(F.col("operator_id") == source_id)
    return entries.distinct()


def with_source_rows(df: DataFrame, source_id: int, name: str) -> DataFrame:
    """One row per row id of the source in each lineage; rows without one are dropped."""
    ids = F.explode_outer(row_ids_of(F.col(LINEAGE), source_id)).alias(name)
    return df.select("*", ids).filter(F.col(name).isNotNull())

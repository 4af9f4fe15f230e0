"""Which source of a star schema holds the entities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import lineage_entries
from ..operators.tracked import JoinRecord


def one_to_one_sources(rows: DataFrame) -> DataFrame:
    """Sources of which no row occurs twice among the lineages, as ``(operator_id)``.

    Counting per (source, row) first combines within each task, also for very frequent rows.
    """
    return (
        lineage_entries(rows)
        .groupBy("operator_id", "row_id")
        .agg(F.count("*").alias("uses"))
        .groupBy("operator_id")
        .agg(F.max("uses").alias("most"))
        .filter(F.col("most") == 1)
        .select("operator_id")
    )


def joined_sources(join: JoinRecord) -> Iterable[int]:
    """The sources of which the join's output really holds rows: as stored, or by one small aggregate."""
    if join.seen is not None:
        return join.seen
    seen = lineage_entries(join.output).select("operator_id").distinct()
    return [r["operator_id"] for r in seen.collect()]


def join_usage(joins: Iterable[JoinRecord], exact: bool = False) -> dict[int, int]:
    """Number of joins each source takes part in.

    This is known from the plan. ``exact`` counts a source only where the join's output really holds
    one of its rows, and runs one small aggregate per join.
    """
    usage: Counter[int] = Counter()
    for join in joins:
        usage.update(joined_sources(join) if exact else join.source_ids)
    return dict(usage)


def source_cardinalities(sources: Mapping[int, DataFrame]) -> dict[int, int]:
    return {i: rows.count() for i, rows in sources.items()}


def _largest(values: Mapping[int, int]) -> set[int]:
    return {i for i, v in values.items() if v == max(values.values())}


def fact_table_id(
    rows: DataFrame, sources: Mapping[int, DataFrame], joins: Iterable[JoinRecord]
) -> int:
    """One-to-one sources first, then the most joined, then the largest, then the first one read.

    A step that would leave nothing is passed over, and each step runs only when still needed.
    """
    if len(sources) == 1:
        return next(iter(sources))
    left = {r["operator_id"] for r in one_to_one_sources(rows).collect()} & set(sources)
    if not left:
        raise ValueError("no source corresponds one to one with the feature rows")
    for step in (lambda: join_usage(joins), lambda: source_cardinalities(sources)):
        if len(left) == 1:
            break
        known = step()
        if known:
            left = (left & _largest(known)) or left
    return min(left)

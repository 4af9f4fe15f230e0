"""A feature plan: chains of encoders per column, fitted on the training rows, applied to any rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, StructField, StructType

from ..functions import bind, number
from ..session import fresh_path, shuffle_partitions
from .encoders import Encoder
from .vectors import ENTRY, sparse


@dataclass(frozen=True)
class FeatureBlock:
    """Columns that go through the same chain of encoders."""

    columns: Sequence[str]
    chain: Sequence[Encoder]


@dataclass(frozen=True)
class Part:
    """The features of one column: their expression, and of what kind it is.

    ``number`` is one position, ``array`` as many as the array is long, ``entries`` and ``category`` are ``width`` wide.
    A category's expression is the value to look up in ``positions(value, position)``.
    """

    column: str
    value: Column
    kind: str
    width: int = 1
    positions: DataFrame | None = None


@dataclass(frozen=True)
class FittedFeatures:
    """The parts in order, and the encoders' learned values by (column, place in chain)."""

    parts: Sequence[Part]
    learned: dict

    @property
    def is_sparse(self) -> bool:
        return any(p.kind in ("entries", "category") for p in self.parts)

    def transform(self, rows: DataFrame, name: str = "features") -> DataFrame:
        """The rows with all their columns and the features; see ``vectors`` for their two forms."""
        joined, found = rows, {}
        for i, part in enumerate(self.parts):
            if part.kind == "category":
                value, known, found[i] = f"__value{i}", f"__known{i}", f"__position{i}"
                table = part.positions.select(F.col("value").alias(known), F.col("position").alias(found[i]))
                joined = joined.withColumn(value, part.value)
                # whether the table is sent to all tasks is left to the optimiser, which knows the size of its files
                joined = joined.join(table, F.col(value).eqNullSafe(F.col(known)), "left")
        features = self._entries(found) if self.is_sparse else self._dense()
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns], features.alias(name))

    def _dense(self) -> Column:
        arrays: list[Column] = []
        for numbers, other in _runs(self.parts):
            arrays.append(F.array(*map(_filled, numbers)) if other is None else other.value)
        return F.concat(*arrays) if len(arrays) > 1 else arrays[0]

    def _entries(self, found: Mapping[int, str]) -> Column:
        """Every part's entries moved to its place; the places of arrays follow their lengths."""
        at, moved, lists = F.lit(0), 0, []
        place = 0
        for numbers, other in _runs(self.parts):
            start = at + F.lit(moved)
            if other is None:
                lists.append(F.array(*[_entry(start + F.lit(k), _filled(p)) for k, p in enumerate(numbers)]))
                moved += len(numbers)
                place += len(numbers)
                continue
            if other.kind == "array":
                lists.append(_listed(other.value, start))
                at = at + F.size(other.value)
            elif other.kind == "entries":
                lists.append(_moved(other.value, start))
                moved += other.width
            else:
                position = F.col(found[place])
                one = F.array(_entry(start + position, F.lit(1.0)))
                lists.append(F.when(position.isNotNull(), one).otherwise(F.array().cast(f"array<{ENTRY}>")))
                moved += other.width
            place += 1
        entries = F.filter(F.concat(*[x.cast(f"array<{ENTRY}>") for x in lists]), lambda e: e["value"] != 0)
        return bind(entries, lambda e: sparse(at + F.lit(moved), e))


def _entry(pos: Column, value: Column) -> Column:
    return F.struct(pos.alias("pos"), value.alias("value"))


def _listed(array: Column, start: Column) -> Column:
    return F.transform(array, lambda v, i: _entry(start + i, v))


def _moved(entries: Column, start: Column) -> Column:
    return F.transform(entries, lambda e: _entry(start + e["pos"], e["value"]))


def _filled(part: Part) -> Column:
    """A missing number becomes NaN."""
    return F.coalesce(part.value.cast("double"), F.lit(float("nan")))


def _runs(parts: Sequence[Part]):
    """Runs of neighbouring numbers, and the other parts one by one: ``(numbers, None)`` or ``([], part)``."""
    numbers: list[Part] = []
    for part in parts:
        if part.kind == "number":
            numbers.append(part)
            continue
        if numbers:
            yield numbers, None
            numbers = []
        yield [], part
    if numbers:
        yield numbers, None


@dataclass(frozen=True)
class FeaturePlan:
    """Blocks are laid out one after the other; columns named in no block are left out."""

    blocks: Sequence[FeatureBlock]

    def __post_init__(self):
        for block in self.blocks:
            if any(e.is_category or e.is_entries for e in list(block.chain)[:-1]):
                raise ValueError("one-hot and hashed encoders stand at the end of their chains")

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for b in self.blocks for c in b.columns))

    def described(self) -> list[tuple[str, dict[str, str]]]:
        """(type, arguments) of every encoder in order, with the columns it works on."""
        return [
            (type(encoder).__name__, {"columns": ",".join(b.columns), **encoder.arguments()})
            for b in self.blocks
            for encoder in b.chain
        ]

    def fit(self, train: DataFrame) -> FittedFeatures:
        """Learn from the training rows: at each place in the chains one job for all aggregates and one for all most
        frequent values, which bring one row each to the driver, and in the end one table of all categories."""
        chains = [(c, list(b.chain)) for b in self.blocks for c in b.columns]
        current: list[Column] = [F.col(f"`{c}`") for c, _ in chains]
        learned: dict = {}
        for place in range(max((len(chain) for _, chain in chains), default=0)):
            active = [i for i, (_, chain) in enumerate(chains) if place < len(chain)]
            wanted = {
                f"{i}.{name}": agg
                for i in active
                for name, agg in chains[i][1][place].aggregates(current[i]).items()
            }
            row = (
                train.agg(*[agg.alias(key) for key, agg in wanted.items()]).first() if wanted else {}
            )
            modes = most_frequent(train, {i: current[i] for i in active if chains[i][1][place].needs_mode})
            for i in active:
                column, chain = chains[i]
                encoder = chain[place]
                values = modes.get(i) or {
                    key.split(".", 1)[1]: row[key] for key in wanted if key.startswith(f"{i}.")
                }
                learned[(column, place)] = values
                current[i] = encoder.expression(current[i], values)
        categories = {i: current[i] for i, (_, chain) in enumerate(chains) if chain and chain[-1].is_category}
        tables = category_positions(train, categories)
        parts = []
        for i, (column, chain) in enumerate(chains):
            last = chain[-1] if chain else Encoder()
            if last.is_category:
                parts.append(Part(column, current[i], "category", *tables[i]))
            elif last.is_entries:
                parts.append(Part(column, current[i], "entries", last.entry_width))
            else:
                parts.append(Part(column, current[i], "array" if last.is_array else "number"))
        return FittedFeatures(parts, learned)


def _by_column(rows: DataFrame, columns: Mapping[int, Column]) -> tuple[DataFrame, dict[int, str], dict[int, int]]:
    """``(set, names, n)``, the distinct values of each column with their counts, all counted in one pass by grouping
    sets. The set number tells the columns apart, also where their values are null."""
    names = {i: f"c{i}" for i in columns}
    keys = list(names.values())
    chosen = rows.select(*[col.alias(names[i]) for i, col in columns.items()])
    counted = chosen.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("set"))
    set_of = {
        i: sum(1 << (len(keys) - 1 - at) for at in range(len(keys)) if at != place) for place, i in enumerate(names)
    }
    return counted, names, set_of


def most_frequent(rows: DataFrame, columns: Mapping[int, Column]) -> dict[int, dict]:
    """The most frequent value of each column, the smallest of equally frequent ones, null without any."""
    if not columns:
        return {}
    kinds = rows.select(*[col.alias(f"c{i}") for i, col in columns.items()]).schema
    fractional = {i: isinstance(kinds[f"c{i}"].dataType, (DoubleType, FloatType)) for i in columns}
    counted, names, set_of = _by_column(rows, {i: number(c) if fractional[i] else c for i, c in columns.items()})
    best = counted.agg(
        *[
            F.min(
                F.when(
                    (F.col("set") == set_of[i]) & F.col(name).isNotNull(),
                    F.struct((-F.col("n")).alias("n"), F.col(name).alias("value")),
                )
            ).alias(name)
            for i, name in names.items()
        ]
    ).first()
    return {
        i: {"mode": None if best[name] is None else best[name]["value"], "fractional": fractional[i]}
        for i, name in names.items()
    }


def category_positions(rows: DataFrame, columns: Mapping[int, Column]) -> dict[int, tuple[int, DataFrame]]:
    """For each column the number of its distinct values and a table ``(value, position)`` in sorted order, null last.

    The values are ranked by ranges, in no single task, and written once to the shared folder, where their tables have
    a known size; nothing but the numbers of values comes to the driver.
    """
    if not columns:
        return {}
    spark = rows.sparkSession
    counted, names, set_of = _by_column(rows, columns)
    keys = list(names.values())
    missing = F.coalesce(*[F.when(F.col("set") == set_of[i], F.col(name).isNull()) for i, name in names.items()])
    values = counted.select("set", missing.alias("missing"), *keys)
    ranges = values.repartitionByRange(shuffle_partitions(spark), "set", "missing", *keys)
    ranges = ranges.withColumn("part", F.spark_partition_id())
    path = fresh_path(spark, "category-values")
    ranges.write.parquet(path)  # the numbers of the ranges belong to one execution
    ranges = spark.read.schema(ranges.schema).parquet(path)
    # one row for each column and shuffle partition at most
    before: dict[int, int] = {}
    starts = []
    for r in sorted(ranges.groupBy("set", "part").count().collect(), key=lambda r: (r["set"], r["part"])):
        starts.append((r["set"], r["part"], before.get(r["set"], 0)))
        before[r["set"]] = before.get(r["set"], 0) + r["count"]
    columns_of = list(zip(*starts)) or [(), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int64())
    firsts = spark.createDataFrame(
        pa.table({n: pa.array(c, k) for n, c, k in zip(("set", "part", "first"), columns_of, kinds)})
    )
    here = Window.partitionBy("set", "part").orderBy("missing", *keys)
    placed = ranges.join(firsts, ["set", "part"]).select(
        "set", *keys, (F.col("first") + F.row_number().over(here) - 1).cast("int").alias("position")
    )
    path = fresh_path(spark, "categories")
    placed.write.partitionBy("set").parquet(path)
    tables = {}
    for i, name in names.items():
        kind = StructType([StructField(name, counted.schema[name].dataType), StructField("position", IntegerType())])
        size = before.get(set_of[i], 0)
        table = spark.read.schema(kind).parquet(f"{path}/set={set_of[i]}") if size else spark.createDataFrame([], kind)
        tables[i] = (size, table.withColumnRenamed(name, "value"))
    return tables

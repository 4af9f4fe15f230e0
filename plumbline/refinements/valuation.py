"""Exact Shapley values of training rows for a k-nearest-neighbour classifier.

For one test row let the training rows be ranked by distance, j = 1..N, with e_j = 1 where the labels
agree. With w_j = min(j, K) / (j K) for j < N and w_N = 1 / N, the value of the row at rank i is

    e_i w_i + sum over j > i of e_j (w_j - w_(j-1)),

which needs only the row's own rank and a running sum from the far end. Both are put together from ranges of distances,
whose boundaries come from a quantile sketch for each test row, so that no test row's N distances have to fit into one
task. Of a distance that very many training rows share, the ranges go on by row key.

Distances are computed between slots of training rows and blocks of test rows. Both are of bounded size and meet by an
ordinary shuffle, so the test sample may be as large as one likes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..features.vectors import is_sparse, width
from ..operators.lineage import LINEAGE, row_id_of, with_source_rows
from ..operators.ranking import before_in
from ..session import fresh_path, ship, shuffle_partitions
from .base import Refinement

#: Training rows of a slot and test rows of a block at most; dense rows of both are also bounded by their numbers.
SLOT, BLOCK = 4096, 256
CELLS = 1 << 22


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


class DenseRows:
    """Rows of equal width."""

    def __init__(self, column: pa.ChunkedArray):
        self.x = _numbers(column).reshape(len(column), -1) if len(column) else np.zeros((0, 0))

    def distances(self, others: DenseRows) -> np.ndarray:
        out = np.empty((len(self.x), len(others.x)))
        if not len(self.x):  # no key fell into the slot
            return out
        for j, row in enumerate(others.x):
            out[:, j] = np.sqrt(((self.x - row) ** 2).sum(axis=1))
        return out


class SparseRows:
    """Rows of which only the numbers other than zero are held, one after the other."""

    def __init__(self, column: pa.ChunkedArray):
        table = column.combine_chunks()
        sizes = table.field("indices").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        self.places = table.field("indices").flatten().to_numpy(zero_copy_only=False)
        self.values = table.field("values").flatten().to_numpy(zero_copy_only=False)

    def part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, places and values of some rows."""
        low, high = self.ends[first], self.ends[last]
        rows = np.repeat(np.arange(last - first), np.diff(self.ends[first : last + 1]))
        return rows, self.places[low:high], self.values[low:high]

    def distances(self, others: SparseRows) -> np.ndarray:
        n, m = len(self.ends) - 1, len(others.ends) - 1
        out = np.empty((n, m))
        for j in range(m):
            _, places, values = others.part(j, j + 1)
            first = 0
            while first < n:
                # as many rows as fit, given that every number may stand at a place of its own
                last = first + 1
                while last < n and (last + 1 - first) * (self.ends[last + 1] - self.ends[first] + len(places)) <= CELLS:
                    last += 1
                rows, here, x = self.part(first, last)
                active = np.unique(np.concatenate([here, places]))
                gap = np.zeros((last - first, len(active)))
                gap[rows, np.searchsorted(active, here)] = x
                gap[:, np.searchsorted(active, places)] -= values
                # one after the other: places where both are zero then change no sum, and ties stay ties
                out[first:last, j] = np.sqrt(np.cumsum(gap**2, axis=1)[:, -1]) if len(active) else 0.0
                first = last
        return out


_SKETCHED = "test int, dist double"
_PLACED = "test int, bucket int, sub int, dist double, key long, label double, hit double"


def _meeting(train: DataFrame, sample: DataFrame, slots: int, blocks: int, meet: Callable, schema: str) -> DataFrame:
    """``meet(training rows, test rows)`` for every slot and block."""
    kind = SparseRows if is_sparse(train) else DenseRows
    ship(train.sparkSession)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(kind, left, right)

    slot = F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot")
    rows = train.select("key", "label", "features", slot, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    tests = sample.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return rows.groupBy("slot", "block").cogroup(tests.groupBy("slot", "block")).applyInArrow(together, schema)


def _sketched(kind, left: pa.Table, right: pa.Table) -> pa.Table:
    dist = kind(left["features"]).distances(kind(right["features"]))
    tests = right["test"].to_numpy()
    return pa.table({"test": pa.array(np.tile(tests, len(dist)), pa.int32()), "dist": dist.ravel()})


def _placed(kind, left: pa.Table, right: pa.Table) -> pa.Table:
    """Distances with their ranges: bucket 2 i holds what lies above i boundaries, bucket 2 i + 1 a frequent boundary."""
    dist = kind(left["features"]).distances(kind(right["features"]))
    keys, labels = left["key"].to_numpy(), left["label"].to_numpy(zero_copy_only=False)
    tests, test_labels = right["test"].to_numpy(), right["label"].to_numpy(zero_copy_only=False)
    buckets, subs = np.zeros(dist.shape, np.int32), np.zeros(dist.shape, np.int32)
    for j in range(len(tests)):
        ends = np.array(right["ends"][j].as_py() or [], np.float64)
        known, times = np.unique(ends, return_counts=True)
        place = np.searchsorted(known, dist[:, j])
        buckets[:, j] = 2 * place
        frequent = np.isin(dist[:, j], known[times > 1])
        buckets[frequent, j] += 1
        subs[frequent, j] = np.searchsorted(np.unique(right["key_ends"][j].as_py() or []), keys[frequent])
    n, m = dist.shape
    label = np.repeat(labels, m)
    return pa.table({
        "test": pa.array(np.tile(tests, n), pa.int32()), "bucket": buckets.ravel(), "sub": subs.ravel(), "dist": dist.ravel(),
        "key": pa.array(np.repeat(keys, m), pa.int64()), "label": pa.array(label, pa.float64(), from_pandas=True),
        "hit": (label == np.tile(test_labels, n)).astype(np.float64)})


def _landed(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def knn_shapley(train: DataFrame, sample: DataFrame, k: int = 1, slot: int = SLOT, block: int = BLOCK) -> DataFrame:
    """``(key, shapley_value)`` from ``train(key, features, label)`` and ``sample(test, features, label)``, where ``test``
    numbers the rows from 0.

    Equal distances are ordered by key, then label. A key that several rows share gets their sum. ``slot`` and ``block``
    change the work of a task, not the result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    size = sample.agg(F.count("*").alias("n"), F.max(width(sample)).alias("width")).first()
    if not size["n"]:
        raise ValueError("the test sample is empty")
    if not is_sparse(train):
        slot, block = (max(1, min(x, CELLS // max(size["width"], 1))) for x in (slot, block))
    ranges = -(-2 * shuffle_partitions(train.sparkSession) // size["n"])
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    keys = train.agg(F.count("*").alias("n"), F.percentile_approx("key", shares).alias("ends")).first()
    slots, blocks = max(1, -(-keys["n"] // slot)), -(-size["n"] // block)

    tests = sample.withColumn("block", (F.col("test") / block).cast("int"))
    ends = (
        _meeting(train, tests, slots, blocks, _sketched, _SKETCHED)
        .groupBy("test")
        .agg(F.percentile_approx("dist", shares).alias("ends"))
    )
    # at most two boundaries for each shuffle partition, or one for each test row
    tests = tests.join(_landed(ends, "distance-ranges"), "test", "left")
    tests = tests.withColumn("key_ends", F.array(*map(F.lit, keys["ends"] or [])).cast("array<bigint>"))
    pairs = _meeting(train, tests, slots, blocks, _placed, _PLACED)

    on = ["test", "bucket", "sub"]
    sizes = pairs.groupBy(*on).agg(F.count("*").alias("size"))
    place = W.partitionBy("test").orderBy("bucket", "sub")
    sizes = sizes.select(
        *on,
        F.coalesce(F.sum("size").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("size").over(W.partitionBy("test")).alias("total"),
    )
    order = [F.col("dist"), F.col("key"), F.col("label")]
    ranked = pairs.join(sizes, on).withColumn(
        "rank", F.col("before") + F.row_number().over(W.partitionBy(*on).orderBy(*order))
    )
    weight, weight_before = _weight(F.col("rank"), k), _weight(F.col("rank") - 1, k)
    step = F.when(F.col("rank") > 1, F.col("hit") * (weight - weight_before)).otherwise(0.0)
    ranked = ranked.withColumn("step", step)
    farther = before_in(F.struct("bucket", "sub").desc(), ["test"])
    later = (
        ranked.groupBy(*on)
        .agg(F.sum("step").alias("step"))
        .select(*on, F.coalesce(F.sum("step").over(farther), F.lit(0.0)).alias("later"))
    )
    behind = W.partitionBy(*on).orderBy(*[c.desc() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    value = F.col("hit") * weight + F.col("within") + F.col("later")
    return (
        ranked.withColumn("within", F.coalesce(F.sum("step").over(behind), F.lit(0.0)))
        .join(later, on)
        .groupBy("key")
        .agg((F.sum(value) / size["n"]).alias("shapley_value"))
    )


def _weight(rank: Column, k: int) -> Column:
    inner = F.least(rank, F.lit(k)) / (rank * F.lit(k))
    return F.when(rank == F.col("total"), 1.0 / F.col("total")).otherwise(inner)


def value_source_rows(
    source_rows: DataFrame, source_id: int, values: DataFrame, name: str = "shapley_value"
) -> DataFrame:
    """The source's rows plus their value, 0.0 where a row was not used. Keys are unique on both sides."""
    keyed = values.select(F.col("key").alias("__key"), F.col("shapley_value").alias(name))
    return (
        source_rows.join(keyed, row_id_of(F.col(LINEAGE), source_id) == F.col("__key"), "left")
        .withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
        .drop("__key")
    )


class DataValuation(Refinement):
    """The entity table of the training side with a Shapley value per row.

    The test sample is the first rows of X_test in lineage order.
    """

    def __init__(self, k: int = 1, num_test_samples: int = 10):
        self.k = k
        self.num_test_samples = num_test_samples

    def values(self, pipeline) -> DataFrame:
        fact = pipeline.fact_id("train")
        first = pipeline.split("test").select(LINEAGE, "features", "label").orderBy(LINEAGE).limit(self.num_test_samples)
        number = (F.row_number().over(W.orderBy(LINEAGE)) - 1).alias("test")  # of the sample only
        sample = _landed(first.select(number, "features", "label"), "test-sample")
        train = with_source_rows(pipeline.split("train"), fact, "key").select("key", "features", "label")
        return knn_shapley(train, sample, self.k)

    def compute(self, pipeline, run=None):
        source = pipeline.fact_source("train")
        rows = value_source_rows(source.rows, source.source_id, self.values(pipeline))
        refined = replace(source, rows=rows)
        if run is not None:
            run.set_tags(
                {
                    "data_valuation.operator_id": source.source_id,
                    "data_valuation.k": self.k,
                    "data_valuation.num_test_samples": self.num_test_samples,
                    "data_valuation.data_file": "input-with-shapley-values",
                }
            )
            run.write_table(refined.data, "input-with-shapley-values")
        return refined

"""The fit of a dense network over rows that are kept packed; what pyspark.ml's multilayer perceptron computes, with the sums
over the rows taken by numpy's matrix products in the tasks.

The first weights, the objective (the mean over blocks of rows of each block's mean loss), the optimiser and the model are
those of ``MultilayerPerceptronClassifier``. Every row takes part in every evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..features import is_sparse
from ..session import ship
from .lbfgs import minimize

MODEL = "org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel"
ROWS = 384  # go through the matrix products at once
TASK = 1 << 17  # rows of a task, about; tasks come in multiples of the cores
CELLS = 1 << 22  # numbers that rows take at most while they are spread out
PIECE = 1 << 13  # sums that are added up together

PACKED = "width int, counts binary, places binary, numbers binary, labels binary"
_SUMS = "piece int, part int, sums binary"
_TOTALS = "piece int, sums binary"


def fit_perceptron(
    learner: MultilayerPerceptronClassifier, hidden: Sequence[int], classes: int, train: DataFrame, vectors: DataFrame
) -> MultilayerPerceptronClassificationModel:
    """What ``learner.fit(vectors)`` gives with layers from the features' width through ``hidden`` to ``classes``. ``train``
    has the same rows with ``features`` and ``label``."""
    ship(train.sparkSession)
    packed = pack(train, classes, learner.getBlockSize(), train.count()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        layers = [_width(packed), *hidden, classes]
        learner.setLayers(layers)
        weights, history = minimize(
            lambda w: objective(packed, layers, w),
            first_weights(learner, vectors.sparkSession),
            learner.getMaxIter(),
            learner.getTol(),
        )
    finally:
        packed.unpersist()
    vector = _py2java(vectors.sparkSession.sparkContext, Vectors.dense(weights))
    java = learner._new_java_obj(MODEL, learner.uid, vector)
    model = learner._copyValues(learner._create_model(java))
    model._transfer_params_to_java()
    gateway = vectors.sparkSession.sparkContext._gateway
    java.createSummary(vectors._jdf, learner._new_java_array(history, gateway.jvm.double))
    return model


def first_weights(learner: MultilayerPerceptronClassifier, spark) -> np.ndarray:
    """The learner's random weights: what it gives without any iteration."""
    empty = Vectors.sparse(learner.getLayers()[0], [])
    two = spark.createDataFrame([(empty, 0.0), (empty, 1.0)], [learner.getFeaturesCol(), learner.getLabelCol()])
    return learner.copy({learner.maxIter: 0}).fit(two).weights.toArray()


def _width(packed: DataFrame) -> int | None:
    least, most = packed.agg(F.min("width"), F.max("width")).first()
    if least != most:
        raise ValueError(f"features are {least} to {most} wide")
    return most


def pack(train: DataFrame, classes: int, block: int, count: int) -> DataFrame:
    """One row for each block of rows that are neighbours in a partition, evenly dealt to the tasks.

    A block holds the features' width, how many numbers each row has, their places (none for rows without gaps), the numbers
    and the labels.
    """
    sparse = is_sparse(train)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            whole = rows.num_rows // block * block
            if whole:
                yield _blocks(rows.slice(0, whole), classes, block, sparse)
            rest = rows.slice(whole)
        if rest is not None and rest.num_rows:
            yield _blocks(rest, classes, block, sparse)

    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-count // (TASK * cores))) * cores
    return train.select("features", "label").mapInArrow(packed, PACKED).repartition(tasks)


def _blocks(rows: pa.RecordBatch, classes: int, block: int, sparse: bool) -> pa.RecordBatch:
    features, label = rows.column("features"), rows.column("label")
    if features.null_count:
        raise ValueError("features must not be null")
    if label.null_count:
        raise ValueError("labels must not be null")
    labels = label.to_numpy(zero_copy_only=False)
    if not np.isin(labels, np.arange(classes)).all():
        raise ValueError(f"labels must be whole numbers below {classes}")
    held = features.field("values") if sparse else features
    counts = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    numbers = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(numbers).all():
        raise ValueError("features must not hold NaN or infinity")
    if sparse:
        sizes = features.field("size").to_numpy(zero_copy_only=False)
        places = features.field("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    else:
        sizes, places = counts, np.empty(0, np.int32)
    if (sizes != sizes[0]).any():
        raise ValueError("features must be of one width")
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    columns: list[list[bytes]] = [[], [], [], []]
    for first in range(0, len(labels), block):
        last = min(first + block, len(labels))
        low, high = ends[first], ends[last]
        parts = counts[first:last], places[low:high], numbers[low:high], labels[first:last].astype(np.int32)
        for column, part in zip(columns, parts):
            column.append(part.tobytes())
    names = [c.split()[0] for c in PACKED.split(", ")]
    width = pa.array([sizes[0]] * len(columns[0]), pa.int32())
    return pa.RecordBatch.from_arrays([width, *(pa.array(c, pa.binary()) for c in columns)], names=names)


def objective(packed: DataFrame, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss and its gradient. Tasks send one vector each, which is added up piece by piece, in the order of the tasks;
    the driver gets one."""
    sent = packed.sparkSession.sparkContext.broadcast(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = None
        for batch in batches:
            network = network or Network(layers, sent.value)
            network.add(batch)
        if network:
            yield _pieces(network.sums(), TaskContext.get().partitionId())

    def totals(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("part")
        total = 0.0
        for one in pieces.column("sums"):
            total = total + np.frombuffer(one.as_buffer())
        return pa.table({"piece": pieces.column("piece").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    try:
        found = packed.mapInArrow(sums, _SUMS).groupBy("piece").applyInArrow(totals, _TOTALS).collect()
    finally:
        sent.destroy()
    total = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["piece"])])
    loss, blocks = total[-2:]
    return float(loss / blocks), total[:-2] / blocks


def _pieces(sums: np.ndarray, part: int) -> pa.RecordBatch:
    parts = [sums[i : i + PIECE].tobytes() for i in range(0, len(sums), PIECE)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array(parts, pa.binary())],
        names=["piece", "part", "sums"],
    )


class Network:
    """Sigmoid layers and a softmax on top, and the sums over the blocks added so far.

    A layer's weights are a matrix with one line for each input and one for the bias, as pyspark.ml lays them out. Matrices of
    rows have a column for each row and a last line of ones; they are written over at every step.
    """

    def __init__(self, layers: Sequence[int], weights: np.ndarray):
        shapes = [(i + 1, o) for i, o in zip(layers, layers[1:])]
        ends = np.cumsum([i * o for i, o in shapes])
        self.matrices = [weights[e - i * o : e].reshape(i, o) for e, (i, o) in zip(ends, shapes)]
        # the sigmoid takes the exponential of the negative
        self.forward = [np.ascontiguousarray(-m.T) for m in self.matrices[:-1]]
        self.step = max(1, min(ROWS, CELLS // (max(layers) + 1)))
        self.rows = np.zeros((self.step, layers[0] + 1))
        self.values = [self.rows.T, *(np.ones((o + 1, self.step)) for o in layers[1:-1])]
        self.deltas = [np.empty((o, self.step)) for o in layers[1:-1]]
        self.products = [np.empty((o, i)) for i, o in shapes]
        self.gradients = [np.zeros((o, i)) for i, o in shapes]
        self.classes = np.arange(layers[-1])[:, None]
        self.loss, self.blocks = 0.0, 0

    def sums(self) -> np.ndarray:
        """The gradient, the loss and the number of blocks."""
        return np.concatenate([*(g.T.ravel() for g in self.gradients), [self.loss, self.blocks]])

    def add(self, batch: pa.RecordBatch) -> None:
        """Some blocks, in steps of equal size; what the last one lacks are rows of no weight."""
        counts, places, numbers, labels = (
            np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
            for name, kind in (("counts", np.int32), ("places", np.int32), ("numbers", np.float64), ("labels", np.int32))
        )
        sizes = np.array([len(c) for c in batch.column("labels").to_pylist()]) // labels.itemsize
        shares = np.repeat(1.0 / sizes, sizes)
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        for first in range(0, len(labels), self.step):
            last = min(first + self.step, len(labels))
            n, low, high = last - first, ends[first], ends[last]
            self.rows[:] = 0.0
            self.rows[:, -1] = 1.0
            if len(places):
                self.rows[np.repeat(np.arange(n), counts[first:last]), places[low:high]] = numbers[low:high]
            elif len(numbers):
                self.rows[:n, :-1] = numbers[low:high].reshape(n, -1)
            target, share = np.zeros(self.step, np.int64), np.zeros(self.step)
            target[:n], share[:n] = labels[first:last], shares[first:last]
            self._step(target, share)
        self.blocks += batch.num_rows

    def _step(self, target: np.ndarray, share: np.ndarray) -> None:
        values = self.values
        for k, matrix in enumerate(self.forward):
            value = values[k + 1][:-1]
            np.matmul(matrix, values[k], out=value)
            with np.errstate(over="ignore"):
                np.exp(value, out=value)
            value += 1.0
            np.reciprocal(value, out=value)
        top = self.matrices[-1].T @ values[-1]
        top -= top.max(axis=0)
        delta = np.exp(top)
        whole = delta.sum(axis=0)
        hit = self.classes == target
        top *= hit
        self.loss += float(share @ (np.log(whole) - top.sum(axis=0)))
        delta /= whole
        delta -= hit
        delta *= share
        for k in range(len(self.matrices) - 1, -1, -1):
            self.gradients[k] += np.matmul(delta, values[k].T, out=self.products[k])
            if k:
                value, below = values[k][:-1], self.deltas[k - 1]
                np.matmul(self.matrices[k][:-1], delta, out=below)
                below *= value
                np.subtract(1.0, value, out=value)
                below *= value
                delta = below

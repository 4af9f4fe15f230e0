"""The network's fit: the learner's own objective and steps, with the sums over the rows taken in numpy."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from plumbline.plans import fit_network, predict
from plumbline.plans.lbfgs import minimize
from plumbline.plans.models import with_vector
from plumbline.plans.network import Network, _blocks, objective, pack

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def rows_of(spark, n, partitions, sparse=False):
    """Two numbers and a category of three, and a label that depends on them."""
    rows = spark.range(0, n, 1, partitions)
    a, b = (F.rand(seed) * 2 - 1 for seed in (1, 2))
    rows = rows.select(a.alias("a"), b.alias("b"), (F.col("id") % 3).cast("int").alias("c"))
    label = (F.col("a") > F.col("b") * (F.col("c") - 1)).cast("double").alias("label")
    if sparse:
        features = F.struct(
            F.lit(5).alias("size"),
            F.array(F.lit(0), F.lit(1), F.col("c") + 2).alias("indices"),
            F.array("a", "b", F.lit(1.0)).alias("values"),
        ).cast(SPARSE)
    else:
        features = F.array("a", "b", *[(F.col("c") == i).cast("double") for i in range(3)])
    return rows.select(features.alias("features"), label)


def learner_of(layers, max_iter):
    return MultilayerPerceptronClassifier(
        featuresCol="__vector", labelCol="label", layers=layers, maxIter=max_iter, seed=42
    )


@pytest.mark.parametrize("sparse", [False, True])
def test_same_steps_as_the_learner(spark, sparse, tmp_path):
    # 7 partitions of 143 rows leave blocks of different sizes, which weigh the same
    train = rows_of(spark, 1001, 7, sparse).cache()
    theirs = learner_of([5, 8, 4, 2], 15).fit(with_vector(train))
    ours = fit_network(train, (8, 4), max_iter=15)
    assert ours.getLayers() == [5, 8, 4, 2] and ours.getMaxIter() == 15
    history = theirs.summary().objectiveHistory
    assert len(history) == 16 and history[-1] < history[0] - 0.05
    assert np.allclose(ours.summary().objectiveHistory, history, rtol=1e-8)
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-4, atol=1e-5)
    both = [[r["prediction"] for r in predict(m, train).collect()] for m in (ours, theirs)]
    assert both[0] == both[1] and set(both[0]) == {0.0, 1.0}
    ours.save(str(tmp_path / "model"))
    loaded = MultilayerPerceptronClassificationModel.load(str(tmp_path / "model"))
    assert (loaded.weights.toArray() == ours.weights.toArray()).all()
    train.unpersist()


def test_rows_of_one_partition_are_dealt_to_all_tasks(spark):
    train = rows_of(spark, 20000, 1)
    cores = spark.sparkContext.defaultParallelism
    packed = pack(train, 2, 128, 20000)
    sizes = [r["n"] for r in packed.groupBy(F.spark_partition_id()).agg(F.sum(F.length("labels") / 4).alias("n")).collect()]
    assert sum(sizes) == 20000 and len(sizes) == cores
    assert max(sizes) - min(sizes) <= 256


def test_fit_is_faster_than_the_learner_over_rows_of_one_partition(spark):
    train = rows_of(spark, 60000, 1).cache()
    train.count()
    fit_network(train.limit(500), max_iter=1)
    start = time.perf_counter()
    fit_network(train, max_iter=3)
    between = time.perf_counter()
    learner_of([5, 256, 64, 2], 3).fit(with_vector(train))
    assert between - start < (time.perf_counter() - between) / 1.5
    train.unpersist()


def test_gradient_agrees_with_differences(spark):
    layers = [5, 4, 3, 2]
    count = sum((i + 1) * o for i, o in zip(layers, layers[1:]))
    weights = np.random.default_rng(3).normal(size=count)
    packed = pack(rows_of(spark, 500, 3, True), 2, 128, 500).cache()
    _, grad = objective(packed, layers, weights)
    for at in (0, 7, 23, count - 1):
        step = np.zeros(count)
        step[at] = 1e-5
        gap = objective(packed, layers, weights + step)[0] - objective(packed, layers, weights - step)[0]
        assert grad[at] == pytest.approx(gap / 2e-5, rel=1e-5, abs=1e-9)
    packed.unpersist()


def test_steps_cut_blocks_anywhere(monkeypatch):
    rng = np.random.default_rng(1)
    layers, n = [3, 4, 3], 300
    weights = rng.normal(size=4 * 4 + 5 * 3)
    features = pa.array(rng.normal(size=(n, 3)).tolist(), pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([features, pa.array(rng.integers(0, 3, n).astype(float))], names=["features", "label"])
    blocks = _blocks(rows, 3, 128, False)
    assert blocks.num_rows == 3
    found = []
    for step in (7, 128, 1000):
        monkeypatch.setattr("plumbline.plans.network.ROWS", step)
        network = Network(layers, weights)
        network.add(blocks)
        found.append(network.sums())
    assert np.allclose(found[0], found[1], rtol=1e-12) and np.allclose(found[0], found[2], rtol=1e-12)


@pytest.mark.parametrize(
    "features, label",
    [
        ([0.0, float("nan")], 1.0),
        ([0.0, float("inf")], 1.0),
        ([0.0, 1.0, 2.0], 1.0),
        (None, 1.0),
        ([0.0, 1.0], None),
        ([0.0, 1.0], 2.0),
        ([0.0, 1.0], 0.5),
    ],
)
def test_rows_that_cannot_be_learned_are_errors(features, label):
    rows = pa.RecordBatch.from_arrays(
        [pa.array([[0.0, 1.0], features], pa.list_(pa.float64())), pa.array([0.0, label], pa.float64())],
        names=["features", "label"],
    )
    with pytest.raises(ValueError):
        _blocks(rows, 2, 128, False)


def test_partitions_of_features_of_different_width_are_an_error(spark):
    wide = spark.range(0, 8, 1, 2).select(
        F.when(F.col("id") < 4, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("features"),
        (F.col("id") % 2).cast("double").alias("label"),
    )
    with pytest.raises(ValueError, match="1 to 2 wide"):
        fit_network(wide, (3,))


def test_optimiser_finds_the_minimum_and_keeps_its_limits():
    def valley(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([2 * (a - 1) - 400 * a * (b - a * a), 200 * (b - a * a)])

    place, history = minimize(valley, np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(place, 1.0, atol=1e-4) and history[-1] < 1e-8
    assert len(minimize(valley, np.array([-1.2, 1.0]), 5, 1e-12)[1]) == 6
    place, history = minimize(lambda x: (float(x @ x), 2 * x), np.zeros(2), 5, 1e-6)
    assert (place == 0).all() and history == [0.0]


def test_optimiser_gives_up_where_no_step_helps():
    start = np.array([1.0, 2.0])
    place, history = minimize(lambda x: (float(x @ x), -x), start, 50, 1e-6)  # the gradient leads upwards
    assert (place == start).all() and history == [5.0, 5.0]

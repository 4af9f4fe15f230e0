from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import track
from plumbline.refinements import (
    DataValuation,
    FairnessMetrics,
    InputUsage,
    confusion_by_group,
    fairness_metric_rows,
    knn_shapley,
)
from plumbline.refinements.usage import UsedRows
from tests.helpers import frame, pipeline_of


def loop_shapley(train, sample, k):
    """The recursion from the far end, for (key, features, label) rows."""
    values = {key: 0.0 for key, _, _ in train}
    for x, y in sample:
        ranked = sorted(
            train, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[1], x)) ** 0.5, r[0], r[2])
        )
        hits = [float(r[2] == y) for r in ranked]
        n = len(ranked)
        score = hits[-1] / n
        values[ranked[-1][0]] += score / len(sample)
        for i in range(n - 1, 0, -1):
            score += (hits[i - 1] - hits[i]) / k * min(i, k) / i
            values[ranked[i - 1][0]] += score / len(sample)
    return values


SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def compact(x):
    return (len(x), [i for i, v in enumerate(x) if v], [v for v in x if v])


def shapley(spark, train, sample, k, parts=3, sparse=False, **sizes):
    kind, form = (SPARSE, compact) if sparse else ("array<double>", list)
    df = spark.createDataFrame([(key, form(x), y) for key, x, y in train], f"key long, features {kind}, label double")
    tests = spark.createDataFrame([(i, form(x), y) for i, (x, y) in enumerate(sample)], f"test int, features {kind}, label double")
    got = knn_shapley(df.repartition(parts), tests, k, **sizes).collect()
    return {r["key"]: r["shapley_value"] for r in got}


TRAIN = [(i, [float((i * 7) % 11), float((i * 5) % 13)], float(i % 3 == 0)) for i in range(60)]
# A third of the rows are copies of one point.
TRAIN += [(100 + i, [3.0, 4.0], float(i % 2)) for i in range(30)]
SAMPLE = [([3.0, 4.0], 1.0), ([0.0, 12.0], 0.0), ([6.5, 2.0], 1.0)]


@pytest.mark.parametrize("k", [1, 2, 7])
@pytest.mark.parametrize("parts", [1, 17])
def test_shapley_against_a_plain_loop(spark, k, parts):
    got = shapley(spark, TRAIN, SAMPLE, k, parts)
    expected = loop_shapley(TRAIN, SAMPLE, k)
    assert got.keys() == expected.keys()
    assert all(got[key] == pytest.approx(expected[key], abs=1e-12) for key in expected)


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("slot,block", [(4096, 256), (7, 2), (1, 1)])
def test_shapley_with_one_and_many_blocks(spark, sparse, slot, block):
    train = [(key, [*x, 0.0, float(key % 2)], y) for key, x, y in TRAIN[50:80]] + [(500, [0.0] * 4, 1.0)]
    sample = [([*x, 0.0, 1.0], y) for x, y in SAMPLE] + [([0.0] * 4, 0.0)]
    got = shapley(spark, train, sample, 3, sparse=sparse, slot=slot, block=block)
    assert got == pytest.approx(loop_shapley(train, sample, 3), abs=1e-12)


def test_distances_of_sparse_rows_keep_ties_in_any_parts(monkeypatch):
    from plumbline.refinements import valuation

    rng = random.Random(6)
    rows = [[rng.choice([0.0, 0.0, 0.1, 0.7, 1e-9]) for _ in range(40)] for _ in range(30)]
    rows += [rows[3][:], rows[3][:], [0.0] * 40]
    held = valuation.SparseRows(pa.chunked_array([pa.array(
        [dict(zip(("size", "indices", "values"), compact(x))) for x in rows],
        pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))]))
    whole = held.distances(held)
    for cells in (1, 200, 3000):
        monkeypatch.setattr(valuation, "CELLS", cells)
        assert (held.distances(held) == whole).all()
    assert whole == pytest.approx(np.sqrt(((np.array(rows)[:, None] - np.array(rows)[None]) ** 2).sum(axis=2)))
    assert (whole[3] == whole[30]).all() and whole[3, 31] == 0


def test_shapley_of_one_frequent_distance_in_many_ranges(spark):
    """Two thirds of all rows lie at one distance: their ranges go on by key."""
    train = [(i, [1.0] if i % 3 else [float(i)], float(i % 2)) for i in range(600)]
    sample = [([0.0], 1.0)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = shapley(spark, train, sample, 2, slot=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == pytest.approx(loop_shapley(train, sample, 2), abs=1e-12)


def test_shapley_values_add_up_to_the_classifier_gain(spark):
    k = 5
    got = shapley(spark, TRAIN, SAMPLE, k)
    gain = 0.0
    for x, y in SAMPLE:
        ranked = sorted(TRAIN, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[1], x)), r[0]))
        gain += sum(r[2] == y for r in ranked[:k]) / k / len(SAMPLE)
    assert sum(got.values()) == pytest.approx(gain)


def test_shapley_by_hand_and_with_fewer_rows_than_neighbours(spark):
    train = [(1, [0.0], 1.0), (2, [1.0], 0.0), (3, [2.0], 1.0)]
    # ranks 1, 2, 3 hit 1, 0, 1: s3 = 1/3, s2 = 1/3 - 1/2, s1 = s2 + 1
    assert shapley(spark, train, [([0.0], 1.0)], 1) == pytest.approx({1: 5 / 6, 2: -1 / 6, 3: 1 / 3})
    assert shapley(spark, train, [([0.0], 1.0)], 5) == pytest.approx(loop_shapley(train, [([0.0], 1.0)], 5))
    assert shapley(spark, train[:1], [([0.0], 1.0)], 1) == pytest.approx({1: 1.0})
    with pytest.raises(ValueError):
        shapley(spark, train, [], 1)


@pytest.fixture
def star(spark):
    """Fact rows 0..9 with dimension rows 0..4; X_train uses facts 0..5, X_test facts 6..9."""
    fact = track(
        spark.range(10).select("id", (F.col("id") % 3).alias("d"), F.when(F.col("id") != 7, "m").alias("sex")),
        0,
        key="id",
    )
    dim = track(spark.range(5).select(F.col("id").alias("d"), F.lit("x").alias("note")), 1, key="d")
    rows = [
        ("train" if i < 6 else "test", [(0, i), (1, i % 3)], [float(i)], float(i % 2), float(i > 7))
        for i in range(10)
    ]
    sources = {0: fact.df, 1: dim.df}
    joins = fact.join(dim, on="d").joins
    return pipeline_of(frame(spark, rows), {"train": sources, "test": sources}, joins)


def test_usage_of_every_source(star):
    fact, dim = InputUsage().compute(star)
    assert sorted(r["id"] for r in fact.data.filter("is_used").collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted((r["d"], r["is_used"]) for r in dim.data.collect()) == [
        (0, True), (1, True), (2, True), (3, False), (4, False)
    ]


@pytest.mark.parametrize("kind", ["close", "scattered", "negative", "none"])
def test_usage_by_bitmaps_and_by_ids(spark, kind):
    ids = {
        "close": [*range(0, 70_000, 3), 32768, 32769, 65536, 1 << 40],
        "scattered": [(i * 0x9E3779B97F4A7C15) % (1 << 63) - (1 << 62) for i in range(500)],
        "negative": [*range(-40_000, 2_000)],
        "none": [],
    }[kind]
    half = set(ids[::2])
    lineage = F.array(F.struct(F.lit(4).alias("operator_id"), F.col("i").alias("row_id")))
    every = spark.createDataFrame([(i,) for i in ids], "i long").select("i", lineage.alias("lineage"))
    repeated = every.filter(F.col("i").isin(list(half)) if len(half) < 600 else F.expr("true")).unionByName(every.limit(0))
    wanted = spark.createDataFrame([(i,) for i in half], "j long")
    rows = repeated.join(wanted, F.col("i") == F.col("j")).select("lineage")
    used = UsedRows(rows.unionByName(rows), [4])
    assert (4 in used.dense) == (kind in ("close", "negative"))
    got = used.marked(every, 4).collect()
    assert len(got) == len(ids) and {r["i"] for r in got if r["is_used"]} == half
    assert every.columns + ["is_used"] == used.marked(every, 4).columns


def test_usage_scans_the_joined_rows_once(spark, star):
    star_rows = star.rows
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    star._rows = star_rows.coalesce(1).mapInArrow(counted, star_rows.schema)
    star.known_facts["train"] = 0
    sources = InputUsage().compute(star)
    assert [s.rows.filter("is_used").count() for s in sources] == [6, 3]
    assert passes.value == 1


def test_valuation_uses_test_labels_and_gives_unused_rows_zero(star):
    values = {r["id"]: r["shapley_value"] for r in DataValuation(1, 2).compute(star).data.collect()}
    train = [(i, [float(i)], float(i % 2)) for i in range(6)]
    expected = loop_shapley(train, [([6.0], 0.0), ([7.0], 1.0)], 1)
    assert values == pytest.approx({**expected, 6: 0.0, 7: 0.0, 8: 0.0, 9: 0.0})


def test_confusion_by_hand_with_a_null_attribute(star):
    got = {r["non_protected"]: tuple(r)[1:] for r in FairnessMetrics("sex", "m").confusion(star).collect()}
    # test rows 6..9: labels 0 1 0 1, predictions 0 0 1 1; row 7 has no attribute
    assert got[True] == (1, 0, 1, 1, 0.0)
    assert got[False] == (0, 1, 0, 0, 1.0)


def test_empty_group_gives_null_rate_and_all_metrics(spark, star):
    confusion = FairnessMetrics("sex", "Nobody").confusion(star)
    metrics = {r["metric"]: r["value"] for r in fairness_metric_rows(confusion, "sex", "Nobody").collect()}
    assert len(metrics) == 10
    assert metrics["fairness.sex.nobody.false_negative_rate"] is None
    assert metrics["fairness.sex.not.nobody.true_positives"] == 1.0
    counts = [v for k, v in metrics.items() if not k.endswith("rate")]
    assert sum(counts) == 4


def test_attribute_of_a_dimension_used_by_most_rows(spark):
    rows = [("test", [(0, i), (1, 0 if i % 3 else 1)], [0.0], float(i % 2), float(i % 5 == 0)) for i in range(90)]
    membership = spark.createDataFrame([(0, True), (1, False)], "row_id long, non_protected boolean")
    got = {r["non_protected"]: r for r in confusion_by_group(frame(spark, rows), membership, 1).collect()}
    assert sum(tuple(got[True])[1:5]) == 60 and sum(tuple(got[False])[1:5]) == 30


def test_unknown_attribute_is_an_error(star):
    with pytest.raises(ValueError):
        FairnessMetrics("age", "old").confusion(star)

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from plumbline.features.vectors import sparse
from plumbline.issues import (
    ConstantFeatures,
    CovariateShift,
    LabelShift,
    TrainTestOverlap,
    UnnormalisedFeatures,
    covariate_shift_between_runs,
    domain_classifier_auc,
    overlapping_rows,
)
from plumbline.issues.shift import BINS, PARTS, RunRows, _ends, chi_square_2x2
from plumbline.operators import LINEAGE, roc_auc_value
from plumbline.plans.classification import feature_statistics, sparse_entries
from tests.helpers import FRAME, frame, lineages, pipeline_of, simple_pipeline


def test_constant_and_unnormalised_features(spark):
    # constant, 0/1, all zero, scaled, unscaled, not a number
    n = 40
    train = []
    for i in range(n):
        scaled = (i - (n - 1) / 2) / math.sqrt((n * n - 1) / 12)
        train.append(([5.0, float(i % 2), 0.0, scaled, 10.0 * i, float("nan")], 1.0))
    pipeline = simple_pipeline(spark, train, [([0.0] * 6, 0.0)])
    constant = ConstantFeatures().detect(pipeline)
    assert constant.is_present
    assert constant.details == {
        "constant_feature_indices": [0, 2, 5], "nonconstant_feature_indices": [1, 3, 4]
    }
    scale = UnnormalisedFeatures().detect(pipeline)
    assert scale.is_present
    assert scale.details == {
        "non_binary_features": [0, 2, 3, 4, 5],
        "non_zero_mean_features": [0, 4, 5],
        "non_unit_variance_features": [0, 2, 4, 5],
    }
    assert "3" in ConstantFeatures().message(constant)


def test_clean_features_raise_nothing(spark):
    pipeline = simple_pipeline(spark, [([1.0, 0.0], 1.0), ([-1.0, 1.0], 0.0)], [([9.0, 9.0], 0.0)])
    assert not ConstantFeatures().detect(pipeline).is_present
    assert not UnnormalisedFeatures().detect(pipeline).is_present


def test_sparse_statistics_equal_those_of_all_numbers(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        x = [rng.choice([0.0, 0.0, 0.0, 1.0]), float(i % 50 == 0) * rng.random(), 1e6 + rng.random(), 0.0, 1.0, -3.0 if i else 0.0]
        x.append(float("nan") if i % 2 else 0.0)
        rows.append((x,))
    dense = spark.createDataFrame(rows, "features array<double>").repartition(5)
    some = F.filter(F.transform("features", lambda v, i: F.struct(i.alias("pos"), v.alias("value"))), lambda e: e["value"] != 0)
    compact = dense.select(sparse(F.size("features"), some).alias("features"))
    assert sparse_entries(compact).count() == 300 + sum(v != 0 for (x,) in rows for v in x)  # not 300 times the width
    one, two = ([tuple(r) for r in feature_statistics(d).orderBy("pos").select(
        "pos", "n", "n_zero", "n_one", "low", "high", "mean", "variance").collect()] for d in (dense, compact))
    assert len(one) == len(two) == 7
    for a, b in zip(one, two):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-12, nan_ok=True)
    assert feature_statistics(compact.filter("false")).count() == 0


def test_constant_features_that_no_row_stores(spark):
    rows = [("train", [(0, i)], (5, [1], [float(i % 2 + 1)]), 0.0, 0.0) for i in range(9)]
    outputs = spark.createDataFrame(rows, FRAME.replace("features array<double>", "features struct<size:int,indices:array<int>,values:array<double>>"))
    issue = ConstantFeatures().detect(pipeline_of(outputs))
    assert issue.details == {"constant_feature_indices": [0, 2, 3, 4], "nonconstant_feature_indices": [1]}


def label_pipeline(spark, train_pos, train_neg, test_pos, test_neg):
    def rows(pos, neg):
        return [([0.0], 1.0)] * pos + [([0.0], 0.0)] * neg

    return simple_pipeline(spark, rows(train_pos, train_neg), rows(test_pos, test_neg))


def test_label_shift_planted_and_clean(spark):
    clean = LabelShift().detect(label_pipeline(spark, 100, 300, 26, 74))
    assert not clean.is_present and clean.details["p_value"] > 0.5
    planted = LabelShift().detect(label_pipeline(spark, 100, 300, 50, 50))
    assert planted.is_present
    # Expected cells are 120, 280, 30 and 70; each observed one is off by 20, less 0.5 by Yates.
    chi = 19.5**2 * (1 / 120 + 1 / 280 + 1 / 30 + 1 / 70)
    assert chi_square_2x2(100.0, 300.0, 50.0, 50.0) == pytest.approx(chi)
    assert planted.details["p_value"] == pytest.approx(math.erfc(math.sqrt(chi / 2)))


def test_label_shift_with_an_empty_class_or_more_classes(spark):
    assert LabelShift().detect(label_pipeline(spark, 10, 0, 10, 0)).details["p_value"] == 1.0
    train = [([0.0], float(i % 3)) for i in range(300)]
    same = simple_pipeline(spark, train, [([0.0], float(i % 3)) for i in range(90)])
    other = simple_pipeline(spark, train, [([0.0], 2.0) for _ in range(90)])
    assert not LabelShift().detect(same).is_present
    assert LabelShift().detect(other).is_present


def test_rows_without_a_label_are_left_out(spark):
    train = [([0.0], 1.0)] * 100 + [([0.0], 0.0)] * 300 + [([0.0], None)] * 7
    issue = LabelShift().detect(simple_pipeline(spark, train, [([0.0], 1.0)] * 50 + [([0.0], 0.0)] * 50))
    plain = LabelShift().detect(label_pipeline(spark, 100, 300, 50, 50))
    assert issue.is_present and issue.details["p_value"] == plain.details["p_value"]
    assert issue.details["rows_without_label"] == {"train": 7, "test": 0}
    three = LabelShift().detect(simple_pipeline(spark, train + [([0.0], 2.0)] * 90, [([0.0], None)] * 5 + [([0.0], 2.0)] * 80))
    assert three.is_present and three.details["rows_without_label"] == {"train": 7, "test": 5}
    odd = simple_pipeline(spark, [([0.0], -4.5)] * 100 + [([0.0], 7.0)] * 300, [([0.0], -4.5)] * 50 + [([0.0], 7.0)] * 50)
    assert LabelShift().detect(odd).details["p_value"] == plain.details["p_value"]


def shifted(spark, factor, test_rows=300):
    values = [((i * 37) % 101 - 50.0, (i * 53) % 89 - 44.0) for i in range(1500 + test_rows)]
    train = [([a, b], 0.0) for a, b in values[:1500]]
    test = [([a * factor, b], 0.0) for a, b in values[1500:]]
    return simple_pipeline(spark, train, test)


def test_covariate_shift_planted_and_clean(spark):
    detector = CovariateShift(trees=20, depth=6)
    clean = detector.detect(shifted(spark, 1.0))
    assert not clean.is_present and clean.details["auc"] < 0.65
    assert detector.detect(shifted(spark, 10.0)).is_present


def test_covariate_shift_is_seen_in_a_small_test_set(spark):
    assert CovariateShift(trees=20, depth=6).detect(shifted(spark, 10.0, test_rows=60)).is_present


def test_forest_is_fitted_on_equal_rows_with_their_number(spark, monkeypatch):
    seen, fit = [], RandomForestRegressor.fit

    def spied(self, rows):
        seen.append(rows.agg(F.count("*"), F.sum("weight")).first())
        return fit(self, rows)

    monkeypatch.setattr(RandomForestRegressor, "fit", spied)
    rows = spark.range(20_000).select(
        F.array(F.struct(F.lit(0).alias("operator_id"), F.col("id").alias("row_id"))).alias(LINEAGE),
        F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("features"),
    )
    other = rows.withColumn("features", F.array(F.element_at("features", 1) + 1, F.lit(1.0)))
    auc = domain_classifier_auc(rows, other, trees=10, depth=5)
    ((fitted, weight),) = seen
    assert fitted <= 2 * 3 * PARTS and weight == 32_000
    # 0 and 3 tell the domain, 1 and 2 do not: 1/3 + 2/3 * (1/3 + 2/3 / 2)
    assert auc == pytest.approx(7 / 9, abs=0.02)


def test_bins_lie_between_counted_values_and_at_quantiles(spark):
    few = _ends([(3.0, 5), (1.0, 900), (2.0, 1)])
    assert few.tolist() == [1.0, 2.0]
    many = _ends([(float(i), 10) for i in range(320)])
    assert len(many) == BINS - 1 and many.tolist() == [10.0 * i - 1 for i in range(1, BINS)]


def test_auc_of_weighted_rows_is_that_of_repeated_ones(spark):
    pairs = [(float(i % 7), float(i % 3 == 0), float(1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame(pairs, "s double, y double, w double")
    repeated = [(s, y) for s, y, w in pairs for _ in range(int(w))]
    assert roc_auc_value(df, "s", "y", "w") == pytest.approx(brute_auc(repeated))


def test_runs_are_compared_in_pairs_and_read_once(spark, monkeypatch):
    class Store:
        def __init__(self):
            self.spark, self.reads = spark, []

        def features(self, run_id, split):
            self.reads.append((run_id, split))
            factor = 10.0 if run_id == "c" else 1.0
            rows = [([(0, i)], [factor * ((i * 37) % 101 - 50.0), (i * 53) % 89 - 44.0]) for i in range(700)]
            return spark.createDataFrame(rows, FRAME.split(", label")[0].split("split string, ")[1])

    store = Store()
    found = covariate_shift_between_runs(store, ["a", "b", "c"], trees=10, depth=5)
    assert [(a, b, shifted) for a, b, _, shifted in found] == [("a", "b", False), ("a", "c", True), ("b", "c", True)]
    assert store.reads == [("a", "train"), ("b", "train"), ("c", "train")]
    again = covariate_shift_between_runs(store, ["a", "b", "c"], trees=10, depth=5, at_once=1)
    assert [f[:2] + f[3:] for f in again] == [f[:2] + f[3:] for f in found]
    assert [f[2] for f in again] == pytest.approx([f[2] for f in found], abs=1e-9)
    runs = RunRows(store, ["a", "c"])
    assert runs.sizes() == {"a": (700, 140), "c": (700, 140)}
    runs.release()


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [1, 17])
def test_auc_with_ties_against_all_pairs(spark, parts):
    pairs = [(float((i * 7919) % 23), float((i * 31) % 5 < 2)) for i in range(400)]
    pairs += [(11.0, 1.0)] * 200  # one score holds a third of the rows
    df = spark.createDataFrame(pairs, "s double, y double").repartition(parts)
    auc = roc_auc_value(df, "s", "y")
    assert auc == pytest.approx(brute_auc(pairs))
    flipped = roc_auc_value(df.withColumn("s", -F.col("s")), "s", "y")
    assert auc + flipped == pytest.approx(1.0)
    assert roc_auc_value(df.filter("y = 1"), "s", "y") is None


def test_overlap_is_by_lineage_not_by_value(spark):
    outputs = frame(
        spark,
        [
            ("train", [(0, 1), (1, 7)], [1.0], 0.0, 0.0),
            ("train", [(0, 2), (1, 7)], [1.0], 0.0, 0.0),
            ("train", [(0, 2), (1, 7)], [1.0], 0.0, 0.0),
            ("test", [(0, 2), (1, 7)], [3.0], 0.0, 0.0),
            ("test", [(0, 3), (1, 7)], [1.0], 0.0, 0.0),
        ],
    )
    issue = TrainTestOverlap().detect(pipeline_of(outputs))
    assert issue.is_present and issue.details == {"num_overlapping_records": 1}
    assert lineages(overlapping_rows(outputs)) == ["0:2,1:7"] * 3
    clean = outputs.filter("split = 'train'")
    assert not TrainTestOverlap().detect(pipeline_of(clean)).is_present

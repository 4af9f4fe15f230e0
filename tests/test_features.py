from __future__ import annotations

import hashlib
import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from plumbline.features import (
    Apply,
    ArrayFeature,
    FeatureBlock,
    FeaturePlan,
    HashNgrams,
    ImputeMean,
    ImputeMode,
    OneHot,
    SafeLog,
    StandardScale,
    dense,
    is_sparse,
    stored_entries,
    vector,
    width,
)
from plumbline.functions import expressions
from plumbline.functions import binarize, hashed_ngrams, positive_flag, safe_log, word_ngrams


@pytest.fixture
def rows(spark):
    data = [(1, 1.0, "b"), (2, None, "a"), (3, 3.0, None), (4, 0.0, "b"), (5, 4.0, "a")]
    return spark.createDataFrame(data, "id int, x double, c string")


def fitted(rows, *blocks, on=None):
    encoded = FeaturePlan(blocks).fit(rows).transform(on or rows)
    return [r["f"] for r in encoded.orderBy("id").select(dense(encoded).alias("f")).collect()]


def test_scaling_uses_the_population_deviation(rows):
    values = [v[0] for v in fitted(rows, FeatureBlock(["x"], [StandardScale()]))]
    assert math.isnan(values[1])
    mean, std = 2.0, math.sqrt(2.5)
    assert values[0] == pytest.approx((1 - mean) / std)
    constant = fitted(rows.withColumn("x", F.lit(3.0)), FeatureBlock(["x"], [StandardScale()]))
    assert constant == [[0.0]] * 5


def test_chain_of_mean_log_scale(rows):
    values = [v[0] for v in fitted(rows, FeatureBlock(["x"], [ImputeMean(), SafeLog(), StandardScale()]))]
    logs = [math.log(v) if v else 0.0 for v in (1.0, 2.0, 3.0, 0.0, 4.0)]
    mean = sum(logs) / 5
    std = math.sqrt(sum((v - mean) ** 2 for v in logs) / 5)
    assert values == pytest.approx([(v - mean) / std for v in logs])


def test_mode_takes_the_smallest_of_ties(rows):
    assert fitted(rows, FeatureBlock(["c"], [ImputeMode(), OneHot()])) == [
        [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]
    ]


def test_unseen_category_is_all_zeros_and_null_a_category(spark, rows):
    other = spark.createDataFrame([(1, "z"), (2, None), (3, "a")], "id int, c string")
    assert fitted(rows, FeatureBlock(["c"], [OneHot()]), on=other) == [
        [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]
    ]
    known = rows.filter("c is not null")
    assert fitted(known, FeatureBlock(["c"], [OneHot()]), on=other) == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_numeric_categories_sort_as_numbers(spark):
    rows = spark.createDataFrame([(1, 10), (2, 9), (3, 9)], "id int, c int")
    assert fitted(rows, FeatureBlock(["c"], [OneHot()])) == [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]


def test_two_hundred_thousand_categories(spark):
    """Positions come from a table; a row holds one number whatever the width; nothing is collected."""
    rows = spark.range(200_000).select("id", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"), F.lit(1.5).alias("x"))
    many = rows.unionByName(rows.filter("id = 7").withColumn("id", F.explode(F.sequence(F.lit(-100_000), F.lit(-1)))))  # a third of all rows
    plan = FeaturePlan([FeatureBlock(["x"], []), FeatureBlock(["c"], [OneHot()])])
    encoded = plan.fit(many).transform(many)
    assert is_sparse(encoded)
    found = encoded.select("id", width(encoded).alias("w"), F.col("features.indices").alias("i"), F.col("features.values").alias("v"))
    expected = F.when(F.col("id") < 0, 7).otherwise(F.col("id")) + 1
    right = (F.col("w") == 200_001) & (F.col("i")[0] == 0) & (F.col("i")[1] == expected) & (F.size("i") == 2) & (F.col("v")[1] == 1)
    assert found.filter(right).count() == found.count() == 300_000


def test_one_hot_ends_its_chain():
    with pytest.raises(ValueError, match="end"):
        FeaturePlan([FeatureBlock(["c"], [OneHot(), ImputeMean()])])


def test_parts_move_behind_arrays_of_any_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", 0.0), (2, [5.0], "b", 2.0), (3, [], None, None)], "id int, v array<double>, c string, x double")
    plan = FeaturePlan([
        FeatureBlock(["x"], []), FeatureBlock(["v"], [ArrayFeature()]), FeatureBlock(["c"], [OneHot()]), FeatureBlock(["id"], []),
    ])
    got = plan.fit(df).transform(df).orderBy("id").select("features.*").collect()
    assert [(r["size"], r["indices"], r["values"]) for r in got[:2]] == [
        (7, [1, 3, 6], [1.0, 1.0, 1.0]), (6, [0, 1, 3, 5], [2.0, 5.0, 1.0, 2.0])
    ]
    assert got[2]["indices"] == [0, 3, 4] and math.isnan(got[2]["values"][0])


def test_vectors_of_both_forms(spark, rows):
    plan = [FeatureBlock(["x"], [ImputeMean()]), FeatureBlock(["c"], [OneHot()])]
    sparse_rows = FeaturePlan(plan).fit(rows).transform(rows).orderBy("id")
    got = [r[0] for r in sparse_rows.select(vector(sparse_rows)).collect()]
    assert all(type(v).__name__ == "SparseVector" for v in got)
    assert [v.toArray().tolist() for v in got] == fitted(rows, *plan)
    dense_rows = FeaturePlan(plan[:1]).fit(rows).transform(rows)
    assert type(dense_rows.select(vector(dense_rows)).first()[0]).__name__ == "DenseVector"
    entries = stored_entries(sparse_rows, "id").collect()
    assert len(entries) == 9 and all(r["value"] != 0 for r in entries)  # one of the numbers is zero


def test_nothing_to_learn_from(spark, rows):
    none = rows.filter("false")
    plan = FeaturePlan([FeatureBlock(["c"], [ImputeMode(), OneHot()]), FeatureBlock(["x"], [ImputeMean(), StandardScale()])])
    encoded = plan.fit(none).transform(rows)
    assert {r["size"] for r in encoded.select("features.size").collect()} == {1}


def test_blocks_are_laid_out_in_order_and_udfs_fit_in(rows):
    @F.pandas_udf("double")
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    values = fitted(
        rows,
        FeatureBlock(["c"], [ImputeMode(), OneHot()]),
        FeatureBlock(["id", "x"], [ImputeMean(), Apply(doubled)]),
    )
    assert values[1] == [1.0, 0.0, 4.0, 4.0]


def expected_counts(text: str, buckets: int) -> list[float]:
    words = regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower())
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    counts = [0.0] * buckets
    for gram in grams:
        code = int(hashlib.md5(gram.encode()).hexdigest()[:9], 16) % (2 * buckets)
        counts[code % buckets] += 1 if code < buckets else -1
    return counts


TEXTS = ["", "a", "Two words", "Ärger über Straße, naïve café 42 x_y!", "go go go go " * 50, None]


def test_hashed_ngrams_against_a_plain_loop(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    got = df.select("id", hashed_ngrams(F.col("t"), 20, normalise=False).alias("f")).collect()
    for row in got:
        counts = expected_counts(TEXTS[row["id"]] or "", 20)
        assert [tuple(e) for e in row["f"]] == [(i, v) for i, v in enumerate(counts) if v]
    for row in df.select(hashed_ngrams(F.col("t"), 20).alias("f")).collect():
        assert sum(v * v for _, v in row["f"]) == pytest.approx(1.0) or not row["f"]


@pytest.mark.parametrize("step", [1, 40, 1 << 20])
def test_hashed_ngrams_in_steps_of_any_size(spark, monkeypatch, step):
    counter = expressions._bucket_counter(20, False).func
    monkeypatch.setattr(expressions, "STEP", step)
    codes = [[3, 3, 23, 39], [], [25] * 200, [0], [], [19, 39]]
    got = counter(pa.array(codes, pa.list_(pa.int32()))).to_pylist()
    assert [[(e["pos"], e["value"]) for e in row] for row in got] == [
        [(3, 1.0), (19, -1.0)], [], [(5, -200.0)], [(0, 1.0)], [], []
    ]
    part = counter(pa.array([[9]] + codes, pa.list_(pa.int32())).slice(1, 2)).to_pylist()  # a slice of a batch
    assert [len(row) for row in part] == [2, 0]


def test_many_buckets_in_large_batches(spark):
    """2^18 buckets and batches of 10,000 rows: as arrays of all buckets a batch would take 21 GB."""
    buckets = 1 << 18
    df = spark.range(10_000, numPartitions=1).select("id", F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" tail")).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        got = df.select("id", hashed_ngrams(F.col("t"), buckets, normalise=False).alias("f")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for row in got[:: 997]:
        expected = {}
        words = ["word", str(row["id"]), "tail"] if row["id"] > 9 else ["word", "tail"]
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                code = int(hashlib.md5(" ".join(words[i : i + n]).encode()).hexdigest()[:9], 16) % (2 * buckets)
                expected[code % buckets] = expected.get(code % buckets, 0) + (1 if code < buckets else -1)
        assert dict(map(tuple, row["f"])) == {k: v for k, v in expected.items() if v}


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([("one two three",), ("one",), ("",)], "t string")
    assert [r[0] for r in df.select(word_ngrams(F.col("t"), 2, 3)).collect()] == [
        ["one two", "two three", "one two three"], [], []
    ]


def test_text_block_is_wide_as_its_buckets(spark):
    df = spark.createDataFrame([(1, "some words here")], "id int, t string")
    assert len(fitted(df, FeatureBlock(["t"], [HashNgrams(buckets=30)]))[0]) == 30


def test_small_expressions(spark):
    df = spark.createDataFrame([(True, 0.0, 2), (False, -1.0, 0), (None, math.e, None)], "b boolean, x double, v int")
    got = df.select(
        binarize(F.col("b"), [True, False]), safe_log(F.col("x")), positive_flag(F.col("v"))
    ).collect()
    assert [r[0] for r in got] == [0.0, 1.0, 0.0]
    assert got[0][1] == 0.0 and math.isnan(got[1][1]) and got[2][1] == pytest.approx(1.0)
    assert [r[2] for r in got] == [True, False, False]
    with pytest.raises(ValueError):
        binarize(F.col("b"), [True])


def test_counts_of_several_columns_in_one_pass(rows):
    values = fitted(
        rows.withColumn("d", F.col("id") % 2),
        FeatureBlock(["c"], [ImputeMode(), OneHot()]),
        FeatureBlock(["d"], [OneHot()]),
        FeatureBlock(["x"], [ImputeMode()]),
    )
    # x has four different values once each: the smallest fills the gap
    assert values[1] == [1.0, 0.0, 1.0, 0.0, 0.0]
    assert values[0] == [0.0, 1.0, 0.0, 1.0, 1.0]


def test_counts_keep_their_types(spark):
    df = spark.sql("select 1 id, cast(3 as int) i, cast(null as string) s, true b, cast(1.5 as float) f, date'2020-01-01' d")
    blocks = [FeatureBlock([c], [OneHot()]) for c in ("i", "s", "b", "f", "d")]
    assert fitted(df, *blocks) == [[1.0] * 5]


def test_plans_describe_their_encoders():
    plan = FeaturePlan(
        [FeatureBlock(["a", "b"], [ImputeMean(), Apply(positive_flag)]), FeatureBlock(["t"], [HashNgrams(50)])]
    )
    assert plan.described() == [
        ("ImputeMean", {"columns": "a,b"}),
        ("Apply", {"columns": "a,b", "function": "positive_flag", "is_array": "False"}),
        ("HashNgrams", {"columns": "t", "buckets": "50", "low": "1", "high": "3"}),
    ]


def test_counting_buckets_holds_little_beside_its_result(spark):
    each, rows = 1000, 4000
    flat = np.random.default_rng(1).integers(0, 1 << 19, rows * each, dtype=np.int32)
    codes = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * each), pa.array(flat))
    count = expressions._bucket_counter(1 << 18, False).func
    tracemalloc.start()
    counted = count(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 12 bytes for each code, and one step
    own = np.bincount(flat[:each] % (1 << 18), np.where(flat[:each] < 1 << 18, 1.0, -1.0))
    assert {e["pos"]: e["value"] for e in counted[0].as_py()} == {i: own[i] for i in np.flatnonzero(own)}

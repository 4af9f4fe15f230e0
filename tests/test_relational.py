from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import positive_flag
from plumbline.operators import (
    LINEAGE,
    balance_classes,
    lineage_pairs,
    merge_lineage,
    random_split,
    sample_rows,
    split_at_rank,
    temporal_split,
    track,
)
from plumbline.sources.identity import ROW_ID, hashed_ids
from tests.helpers import lineages
from workload.bindings import orders_star


@pytest.fixture
def fact(spark):
    rows = [
        (1, 10, "2020-01-01", 1.0, "a"),
        (2, 10, "2020-02-01", 2.0, None),
        (3, 20, "2020-03-01", None, "c"),
        (4, None, "2020-04-01", 4.0, "d"),
    ]
    df = spark.createDataFrame(rows, "id long, dim long, day string, x double, txt string")
    return track(df, 0, "fact", key="id")


@pytest.fixture
def dim(spark):
    df = spark.createDataFrame([(10, "p", "one"), (20, "q", "two")], "dim long, cat string, txt string")
    return track(df, 1, "dim", key="dim")


def test_join_merges_lineage_and_renames_clashing_columns(fact, dim):
    joined = fact.join(dim, on="dim")
    assert joined.columns == ["id", "dim", "day", "x", "txt_x", "cat", "txt_y"]
    assert lineages(joined.df) == ["0:1,1:10", "0:2,1:10", "0:3,1:20"]
    assert joined.source_ids == {0, 1}
    assert [j.source_ids for j in joined.joins] == [{0, 1}]


def test_join_keeps_both_keys_when_names_differ(fact, dim):
    renamed = dim.rename({"dim": "key"}).drop("txt")
    joined = fact.join(renamed, left_on="dim", right_on="key")
    assert {"dim", "key"} <= set(joined.columns)
    assert joined.df.count() == 3


def test_null_keys_match_only_when_asked(spark, fact):
    side = track(spark.createDataFrame([(7, None)], "n long, dim long"), 1, key="n")
    assert fact.join(side, on="dim").df.count() == 0
    assert lineages(fact.join(side, on="dim", null_safe=True).df) == ["0:4,1:7"]


@pytest.mark.parametrize("salt", [None, 3])
def test_salted_join_with_one_dominant_key(spark, salt):
    left = track(spark.range(1000).select("id", F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k")), 0, key="id")
    right = track(spark.range(1000).select(F.col("id").alias("k")), 1, key="k")
    joined = left.join(right, on="k", salt=salt)
    assert joined.df.count() == 1000
    assert joined.df.select(LINEAGE).distinct().count() == 1000


def test_salted_join_never_broadcasts_the_repeated_side(spark, capsys):
    left = track(spark.range(100).withColumn("k", F.col("id") % 7), 0, key="id")
    right = track(spark.range(7).select(F.col("id").alias("k")), 1, key="k")
    left.join(right, on="k", salt=3).df.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_orders_star_broadcasts_no_customers(spark, small, capsys):
    orders_star(spark, small).df.explain()
    joins = [line.strip(" +-:") for line in capsys.readouterr().out.splitlines() if "Join" in line]
    assert [j for j in joins if "o_custkey" in j and "SortMergeJoin" in j]
    assert not [j for j in joins if "o_custkey" in j and "BroadcastHashJoin" in j]


def test_join_order_does_not_change_lineage(fact, dim):
    assert lineages(fact.join(dim, on="dim").df) == lineages(dim.join(fact, on="dim").df)


def test_self_join_merges_equal_ids(fact):
    joined = fact.join(fact.select("id"), on="id")
    assert lineages(joined.df) == ["0:1", "0:2", "0:3", "0:4"]


def test_interleaved_sources_are_sorted(spark):
    left = F.expr("array(named_struct('operator_id', 0, 'row_id', 5L), named_struct('operator_id', 3, 'row_id', 1L))")
    right = F.expr("array(named_struct('operator_id', 2, 'row_id', 9L))")
    merged = spark.range(1).select(merge_lineage(left, right, {0, 3}, {2}).alias(LINEAGE))
    assert lineages(merged) == ["0:5,2:9,3:1"]


def test_union_keeps_repeats_and_counts_shared_joins_once(fact, dim):
    joined = fact.join(dim, on="dim")
    both = joined.filter(F.col("cat") == "p").union(joined)
    assert len(both.joins) == 1
    assert lineages(both.df) == ["0:1,1:10", "0:1,1:10", "0:2,1:10", "0:2,1:10", "0:3,1:20"]


def test_lineage_stays_through_projection_and_cannot_be_dropped(fact):
    assert lineages(fact.select("x").drop("x", LINEAGE).df) == ["0:1", "0:2", "0:3", "0:4"]
    with pytest.raises(ValueError):
        fact.with_column(LINEAGE, F.lit(1))
    with pytest.raises(ValueError):
        fact.apply(lambda df: df.drop(LINEAGE))


def test_null_rules(fact):
    assert lineages(fact.exclude("txt", ["a", "c"]).df) == ["0:2", "0:4"]
    assert lineages(fact.filter_equal("txt", "a").df) == ["0:1"]
    assert lineages(fact.filter_between("x", low=1.5).df) == ["0:2", "0:4"]
    texts = fact.fill_null(["txt"], "").concat_text("t", ["txt", "day"]).df.select("t").collect()
    assert sorted(r["t"] for r in texts)[0] == " 2020-02-01"
    assert fact.concat_text("t", ["txt", "day"]).df.filter("t is null").count() == 1


def test_pairs_of_one_source(fact, dim):
    pairs = lineage_pairs(fact.join(dim, on="dim").df, 1).collect()
    assert sorted((r["operator_id"], r["row_id"]) for r in pairs) == [(1, 10), (1, 20)]


def test_filter_on_a_key_source_reaches_the_scan(spark, small):
    orders = track(spark.read.parquet(f"{small}/orders.parquet"), 0, key="o_orderkey")
    plan = orders.filter_equal("o_orderstatus", "F").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_temporal_split_with_and_without_overlap(fact):
    train, test = temporal_split(fact, "day", "2020-02-01")
    assert (train.df.count(), test.df.count()) == (2, 2)
    train, test = temporal_split(fact, "day", "2020-02-01", overlap=True)
    assert (train.df.count(), test.df.count()) == (2, 3)


@pytest.fixture
def numbers(spark):
    return track(spark.range(1000).withColumn("even", F.col("id") % 10 == 0), 0, key="id")


@pytest.mark.parametrize("n", [0, 1, 137, 999, 1000])
def test_sample_has_exactly_n_rows_whatever_the_partitioning(numbers, n):
    first = lineages(sample_rows(numbers, n, seed=5).df)
    again = lineages(sample_rows(numbers.apply(lambda d: d.repartition(17)), n, seed=5).df)
    assert len(first) == min(n, 1000)
    assert first == again


def test_narrowing_over_several_levels(numbers, monkeypatch):
    from plumbline.operators import sampling

    expected = lineages(sample_rows(numbers, 333).df)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    monkeypatch.setattr(sampling, "_FAN", 2)
    assert lineages(sample_rows(numbers, 333).df) == expected


@pytest.mark.parametrize("digits,fan", [(3, 4096), (1, 1)])
def test_a_cut_takes_two_passes_over_the_rows(spark, numbers, monkeypatch, digits, fan):
    from plumbline.operators import sampling

    monkeypatch.setattr(sampling, "_DIGITS", digits)
    monkeypatch.setattr(sampling, "_FAN", fan)
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    rows = numbers.df.coalesce(1).mapInArrow(counted, numbers.df.schema)
    for wanted in (1, 500, 999):
        before = passes.value
        cut = sampling.find_cut(rows, wanted, 9)
        assert passes.value - before == 2
        assert numbers.df.filter(cut.head).count() == wanted


def test_split_is_exact_and_complete(numbers):
    train, test = random_split(numbers, 0.2, seed=3)
    assert (train.df.count(), test.df.count()) == (800, 200)
    assert sorted(lineages(train.df) + lineages(test.df)) == lineages(numbers.df)
    odd = numbers.filter(F.col("id") < 7)
    assert random_split(odd, 0.2)[1].df.count() == math.ceil(0.2 * 7)


def test_many_copies_of_one_row_are_split_exactly(spark):
    rows = spark.range(74).select(F.when(F.col("id") < 64, 3).otherwise(F.col("id") - 64).alias("id"))
    frame = track(rows, 0, key="id")
    for n in (5, 37, 70):
        head, tail = split_at_rank(frame.df, n, 1)
        first, rest = lineages(head), lineages(tail)
        assert len(first) == n
        assert sorted(first + rest) == lineages(frame.df)


def test_balanced_classes(numbers):
    balanced = balance_classes(numbers, F.col("even")).df
    counts = {r["even"]: r["count"] for r in balanced.groupBy("even").count().collect()}
    assert counts == {True: 100, False: 100}


def test_a_sample_larger_than_the_frame_is_an_error(numbers):
    with pytest.raises(ValueError, match="1001 rows"):
        sample_rows(numbers, 1001)


def test_two_sources_with_one_id_are_an_error(spark):
    one, two = (track(spark.range(5), 0, key="id") for _ in range(2))
    with pytest.raises(ValueError, match="id 0"):
        one.union(two)
    assert one.union(one.filter("id > 2")).df.count() == 7


def test_nan_is_a_missing_value(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, -2.0), (4, None)], "id long, x double")
    frame = track(rows, 0, key="id")
    assert frame.filter_between("x", low=-5).df.count() == 2
    assert [r["x"] for r in frame.fill_null(["x"], 7.0).df.orderBy("id").collect()] == [1.0, 7.0, -2.0, 7.0]
    flags = rows.select("id", positive_flag(F.col("x")).alias("f")).orderBy("id").collect()
    assert [r["f"] for r in flags] == [True, False, False, False]


def test_hashed_ids_tell_nulls_apart(spark):
    rows = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    assert hashed_ids(rows, ["a", "b"]).select(ROW_ID).distinct().count() == 2

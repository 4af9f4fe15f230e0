from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.features import FeatureBlock, FeaturePlan, OneHot, StandardScale
from plumbline.operators import temporal_split, track
from plumbline.plans import (
    RunStore,
    ScreeningFailed,
    build_classification,
    fact_table_id,
    fit_linear,
    join_usage,
    pipeline_profile,
    screen,
)
from plumbline.refinements import DataValuation, FairnessMetrics, InputUsage
from tests.helpers import lineages


def source(spark, source_id, n, **columns):
    df = spark.range(n).select("id", *[e.alias(c) for c, e in columns.items()])
    return track(df.withColumnRenamed("id", f"id{source_id}"), source_id, key=f"id{source_id}")


def test_fact_table_from_the_only_one_to_one_source(spark):
    fact = source(spark, 1, 10, d=F.col("id") % 3)
    dim = source(spark, 0, 3)
    joined = fact.join(dim, left_on="d", right_on="id0")
    assert fact_table_id(joined.df, joined.sources, joined.joins) == 1


def test_fact_table_from_join_usage(spark):
    fact = source(spark, 1, 4)
    one, two = source(spark, 0, 9), source(spark, 2, 9)
    joined = fact.join(one, left_on="id1", right_on="id0").join(two, left_on="id1", right_on="id2")
    assert join_usage(joined.joins) == join_usage(joined.joins, exact=True) == {0: 2, 1: 2, 2: 1}
    # 0 and 1 tie on joins; the larger one of them wins
    assert fact_table_id(joined.df, joined.sources, joined.joins) == 0
    only = (one.filter(F.lit(False)), two)
    snow = fact.join(only[1], left_on="id1", right_on="id2")
    assert fact_table_id(snow.df, snow.sources, snow.joins) == 2


def test_fact_table_from_order_of_reading(spark):
    a, b = source(spark, 5, 4), source(spark, 3, 4)
    joined = a.join(b, left_on="id5", right_on="id3")
    assert fact_table_id(joined.df, joined.sources, joined.joins) == 3


def test_fact_table_without_joins_or_without_candidate(spark):
    a, b = source(spark, 0, 4), source(spark, 1, 6)
    both = a.select().union(b.select())
    assert fact_table_id(both.df, both.sources, both.joins) == 1
    twice = both.union(both)
    with pytest.raises(ValueError):
        fact_table_id(twice.df, twice.sources, twice.joins)


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, f"2020-{1 + i % 12:02d}-01", float(i % 5), "ab"[i % 2], float(i % 7 > 2)) for i in range(400)]
    fact = track(spark.createDataFrame(rows, "id long, day string, stars double, kind string, good double"), 0, "reviews", key="id")
    kinds = track(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n long, kind string"), 1, "kinds", key="n")
    return fact.join(kinds, on="kind")


def build(reviews, overlap=False, **options):
    train, test = temporal_split(reviews, "day", "2020-09-01", overlap)
    plan = FeaturePlan([FeatureBlock(["stars"], [StandardScale()]), FeatureBlock(["kind"], [OneHot()])])
    options = options or {"prediction": F.col("stars") > 2}
    return build_classification(train, test, plan, F.col("good"), **options)


def test_outputs_and_sources(reviews):
    pipeline = build(reviews)
    assert [(s.source_id, s.role, s.name) for s in pipeline.sources("test")] == [
        (0, "Entities", "reviews"), (1, "SideData", "kinds")
    ]
    x = pipeline.output("X_train")
    assert x.columns == ["lineage", "features"]
    assert all(r["features"]["size"] == 3 for r in x.collect())
    assert pipeline.output("y_pred").count() == pipeline.output("y_test").count() == pipeline.output("X_test").count()
    with pytest.raises(ValueError):
        pipeline.output("z")
    pipeline.release()


def test_nothing_is_fitted_before_features_are_asked_for(spark, reviews, monkeypatch):
    fitted = []
    fit = FeaturePlan.fit
    monkeypatch.setattr(FeaturePlan, "fit", lambda plan, rows: fitted.append(plan) or fit(plan, rows))
    pipeline = build(reviews, overlap=True)
    screen(pipeline, ["label_shift", "traintest_overlap"], [InputUsage(), FairnessMetrics("kind", "a")])
    assert pipeline.fact_id("train") == 0 and pipeline.output("y_train").count() > 0
    assert fitted == []
    assert pipeline.output("X_test").count() == pipeline.output("y_test").count()
    pipeline.output("X_train").count()
    assert len(fitted) == 1
    pipeline.release()


def test_missing_predictions_are_an_error(reviews):
    train, test = temporal_split(reviews, "day", "2020-09-01")
    plan = FeaturePlan([FeatureBlock(["stars"], [StandardScale()])])
    pipeline = build_classification(train, test, plan, F.col("good"), cache=False)
    with pytest.raises(ValueError):
        pipeline.output("y_pred")


def test_model_predictions_stay_beside_their_rows(reviews):
    pipeline = build(reviews, fit=lambda rows: fit_linear(rows, "l2"))
    assert pipeline.model is not None
    assert set(r["prediction"] for r in pipeline.output("y_pred").collect()) <= {0.0, 1.0}
    pipeline.release()


def test_screening_order_gate_and_unknown_names(spark, reviews):
    report = screen(build(reviews, overlap=True), ["traintest_overlap", "label_shift", "constant_features"])
    assert [i.id for i in report.issues] == ["constant_features", "label_shift", "traintest_overlap"]
    assert not report.passes
    with pytest.raises(ScreeningFailed, match="both train and test"):
        report.assert_passes()
    rows = {r["issue"]: r["is_present"] for r in report.to_dataframe(spark).collect()}
    assert rows == {"constant_features": False, "label_shift": False, "traintest_overlap": True}
    clean = screen(build(reviews), ["traintest_overlap", "unnormalised_features"])
    clean.assert_passes()
    assert screen(build(reviews), None).issues == []
    with pytest.raises(ValueError):
        screen(build(reviews), ["label_shfit"])


def test_run_tables_and_reloaded_pipeline(spark, reviews, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    run = store.start("reviews", {"split_date": "2020-09-01"})
    other = store.start("reviews")
    pipeline = build(reviews)
    run.save(pipeline)
    screen(
        pipeline,
        ["label_shift"],
        [InputUsage(), DataValuation(3, 5), FairnessMetrics("kind", "a"), FairnessMetrics("kind", "B")],
        run,
    )
    tags = {r["key"]: r["value"] for r in store.table("tags", run.run_id).collect()}
    assert tags["series"] == "reviews" and tags["issues.label_shift.is_present"] == "false"
    assert tags["data_valuation.k"] == "3" and tags["input_usage.source.1.source_type"] == "SideData"
    metrics = {r["key"]: r["value"] for r in store.table("metrics", run.run_id).collect()}
    assert len(metrics) == 20 and "fairness.kind.not.b.false_negative_rate" in metrics
    params = {r["key"]: r["value"] for r in store.table("params", run.run_id).collect()}
    assert params["argument.split_date"] == "2020-09-01"
    assert params["train_source.0.num_records"] == "400"
    assert dict(pipeline_profile(pipeline)).items() <= params.items()
    assert run.read_table("input-1-with-usage").filter("is_used").count() == 2
    assert run.read_table("input-with-shapley-values").count() == 400

    loaded = store.load(run.run_id)
    assert sorted(map(tuple, loaded.outputs.select(pipeline.outputs.columns).collect())) == sorted(
        map(tuple, pipeline.outputs.collect())
    )
    assert loaded.fact_source("train").name == "reviews"
    assert lineages(loaded.sources("train")[1].rows) == ["1:1", "1:2", "1:3"]
    again = screen(loaded, ["label_shift"]).issues[0]
    assert again.details == screen(pipeline, ["label_shift"]).issues[0].details
    with pytest.raises(ValueError):
        store.load(other.run_id)
    pipeline.release()


def test_reloaded_joins_and_half_written_runs(spark, reviews, tmp_path, monkeypatch):
    fact, one, two = source(spark, 1, 4), source(spark, 0, 9), source(spark, 2, 9)
    joined = fact.join(one.filter(F.lit(False)), left_on="id1", right_on="id0").union(fact.join(one, left_on="id1", right_on="id0"))
    joined = joined.join(two, left_on="id1", right_on="id2").with_column("day", F.col("id1"))
    train, test = temporal_split(joined, "day", 2)
    plan = FeaturePlan([FeatureBlock(["id1"], [StandardScale()])])
    pipeline = build_classification(train, test, plan, F.col("id1") > 1, prediction=F.col("id1") > 0, cache=False)
    store = RunStore(spark, str(tmp_path / "runs"))
    run = store.start("joins")
    assert store.saved_runs().count() == 0

    def stop(*_):
        raise RuntimeError("executor lost")

    from plumbline.plans import run_store

    profile = run_store.pipeline_profile
    monkeypatch.setattr(run_store, "pipeline_profile", stop)
    with pytest.raises(RuntimeError):
        run.save(pipeline)  # all tables are there, but not the manifest
    assert store.saved_runs().count() == 0
    for read in (lambda: store.load(run.run_id), lambda: store.features(run.run_id, "train")):
        with pytest.raises(ValueError, match="no pipeline"):
            read()
    monkeypatch.setattr(run_store, "pipeline_profile", profile)
    run.save(pipeline)
    loaded = store.load(run.run_id)
    assert loaded.outputs.count() == pipeline.outputs.count() == 4  # not twice
    usage = join_usage(pipeline.joins, exact=True)
    assert usage == join_usage(loaded.joins, exact=True) != join_usage(loaded.joins)
    assert join_usage(pipeline.joins) == join_usage(loaded.joins)
    assert loaded.preprocessing == pipeline.preprocessing
    assert [r["series"] for r in store.saved_runs("joins").collect()] == ["joins"]
    assert store.saved_runs("other").count() == 0
    monkeypatch.setattr(run_store, "VERSION", 3)
    with pytest.raises(ValueError, match="version 2"):
        store.load(run.run_id)


def test_splits_of_one_frame_are_read_in_one_pass(reviews):
    def unions(pipeline):
        return pipeline.outputs._jdf.queryExecution().analyzed().toString().count("Union")

    for overlap in (False, True):
        train, test = temporal_split(reviews, "day", "2020-09-01", overlap)
        plan = FeaturePlan([FeatureBlock(["stars"], [StandardScale()])])
        once = build_classification(train, test, plan, F.col("good"))
        twice = build_classification(train, test, plan, F.col("good"), cache=False)
        assert (unions(once), unions(twice)) == (0, 1)
        rounded = F.round(F.get("features", F.lit(0)), 9)
        rows = [sorted(map(tuple, p.outputs.select("split", "lineage", "label", rounded).collect())) for p in (once, twice)]
        assert rows[0] == rows[1]
        once.release()

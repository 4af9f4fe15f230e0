"""What runs leave behind: refined inputs, tags and metrics, reports; labels of splits that differ; fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.features import FeatureBlock, FeaturePlan, StandardScale
from plumbline.functions import binarize
from plumbline.issues import CovariateShift
from plumbline.operators import LINEAGE, row_id_of, temporal_split
from plumbline.plans import RunStore, build_classification, fit_linear, fit_network, screen
from plumbline.refinements import DataValuation, FairnessMetrics, InputUsage
from plumbline.session import fresh_path

from .bindings import ORDERS, SPLIT_DATE, STAR_SQL, moment, orders_pipeline, orders_star, vector_pipeline
from .refinement_queries import COUNTS, FAIRNESS_SQL, SHAPLEY_SQL
from .registry import query


def _run(spark, pipeline, series, detect=(), refine=()):
    run = RunStore(spark, fresh_path(spark, "runs")).start(series, {"split_date": SPLIT_DATE})
    report = screen(pipeline, detect, refine, run)
    return run, report


@query(
    "refined_inputs",
    f"""
    WITH {STAR_SQL}
    SELECT c_custkey, c_name, c_acctbal, c_custkey IN (SELECT c_custkey FROM star WHERE split = 'train') AS is_used
    FROM customer
    """,
)
def refined_inputs(spark, folder):
    """The customers as the refinement wrote them to the run's folder."""
    run, _ = _run(spark, orders_pipeline(spark, folder, cache=False), "orders", refine=[InputUsage()])
    return run.read_table("input-1-with-usage").select("c_custkey", "c_name", "c_acctbal", "is_used")


@query(
    "refined_valuation",
    SHAPLEY_SQL.format(k=3, m=20)
    + """
    SELECT vec_id, label, round(coalesce(value, 0.0), 9)::DOUBLE AS shapley_value
    FROM embeddings LEFT JOIN shapley ON vec_id = key
    """,
)
def refined_valuation(spark, folder):
    """The entity table with its values as written to the run's folder."""
    run, _ = _run(spark, vector_pipeline(spark, folder), "vectors", refine=[DataValuation(3, 20)])
    written = run.read_table("input-with-shapley-values")
    return written.select("vec_id", "label", F.round("shapley_value", 9).alias("shapley_value"))


@query(
    "run_tags",
    """
    SELECT * FROM (VALUES
      ('series', 'orders'),
      ('issues.traintest_overlap.is_present', 'false'),
      ('issues.traintest_overlap.details', '{"num_overlapping_records": 0}'),
      ('input_usage.source.0.operator_id', '0'), ('input_usage.source.0.source_type', 'Entities'),
      ('input_usage.source.1.operator_id', '1'), ('input_usage.source.1.source_type', 'SideData'),
      ('input_usage.source.2.operator_id', '2'), ('input_usage.source.2.source_type', 'SideData'),
      ('input_usage.source.3.operator_id', '3'), ('input_usage.source.3.source_type', 'SideData')) AS t(key, value)
    WHERE (SELECT count(*) FROM orders) > 0
    """,
)
def run_tags(spark, folder):
    pipeline = orders_pipeline(spark, folder, cache=False)
    run, _ = _run(spark, pipeline, "orders", ["traintest_overlap"], [InputUsage()])
    return run.store.table("tags", run.run_id).select("key", "value")


@query(
    "run_metrics",
    FAIRNESS_SQL.format(attribute="o_orderstatus", value="F")
    + f"""
    SELECT 'fairness.o_orderstatus.' || CASE WHEN non_protected THEN '' ELSE 'not.' END || 'f.' || name AS key, value::DOUBLE AS value
    FROM (UNPIVOT (SELECT {COUNTS} FROM rates) ON {COUNTS.removeprefix("non_protected, ")} INTO NAME name VALUE value)
    """,
)
def run_metrics(spark, folder):
    """The counts that the fairness refinement logged as metrics of its run."""
    run, _ = _run(spark, orders_pipeline(spark, folder, cache=False), "orders", refine=[FairnessMetrics("o_orderstatus", "F")])
    return run.store.table("metrics", run.run_id).filter(~F.col("key").endswith("rate")).select("key", "value")


@query(
    "screen_refinements",
    f"""
    WITH {STAR_SQL}
    SELECT 0::INTEGER AS place, 'InputUsage' AS refinement, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)
           + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n_rows
    UNION ALL SELECT 1, 'FairnessMetrics', 10
    UNION ALL SELECT 2, 'FairnessMetrics', 10 FROM (SELECT count(*) AS n FROM star) WHERE n > 0
    """,
)
def screen_refinements(spark, folder):
    """Refinements run in the order of the plan, the same one also twice, after the detectors that were asked for."""
    plan = [InputUsage(), FairnessMetrics("o_orderstatus", "F"), FairnessMetrics("c_mktsegment", "BUILDING")]
    report = screen(orders_pipeline(spark, folder, cache=False), [], plan)
    rows = []
    for place, (refinement, result) in enumerate(zip(plan, report.refined)):
        frames = [s.rows for s in result] if isinstance(result, list) else [result]
        rows.append((place, type(refinement).__name__, sum(f.count() for f in frames)))
    return spark.createDataFrame(rows, "place int, refinement string, n_rows bigint")


@query(
    "screen_dispatch",
    """
    SELECT * FROM (VALUES (0::INTEGER, 'label_shift'), (1, 'traintest_overlap')) AS t(place, issue)
    WHERE (SELECT count(*) FROM orders) > 0
    """,
)
def screen_dispatch(spark, folder):
    """Detectors are found by name and run in their own order, however they are named."""
    report = screen(orders_pipeline(spark, folder, cache=False), ["traintest_overlap", "label_shift"])
    return spark.createDataFrame([(i, issue.id) for i, issue in enumerate(report.issues)], "place int, issue string")


@query(
    "labels_per_split",
    f"""
    WITH {STAR_SQL}
    SELECT o_orderkey AS row_id, split, CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM star
    """,
)
def labels_per_split(spark, folder):
    """The test rows spell their classes with a dot, so each split has classes of its own."""
    frame = orders_star(spark, folder).with_column(
        "price_class", F.when(F.col("o_totalprice") > 250000, F.lit(">250K")).otherwise(F.lit("<=250K"))
    )
    train, test = temporal_split(frame, "o_orderdate", moment(SPLIT_DATE))
    test = test.with_column("price_class", F.concat("price_class", F.lit(".")))
    price = F.col("price_class")
    labels = binarize(price, ["<=250K", ">250K"]), binarize(price, ["<=250K.", ">250K."])
    plan = FeaturePlan([FeatureBlock(["c_acctbal"], [StandardScale()])])
    rows = build_classification(train, test, plan, labels, cache=False).rows
    return rows.select(row_id_of(F.col(LINEAGE), ORDERS).alias("row_id"), "split", "label")


# The label is a threshold of one feature; what a model must say of rows far from it is known.
SEPARABLE_SQL = f"""
WITH {STAR_SQL}
SELECT o_orderkey AS row_id, CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
FROM star WHERE split = 'test' AND abs(o_totalprice - 250000) > 60000
"""


def _separable(spark, folder, fit):
    plan = FeaturePlan([FeatureBlock(["o_totalprice"], [StandardScale()])])
    train, test = temporal_split(orders_star(spark, folder), "o_orderdate", moment(SPLIT_DATE))
    label = F.col("o_totalprice") > 250000
    pipeline = build_classification(train, test, plan, label, fit, carry=["o_totalprice"])
    far = pipeline.split("test").filter(F.abs(F.col("o_totalprice") - 250000) > 60000)
    return far.select(row_id_of(F.col(LINEAGE), ORDERS).alias("row_id"), "prediction")


@query("linear_fit_separable", SEPARABLE_SQL)
def linear_fit_separable(spark, folder):
    return _separable(spark, folder, fit_linear)


@query("network_fit_separable", SEPARABLE_SQL)
def network_fit_separable(spark, folder):
    return _separable(spark, folder, lambda train: fit_network(train, (8,)))


@query(
    "covariate_shift_verdicts",
    """
    SELECT planted, planted AS is_present, 0.7::DOUBLE AS auc_threshold, 0.2::DOUBLE AS test_size
    FROM (SELECT unnest([false, true]) AS planted) WHERE (SELECT count(*) FROM orders) > 0
    """,
)
def covariate_shift_verdicts(spark, folder):
    """The verdicts on the orders as they are, and with a unit error in the test rows."""
    rows = []
    for planted in (False, True):
        change = (lambda t: t.scale_column("c_acctbal", 10.0)) if planted else None
        pipeline = orders_pipeline(spark, folder, change_test=change)
        issue = CovariateShift(trees=20, depth=6).detect(pipeline)
        pipeline.release()
        rows.append((planted, issue.is_present, issue.details["auc_threshold"], issue.details["test_size"]))
    return spark.createDataFrame(rows, "planted boolean, is_present boolean, auc_threshold double, test_size double")

"""Tracked test tables, and the pipelines over them that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.features import ArrayFeature, FeatureBlock, FeaturePlan, HashNgrams, OneHot, StandardScale
from plumbline.functions import binarize
from plumbline.operators import Tracked, random_split, temporal_split, track
from plumbline.sources import spread
from plumbline.plans import ClassificationPipeline, build_classification

SPLIT_DATE = "1999-12-31"
LEAK_DATE = "1999-06-01"
ORDERS, CUSTOMER, NATION, REGION = 0, 1, 2, 3
DOCUMENTS, LABELS, EMBEDDINGS, EVENTS = 4, 5, 6, 7
KEYS = {
    "orders": (ORDERS, "o_orderkey"),
    "customer": (CUSTOMER, "c_custkey"),
    "nation": (NATION, "n_nationkey"),
    "region": (REGION, "r_regionkey"),
    "documents": (DOCUMENTS, "doc_id"),
    "labels": (LABELS, "doc_id"),
    "embeddings": (EMBEDDINGS, "vec_id"),
    "events": (EVENTS, "event_id"),
}

# The same star in SQL; the lineage of a row is its four keys.
STAR_SQL = """
star AS (
  SELECT *, CASE WHEN o_orderdate <= TIMESTAMP '1999-12-31' THEN 'train' ELSE 'test' END AS split,
         CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END AS label,
         CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END AS prediction
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

# Every (source, row) of every lineage, repeats included.
PAIRS_SQL = """
pairs AS (
  SELECT split, 0 AS operator_id, o_orderkey AS row_id FROM star
  UNION ALL SELECT split, 1, c_custkey FROM star
  UNION ALL SELECT split, 2, n_nationkey FROM star
  UNION ALL SELECT split, 3, r_regionkey FROM star
)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tracked(spark: SparkSession, folder: str, name: str, spread_rows: bool = False) -> Tracked:
    source_id, key = KEYS[name]
    rows = table(spark, folder, name)
    return track(spread(rows, key) if spread_rows else rows, source_id, name, key=key)


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def orders_star(spark: SparkSession, folder: str, spread_rows: bool = False) -> Tracked:
    """Orders with their customer, nation and region."""
    return (
        tracked(spark, folder, "orders", spread_rows)
        .join(tracked(spark, folder, "customer"), left_on="o_custkey", right_on="c_custkey", shuffled=True)
        .join(tracked(spark, folder, "nation"), left_on="c_nationkey", right_on="n_nationkey")
        .join(tracked(spark, folder, "region"), left_on="n_regionkey", right_on="r_regionkey")
    )


def orders_features() -> FeaturePlan:
    return FeaturePlan(
        [
            FeatureBlock(["c_acctbal"], [StandardScale()]),
            FeatureBlock(["c_mktsegment", "o_orderpriority"], [OneHot()]),
        ]
    )


def orders_pipeline(
    spark: SparkSession,
    folder: str,
    features: FeaturePlan | None = None,
    fit=None,
    change_test=None,
    cache: bool = True,
) -> ClassificationPipeline:
    """Predict expensive orders; split by date. ``change_test`` may plant an error in the test rows."""
    train, test = temporal_split(
        orders_star(spark, folder, spread_rows=True), "o_orderdate", moment(SPLIT_DATE)
    )
    if change_test is not None:
        test = change_test(test)
    is_expensive = binarize(F.col("o_totalprice") > 250000, [False, True])
    rule = None if fit is not None else (F.col("c_acctbal") > 5000)
    return build_classification(
        train, test, features or orders_features(), is_expensive, fit, rule, cache=cache
    )


def leaky_pipeline(spark: SparkSession, folder: str) -> ClassificationPipeline:
    """One day of orders ends up in both splits."""
    joined = tracked(spark, folder, "orders").join(
        tracked(spark, folder, "customer"), left_on="o_custkey", right_on="c_custkey"
    )
    train, test = temporal_split(joined, "o_orderdate", moment(LEAK_DATE), overlap=True)
    plan = FeaturePlan([FeatureBlock(["c_acctbal"], [StandardScale()])])
    return build_classification(train, test, plan, F.col("o_totalprice") > 250000, cache=False)


def labelled_documents(spark: SparkSession, folder: str) -> Tracked:
    documents = tracked(spark, folder, "documents", spread_rows=True)
    return documents.join(tracked(spark, folder, "labels"), on="doc_id")


def text_pipeline(spark: SparkSession, folder: str, fit) -> ClassificationPipeline:
    """Predict the quality label from hashed n-grams of the whole text."""
    train, test = random_split(labelled_documents(spark, folder), 0.2, seed=7)
    plan = FeaturePlan(
        [FeatureBlock(["text"], [HashNgrams()]), FeatureBlock(["lang"], [OneHot()])]
    )
    return build_classification(train, test, plan, F.col("quality") == 1, fit)


def vector_pipeline(spark: SparkSession, folder: str) -> ClassificationPipeline:
    """Embeddings as features; the label tells high class numbers from low ones."""
    train, test = random_split(tracked(spark, folder, "embeddings", True), 0.2, seed=1337)
    plan = FeaturePlan([FeatureBlock(["embedding"], [ArrayFeature()])])
    return build_classification(train, test, plan, F.col("label") >= 5)


def events_pipeline(spark: SparkSession, folder: str, start: str) -> ClassificationPipeline:
    """Predict purchases from the event's value and its hour, from a start date on."""
    events = tracked(spark, folder, "events", True).filter_between("ts", low=moment(start))
    events = events.with_column("hour", F.hour("ts"))
    train, test = random_split(events, 0.2, seed=3, exact=False)
    plan = FeaturePlan([FeatureBlock(["value", "hour"], [StandardScale()])])
    return build_classification(train, test, plan, F.col("event_type") == "purchase")

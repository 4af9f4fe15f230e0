"""Usage of inputs, Shapley values and fairness counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import LINEAGE, row_id_of
from plumbline.refinements import DataValuation, FairnessMetrics, InputUsage, fairness_metric_rows
from plumbline.refinements.fairness import group_membership

from .bindings import EMBEDDINGS, ORDERS, STAR_SQL, orders_pipeline, tracked, vector_pipeline
from .registry import query


@query(
    "input_usage",
    """
    WITH train_customers AS (
      SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= TIMESTAMP '1999-12-31'
    )
    SELECT o_orderkey AS row_id, o_orderdate <= TIMESTAMP '1999-12-31' AND c_custkey IS NOT NULL AS is_used,
           0::INTEGER AS source_id
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31'), 1
    FROM customer
    UNION ALL
    SELECT n_nationkey, n_nationkey IN (SELECT c_nationkey FROM train_customers), 2 FROM nation
    UNION ALL
    SELECT r_regionkey, r_regionkey IN (SELECT n_regionkey FROM nation JOIN train_customers ON n_nationkey = c_nationkey), 3
    FROM region
    """,
)
def input_usage(spark, folder):
    """All rows of the four sources with the flag that says whether X_train used them; one scan of the star."""
    refined = InputUsage().compute(orders_pipeline(spark, folder, cache=False))
    parts = [
        s.rows.select(
            row_id_of(F.col(LINEAGE), s.source_id).alias("row_id"),
            "is_used",
            F.lit(s.source_id).alias("source_id"),
        )
        for s in refined
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "input_usage_summary",
    f"""
    WITH {STAR_SQL},
    train AS (SELECT * FROM star WHERE split = 'train')
    SELECT 0::INTEGER AS source_id, count(DISTINCT o_orderkey) AS used, (SELECT count(*) FROM orders) AS total FROM train
    UNION ALL SELECT 1, count(DISTINCT c_custkey), (SELECT count(*) FROM customer) FROM train
    UNION ALL SELECT 2, count(DISTINCT n_nationkey), (SELECT count(*) FROM nation) FROM train
    UNION ALL SELECT 3, count(DISTINCT r_regionkey), (SELECT count(*) FROM region) FROM train
    """,
)
def input_usage_summary(spark, folder):
    pipeline = orders_pipeline(spark, folder)
    parts = [
        s.rows.agg(
            F.lit(s.source_id).alias("source_id"),
            F.count_if("is_used").alias("used"),
            F.count("*").alias("total"),
        )
        for s in InputUsage().compute(pipeline)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


SHAPLEY_SQL = """
WITH split AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, label >= 5 AS y,
         row_number() OVER (ORDER BY md5('1337:6:' || vec_id), vec_id) <= ceil(0.2 * count(*) OVER ()) AS test
  FROM embeddings
),
train AS (SELECT * FROM split WHERE NOT test),
sample AS (SELECT * FROM split WHERE test ORDER BY vec_id LIMIT {m}),
ranked AS (
  SELECT s.vec_id AS t, train.vec_id AS key, CASE WHEN train.y = s.y THEN 1.0 ELSE 0.0 END AS e,
         row_number() OVER (PARTITION BY s.vec_id ORDER BY list_distance(train.x, s.x), train.vec_id) AS i,
         count(*) OVER (PARTITION BY s.vec_id) AS n
  FROM train, sample s
),
steps AS (
  SELECT t, key, i,
         CASE WHEN i = n THEN e / n
              ELSE (e - lead(e) OVER (PARTITION BY t ORDER BY i)) / {k} * least(i, {k}) / i END AS d
  FROM ranked
),
scores AS (SELECT t, key, sum(d) OVER (PARTITION BY t ORDER BY i DESC) AS s FROM steps),
shapley AS (SELECT key, sum(s) / {m} AS value FROM scores GROUP BY key)
"""


def _shapley_values(spark, folder, k: int, samples: int):
    return DataValuation(k, samples).values(vector_pipeline(spark, folder))


@query(
    "knn_shapley",
    SHAPLEY_SQL.format(k=1, m=10) + "SELECT key, round(value, 9)::DOUBLE AS shapley_value FROM shapley",
)
def knn_shapley(spark, folder):
    values = _shapley_values(spark, folder, 1, 10)
    return values.select("key", F.round("shapley_value", 9).alias("shapley_value"))


@query(
    "knn_shapley_ten_neighbours",
    SHAPLEY_SQL.format(k=10, m=100) + "SELECT key, round(value, 9)::DOUBLE AS shapley_value FROM shapley",
)
def knn_shapley_ten_neighbours(spark, folder):
    values = _shapley_values(spark, folder, 10, 100)
    return values.select("key", F.round("shapley_value", 9).alias("shapley_value"))


@query(
    "shapley_on_source",
    SHAPLEY_SQL.format(k=1, m=10)
    + """
    SELECT vec_id, label, round(coalesce(value, 0.0), 9)::DOUBLE AS shapley_value
    FROM embeddings LEFT JOIN shapley ON vec_id = key
    """,
)
def shapley_on_source(spark, folder):
    refined = DataValuation().compute(vector_pipeline(spark, folder))
    return refined.data.select("vec_id", "label", F.round("shapley_value", 9).alias("shapley_value"))


@query(
    "group_membership",
    """
    SELECT o_orderkey AS row_id, nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM 'F' AS non_protected FROM orders
    """,
)
def membership(spark, folder):
    orders = tracked(spark, folder, "orders").with_column(
        "o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))
    )
    return group_membership(orders.df, ORDERS, "o_orderstatus", "F")


FAIRNESS_SQL = f"""
WITH {STAR_SQL},
counts AS (
  SELECT {{attribute}} = '{{value}}' AS non_protected,
         count(*) FILTER (label = 1 AND prediction = 1) AS true_positives,
         count(*) FILTER (label = 1 AND prediction <> 1) AS false_negatives,
         count(*) FILTER (label <> 1 AND prediction = 1) AS false_positives,
         count(*) FILTER (label <> 1 AND prediction <> 1) AS true_negatives
  FROM star WHERE split = 'test' GROUP BY 1
),
rates AS (
  SELECT *, round(false_negatives / nullif(false_negatives + true_positives, 0), 9) AS false_negative_rate
  FROM counts
)
"""
COUNTS = "non_protected, true_positives, false_negatives, false_positives, true_negatives"


def _confusion(spark, folder, attribute: str, value: str):
    return FairnessMetrics(attribute, value).confusion(orders_pipeline(spark, folder, cache=False))


@query(
    "fairness_confusion",
    FAIRNESS_SQL.format(attribute="o_orderstatus", value="F") + f"SELECT {COUNTS} FROM rates",
)
def fairness_confusion(spark, folder):
    return _confusion(spark, folder, "o_orderstatus", "F").drop("false_negative_rate")


@query(
    "fairness_by_dimension",
    FAIRNESS_SQL.format(attribute="c_mktsegment", value="BUILDING") + f"SELECT {COUNTS} FROM rates",
)
def fairness_by_dimension(spark, folder):
    """The sensitive attribute stands in a dimension table."""
    return _confusion(spark, folder, "c_mktsegment", "BUILDING").drop("false_negative_rate")


@query(
    "fairness_fnr",
    FAIRNESS_SQL.format(attribute="o_orderstatus", value="F")
    + "SELECT non_protected, false_negative_rate FROM rates",
)
def fairness_fnr(spark, folder):
    rates = _confusion(spark, folder, "o_orderstatus", "F")
    return rates.select("non_protected", F.round("false_negative_rate", 9).alias("false_negative_rate"))


@query(
    "fairness_metrics_long",
    FAIRNESS_SQL.format(attribute="o_orderstatus", value="F")
    + """
    SELECT 'fairness.o_orderstatus.' || CASE WHEN non_protected THEN '' ELSE 'not.' END || 'f.' || name AS metric,
           value
    FROM (
      UNPIVOT (
        SELECT non_protected, true_positives::DOUBLE AS true_positives, false_negatives::DOUBLE AS false_negatives,
               false_positives::DOUBLE AS false_positives, true_negatives::DOUBLE AS true_negatives,
               false_negative_rate
        FROM rates
      ) ON true_positives, false_negatives, false_positives, true_negatives, false_negative_rate
      INTO NAME name VALUE value
    )
    """,
)
def fairness_metrics_long(spark, folder):
    metrics = fairness_metric_rows(_confusion(spark, folder, "o_orderstatus", "F"), "o_orderstatus", "F")
    return metrics.withColumn("value", F.round("value", 9))

"""Labels, feature encoders, models and the scores of models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plumbline.features import (
    Apply,
    ArrayFeature,
    FeatureBlock,
    FeaturePlan,
    ImputeMean,
    ImputeMode,
    OneHot,
    SafeLog,
    StandardScale,
    dense,
)
from plumbline.features.vectors import stored
from plumbline.functions import binarize, hashed_ngrams
from plumbline.operators import LINEAGE, row_id_of, temporal_split
from plumbline.plans import fit_linear, fit_network
from plumbline.plans.classification import accuracy
from plumbline.sources import spread

from .bindings import (
    ORDERS,
    SPLIT_DATE,
    STAR_SQL,
    moment,
    orders_pipeline,
    orders_star,
    table,
    text_pipeline,
    tracked,
    vector_pipeline,
)
from .registry import query

# Orders whose balance or segment is unknown in places, for the encoders that fill gaps.
GAPS_SQL = f"""
WITH {STAR_SQL},
gaps AS (
  SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
         nullif(c_mktsegment, 'BUILDING') AS segment
  FROM star
)"""


def with_gaps(spark, folder):
    frame = orders_star(spark, folder)
    frame = frame.with_column("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return frame.with_column("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))


def encoded(spark, folder, *blocks: FeatureBlock):
    """Fit on the training orders, apply to all: ``(o_orderkey, features)``."""
    frame = with_gaps(spark, folder)
    train, _ = temporal_split(frame, "o_orderdate", moment(SPLIT_DATE))
    return FeaturePlan(blocks).fit(train.df).transform(frame.df).select("o_orderkey", "features")


def first_value(df, name: str, digits: int = 6):
    return df.select("o_orderkey", F.round(F.get(dense(df), F.lit(0)), digits).alias(name))


def all_values(df):
    """Every position of every order, zeros included."""
    return df.select("o_orderkey", F.posexplode(dense(df)).alias("pos", "value"))


@query(
    "binarize_label",
    """
    SELECT doc_id, CASE WHEN nullif(lang, 'de') IS NOT DISTINCT FROM 'fr' THEN 1.0 ELSE 0.0 END::DOUBLE AS label
    FROM documents
    """,
)
def binarize_label(spark, folder):
    """The second class becomes 1, all else 0, nulls included."""
    lang = F.nullif(F.col("lang"), F.lit("de"))
    return table(spark, folder, "documents").select("doc_id", binarize(lang, ["en", "fr"]).alias("label"))


@query(
    "standard_scale",
    f"""
    WITH {STAR_SQL},
    fitted AS (SELECT avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS sd FROM star WHERE split = 'train')
    SELECT o_orderkey, round((c_acctbal - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS scaled
    FROM star, fitted
    """,
)
def standard_scale(spark, folder):
    return first_value(
        encoded(spark, folder, FeatureBlock(["c_acctbal"], [StandardScale()])), "scaled"
    )


@query(
    "standard_scale_nan",
    f"""
    WITH {STAR_SQL},
    planted AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_acctbal END AS known FROM star),
    fitted AS (SELECT avg(known) AS mean, stddev_pop(known) AS sd FROM planted WHERE split = 'train')
    SELECT o_orderkey, round((known - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS scaled
    FROM planted, fitted
    """,
)
def standard_scale_nan(spark, folder):
    """NaN in the fitted column is left out of the fit; its rows give NaN, shown as null."""
    missing = F.lit(float("nan"))
    planted = Apply(lambda c: F.when(F.col("o_orderkey") % 7 == 0, missing).otherwise(c))
    values = first_value(encoded(spark, folder, FeatureBlock(["c_acctbal"], [planted, StandardScale()])), "scaled")
    return values.withColumn("scaled", F.nanvl("scaled", F.lit(None)))


@query(
    "one_hot",
    f"""
    {GAPS_SQL},
    known AS (SELECT DISTINCT segment FROM gaps WHERE split = 'train'),
    placed AS (SELECT segment, (row_number() OVER (ORDER BY segment NULLS LAST) - 1)::INTEGER AS pos FROM known)
    SELECT o_orderkey, pos,
           CASE WHEN gaps.segment IS NOT DISTINCT FROM placed.segment THEN 1.0 ELSE 0.0 END::DOUBLE AS value
    FROM gaps, placed
    """,
)
def one_hot(spark, folder):
    return all_values(encoded(spark, folder, FeatureBlock(["segment"], [OneHot()])))


@query(
    "one_hot_wide",
    f"""
    WITH {STAR_SQL},
    placed AS (
      SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1)::INTEGER AS pos
      FROM (SELECT DISTINCT c_name FROM star WHERE split = 'train')
    ),
    width AS (SELECT count(*)::INTEGER AS width FROM placed)
    SELECT o_orderkey, width, pos, CASE WHEN pos IS NULL THEN NULL ELSE 1.0 END::DOUBLE AS value
    FROM star LEFT JOIN placed USING (c_name), width
    """,
)
def one_hot_wide(spark, folder):
    """As many categories as there are customers in the training rows: what each order holds of them."""
    features = encoded(spark, folder, FeatureBlock(["c_name"], [OneHot()]))
    entry = F.inline_outer(stored(features))
    return features.select("o_orderkey", F.col("features.size").alias("width"), entry)


NGRAMS_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents
), one AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), runs AS (
  SELECT doc_id, word, lead(word) OVER d AS second, lead(word, 2) OVER d AS third FROM one
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT doc_id, word AS gram FROM runs
  UNION ALL SELECT doc_id, word || ' ' || second FROM runs WHERE second IS NOT NULL
  UNION ALL SELECT doc_id, word || ' ' || second || ' ' || third FROM runs WHERE third IS NOT NULL
), codes AS (
  SELECT doc_id, ('0x' || substr(md5(gram), 1, 9))::BIGINT % 200 AS code FROM grams
), counts AS (
  SELECT doc_id, (code % 100)::INTEGER AS bucket, sum(CASE WHEN code < 100 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value
  FROM codes GROUP BY ALL
)"""


@query("hash_ngrams", NGRAMS_SQL + " SELECT doc_id, bucket, value FROM counts WHERE value <> 0")
def hash_ngrams(spark, folder):
    """Signed 1- to 3-gram counts of whole texts in 100 hash buckets."""
    counts = hashed_ngrams(F.col("text"), normalise=False)
    documents = spread(table(spark, folder, "documents"), "doc_id")
    return documents.select("doc_id", F.inline(counts).alias("bucket", "value"))


@query(
    "hash_ngrams_wide",
    NGRAMS_SQL.replace("% 200", "% 524288").replace("% 100", "% 262144").replace("< 100", "< 262144")
    + " SELECT doc_id, bucket, value FROM counts WHERE value <> 0",
)
def hash_ngrams_wide(spark, folder):
    """The same in 262,144 buckets: a text costs as many entries as it has n-grams."""
    counts = hashed_ngrams(F.col("text"), buckets=1 << 18, normalise=False)
    documents = spread(table(spark, folder, "documents"), "doc_id")
    return documents.select("doc_id", F.inline(counts).alias("bucket", "value"))


@query(
    "hash_ngrams_normalised",
    NGRAMS_SQL
    + """
    SELECT doc_id, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value
    FROM counts WHERE value <> 0
    """,
)
def hash_ngrams_normalised(spark, folder):
    return (
        spread(table(spark, folder, "documents"), "doc_id")
        .select("doc_id", F.inline(hashed_ngrams(F.col("text"))).alias("bucket", "value"))
        .withColumn("value", F.round("value", 6))
    )


@query(
    "impute_mode",
    f"""
    {GAPS_SQL},
    best AS (
      SELECT segment FROM gaps WHERE split = 'train' AND segment IS NOT NULL
      GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1
    )
    SELECT o_orderkey, coalesce(gaps.segment, best.segment) AS segment FROM gaps, best
    """,
)
def impute_mode(spark, folder):
    frame = with_gaps(spark, folder)
    train, _ = temporal_split(frame, "o_orderdate", moment(SPLIT_DATE))
    plan = FeaturePlan([FeatureBlock(["segment"], [ImputeMode()])])
    filled = plan.fit(train.df).parts[0].value
    return frame.df.select("o_orderkey", filled.alias("segment"))


@query(
    "impute_mean",
    f"""
    {GAPS_SQL}
    SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM gaps WHERE split = 'train')), 4) AS price
    FROM gaps
    """,
)
def impute_mean(spark, folder):
    return first_value(encoded(spark, folder, FeatureBlock(["price"], [ImputeMean()])), "price", 4)


@query(
    "safe_log",
    """
    SELECT c_custkey, round(CASE WHEN x = 0 THEN 0.0 WHEN x < 0 THEN 'NaN'::DOUBLE ELSE ln(x) END, 6) AS log_balance
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS x FROM customer)
    """,
)
def safe_log(spark, folder):
    from plumbline.functions import safe_log as safe

    x = F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal"))
    return table(spark, folder, "customer").select("c_custkey", F.round(safe(x), 6).alias("log_balance"))


@query(
    "normalise_array",
    """
    SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
           round(unnest(embedding)::DOUBLE / 255.0, 8) AS value
    FROM embeddings
    """,
)
def normalise_array(spark, folder):
    plan = FeaturePlan([FeatureBlock(["embedding"], [ArrayFeature(divisor=255.0)])])
    frame = tracked(spark, folder, "embeddings")
    features = plan.fit(frame.df).transform(frame.df)
    return features.select("vec_id", F.posexplode("features").alias("pos", "value")).withColumn(
        "value", F.round("value", 8)
    )


# Two imputed, logged and scaled numbers, then the one-hot block of an imputed category.
ASSEMBLED_SQL = f"""
{GAPS_SQL},
means AS (SELECT avg(price) AS price, avg(o_custkey) AS cust FROM gaps WHERE split = 'train'),
logged AS (
  SELECT o_orderkey, split, gaps.segment,
         ln(coalesce(gaps.price, means.price)) AS price,
         CASE WHEN o_custkey = 0 THEN 0.0 ELSE ln(o_custkey) END AS cust
  FROM gaps, means
),
stats AS (
  SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(cust) AS cm, stddev_pop(cust) AS cs
  FROM logged WHERE split = 'train'
),
best AS (
  SELECT segment FROM gaps WHERE split = 'train' AND segment IS NOT NULL
  GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1
),
known AS (
  SELECT segment, row_number() OVER (ORDER BY segment) + 1 AS pos
  FROM (SELECT DISTINCT segment FROM gaps WHERE split = 'train' AND segment IS NOT NULL)
),
assembled AS (
  SELECT o_orderkey, 0 AS pos, (price - pm) / ps AS value FROM logged, stats
  UNION ALL SELECT o_orderkey, 1, (cust - cm) / cs FROM logged, stats
  UNION ALL
  SELECT o_orderkey, known.pos,
         CASE WHEN coalesce(logged.segment, best.segment) = known.segment THEN 1.0 ELSE 0.0 END
  FROM logged, best, known
)
SELECT o_orderkey, pos::INTEGER AS pos, round(value, 6)::DOUBLE AS value FROM assembled
"""


@query("assemble_features", ASSEMBLED_SQL)
def assemble_features(spark, folder):
    features = encoded(
        spark,
        folder,
        FeatureBlock(["price", "o_custkey"], [ImputeMean(), SafeLog(), StandardScale()]),
        FeatureBlock(["segment"], [ImputeMode(), OneHot()]),
    )
    return all_values(features).withColumn("value", F.round("value", 6))


@query(
    "feature_matrix_long",
    """
    WITH split AS (
      SELECT *, row_number() OVER (ORDER BY md5('1337:6:' || vec_id), vec_id) <= ceil(0.2 * count(*) OVER ()) AS test
      FROM embeddings
    )
    SELECT vec_id AS row_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
           round(unnest(embedding)::DOUBLE, 6) AS value
    FROM split WHERE NOT test
    """,
)
def feature_matrix_long(spark, folder):
    """The X_train output with its lineage, one row per number."""
    features = vector_pipeline(spark, folder).output("X_train")
    return features.select(
        row_id_of(F.col(LINEAGE), 6).alias("row_id"), F.posexplode("features").alias("pos", "value")
    ).withColumn("value", F.round("value", 6))


@query(
    "apply_column_udf",
    f"WITH {STAR_SQL} SELECT o_orderkey, round(sqrt(o_totalprice) + 1, 6) AS custom FROM star",
)
def apply_column_udf(spark, folder):
    """A user's vectorised Python function inside a feature chain."""

    @F.pandas_udf("double")
    def custom(x: pd.Series) -> pd.Series:
        return x**0.5 + 1

    return first_value(
        encoded(spark, folder, FeatureBlock(["o_totalprice"], [Apply(custom)])), "custom"
    )


@query(
    "feature_row_counts",
    f"""
    WITH {STAR_SQL}
    SELECT split, count(*) AS n_rows, sum(label)::DOUBLE AS positives, sum(prediction)::DOUBLE AS predicted
    FROM star GROUP BY split
    """,
)
def feature_row_counts(spark, folder):
    pipeline = orders_pipeline(spark, folder, cache=False)
    return pipeline.predicted.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.sum("label").alias("positives"),
        F.sum("prediction").alias("predicted"),
    )


@query(
    "accuracy",
    f"""
    WITH {STAR_SQL}
    SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy
    FROM star WHERE split = 'test'
    """,
)
def accuracy_score(spark, folder):
    pipeline = orders_pipeline(spark, folder, cache=False)
    return accuracy(pipeline.predicted).select(F.round("accuracy", 6).alias("accuracy"))


def _predictions(pipeline, source_id: int):
    return pipeline.split("test").select(
        row_id_of(F.col(LINEAGE), source_id).alias("row_id"), "label", "prediction"
    )


@query("fit_predict")
def fit_predict(spark, folder):
    """Logistic regression with an L1 penalty on the orders star: test labels and predictions."""
    return _predictions(orders_pipeline(spark, folder, fit=fit_linear), ORDERS)


@query("fit_predict_l2")
def fit_predict_l2(spark, folder):
    """Logistic regression with an L2 penalty on hashed n-grams of whole texts."""
    pipeline = text_pipeline(spark, folder, fit=lambda train: fit_linear(train, "l2"))
    return _predictions(pipeline, 4)


@query("fit_predict_network")
def fit_predict_network(spark, folder):
    """A dense 256/64/2 network on the orders star."""
    pipeline = orders_pipeline(
        spark, folder, fit=lambda train: fit_network(train, (256, 64))
    )
    return _predictions(pipeline, ORDERS)

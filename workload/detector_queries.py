"""Fact-table decision, issue detectors, profile and the screening report."""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.features import Apply, FeatureBlock, FeaturePlan, OneHot, StandardScale, width
from plumbline.issues import (
    AUC_THRESHOLD,
    ConstantFeatures,
    CovariateShift,
    LabelShift,
    covariate_shift_between_runs,
    overlapping_rows,
    shared_lineages,
)
from plumbline.issues.features import MEAN_TOLERANCE, VARIANCE_TOLERANCE
from plumbline.issues.shift import RunRows, chi_square_2x2
from plumbline.operators import LINEAGE, balance_classes, lineage_text, roc_auc, temporal_split
from plumbline.plans import (
    RunStore,
    build_classification,
    join_usage,
    one_to_one_sources,
    pipeline_profile,
    screen,
    source_cardinalities,
)
from plumbline.plans.classification import feature_statistics
from plumbline.session import fresh_path

from .bindings import (
    PAIRS_SQL,
    SPLIT_DATE,
    STAR_SQL,
    events_pipeline,
    leaky_pipeline,
    moment,
    orders_features,
    orders_pipeline,
    orders_star,
    vector_pipeline,
)
from .registry import query

# Two scaled numbers, one of them spoilt; two one-hot blocks; and a constant.
STATS_SQL = f"""
WITH {STAR_SQL},
train AS (SELECT * FROM star WHERE split = 'train'),
fitted AS (SELECT avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS sd FROM train),
segments AS (
  SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) + 2 AS pos
  FROM (SELECT DISTINCT c_mktsegment FROM train)
),
long AS (
  SELECT 0 AS pos, (c_acctbal - mean) / sd AS x FROM train, fitted
  UNION ALL SELECT 1, o_totalprice FROM train
  UNION ALL SELECT 2, 7.0 FROM train
  UNION ALL SELECT s.pos, CASE WHEN t.c_mktsegment = s.c_mktsegment THEN 1.0 ELSE 0.0 END
  FROM train t, segments s
),
stats AS (
  SELECT pos::INTEGER AS pos, count(*) AS n, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1,
         min(x) AS low, max(x) AS high, avg(x) AS mean, var_pop(x) AS variance
  FROM long GROUP BY pos
)"""


def spoilt_pipeline(spark, folder):
    plan = FeaturePlan(
        [
            FeatureBlock(["c_acctbal"], [StandardScale()]),
            FeatureBlock(["o_totalprice"], []),
            FeatureBlock(["o_orderstatus"], [Apply(lambda c: F.lit(7.0))]),
            FeatureBlock(["c_mktsegment"], [OneHot()]),
        ]
    )
    return orders_pipeline(spark, folder, features=plan, cache=False)


@query(
    "fact_one_to_one",
    f"""
    WITH {STAR_SQL}, {PAIRS_SQL}
    SELECT operator_id::INTEGER AS operator_id FROM pairs WHERE split = 'train'
    GROUP BY operator_id HAVING count(*) = count(DISTINCT row_id)
    """,
)
def fact_one_to_one(spark, folder):
    return one_to_one_sources(orders_pipeline(spark, folder, cache=False).split_rows("train"))


@query(
    "fact_join_usage",
    """
    WITH one AS (SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
    two AS (SELECT * FROM one JOIN nation ON c_nationkey = n_nationkey),
    three AS (SELECT * FROM two JOIN region ON n_regionkey = r_regionkey),
    seen AS (
      SELECT 1 AS number, unnest([0, 1]) AS operator_id FROM one
      UNION SELECT 2, unnest([0, 1, 2]) FROM two
      UNION SELECT 3, unnest([0, 1, 2, 3]) FROM three
    )
    SELECT operator_id::INTEGER AS operator_id, count(*) AS joins FROM seen GROUP BY operator_id
    """,
)
def fact_join_usage(spark, folder):
    """Counted over the rows that the joins really give."""
    usage = join_usage(orders_star(spark, folder).joins, exact=True)
    return spark.createDataFrame(sorted(usage.items()), "operator_id int, joins bigint")


@query(
    "fact_cardinality",
    """
    SELECT 0::INTEGER AS operator_id, count(*) AS n_rows FROM orders
    UNION ALL SELECT 1, count(*) FROM customer
    UNION ALL SELECT 2, count(*) FROM nation
    UNION ALL SELECT 3, count(*) FROM region
    """,
)
def fact_cardinality(spark, folder):
    counts = source_cardinalities(orders_star(spark, folder).sources)
    return spark.createDataFrame(sorted(counts.items()), "operator_id int, n_rows bigint")


@query(
    "fact_table",
    f"""
    WITH {STAR_SQL}, {PAIRS_SQL},
    single AS (SELECT split, operator_id FROM pairs GROUP BY ALL HAVING count(*) = count(DISTINCT row_id)),
    sizes AS (
      SELECT 0 AS operator_id, count(*) AS n_rows FROM orders UNION ALL SELECT 1, count(*) FROM customer
      UNION ALL SELECT 2, count(*) FROM nation UNION ALL SELECT 3, count(*) FROM region
    )
    SELECT split, operator_id::INTEGER AS operator_id, n_rows FROM single JOIN sizes USING (operator_id)
    """,
)
def fact_table(spark, folder):
    pipeline = orders_pipeline(spark, folder, cache=False)
    rows = [(s, pipeline.fact_id(s), pipeline.fact_source(s).data.count()) for s in ("train", "test")]
    return spark.createDataFrame(rows, "split string, operator_id int, n_rows bigint")


@query("constant_features", STATS_SQL + " SELECT pos, low = high AS is_constant FROM stats")
def constant_features(spark, folder):
    stats = feature_statistics(spoilt_pipeline(spark, folder).split("train"))
    return stats.select("pos", (F.col("low") == F.col("high")).alias("is_constant"))


@query(
    "unnormalised_features",
    STATS_SQL
    + """,
    kinds AS (SELECT *, NOT (n0 + n1 = n AND n0 > 0 AND n1 > 0) AS non_binary FROM stats)
    SELECT pos, non_binary, non_binary AND abs(mean) > 1e-8 AS non_zero_mean,
           non_binary AND abs(variance - 1) > 1.001e-5 AS non_unit_variance
    FROM kinds
    """,
)
def unnormalised_features(spark, folder):
    stats = feature_statistics(spoilt_pipeline(spark, folder).split("train"))
    binary = (F.col("n_zero") + F.col("n_one") == F.col("n")) & (F.col("n_zero") > 0) & (F.col("n_one") > 0)
    return stats.select(
        "pos",
        (~binary).alias("non_binary"),
        (~binary & (F.abs("mean") > MEAN_TOLERANCE)).alias("non_zero_mean"),
        (~binary & (F.abs(F.col("variance") - 1) > VARIANCE_TOLERANCE)).alias("non_unit_variance"),
    )


LABEL_SHIFT_SQL = """
SELECT a::BIGINT AS train_positive, b::BIGINT AS train_negative, c::BIGINT AS test_positive,
       d::BIGINT AS test_negative, round(chi, 6) AS chi_square, chi > 10.827566170662733 AS is_present
FROM (
  SELECT *, (a + b + c + d) * greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0) ^ 2
            / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi
  FROM (
    SELECT count(*) FILTER (split = 'train' AND label = 1)::DOUBLE AS a,
           count(*) FILTER (split = 'train' AND label = 0)::DOUBLE AS b,
           count(*) FILTER (split = 'test' AND label = 1)::DOUBLE AS c,
           count(*) FILTER (split = 'test' AND label = 0)::DOUBLE AS d
    FROM labelled
  )
)"""


def _label_shift(spark, pipeline):
    counts = pipeline.label_counts
    cells = [counts[s].get(y, 0) for s in ("train", "test") for y in (1.0, 0.0)]
    issue = LabelShift().detect(pipeline)
    row = (*cells, round(chi_square_2x2(*map(float, cells)), 6), issue.is_present)
    return spark.createDataFrame(
        [row],
        "train_positive bigint, train_negative bigint, test_positive bigint, test_negative bigint, "
        "chi_square double, is_present boolean",
    )


@query("label_shift", f"WITH {STAR_SQL}, labelled AS (SELECT split, label FROM star) {LABEL_SHIFT_SQL}")
def label_shift(spark, folder):
    return _label_shift(spark, orders_pipeline(spark, folder, cache=False))


@query(
    "label_shift_planted",
    f"""
    WITH {STAR_SQL},
    ranked AS (
      SELECT split, o_totalprice > 400000 AS is_top, row_number() OVER (
        PARTITION BY split, o_totalprice > 400000
        ORDER BY md5('42:0:' || o_orderkey || ',1:' || c_custkey || ',2:' || n_nationkey || ',3:' || r_regionkey)
      ) AS r
      FROM star
    ),
    labelled AS (
      SELECT split, CASE WHEN is_top THEN 1.0 ELSE 0.0 END AS label FROM ranked
      WHERE split = 'train' OR is_top
         OR r <= (SELECT count(*) FROM ranked WHERE split = 'test' AND is_top)
    )
    {LABEL_SHIFT_SQL}
    """,
)
def label_shift_planted(spark, folder):
    """The test rows are resampled to equal class sizes, the training rows are not."""
    train, test = temporal_split(orders_star(spark, folder), "o_orderdate", moment(SPLIT_DATE))
    is_top = F.col("o_totalprice") > 400000
    test = balance_classes(test, is_top)
    return _label_shift(spark, build_classification(train, test, orders_features(), is_top, cache=False))


SHIFT_SCHEMA = "is_present boolean, auc double, auc_threshold double, test_size double"


def _covariate_shift(spark, pipeline):
    issue = CovariateShift().detect(pipeline)
    pipeline.release()
    return spark.createDataFrame([{"is_present": issue.is_present, **issue.details}], SHIFT_SCHEMA)


@query("covariate_shift")
def covariate_shift(spark, folder):
    """No shift: the forest cannot tell test orders from training orders."""
    return _covariate_shift(spark, orders_pipeline(spark, folder))


@query("covariate_shift_planted")
def covariate_shift_planted(spark, folder):
    """A unit error in the test rows."""
    return _covariate_shift(
        spark,
        orders_pipeline(spark, folder, change_test=lambda t: t.scale_column("c_acctbal", 10.0)),
    )


@query(
    "roc_auc",
    f"""
    WITH {STAR_SQL},
    per AS (SELECT c_acctbal AS s, sum(label) AS p, sum(1 - label) AS n FROM star GROUP BY c_acctbal),
    running AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM per)
    SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9)::DOUBLE AS auc FROM running
    """,
)
def roc_auc_exact(spark, folder):
    star = orders_star(spark, folder).df.withColumn("label", (F.col("o_totalprice") > 250000).cast("double"))
    return roc_auc(star, "c_acctbal", "label").select(F.round("auc", 9).alias("auc"))


@query(
    "train_test_overlap",
    """
    SELECT count(*) AS num_overlapping_records, count(*) > 0 AS is_present
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate = TIMESTAMP '1999-06-01'
    """,
)
def train_test_overlap(spark, folder):
    shared = shared_lineages(leaky_pipeline(spark, folder).rows)
    found = F.count("*")
    return shared.agg(found.alias("num_overlapping_records"), (found > 0).alias("is_present"))


@query(
    "overlap_rows",
    """
    SELECT '0:' || o_orderkey || ',1:' || c_custkey AS lineage, split
    FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('train'), ('test')) AS s(split)
    WHERE o_orderdate = TIMESTAMP '1999-06-01'
    """,
)
def overlap_rows(spark, folder):
    rows = overlapping_rows(leaky_pipeline(spark, folder).rows)
    return rows.select(lineage_text(F.col(LINEAGE)).alias("lineage"), "split")


@query(
    "runs_of_different_shape",
    f"""
    WITH {STAR_SQL},
    vectors AS (
      SELECT CASE WHEN row_number() OVER (ORDER BY md5('1337:6:' || vec_id), vec_id) <= ceil(0.2 * count(*) OVER ())
                  THEN 'test' ELSE 'train' END AS split,
             CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS label
      FROM embeddings
    ),
    width AS (
      SELECT 1 + count(DISTINCT c_mktsegment) + count(DISTINCT o_orderpriority) AS d FROM star WHERE split = 'train'
    )
    SELECT 'orders' AS series, split, count(*) AS n_rows, max(d)::INTEGER AS width, sum(label)::DOUBLE AS positives,
           '0:3,1:3,2:2,3:1' AS joins, 4 AS n_sources
    FROM star, width GROUP BY split
    UNION ALL
    SELECT 'vectors', split, count(*), 64, sum(label)::DOUBLE, '', 1 FROM vectors GROUP BY split
    """,
)
def runs_of_different_shape(spark, folder):
    """Two runs of one store, with sparse and dense features, read back; a third one that was not finished is not seen."""
    store = RunStore(spark, fresh_path(spark, "runs"))
    for series, make in (("orders", orders_pipeline), ("vectors", vector_pipeline)):
        pipeline = make(spark, folder)
        store.start(series).save(pipeline)
        pipeline.release()
    store.start("vectors").log_params({"stored.layout": "{}"})
    parts = []
    for saved in store.saved_runs().orderBy("series").collect():
        loaded = store.load(saved["run_id"])
        usage = ",".join(f"{i}:{n}" for i, n in sorted(join_usage(loaded.joins, exact=True).items()))
        parts.append(
            loaded.outputs.groupBy("split").agg(
                F.lit(saved["series"]).alias("series"),
                F.count("*").alias("n_rows"),
                F.max(width(loaded.outputs)).alias("width"),
                F.sum("label").alias("positives"),
                F.lit(usage).alias("joins"),
                F.lit(len(loaded.source_rows["train"])).alias("n_sources"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


RUN_STARTS = ("2024-01-01", "2024-01-08", "2024-01-15")


def _event_runs(spark, folder):
    """Stored runs of one pipeline with three start dates."""
    store = RunStore(spark, fresh_path(spark, "runs"))
    starts = {}
    for start in RUN_STARTS:
        run = store.start("events", {"start": start})
        pipeline = events_pipeline(spark, folder, start)
        run.save(pipeline)
        pipeline.release()
        starts[run.run_id] = start
    return store, starts


@query("covariate_shift_runs")
def covariate_shift_runs(spark, folder):
    """Training features of the stored runs, compared in pairs."""
    store, starts = _event_runs(spark, folder)
    found = covariate_shift_between_runs(store, list(starts))
    rows = [(starts[a], starts[b], auc, AUC_THRESHOLD, shifted) for a, b, auc, shifted in found]
    return spark.createDataFrame(
        rows, "run_a string, run_b string, auc double, auc_threshold double, is_present boolean"
    )


@query(
    "covariate_shift_run_rows",
    """
    WITH starts AS (SELECT unnest(['2024-01-01', '2024-01-08', '2024-01-15']) AS start),
    kept AS (
      SELECT start, count(*) AS n FROM events, starts
      WHERE ts >= start::TIMESTAMP AND md5('3:7:' || event_id) >= '33333333' GROUP BY start
    ),
    sizes AS (SELECT start, n, ceil(0.2 * n)::BIGINT AS held_out FROM kept)
    SELECT a.start AS run_a, b.start AS run_b, (a.n - a.held_out + b.n - b.held_out)::BIGINT AS n_fitted_on,
           (a.held_out + b.held_out)::BIGINT AS n_held_out, b.held_out AS n_held_out_b
    FROM sizes a JOIN sizes b ON a.start < b.start
    """,
)
def covariate_shift_run_rows(spark, folder):
    """What the forests of each pair of runs are fitted on and judged by."""
    store, starts = _event_runs(spark, folder)
    runs = RunRows(store, list(starts))
    parts = [
        runs.pair(a, b).agg(
            F.lit(starts[a]).alias("run_a"),
            F.lit(starts[b]).alias("run_b"),
            F.count_if(~F.col("held_out")).alias("n_fitted_on"),
            F.count_if("held_out").alias("n_held_out"),
            F.count_if(F.col("held_out") & (F.col("domain") == 1)).alias("n_held_out_b"),
        )
        for a, b in combinations(starts, 2)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "run_profile",
    f"""
    WITH {STAR_SQL},
    tables AS (
      SELECT 0 AS id, 'Entities' AS type, count(*) AS n,
             'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS attributes,
             'bigint,bigint,string,double,timestamp_ntz,string' AS types FROM orders
      UNION ALL SELECT 1, 'SideData', count(*), 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment',
             'bigint,string,int,double,string' FROM customer
      UNION ALL SELECT 2, 'SideData', count(*), 'n_nationkey,n_name,n_regionkey', 'int,string,int' FROM nation
      UNION ALL SELECT 3, 'SideData', count(*), 'r_regionkey,r_name', 'int,string' FROM region
    ),
    splits AS (SELECT * FROM (VALUES ('train'), ('test')) AS s(split)),
    width AS (
      SELECT 1 + count(DISTINCT c_mktsegment) + count(DISTINCT o_orderpriority) AS d FROM star WHERE split = 'train'
    )
    SELECT split || '_source.' || id || '.type' AS key, type AS value FROM tables, splits
    UNION ALL SELECT split || '_source.' || id || '.num_records', n::VARCHAR FROM tables, splits
    UNION ALL SELECT split || '_source.' || id || '.attributes', attributes FROM tables, splits
    UNION ALL SELECT split || '_source.' || id || '.attribute_types', types FROM tables, splits
    UNION ALL SELECT 'X_' || split || '.num_rows', count(*)::VARCHAR FROM star GROUP BY split
    UNION ALL SELECT 'X_' || split || '.num_features', d::VARCHAR FROM width, splits
    UNION ALL FROM (VALUES ('preprocessing.0.type', 'StandardScale'),
                           ('preprocessing.0.arguments', '{{"columns": "c_acctbal"}}'),
                           ('preprocessing.1.type', 'OneHot'),
                           ('preprocessing.1.arguments', '{{"columns": "c_mktsegment,o_orderpriority"}}'))
    """,
)
def run_profile(spark, folder):
    rows = pipeline_profile(orders_pipeline(spark, folder, cache=False))
    return spark.createDataFrame(rows, "key string, value string")


SCREENED = ("constant_features", "unnormalised_features", "label_shift", "traintest_overlap")


def screening(spark, folder):
    """The report over the spoilt pipeline, with the number of findings of each detector."""
    report = screen(spoilt_pipeline(spark, folder), SCREENED)
    findings = {
        "constant_features": lambda d: len(d["constant_feature_indices"]),
        "unnormalised_features": lambda d: len(
            set(d["non_zero_mean_features"]) | set(d["non_unit_variance_features"])
        ),
        "label_shift": lambda d: int(d["p_value"] < d["threshold"]),
        "traintest_overlap": lambda d: d["num_overlapping_records"],
    }
    rows = [(i.id, i.is_present, findings[i.id](i.details)) for i in report.issues]
    return spark.createDataFrame(rows, "issue string, is_present boolean, findings bigint")


query(
    "screening_report",
    STATS_SQL
    + f""",
    labelled AS (SELECT split, label FROM star),
    shift AS ({LABEL_SHIFT_SQL}),
    kinds AS (SELECT *, NOT (n0 + n1 = n AND n0 > 0 AND n1 > 0) AS non_binary FROM stats)
    SELECT 'constant_features' AS issue, count(*) > 0 AS is_present, count(*) AS findings FROM stats WHERE low = high
    UNION ALL
    SELECT 'unnormalised_features', count(*) > 0, count(*) FROM kinds
    WHERE non_binary AND (abs(mean) > 1e-8 OR abs(variance - 1) > 1.001e-5)
    UNION ALL SELECT 'label_shift', is_present, is_present::BIGINT FROM shift
    UNION ALL
    SELECT 'traintest_overlap', count(*) > 0, count(*) FROM (
      SELECT o_orderkey FROM star WHERE split = 'train' INTERSECT SELECT o_orderkey FROM star WHERE split = 'test'
    )
    """,
)(screening)


@query(
    "constant_feature_lists",
    STATS_SQL
    + """
    SELECT 'constant_features' AS issue, bool_or(low = high) AS is_present,
           to_json(list(pos ORDER BY pos) FILTER (low = high))::VARCHAR AS constant,
           to_json(list(pos ORDER BY pos) FILTER (low <> high))::VARCHAR AS others
    FROM stats
    """,
)
def constant_feature_lists(spark, folder):
    issue = ConstantFeatures().detect(spoilt_pipeline(spark, folder))
    lists = [
        json.dumps(issue.details[k], separators=(",", ":"))
        for k in ("constant_feature_indices", "nonconstant_feature_indices")
    ]
    return spark.createDataFrame(
        [(issue.id, issue.is_present, *lists)],
        "issue string, is_present boolean, constant string, others string",
    )

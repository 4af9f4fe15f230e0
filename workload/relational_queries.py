"""Sources, relational steps, samples and splits, each with the lineage of its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import positive_flag
from plumbline.operators import (
    LINEAGE,
    Tracked,
    balance_classes,
    lineage_pairs,
    lineage_text,
    random_split,
    row_id_of,
    sample_rows,
    temporal_split,
    track,
)
from plumbline.plans import RunStore
from plumbline.session import fresh_path
from plumbline.sources import FileRegister, file_position_ids
from plumbline.sources.identity import INDEX_BITS, ROW_ID

from .bindings import (
    LEAK_DATE,
    ORDERS,
    PAIRS_SQL,
    SPLIT_DATE,
    STAR_SQL,
    labelled_documents,
    moment,
    orders_pipeline,
    orders_star,
    table,
    tracked,
    vector_pipeline,
)
from .registry import query


def shown(frame: Tracked, *columns):
    """Columns and the lineage as text."""
    return frame.df.select(*columns, lineage_text(F.col(LINEAGE)).alias("lineage"))


@query("source_lineage", "SELECT o_orderkey, '0:' || o_orderkey AS lineage FROM orders")
def source_lineage(spark, folder):
    return shown(tracked(spark, folder, "orders"), "o_orderkey")


@query(
    "source_positions",
    """
    SELECT count(*) AS n, count(*) AS different, 5::BIGINT AS n_files, (sum(l_quantity))::BIGINT AS quantity FROM lineitem
    """,
)
def source_positions(spark, folder):
    """Row ids by file position over a table that has no short key, in five files."""
    path = fresh_path(spark, "lineitem")
    # a task for each file reads a fifth of all rows, and so no more columns than are asked for below
    table(spark, folder, "lineitem").select("l_quantity").repartition(5).write.parquet(path)
    rows = track(file_position_ids(spark, path), 8, "lineitem")
    row_id = row_id_of(F.col(LINEAGE), 8)
    return rows.df.agg(
        F.count("*").alias("n"),
        F.count_distinct(row_id).alias("different"),
        F.count_distinct(F.shiftright(row_id, INDEX_BITS)).alias("n_files"),
        F.sum("l_quantity").cast("bigint").alias("quantity"),
    )


@query(
    "source_positions_kept",
    """
    SELECT c_nationkey::INTEGER AS c_nationkey, count(*) AS n, count(*) AS unchanged FROM customer
    WHERE c_nationkey >= 8 GROUP BY 1
    """,
)
def source_positions_kept(spark, folder):
    """Customers whose row ids are the same before and after files that sort first were added."""
    path, customers = fresh_path(spark, "customers"), table(spark, folder, "customer")
    register = FileRegister(spark, fresh_path(spark, "register"))
    customers.filter("c_nationkey >= 8").repartition(3).write.parquet(f"{path}/later")
    before = file_position_ids(spark, f"{path}/later", register).select("c_custkey", F.col(ROW_ID).alias("before"))
    landed = fresh_path(spark, "before")
    before.write.parquet(landed)
    customers.filter("c_nationkey < 8").repartition(4).write.parquet(f"{path}/earlier")
    after = file_position_ids(spark, f"{path}/*", register)
    both = after.join(spark.read.parquet(landed), "c_custkey")
    unique = after.groupBy(ROW_ID).count().filter("count > 1")
    same = F.count_if(F.col(ROW_ID) == F.col("before")).alias("unchanged")
    return both.join(unique, ROW_ID, "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"), same)


@query(
    "parse_array_column",
    """
    SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
           floor(unnest(embedding)::DOUBLE * 1000)::INTEGER AS pixel
    FROM embeddings
    """,
)
def parse_array_column(spark, folder):
    """Numbers written as ``a:b:c`` and parsed back at the scan."""
    from plumbline.functions import parse_int_array

    written = table(spark, folder, "embeddings").select(
        "vec_id",
        F.array_join(
            F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("string")), ":"
        ).alias("image"),
    )
    return written.select("vec_id", F.posexplode(parse_int_array(F.col("image"))).alias("pos", "pixel"))


@query(
    "filter_eq",
    "SELECT o_orderkey, '0:' || o_orderkey AS lineage FROM orders WHERE o_orderstatus = 'F'",
)
def filter_eq(spark, folder):
    return shown(tracked(spark, folder, "orders").filter_equal("o_orderstatus", "F"), "o_orderkey")


@query(
    "filter_ne_keep_nulls",
    """
    SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, '0:' || o_orderkey AS lineage
    FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'
    """,
)
def filter_ne_keep_nulls(spark, folder):
    orders = tracked(spark, folder, "orders").with_column("status", F.nullif("o_orderstatus", F.lit("P")))
    return shown(orders.exclude("status", ["F"]), "o_orderkey", "status")


@query(
    "filter_date_range",
    """
    SELECT o_orderkey, o_orderdate, '0:' || o_orderkey AS lineage FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-06-30'
    """,
)
def filter_date_range(spark, folder):
    orders = tracked(spark, folder, "orders")
    in_range = orders.filter_between("o_orderdate", moment("1997-01-01"), moment("1998-06-30"))
    return shown(in_range, "o_orderkey", "o_orderdate")


@query(
    "filter_isin",
    """
    SELECT c_custkey, c_mktsegment, '1:' || c_custkey AS lineage FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    """,
)
def filter_isin(spark, folder):
    customers = tracked(spark, folder, "customer")
    return shown(
        customers.filter_in("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_custkey", "c_mktsegment"
    )


@query("project_columns", "SELECT c_name AS customer_name, '1:' || c_custkey AS lineage FROM customer")
def project_columns(spark, folder):
    """The lineage stays although the key is not selected."""
    only = tracked(spark, folder, "customer").select("c_name").rename({"c_name": "customer_name"})
    return shown(only, "customer_name")


@query("fill_null", "SELECT doc_id, coalesce(nullif(lang, 'de'), '') AS lang, n_chars FROM documents")
def fill_null(spark, folder):
    documents = tracked(spark, folder, "documents").with_column("lang", F.nullif("lang", F.lit("de")))
    return documents.fill_null(["lang"], "").df.select("doc_id", "lang", "n_chars")


@query(
    "concat_text",
    """
    SELECT doc_id, md5(lang || ' ' || nullif(source, 'src3') || ' ' || text) AS digest,
           length(lang || ' ' || nullif(source, 'src3') || ' ' || text)::INTEGER AS chars
    FROM documents
    """,
)
def concat_text(spark, folder):
    documents = tracked(spark, folder, "documents").with_column(
        "source", F.nullif("source", F.lit("src3"))
    )
    joined = documents.concat_text("joined", ["lang", "source", "text"])
    return joined.df.select("doc_id", F.md5("joined").alias("digest"), F.length("joined").alias("chars"))


@query(
    "derive_flag",
    """
    SELECT c_custkey, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END > 0, false) AS in_credit
    FROM customer
    """,
)
def derive_flag(spark, folder):
    balance = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    flagged = tracked(spark, folder, "customer").with_column("in_credit", positive_flag(balance))
    return flagged.df.select("c_custkey", "in_credit")


@query("perturb_scale", "SELECT c_custkey, round(c_acctbal * 10.0, 6) AS c_acctbal FROM customer")
def perturb_scale(spark, folder):
    scaled = tracked(spark, folder, "customer").scale_column("c_acctbal", 10.0)
    return scaled.df.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(
    "join_lineage",
    """
    SELECT doc_id, quality, n_chars, '4:' || doc_id || ',5:' || doc_id AS lineage
    FROM documents JOIN labels USING (doc_id)
    """,
)
def join_lineage(spark, folder):
    return shown(labelled_documents(spark, folder), "doc_id", "quality", "n_chars")


@query(
    "join_different_keys",
    """
    SELECT o_orderkey, o_custkey, c_custkey, '0:' || o_orderkey || ',1:' || c_custkey AS lineage
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def join_different_keys(spark, folder):
    joined = tracked(spark, folder, "customer").join(
        tracked(spark, folder, "orders"), left_on="c_custkey", right_on="o_custkey"
    )
    return shown(joined, "o_orderkey", "o_custkey", "c_custkey")


@query(
    "join_frequent_keys",
    """
    SELECT o_orderkey, c_mktsegment, '0:' || o_orderkey || ',1:' || c_custkey AS lineage
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def join_frequent_keys(spark, folder):
    """The left side's keys are split over eight parts."""
    joined = tracked(spark, folder, "orders").join(
        tracked(spark, folder, "customer"), left_on="o_custkey", right_on="c_custkey", salt=8
    )
    return shown(joined, "o_orderkey", "c_mktsegment")


@query(
    "join_null_keys",
    """
    SELECT c_custkey, n_name, '1:' || c_custkey || ',2:' || n_nationkey AS lineage
    FROM customer JOIN nation ON nullif(c_nationkey, 7) IS NOT DISTINCT FROM nullif(n_nationkey, 7)
    """,
)
def join_null_keys(spark, folder):
    customers = tracked(spark, folder, "customer").with_column("k", F.nullif("c_nationkey", F.lit(7)))
    nations = tracked(spark, folder, "nation").with_column("k", F.nullif("n_nationkey", F.lit(7)))
    return shown(customers.join(nations, on="k", null_safe=True), "c_custkey", "n_name")


@query(
    "star_join_lineage",
    """
    SELECT o_orderkey, r_name,
           '0:' || o_orderkey || ',1:' || c_custkey || ',2:' || n_nationkey || ',3:' || r_regionkey AS lineage
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def star_join_lineage(spark, folder):
    return shown(orders_star(spark, folder), "o_orderkey", "r_name")


@query(
    "union_lineage",
    """
    SELECT o_orderkey, '0:' || o_orderkey AS lineage FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT o_orderkey, '0:' || o_orderkey AS lineage FROM orders WHERE o_totalprice > 300000
    """,
)
def union_lineage(spark, folder):
    orders = tracked(spark, folder, "orders")
    both = orders.filter_equal("o_orderstatus", "F").union(orders.filter(F.col("o_totalprice") > 300000))
    return shown(both, "o_orderkey")


@query(
    "sample_exact_n",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (ORDER BY md5('42:0:' || o_orderkey), o_orderkey) <= 1000
    """,
)
def sample_exact_n(spark, folder):
    return sample_rows(tracked(spark, folder, "orders"), 1000).df.select("o_orderkey", "o_totalprice")


@query(
    "balanced_sample",
    """
    WITH classed AS (SELECT o_orderkey, o_totalprice > 400000 AS is_top FROM orders),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY is_top ORDER BY md5('42:0:' || o_orderkey), o_orderkey) AS r
      FROM classed
    )
    SELECT o_orderkey, is_top FROM ranked
    WHERE is_top OR r <= (SELECT count(*) FROM classed WHERE is_top)
    """,
)
def balanced_sample(spark, folder):
    orders = tracked(spark, folder, "orders").with_column("is_top", F.col("o_totalprice") > 400000)
    return balance_classes(orders, F.col("is_top")).df.select("o_orderkey", "is_top")


@query(
    "random_split",
    """
    SELECT o_orderkey,
           CASE WHEN row_number() OVER (ORDER BY md5('1337:0:' || o_orderkey), o_orderkey)
                     <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
    FROM orders
    """,
)
def random_split_exact(spark, folder):
    train, test = random_split(tracked(spark, folder, "orders"), 0.2, seed=1337)
    return train.df.select("o_orderkey", F.lit("train").alias("split")).unionByName(
        test.df.select("o_orderkey", F.lit("test").alias("split"))
    )


@query(
    "random_split_threshold",
    """
    SELECT o_orderkey, CASE WHEN md5('1337:0:' || o_orderkey) < '33333333' THEN 'test' ELSE 'train' END AS split
    FROM orders
    """,
)
def random_split_threshold(spark, folder):
    train, test = random_split(tracked(spark, folder, "orders"), 0.2, seed=1337, exact=False)
    return train.df.select("o_orderkey", F.lit("train").alias("split")).unionByName(
        test.df.select("o_orderkey", F.lit("test").alias("split"))
    )


def _both_splits(train: Tracked, test: Tracked, *columns):
    return shown(train, *columns, F.lit("train").alias("split")).unionByName(
        shown(test, *columns, F.lit("test").alias("split"))
    )


@query(
    "temporal_split",
    """
    SELECT o_orderkey, '0:' || o_orderkey AS lineage,
           CASE WHEN o_orderdate <= TIMESTAMP '1999-12-31' THEN 'train' ELSE 'test' END AS split
    FROM orders
    """,
)
def temporal(spark, folder):
    orders = tracked(spark, folder, "orders")
    return _both_splits(*temporal_split(orders, "o_orderdate", moment(SPLIT_DATE)), "o_orderkey")


@query(
    "temporal_split_overlapping",
    """
    SELECT o_orderkey, '0:' || o_orderkey AS lineage, 'train' AS split FROM orders
    WHERE o_orderdate <= TIMESTAMP '1999-06-01'
    UNION ALL
    SELECT o_orderkey, '0:' || o_orderkey, 'test' FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'
    """,
)
def temporal_overlapping(spark, folder):
    orders = tracked(spark, folder, "orders")
    splits = temporal_split(orders, "o_orderdate", moment(LEAK_DATE), overlap=True)
    return _both_splits(*splits, "o_orderkey")


@query(
    "lineage_pairs",
    """
    SELECT 0::INTEGER AS operator_id, o_orderkey AS row_id FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate <= TIMESTAMP '1999-12-31'
    UNION
    SELECT 1, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate <= TIMESTAMP '1999-12-31'
    """,
)
def pairs(spark, folder):
    joined = tracked(spark, folder, "orders").join(
        tracked(spark, folder, "customer"), left_on="o_custkey", right_on="c_custkey"
    )
    return lineage_pairs(temporal_split(joined, "o_orderdate", moment(SPLIT_DATE))[0].df)


@query(
    "lineage_roundtrip",
    """
    SELECT CASE WHEN row_number() OVER (ORDER BY md5('1337:6:' || vec_id), vec_id)
                     <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split,
           '6:' || vec_id AS lineage, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
           (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, round(unnest(embedding)::DOUBLE, 6) AS value
    FROM embeddings
    """,
)
def lineage_roundtrip(spark, folder):
    """A pipeline written to the run tables and read back."""
    store = RunStore(spark, fresh_path(spark, "runs"))
    run = store.start("vectors", {"seed": 1337})
    pipeline = vector_pipeline(spark, folder)
    run.save(pipeline)
    pipeline.release()
    loaded = store.load(run.run_id)
    return loaded.outputs.select(
        "split",
        lineage_text(F.col(LINEAGE)).alias("lineage"),
        "label",
        F.posexplode("features").alias("pos", "value"),
    ).withColumn("value", F.round("value", 6))


@query(
    "source_roles",
    f"""
    WITH {STAR_SQL}, {PAIRS_SQL},
    fact AS (
      SELECT split, min(operator_id) AS fact FROM (
        SELECT split, operator_id FROM pairs GROUP BY ALL HAVING count(*) = count(DISTINCT row_id)
      ) GROUP BY split
    )
    SELECT split, source_id::INTEGER AS source_id, name,
           CASE WHEN source_id = fact THEN 'Entities' ELSE 'SideData' END AS role
    FROM fact, (VALUES (0, 'orders'), (1, 'customer'), (2, 'nation'), (3, 'region')) AS t(source_id, name)
    """,
)
def source_roles(spark, folder):
    pipeline = orders_pipeline(spark, folder, cache=False)
    rows = [
        (split, s.source_id, s.name, s.role) for split in ("train", "test") for s in pipeline.sources(split)
    ]
    return spark.createDataFrame(rows, "split string, source_id int, name string, role string")


@query(
    "run_parameters",
    """
    SELECT start, count(*) AS n_rows, min(o_orderkey) AS first_key
    FROM orders, (VALUES ('1996-01-01'), ('1998-01-01')) AS p(start)
    WHERE o_orderdate >= start::TIMESTAMP GROUP BY start
    """,
)
def run_parameters(spark, folder):
    """The same steps run with different arguments."""

    def steps(start: str):
        kept = tracked(spark, folder, "orders").filter_between("o_orderdate", low=moment(start))
        row_id = row_id_of(F.col(LINEAGE), ORDERS)
        return kept.df.agg(
            F.lit(start).alias("start"), F.count("*").alias("n_rows"), F.min(row_id).alias("first_key")
        )

    return steps("1996-01-01").unionByName(steps("1998-01-01"))

"""The operators over their whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    dart_minhash, exact_dedup, language_id, lexical, line_crf, line_join, mixing, packing, pii, rules, warc_fixity, whitening,
    window_dedup,
)
from .common import documents
from .registry import query


@query(
    "op1_exact_dedup",
    """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    ), d AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


@query("op5_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.sized(mixing.marked(documents(spark, folder), F.array("source")))
    mixture = mixing.plan_mixture(rows)
    sources = spark.createDataFrame(
        [(s, mixture.totals[s], mixture.quotas[s]) for s in mixture.totals], "source string, source_size long, target double")
    taken = mixing.times_taken(rows, mixture).withColumn("source", F.element_at("__pattern", 1))
    same = taken["source"].eqNullSafe(sources["source"])
    return taken.join(F.broadcast(sources), same).select(
        "doc_id", "size", "source_size", "target", (F.col("__times") * F.col("size")).alias("taken"))


@query("op7_dart_minhash")
def dart_minhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.near_duplicates(documents(spark, folder))


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


@query("op9_language_id")
def language_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language_id.identify(docs, language_id.fit_languages(docs))


@query(
    "op10_window_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT doc_id, spot, array_to_string(w[spot : spot + 12], ' ') AS key
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS spot FROM d)
    ), firsts AS (SELECT key, min(doc_id) AS low FROM windows GROUP BY key),
    covered AS (
        SELECT DISTINCT doc_id, spot + step AS spot
        FROM (SELECT DISTINCT doc_id, spot FROM windows JOIN firsts USING (key) WHERE doc_id > low), range(13) AS s(step)
    ), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM d),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY spot) AS text, count(*) AS n
        FROM words ANTI JOIN covered USING (doc_id, spot) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def window_dedup_words(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.remove_repeated(documents(spark, folder)).drop("kept_text")


@query("op4_line_crf")
def line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return line_crf.line_quality(docs, line_crf.fit_lines(docs))


@query("op6_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder))


@query(
    "op2_warc_fixity",
    r"""
    WITH r AS (
        SELECT page_id, page_id // 500 AS archive, url,
               concat('WARC/1.1', e'\r\n', 'WARC-Type: resource', e'\r\n', 'WARC-Record-ID: <urn:page:', page_id, '>', e'\r\n',
                      'WARC-Target-URI: ', url, e'\r\n', 'Content-Type: text/html', e'\r\n',
                      'Content-Length: ', strlen(coalesce(html, '')), e'\r\n\r\n', coalesce(html, ''), e'\r\n\r\n') AS record,
               html
        FROM pages
    )
    SELECT page_id, url, archive, strlen(record) AS length, sha256(record) AS sha256,
           CAST(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(record) AS BIGINT) AS "offset",
           CASE WHEN page_id % 97 = 3 AND length(html) > 0 THEN 'changed' ELSE 'intact' END AS state
    FROM r
    """,
)
def warc_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as archives in two replicas, one of them damaged at every 97th page, and the audit of all records."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return warc_fixity.audited(spark, *warc_fixity.replicated(pages, F.col("page_id") % 97 == 3))


@query("op3_line_join")
def line_join_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return line_join.duplicate_lines(documents(spark, folder))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query(
    "op12_lexical_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents
    ), i AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), totals AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
    tf AS (SELECT r, doc_id, len(t) AS size, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
    w AS (
        SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
    ), scores AS (
        SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l))))::BIGINT AS score
        FROM i JOIN w USING (term) JOIN tf USING (term), totals GROUP BY item_id, r, doc_id
    ), ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op13_rule_quality")
def rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return rules.score(docs, rules.fit_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")))

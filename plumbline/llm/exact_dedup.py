"""Exact deduplication with the frequent digests split off.

A Misra-Gries summary names every digest that more than ``support`` of the rows have. The named digests are
counted exactly; those that really are that frequent (at most ``1 / support``) are broadcast with their winner, so
that their rows are settled where they are read. All other digests have a bounded number of rows and are settled
by one ordinary shuffle. Everything runs on built-in functions.

Defined cases: a null text equals the empty text; a null doc_id ranks below every other; of rows that repeat a
doc_id in one group exactly one stays; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, landed, nested

#: A digest in more than this share of the rows is frequent.
SUPPORT = 0.001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null gives the empty text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def frequent(rows: DataFrame, support: float) -> DataFrame:
    """Digests that at least ``support`` of the rows have, with count and winner: at most ``1 / support`` rows."""
    marks = rows.select(F.hex("digest").alias("mark")).stat.freqItems(["mark"], support)
    named = marks.select(F.explode("mark_freqItems").alias("mark")).select(F.unhex("mark").alias("digest"))
    least = rows.count() * support
    return (
        rows.join(F.broadcast(named.distinct()), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
        .filter(F.col("group_size") >= least)
    )


def settle(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``rows`` (doc_id, row, digest), landed, with group_size and best (doc_id, row) of each digest."""
    winners = landed(frequent(rows, support), "frequent-digests")
    small = F.broadcast(winners)
    hot = rows.join(small, "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(small, "digest", "left_anti").select(
        "digest",
        "doc_id",
        "row",
        F.count("*").over(group).alias("group_size"),
        F.max(F.struct("doc_id", "row")).over(group).alias("best"),
    )
    return hot.select(rest.columns).unionByName(rest)


def exact_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the SHA-256 of its normalised text in hex."""
    rows = docs.select(column(doc_id).alias("doc_id"), digest(column(text)).alias("digest"))
    rows = landed(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    return settle(rows, support).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT
) -> DataFrame:
    """The documents with one row left of each group of equal texts; columns as given."""
    rows = docs.select(column(doc_id).alias("doc_id"), digest(column(text)).alias("digest"))
    rows = landed(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    winners = settle(rows, support).filter(F.col("row") == F.col("best.row"))
    winners = winners.select(F.col("doc_id").alias("winner"), F.col("digest").alias("of"))
    marked = docs.select(nested(docs), digest(column(text)).alias("digest"), column(doc_id).alias("id"))
    left = marked.join(winners, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("winner")), "left_semi")
    once = Window.partitionBy("digest", "id").orderBy("digest")
    return left.withColumn("n", F.row_number().over(once)).filter("n = 1").select("doc.*")

"""CSV scans. A schema is required wherever the file has no header; otherwise it may be inferred."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .identity import ROW_ID


def _csv(spark: SparkSession, schema: StructType | str | None, **options):
    reader = spark.read.options(**options)
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a scan over all cores when it has fewer partitions than there are cores.

    For few, large or unsplittable files ahead of costly work per row. A scan of many files is left
    alone. Filters and column pruning still pass through to the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def _unpacked(df: DataFrame, path: str) -> DataFrame:
    return spread(df, *df.columns) if str(path).endswith(".gz") else df


def read_plain_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """CSV with a header line, plain or gzip-compressed."""
    return _unpacked(_csv(spark, schema, header=True).csv(path), path)


def read_indexed_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    index_as_row_id: bool = False,
) -> DataFrame:
    """CSV with a header line whose first column is a row index and not an attribute.

    A unique integral index can serve as the row id of ``track``.
    """
    df = _csv(spark, schema, header=True).csv(path)
    index, *attributes = (F.col(f"`{c}`") for c in df.columns)
    row_id = [index.cast("bigint").alias(ROW_ID)] if index_as_row_id else []
    return _unpacked(df.select(*attributes, *row_id), path)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    separator: str = ", ",
    null_token: str = "?",
    skip_first_line: bool = False,
) -> DataFrame:
    """Delimited text without column names, with its own null token and maybe a first line to skip."""
    return _csv(
        spark, schema, sep=separator, nullValue=null_token, header=skip_first_line, enforceSchema=True
    ).csv(path)


@dataclass(frozen=True)
class CheckedScan:
    """The rows that fit the schema, and the lines that do not: ``(file, line, copies, fields_read)``."""

    rows: DataFrame
    rejected: DataFrame


_REJECTED = "__rejected"


def read_checked_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, **options) -> CheckedScan:
    """CSV, plain or gzip-compressed, whose lines are checked against the schema; ``options`` are those of Spark's reader.

    A line is rejected if a field cannot be read as its type or if there are too few or too many fields. All fields are
    parsed for that whichever are used later, so that what is rejected does not depend on the query.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = StructType([*wanted.fields]).add(_REJECTED, StringType())
    lines = (
        spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_REJECTED, columnPruning=False, **options)
        .schema(read)
        .csv(path if isinstance(path, str) else list(path))
    )
    columns = [F.col(f"`{f.name}`") for f in wanted.fields]
    # fields that nothing refers to are not converted, and what is wrong with them goes unseen
    every = F.hash(*columns) >= F.lit(-(1 << 31))
    known = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    rejected = (
        lines.filter(F.col(_REJECTED).isNotNull() & every)
        .groupBy(F.col("_metadata.file_path").alias("file"), F.col(_REJECTED).alias("line"))
        .agg(F.count("*").alias("copies"), F.max(known).alias("fields_read"))
    )
    return CheckedScan(lines.filter(F.col(_REJECTED).isNull() & every).select(*columns), rejected)

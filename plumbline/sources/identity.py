"""Row ids that stay the same when a partition is recomputed and let filters reach the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

ROW_ID = "__row_id"

# A row id is the number of the row's file, shifted by so many bits, and the row's index in it.
INDEX_BITS = 40


def key_ids(df: DataFrame, key: str) -> DataFrame:
    """Use a unique integral column as the row id."""
    return df.withColumn(ROW_ID, F.col(key).cast("bigint"))


def hashed_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hash a composite key to a 64-bit id. For up to about 1e8 rows; use positions beyond that.

    Nulls take part, so that keys that differ by a null's place have different ids.
    """
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    return df.withColumn(ROW_ID, F.xxhash64(*parts))


def check_ids(df: DataFrame) -> None:
    """Raise if a row id is missing or held by two rows: one aggregate, and rows of one id combine before its shuffle."""
    held = df.groupBy(ROW_ID).count().agg(
        F.max(F.when(F.col(ROW_ID).isNull(), F.col("count"))).alias("missing"),
        F.count_if(F.col(ROW_ID).isNotNull() & (F.col("count") > 1)).alias("repeated"),
        F.max(F.when(F.col("count") > 1, F.col(ROW_ID))).alias("example"),
    )
    found = held.first()
    if found["missing"]:
        raise ValueError(f"{found['missing']} rows have no row id")
    if found["repeated"]:
        raise ValueError(f"{found['repeated']} row ids belong to several rows, {found['example']} for one")


class FileRegister:
    """Numbers of files that stay as they are when files are added: a Parquet table ``(file, number)`` that only grows.

    One process registers the files of a source at a time; many may read the register.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def known(self) -> dict[str, int]:
        try:
            table = self.spark.read.schema("file string, number bigint").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["file"]: r["number"] for r in table.collect()}  # no more than the listing of the scan

    def numbers(self, files: Iterable[str]) -> dict[str, int]:
        """The numbers of these files; those not seen before get the next ones, in order of their names."""
        known = self.known()
        added = [f for f in sorted(files) if f not in known]
        new = list(enumerate(added, 1 + max(known.values(), default=-1)))
        if new:
            rows = self.spark.createDataFrame([(f, n) for n, f in new], "file string, number bigint")
            rows.coalesce(1).write.mode("append").parquet(self.path)
        return known | {f: n for n, f in new}


def file_position_ids(spark: SparkSession, path: str, register: FileRegister | None = None) -> DataFrame:
    """Read Parquet with the places of the rows, file number and index in the file, as row ids.

    Files are numbered by name, or as the register has them. What the driver sorts is one short row per file, no more
    than the listing that it holds of every scan; no job is run for it, and the rows are not shuffled for the join when
    the optimiser finds the numbers small.
    """
    rows = spark.read.parquet(path)
    columns = rows.columns
    # the scan's listing and its metadata column write an empty host differently
    files = sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in rows.inputFiles())
    numbers = {f: n for n, f in enumerate(files)} if register is None else register.numbers(files)
    if max(numbers.values(), default=0) >= 1 << (63 - INDEX_BITS):
        raise ValueError("too many files for row ids of 64 bits")
    located = rows.select(
        *[F.col(c) for c in columns],
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__index"),
    )
    # as an Arrow table it has a size that the optimiser knows
    places = pa.array([numbers[f] for f in files], pa.int64())
    numbered = spark.createDataFrame(pa.table({"__file": pa.array(files, pa.string()), "__number": places}))
    return located.join(numbered, "__file").select(
        *[F.col(c) for c in columns],
        (F.shiftleft("__number", INDEX_BITS) + F.col("__index")).alias(ROW_ID),
    )


def landed_ids(df: DataFrame) -> DataFrame:
    """Write a frame without any key to the shared folder as Parquet, and use the positions there."""
    path = fresh_path(df.sparkSession, "landed")
    df.write.parquet(path)
    return file_position_ids(df.sparkSession, path)

"""Which input rows made it into the training features."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import LINEAGE, lineage_pairs, row_id_of
from ..session import fresh_path
from .base import Refinement

#: Row ids that a bitmap of 4,096 bytes must hold on average to be worth it: with fewer the ids themselves are smaller.
DENSE = 512
_SPAN = 1 << 15  # ids of one bitmap, as the built-in functions have it


def is_set(bits: Column, position: Column) -> Column:
    """Whether the bit of a bitmap is set; false without a bitmap."""
    octet = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(octet, (position % 8).cast("int")) == 1, F.lit(False))


class UsedRows:
    """The row ids of every source found in some lineages, collected in one pass over them.

    They are written once to the shared folder, by source. Where ids lie close together, as keys and file positions do,
    a source is joined with bitmaps of 32,768 ids each, a hundredth of the ids' size, so that its own rows seldom have to
    be shuffled; scattered ids (hashes) are joined one by one.
    """

    def __init__(self, rows: DataFrame, source_ids: Iterable[int]):
        self.spark: SparkSession = rows.sparkSession
        self.path = fresh_path(self.spark, "used")
        wanted = sorted(source_ids)
        lineage_pairs(rows).filter(F.col("operator_id").isin(wanted)).write.partitionBy("operator_id").parquet(self.path)
        ids = self.spark.read.schema("row_id bigint, operator_id int").parquet(self.path)
        spread = F.approx_count_distinct(F.floor(F.col("row_id") / _SPAN)).alias("spans")
        sizes = ids.groupBy("operator_id").agg(F.count("*").alias("n"), spread).collect()  # one row per source
        self.dense = {r["operator_id"] for r in sizes if r["n"] >= DENSE * r["spans"]}
        self.known = {r["operator_id"] for r in sizes}

    def ids(self, source_id: int) -> DataFrame:
        if source_id not in self.known:
            return self.spark.createDataFrame([], "row_id bigint")
        return self.spark.read.schema("row_id bigint").parquet(f"{self.path}/operator_id={source_id}")

    def bitmaps(self, source_id: int) -> DataFrame:
        """``(bucket, bits)``."""
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("row_id")).alias("bits")
        return self.ids(source_id).groupBy(F.bitmap_bucket_number("row_id").alias("bucket")).agg(bits)

    def marked(self, source_rows: DataFrame, source_id: int, name: str = "is_used") -> DataFrame:
        """The source's rows plus a boolean."""
        row_id = row_id_of(F.col(LINEAGE), source_id)
        if source_id in self.dense:
            found = self.bitmaps(source_id).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
            joined = source_rows.join(found, F.bitmap_bucket_number(row_id) == F.col("__bucket"), "left")
            used = is_set(F.col("__bits"), F.bitmap_bit_position(row_id))
            return joined.withColumn(name, used).drop("__bucket", "__bits")
        found = self.ids(source_id).select(F.col("row_id").alias("__used"))
        joined = source_rows.join(found, row_id == F.col("__used"), "left")
        return joined.withColumn(name, F.col("__used").isNotNull()).drop("__used")


class InputUsage(Refinement):
    """Every training source with a flag for the rows used."""

    def compute(self, pipeline, run=None):
        sources = pipeline.sources("train")
        used = UsedRows(pipeline.split_rows("train").select(LINEAGE), [s.source_id for s in sources])
        refined = []
        for index, source in enumerate(sources):
            flagged = replace(source, rows=used.marked(source.rows, source.source_id))
            refined.append(flagged)
            if run is not None:
                run.set_tags(
                    {
                        f"input_usage.source.{index}.operator_id": source.source_id,
                        f"input_usage.source.{index}.source_type": source.role,
                    }
                )
                run.write_table(flagged.data, f"input-{index}-with-usage")
        return refined

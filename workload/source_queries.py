"""CSV scans over files that are written from the test tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import LINEAGE, row_id_of, track
from plumbline.session import fresh_path
from plumbline.sources import read_checked_csv, read_delimited, read_indexed_csv, read_plain_csv

from .bindings import CUSTOMER, table
from .registry import query

CUSTOMERS = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMERS_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def written(spark, df, **options) -> str:
    path = fresh_path(spark, "files")
    df.write.options(**options).csv(path)
    return path


@query("read_plain_csv", CUSTOMERS_SQL)
def plain_csv(spark, folder):
    path = written(spark, table(spark, folder, "customer"), header=True)
    return read_plain_csv(spark, path, CUSTOMERS)


@query("read_gzip_csv", CUSTOMERS_SQL)
def gzip_csv(spark, folder):
    path = written(spark, table(spark, folder, "customer"), header=True, compression="gzip")
    return read_plain_csv(spark, f"{path}/*.csv.gz", CUSTOMERS)


@query("read_indexed_csv", "SELECT c_custkey + 5 AS row_id, c_name, c_acctbal FROM customer")
def indexed_csv(spark, folder):
    """The first column is an index, which becomes the row id and no attribute."""
    rows = table(spark, folder, "customer").select((F.col("c_custkey") + 5).alias("_c0"), "c_name", "c_acctbal")
    path = written(spark, rows, header=True)
    scan = read_indexed_csv(spark, path, "_c0 bigint, c_name string, c_acctbal double", index_as_row_id=True)
    frame = track(scan, CUSTOMER, "customer")
    return frame.df.select(row_id_of(F.col(LINEAGE), CUSTOMER).alias("row_id"), "c_name", "c_acctbal")


@query(
    "read_delimited",
    """
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal,
           nullif(c_mktsegment, 'BUILDING') AS c_mktsegment
    FROM customer
    """,
)
def delimited(spark, folder):
    """No column names but a first line to skip, a separator of two characters, and a question mark for unknown."""
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )
    path = written(spark, rows, header=True, sep=", ", nullValue="?")
    return read_delimited(spark, path, CUSTOMERS, skip_first_line=True)


def _checked(spark, folder):
    """Customers as CSV lines in plain and in compressed files; every 50th has a balance that is no number, the one
    after it lacks its last fields, the one after that has one too many."""
    customers = table(spark, folder, "customer")
    kind = F.col("c_custkey") % 50
    balance = F.when(kind == 0, F.lit("unknown")).otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(",", F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), balance, F.col("c_mktsegment"))
    line = F.when(kind == 1, F.concat_ws(",", "c_custkey", "c_name")).when(kind == 2, F.concat(line, F.lit(",more"))).otherwise(line)
    paths = []
    for compression, chosen in (("none", F.col("c_nationkey") < 12), ("gzip", F.col("c_nationkey") >= 12)):
        paths.append(fresh_path(spark, "lines"))
        customers.filter(chosen).select(line.alias("value")).write.option("compression", compression).text(paths[-1])
    return read_checked_csv(spark, paths, CUSTOMERS)


@query("csv_checked_rows", f"{CUSTOMERS_SQL} WHERE c_custkey % 50 NOT IN (0, 1, 2)")
def csv_checked_rows(spark, folder):
    return _checked(spark, folder).rows


@query(
    "csv_rejected_lines",
    """
    SELECT CASE WHEN c_nationkey >= 12 THEN 'gz' ELSE 'txt' END AS kind, c_custkey % 50 AS planted, count(*) AS lines,
           sum(1)::BIGINT AS copies, min(CASE c_custkey % 50 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 5 END)::INTEGER AS least_read
    FROM customer WHERE c_custkey % 50 IN (0, 1, 2) GROUP BY ALL
    """,
)
def csv_rejected_lines(spark, folder):
    """The lines that were rejected, by kind of file and planted fault."""
    rejected = _checked(spark, folder).rejected
    return rejected.groupBy(
        F.element_at(F.split("file", r"\."), -1).alias("kind"),
        (F.split("line", ",")[0].cast("bigint") % 50).alias("planted"),
    ).agg(F.count("*").alias("lines"), F.sum("copies").alias("copies"), F.min("fields_read").alias("least_read"))

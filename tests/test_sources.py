from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from plumbline.functions import parse_int_array
from plumbline.operators import track
from plumbline.sources import (
    FileRegister,
    file_position_ids,
    landed_ids,
    read_checked_csv,
    read_delimited,
    read_indexed_csv,
    read_plain_csv,
)
from plumbline.sources.identity import ROW_ID
from tests.helpers import lineages
from workload import relational_queries


def test_indexed_csv_plain_and_gzip(spark, tmp_path):
    text = ",review_id,votes\n7,r1,3\n9,r2,\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write(text)
    for name in ("a.csv", "b.csv.gz"):
        df = read_indexed_csv(spark, str(tmp_path / name))
        assert df.columns == ["review_id", "votes"]
        assert sorted(map(tuple, df.collect())) == [("r1", 3), ("r2", None)]
        tracked = track(read_indexed_csv(spark, str(tmp_path / name), index_as_row_id=True), 4)
        assert lineages(tracked.df) == ["4:7", "4:9"]


def test_delimited_with_null_token_and_skipped_line(spark, tmp_path):
    (tmp_path / "test.data").write_text("|junk line, with commas\n25, Private, ?\n38, ?, <=50K.\n")
    df = read_delimited(
        spark, str(tmp_path / "test.data"), "age double, work string, income string", skip_first_line=True
    )
    assert sorted(map(tuple, df.collect())) == [(25.0, "Private", None), (38.0, None, "<=50K.")]
    (tmp_path / "train.data").write_text("25, Private, >50K\n")
    train = read_delimited(spark, str(tmp_path / "train.data"), "age double, work string, income string")
    assert [tuple(r) for r in train.collect()] == [(25.0, "Private", ">50K")]


def test_images_are_parsed_at_the_scan(spark, tmp_path):
    (tmp_path / "i.csv").write_text("image,category_id\n0:12:255,1\n")
    df = read_plain_csv(spark, str(tmp_path / "i.csv"), "image string, category_id int")
    assert df.select(parse_int_array(F.col("image")).alias("a")).first()["a"] == [0, 12, 255]


def test_positions_number_the_rows_of_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 3).withColumn("v", F.col("id") % 7).write.parquet(path)
    df = file_position_ids(spark, path)
    assert df.select(ROW_ID).distinct().count() == 1000
    starts = df.groupBy(F.shiftright(ROW_ID, 40)).agg(F.min(F.col(ROW_ID) % 2**40)).collect()
    assert sorted(map(tuple, starts)) == [(0, 0), (1, 0), (2, 0)]
    assert df.filter("v = 3").select(ROW_ID).distinct().count() == df.filter("v = 3").count()
    again = {r["id"]: r[ROW_ID] for r in file_position_ids(spark, path).filter("id < 50").collect()}
    assert again == {r["id"]: r[ROW_ID] for r in df.filter("id < 50").collect()}


def test_equal_rows_without_key_get_ids_of_their_own(spark):
    df = landed_ids(spark.createDataFrame([("a",), ("a",), ("b",)], "v string"))
    assert df.select(ROW_ID).distinct().count() == 3


def test_composite_key_and_missing_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert len(set(lineages(track(df, 0, key=["a", "b"]).df))) == 2
    with pytest.raises(ValueError):
        track(df, 0)


def test_missing_and_repeated_keys_raise_on_request(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k long, v string")
    with pytest.raises(ValueError, match="2 rows have no row id"):
        track(rows, 0, key="k", check=True)
    known = rows.filter("k is not null")
    assert track(known, 0, key="k", check=True).df.count() == 2
    with pytest.raises(ValueError, match="1 row ids belong to several rows, 2"):
        track(known.unionByName(known.filter("k = 2")), 0, key="k", check=True)
    with pytest.raises(ValueError, match="several rows"):
        track(known.unionByName(known), 0, key=["k", "v"], check=True)
    assert track(rows.limit(0), 0, key="k", check=True).df.count() == 0
    assert track(rows, 0, key="k").df.count() == 4


def test_registered_files_keep_their_numbers(spark, tmp_path):
    path, register = str(tmp_path / "t x+%20"), FileRegister(spark, str(tmp_path / "register"))
    spark.range(100, 200, 1, 2).write.parquet(f"{path}/b")
    ids = {r["id"]: r[ROW_ID] for r in file_position_ids(spark, f"{path}/*", register).collect()}
    plain = {r["id"]: r[ROW_ID] for r in file_position_ids(spark, f"{path}/*").collect()}
    assert len(ids) == 100 and ids == plain
    spark.range(0, 100, 1, 3).write.parquet(f"{path}/a")
    after = {r["id"]: r[ROW_ID] for r in file_position_ids(spark, f"{path}/*", register).collect()}
    assert len(set(after.values())) == 200 and ids.items() <= after.items()
    assert len(register.known()) == 5
    shifted = {r["id"]: r[ROW_ID] for r in file_position_ids(spark, f"{path}/*").collect()}
    assert any(shifted[i] != ids[i] for i in ids)  # which is what the register is for
    again = file_position_ids(spark, f"{path}/*", FileRegister(spark, register.path))
    assert {r["id"]: r[ROW_ID] for r in again.collect()} == after


def test_lines_that_do_not_fit_are_split_off(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,x,2.5\n2,y\n3,z,oops\n4,"q, r",1\n2,y\n5,s,1,extra\n\n6,,\n')
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("7,t,3\nno number,u,4\n")
    schema = "id int, name string, amount double"
    scan = read_checked_csv(spark, str(tmp_path / "*.csv*"), schema)
    assert sorted(map(tuple, scan.rows.collect())) == [(1, "x", 2.5), (4, "q, r", 1.0), (6, None, None), (7, "t", 3.0)]
    found = {(r["file"].rsplit("/", 1)[1], r["line"]): (r["copies"], r["fields_read"]) for r in scan.rejected.collect()}
    assert found == {
        ("a.csv", "2,y"): (2, 2), ("a.csv", "3,z,oops"): (1, 2), ("a.csv", "5,s,1,extra"): (1, 3), ("b.csv.gz", "no number,u,4"): (1, 2)
    }
    # whichever columns are read
    assert scan.rows.select("id").count() == 4 and scan.rows.agg(F.sum("id")).first()[0] == 18
    (tmp_path / "h.csv").write_text("id;name;amount\n1;x;?\n")
    headed = read_checked_csv(spark, [str(tmp_path / "h.csv")], schema, header=True, sep=";", nullValue="?")
    assert [tuple(r) for r in headed.rows.collect()] == [(1, "x", None)] and headed.rejected.count() == 0


def test_positions_are_taken_over_five_files_of_the_columns_asked_for(spark, small, tmp_path, monkeypatch):
    path = str(tmp_path / "lineitem")
    monkeypatch.setattr(relational_queries, "fresh_path", lambda spark, label: path)
    row = relational_queries.source_positions(spark, small).first()
    written = spark.read.parquet(path)
    assert written.columns == ["l_quantity"] and len(written.inputFiles()) == row["n_files"] == 5
    assert row["n"] == row["different"] == spark.read.parquet(f"{small}/lineitem.parquet").count()

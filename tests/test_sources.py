"""Files with the quirks the survey exports have."""

import pytest
from pyspark.sql import types as T

from shoalmark.functions.columns import clean_names
from shoalmark.session import scratch_path, shared_dir, written
from shoalmark.sources import readers as S

SCHEMA = T.StructType([T.StructField("Paper_num", T.IntegerType()), T.StructField("Trait cat", T.StringType()),
                       T.StructField("Year", T.IntegerType())])


def test_csv_with_bom_quotes_and_unnamed_columns(spark, tmp_path):
    p = tmp_path / "lit.csv"
    p.write_bytes('﻿Paper_num,Trait cat,Year,,\r\n1,"size, max",2001,,\r\n2,NA,NA,,\r\n3,"a ""b""",1999,x,\r\n'.encode())
    df = S.read_csv_by_header(spark, str(p), SCHEMA)
    assert df.columns == ["Paper_num", "Trait cat", "Year"]
    assert [tuple(r) for r in df.collect()] == [(1, "size, max", 2001), (2, None, None), (3, 'a "b"', 1999)]
    assert clean_names(df).columns == ["paper_num", "trait_cat", "year"]


def test_index_column_is_dropped(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('"","Paper_num","Trait cat","Year"\n"1",7,"a",2000\n"2",8,"b",2001\n')
    assert [tuple(r) for r in S.read_csv_by_header(spark, str(p), SCHEMA).collect()] == [(7, "a", 2000), (8, "b", 2001)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x, "y"', 2.5), (2, None, None), (3, "", 1.0)], "i int, s string, v double")
    path = str(tmp_path / "out")
    S.write_csv(df, path)
    back = {r.i: (r.s, r.v) for r in S.read_csv(spark, path, df.schema).collect()}
    assert back[1] == ('x, "y"', 2.5) and back[2] == (None, None)


def test_grid_filters_reach_the_scan(spark, tmp_path):
    df = spark.range(1000).selectExpr("int(id % 4) + 2000 AS year", "int(id % 366) AS day", "double(id) AS temp")
    path = str(tmp_path / "grid")
    S.write_parquet(df, path, by=["year"])
    out = S.scan_grid(spark.read.parquet(path).where("year = 2001")).select("temp")
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [Or(" in plan
    assert "ReadSchema: struct<day:int,temp:double>" in plan


def test_shared_folder_is_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        pytest.skip("session without a named folder")
    assert shared_dir(spark) == named and scratch_path(spark, "t").startswith(named)


def test_written_table_has_a_known_size(spark):
    df = written(spark.range(1000).toDF("i"), "t")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert df.count() == 1000 and int(str(size)) < 1_000_000


def test_snake_names_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Spec Code", "SpecCode", "2nd")
    assert clean_names(df).columns == ["spec_code", "spec_code_2", "x2nd"]

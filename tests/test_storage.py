"""Commit log, overlapping appends and footers."""

from __future__ import annotations

import datetime as dt
import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.sources import commits, footers

START = dt.datetime(2024, 1, 1)
TABLES = {"a": ("k bigint, ts timestamp_ntz", "ts"), "b": ("k bigint, v string, ts timestamp_ntz", "ts")}


def rows(spark, ids, day=0):
    a = spark.createDataFrame([(i, START + dt.timedelta(days=day, hours=i)) for i in ids], TABLES["a"][0])
    return {"a": a, "b": a.withColumn("v", F.lit("x")).select("k", "v", "ts")}


def ids(df):
    return sorted(r.k for r in df.collect())


def test_a_unit_is_seen_whole_or_not_at_all(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    assert ids(log.read("a")) == []
    log.write("one", rows(spark, [1, 2]))
    log.stage("two", rows(spark, [3]))  # stopped here
    assert ids(log.read("a")) == [1, 2] and ids(log.read("b")) == [1, 2]
    broken = rows(spark, [4, 5])
    broken["b"] = broken["b"].where(F.when(F.col("k") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit(True)).cast("boolean"))
    with pytest.raises(Exception, match="lost"):
        log.write("three", broken)  # table a is written, table b fails
    assert ids(log.read("a")) == [1, 2]
    assert log.write("two", rows(spark, [3, 6])) and log.write("three", rows(spark, [4]))  # tried again: they replace what they left
    again = commits.CommitLog(spark, str(tmp_path), TABLES)
    assert ids(again.read("a")) == ids(again.read("b")) == [1, 2, 3, 4, 6]
    assert not again.write("two", rows(spark, [99])) and ids(again.read("a")) == [1, 2, 3, 4, 6]
    with pytest.raises(ValueError, match="not staged"):
        again.commit("never")


def test_an_append_reads_only_files_that_overlap_it(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    for day in range(4):
        assert log.append_new(f"d{day}", "a", rows(spark, range(5), day)["a"], ["k", "ts"])
    part = log.read("a", START + dt.timedelta(days=1), START + dt.timedelta(days=1, hours=9))
    assert {f.split("/")[-2] for f in part.inputFiles()} == {"d1"} and ids(part) == [0, 1, 2, 3, 4]
    twice = rows(spark, range(3, 8), 2)["a"]
    log.append_new("late", "a", twice.union(twice), ["k", "ts"])
    assert log.read("a").count() == 23
    log.append_new("again", "a", twice, ["k", "ts"])
    assert log.read("a").count() == 23
    log.append_new("none", "a", twice.limit(0), ["k", "ts"])
    assert log.read("a").count() == 23


def test_rows_need_their_parent(spark):
    child, parent = spark.createDataFrame([(1, "h1"), (2, "h2")], "k int, previous string"), spark.createDataFrame([(1, "h1"), (2, "hx")], "k int, hash string")
    same = F.col("previous") == F.col("hash")
    assert commits.linked(child.where("k = 1"), parent, "k", same, "broken chain").count() == 1
    with pytest.raises(Exception, match="broken chain of 2"):
        commits.linked(child, parent, "k", same, "broken chain").collect()


def test_bounds_come_from_footers_where_they_have_them(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    table = lambda hours: pa.table({"ts": pa.array(hours, pa.timestamp("us")), "x": list(range(len(hours)))})
    pq.write_table(table([at(3), at(1), at(2), None]), tmp_path / "one.parquet", row_group_size=2)
    pq.write_table(table([at(9), at(7)]), tmp_path / "two.parquet", write_statistics=False)
    pq.write_table(table([None, None]), tmp_path / "three.parquet")
    assert footers.footer_bounds(str(tmp_path / "one.parquet"), "ts") == (at(1), at(3), 4)
    assert footers.footer_bounds(str(tmp_path / "two.parquet"), "ts") == (None, None, None)
    assert footers.footer_bounds("viewfs://nowhere/x.parquet", "ts") == (None, None, None)
    got = {r.file.split("/")[-1]: (r["first"], r["last"], r.n) for r in footers.file_bounds(spark, str(tmp_path), "ts").collect()}
    assert got == {"one.parquet": (at(1), at(3), 4), "two.parquet": (at(7), at(9), 2), "three.parquet": (None, None, 2)}
    # no column is read where every footer has bounds
    only = tmp_path / "only"
    spark.range(10).select(F.lit(START).cast("timestamp_ntz").alias("ts")).write.parquet(str(only))
    plan = footers.file_bounds(spark, str(only), "ts")._jdf.queryExecution().toString()
    assert "FileScan" not in plan and glob.glob(f"{only}/*.parquet")

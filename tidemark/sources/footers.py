"""Time bounds out of Parquet footers, read in the tasks, one partition per file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ROWS = "file string, first timestamp_ntz, last timestamp_ntz, n bigint"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Footers(DataSourceReader):
    def __init__(self, paths: list[str], column: str):
        self.paths, self.column = paths, column

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition: _File):
        yield (partition.path, *footer_bounds(partition.path, self.column))


def footer_bounds(path: str, column: str) -> tuple:
    """Smallest and largest value of a column and the number of rows; nulls where the footer does not say, or cannot be opened here.

    A row group without values (only nulls) needs no bounds."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    try:
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
        meta = pq.ParquetFile(inner, filesystem=system).metadata
    except (OSError, ValueError, pyarrow.ArrowInvalid):  # a store that only Spark reaches
        return None, None, None
    low, high, n = None, None, 0
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        n += group.num_rows
        found = [group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == column]
        stats = found[0].statistics if found else None
        if stats is not None and stats.null_count == group.num_rows:
            continue
        if stats is None or not stats.has_min_max:
            return None, None, None
        low = stats.min if low is None else min(low, stats.min)
        high = stats.max if high is None else max(high, stats.max)
    return low, high, n


class FooterSource(DataSource):
    """``format("parquet_footers")`` with the options ``files`` (a JSON list) and ``column``."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> _Footers:
        return _Footers(json.loads(self.options["files"]), self.options["column"])


def file_bounds(spark: SparkSession, path: str, column: str) -> DataFrame:
    """file, first, last, n of every file under ``path``.  Files whose footers give no bounds are read, their one column only."""
    spark.dataSource.register(FooterSource)
    files = sorted(spark.read.parquet(path).inputFiles())
    found = spark.read.format("parquet_footers").option("files", json.dumps(files)).option("column", column).load()
    silent = [r["file"] for r in found.where("n IS NULL").select("file").collect()]
    known = found.where("n IS NOT NULL")
    if not silent:
        return known
    read = spark.read.parquet(*silent).select(F.col("_metadata.file_path").alias("file"), F.col(column).cast("timestamp_ntz").alias("t"))
    return known.unionByName(read.groupBy("file").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n")))

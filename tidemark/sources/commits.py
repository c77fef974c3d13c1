"""Batches over several tables that become visible at once, with the time bounds of every file.

A batch writes its tables into folders of its own and then a manifest: one row per file with its bounds and count.  The manifest becomes valid by one
rename, so a batch that was stopped before it is never read, and a batch that is tried again replaces what it had left.  The bounds let
readers, and writers that must look for rows they overlap, open only the files that matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "table string, file string, first timestamp_ntz, last timestamp_ntz, n bigint"


class CommitLog:
    """Tables under ``root``, each with a schema and a time column."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/commits/batch={batch}"))

    def stage(self, batch: str, rows: dict[str, DataFrame]) -> None:
        """Write the tables of a batch and its manifest, both invisible yet.  What an earlier try left is replaced."""
        manifest = None
        for table, df in rows.items():
            schema, ts = self.tables[table]
            data = f"{self.root}/data/{table}/{batch}"
            df.select(*self._columns(table)).write.mode("overwrite").option("compression", "zstd").parquet(data)
            files = self.spark.read.schema(schema).parquet(data).select("_metadata.file_path", ts).groupBy("file_path").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
            files = files.select(F.lit(table).alias("table"), F.col("file_path").alias("file"), F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")
            manifest = files if manifest is None else manifest.unionByName(files)
        manifest.write.mode("overwrite").parquet(f"{self.root}/pending/{batch}")

    def commit(self, batch: str) -> None:
        """Make a staged batch visible."""
        staged = self._path(f"{self.root}/pending/{batch}")
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        if not self._fs.exists(staged) or not self._fs.rename(staged, self._path(f"{self.root}/commits/batch={batch}")):
            raise ValueError(f"batch {batch} is not staged")

    def write(self, batch: str, rows: dict[str, DataFrame]) -> bool:
        """Stage and commit, unless the batch is committed already."""
        if self.committed(batch):
            return False
        self.stage(batch, rows)
        self.commit(batch)
        return True

    def files(self, table: str) -> DataFrame:
        """The committed files of a table: file, first, last, n."""
        if not self._fs.exists(self._path(f"{self.root}/commits")):
            return self.spark.createDataFrame([], _MANIFEST).drop("table")
        every = self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.root}/commits")
        return every.where(F.col("table") == table).drop("table")

    def read(self, table: str, first: object = None, last: object = None) -> DataFrame:
        """The committed rows; with bounds (both included), of the files that reach into them only, and filtered."""
        schema, ts = self.tables[table]
        files = self.files(table)
        within = F.lit(True)
        if first is not None:
            files, within = files.where(F.col("last") >= F.lit(first)), within & (F.col(ts) >= F.lit(first))
        if last is not None:
            files, within = files.where(F.col("first") <= F.lit(last)), within & (F.col(ts) <= F.lit(last))
        paths = [r["file"] for r in files.select("file").collect()]  # names only, as Spark's own listing holds them
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).where(within)

    def append_new(self, batch: str, table: str, rows: DataFrame, key: list[str]) -> bool:
        """Commit the rows of ``rows`` whose key is not stored; of equal keys in the batch one row.  Only files that overlap the batch in time are read."""
        if self.committed(batch):
            return False
        ts = self.tables[table][1]
        first, last = rows.agg(F.min(ts), F.max(ts)).first()
        if first is None:
            return self.write(batch, {table: rows})
        rest = [c for c in self._columns(table) if c not in key]
        one = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
        return self.write(batch, {table: one.join(self.read(table, first, last).select(*key), key, "left_anti")})

    def _columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], self.tables[table][0]).columns


def linked(rows: DataFrame, parents: DataFrame, key: str, ok: Column, what: str) -> DataFrame:
    """``rows`` whose parent in ``parents`` satisfies ``ok``; a row without, or against it, fails the batch before anything is written."""
    both = rows.join(parents, key, "left")
    stop = F.raise_error(F.concat(F.lit(f"{what} of "), F.col(key).cast("string"))).cast("boolean")
    kept = F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(stop)
    return both.where(kept).select(*rows.columns)

"""Written intermediate tables in the folder the cluster names in ``spark.checkpoint.dir``.

An operator that needs a table more than once, or that must cut its lineage, writes it here as
Parquet: the files outlive lost executors and Spark knows their true size when it plans the next join.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator may broadcast; it is counted before the hint is given.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and one machine runs everything, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """A folder of tables of one operator call; removed when the session ends or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back with the schema it was written with."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        # shuffle files of the finished step go when the driver notices that nothing refers to them
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_only(self, *prefixes: str) -> None:
        """Delete the tables that the operator's result does not read any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for entry in fs.listStatus(path) if fs.exists(path) else []:
            if not entry.getPath().getName().startswith(prefixes or ("\0",)):
                fs.delete(entry.getPath(), True)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone already; the cluster clears its checkpoint folder
            pass


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint while the counted size is within the bound; beyond it Spark's shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def flagged(df: DataFrame, rows: DataFrame, key: str = "row") -> DataFrame:
    """``df`` with ``maybe``: whether ``key`` (a 64-bit hash) can be among those of ``rows``; never wrongly false.

    A bit map of at most 8 MB, whatever the size of ``rows``, is broadcast, so that a join that follows
    shuffles only the texts that it needs.  (``rows`` is a saved table: it is read twice.)"""
    bits = min(1 << 26, max(1 << 15, 1 << (16 * max(1, rows.count()) - 1).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits))
    cell, bit = (F.floor(place / 32768)).cast("long"), F.pmod(place, F.lit(32768)).cast("int")
    maps = rows.select(cell.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(floor(_bit / 8) as int) + 1, 1)")), 16, 10).cast("int")
    seen = df.withColumn("_cell", cell).withColumn("_bit", bit).join(F.broadcast(maps), "_cell", "left").withColumn("_byte", byte)
    return seen.withColumn("maybe", F.coalesce(F.expr("(shiftright(_byte, _bit % 8) & 1) = 1"), F.lit(False))).drop("_cell", "_bit", "_map", "_byte")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df

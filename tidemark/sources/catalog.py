"""Tables at rest: tick and bar catalogs, feature store, reference files, ledgers.

Readers take explicit schemas; writers are append-only and idempotent by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeops import PRICE
from tidemark.operators.intake import conflict_free


def write_ticks(ticks: DataFrame, path: str, key: str = "dedupe_key") -> None:
    """One row per key (the earliest arrival), partitioned by instrument and day."""
    first_arrival(ticks, key).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("instrument", "day").option("compression", "zstd").parquet(path)


def write_batch(rows: DataFrame, path: str, key: list[str], most: int) -> int:
    """A guarded batch: refused when larger than ``most``; rows of a key count once.  Returns what was written."""
    fresh = rows.dropDuplicates(key)
    n = fresh.count()
    if n > most:
        raise ValueError(f"a batch of {n} rows is over the bound of {most}")
    fresh.write.mode("append").partitionBy("day").option("compression", "zstd").parquet(path)
    return n


def consolidate(stored: DataFrame, path: str, key: list[str], newest: str) -> None:
    """Batches that overlap, rewritten as one table: of each key the row that arrived last."""
    rest = [c for c in stored.columns if c not in key]
    one = stored.groupBy(*key).agg(F.max_by(F.struct(*rest), newest).alias("_r")).select(*key, "_r.*")
    one.repartition("day").write.mode("overwrite").partitionBy("day").option("compression", "zstd").parquet(path)


def first_arrival(ticks: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("ts_init")
    return ticks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def scan_ticks(spark: SparkSession, path: str, schema: T.StructType, instrument: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Partition filters reach the listing, time filters the Parquet footers."""
    df = spark.read.schema(schema).parquet(path).where(F.col("instrument") == instrument)
    if start:
        df = df.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("day") >= F.to_date(F.lit(start))))
    if end:
        df = df.where((F.col("ts") < F.lit(end).cast("timestamp_ntz")) & (F.col("day") <= F.to_date(F.lit(end))))
    return df


def identity(*parts: Column | str) -> Column:
    """A content-addressed id: the hash of its parts in order."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)), 256)


def encode_bars(bars: DataFrame) -> DataFrame:
    """Prices as exact text with an identity that decoding checks again."""
    cols = ["open", "high", "low", "close", "volume"]
    text = bars.select("instrument", "open_ts", *(F.col(c).cast("string").alias(c) for c in cols))
    return text.withColumn("record_id", _record_id())


def _record_id() -> Column:
    return F.sha2(F.concat_ws("|", "instrument", F.date_format("open_ts", "yyyy-MM-dd HH:mm:ss"), "open", "high", "low", "close", "volume"), 256)


def decode_bars(records: DataFrame) -> DataFrame:
    cols = ["open", "high", "low", "close", "volume"]
    return records.withColumn("valid", F.col("record_id") == _record_id()).select("instrument", "open_ts", *(F.col(c).cast(PRICE).alias(c) for c in cols), "valid")


def append_features(features: DataFrame, path: str, stored: DataFrame | None = None) -> DataFrame:
    """Append ``features(feature_id, content_hash, instrument, timeframe, as_of, ..)`` that are not stored; the same id with
    another hash, stored or in the batch, fails the batch.  Returns what was written."""
    fresh = conflict_free(features, "feature_id", F.col("content_hash"))
    if stored is not None:
        known = stored.select("feature_id", F.col("content_hash").alias("_h"))
        both = fresh.join(known, "feature_id", "left")
        conflict = F.col("_h").isNotNull() & (F.col("_h") != F.col("content_hash"))
        stop = F.raise_error(F.concat(F.lit("conflicting feature "), F.col("feature_id"))).cast("boolean")
        fresh = both.where(F.when(conflict, stop).otherwise(F.col("_h").isNull())).drop("_h")
    fresh.withColumn("day", F.to_date("as_of")).write.mode("append").partitionBy("instrument", "timeframe", "day").option("compression", "zstd").parquet(path)
    return fresh


def feature_history(features: DataFrame, instrument: str, timeframe: str | None = None, version: str | None = None) -> DataFrame:
    out = features.where(F.col("instrument") == instrument)
    out = out.where(F.col("timeframe") == timeframe) if timeframe else out
    out = out.where(F.col("version") == version) if version else out
    return out.orderBy("as_of", "feature_id")


def latest_variants(features: DataFrame, keys: list[str]) -> DataFrame:
    """All rows at each key's newest as_of; ties stay."""
    return features.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("as_of")))).where("_r = 1").drop("_r")


def event_bounds(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """Smallest and largest time: a scan of the one column, reduced in the tasks.  (Spark pushes no aggregate of times into
    Parquet footers, so none is asked for.)"""
    return spark.read.parquet(path).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def read_reference(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict header (a differing one fails), blank lines skipped."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Byte-stable: sorted columns and rows; the files in order of their names are the sorted table, so no task holds all of it."""
    df.select(*sorted(df.columns)).orderBy(*order).write.mode("overwrite").json(path)


def write_report(groups: DataFrame, path: str, title: str, columns: list[str]) -> None:
    """A Markdown table of an aggregate's rows (a line each), written by Spark as text, heading first."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    body = groups.select(F.lit(1).alias("_k"), line.alias("value"))
    head = groups.sparkSession.createDataFrame([(0, i, v) for i, v in enumerate([f"# {title}", "", f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns)])], "_k int, _i int, value string")
    body = body.withColumn("_i", F.lit(0))
    head.unionByName(body).orderBy("_k", "_i", "value").select("value").write.mode("overwrite").text(path)


_NAME = r"^(\d{4}-\d{2}-\d{2}T\d{6})_([A-Z0-9]+)_(\d+[mhd])_(long|short)_([a-z-]+)\.[a-z]+$"


def parse_names(names: DataFrame, col: str = "name", known: list[str] | None = None) -> DataFrame:
    """Time, instrument, timeframe, direction and setup out of a file name; ``error`` where it does not parse."""
    part = lambda i: F.nullif(F.regexp_extract(col, _NAME, i), F.lit(""))
    out = names.withColumns({"taken_ts": F.to_timestamp_ntz(part(1), F.lit("yyyy-MM-dd'T'HHmmss")), "instrument": part(2), "timeframe": part(3), "direction": part(4), "setup": part(5)})
    bad = F.when(F.col("instrument").isNull(), "unparsable")
    if known is not None:
        bad = bad.when(~F.col("instrument").isin(known), "unknown_instrument")
    return out.withColumn("error", bad)


def append_ledger(batch: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """Ledger rows (run_id, event_id, sequence, ..): the first row of each identity that the table does not hold.

    An identity is written once; a row of the batch that has the identity and the sequence of a stored row but another content is a
    collision and fails the batch."""
    content = F.xxhash64(*(c for c in batch.columns if c not in ("run_id", "event_id")))
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy("sequence"))).where("_r = 1").drop("_r")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        stored = spark.read.schema(batch.schema).parquet(path).select("run_id", "event_id", F.col("sequence").alias("_s"), content.alias("_c"))
        both = first.withColumn("_n", content).join(stored, ["run_id", "event_id"], "left")
        collides = (F.col("_s") == F.col("sequence")) & (F.col("_c") != F.col("_n"))
        stop = F.raise_error(F.concat(F.lit("identity collision of "), "run_id", F.lit("/"), "event_id")).cast("boolean")
        first = both.where(F.when(collides, stop).otherwise(F.col("_s").isNull())).select(*batch.columns)
    first.write.mode("append").parquet(path)
    return first


def upsert_profiles(stored: DataFrame, incoming: DataFrame, keys: list[str], guard: str) -> DataFrame:
    """Recency profiles by key: the newest by ``guard``; what is stored wins a tie."""
    both = stored.withColumn("_o", F.lit(1)).unionByName(incoming.withColumn("_o", F.lit(0)))
    cols = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(guard, "_o")).alias("v")).select(*keys, "v.*")


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, run_id: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path).where(F.col("run_id") == run_id).orderBy("sequence")

"""Bars: building from ticks, aggregation to longer frames, ledgers, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import HEALTH, PRICE, anchored_floor, from_micros, micros, worst


def build_bars(trades: DataFrame, seconds: int) -> DataFrame:
    """Time bars of ``trades(instrument, ts, seq, price, size)``; order inside a bar is (ts, seq).

    ``is_complete`` is false for each instrument's newest bar: a bar is complete once a later one exists."""
    at = F.struct("ts", "seq")
    bars = trades.withColumn("open_ts", anchored_floor(F.col("ts"), seconds)).groupBy("instrument", "open_ts").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").cast(PRICE).alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    )
    newest = Window.partitionBy("instrument")
    return bars.withColumn("close_ts", from_micros(micros(F.col("open_ts")) + seconds * 1_000_000)).withColumn("is_complete", F.col("open_ts") < F.max("open_ts").over(newest))


def ohlcv(order: str = "open_ts") -> list[Column]:
    return [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").cast(PRICE).alias("volume")]


def session_aggregate(bars: DataFrame, base_seconds: int, seconds: int, anchor: Column) -> DataFrame:
    """Longer bars counted from the session open; only complete contiguous buckets are emitted."""
    n = seconds // base_seconds
    span = (n - 1) * base_seconds * 1_000_000
    return (
        bars.withColumn("bucket", anchored_floor(F.col("open_ts"), seconds, anchor)).groupBy("instrument", "bucket")
        .agg(*ohlcv(), F.countDistinct("open_ts").alias("n"), (F.max(micros(F.col("open_ts"))) - F.min(micros(F.col("open_ts")))).alias("span"))
        .where((F.col("n") == n) & (F.col("span") == span)).drop("n", "span")
    )


def utc_aggregate(bars: DataFrame, base_seconds: int, seconds: int, strict: bool = False) -> DataFrame:
    """UTC-fixed longer bars of ``bars(.., health, evidence)``: incomplete buckets are dropped, or fail the batch if ``strict``.

    Health is the worst of the parts, fidelity PARTIAL if any volume is missing, evidence the ordered union."""
    n = seconds // base_seconds
    out = bars.withColumn("bucket", anchored_floor(F.col("open_ts"), seconds)).groupBy("instrument", "bucket").agg(
        F.min_by("open", "open_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ts").alias("close"),
        F.when(F.count("volume") == F.count(F.lit(1)), F.sum("volume").cast(PRICE)).alias("volume"),
        worst(F.col("health"), HEALTH).alias("health"),
        F.when(F.count("volume") == F.count(F.lit(1)), "DERIVED").otherwise("PARTIAL").alias("fidelity"),
        F.array_join(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("open_ts", "evidence"))), lambda x: x["evidence"]))), ",").alias("evidence"),
        F.count(F.lit(1)).alias("n"),
    )
    if strict:
        return out.where(F.when(F.col("n") != n, F.raise_error(F.lit("incomplete bucket")).cast("boolean")).otherwise(F.lit(True))).drop("n")
    return out.where(F.col("n") == n).drop("n")


def keep_last(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("_r", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("open_ts")))).where(F.col("_r") <= n).drop("_r")


def resolve_revisions(bars: DataFrame, strict: bool = False) -> DataFrame:
    """One bar per (instrument, open_ts): the latest revision; ``conflict`` tells that values of one revision level differ, which
    fails the batch if ``strict``."""
    sig = F.xxhash64("open", "high", "low", "close", "volume")
    out = bars.groupBy("instrument", "open_ts").agg(
        F.max_by(F.struct("open", "high", "low", "close", "volume"), F.struct("is_revision", "ts_init")).alias("b"),
        (F.countDistinct(F.when(~F.col("is_revision"), sig)) > 1).alias("conflict"),
    ).select("instrument", "open_ts", "b.*", "conflict")
    if strict:
        stop = F.raise_error(F.concat(F.lit("conflicting revisions of "), "instrument")).cast("boolean")
        return out.where(F.when(F.col("conflict"), stop).otherwise(F.lit(True)))
    return out


def first_accepted(bars: DataFrame) -> DataFrame:
    """Ledger admission by arrival: the first bar of a key is ACCEPTED, equal market values later DUPLICATE, others CONFLICT."""
    w = Window.partitionBy("instrument", "open_ts").orderBy("arrival")
    values = F.struct("open", "high", "low", "close", "volume")
    first = F.first(values).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("status", F.when(F.row_number().over(w) == 1, "ACCEPTED").when(values.eqNullSafe(first), "DUPLICATE").otherwise("CONFLICT"))


def history_live_union(history: DataFrame, live: DataFrame, cutoff: Column) -> DataFrame:
    """Historical bars, replaced by live bars of the same key that start at or after the cutoff."""
    both = history.withColumn("_p", F.lit(1)).unionByName(live.where(F.col("open_ts") >= cutoff).withColumn("_p", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("instrument", "open_ts").orderBy("_p", "arrival"))).where("_r = 1").drop("_r", "_p")

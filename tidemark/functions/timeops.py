"""Time building blocks: anchored buckets, islands, interval unions, last value before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE = "decimal(18,6)"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def anchored_floor(ts: Column, seconds: int, anchor: Column | None = None) -> Column:
    """Start of the bucket of ``seconds`` that holds ``ts``, counted from ``anchor`` (default: the epoch)."""
    step = F.lit(seconds * 1_000_000)
    base = F.lit(0).cast("long") if anchor is None else micros(anchor)
    return from_micros(base + F.floor((micros(ts) - base) / step) * step)


def ceil_to(ts: Column, seconds: int) -> Column:
    down = anchored_floor(ts, seconds)
    return F.when(down == ts.cast("timestamp_ntz"), down).otherwise(from_micros(micros(down) + seconds * 1_000_000))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of intervals that overlap or touch: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    run = df.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def last_before(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, value: str, bucket_seconds: int = 86_400) -> DataFrame:
    """As-of match: every row of ``left(key, ts, tie, ...)`` gets the struct ``value`` (ts, ..) of the latest row of ``right``
    of its key at or before it.  On equal times right rows come first.

    Keys are few and large in market data, so the running value is computed inside (key, time bucket) and carried between
    buckets over one summary row each: no task holds a whole key.
    """
    bucket = lambda c: F.floor(micros(c) / (bucket_seconds * 1_000_000))
    names = [c for c in left.columns if c not in (key, ts, tie)]
    pay = F.struct(*(F.col(c).alias(c) for c in names)) if names else F.lit(None)
    fields = [c for c in right.columns if c not in (key, tie)]
    both = left.select(key, ts, tie, F.lit(1).alias("_side"), pay.alias("_row"), F.lit(None).cast(right.select(F.struct(*fields)).schema[0].dataType).alias("_v")).unionByName(
        right.select(key, ts, tie, F.lit(0).alias("_side"), F.lit(None).cast(left.select(pay).schema[0].dataType).alias("_row"), F.struct(*fields).alias("_v"))
    ).withColumn("_b", bucket(F.col(ts)))
    inside = Window.partitionBy(key, "_b").orderBy(ts, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    last = right.withColumn("_b", bucket(F.col(ts))).groupBy(key, "_b").agg(F.max_by(F.struct(*fields), F.struct(ts, tie)).alias("_end"))
    used = both.select(key, "_b").distinct().join(last, [key, "_b"], "left")
    carry = used.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    run = both.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1").join(carry, [key, "_b"], "left")
    return run.select(key, ts, tie, *(F.col(f"_row.{c}").alias(c) for c in names), F.coalesce("_here", "_carry").alias(value))


HEALTH = ["READY", "WARMING", "DEGRADED", "STALE", "UNAVAILABLE", "UNSUPPORTED", "FAILED"]


def rank_of(col: Column, names: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        out = F.when(col == n, i).otherwise(out)
    return out


def worst(col: Column, names: list[str] = HEALTH) -> Column:
    """Aggregate: the last in ``names`` of the group's values."""
    return F.element_at(F.array(*map(F.lit, names)), (F.max(rank_of(col, names)) + 1).cast("int"))

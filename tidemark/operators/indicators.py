"""Indicators over bars: moving averages, ranges, trend, gaps, swings, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import bucket_of, carried, with_halo, without_halo
from tidemark.functions.timeops import micros


def ema(bars: DataFrame, periods: list[int], bucket_seconds: int = 86_400) -> DataFrame:
    """Exponential averages of the close, seeded by the first close, published from the period-th bar on.

    The recurrence is linear.  Inside an (instrument, time bucket) the i-th value is d**i times a running sum of close * d**-i, with d the decay,
    plus d**i times the value before the bucket; a fold over one row a bucket carries these, so no task holds an instrument's history.  A
    bucket may hold some thousands of bars (a day of minutes is 1,440) before d**-i leaves the range of a double."""
    inside = Window.partitionBy("instrument", "_b").orderBy("open_ts")
    rows = bars.select("instrument", "open_ts", F.col("close").cast("double").alias("close")).withColumn("_b", bucket_of("open_ts", bucket_seconds))
    rows = rows.withColumn("_i", F.row_number().over(inside))
    decay = {p: 1 - 2.0 / (p + 1) for p in periods}
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_o{p}": (1 - d) * F.pow(F.lit(d), F.col("_i")) * F.sum(F.col("close") * F.pow(F.lit(d), -F.col("_i"))).over(so_far) for p, d in decay.items()})
    sums = rows.groupBy("instrument", "_b").agg(F.count(F.lit(1)).alias("n"), F.min_by("close", "_i").alias("seed"), *(F.max_by(f"_o{p}", "_i").alias(f"o{p}") for p in periods))
    state = ", ".join(["_n bigint", *(f"_e{p} double" for p in periods)])
    carry = carried(
        sums, ["instrument"], "_b", f"instrument string, _b bigint, {state}",
        lambda r: (0, *(r[3] for _ in periods)),
        lambda s, r: (s[0] + r[2], *(r[4 + k] + s[1 + k] * decay[p] ** r[2] for k, p in enumerate(periods))),
    )
    value = lambda p: F.col(f"_o{p}") + F.col(f"_e{p}") * F.pow(F.lit(decay[p]), F.col("_i"))
    out, count = rows.join(carry, ["instrument", "_b"]), F.col("_n") + F.col("_i")
    return out.select("instrument", "open_ts", "close", *(F.round(F.when(count >= p, value(p)), 6).alias(f"ema{p}") for p in periods))


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Mean of the last ``period`` true ranges; the first bar's true range is its own range."""
    w = Window.partitionBy("instrument", "_b").orderBy("open_ts")
    prev, hl = F.lag("close").over(w), F.col("high") - F.col("low")
    tr = F.when(prev.isNull(), hl).otherwise(F.greatest(hl, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    last = w.rowsBetween(-(period - 1), 0)
    rows = with_halo(bars, ["instrument"], ["open_ts"], period).withColumn("_tr", tr.cast("double"))
    return without_halo(rows.withColumn("atr", F.round(F.when(F.count(F.lit(1)).over(last) == period, F.avg("_tr").over(last)), 6)).drop("_tr"))


def trend(emas: DataFrame, least: int = 50, look: int = 5) -> DataFrame:
    """``emas(.., close, ema20, ema50)``: bullish above a rising stack, bearish below a falling one, else range."""
    w = Window.partitionBy("instrument", "_b").orderBy("open_ts")
    back, n = F.lag("ema20", look).over(w), F.col("_before") + F.count_if(~F.col("_halo")).over(w)
    state = (
        F.when((n < least) | F.col("ema50").isNull(), "insufficient")
        .when((F.col("close") > F.col("ema20")) & (F.col("ema20") > F.col("ema50")) & (F.col("ema20") > back), "bullish")
        .when((F.col("close") < F.col("ema20")) & (F.col("ema20") < F.col("ema50")) & (F.col("ema20") < back), "bearish").otherwise("range")
    )
    return without_halo(with_halo(emas, ["instrument"], ["open_ts"], look).withColumn("trend", state))


def fair_value_gaps(bars: DataFrame, lookback: int = 500, kept: int = 10) -> DataFrame:
    """Three-bar gaps of the newest ``lookback`` bars that no later bar has filled; the newest ``kept`` of each instrument."""
    newest = Window.partitionBy("instrument").orderBy(F.desc("open_ts"))
    rows = bars.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= lookback)
    w = Window.partitionBy("instrument").orderBy("open_ts")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    high2, low2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    rows = rows.select("instrument", "open_ts", "high", "low", high2.alias("_h2"), low2.alias("_l2"), F.min("low").over(later).alias("_lo"), F.max("high").over(later).alias("_hi"))
    gap = F.when(F.col("low") > F.col("_h2"), F.struct(F.lit("bullish").alias("direction"), F.col("_h2").alias("lower"), F.col("low").alias("upper"), (F.col("_lo") <= F.col("_h2")).alias("filled"))).when(
        F.col("high") < F.col("_l2"), F.struct(F.lit("bearish").alias("direction"), F.col("high").alias("lower"), F.col("_l2").alias("upper"), (F.col("_hi") >= F.col("_l2")).alias("filled")))
    active = rows.withColumn("g", gap).where("g IS NOT NULL AND NOT coalesce(g.filled, false)")
    return active.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= kept).select("instrument", "open_ts", "g.direction", "g.lower", "g.upper")


def swing_levels(bars: DataFrame, lookback: int = 500) -> DataFrame:
    """Five-bar fractals of the newest ``lookback`` bars, grouped by exact price: touches and the latest time."""
    rows = bars.withColumn("_r", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("open_ts")))).where(F.col("_r") <= lookback)
    w = Window.partitionBy("instrument").orderBy("open_ts")

    def fractal(c: str, low: bool) -> Column:
        around = [F.lag(c, 1).over(w), F.lag(c, 2).over(w), F.lead(c, 1).over(w), F.lead(c, 2).over(w)]
        x, whole = F.col(c), around[1].isNotNull() & around[3].isNotNull()
        least, most = F.least(*around), F.greatest(*around)
        return whole & (((x <= least) & (x < most)) if low else ((x >= most) & (x > least)))

    rows = rows.withColumn("_s", fractal("low", True)).withColumn("_t", fractal("high", False))
    rows = rows.select("instrument", "open_ts", F.explode(F.array_compact(F.array(F.when(F.col("_s"), F.struct(F.lit("support").alias("kind"), F.col("low").alias("price"))), F.when(F.col("_t"), F.struct(F.lit("resistance").alias("kind"), F.col("high").alias("price")))))).alias("l"))
    return rows.groupBy("instrument", "l.kind", "l.price").agg(F.count(F.lit(1)).alias("touches"), F.max("open_ts").alias("latest_ts"))


def nearest_levels(closes: DataFrame, levels: DataFrame) -> DataFrame:
    """Highest support at or below and lowest resistance at or above ``closes(instrument, close)``."""
    j = closes.join(levels, "instrument", "left")
    return j.groupBy("instrument", "close").agg(F.max(F.when((F.col("kind") == "support") & (F.col("price") <= F.col("close")), F.col("price"))).alias("support"), F.min(F.when((F.col("kind") == "resistance") & (F.col("price") >= F.col("close")), F.col("price"))).alias("resistance"))


def range_position(bars: DataFrame) -> DataFrame:
    """Where each close stands in the session's range so far, 0 to 1."""
    w = Window.partitionBy("instrument", "session").orderBy("open_ts").rowsBetween(Window.unboundedPreceding, 0)
    high, low = F.max("high").over(w), F.min("low").over(w)
    pos = (F.col("close") - low).cast("double") / (high - low).cast("double")
    return bars.withColumn("range_position", F.round(F.when(high == low, F.lit(0.5)).otherwise(F.least(F.greatest(pos, F.lit(0.0)), F.lit(1.0))), 6))

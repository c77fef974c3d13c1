"""Order flow: trade classification, cumulative delta, pressure, clusters of large prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import peak_before, previous, running, sorted_fold, with_halo, without_halo
from tidemark.functions.timeops import PRICE, last_before, micros


def classify_trades(trades: DataFrame, quotes: DataFrame, max_age_seconds: int) -> DataFrame:
    """Side of each trade against the latest quote at or before it, else by the tick rule; every miss has a reason."""
    seen = last_before(previous(trades, ["instrument"], ["ts", "seq"], {"prev": F.col("price")}), quotes.select("instrument", "ts", "seq", "bid", "ask"), "instrument", "ts", "seq", "quote")
    age = micros(F.col("ts")) - micros(F.col("quote.ts"))
    fresh = F.col("quote").isNotNull() & (age <= max_age_seconds * 1_000_000)
    reason = (
        F.when(F.col("quote").isNull(), "no_quote_available").when(~fresh, "quote_stale")
        .when(F.col("price") >= F.col("quote.ask"), "at_or_above_ask").when(F.col("price") <= F.col("quote.bid"), "at_or_below_bid")
        .when(F.col("price") > F.col("prev"), "tick_up").when(F.col("price") < F.col("prev"), "tick_down").otherwise("inside_spread")
    )
    side = F.when(F.col("reason").isin("at_or_above_ask", "tick_up"), "BUY").when(F.col("reason").isin("at_or_below_bid", "tick_down"), "SELL").otherwise("UNKNOWN")
    return seen.withColumn("reason", reason).withColumn("side", side)


def pressure(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Volumes by side, delta, classified ratio and the histogram of reasons."""
    vol = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(F.lit(0))).cast(PRICE)
    parts = classified.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"), vol("BUY").alias("b"), vol("SELL").alias("s"), vol("UNKNOWN").alias("u"))
    total = parts.groupBy(*keys).agg(F.sum("b").cast(PRICE).alias("buy"), F.sum("s").cast(PRICE).alias("sell"), F.sum("u").cast(PRICE).alias("unknown"), F.sum("n").alias("n_trades"),
                                     F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat_ws("=", x["reason"], x["n"].cast("string"))), ";").alias("reasons"))
    return total.withColumns(ratios())


def ratios() -> dict[str, Column]:
    classified = F.col("buy") + F.col("sell")
    total = classified + F.col("unknown")
    return {
        "delta": (F.col("buy") - F.col("sell")).cast("double"),
        "classified_ratio": F.round(F.when(total == 0, F.lit(0.0)).otherwise(classified.cast("double") / total.cast("double")), 6),
        "delta_ratio": F.round(F.when(classified != 0, (F.col("buy") - F.col("sell")).cast("double") / classified.cast("double")), 6),
    }


def cumulative_delta(classified: DataFrame, session: Column) -> DataFrame:
    """Running delta inside each session, gaps in the sequence numbers and trades out of order."""
    w = Window.partitionBy("instrument", "session").orderBy("ts", "seq")
    signed = F.when(F.col("side") == "BUY", F.col("size")).when(F.col("side") == "SELL", -F.col("size")).otherwise(F.lit(0))
    return classified.withColumn("session", session).withColumn("cvd", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))


def sequence_gaps(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Missing sequence numbers: those between the highest seen so far and a jump above it."""
    top = F.col("_top_seq")
    return peak_before(trades, keys, ["ts", "seq"], "_top_seq", F.col("seq")).withColumn("gap", F.when(F.col("seq") > top + 1, F.col("seq") - top - 1).otherwise(F.lit(0))).groupBy(*keys).agg(F.sum("gap").alias("missing"), F.sum((F.col("gap") > 0).cast("long")).alias("jumps"))


def large_trade_clusters(classified: DataFrame, window_ms: int, threshold: float) -> DataFrame:
    """Consecutive prints of one side within ``window_ms`` of each other; emitted and reset when their size reaches the threshold.

    The reset makes it a fold: each instrument's runs (side unchanged, gaps within the window) are independent, so the fold
    runs per run, not per instrument."""
    rows = classified.select("instrument", "ts", "seq", "side", F.col("size").cast("double").alias("size"))
    w = Window.partitionBy("instrument", "_b").orderBy("ts", "seq")
    side, at = F.lag("side").over(w), F.lag("ts").over(w)
    new = side.isNull() | (side != F.col("side")) | (micros(F.col("ts")) - micros(at) > window_ms * 1000)
    rows = without_halo(with_halo(rows, ["instrument"], ["ts", "seq"], 1).withColumn("_new", new.cast("long")))
    runs = running(rows, ["instrument"], ["ts", "seq"], {"run": F.col("_new")}).drop("_new").where("side <> 'UNKNOWN'")

    def make():
        total, prints, first = 0.0, 0, None

        def step(r):
            nonlocal total, prints, first
            first = r.seq if prints == 0 else first
            total, prints = total + r.size, prints + 1
            if total < threshold:
                return []
            out = [(r.instrument, first, r.seq, r.side, total, prints)]
            total, prints = 0.0, 0
            return out

        return step

    schema = "instrument string, first_seq bigint, last_seq bigint, side string, size double, print_count bigint"
    return sorted_fold(runs, ["instrument", "run"], ["ts", "seq"], schema, make)


def bar_pressure_proxy(bars: DataFrame, window: int = 3, baseline: int = 10) -> DataFrame:
    """Direction of the last ``window`` bars, where they close in their range, and pace against the median earlier volume."""
    w = Window.partitionBy("instrument", "island").orderBy("open_ts")
    last, before = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(window + baseline - 1), -window)
    up = F.sum((F.col("close") > F.col("open")).cast("long")).over(last)
    down = F.sum((F.col("close") < F.col("open")).cast("long")).over(last)
    high, low = F.max("high").over(last), F.min("low").over(last)
    vol = F.col("volume").cast("double")
    return bars.select(
        "instrument", "open_ts", up.alias("up"), down.alias("down"),
        F.when(up > down, "UPWARD").when(down > up, "DOWNWARD").otherwise("BALANCED").alias("direction"),
        F.round(F.when(high > low, (F.col("close") - low).cast("double") / (high - low).cast("double")).otherwise(F.lit(0.5)), 6).alias("close_location"),
        F.round(F.when((F.count(F.lit(1)).over(before) == baseline), F.avg(vol).over(last) / F.percentile(vol, F.lit(0.5)).over(before)), 6).alias("pace"),
        F.count(F.lit(1)).over(last).alias("n"),
    ).where(F.col("n") == window).drop("n")

"""Record normalizers and validators: bad rows keep a reason instead of vanishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import PRICE, from_micros, micros


def trades(raw: DataFrame) -> DataFrame:
    """``raw(instrument, ts, trade_id, price, size)``: ids as text; ``reject_reason`` null means accepted."""
    return raw.select(
        F.col("trade_id").cast("string").alias("source_trade_id"), "instrument", "ts", "price", "size",
        F.when(F.col("price").isNull() | (F.col("price") <= 0), "price_not_positive").when(F.col("size").isNull() | (F.col("size") <= 0), "size_not_positive").alias("reject_reason"),
    )


def quotes(raw: DataFrame) -> DataFrame:
    bad = F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") <= 0)
    return raw.withColumn("reject_reason", F.when(bad, "price_not_positive").when(F.col("bid") > F.col("ask"), "crossed").when((F.col("bid_size") < 0) | (F.col("ask_size") < 0), "negative_size"))


def minute_bars(raw: DataFrame, received: Column | None = None) -> DataFrame:
    """Provider one-minute bars: the event time is the open; all volume is of unknown side."""
    out = raw.withColumn("received_ts", received if received is not None else F.col("ts_init")).withColumnRenamed("ts_event", "open_ts")
    zero = F.lit(0).cast(PRICE)
    return out.withColumn("close_ts", from_micros(micros(F.col("open_ts")) + 60_000_000)).withColumns({"buy_volume": zero, "sell_volume": zero, "unknown_volume": F.col("volume")})


def bar_checks(bars: DataFrame) -> DataFrame:
    """``reasons``: every broken price invariant of a bar."""
    body = lambda f: f("open", "close")
    return bars.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("low") > body(F.least), "low_above_body"), F.when(F.col("high") < body(F.greatest), "high_below_body"), F.when(F.col("high") < F.col("low"), "high_below_low"))))


def volume_split(bars: DataFrame) -> DataFrame:
    """Delta, classified ratio and whether the sides add up to the volume."""
    classified = F.col("buy_volume") + F.col("sell_volume")
    return bars.withColumns({
        "delta": F.col("buy_volume") - F.col("sell_volume"),
        "classified_ratio": F.round(F.when(F.col("volume") == 0, F.lit(0.0)).otherwise(classified.cast("double") / F.col("volume").cast("double")), 6),
        "conserved": classified + F.col("unknown_volume") == F.col("volume"),
    })


def response_check(bars: DataFrame, limit: int, start: str, end: str, interval_seconds: int) -> DataFrame:
    """A historical response per instrument: row limit, bounds (the end plus one interval) and strictly increasing opens."""
    w = Window.partitionBy("instrument").orderBy("open_ts")
    lo, hi = F.lit(start).cast("timestamp_ntz"), from_micros(micros(F.lit(end).cast("timestamp_ntz")) + interval_seconds * 1_000_000)
    rows = bars.withColumn("_prev", F.lag("open_ts").over(w))
    return rows.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) <= limit).alias("within_limit"), F.bool_and(F.col("open_ts").between(lo, hi)).alias("within_bounds"),
        F.bool_and(F.col("_prev").isNull() | (F.col("open_ts") > F.col("_prev"))).alias("increasing"),
    )


def source_quality(kind: Column, evidence: Column) -> tuple[Column, Column]:
    """Health and fidelity of a source: history is READY and REPORTED, live follows its evidence."""
    health = F.when(kind == "historical", "READY").when(evidence == "HEALTHY", "READY").when(evidence == "DEGRADED", "DEGRADED").when(evidence == "STALE", "STALE").otherwise("UNAVAILABLE")
    return health, F.when((kind == "historical") | (evidence == "HEALTHY"), "REPORTED").otherwise("PARTIAL")


def value_contract(values: DataFrame) -> DataFrame:
    """Metric values: time order, nulls need a reason, unusable health carries no value."""
    return values.withColumn("violations", F.array_compact(F.array(
        F.when(~((F.col("observed_ts") <= F.col("received_ts")) & (F.col("received_ts") <= F.col("calculated_ts")) & (F.col("calculated_ts") <= F.col("published_ts"))), "time_order"),
        F.when(F.col("value").isNull() & (F.size("missing_reasons") == 0), "null_without_reason"),
        F.when(F.col("value").isNotNull() & F.col("health").isin("UNAVAILABLE", "UNSUPPORTED", "FAILED"), "value_under_bad_health"))))

"""Tidy metric values: one row per metric with value, health, fidelity and the reasons of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import HEALTH, micros, worst
from tidemark.operators.schedule import evaluate


def summaries(bars: DataFrame, calendar: DataFrame, least_coverage: float) -> DataFrame:
    """``bars(instrument, open_ts, close_ts, open, high, low, close, volume, health)`` -> one row per (instrument, trade_date, phase).

    A bar belongs to the session of its last instant; coverage counts what lies inside the session."""
    rows = evaluate(bars.withColumn("_last", F.col("close_ts") - F.expr("INTERVAL 1 MICROSECOND")), "_last", calendar).where("phase <> 'CLOSED'").drop("_last")
    inside = F.least(micros(F.col("close_ts")), micros(F.col("phase_close_ts"))) - F.greatest(micros(F.col("open_ts")), micros(F.col("phase_open_ts")))
    typical = (F.col("high") + F.col("low") + F.col("close")).cast("double") / 3
    volume = F.col("volume").cast("double")
    out = rows.groupBy("instrument", "trade_date", "phase", "phase_open_ts", "phase_close_ts").agg(
        F.min_by("open", "open_ts").cast("double").alias("open"), F.max("high").cast("double").alias("high"), F.min("low").cast("double").alias("low"), F.max_by("close", "open_ts").cast("double").alias("close"),
        F.sum(volume).alias("_v"), F.sum(typical * volume).alias("_pv"), (F.count("volume") == F.count(F.lit(1))).alias("_all"), (F.count("volume") == 0).alias("_none"),
        F.round(F.sum(inside) / F.first(micros(F.col("phase_close_ts")) - micros(F.col("phase_open_ts"))), 6).alias("coverage_ratio"),
        worst(F.col("health"), HEALTH).alias("_health"), F.min("open_ts").alias("_first"), F.max("close_ts").alias("_last"))
    low = F.col("coverage_ratio") < least_coverage
    out = out.withColumns({"opening_observed": F.col("_first") == F.col("phase_open_ts"), "closing_observed": F.col("_last") == F.col("phase_close_ts"), "health": F.when(low, "DEGRADED").otherwise(F.col("_health"))})
    reasons = F.array_compact(F.array(
        F.when(~F.col("opening_observed"), "session_open_not_observed"), F.when(~F.col("closing_observed"), "session_close_not_observed"), F.when(low, "session_coverage_below_threshold"),
        F.when(F.col("_none"), "volume_unsupported").when(~F.col("_all"), "volume_partial").when(F.col("_v") == 0, "zero_session_volume")))
    return out.withColumns({
        "volume": F.when(F.col("_all"), F.col("_v")), "vwap": F.round(F.when(F.col("_all") & (F.col("_v") > 0), F.col("_pv") / F.col("_v")), 6),
        "fidelity": F.when((F.col("health") == "READY") & ~low, "DERIVED").otherwise("PARTIAL"), "reasons": F.array_join(reasons, ",")}).drop("_v", "_pv", "_all", "_none", "_health", "_first", "_last")


def _value(metric: str, value: Column, source: Column, absent: str) -> Column:
    """One tidy value out of a summary struct; without the summary, or without the value, it is unavailable."""
    here = source.isNotNull() & value.isNotNull()
    return F.struct(
        F.lit(metric).alias("metric_id"), F.round(value.cast("double"), 6).alias("value"),
        F.when(here, source["health"]).otherwise("UNAVAILABLE").alias("health"), F.when(here, source["fidelity"]).otherwise("UNAVAILABLE").alias("fidelity"),
        F.when(source.isNull(), absent).otherwise(source["reasons"]).alias("missing_reasons"))


def session_references(found: DataFrame, active: str = "RTH", overnight: str = "GTH") -> DataFrame:
    """The 27 reference values of every (instrument, trade_date): the active session, the one before it, the night before, and the gaps."""
    s = F.struct("open", "high", "low", "close", "volume", "vwap", "coverage_ratio", "health", "fidelity", "reasons", "opening_observed", "closing_observed").alias("s")
    day = found.where(F.col("phase") == active).select("instrument", "trade_date", s)
    before = Window.partitionBy("instrument").orderBy("trade_date")  # a row per session
    day = day.select("instrument", "trade_date", F.col("s").alias("a"), F.lag("s").over(before).alias("p"))
    night = found.where(F.col("phase") == overnight).select("instrument", "trade_date", s.alias("o"))
    rows = day.join(night, ["instrument", "trade_date"], "full_outer")
    a, p, o = F.col("a"), F.col("p"), F.col("o")
    span = lambda x: x["high"] - x["low"]
    place = F.when(span(a) == 0, F.lit(0.5)).otherwise((a["close"] - a["low"]) / span(a))
    no_a, no_p, no_o = "active_session_missing", "previous_session_missing", "overnight_missing"
    values = [_value(f"active_session.{m}", x, a, no_a) for m, x in [("open", a["open"]), ("high", a["high"]), ("low", a["low"]), ("latest_close", a["close"]), ("range", span(a)), ("location", place), ("volume", a["volume"]), ("bar_vwap_estimate", a["vwap"]), ("coverage_ratio", a["coverage_ratio"])]]
    change = F.when(p["open"] != 0, (p["close"] - p["open"]) / p["open"])
    values += [_value(f"previous_session.{m}", x, p, no_p) for m, x in [("open", p["open"]), ("high", p["high"]), ("low", p["low"]), ("close", p["close"]), ("range", span(p)), ("simple_return", change), ("volume", p["volume"]), ("bar_vwap_estimate", p["vwap"]), ("coverage_ratio", p["coverage_ratio"])]]
    values += [_value(f"overnight.{m}", x, o, no_o) for m, x in [("open", o["open"]), ("high", o["high"]), ("low", o["low"]), ("latest_close", o["close"]), ("range", span(o))]]
    close = F.when(p["closing_observed"], p["close"])
    opening = F.when(a["opening_observed"], a["open"])
    for name, x, src, absent in (("indicative", o["close"], o, no_o), ("opening", opening, a, no_a)):
        values += [_value(f"gap.{name}.points", x - close, src, absent), _value(f"gap.{name}.ratio", F.when(close != 0, (x - close) / close), src, absent)]
    return rows.select("instrument", "trade_date", F.explode(F.array(*values)).alias("m")).select("instrument", "trade_date", "m.*")


def window_values(windows: DataFrame, prefix: str, metrics: dict[str, Column], least_coverage: float) -> DataFrame:
    """``windows(instrument, session, .., coverage_ratio, complete)`` wide -> tidy values of one analytical window."""
    low = F.col("coverage_ratio") < least_coverage
    source = F.struct(F.when(low, "DEGRADED").otherwise("READY").alias("health"), F.when(low, "PARTIAL").otherwise("DERIVED").alias("fidelity"), F.when(low, "window_coverage_below_threshold").otherwise("").alias("reasons"))
    values = [_value(f"{prefix}.{m}", x, F.col("_s"), "window_not_started") for m, x in metrics.items()]
    return windows.withColumn("_s", source).select("instrument", "session", F.explode(F.array(*values)).alias("m")).select("instrument", "session", "m.*")


def rolling_values(now: DataFrame, recent: DataFrame, phase: DataFrame, prefix: str) -> DataFrame:
    """The rolling observation of every bar with both baselines, tidy: a window with too little coverage is degraded and has no
    baseline; a baseline with too few references has no value but a reason."""
    keys = ["instrument", "close_ts"]
    r = recent.select(*keys, F.col("expansion_ratio").alias("er"), F.col("range_percentile").alias("pr"), F.col("reference_count").alias("nr"))
    p = phase.select(*keys, F.col("expansion_ratio").alias("ep"), F.col("range_percentile").alias("pp"), F.col("reference_count").alias("np"))
    rows = now.join(r, keys, "left").join(p, keys, "left")
    ok = F.col("eligible")
    source = F.struct(F.when(ok, "READY").otherwise("DEGRADED").alias("health"), F.when(ok, "DERIVED").otherwise("PARTIAL").alias("fidelity"), F.when(ok, "").otherwise("window_coverage_below_threshold").alias("reasons"))

    def baseline(metric, value, count):
        here = value.isNotNull()
        reason = F.when(~ok, "window_coverage_below_threshold").when(here, "").when(count.isNull(), "phase_not_evaluated").otherwise("insufficient_references")
        return F.struct(F.lit(f"{prefix}.{metric}").alias("metric_id"), value.cast("double").alias("value"), F.when(here, "READY").otherwise("UNAVAILABLE").alias("health"), F.when(here, "DERIVED").otherwise("UNAVAILABLE").alias("fidelity"), reason.alias("missing_reasons"))

    values = [_value(f"{prefix}.{m}", F.col(m), F.col("_s"), "") for m in ("price_range", "realized_log_return_magnitude", "average_true_range", "directional_efficiency", "coverage_ratio")]
    values += [baseline("expansion_ratio_recent", F.col("er"), F.col("nr")), baseline("range_percentile_recent", F.col("pr"), F.col("nr")), baseline("expansion_ratio_phase", F.col("ep"), F.col("np")), baseline("range_percentile_phase", F.col("pp"), F.col("np"))]
    return rows.withColumn("_s", source).select(*keys, F.explode(F.array(*values)).alias("m")).select(*keys, "m.*")

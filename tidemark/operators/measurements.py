"""Metric values: quotes, completed bars, sessions, windows and rolling measurements, as tidy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import previous, running, sorted_fold, with_halo, with_time_halo, without_halo
from tidemark.functions.timeops import merged_intervals, micros


def quote_metrics(quotes: DataFrame) -> DataFrame:
    """``quotes(.., bid, ask, evidence)`` -> midpoint and spreads with health and ordered reasons."""
    reasons = F.array_compact(F.array(
        F.when(F.col("evidence") != "HEALTHY", F.concat(F.lit("evidence_"), F.lower("evidence"))),
        F.when(F.col("bid").isNull() | F.col("ask").isNull(), "quote_side_missing"),
        F.when((F.col("bid") <= 0) | (F.col("ask") <= 0), "price_not_positive"),
        F.when(F.col("bid") > F.col("ask"), "crossed_quote"),
    ))
    b, a = F.col("bid").cast("double"), F.col("ask").cast("double")
    usable = F.col("bid").isNotNull() & F.col("ask").isNotNull() & (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") <= F.col("ask")) & F.col("evidence").isin("HEALTHY", "DEGRADED")
    health = F.when(F.col("evidence") == "HEALTHY", F.when(usable, "READY").otherwise("FAILED")).when(F.col("evidence") == "DEGRADED", F.when(usable, "DEGRADED").otherwise("FAILED")).when(F.col("evidence") == "STALE", "STALE").otherwise("UNAVAILABLE")
    value = lambda x: F.round(F.when(usable, x), 6)
    return quotes.withColumns({"midpoint": value((b + a) / 2), "spread_absolute": value(a - b), "spread_relative": value((a - b) / ((a + b) / 2)), "health": health, "missing_reasons": F.array_join(reasons, ",")})


def unpivot(df: DataFrame, ids: list[str], metrics: list[str], prefix: str) -> DataFrame:
    """Wide measurements to one row per metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{prefix}.{m}").alias("metric_id"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return df.select(*ids, pairs.alias("_m")).select(*ids, "_m.metric_id", "_m.value")


def completed_bar_metrics(bars: DataFrame) -> DataFrame:
    """Return and true range against the bar before (any earlier bar of the instrument); null and WARMING for the first."""
    w = Window.partitionBy("instrument").orderBy("open_ts")
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return bars.withColumns({
        "simple_return": F.round(F.when(prev.isNotNull(), (F.col("close") - prev).cast("double") / prev.cast("double")), 6),
        "true_range": F.when(prev.isNotNull(), tr).cast("double"),
        "health": F.when(prev.isNull(), "WARMING").otherwise("READY"),
    })


def price_of(basis: str) -> Column:
    return {"typical": (F.col("high") + F.col("low") + F.col("close")).cast("double") / 3, "close": F.col("close").cast("double"),
            "ohlc4": (F.col("open") + F.col("high") + F.col("low") + F.col("close")).cast("double") / 4}[basis]


def vwap(basis: str = "typical") -> Column:
    v = F.col("volume").cast("double")
    return F.round(F.when(F.sum(v) != 0, F.sum(price_of(basis) * v) / F.sum(v)), 6)


def covered_seconds(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of [open_ts, close_ts)."""
    return merged_intervals(bars.select(*keys, "open_ts", "close_ts"), keys, "open_ts", "close_ts").groupBy(*keys).agg((F.sum(micros(F.col("close_ts")) - micros(F.col("open_ts"))) / 1e6).alias("covered_seconds"))


def session_summary(bars: DataFrame, session_seconds: int, least_coverage: float = 0.8, basis: str = "typical") -> DataFrame:
    """Per (instrument, session): prices, range, location, vwap, coverage, health and reasons; ``bars`` carry session and session_open."""
    out = bars.groupBy("instrument", "session").agg(
        F.min_by("open", "open_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ts").alias("close"),
        F.sum("volume").cast("double").alias("volume"), vwap(basis).alias("vwap"),
        F.round(F.sum(micros(F.col("close_ts")) - micros(F.col("open_ts"))) / (session_seconds * 1e6), 6).alias("coverage_ratio"),
        F.bool_or(F.col("open_ts") == F.col("session_open")).alias("opening_observed"),
    )
    rng = F.col("high") - F.col("low")
    return out.withColumns({
        "range": rng.cast("double"),
        "location": F.round(F.when(rng == 0, F.lit(0.5)).otherwise((F.col("close") - F.col("low")).cast("double") / rng.cast("double")), 6),
        "health": F.when(F.col("coverage_ratio") >= least_coverage, "READY").otherwise("DEGRADED"),
        "missing_reasons": F.array_join(F.array_compact(F.array(F.when(F.col("coverage_ratio") < least_coverage, "coverage_below_minimum"), F.when(~F.col("opening_observed"), "opening_not_observed"))), ","),
    })


def session_gaps(summary: DataFrame) -> DataFrame:
    """Opening gap of each session against the close of the one before."""
    w = Window.partitionBy("instrument").orderBy("session")
    prev = F.lag("close").over(w)
    return summary.withColumns({"previous_close": prev, "gap_points": (F.col("open") - prev).cast("double"), "gap_ratio": F.round((F.col("open") - prev).cast("double") / prev.cast("double"), 6),
                                "previous_return": F.round((prev - F.lag("open").over(w)).cast("double") / F.lag("open").over(w).cast("double"), 6)})


def analytical_window(bars: DataFrame, offset_seconds: int, duration_seconds: int, from_end: bool, session_seconds: int) -> DataFrame:
    """Opening range or closing hour of each session: bars that overlap the window; the latest close goes on after it."""
    begin = micros(F.col("session_open")) + ((session_seconds - duration_seconds) if from_end else offset_seconds) * 1_000_000
    end = begin + duration_seconds * 1_000_000
    o, c = micros(F.col("open_ts")), micros(F.col("close_ts"))
    rows = bars.withColumn("_in", (o < end) & (c > begin)).withColumn("_cov", F.greatest(F.lit(0), F.least(c, end) - F.greatest(o, begin)))
    w = Window.partitionBy("instrument", "session").orderBy("open_ts")
    rows = rows.withColumn("_step", F.when(F.col("_in"), F.abs(F.col("close") - F.lag(F.when(F.col("_in"), F.col("close"))).over(w))))
    inside = lambda x: F.when(F.col("_in"), x)
    out = rows.groupBy("instrument", "session").agg(
        F.min_by(inside(F.col("open")), inside(F.col("open_ts"))).alias("open"), F.max(inside(F.col("high"))).alias("high"), F.min(inside(F.col("low"))).alias("low"),
        F.max_by(inside(F.col("close")), inside(F.col("open_ts"))).alias("close"), F.min_by(inside(F.col("close")), inside(F.col("open_ts"))).alias("_first"),
        F.max_by("close", "open_ts").alias("latest_close"), F.sum("_step").alias("_path"), F.count_if("_in").alias("n"), F.round(F.sum("_cov") / (duration_seconds * 1e6), 6).alias("coverage_ratio"),
    ).where("n > 0")
    return out.withColumns({
        "range": (F.col("high") - F.col("low")).cast("double"),
        "distance_above_high": F.greatest(F.col("latest_close") - F.col("high"), F.lit(0)).cast("double"),
        "distance_below_low": F.greatest(F.col("low") - F.col("latest_close"), F.lit(0)).cast("double"),
        "directional_efficiency": F.round(F.when((F.col("n") > 1) & (F.col("_path") != 0), F.abs(F.col("close") - F.col("_first")).cast("double") / F.col("_path").cast("double")), 6),
        "complete": F.col("coverage_ratio") >= 1,
    }).drop("_path", "_first")


def rolling_windows(bars: DataFrame, bar_seconds: int, window_seconds: int, least_coverage: float) -> DataFrame:
    """One observation at every bar's close over the bars that lie whole in (close - window, close]."""
    w = Window.partitionBy("instrument", "_b").orderBy("_end").rangeBetween(-(window_seconds - bar_seconds), 0)
    rows = with_time_halo(bars.withColumn("_end", F.floor(micros(F.col("close_ts")) / 1_000_000)), "_end", window_seconds)
    items = F.sort_array(F.collect_list(F.struct("_end", F.col("high").cast("double").alias("h"), F.col("low").cast("double").alias("l"), F.col("close").cast("double").alias("c"))).over(w))
    rows = rows.select("instrument", "close_ts", "_end", "_halo", F.max("high").over(w).alias("_h"), F.min("low").over(w).alias("_l"), items.alias("_i")).where("NOT _halo")
    pairs = F.expr("transform(sequence(2, greatest(size(_i), 2)), j -> struct(_i[j - 2] as p, _i[j - 1] as q))")
    rows = rows.withColumn("_p", F.when(F.size("_i") > 1, pairs))
    total = lambda e: F.aggregate("_p", F.lit(0.0), lambda a, x: a + e(x))
    path = total(lambda x: F.abs(x["q"]["c"] - x["p"]["c"]))
    first = F.col("_i")[0]
    return rows.select(
        "instrument", "close_ts", "_end", (F.col("_h") - F.col("_l")).cast("double").alias("price_range"),
        F.round(F.least(F.lit(1.0), F.size("_i") * bar_seconds / window_seconds), 6).alias("coverage_ratio"), F.size("_i").cast("long").alias("n_bars"),
        F.round(F.sqrt(total(lambda x: F.pow(F.log(x["q"]["c"] / x["p"]["c"]), 2))), 6).alias("realized_log_return_magnitude"),
        F.round((first["h"] - first["l"] + F.coalesce(total(lambda x: F.greatest(x["q"]["h"] - x["q"]["l"], F.abs(x["q"]["h"] - x["p"]["c"]), F.abs(x["q"]["l"] - x["p"]["c"]))), F.lit(0.0))) / F.size("_i"), 6).alias("average_true_range"),
        F.round(F.when(path != 0, F.abs(F.element_at("_i", -1)["c"] - first["c"]) / path), 6).alias("directional_efficiency"),
        (F.size("_i") * bar_seconds >= least_coverage * window_seconds).alias("eligible"),
    )


def recent_baseline(bars: DataFrame, bar_seconds: int, window_seconds: int, references: int, least_coverage: float, least_references: int) -> DataFrame:
    """Each window's range against the ranges of the ``references`` back-to-back windows before it.

    An earlier window is the same range frame shifted by whole windows, so all of them come out of one pass over (instrument, time
    bucket); windows with too little coverage are skipped and not replaced; ratio to the median and midrank percentile."""
    ends = bars.select("instrument", "close_ts", F.floor(micros(F.col("close_ts")) / 1_000_000).alias("_end"), "high", "low")
    rows = with_time_halo(ends, "_end", (references + 1) * window_seconds)
    order = Window.partitionBy("instrument", "_b").orderBy("_end")

    def covered(k: int) -> Column:
        w = order.rangeBetween(-(k + 1) * window_seconds + bar_seconds, -k * window_seconds)
        enough = F.count(F.lit(1)).over(w) * bar_seconds >= least_coverage * window_seconds
        return F.when(enough, (F.max("high").over(w) - F.min("low").over(w)).cast("double"))

    earlier = F.array_compact(F.array(*(covered(k) for k in range(1, references + 1))))
    rows = rows.withColumns({"price_range": covered(0), "ranges": earlier}).where("NOT _halo AND price_range IS NOT NULL")
    return _against(rows.select("instrument", "close_ts", "_end", "price_range", "ranges"), least_references)


def _against(df: DataFrame, least: int) -> DataFrame:
    n = F.size("ranges")
    sorted_ = F.sort_array("ranges")
    median = F.when(n % 2 == 1, F.get(sorted_, F.floor(n / 2).cast("int"))).otherwise((F.get(sorted_, (F.floor(n / 2) - 1).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2)
    below = F.size(F.filter("ranges", lambda x: x < F.col("price_range")))
    equal = F.size(F.filter("ranges", lambda x: x == F.col("price_range")))
    enough = n >= least
    return df.withColumns({
        "reference_count": n.cast("long"),
        "expansion_ratio": F.round(F.when(enough & (median != 0), F.col("price_range") / median), 6),
        "range_percentile": F.round(F.when(enough, (below + equal / 2) / n), 6),
    }).drop("ranges")


def phase_baseline(bars: DataFrame, bar_seconds: int, window_seconds: int, sessions: int, least_coverage: float, least_references: int) -> DataFrame:
    """Each window's range against the same stretch of the newest ``sessions`` earlier sessions that cover it.

    A stretch that ends at an offset exists in a session even when its last bar does not, so every bar goes to all stretches
    that hold it; the references of a stretch are then the rows before it in one window by (instrument, offset)."""
    offset = F.floor((micros(F.col("close_ts")) - micros(F.col("session_open"))) / 1_000_000)
    reach = F.explode(F.sequence(F.lit(0), F.lit(window_seconds // bar_seconds - 1)))
    held = bars.select("instrument", "session", "close_ts", "high", "low", offset.alias("offset"), reach.alias("j")).withColumn("offset", F.col("offset") + F.col("j") * bar_seconds)
    stretch = held.groupBy("instrument", "session", "offset").agg(
        (F.max("high") - F.min("low")).cast("double").alias("price_range"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("j") == 0, F.col("close_ts"))).alias("close_ts"))
    before = Window.partitionBy("instrument", "offset").orderBy("session").rowsBetween(-sessions, -1)
    rows = stretch.where(F.col("n") * bar_seconds >= least_coverage * window_seconds).withColumn("ranges", F.collect_list("price_range").over(before))
    return _against(rows.where("close_ts IS NOT NULL").select("instrument", "session", "close_ts", "offset", "price_range", "ranges"), least_references)


def rate_suppressed(quotes: DataFrame, min_ms: int) -> DataFrame:
    """Quotes published under a minimum interval per instrument.

    Every publication moves the mark, but a gap of the whole interval always publishes; the runs between such gaps are folded
    independently, so neither an instrument's history nor a run is ever held."""
    rows = quotes.select("instrument", "ts", "seq", micros(F.col("ts")).alias("us"))
    w = Window.partitionBy("instrument", "_b").orderBy("ts", "seq")
    gap = F.col("us") - F.lag("us").over(w)
    rows = without_halo(with_halo(rows, ["instrument"], ["ts", "seq"], 1).withColumn("_gap", F.when(gap < min_ms * 1000, 0).otherwise(1).cast("long")))
    runs = running(rows, ["instrument"], ["ts", "seq"], {"run": F.col("_gap")}).select("instrument", "run", "ts", "seq", "us")

    def make():
        last = None

        def step(r):
            nonlocal last
            ok = last is None or r.us - last >= min_ms * 1000
            last = r.us if ok else last
            return [(r.instrument, r.ts, r.seq, ok)]

        return step

    return sorted_fold(runs, ["instrument", "run"], ["ts", "seq"], "instrument string, ts timestamp_ntz, seq bigint, published boolean", make)


def changed_only(df: DataFrame, key: str, order: str, signature: list[str]) -> DataFrame:
    """Rows whose signature differs from the row before (nulls are values); ``order`` is a time."""
    sig = F.struct(*signature)
    rows = previous(df, [key], [order], {"_s": sig, "_seen": F.lit(True)})
    return rows.where(F.col("_seen").isNull() | ~sig.eqNullSafe(F.col("_s"))).drop("_s", "_seen")


def with_utc_session(bars: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "open_ts").cast("timestamp_ntz")
    return bars.withColumn("session", day).withColumn("session_open", day)


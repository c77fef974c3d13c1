"""Signals: direction, regimes, episodes, lifecycle, confirmation windows, evidence and health machines.

Rules over one row are expressions; rules over the row before are windows; only true state machines (whose next state depends on
their own last state) are folds, one keyed group of a bounded session or instrument at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ahead import first_ahead, millionths, points_up
from tidemark.functions.carry import carried, sorted_fold, with_halo, without_halo
from tidemark.functions.timeops import micros


def qualify_direction(bundles: DataFrame) -> DataFrame:
    """``bundles(evaluation, primary1, primary2, confirm, context)`` of direction scores (null: missing) -> qualified side and reason.

    Gates in order: evaluation present, primaries present, neutral, disagreement, confirmation; an opposed context degrades."""
    s = lambda c: F.signum(F.col(c))
    reason = (
        F.when(F.col("evaluation").isNull(), "evaluation_missing").when(F.col("primary1").isNull() | F.col("primary2").isNull(), "primary_missing")
        .when((s("primary1") == 0) | (s("primary2") == 0), "neutral").when(s("primary1") != s("primary2"), "disagreement")
        .when(F.col("confirm").isNull() | (s("confirm") != s("primary1")), "unconfirmed").when(s("context") == -s("primary1"), "context_opposed").otherwise("qualified")
    )
    ok = reason.isin("qualified", "context_opposed")
    return bundles.withColumn("reason", reason).withColumn("direction", F.when(ok & (s("primary1") > 0), "LONG").when(ok & (s("primary1") < 0), "SHORT")).withColumn("degraded", reason == "context_opposed")


def regimes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A new candidate only when a qualified direction differs from the last qualified one; unqualified rows keep the regime."""
    w = Window.partitionBy(key).orderBy(order)
    last = F.last("direction", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("new_candidate", F.col("direction").isNotNull() & ~F.col("direction").eqNullSafe(last)).withColumn("regime", F.last("direction", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def transitions(rows: DataFrame, keys: list[str], order: str, value: str, ignored: list[str]) -> DataFrame:
    """Changes of a state between consecutive rows; ignored states are neither ends of a change."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = rows.where(~F.col(value).isin(ignored)).withColumn("from_state", F.lag(value).over(w))
    return seen.where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(value))).select(*keys, order, "from_state", F.col(value).alias("to_state"))


def confirmation_window(bars: DataFrame, k: int, min_ratio: float, min_delta: float, side: int, most_adverse: float = 1.0) -> DataFrame:
    """Last k bars: classified ratio, signed delta share, follow-through and adverse move in units of the range mean; reasons failed."""
    w = Window.partitionBy("instrument", "island").orderBy("open_ts").rowsBetween(-(k - 1), 0)
    d = lambda c: F.col(c).cast("double")
    buy, sell, vol = F.sum(d("buy_volume")).over(w), F.sum(d("sell_volume")).over(w), F.sum(d("volume")).over(w)
    first = F.first(d("open")).over(w)
    unit = F.avg(d("high") - d("low")).over(w)
    rows = bars.withColumns({
        "n": F.count(F.lit(1)).over(w), "classified_ratio": F.round(F.when(vol != 0, (buy + sell) / vol).otherwise(F.lit(0.0)), 6),
        "delta_ratio": F.round(F.when(buy + sell != 0, side * (buy - sell) / (buy + sell)).otherwise(F.lit(0.0)), 6),
        "follow": F.round(F.when(unit != 0, side * (d("close") - first) / unit).otherwise(F.lit(0.0)), 6),
        "adverse": F.round(F.when(unit != 0, F.greatest(first - F.min(d("low")).over(w) if side > 0 else F.max(d("high")).over(w) - first, F.lit(0.0)) / unit).otherwise(F.lit(0.0)), 6),
    })
    fails = F.array_compact(F.array(F.when(F.col("classified_ratio") < min_ratio, "classified_ratio"), F.when(F.col("delta_ratio") < min_delta, "delta"), F.when(F.col("follow") < 0.1, "follow_through"), F.when(F.col("adverse") > most_adverse, "adverse_move")))
    return rows.withColumn("failures", F.array_join(fails, ",")).where(F.col("n") == k)


def pace(bars: DataFrame, window: int, baseline: int) -> DataFrame:
    """Mean volume of the window over the median of the baseline before it; null while the baseline is short."""
    w = Window.partitionBy("instrument").orderBy("open_ts")
    v, before = F.col("volume").cast("double"), w.rowsBetween(-(window + baseline - 1), -window)
    return bars.withColumn("pace", F.round(F.when(F.count(F.lit(1)).over(before) == baseline, F.avg(v).over(w.rowsBetween(-(window - 1), 0)) / F.percentile(v, F.lit(0.5)).over(before)), 6))


def episodes(rows: DataFrame, confirm: int, schema_key: str = "instrument") -> DataFrame:
    """Location episodes of ``rows(key, session, ts, inside boolean, favourable int)``: entered, held, rejected after ``confirm``
    consecutive adverse rows, confirmed after as many favourable ones, exited outside."""

    def make():
        state, run = "idle", 0

        def step(r):
            nonlocal state, run
            event = None
            if state == "idle":
                if r.inside:
                    state, run, event = "active", 0, "entered"
            elif not r.inside:
                state, run, event = "idle", 0, "exited"
            else:
                run = (run + 1 if run >= 0 else 1) if r.favourable > 0 else (run - 1 if run <= 0 else -1) if r.favourable < 0 else 0
                if run == confirm and state == "active":
                    state, event = "confirmed", "confirmed"
                elif run == -confirm:
                    state, run, event = "idle", 0, "rejected"
            return [(r[0], r.session, r.ts, event)] if event else []

        return step

    return sorted_fold(rows, [schema_key, "session"], ["ts"], f"{schema_key} string, session timestamp_ntz, ts timestamp_ntz, event string", make)


ALLOWED = {"candidate": ("armed", "expired"), "armed": ("triggered", "invalidated", "expired"), "triggered": ("invalidated", "expired")}


def lifecycle_check(steps: DataFrame, key: str, order: str) -> DataFrame:
    """Each step must start where the last one ended and be an allowed move."""
    w = Window.partitionBy(key).orderBy(order)
    ok = F.lit(False)
    for a, bs in ALLOWED.items():
        ok = ok | ((F.col("from_status") == a) & F.col("to_status").isin(*bs))
    prev = F.lag("to_status").over(w)
    return steps.withColumn("chained", F.coalesce(prev == F.col("from_status"), F.col("from_status") == "candidate")).withColumn("allowed", ok)


def recency(gaps: DataFrame, key: str, order: str, value: str, decay: float = 0.95, chunk: int = 4096) -> DataFrame:
    """Exponentially weighted mean and variance of arrival gaps: mean += a d; variance = decay (variance + a d d).

    A step is linear in the mean and, with it, quadratic in the variance, and such steps compose: the gaps whose ``order`` number lies
    in one chunk fold to six coefficients, and only these pass from chunk to chunk."""
    a = 1 - decay
    names = ("A", "B", "C", "D", "E", "G")
    start = F.struct(*(F.lit(x).alias(n) for n, x in zip(names, (1.0, 0.0, 1.0, 0.0, 0.0, 0.0), strict=True)))

    def step(s: Column, x: Column) -> Column:  # mean = A m + B; variance = C v + D m m + E m + G
        d = x["x"] - s["B"]
        new = {
            "A": s["A"] * (1 - a), "B": s["B"] + a * d, "C": decay * s["C"], "D": decay * (s["D"] + a * s["A"] * s["A"]),
            "E": decay * (s["E"] - 2 * a * d * s["A"]), "G": decay * (s["G"] + a * d * d),
        }
        return F.struct(*(new[n].alias(n) for n in names))

    item = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    packed = gaps.withColumn("_b", F.floor(F.col(order) / chunk)).groupBy(key, "_b").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    folded = packed.withColumn("s", F.aggregate("xs", start, step)).select(key, "_b", F.size("xs").cast("long").alias("n"), F.col("xs")[0]["x"].alias("first"), "s.*")
    after = lambda s, r: (s[0] + r[2], r[4] * s[1] + r[5], r[6] * s[2] + r[7] * s[1] * s[1] + r[8] * s[1] + r[9])
    kind = f"{key} {gaps.schema[key].dataType.simpleString()}"
    before = carried(folded, [key], "_b", f"{kind}, _b bigint, _n bigint, _m double, _v double", lambda r: (0, r[3], 0.0), after)
    m, v = F.col("_m"), F.col("_v")
    last = folded.join(before, [key, "_b"]).groupBy(key).agg(F.max_by(F.struct((F.col("_n") + F.col("n")).alias("samples"), F.round(F.col("A") * m + F.col("B"), 6).alias("mean"), F.round(F.col("C") * v + F.col("D") * m * m + F.col("E") * m + F.col("G"), 6).alias("variance")), "_b").alias("s"))
    return last.select(key, "s.*")


def adaptive_thresholds(profiles: DataFrame, ks: tuple[float, ...] = (2, 4, 8), floor: float = 1.0, most: float = 1e6) -> DataFrame:
    """mean + k sigma, clamped, strictly rising."""
    sigma = F.sqrt("variance")
    out, last = {}, None
    for name, k in zip(("degraded_after", "stale_after", "unavailable_after"), ks, strict=True):
        x = F.least(F.greatest(F.bround(F.col("mean") + k * sigma, 0), F.lit(floor)), F.lit(most))
        last = x if last is None else F.greatest(x, last + 1)
        out[name] = last
    return profiles.withColumns(out)


def assess_evidence(age_seconds: Column, subscribed: Column, open_: Column, degraded: float, stale: float, gone: float) -> Column:
    """Evidence state: session first, then subscription, then age."""
    return F.when(~open_, "DORMANT").when(~subscribed, "UNAVAILABLE").when(age_seconds.isNull(), "NOT_EVALUATED").when(age_seconds <= degraded, "HEALTHY").when(age_seconds <= stale, "DEGRADED").when(age_seconds <= gone, "STALE").otherwise("UNAVAILABLE")


def hysteresis(rows: DataFrame, key: str, order: str | list[str], value: str, high: float, low: float, confirm: int) -> DataFrame:
    """Alarm after ``confirm`` consecutive values above ``high``, cleared by one below ``low``.

    Both marks are known from the last ``confirm`` rows, so an event is a mark that differs from the mark before it."""
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(key, "_b").orderBy(*order)
    last = w.rowsBetween(-(confirm - 1), 0)
    raised = (F.min(value).over(last) > high) & (F.count(F.lit(1)).over(last) == confirm)
    mark = F.when(raised, "raised").when(F.col(value) < low, "cleared")
    marks = without_halo(with_halo(rows, [key], order, confirm - 1).withColumn("event", mark)).where("event IS NOT NULL") if confirm > 1 else rows.withColumn("event", mark).where("event IS NOT NULL")
    before = F.coalesce(F.lag("event").over(w), F.lit("cleared"))
    changed = with_halo(marks, [key], order, 1).withColumn("_e", before)
    return without_halo(changed).where(F.col("event") != F.col("_e")).select(key, *order, "event")


def first_hit(episodes_: DataFrame, prices: DataFrame, points: float, window_seconds: int) -> DataFrame:
    """Outcome of ``episodes_(id, instrument, ts, price, sign)``: which of +points or -points comes first within the window, in rows after ``id``."""
    price, step = millionths("price"), F.when(F.col("id").isNotNull(), points_up(points))
    ep = episodes_.select("id", "instrument", "ts", "sign", (price + step).alias("up"), (price - step).alias("down"), F.coalesce("id", F.lit(0)).cast("long").alias("level"))
    rows = prices.where("seq IS NOT NULL").select("instrument", F.col("ts").alias("rts"), F.col("seq").alias("rseq"), price.alias("price"), F.col("seq").alias("rlevel"))
    got = first_ahead(ep, rows, window_seconds, after=False, mirrored=False)
    outcome = F.when(F.col("rose") == (F.col("sign") > 0), "with_flow").when(F.col("rose").isNotNull(), "trapped").otherwise("unresolved")
    return got.select("id", "instrument", outcome.alias("outcome"))


def readiness(latest: DataFrame, as_of: Column, seconds: int, tolerated: int, full: int, partial: int) -> DataFrame:
    """``latest(instrument, close_ts, depth)``: lag in intervals, freshness and depth status."""
    lag = F.ceil((micros(as_of) - micros(F.col("close_ts"))) / (seconds * 1_000_000))
    return latest.withColumn("lag_intervals", lag).withColumn("freshness", F.when(lag <= tolerated, "current").otherwise("lagging")).withColumn("depth_status", F.when(F.col("depth") >= full, "full").when(F.col("depth") >= partial, "partial").otherwise("insufficient"))

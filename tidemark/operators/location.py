"""Market context at every bar, and whether price stands at a location: zones of four sources, tolerance, clusters, confluence.

A bar's context looks back a bounded number of bars, so it is computed in blocks of bars with a copy of the block before.
What a bar carries is bounded too: the nearest level of either side, at most ten open gaps, one value area and one average
price.  An evaluation takes the newest context of every timeframe by an as-of match, so no zone is ever joined with all bars.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import running
from tidemark.functions.timeops import last_before
from tidemark.operators.indicators import atr

#: Bars in which levels and gaps are looked for, and gaps that are kept.
LOOKBACK, GAPS = 500, 10
GAP = "array<struct<bullish: boolean, detected_ts: timestamp_ntz, lower: double, upper: double>>"
_LEVELS = f"instrument string, open_ts timestamp_ntz, support double, support_ts timestamp_ntz, resistance double, resistance_ts timestamp_ntz, gaps {GAP}"


def _extremes(x: np.ndarray) -> np.ndarray:
    """Places that are no greater than the two neighbours on either side, and less than one of them."""
    at = np.zeros(len(x), bool)
    if len(x) >= 5:
        around = np.stack([x[:-4], x[1:-3], x[3:-1], x[4:]])
        at[2:-2] = (x[2:-2] <= around).all(0) & (x[2:-2] < around).any(0)
    return at


def _levels_of(bars: pd.DataFrame) -> pd.DataFrame:
    """Nearest levels and open gaps at each bar of a stretch, the copies before it included in the look back."""
    bars = bars.sort_values("open_ts", ignore_index=True)
    high, low, close, end = (bars[c].to_numpy() for c in ("high", "low", "close", "close_ts"))
    top, bottom = bars["session_high"].to_numpy(), bars["session_low"].to_numpy()
    swings = {"s": np.flatnonzero(_extremes(low)), "r": np.flatnonzero(_extremes(-high))}
    up = np.flatnonzero(low[2:] > high[:-2]) + 2
    down = np.flatnonzero(high[2:] < low[:-2]) + 2
    gaps = sorted([(i, True, high[i - 2], low[i]) for i in up] + [(i, False, high[i], low[i - 2]) for i in down])
    filled = []
    for i, bullish, lower, upper in gaps:
        hit = np.flatnonzero(low[i + 1 :] <= lower) if bullish else np.flatnonzero(high[i + 1 :] >= upper)
        filled.append(i + 1 + hit[0] if len(hit) else len(bars))
    born, filled = np.array([g[0] for g in gaps], int), np.array(filled, int)

    def nearest(f: int, places: np.ndarray, price: np.ndarray, own: float, sign: int) -> tuple:
        """The session's extreme so far or the swing that is closer to the close on its side; the newest of equal prices."""
        seen = places[(places >= f - LOOKBACK + 3) & (places <= f - 2)]
        seen = seen[sign * price[seen] <= sign * close[f]]
        best = max((sign * price[i], i) for i in seen) if len(seen) else None
        if best is None or sign * own >= best[0]:
            return own, end[f]
        return price[best[1]], end[best[1]]

    rows = []
    for f in np.flatnonzero(~bars["_halo"].to_numpy(bool)):
        live = np.flatnonzero((born <= f) & (born >= f - LOOKBACK + 3) & (filled > f))[-GAPS:]
        held = [{"bullish": bool(gaps[g][1]), "detected_ts": pd.Timestamp(end[gaps[g][0]]), "lower": float(gaps[g][2]), "upper": float(gaps[g][3])} for g in live]
        rows.append((bars["instrument"][f], bars["open_ts"][f], *nearest(f, swings["s"], low, bottom[f], 1), *nearest(f, swings["r"], high, top[f], -1), held))
    return pd.DataFrame(rows, columns=["instrument", "open_ts", "support", "support_ts", "resistance", "resistance_ts", "gaps"])


def value_area_of(volume: dict[int, int]) -> tuple[int, int, int]:
    """Point of control (higher on ties) and the ends of the area grown from it to 70 percent, the lower side first on ties."""
    prices = sorted(volume)
    poc = max(prices, key=lambda p: (volume[p], p))
    left = right = prices.index(poc)
    held, total = volume[poc], sum(volume.values())
    while 10 * held < 7 * total:
        below = volume[prices[left - 1]] if left else -1
        above = volume[prices[right + 1]] if right + 1 < len(prices) else -1
        if above > below:
            right += 1
            held += above
        else:
            left -= 1
            held += below
    return poc, prices[left], prices[right]


def _developing(bin_size: int):
    """Value area of a session's bars so far; a bar's volume, in millionths, is dealt evenly over its bins, the rest to the last."""

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        volume: dict[int, int] = {}
        rows = []
        for r in bars.sort_values("open_ts").itertuples(index=False):
            lo, hi = int(r.lo), int(r.hi)
            share = int(r.micro) // (hi - lo + 1)
            for b in range(lo, hi + 1):
                volume[b] = volume.get(b, 0) + (share if b < hi else int(r.micro) - share * (hi - lo))
            rows.append((r.instrument, r.open_ts, *(float(b * bin_size) for b in value_area_of(volume))))
        return pd.DataFrame(rows, columns=["instrument", "open_ts", "poc", "value_area_low", "value_area_high"])

    return run


def context_features(bars: DataFrame, bin_size: int) -> DataFrame:
    """``bars(instrument, open_ts, close_ts, high, low, close, volume, session)`` of one timeframe -> per bar: as_of, close, atr, the session so far
    (high, low, vwap, value area, point of control), nearest support and resistance with their times, open gaps."""
    so_far = Window.partitionBy("instrument", "session").orderBy("open_ts").rowsBetween(Window.unboundedPreceding, 0)
    paid, volume = F.sum((F.col("high") + F.col("low") + F.col("close")) * F.col("volume")).over(so_far), F.sum("volume").over(so_far)
    vwap = F.when(volume != 0, F.round(paid.cast("double") / 3 / volume.cast("double"), 6))
    rows = bars.select("instrument", "session", "open_ts", "close_ts", "high", "low", "close", F.max("high").over(so_far).alias("session_high"), F.min("low").over(so_far).alias("session_low"), vwap.alias("vwap"))
    doubles = {c: F.col(c).cast("double") for c in ("high", "low", "close", "session_high", "session_low")}
    # bars by number in blocks of LOOKBACK, each with a copy of the block before: all that any of its bars looks back to
    past = running(rows.drop("session", "vwap").withColumns(doubles), ["instrument"], ["open_ts"], {"_n": F.lit(1)})
    past = past.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"_b": F.floor((F.col("_n") - 1) / LOOKBACK) + F.col("_copy"), "_halo": F.col("_copy") == 1})
    levels = past.drop("_n", "_copy").groupBy("instrument", "_b").applyInPandas(_levels_of, _LEVELS)
    bins = bars.where("volume > 0").select(
        "instrument", "session", "open_ts", F.floor(F.col("low") / bin_size).alias("lo"), F.ceil(F.col("high") / bin_size).alias("hi"), (F.col("volume") * 1_000_000).cast("long").alias("micro"))
    areas = bins.groupBy("instrument", "session").applyInPandas(_developing(bin_size), "instrument string, open_ts timestamp_ntz, poc double, value_area_low double, value_area_high double")
    key = ["instrument", "open_ts"]
    ranges = atr(bars.select("instrument", "open_ts", "high", "low", "close")).select(*key, "atr")
    out = rows.withColumns(doubles).join(levels, key).join(ranges, key).join(areas, key, "left")
    return out.withColumnRenamed("close_ts", "as_of").drop("high", "low")


@dataclass(frozen=True)
class Source:
    """Zones of one kind from some timeframes; ``fraction`` of the average true range is the tolerance around them."""

    kind: str
    timeframes: tuple[str, ...]
    fraction: float


def _zone(kind: str, tf: str, name: str, at: Column, lower: Column, upper: Column, fraction: float) -> Column:
    unit = F.col(f"_{tf}.atr")
    slack = F.lit(0.0) if fraction == 0 else F.when(unit > 0, F.round(unit * fraction, 6))
    text = lambda p: p.cast("decimal(18,6)").cast("string")
    zone_id = F.concat_ws("|", F.lit(tf), F.lit(name), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), text(lower), text(upper))
    fields = {"zone_id": zone_id, "source": F.lit(kind), "timeframe": F.lit(tf), "reported": F.lit(kind != "value_area_edge"), "lower": lower, "upper": upper, "tolerance": slack}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _zones(source: Source, tf: str) -> Column:
    f, long = F.col(f"_{tf}"), F.col("direction") == "LONG"
    one = lambda z, there: F.when(there, F.array(z)).otherwise(F.array().cast(_ZONES))
    if source.kind == "structural_level":
        price, at = F.when(long, f["support"]).otherwise(f["resistance"]), F.when(long, f["support_ts"]).otherwise(f["resistance_ts"])
        z = _zone(source.kind, tf, "level", at, price, price, source.fraction)
        return one(z, price.isNotNull())
    if source.kind == "fair_value_gap":
        mine = F.filter(F.coalesce(f["gaps"], F.array().cast(GAP)), lambda g: g["bullish"] == long)
        return F.transform(mine, lambda g: _zone(source.kind, tf, "gap", g["detected_ts"], g["lower"], g["upper"], source.fraction))
    if source.kind == "value_area_edge":
        price = F.when(long, f["value_area_low"]).otherwise(f["value_area_high"])
    else:
        price = f["vwap"]
    return one(_zone(source.kind, tf, source.kind, f["session"], price, price, source.fraction), price.isNotNull())


_ZONES = "array<struct<zone_id: string, source: string, timeframe: string, reported: boolean, lower: double, upper: double, tolerance: double>>"


def qualify_locations(evaluations: DataFrame, features: dict[str, DataFrame], sources: list[Source], minimum_sources: int) -> DataFrame:
    """``evaluations(instrument, ts, direction, low, high)``, one row each, -> status, is_degraded, the selected cluster and its ``zones``.

    A zone matches if the bar's range comes as near as its tolerance.  Without an average range only a touch matches and the result is degraded, as it
    is without a timeframe or a source.  Matches whose zones, tolerances included, overlap are one cluster; the cluster with most sources, then
    timeframes, touches, reported matches, the least mean distance, the least width and the first name is selected."""
    keys = ["instrument", "ts", "direction"]
    seen = evaluations.withColumn("_t", F.lit(0).cast("long"))
    for tf, f in features.items():
        right = f.select("instrument", F.col("as_of").alias("ts"), F.lit(0).cast("long").alias("_t"), "atr", "session", "support", "support_ts", "resistance", "resistance_ts", "gaps", "vwap", "value_area_low", "value_area_high")
        seen = last_before(seen, right, "instrument", "ts", "_t", f"_{tf}")
    there = {"structural_level": lambda f: f.isNotNull(), "fair_value_gap": lambda f: f.isNotNull(), "value_area_edge": lambda f: f["value_area_low"].isNotNull(), "session_vwap": lambda f: f["vwap"].isNotNull()}
    usable = {s.kind: F.array_contains(F.array(*(F.coalesce(there[s.kind](F.col(f"_{tf}")), F.lit(False)) for tf in s.timeframes)), True) for s in sources}
    missing = [F.col(f"_{tf}").isNull() for s in sources for tf in s.timeframes] + [~u for u in usable.values()]
    gap = lambda z: F.when(F.col("high") < z["lower"], z["lower"] - F.col("high")).when(F.col("low") > z["upper"], F.col("low") - z["upper"]).otherwise(F.lit(0.0))
    rows = seen.withColumn("_z", F.concat(*(_zones(s, tf) for s in sources for tf in s.timeframes)))
    rows = rows.select(*keys, "_z", "low", "high", F.array_contains(F.array(*usable.values()), True).alias("_any"), F.array_contains(F.array(*missing), True).alias("_missing"))
    blind = F.exists("_z", lambda z: z["tolerance"].isNull() & (gap(z) > 0))
    near = F.filter("_z", lambda z: gap(z) <= F.coalesce(z["tolerance"], F.lit(0.0)))
    rows = rows.withColumns({"is_degraded": F.col("_missing") | blind, "_m": F.transform(near, lambda z: F.struct(z.alias("z"), gap(z).alias("distance")))})
    match = rows.select(*keys, "_any", "is_degraded", F.explode_outer("_m").alias("_m"))
    slack = F.coalesce(F.col("_m.z.tolerance"), F.lit(0.0))
    match = match.withColumns({"_lo": F.col("_m.z.lower") - slack, "_hi": F.col("_m.z.upper") + slack, "_slack": slack})
    by = Window.partitionBy(*keys).orderBy("_lo", "_hi", "_m.z.zone_id")
    reach = F.max("_hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    match = match.withColumn("_new", F.when(reach.isNull() | (F.col("_lo") > reach), 1).otherwise(0)).withColumn("_c", F.sum("_new").over(by))
    z = F.struct("_m.z.zone_id", "_m.z.lower", "_m.z.upper", F.col("_slack").alias("tolerance"))
    clusters = match.groupBy(*keys, "_any", "is_degraded", "_c").agg(
        F.count("_m").alias("n"), F.countDistinct("_m.z.source").alias("sources"), F.countDistinct("_m.z.timeframe").alias("timeframes"), F.count_if(F.col("_m.distance") == 0).alias("touches"), F.count_if(F.col("_m.z.reported")).alias("reported"),
        F.round(F.avg(F.when(F.col("_slack") == 0, 0.0).otherwise(F.col("_m.distance") / F.col("_slack"))), 6).alias("mean_distance"), F.min("_lo").alias("lower"), F.max("_hi").alias("upper"),
        F.sort_array(F.collect_list(F.when(F.col("_m").isNotNull(), z))).alias("zones"))
    ids = F.array_join(F.transform("zones", lambda x: x["zone_id"]), ",")
    order = F.struct(-F.col("sources"), -F.col("timeframes"), -F.col("touches"), -F.col("reported"), F.col("mean_distance"), F.round(F.col("upper") - F.col("lower"), 6), ids)
    columns = ["n", "sources", "timeframes", "touches", "reported", "mean_distance", "lower", "upper", "zones"]
    best = clusters.groupBy(*keys, "_any", "is_degraded").agg(F.min_by(F.struct(*columns), order).alias("b"), F.count_if(F.col("n") > 0).alias("n_clusters"))
    status = F.when(F.col("b.sources") >= minimum_sources, "qualified").when(F.col("b.n") > 0, "insufficient_confluence").when(~F.col("_any"), "missing_evidence").otherwise("not_at_location")
    return best.select(*keys, status.alias("status"), "is_degraded", "n_clusters", F.col("b.n").alias("n_matches"), *(f"b.{c}" for c in columns[1:]))

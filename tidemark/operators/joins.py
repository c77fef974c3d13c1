"""Join shapes of market research: point-in-time bundles, intervals, overlaps, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import last_before, micros


def point_in_time(evaluations: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """For every ``evaluations(instrument, ts, seq)`` the latest committed feature of each timeframe at or before it.

    ``features[tf](instrument, ts, seq, value)``; one as-of step per timeframe."""
    out = evaluations
    for tf, f in features.items():
        out = last_before(out, f, "instrument", "ts", "seq", f"_{tf}").withColumn(f"{tf}_as_of", F.col(f"_{tf}.ts")).withColumn(f"{tf}_value", F.col(f"_{tf}.value")).drop(f"_{tf}")
    return out


def asof_with_ties(left: DataFrame, right: DataFrame, key: str, max_age_seconds: int, status: str = "status") -> DataFrame:
    """All rows of ``right(key, as_of, id)`` at the latest as_of at or before ``left(key, ts)``; missing, stale, ambiguous or matched."""
    days = 86_400_000_000
    keyed = right.groupBy(key, "as_of").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    seen = last_before(left.withColumn("_t", F.lit(0).cast("long")), keyed.select(F.col(key), F.col("as_of").alias("ts"), F.lit(0).cast("long").alias("_t"), "ids"), key, "ts", "_t", "_m", days // 1_000_000).drop("_t")
    age = micros(F.col("ts")) - micros(F.col("_m.ts"))
    return seen.withColumn(status, F.when(F.col("_m").isNull(), "missing").when(age > max_age_seconds * 1_000_000, "stale").when(F.size("_m.ids") > 1, "ambiguous").otherwise("matched")).withColumn("as_of", F.col("_m.ts")).withColumn("n_matches", F.coalesce(F.size("_m.ids"), F.lit(0)).cast("long")).drop("_m")


def interval_join(left: DataFrame, right: DataFrame, key: str, before_seconds: int, after_seconds: int) -> DataFrame:
    """Pairs of ``left(key, ts, ..)`` and ``right(key, rts, ..)`` with rts in [ts - before, ts + after].

    An equi-join on (key, time cell): left rows are repeated over the one or two cells that their interval touches."""
    cell = (before_seconds + after_seconds) * 1_000_000 or 1
    lo, hi = micros(F.col("ts")) - before_seconds * 1_000_000, micros(F.col("ts")) + after_seconds * 1_000_000
    spread = left.withColumn("_c", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    cells = right.withColumn("_c", F.floor(micros(F.col("rts")) / cell))
    return spread.join(cells, [key, "_c"]).where(micros(F.col("rts")).between(micros(F.col("ts")) - before_seconds * 1_000_000, micros(F.col("ts")) + after_seconds * 1_000_000)).drop("_c")


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of zones ``left(key, id, lower, upper)`` and ``right(key, rid, rlower, rupper)`` that overlap or touch.

    Zones are spread over price cells of ``width``; a pair is taken in the first cell both touch, so once."""
    c = lambda x: F.floor(F.col(x).cast("double") / width)
    l = left.withColumn("_lc", c("lower")).withColumn("_c", F.explode(F.sequence(c("lower"), c("upper"))))  # noqa: E741
    r = right.withColumn("_rc", c("rlower")).withColumn("_c", F.explode(F.sequence(c("rlower"), c("rupper"))))
    return l.join(r, [key, "_c"]).where((F.col("lower") <= F.col("rupper")) & (F.col("upper") >= F.col("rlower")) & (F.col("_c") == F.greatest("_lc", "_rc"))).drop("_c", "_lc", "_rc")


def missing_required(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Required keys that are not available."""
    return required.join(available.select(key).distinct(), key, "left_anti")


def unique_lookup(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Join that expects one candidate; ``candidates`` counts them, and more are flagged as ``ambiguous`` or, if ``strict``, fail the batch."""
    out = left.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.min("replacement").alias("replacement")), keys).withColumn("ambiguous", F.col("candidates") > 1)
    if strict:
        stop = F.raise_error(F.concat(F.lit("several candidates for "), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))).cast("boolean")
        return out.where(F.when(F.col("ambiguous") & (F.monotonically_increasing_id() >= 0), stop).otherwise(F.lit(True)))  # kept above the join by a value of the row
    return out


def clusters(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping ``matches(keys, lower, upper, source, touches, distance)`` along the price axis."""
    w = Window.partitionBy(*keys).orderBy("lower", "upper")
    reach = F.max("upper").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = matches.withColumn("_n", F.when(reach.isNull() | (F.col("lower") > reach), 1).otherwise(0)).withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(*keys, "cluster").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.count(F.lit(1)).alias("n_matches"), F.countDistinct("source").alias("n_sources"), F.sum("touches").alias("touches"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def best_cluster(clusters_: DataFrame, keys: list[str]) -> DataFrame:
    """Lexicographic pick: most sources, most matches, most touches, nearest, narrowest, lowest, first."""
    width = (F.col("upper") - F.col("lower")).cast("double")
    order = F.struct(-F.col("n_sources"), -F.col("n_matches"), -F.col("touches"), F.col("mean_distance"), width, F.col("lower").cast("double"), F.col("cluster"))
    return clusters_.groupBy(*keys).agg(F.min_by(F.struct("cluster", "lower", "upper", "n_sources", "n_matches"), order).alias("b")).select(*keys, "b.*")


def forward_outcome(events: DataFrame, bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Return, best and worst excursion over the next N bars of the session, by ordinal, for each event and horizon.

    ``events(instrument, session, ordinal, reference, sign)``; a horizon whose bars do not all exist is unavailable with a reason."""
    top = max(horizons)
    spread = events.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top)))).withColumn("_o", F.col("ordinal") + F.col("k"))
    ahead = spread.join(bars.select("instrument", "session", F.col("ordinal").alias("_o"), "open_ts", "high", "low", "close"), ["instrument", "session", "_o"])
    d = lambda c: F.col(c).cast("double")
    move = lambda c: F.col("sign") * (d(c) - F.col("reference"))
    best = F.when(F.col("sign") > 0, d("high") - F.col("reference")).otherwise(F.col("reference") - d("low"))
    worst_ = F.when(F.col("sign") > 0, F.col("reference") - d("low")).otherwise(d("high") - F.col("reference"))
    rows = ahead.select("event_id", "k", move("close").alias("ret"), best.alias("best"), worst_.alias("worst"), "open_ts")
    per = events.select("event_id", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).join(rows, "event_id", "left").where("k IS NULL OR k <= horizon")
    out = per.groupBy("event_id", "horizon").agg(F.count("k").alias("n"), F.max_by("ret", "k").alias("ret"), F.max("best").alias("mfe"), F.max("worst").alias("mae"))
    full = events.select("event_id", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).join(out, ["event_id", "horizon"], "left")
    ok = F.coalesce("n", F.lit(0)) == F.col("horizon")
    v = lambda c: F.round(F.when(ok, F.col(c)), 6).alias(c)
    pos = lambda c: F.round(F.when(ok, F.greatest(F.col(c), F.lit(0.0))), 6).alias(c)
    return full.select("event_id", F.col("horizon").cast("long").alias("horizon"), v("ret"), pos("mfe"), pos("mae"), F.when(~ok, "bars_missing").alias("reason"))


def ordered_unique(col: Column) -> Column:
    return F.array_distinct(col)

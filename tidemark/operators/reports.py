"""Reports, guards and small rules over finished tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import sorted_fold, with_halo, without_halo


def detections(revisions: DataFrame, keys: list[str], ignored: list[str]) -> DataFrame:
    """``revisions(keys, commit_sequence, as_of, state)`` in commit order -> the status of each: SEEDED, STALE (an older time than was seen),
    CORRECTION (the newest time again), TRANSITION or UNCHANGED against the last revision that was not stale."""
    w = Window.partitionBy(*keys).orderBy("commit_sequence")
    top = F.max("as_of").over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = revisions.withColumn("_top", top).withColumn("_stale", F.coalesce(F.col("as_of") < F.col("_top"), F.lit(False)))
    last = F.last(F.when(~F.col("_stale"), F.struct("as_of", "state")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = ~F.col("state").isin(*ignored) & ~F.col("_l.state").isin(*ignored)
    status = (
        F.when(F.col("_l").isNull(), "SEEDED").when(F.col("_stale"), "STALE").when(F.col("as_of") == F.col("_l.as_of"), "CORRECTION")
        .when(known & (F.col("state") != F.col("_l.state")), "TRANSITION").otherwise("UNCHANGED"))
    rows = seen.withColumn("_l", last).withColumn("status", status)
    return rows.withColumn("from_state", F.when(F.col("status") == "TRANSITION", F.col("_l.state"))).drop("_top", "_stale", "_l")


def recent_identities(events: DataFrame, key: str, order: str, identity: str, capacity: int, schema: str) -> DataFrame:
    """Whether an event's identity is among the last ``capacity`` distinct ones of its stream; seeing it again renews it."""

    def make():
        seen: dict = {}  # in order of last sight, never more than the capacity

        def step(r):
            old = r[2] in seen
            seen.pop(r[2], None)
            seen[r[2]] = None
            if len(seen) > capacity:
                del seen[next(iter(seen))]
            return [(r[0], r[1], r[2], old)]

        return step

    return sorted_fold(events.select(key, order, identity), [key], [order], f"{schema}, duplicate boolean", make)


def nearest(rows: DataFrame, keys: list[str], distance: Column, k: int, *shown: str) -> DataFrame:
    """The ``k`` rows of least distance of each key: a top-k list for display."""
    w = Window.partitionBy(*keys).orderBy("_d", *shown)
    out = rows.withColumn("_d", distance).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(*keys, *shown, F.round(F.col("_d"), 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def dispatch_within(queue: DataFrame, capacity: int) -> DataFrame:
    """Queued requests of each provider by falling priority, then id, while slots are free: requests in flight take some."""
    busy = queue.groupBy("provider").agg(F.count_if(F.col("status") == "running").alias("in_flight"))
    w = Window.partitionBy("provider").orderBy(F.desc("priority"), "id")
    waiting = queue.where("status = 'queued'").withColumn("place", F.row_number().over(w).cast("long"))
    return waiting.join(busy, "provider").where(F.col("place") <= capacity - F.col("in_flight")).select("provider", "id", "priority", "place", "in_flight")


def reference_report(records: DataFrame) -> DataFrame:
    """``records(instrument, complete, joined, missing)`` -> annotations, complete and draft counts by join status."""
    n = F.count(F.lit(1))
    return records.groupBy("instrument", "joined").agg(n.alias("annotations"), F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("draft"), F.sum("missing").alias("missing_fields"))


def outcome_by(outcomes: DataFrame, dimension: str) -> DataFrame:
    """Favourable share and medians of ``outcomes(.., ret, mfe, mae)`` by one dimension and horizon."""
    med = lambda c: F.round(F.median(c), 6)
    share = F.round(100.0 * F.count_if(F.col("ret") > 0) / F.nullif(F.count("ret"), F.lit(0)), 4)
    return outcomes.groupBy(F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("value"), "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count("ret").alias("available"), share.alias("favourable_pct"), med("ret").alias("median_return"), med("mfe").alias("median_mfe"), med("mae").alias("median_mae"))


def contract_coverage(contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of contracts with a two-sided quote, and with each Greek that is a finite number."""
    n = F.count(F.lit(1))
    have = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pct = lambda x: F.round(100.0 * x / n, 4)
    quoted, greeks = F.count_if(have("bid") & have("ask")), [F.count_if(have(g)) for g in ("delta", "gamma", "vega", "theta")]
    every = F.count_if(have("delta") & have("gamma") & have("vega") & have("theta"))
    return contracts.groupBy(*keys).agg(n.alias("contracts"), quoted.alias("quoted"), pct(quoted).alias("quoted_pct"), *(g.alias(f"with_{name}") for g, name in zip(greeks, ("delta", "gamma", "vega", "theta"), strict=True)), pct(every).alias("greeks_pct"))


def parameter_faults(value: Column, low: Decimal | None = None, high: Decimal | None = None, step: Decimal | None = None, allowed: tuple = ()) -> Column:
    """What a parameter's value breaks of its envelope: missing, bounds, grid, list."""
    return F.array_join(F.array_compact(F.array(
        F.when(value.isNull(), "missing"),
        F.when(value < F.lit(low), "below_minimum") if low is not None else F.lit(None),
        F.when(value > F.lit(high), "above_maximum") if high is not None else F.lit(None),
        F.when((value - F.lit(low or 0)) % F.lit(step) != 0, "off_grid") if step else F.lit(None),
        F.when(~value.isin(*allowed), "not_allowed") if allowed else F.lit(None))), ",")


def running_peak(samples: DataFrame, key: str, order: list[str], value: str, window: int) -> DataFrame:
    """Peak so far and growth over the last ``window`` samples."""
    w = Window.partitionBy(key, "_b").orderBy(*order)
    rows = with_halo(samples, [key], order, window).withColumn("growth", F.col(value) - F.lag(value, window).over(w))
    rows = rows.withColumn("_in", F.max(F.when(~F.col("_halo"), F.col(value))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = rows.where("NOT _halo").groupBy(key, "_b").agg(F.max(value).alias("_m"))
    tops = tops.select(key, "_b", F.max("_m").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_up"))
    out = rows.join(tops, [key, "_b"]).withColumn("peak", F.greatest("_in", "_up"))
    return without_halo(out).drop("_in", "_up")


def print_count(text: Column) -> Column:
    """The number of prints out of a reason such as ``3 prints in 250ms``; null where there is none."""
    found = F.regexp_extract(text, r"(\d+) prints?", 1)
    return F.when(found != "", found.cast("long"))

"""Bar intake: adapters, calendar-aware normalization, bounded stores, late arrivals, restart seeds, lineage."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import sorted_fold, with_halo, without_halo
from tidemark.functions.timeops import anchored_floor, from_micros, micros
from tidemark.operators.bars import ohlcv
from tidemark.operators.normalize import source_quality
from tidemark.operators.schedule import evaluate

#: Supported timeframes of analysis bars, in seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14_400, "1d": 86_400}


def analysis_bars(bars: DataFrame) -> DataFrame:
    """``bars(.., timeframe, source, open_ts, is_complete)`` -> close_ts, input_fidelity and ``reject_reason`` (null: accepted)."""
    seconds = F.coalesce(*(F.when(F.col("timeframe") == t, F.lit(s)) for t, s in TIMEFRAMES.items()))
    fidelity = F.when(F.col("source") == "classified_ticks", "inferred").otherwise("reported")
    reject = F.when(seconds.isNull(), "unsupported_timeframe").when(~F.col("is_complete"), "incomplete")
    return bars.withColumns({"close_ts": from_micros(micros(F.col("open_ts")) + seconds.cast("long") * 1_000_000), "input_fidelity": fidelity, "reject_reason": reject})


def completed_bars(raw: DataFrame, calendar: DataFrame, interval_seconds: int) -> DataFrame:
    """``raw(.., ts_event, policy, source_kind, evidence, volume, volume_supported, received_ts)`` -> a completed bar.

    ``policy`` says whether the provider stamps the start or the end of an interval; the session is that of the interval's last
    instant; an unsupported volume is null with a reason; a bar without a trade date or with another policy is refused."""
    at, step = micros(F.col("ts_event")), interval_seconds * 1_000_000
    begin = F.when(F.col("policy") == "interval_start", at).when(F.col("policy") == "interval_end", at - step)
    rows = raw.withColumns({"interval_start": from_micros(begin), "interval_end": from_micros(begin + step), "_last": from_micros(begin + step - 1)})
    health, fidelity = source_quality(F.col("source_kind"), F.col("evidence"))
    out = evaluate(rows, "_last", calendar)
    return out.withColumns({
        "session_id": F.concat_ws(":", F.to_date("trade_date").cast("string"), "phase"), "health": health, "fidelity": fidelity,
        "volume": F.when(F.col("volume_supported"), F.col("volume")),
        "missing_reasons": F.when(F.col("volume_supported"), "").otherwise("volume_unsupported"),
        "received_ts": F.greatest("received_ts", "interval_end"),
        "reject_reason": F.when(F.col("interval_start").isNull(), "unsupported_timestamp_policy").when(F.col("trade_date").isNull(), "no_trade_date"),
    }).drop("_last")


def recalculations(bars: DataFrame) -> DataFrame:
    """``bars(instrument, open_ts, close, arrival)`` -> every calculation that the arrivals cause: the bar itself, and its successor
    again if that had arrived before (its prior close changed).  Rows: instrument, arrival, open_ts, prior_open_ts.

    Contiguous bars: the neighbours of a bar are the next rows in time, so one look at either side decides."""
    w = Window.partitionBy("instrument", "_b").orderBy("open_ts")
    item = F.struct("open_ts", "arrival", "close_ts")
    rows = with_halo(bars.select("instrument", "open_ts", "close_ts", "arrival"), ["instrument"], ["open_ts"], 1).withColumn("_p", F.lag(item).over(w))
    rows = without_halo(rows).withColumn("_p", F.when(F.col("_p.close_ts") == F.col("open_ts"), F.col("_p")))
    known = F.when(F.col("_p.arrival") < F.col("arrival"), F.col("_p.open_ts"))
    own = rows.select("instrument", "arrival", "open_ts", known.alias("prior_open_ts"))
    again = rows.where(F.col("_p.arrival") > F.col("arrival")).select("instrument", F.col("_p.arrival").alias("arrival"), "open_ts", F.col("_p.open_ts").alias("prior_open_ts"))
    return own.unionByName(again)


def seeded_aggregate(warm: DataFrame, live: DataFrame, base_seconds: int, seconds: int) -> DataFrame:
    """Longer bars that the live bars complete after a restart: a bucket that was still forming is seeded from the warm bars, one
    that the warm bars had completed already is not emitted again."""
    n = seconds // base_seconds
    both = warm.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    first = both.groupBy("instrument", "open_ts").agg(F.min_by(F.struct(*[c for c in both.columns if c not in ("instrument", "open_ts")]), "_live").alias("b")).select("instrument", "open_ts", "b.*")
    out = first.withColumn("bucket", anchored_floor(F.col("open_ts"), seconds)).groupBy("instrument", "bucket").agg(*ohlcv(), F.count(F.lit(1)).alias("n"), F.max("_live").alias("_live"))
    return out.where((F.col("n") == n) & (F.col("_live") == 1)).drop("n", "_live")


class NewestHeld:
    """The newest ``most`` (time, payload) of one key; ``held`` is all that it remembers."""

    def __init__(self, most: int, held: dict | None = None):
        self.most, self.held = most, dict(held or {})
        self.order = list(self.held)
        heapq.heapify(self.order)

    def admit(self, at, payload) -> tuple:
        """(status, evicted time or None) of one arrival."""
        if at in self.held:
            return "DUPLICATE" if self.held[at] == payload else "CONFLICT", None
        self.held[at] = payload
        heapq.heappush(self.order, at)
        if len(self.held) <= self.most:
            return "ACCEPTED", None
        gone = heapq.heappop(self.order)
        del self.held[gone]
        return "ACCEPTED", gone


def bounded_store(rows: DataFrame, keys: list[str], most: int, schema: str) -> DataFrame:
    """Admission of ``rows(keys, arrival, open_ts, payload)`` to a store of the newest ``most`` bars of each key: ACCEPTED, DUPLICATE or
    CONFLICT against what is held, and which bar each acceptance evicts (the oldest; possibly itself).

    ``schema`` names the keys' types.  The fold keeps ``most`` bars at a time."""

    def make():
        store = NewestHeld(most)
        return lambda r: [(*r[: len(keys)], r.arrival, r.open_ts, *store.admit(r.open_ts, r.payload))]

    return sorted_fold(rows.select(*keys, "arrival", "open_ts", "payload"), keys, ["arrival"], f"{schema}, arrival bigint, open_ts timestamp_ntz, status string, evicted_ts timestamp_ntz", make)


def session_book(bars: DataFrame, most: int) -> DataFrame:
    """Summaries of each instrument's newest ``most`` sessions.  What is kept depends on the sessions' dates alone, so any order of arrival
    gives the same book; ranks are taken over the one row per session that the aggregation leaves."""
    out = bars.groupBy("instrument", "session").agg(
        F.min_by("open", "open_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"), F.max("close_ts").alias("last_ts"))
    newest = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("session")))
    return out.withColumn("_r", newest).where(F.col("_r") <= most).drop("_r")


def lineages(bars: DataFrame) -> DataFrame:
    """Per (instrument, timeframe, source, input_fidelity): bounds, count and a hash over the ordered bars.

    The bars are hashed one by one and then per day, so that the ordered text of a group holds one hash a day."""
    one = F.sha2(F.concat_ws("|", F.date_format("open_ts", "yyyy-MM-dd HH:mm:ss"), *(F.col(c).cast("double").cast("decimal(18,6)").cast("string") for c in ("open", "high", "low", "close", "volume"))), 256)
    keys = ["instrument", "timeframe", "source", "input_fidelity"]
    joined = lambda order, h: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(h).alias("h")))), lambda x: x["h"]), ","), 256)
    days = bars.withColumns({"_h": one, "_d": F.to_date("open_ts")}).groupBy(*keys, "_d").agg(
        F.min("open_ts").alias("start_ts"), F.max("close_ts").alias("end_ts"), F.count(F.lit(1)).alias("event_count"), joined("open_ts", "_h").alias("_h"))
    return days.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("event_count").alias("event_count"), joined("_d", "_h").alias("identity_hash"))


def feature_envelopes(snapshots: DataFrame, lineage: DataFrame, feature_set: str, version: str, configuration: str) -> DataFrame:
    """``snapshots(instrument, timeframe, as_of, source, input_fidelity, payload)`` with their ``lineage`` rows -> feature_id (hash of the
    identity, lineage included) and content_hash (hash of identity and payload)."""
    item = F.concat_ws("~", "source", "timeframe", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss"), "identity_hash", "input_fidelity", F.col("event_count").cast("string"))
    inputs = lineage.withColumn("_i", item).groupBy("instrument").agg(F.array_join(F.sort_array(F.collect_list("_i")), ",").alias("inputs"), F.count(F.lit(1)).alias("n_inputs"))
    identity = F.concat_ws("|", F.lit(feature_set), F.lit(version), F.lit(configuration), "instrument", "timeframe", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), "source", "input_fidelity", "inputs")
    out = snapshots.join(inputs, "instrument").withColumn("feature_id", F.sha2(identity, 256))
    return out.withColumn("content_hash", F.sha2(F.concat_ws("|", "feature_id", "payload"), 256)).drop("inputs")


def conflict_free(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """One row per key; a key with two contents fails the batch."""
    whole = F.struct(*rows.columns)
    seen = rows.groupBy(key).agg(F.min(whole).alias("_w"), F.min(content).alias("_lo"), F.max(content).alias("_hi"))
    stop = F.raise_error(F.concat(F.lit("conflicting content for "), F.col(key).cast("string"))).cast("boolean")
    return seen.where(F.when(~F.col("_lo").eqNullSafe(F.col("_hi")), stop).otherwise(F.lit(True))).select("_w.*")
